"""Quality rules as a bitmask ledger.

Every rule is evaluated once on every document. The ledger keeps what was
measured and one bit per rule that failed. Policies are versioned sets of
rules: applying one is a bitwise AND, and the effect of leaving a rule out
(an ablation) is a bitwise aggregation over the ledger, without a look at the
texts. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let, words

#: Words of a window whose repetition counts.
WINDOW = 8

#: Rule name -> failure condition over the ledger's measurements, in bit order. New rules go to the end.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "stutter": "100 * n_stutter > 30 * n_words",
}

#: Versions are never changed, only added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols"),
    "v2": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "shouting"),
    "v3": ("too_few_words", "repeated_windows", "symbols", "shouting", "stutter"),
}


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeated_words(w: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, the first occurrence included."""

    def covered(places: Column) -> Column:
        # places: the start of each repeated window, ascending; overlapping windows count once
        step = F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")
            ),
        )
        return step["n"]

    def among(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, i: F.struct(
                                x["i"].alias("i"),
                                (
                                    F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                                    | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(places)).otherwise(F.lit(0))

    def windows(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(x) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(WINDOW)]))

    return let(w, lambda x: F.when(F.size(x) < WINDOW, F.lit(0)).otherwise(let(windows(x), among)))


def _stutter(w: Column) -> Column:
    return let(w, lambda x: F.size(F.filter(x, lambda y, i: F.coalesce(F.get(x, i - 1) == y, F.lit(False)))))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, a bit for each rule of RULES that the document fails.

    Measurements: n_words, word_chars (code points in words), n_symbols
    (``#*$%&|<>``), n_lines (lines with a word), n_dup_lines (of those, equal to
    an earlier one), n_repeat_words, n_upper (A-Z), n_stutter (words equal to the
    word before). Null text counts as empty:
    all zero. Every row is kept, repeated ones too, and equal texts measure
    alike; whole texts are read, however long; an empty table gives no rows;
    other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    w = F.col("_words")
    lines = F.col("_lines")
    base = docs.select(F.col("doc_id"), text.alias("_text"))
    parts = base.withColumns(
        {
            "_words": words(F.col("_text")),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    measured = parts.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated_words(w).cast("long").alias("n_repeat_words"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[A-Z]+", ""))).cast("long").alias("n_upper"),
        _stutter(w).cast("long").alias("n_stutter"),
    )
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def apply_policy(entries: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept``: true where no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_alone (rejected by no other rule of it), n_rejected (by the policy).

    One pass over the ledger, grouped by bitmask first; no rows for an empty ledger's counts but zeros.
    """
    chosen = F.lit(mask(POLICIES[version]))
    masks = entries.groupBy(F.col("failed").bitwiseAND(chosen).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    per_rule = [
        F.struct(
            F.lit(r).alias("rule"),
            total(F.col("m").bitwiseAND(F.lit(mask((r,)))) != 0).alias("n_failed"),
            total(F.col("m") == mask((r,))).alias("n_alone"),
            total(F.col("m") != 0).alias("n_rejected"),
        )
        for r in POLICIES[version]
    ]
    return masks.agg(F.array(*per_rule).alias("x")).select(F.inline("x"))
