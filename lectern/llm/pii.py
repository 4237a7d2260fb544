"""Personal data by weak supervision.

Fixed patterns find e-mail and IP addresses, card and phone numbers. Wider
patterns propose further spans. Labelers vote on every proposed and every
fixed span: the shape of the span (regex), lists of known parts (gazetteer) and
the words before it (context). Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is; the posteriors then train a
span classifier over shape features, and proposed spans that it accepts are
added. Fixed spans always stay.

DataFrame functions only: spans are arrays of their document, written once, so
there is no shuffle but that of the counts. The counts have a bounded number of
rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let
from lectern.storage import written

#: Kinds in the order in which spans that start together are listed; the last two are only proposed.
KINDS = ("email", "ip", "card", "phone", "tel", "address")
BASE = KINDS[:4]

# The patterns are the contract's, with possessive quantifiers where nothing can be given back and a look
# behind where a match can't begin inside a run, so that no text takes more than linear time.
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "tel": r"(?<![+0-9A-Za-z.-])(?:\([0-9]{2,4}\)\x20?+|[0-9]{2,4}[\x20.-])[0-9]{2,4}[\x20.-][0-9]{2,5}(?![0-9A-Za-z-])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}"
    r"(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}",
}
#: What a text must hold for a pattern to be tried.
_GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike("[0-9]"),
    "card": lambda t: t.rlike("[0-9]"),
    "phone": lambda t: t.contains("+"),
    "tel": lambda t: t.rlike("[0-9]"),
    "address": lambda t: t.rlike(r"[\[(]at[\])]"),
}
#: Words before a span that speak for personal data, in the documents' languages, and against it.
CONTEXT_FOR = "tel|phone|mobile|cell|call|fax|contact|mail|reach|card|visa|telefon|handy|anruf|appelez|téléphone|teléfono|móvil|llame|correo"
CONTEXT_AGAINST = "order|page|version|isbn|invoice|model|serial|part|token|hash|seite|bestell|commande|pedido|página"
#: Parts known from directories: mail providers, area codes set aside for examples, card issuers' first digits.
GAZETTEER = {
    "email": r"@(?:gmail|yahoo|outlook|hotmail|gmx|web|orange|free|icloud|mail[0-9]*)\.|\.(?:com|org|net|de|fr|es|it|pt)$",
    "ip": r"^(?!0|127\.|255)",
    "card": r"^(?:4|5[1-5]|3[47]|6011|2[2-7])",
    "phone": r"^\+(?:1|33|34|39|44|49|351)[^0-9]",
    "tel": r"(?:555|0800|\(0[1-9])",
    "address": r"(?:gmail|yahoo|outlook|hotmail|gmx|com|org|net)",
}
#: Characters before a span that the context labeler sees.
BEFORE = 32


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(1), F.length(d)),
            lambda i: let(
                F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
                lambda x: F.when(x > 9, x - 9).otherwise(x),
            ),
        )
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    return let(_digits(value), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), total(d) % 10 == 0))


_CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "tel": lambda v: F.length(_digits(v)).between(7, 12),
    "address": lambda v: F.lit(True),
}
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string>>"


def _running(lengths: Column, combine=lambda a, b: a + b, start: int = 0) -> Column:
    """Running sums of an array of numbers, or what else combines them, by doubling: the array is passed over as often as
    its length has bits."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths) + 1)).cast("int"))

    def step(sums: Column, j: Column) -> Column:
        n = F.least(F.pow(F.lit(2), j).cast("int"), F.size(sums))
        moved = F.concat(F.array_repeat(F.lit(start).cast("long"), n), F.slice(sums, 1, F.size(sums) - n))
        return F.zip_with(sums, moved, combine)

    return F.aggregate(steps, lengths, step)


def _matches(text: Column, kind: str) -> Column:
    """The valid matches of one kind with their places and the end of the text between the match before and them."""
    pattern = PATTERNS[kind]

    def spans(values: Column, parts: Column) -> Column:
        gap = lambda v, i: (F.length(F.get(parts, i)) + F.coalesce(F.length(F.get(values, i - 1)), F.lit(0))).cast("long")
        return let(
            _running(F.transform(values, gap)),
            lambda starts: F.filter(
                F.transform(
                    values,
                    lambda v, i: F.struct(
                        F.lit(kind).alias("kind"),
                        F.get(starts, i).alias("start"),
                        (F.get(starts, i) + F.length(v)).alias("end"),
                        v.alias("value"),
                        F.right(F.get(parts, i), F.lit(BEFORE)).alias("before"),
                    ),
                ),
                lambda s: _CHECKS[kind](s["value"]),
            ),
        )

    none = F.array().cast(_SPAN)
    found = let(
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda values: F.when(
            F.exists(values, _CHECKS[kind]), let(F.split(text, pattern, -1), lambda parts: spans(values, parts))
        ).otherwise(none),
    )
    return F.when(_GUARDS[kind](text), found).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and proposed: arrays of spans; proposed ones overlap no base span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    found = base.select("doc_id", *[_matches(F.col("_text"), k).alias(k) for k in KINDS])
    fixed = F.concat(*[F.col(k) for k in BASE])
    more = F.concat(*[F.col(k) for k in KINDS[4:]])
    apart = F.when((F.size(fixed) == 0) | (F.size(more) == 0), more).otherwise(_apart(fixed, more))
    return found.select("doc_id", fixed.alias("base"), apart.alias("proposed"))


def _apart(fixed: Column, more: Column) -> Column:
    """The spans of more that overlap none of fixed.

    Both are put in one order by their starts. A span is overlapped from before if a fixed one before it ends after its
    start, and from behind if one after it starts before its end: running maxima and minima, so that nothing grows with
    the product of their numbers.
    """
    each = lambda spans, held: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(held).alias("held"), s.alias("span"))
    )
    none, far = -1, 1 << 62

    def judged(every: Column) -> Column:
        ends = _running(F.transform(every, lambda x: F.when(x["held"] == 1, x["end"]).otherwise(none)), lambda a, b: F.greatest(a, b), none)
        starts = F.transform(F.reverse(every), lambda x: F.when(x["held"] == 1, x["start"]).otherwise(F.lit(far)))
        following = F.reverse(_running(starts, lambda a, b: F.least(a, b), far))

        def kept(e: Column) -> Column:
            free = lambda x, i: (x["held"] == 0) & (F.get(e["ends"], i) <= x["start"]) & (F.get(e["following"], i) >= x["end"])
            return F.transform(F.filter(every, free), lambda x: x["span"])

        return let(F.struct(ends.alias("ends"), following.alias("following")), kept)

    return let(F.array_sort(F.concat(each(fixed, 1), each(more, 0))), judged)


#: Strict shapes, for the regex labeler.
SHAPES = {
    "email": r"^[A-Za-z][A-Za-z0-9._-]*+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",  # dots in a span stand between labels
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3})$",
    "phone": r"^\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}$",
    "tel": r"^(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$",
    "address": r"[\[(]at[\])].*(?:[\[(]dot[\])]|\.)",
}


def _by_kind(span: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(False)
    for kind, pattern in patterns.items():
        out = F.when(span["kind"] == kind, span["value"].rlike(pattern)).otherwise(out)
    return out


def votes(span: Column) -> Column:
    """Votes of the regex, gazetteer and context labelers as a text of three digits: 0 against, 1 for, 2 none."""
    before = F.lower(span["before"])
    context = (
        F.when(before.rlike(rf"(?U)\b(?:{CONTEXT_FOR})"), "1")
        .when(before.rlike(rf"(?U)\b(?:{CONTEXT_AGAINST})"), "0")
        .otherwise("2")
    )
    return F.concat(
        F.when(_by_kind(span, SHAPES), "1").otherwise("0"),
        F.when(_by_kind(span, GAZETTEER), "1").otherwise("2"),
        context,
    )


def features(span: Column) -> Column:
    """The features of the span classifier: a bounded number of different texts."""
    value, n = span["value"], F.length(_digits(span["value"]))
    flag = lambda name, c: F.concat(F.lit(name), F.when(c, "1").otherwise("0"))
    return F.array(
        F.concat(F.lit("kind:"), span["kind"]),
        F.concat(F.lit("digits:"), F.least(n, F.lit(20)).cast("string")),
        flag("paren:", value.contains("(")),
        flag("dash:", value.contains("-")),
        flag("space:", value.contains(" ")),
        F.concat(F.lit("dots:"), F.least(F.length(value) - F.length(F.replace(value, F.lit("."))), F.lit(4)).cast("string")),
        flag("letter:", value.rlike("[A-Za-z]")),
        F.concat(F.lit("votes:"), votes(span)),
    )


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]]]:
    """The posterior of every vote pattern, and each labeler's P(vote | not personal), P(vote | personal).

    counts: how many spans got each pattern, at most 3 to the power of the number of labelers.
    """
    n = len(next(iter(counts), ""))
    share = 0.5
    table = [{"0": (0.7, 0.2), "1": (0.1, 0.6), "2": (0.2, 0.2)} for _ in range(n)]
    post: dict[str, float] = {}
    for _ in range(rounds):
        for p in counts:
            yes, no = share, 1 - share
            for labeler, vote in zip(table, p, strict=True):
                no, yes = no * labeler[vote][0], yes * labeler[vote][1]
            post[p] = yes / (yes + no)
        all_n = sum(counts.values())
        ones = sum(counts[p] * post[p] for p in counts)
        if not all_n:
            break
        share = min(0.99, max(0.01, (ones + 1) / (all_n + 2)))
        for i in range(n):
            for vote in "012":
                hit = [p for p in counts if p[i] == vote]
                yes = sum(counts[p] * post[p] for p in hit)
                no = sum(counts[p] * (1 - post[p]) for p in hit)
                # a labeler is trusted to be better than chance: smoothed towards that
                prior = {"0": (3.0, 1.0), "1": (1.0, 3.0), "2": (2.0, 2.0)}[vote]
                table[i][vote] = ((no + prior[0]) / (all_n - ones + 6), (yes + prior[1]) / (ones + 6))
    return post, table


def train(spans: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the features and a bias, from a table with one column ``span``.

    Only counts leave the executors: of vote patterns (27 at most) and of
    features within them (some dozens).
    """
    seen = spans.select(votes(F.col("span")).alias("p"), features(F.col("span")).alias("f"))
    rows = (
        seen.select("p", F.explode("f").alias("f")).groupBy("p", "f").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    counts: dict[str, int] = {}
    for r in rows:
        if r["f"].startswith("kind:"):
            counts[r["p"]] = counts.get(r["p"], 0) + r["n"]
    if not counts:
        return {}, -1.0
    post, _ = reliabilities(counts)
    yes = sum(counts[p] * post[p] for p in counts)
    no = sum(counts.values()) - yes
    each: dict[str, list[float]] = {}
    for r in rows:
        w = each.setdefault(r["f"], [0.0, 0.0])
        w[0] += r["n"] * (1 - post[r["p"]])
        w[1] += r["n"] * post[r["p"]]
    # a feature seen too rarely to tell keeps the overall odds
    p1 = (yes + 1) / (yes + no + 2)
    weights = {
        f: math.log((w[1] + 2 * p1) / (w[0] + 2 * (1 - p1))) - math.log(p1 / (1 - p1)) for f, w in sorted(each.items())
    }
    return weights, math.log((yes + 1) / (no + 1))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end), code points, end exclusive, by start and then kind.

    All base spans, and the proposed spans (kinds tel and address) that the
    classifier accepts; it is trained on the same rows. Null text counts as
    empty. Every row is kept; repeated rows count as often as they appear;
    other columns are ignored. Spans of different kinds may start together and
    are then in the order of KINDS. Whole texts are read, in time proportional
    to their length, and to n log n of their spans. An empty table gives no rows.
    """
    # matched once: the spans train the classifier and are filtered by it
    found = written(candidates(docs), "pii-spans")
    spans = found.select(F.explode(F.concat("base", "proposed")).alias("span"))
    weights, bias = train(spans)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None

    def accepted(s: Column) -> Column:
        if table is None:
            return F.lit(False)
        score = F.aggregate(
            features(s), F.lit(float(bias)), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0))
        )
        return score > 0

    order = lambda s: F.struct(
        s["start"].alias("start"),
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"),
        s["end"].alias("end"),
        s["kind"].alias("kind"),
    )
    every = F.concat(F.col("base"), F.filter("proposed", accepted))
    ordered = F.array_sort(F.transform(every, order))
    return found.select(
        "doc_id",
        F.transform(
            ordered,
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        ).alias("spans"),
    )

