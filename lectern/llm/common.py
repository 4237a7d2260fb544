"""Column helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs of non-space characters of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda.

    Without this the optimizer may inline value into the lambda, and compute it
    for each element.
    """
    return F.transform(F.array(value), body)[0]


def span_columns(spans: Column, base: tuple[str, ...]) -> dict[str, Column]:
    """n_<kind> for the base kinds, base_sha256 and spans, of an ordered array of (kind, start, end).

    A span reads kind:start:end and spans are joined by commas; base_sha256 is
    the lowercase hexadecimal digest of the base kinds' spans.
    """
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda x: F.array_join(F.transform(x, text), ",")
    number = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    counts = {f"n_{k}": number(k) for k in base}
    return counts | {
        "base_sha256": F.sha2(joined(F.filter(spans, lambda x: x["kind"].isin(*base))), 256),
        "spans": joined(spans),
    }


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until docs has no column of that name, in capital or small letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as it is, dots and all, for F.col and select."""
    return "`{}`".format(name.replace("`", "``"))
