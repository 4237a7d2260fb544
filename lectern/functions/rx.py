"""Regular expressions with Unicode classes and newline-only line ends, and ordered rewriting."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags by letter: d (only \n ends a line), U (Unicode classes); i and m as wanted.
FLAGS = "dU"


def rx(pattern: str, flags: str = "") -> str:
    return f"(?{flags}{FLAGS}){pattern}"


def literal(text: str) -> str:
    """text as part of a pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def sub(value: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(value, rx(pattern, flags), replacement)


def matches(value: Column, pattern: str, flags: str = "") -> Column:
    return value.rlike(rx(pattern, flags))


def rewrite(value: Column, rules: Iterable[tuple[str, str] | tuple[str, str, str]]) -> Column:
    """Apply (pattern, replacement[, flags]) one after the other."""
    for rule in rules:
        value = sub(value, *rule)
    return value


#: What \s is in a pattern with Unicode classes.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column) -> Column:
    # a pattern would be tried at each character between the ends
    return F.btrim(value, F.lit(WHITE))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def holds(*marks: str) -> Callable[[Column], Column]:
    """Whether a text has one of the marks, by its bytes: a small part of what a pattern takes."""
    return lambda value: reduce(or_, (F.contains(value, F.lit(m)) for m in marks))


def rewrite_held(value: Column, rules: Iterable[tuple[str, str, str] | tuple[str, str, str, str]]) -> Column:
    """Apply (mark, pattern, replacement[, flags]) one after the other, each to texts that hold its mark: a text without it
    must be one that the rule leaves as it is. One lambda for all, since the analyzer takes a round for each in a chain."""
    listed = [F.struct(F.lit(m).alias("mark"), F.lit(rx(p, *f)).alias("key"), F.lit(r).alias("name")) for m, p, r, *f in rules]
    held = lambda text, r: F.when(F.contains(text, r["mark"]), F.regexp_replace(text, r["key"], r["name"])).otherwise(text)
    return F.aggregate(F.array(*listed), value, held)


def position(value: Column, pattern: Column) -> Column:
    """0-based offset of the first match of a whole pattern, flags and all, -1 if there is none."""
    head = F.split(value, pattern, 2)
    return F.when(F.rlike(value, pattern), F.length(head[0])).otherwise(F.lit(-1))


#: A pattern that matches nothing.
NEVER = "(?!)"


def of_language(lang: str | Column, values: dict, default, kind: str = "string") -> Column:
    """The value of a language, which is given or in a column; of a SQL type, from plain Python values.

    A rule that depends on the language is a value that is looked up, so that a
    step is planned once and not once a language. The table is one constant:
    thousands of literals would take longer to plan than to run.
    """
    constant = lambda x, t: F.lit(x) if t == "string" else F.from_json(F.lit(json.dumps(x)), t)
    if isinstance(lang, str):
        return constant(values.get(lang, default), kind)
    return F.coalesce(F.try_element_at(constant(values, f"map<string,{kind}>"), lang), constant(default, kind))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]
