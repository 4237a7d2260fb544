"""A description as an ordered array of sections: readings, gospel and comment; the psalm is left out.

A section is text whose first line is its heading; a comment begins with a
marker. Sections are found by lines, or, if the description is one paragraph,
by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dims
from lectern.functions.rx import NEVER, let, matches, of_language, position, rx, strip, sub, text_or_empty
from lectern.functions.text import (
    COMMENT,
    expand_books,
    expand_cross_references,
    html_to_text,
    known_language,
    normalize_punctuation,
    normalize_verses,
    smooth,
    strip_header_verses,
    strip_inline_verses,
)

# fixed values
_VERSE = r"[\d\s,;.:–\-a-zà-ü]"
_BARE = (
    rf"^(?:\d+\s*)?[A-ZÀ-Ü][a-zà-ü]{{0,6}}(?:\s+\d{_VERSE}*)?\s*$"
    rf"|^[A-ZÀ-Ü][a-zà-ü]+(?:\s+[A-ZÀ-Ü][a-zà-ü]+)?\s+\d{_VERSE}*\s*$"
    rf"|^\d{_VERSE}*$"
)
_LONGEST_ATTRIBUTION, _LONGEST_LABEL = 120, 55


def _spoken(plain: Column, lang: str | Column, flatten: bool) -> Column:
    """normalize() for text that is free of markup already."""
    value = normalize_punctuation(plain, flatten)
    for step in (expand_cross_references, expand_books, normalize_verses):
        value = step(value, lang)
    return smooth(value, lang, flatten)


def text_lines(value: Column) -> Column:
    """The stripped lines of a text that are not empty."""
    return F.filter(F.transform(F.split(text_or_empty(value), "\n"), strip), lambda x: x != "")


def line_index(lines: Column, pattern: Column) -> Column:
    """0-based index of the first line that has the pattern, -1 if none."""
    return F.array_position(F.transform(lines, lambda x: F.rlike(x, pattern)), True).cast("int") - 1


def _patterns(table: dict[str, str], flags: str = "i") -> dict[str, str]:
    return {c: rx(x, flags) for c, x in table.items()}


def attribution_at_end(line: Column) -> Column:
    """(body, meta): a parenthesis that ends the line and names a pope is meta; meta is null if there is none."""
    end = r"\(([^()]+)\)\s*$"
    inner = strip(F.regexp_extract(line, rx(end), 1))
    found = matches(line, end) & matches(inner, dims.POPE_IN_PARENTHESIS, "i")
    body = F.when(found, strip(sub(line, end, ""))).otherwise(strip(line))
    return F.struct(body.alias("body"), F.when(found, inner).alias("meta"))


def attribution_line(lines: Column) -> Column:
    """(meta, at) of the first line that ends with an attribution or is one; null if there is none."""

    def judged(line: Column, i: Column) -> Column:
        inner = strip(F.regexp_extract(line, rx(r"\(([^()]+)\)\s*$"), 1))
        alone = (
            (F.length(line) < _LONGEST_ATTRIBUTION) & matches(line, dims.POPE_NAME, "i") & matches(line, dims.EVENT, "i")
        )
        meta = F.when((inner != "") & matches(inner, dims.POPE_NAME, "i"), inner).when(alone, line)
        return F.struct(meta.alias("meta"), i.alias("at"))

    return F.get(F.filter(F.transform(lines, judged), lambda x: x["meta"].isNotNull()), F.lit(0))


def is_bare_reference(line: Column, lang: str | Column) -> Column:
    """Whether a line is nothing but a book reference or verse numbers."""
    # names are looked for one by one, so that the pattern is the same for all languages and compiled once
    names = of_language(lang, {c: sorted({n.lower() for _, n in dims.books(c)}) for c in dims.BOOKS}, [], "array<string>")
    rest = lambda low, n: F.substring(low, F.length(n) + 1, F.length(low))
    book = lambda low: F.exists(names, lambda n: F.startswith(low, n) & ((low == n) | matches(rest(low, n), rf"^(?=[^\d]*\d){_VERSE}+$")))
    return let(strip(line), lambda text: (text != "") & (matches(text, _BARE) | let(F.lower(text), book)))


def clean_section(section: Column, lang: str | Column) -> Column:
    """A section without verse numbers in its headings, bare references and stray labels."""
    labels = {c: [*(a.lstrip("^") for group in marks.values() for a in group), dims.ORDINAL_LABELS[c]] for c, marks in dims.SECTION_MARKS.items()}
    label = of_language(lang, _patterns({c: f"^(?:{'|'.join(x)})" for c, x in labels.items()}), NEVER)
    headed = F.transform(
        F.split(text_or_empty(section), "\n"), lambda x, i: F.when(i < 2, strip_header_verses(x, lang)).otherwise(x)
    )
    kept = F.filter(headed, lambda x, i: ~((i < 4) & is_bare_reference(x, lang)))

    def stray(line: Column, i: Column) -> Column:
        text = strip(line)
        whole = (text != "") & (F.length(text) < _LONGEST_LABEL) & (F.call_function("regexp_extract", text, label, F.lit(0)) == text)
        return (i > 0) & (i < 5) & whole

    return strip(F.array_join(F.filter(kept, lambda x, i: ~stray(x, i)), "\n"))


def inline_position(text: Column, alternatives: Column) -> Column:
    """Offset of the first alternative (an array of patterns) that occurs anywhere, tried in order; -1 if none does."""
    tried = lambda at, a: F.when(at >= 0, at).when(F.rlike(text, a), position(text, a)).otherwise(at)
    return F.aggregate(alternatives, F.lit(-1), tried)


def without_attribution(text: Column, meta: Column, lang: str | Column) -> Column:
    """A comment's text without the attribution at its end."""

    def before_last(x: Column) -> Column:
        at = F.call_function("locate", F.reverse(x), F.reverse(text))
        return F.when((x != "") & (at > 0), strip(F.left(text, F.length(text) - at - F.length(x) + 1)))

    def cut(spoken: Column) -> Column:
        first_two = F.array_join(F.slice(F.split(strip(meta), rx(r"\s+")), 1, 2), " ")
        pattern = F.concat(F.lit(r"(?isU)^(.*)\b\Q"), first_two, F.lit(r"\E\b"))
        head = F.call_function("regexp_extract", text, pattern, F.lit(1))
        again = F.call_function("rlike", text, pattern)
        ends = F.when((spoken != "") & F.endswith(text, spoken), strip(F.left(text, F.length(text) - F.length(spoken))))
        return F.coalesce(
            ends, before_last(F.left(spoken, F.lit(20))), F.when((first_two != "") & again, strip(head)), text
        )

    return F.when(meta.isNull() | (text == ""), text).otherwise(let(_spoken(text_or_empty(meta), lang, True), cut))


def comment_header(meta: Column, lang: str | Column) -> Column:
    label, title = (of_language(lang, {c: v[i] for c, v in dims.COMMENT_LABELS.items()}, dims.COMMENT_LABELS["it"][i]) for i in range(2))
    name = F.replace(strip(meta), F.lit(" - "), F.lit(", "))
    named = F.when(matches(name, dims.POPE_TITLE, "i"), name).otherwise(F.concat_ws(" ", title, name))
    return F.concat(F.concat_ws(" ", F.lit(COMMENT), label, named), F.lit("."))


def _with_body(header: Column, body: Column, lang: str | Column) -> Column:
    return F.when(body == "", header).otherwise(F.concat(header, F.lit("\n"), strip_inline_verses(body, lang)))


#: How a part of a text becomes a section: as it is, cleaned, or as the body of a comment.
_WHOLE, _READ, _COMMENT = "whole", "read", "comment"


def _part(how: str, text: Column) -> Column:
    return F.struct(F.lit(how).alias("how"), text.alias("text"))


def _finished(parts: Column, meta: Column, lang: str | Column) -> Column:
    """The sections of an array of parts, without those that end up empty."""
    done = lambda p: F.when(p["how"] == _READ, clean_section(p["text"], lang)).when(
        p["how"] == _COMMENT, _with_body(comment_header(meta, lang), p["text"], lang)
    ).otherwise(p["text"])
    return F.filter(F.transform(parts, done), lambda s: s != "")


def _between(text: Column, start: Column, end: Column) -> Column:
    return strip(F.substring(text, start + 1, end - start))


def _listed(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda p: p["text"].isNotNull())


def flat_parts(flat: Column, meta: Column, lang: str | Column) -> Column:
    """Parts of a one-paragraph text, by the positions of their marks; none without a gospel."""
    kinds = ("first", "second", "psalm", "gospel")
    bare = lambda c, k: [rx(a.lstrip("^"), "i") for a in dims.SECTION_MARKS[c][k]]
    marks = {k: of_language(lang, {c: bare(c, k) for c in dims.SECTION_MARKS}, [], "array<string>") for k in kinds}
    places = F.struct(*[inline_position(flat, marks[k]).alias(k) for k in kinds])

    def gospel_and_comment(raw: Column) -> list[Column]:
        """(end of the gospel, body of the comment) if there is a comment."""
        closing, opening = (of_language(lang, _patterns(x), NEVER) for x in (dims.CLOSING, dims.OPENING))
        after = position(raw, closing) + F.length(F.call_function("regexp_extract", raw, closing, F.lit(0)))
        begins = position(raw, opening)
        rest = sub(F.substring(raw, after + 1, F.length(raw)), r"^[\s.,;:]+", "")
        closed, opened = F.rlike(raw, closing), F.rlike(raw, opening)
        begun = strip(F.substring(raw, begins + 1, F.length(raw)))
        bare = without_attribution(F.when(closed, rest).when(opened, begun).otherwise(raw), meta, lang)
        end = F.when(closed, after).when(opened, begins).otherwise(F.length(bare))
        body = F.when(closed | opened, bare)
        return [end, F.coalesce(body, F.lit(""))]

    def made(p: Column) -> Column:
        first = F.when(p["first"] < 0, 0).otherwise(p["first"])
        inside = lambda x, low: (p[x] != -1) & (low < p[x]) & (p[x] < p["gospel"])
        second = inside("second", first)
        first_end = F.when(second, p["second"]).when(inside("psalm", first), p["psalm"]).otherwise(p["gospel"])
        second_end = F.when(inside("psalm", p["second"]), p["psalm"]).otherwise(p["gospel"])

        def with_gospel(raw: Column) -> Column:
            end, body = gospel_and_comment(raw)
            gospel = F.when(meta.isNull(), strip(raw)).otherwise(strip(F.left(raw, end)))
            return _listed(
                _part(_READ, _between(flat, first, first_end)),
                _part(_READ, F.when(second, _between(flat, p["second"], second_end))),
                _part(_READ, gospel),
                _part(_COMMENT, F.when(meta.isNotNull(), body)),
            )

        parts = let(F.substring(flat, p["gospel"] + 1, F.length(flat)), with_gospel)
        return F.when(p["gospel"] < 0, F.array(_part(_WHOLE, flat))).otherwise(parts)

    return let(places, made)


def sections_of(plain: Column, lang: str | Column = "it", faithful: bool = False) -> Column:
    """The sections (array of text) of a description without markup.

    faithful=True keeps a known fault: if the attribution is a line of its own
    at the end and falls away in normalization, the line before it is lost.
    """
    marks = {
        k: of_language(lang, _patterns({c: "|".join(v[k]) for c, v in dims.SECTION_MARKS.items()}), NEVER) for k in ("first", "second", "psalm", "gospel")
    }

    def found(source: Column) -> Column:
        last = F.coalesce(F.get(source, F.size(source) - 1), F.lit(""))

        def attributed(end: Column) -> Column:
            alone = F.when(end["meta"].isNull(), attribution_line(source))
            body = F.when(end["meta"].isNotNull(), end["body"]).otherwise("")

            def judged(spoken: Column) -> Column:
                return let(
                    F.struct(
                        F.coalesce(end["meta"], alone["meta"]).alias("meta"),
                        (end["meta"].isNull() & alone.isNotNull()).alias("alone"),
                        spoken[1].alias("body"),
                        (F.lit(faithful) | (spoken[0] != "")).alias("shown"),
                    ),
                    by_lines,
                )

            return let(F.transform(F.array(last, body), lambda x: _spoken(x, lang, True)), judged)

        return let(attribution_at_end(last), attributed)

    def by_lines(a: Column) -> Column:
        return let(text_lines(_spoken(plain, lang, False)), lambda lines: with_lines(a, lines))

    def with_lines(a: Column, lines: Column) -> Column:
        at = F.struct(*[line_index(lines, p).alias(k) for k, p in marks.items()])
        flat = F.array_join(lines, " ")

        def made(p: Column) -> Column:
            first = F.when(p["first"] < 0, 0).otherwise(p["first"])
            second, n = p["second"] > first, F.size(lines)
            first_end = F.when(second, p["second"]).when(p["psalm"] > first, p["psalm"]).otherwise(p["gospel"])
            second_end = F.when(p["psalm"] > p["second"], p["psalm"]).otherwise(p["gospel"])
            names = F.transform(lines, lambda x, i: (i > p["gospel"]) & matches(x, dims.POPE_NAME, "i"))
            apart = F.when(a["alone"], F.array_position(names, True).cast("int") - 1).otherwise(-1)
            end = (
                F.when(a["meta"].isNull(), n).when(apart >= 0, apart).when(a["shown"], n - 1).otherwise(n)
            )
            joined = lambda x, y: strip(F.array_join(F.slice(lines, x + 1, F.greatest(F.lit(0), y - x)), "\n"))
            gospel = joined(p["gospel"], end)
            start = position(gospel, of_language(lang, _patterns({"it": r"dal\s+vangelo"}), NEVER))
            gospel = F.when(start >= 0, F.substring(gospel, start + 1, F.length(gospel))).otherwise(gospel)
            after = strip(F.array_join(F.slice(lines, apart + 2, n), " "))
            body = F.when(apart >= 0, after).otherwise(a["body"])
            parts = _listed(
                _part(_READ, joined(first, first_end)),
                _part(_READ, F.when(second, joined(p["second"], second_end))),
                _part(_READ, gospel),
                _part(_COMMENT, F.when(a["meta"].isNotNull(), body)),
            )
            lined = (p["gospel"] >= 0) & ((p["first"] < 0) | (p["first"] < p["gospel"]))
            found = F.when(F.size(lines) == 0, F.array(_part(_WHOLE, F.lit("")))).when(lined, parts).otherwise(
                let(flat, lambda x: flat_parts(x, a["meta"], lang))
            )
            # a text that no section is left of stays whole
            whole = F.array(F.when(lined, F.array_join(lines, "\n")).otherwise(flat))
            return let(_finished(found, a["meta"], lang), lambda x: F.when(F.size(x) == 0, whole).otherwise(x))

        return let(at, made)

    return let(text_lines(plain), found)


def segment(df: DataFrame, text: str = "description", lang: str = "lang", faithful: bool = False) -> DataFrame:
    """df with ``segments``: array of (ord, kind, text). Rows without a known language keep the text as one section.

    kind is ``comment`` or ``section``; a comment's marker is cut off.
    """
    staged = df.withColumn("_plain", html_to_text(F.col(text)))
    whole = F.array(normalize_punctuation(F.col("_plain"), False))
    texts = F.when(known_language(F.col(lang)), sections_of(F.col("_plain"), F.col(lang), faithful)).otherwise(whole)
    shaped = F.transform(
        texts,
        lambda s, i: F.struct(
            i.alias("ord"),
            F.when(s.startswith(COMMENT), "comment").otherwise("section").alias("kind"),
            F.when(s.startswith(COMMENT), strip(F.substring(s, len(COMMENT) + 1, F.length(s)))).otherwise(s).alias("text"),
        ),
    )
    return staged.withColumn("segments", shaped).drop("_plain")


def split_readings(plain: Column, lang: str | Column) -> Column:
    """(first, second) reading of a day page's reading section, without the psalm; second is empty if there is one."""
    mark = lambda i, flags="i", around="{}": of_language(lang, _patterns({c: around.format(v[i]) for c, v in dims.DAY_MARKS.items()}, flags), NEVER)
    n = F.length(plain)
    pair = lambda a, b: F.struct(strip(a).alias("first"), strip(b).alias("second"))
    part = lambda a, b: F.substring(plain, a + 1, b - a)

    def headed(again: Column) -> Column:
        """Where a first reading begins for the second time."""
        begun = F.filter(again, lambda x: F.rlike(x, mark(2, "im", "^(?:{})")))
        return let(F.size(begun), lambda k: F.when(k >= 2, F.length(F.array_join(F.slice(again, 1, F.size(again) - k + 1), ""))))

    def parted(at: Column) -> Column:
        p, s = at["psalm"], at["second"]
        psalm_at = F.when(p < 0, n).otherwise(p)
        again = let(F.split(plain, mark(2, "im", "(?=(?:{}))")), headed)
        whole = pair(plain, F.lit(""))
        return (
            F.when((s >= 0) & (s > psalm_at), pair(part(F.lit(0), psalm_at), part(s, n)))
            .when(s >= 0, pair(part(F.lit(0), s), part(s, psalm_at)))
            .when(p >= 0, pair(part(F.lit(0), p), F.lit("")))
            .otherwise(let(again, lambda head: F.when(head.isNotNull(), pair(part(F.lit(0), head), part(head, n))).otherwise(whole)))
        )

    # each place is used several times, and looked for once
    return let(F.struct(position(plain, mark(0)).alias("psalm"), position(plain, mark(1)).alias("second")), parted)


def cut_at(text: Column, pattern: str) -> Column:
    """(before, from): the text parted where the pattern first occurs; all of it before if it does not."""
    at = position(text, F.lit(rx(pattern, "i")))
    whole = F.length(text)
    return F.struct(
        strip(F.when(at < 0, text).otherwise(F.substring(text, 1, at))).alias("before"),
        strip(F.when(at < 0, "").otherwise(F.substring(text, at + 1, whole))).alias("from"),
    )


def comment_section(plain: Column, lang: str | Column) -> Column:
    """The comment of a day page: its body is what stands before the attribution. Null without an attribution."""

    def made(lines: Column) -> Column:
        end = attribution_at_end(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")))

        def joined(e: Column) -> Column:
            alone = attribution_line(lines)
            before = F.array_join(F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1)), "\n")
            body = F.when(e["meta"].isNotNull(), strip(F.concat(before, F.lit("\n"), e["body"]))).otherwise(
                F.array_join(F.slice(lines, 1, F.coalesce(alone["at"], F.lit(0))), "\n")
            )
            meta = F.coalesce(e["meta"], alone["meta"])
            return F.when(meta.isNotNull(), _with_body(comment_header(meta, lang), _spoken(body, lang, True), lang))

        return let(end, joined)

    return let(text_lines(plain), made)

