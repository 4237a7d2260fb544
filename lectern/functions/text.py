"""The text kernel: functions from column to column. Null counts as empty text."""

from __future__ import annotations

import html
from collections.abc import Collection

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import dims
from lectern.functions.rx import NEVER, holds, let, literal, matches, of_language, rewrite, rewrite_held, rx, strip, sub, text_or_empty

QUOTE_START, QUOTE_END, PAUSE, COMMENT = "__QSTART__", "__QEND__", "__PAUSE__", "__POPE__"

# Runs of white space are matched from their beginning and as a whole, so that none is looked at again from each of its
# characters. A run before a mark may have gone with the mark before it. A pattern is tried at each character of a text, so
# what most characters fail comes first, and what looks back comes after it.
_LINE_END = r"\s(?<!\s\s)(?:(?<=\n)|[^\S\n]*+\n)\s*+"
_ONE_BLANK = (("\t", r"\t", " "), ("  ", " {2,}+", " "))
_COMMAS = (r",\s*+(?:,\s*+)++", ", ")
_BLANKS = r"(?:(?<![ \t])[ \t]++)?"

# fixed values: rewriting rules, in order -----------------------------------
_TAGS = (
    (r"<(br|/p|/div|/li|/h[1-6])\s*/?>", "\n", "i"),
    (r"<li\b[^>]*>", "- ", "i"),
    (r"<[^>]+>", " "),
)
# those with a mark before them are applied to texts that hold it
_JOINED = (("-", r"(\w)-\s+(\w)", "$1$2"), ("\n", _LINE_END, "\n"), *_ONE_BLANK)
_MARKS = (
    (r"\s(?<!\s\s)\s*+([,;:.!?])", "$1"),
    (r"([,;:.!?])(?!\s|$)", "$1 "),
    _COMMAS,
)
# after the first two, two of a mark in a row have one blank between them
_TWICE = (
    (", ,", *_COMMAS),
    ("; ;", r";\s*;{1,}", "; "),
    (": :", r":\s*:{1,}", ": "),
    ("! !", r"!\s*!{1,}", "! "),
    ("? ?", r"\?\s*\?{1,}", "? "),
)
_FLAT = {True: ("\n", _LINE_END, " "), False: ("\n", _LINE_END, "\n")}
_QUOTES = (
    ("«", rf"{_BLANKS}«[ \t]*", f" {QUOTE_START} "),
    ("»", rf"{_BLANKS}»[ \t]*", f" {QUOTE_END} "),
    ("“", "“", f" {QUOTE_START} "),
    ("”", "”", f" {QUOTE_END} "),
    ('"', r'^"(?=\S)', f"{QUOTE_START} ", "m"),
    ('"', r'(?<=[\s,\-])"(?=\S)', f" {QUOTE_START} "),
    ('"', r'"(?=\s*(?:[,;:.!?]|\s|$))', f" {QUOTE_END} ", "m"),
)
_PAUSES = (
    (":", r":(?!\s*$)", ",", "m"),
    ("(", r"\([^()]{0,120}\d[^()]{0,60}\)", " "),
    ("(", r"\(", ""),
    (")", r"\)", ""),
    ("-", r"(?<![ \t])[ \t]++-[ \t]+", ", "),
    (",", *_COMMAS),
)
_ENDS = ((";", rf"{_BLANKS};[ \t]*", ", "), ("  ", r"[ \t]{2,}", " "), ("\t", r"[ \t]{2,}", " "))
_PLAIN = ((_LINE_END, ". "), (r"\.\s*\.+", "."), (r",\s*\.\s*", ". "), (r"[ \t]{2,}", " "))
_FEED_TEXT = ((r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), (r"[\x{1F300}-\x{1FAFF}]", ""), (r"\s+", " "))
_XML_ILLEGAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# end of fixed values --------------------------------------------------------


@F.pandas_udf(StringType())
def _unescape_once(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def _decoded(value: str) -> str:
    for _ in range(3):
        newer = html.unescape(value)
        if newer == value:
            break
        value = newer
    return value.replace("\xa0", " ")


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(_decoded, na_action="ignore")


def decode_entities(value: Column) -> Column:
    """Character references resolved, up to three rounds, and hard spaces made plain."""
    return _unescape(text_or_empty(value))


def _without_entities(value: Column) -> Column:
    return F.translate(text_or_empty(value), "\xa0", " ")


def _tagless(value: Column, rules: tuple) -> Column:
    """The rules for tags applied up to the last >. Nothing after it is a tag, and each < there would look for an end."""

    def cut(text: Column) -> Column:
        rest = F.substring_index(text, ">", -1)
        return F.concat(rewrite(F.left(text, F.length(text) - F.length(rest)), rules), rest)

    return let(text_or_empty(value), lambda v: F.when(holds(">")(v), cut(v)).otherwise(v))


def html_to_text(value: Column, entities: bool = True) -> Column:
    """HTML to lines of text. entities=False leaves references as they are and stays free of Python."""
    tagless = _tagless(value, _TAGS)
    decoded = decode_entities(tagless) if entities else _without_entities(tagless)
    return strip(rewrite_held(decoded, _JOINED))


def normalize_punctuation(value: Column, flatten: bool = True) -> Column:
    return strip(rewrite_held(rewrite(text_or_empty(value), _MARKS[:2]), (*_TWICE, _FLAT[flatten], *_ONE_BLANK)))


def detect_language(lang: Column | None, url: Column | None) -> Column:
    """The given language if it is known, else the first known one in the URL's path, else null."""
    low = F.lower(text_or_empty(url)) if url is not None else F.lit("")
    found = F.coalesce(*[F.when(F.contains(low, F.lit(f"/{c}/")), c) for c in dims.LANGUAGES])
    if lang is None:
        return found
    asked = F.lower(strip(text_or_empty(lang)))
    return F.when(asked.isin(*dims.LANGUAGES), asked).otherwise(found)


_RULES = "array<struct<key:string,name:string>>"


def _table(rules: list[tuple[str, str]]) -> list[dict[str, str]]:
    """Rules (pattern, replacement) as _RULES has them."""
    return [{"key": a, "name": b} for a, b in rules]


def _folded(value: Column, rules: Column) -> Column:
    """The rules of an array applied one after the other: a chain of calls would be as deep as the array is long."""
    return F.aggregate(rules, value, lambda text, r: F.regexp_replace(text, r["key"], r["name"]))


def _word(words: Collection[str]) -> str:
    """The pattern of one of some words (patterns that begin with a letter or digit, case ignored), alone and with the dot
    after it, looked for by their first characters."""
    first = "".join(sorted({w[0] for w in words}))
    return rx(rf"(?=[{first}])(?<!\w)(?:{'|'.join(words)})\.?(?!\w)", "i")


def expand_cross_references(value: Column, lang: str | Column) -> Column:
    rules = {c: _table([(_word([a]), b) for a, b in pairs]) for c, pairs in dims.CROSS_REFERENCES.items()}
    # few texts hold any in any language
    some = holds(*sorted({a for pairs in dims.CROSS_REFERENCES.values() for a, _ in pairs}))
    named = lambda v: _folded(v, of_language(lang, rules, [], _RULES))
    return let(text_or_empty(value), lambda v: F.when(let(F.lower(v), some), named(v)).otherwise(v))


def _book_keys(lang: str) -> dict[str, str]:
    """Abbreviation to its pattern."""
    return {short: rf"{short[0]}\s*{short[1:]}" if short[0].isdigit() else short for short, _ in dims.books(lang)}


def expand_books(value: Column, lang: str | Column) -> Column:
    """Book abbreviations to names: the longest first, case ignored, a dot after them taken along."""
    rules, some = {}, {}
    for c in dims.BOOKS:
        keys = _book_keys(c)
        rules[c] = _table([(_word([keys[k]]), name) for k, name in dims.books(c)])
        some[c] = _word(keys.values())
    # few texts hold any, and value is worked out once
    named = lambda v: _folded(v, of_language(lang, rules, [], _RULES))
    return let(text_or_empty(value), lambda v: F.when(F.rlike(v, of_language(lang, some, NEVER)), named(v)).otherwise(v))


def normalize_verses(value: Column, lang: str | Column) -> Column:
    """Chapter and verse numbers as they are spoken."""
    spoken = F.concat(F.lit("$1 $2 "), of_language(lang, dims.RANGE_WORD, "to"), F.lit(" $3"))
    # fixed values; a number is read from its beginning and as a whole
    number = r"(\d(?<!\d\d)\d*+)"
    rules = (
        (rf"{number},\s*(\d+)[a-z]\s*-\s*(\d+)", spoken),
        (rf"{number}\s+(\d+)[a-z]\s*-\s*(\d+)", spoken),
        (rf"{number},\s*(\d+)\s*-\s*(\d+)", spoken),
        (rf"{number},\s*(\d+)", "$1 $2"),
        (r"(?=\d)\b(\d++)[a-z]\b", "$1"),
    )
    dashed = F.replace(text_or_empty(value), F.lit("–"), F.lit("-"))
    return let(dashed, lambda v: F.when(matches(v, r"\d"), rewrite(v, rules)).otherwise(v))


def balance_quotes(value: Column) -> Column:
    """Quote markers alternate: an open quote is closed before the next opens and at the end; stray ends go."""

    def balanced(pieces: Column) -> Column:
        # each piece but the first begins with a marker, and is inside a quote if the piece before it began one
        opened = lambda i: F.coalesce(F.get(pieces, i).startswith(QUOTE_START), F.lit(False))
        shown = F.transform(
            pieces,
            lambda p, i: F.when(p.startswith(QUOTE_START) & opened(i - 1), F.concat(F.lit(QUOTE_END), p))
            .when(p.startswith(QUOTE_END) & ~opened(i - 1), F.substring(p, len(QUOTE_END) + 1, F.length(p)))
            .otherwise(p),
        )
        return F.concat(F.array_join(shown, ""), F.when(opened(F.size(pieces) - 1), QUOTE_END).otherwise(""))

    return let(F.split(text_or_empty(value), "(?=__Q(?:START|END)__)"), balanced)


#: Italian marks responses, and three languages write an accent as an apostrophe (fixed values).
_RESPONSES = {"it": r"\bR\.[ \t]*"}
_ACCENTS = ("it", "fr", "pt")


def smooth(value: Column, lang: str | Column = "it", flatten: bool = True) -> Column:
    """Punctuation that makes a voice stumble is removed, quotes become markers."""
    value = F.regexp_replace(text_or_empty(value), of_language(lang, {c: rx(x) for c, x in _RESPONSES.items()}, NEVER), F.lit(""))
    ends = r"'(?=[\s,;:.!?\"\[\]]|$)"
    accents = _table([(rx(f"{v}{ends}", "m"), w) for v, w in zip("aeiouAEIOU", "àèìòùÀÈÌÒÙ", strict=True)])
    written = lambda v: _folded(v, of_language(lang, dict.fromkeys(_ACCENTS, accents), [], _RULES))
    value = let(value, lambda v: F.when(holds("'")(v) & matches(v, "[aeiouAEIOU]'"), written(v)).otherwise(v))
    value = rewrite_held(value, (*_QUOTES, *_PAUSES, _FLAT[flatten], *_ENDS))
    return strip(balance_quotes(value))


def normalize(
    value: Column, lang: str | Column | None, flatten: bool = True, entities: bool = True
) -> Column:
    """Everything that turns markup into text to be spoken; without a language only the general steps."""
    value = normalize_punctuation(html_to_text(value, entities), flatten)
    return value if lang is None else localized(value, lang, flatten)


def localized(value: Column, lang: str | Column, flatten: bool = True) -> Column:
    """The steps of normalize that depend on the language, for text that has been through the others; null for rows whose
    language, in a column, is none that is known."""
    if isinstance(lang, Column):
        return F.when(known_language(lang), _localized(value, lang, flatten))
    return _localized(value, lang, flatten)


def known_language(lang: Column) -> Column:
    return F.coalesce(lang.isin(*dims.LANGUAGES), F.lit(False))


def _localized(value: Column, lang: str | Column, flatten: bool) -> Column:
    for step in (expand_cross_references, expand_books, normalize_verses):
        value = step(value, lang)
    return smooth(value, lang, flatten)


def strip_header_verses(line: Column, lang: str | Column) -> Column:
    """Chapter and verse numbers cut from the end of a heading."""
    numbers = r"\s++\d++(?:\s++\d++)*+"  # possessive, so that no number of numbers is too deep
    ends = lambda word: rx(rf"(?<!\s){numbers}(?:\s++{word}{numbers})?+\s*$", "i")
    pattern = of_language(lang, {c: ends(w) for c, w in dims.RANGE_WORD.items()}, ends("to"))
    cut = F.regexp_replace(line, pattern, F.lit(""))
    return strip(F.when(matches(line, r"\d\s*$"), cut).otherwise(line))


def strip_inline_verses(value: Column, lang: str | Column) -> Column:
    """Book name with chapter and verse taken out of running text."""

    def pattern(c: str) -> str:
        names = sorted({name for _, name in dims.books(c)}, key=lambda n: (-len(n), n))
        return rx(rf"\b(?:{'|'.join(map(literal, names))})\s+\d+\s+\d+(?:\s+{dims.RANGE_WORD[c]}\s+\d+)?\b", "i")

    cut = F.regexp_replace(value, of_language(lang, {c: pattern(c) for c in dims.BOOKS}, NEVER), F.lit(" "))
    return strip(sub(cut, r"[ \t]{2,}", " "))


def plain_speech(value: Column, lang: str | Column, entities: bool = True) -> Column:
    """Text for voices that know no markers."""
    spoken = normalize(value, lang, flatten=False, entities=entities)
    said = lambda x: F.when(x.startswith(COMMENT), strip(F.substring(x, len(COMMENT) + 1, F.length(x)))).otherwise(x)
    spoken = F.replace(let(spoken, said), F.lit(PAUSE), F.lit("."))
    for marker in (QUOTE_START, QUOTE_END):
        spoken = F.replace(spoken, F.lit(marker))
    return strip(rewrite(spoken, _PLAIN))


def sanitize(value: Column) -> Column:
    """Text fit for a feed: no control characters, no emoji, single spaces."""
    return strip(rewrite(text_or_empty(value), _FEED_TEXT))


def xml_legal(value: Column) -> Column:
    return sub(text_or_empty(value), _XML_ILLEGAL, " ")


def title_key(value: Column) -> Column:
    """What two titles are compared by."""
    return strip(F.lower(text_or_empty(value)))


def slug(value: Column, most: int = 80, empty: str = "audio") -> Column:
    """ASCII letters, digits and hyphens only; other letters vanish."""
    made = F.left(sub(sub(strip(text_or_empty(value)), r"\s+", "-"), r"[^a-zA-Z0-9\-]", ""), F.lit(most))
    return F.when(made == "", empty).otherwise(made)


def name_slug(value: Column) -> Column:
    """A person's name as it appears in an address."""
    made = F.translate(F.lower(text_or_empty(value)), *dims.TRANSLIT_ONE)
    for letter, two in dims.TRANSLIT_TWO:
        made = F.replace(made, F.lit(letter), F.lit(two))
    for mark in ".,":
        made = F.replace(made, F.lit(mark), F.lit("--"))
    made = F.translate(made, " ", "-")
    return F.btrim(sub(sub(made, r"[^a-z0-9\-]", ""), r"-{3,}", "--"), F.lit("-"))


def month_name(day: Column, lang: Column) -> Column:
    listed = {c: F.array(*map(F.lit, m)) for c, m in dims.MONTHS.items()}
    names = F.create_map(*[x for c, m in listed.items() for x in (F.lit(c), m)])
    return F.element_at(F.coalesce(F.element_at(names, lang), listed["en"]), F.month(day))


def spoken_date(day: Column, lang: Column) -> Column:
    name, number, year = month_name(day, lang), F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    return (
        F.when(lang == "en", F.concat(name, F.lit(" "), number, F.lit(", "), year))
        .when(lang == "de", F.concat(number, F.lit(". "), name, F.lit(" "), year))
        .when(lang.isin("es", "pt"), F.concat_ws(" de ", number, name, year))
        .otherwise(F.concat_ws(" ", number, name, year))
    )


def rfc822(moment: Column) -> Column:
    return F.date_format(moment, "EEE, dd MMM yyyy HH:mm:ss '+0000'")


def parse_rfc822(value: Column) -> Column:
    """The moment, null where it can't be read; the day's name is not looked at."""
    plain = F.regexp_replace(F.substring(value, 6, 100), "GMT$", "+0000")
    return F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss Z"))


def file_name(value: Column) -> Column:
    """Percent-encoded, slashes kept."""
    return F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def stored_path(url: Column) -> Column:
    """The path of a URL from its second part onward; null if it has none."""
    path = F.regexp_extract(text_or_empty(F.try_parse_url(url, F.lit("PATH"))), r"^/+[^/]+/(.*)$", 1)
    return F.when(path != "", path)


def title_case(value: Column) -> Column:
    """Texts in capitals only: every run of letters gets one capital; others stay."""
    runs = F.regexp_extract_all(value, F.lit(r"(?U)[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))
    cased = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))), "")
    capitals = (F.upper(value) == value) & (F.lower(value) != value)
    return F.when(capitals, cased).otherwise(value)


def speed_percent(rate: Column) -> Column:
    """A speaking rate as a signed percentage, halves to even."""
    return F.format_string("%+d%%", F.bround((rate - 1) * 100, 0).cast("int"))


def strip_markup(value: Column) -> Column:
    """Markup to plain text, references resolved once."""
    plain = _unescape_once(_tagless(value, ((r"<[^>]+>", " "),)))
    plain = F.replace(plain, F.lit(PAUSE), F.lit(", "))
    for marker in (QUOTE_START, QUOTE_END):
        plain = F.replace(plain, F.lit(marker))
    return strip(sub(plain, r"\s+", " "))


def duration_seconds(log: Column) -> Column:
    """Seconds of the first ``Duration: h:m:s`` in a log, fractions cut off; 0 if there is none."""
    part = lambda i: F.regexp_extract(text_or_empty(log), r"Duration:\s*(\d+):(\d+):(\d+)", i)
    return F.when(part(1) == "", 0).otherwise(
        part(1).try_cast("int") * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("int")
    )


def forced(flag: Column) -> Column:
    return F.lower(text_or_empty(flag)).isin("1", "true", "yes")


def is_navigation(heading: Column) -> Column:
    """Whether a heading holds one of the words of navigation parts, as a substring."""
    # in small letters once, and not once a word; none begins or ends with white space
    words = F.array(*map(F.lit, dims.NAVIGATION))
    return let(F.lower(text_or_empty(heading)), lambda low: F.exists(words, lambda k: F.contains(low, k)))


def is_saint_link(href: Column, lang: str | Column) -> Column:
    patterns = {c: rx(rf"/{c}/{literal(known[0])}/\d{{2}}/\d{{2}}/.+\.html") for c, known in dims.SAINT_PAGES.items()}
    return F.coalesce(F.rlike(href, of_language(lang, patterns, NEVER)), F.lit(False))
