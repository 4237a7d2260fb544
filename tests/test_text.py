import datetime

import pytest
from pyspark.sql import functions as F

from lectern.functions import dims
from lectern.functions import text as T

Q = f"{T.QUOTE_START} ciao {T.QUOTE_END}"
IT = {
    "cross": lambda c: T.expand_cross_references(c, "it"),
    "books": lambda c: T.expand_books(c, "it"),
    "verses": lambda c: T.normalize_verses(c, "it"),
    "smooth": lambda c: T.smooth(c, "it"),
    "header": lambda c: T.strip_header_verses(c, "it"),
    "inline": lambda c: T.strip_inline_verses(c, "it"),
}
CASES = [
    (T.decode_entities, "&amp;amp;amp;lt;", "&lt;"), (T.decode_entities, "&eacute;&nbsp;x", "é x"), (T.decode_entities, None, ""),
    (T.html_to_text, "<p>a</p><p>b</p>", "a\nb"), (T.html_to_text, "foo-<br>bar", "foobar"), (T.html_to_text, "x<li>y", "xy"),
    (T.html_to_text, 'a<br class="c">b', "a b"), (T.html_to_text, '<script>v="</p>";</script>', 'v="\n";'),
    (T.normalize_punctuation, "a ,b", "a, b"), (T.normalize_punctuation, "3.5", "3. 5"), (T.normalize_punctuation, "Wait...", "Wait. . ."),
    (T.normalize_punctuation, "no!!!", "no! !"), (T.normalize_punctuation, "a,,b", "a, b"),
    (lambda c: T.normalize_punctuation(c, False), "a\n;b", "a; b"),
    (IT["cross"], "Cfr. Lc", "confronta Lc"), (lambda c: T.expand_cross_references(c, "en"), "cf. Mk", "see Mk"),
    (IT["books"], "Mt. 5", "Matteo 5"), (IT["books"], "1 Cor 13", "Prima lettera ai Corinzi 13"), (IT["books"], "amt", "amt"),
    (IT["books"], "col tempo", "Lettera ai Colossesi tempo"), (lambda c: T.expand_books(c, "de"), "Röm 5 RÖM. 6", "Römer 5 Römer 6"),
    (IT["verses"], "5,1-13", "5 1 a 13"), (IT["verses"], "9,4b-10", "9 4 a 10"), (IT["verses"], "5, 1", "5 1"),
    (IT["verses"], "5,1–13", "5 1 a 13"), (lambda c: T.normalize_verses(c, "de"), "5,1-13", "5 1 bis 13"), (IT["verses"], "1,000", "1 000"), (IT["verses"], "4b", "4"),
    (IT["smooth"], "Gesu' disse", "Gesù disse"), (IT["smooth"], "R. Amen", "Amen"), (IT["smooth"], "«ciao»", Q),
    (IT["smooth"], "disse: vieni", "disse, vieni"), (IT["smooth"], "a; b", "a, b"), (IT["smooth"], "x - y", "x, y"), (IT["smooth"], "a (Mt 5) b (c)", "a b c"),
    (T.balance_quotes, "__QSTART__a__QSTART__b__QEND__c__QEND__", "__QSTART__a__QEND____QSTART__b__QEND__c"),
    (IT["header"], "Genesi 1 1 a 13", "Genesi"), (IT["header"], "x 27 30 a 28 7", "x"), (IT["header"], "x 26", "x"),
    (IT["inline"], "a Matteo 5 17 b", "a b"), (IT["inline"], "Matteo 5 b", "Matteo 5 b"),
    (T.sanitize, "a\x01b", "a b"), (T.sanitize, "Hi 😀 x", "Hi x"), (T.xml_legal, "a\x7fb", "a b"),
    (T.slug, "San José 1", "San-Jos-1"), (T.slug, "", "audio"), (T.name_slug, "St. John Ogilvie, Jesuit", "st--john-ogilvie--jesuit"),
    (T.name_slug, "Ä Æ ß", "ae-ae-ss"), (T.title_case, "D'ARIMATEA-X", "D'Arimatea-X"), (T.title_case, "Ab CD", "Ab CD"), (T.title_key, " A b ", "a b"),
    (T.strip_markup, "<a>x</a> &amp;amp; __PAUSE__y", "x &amp; , y"), (T.stored_path, "https://h.example/bucket/a/b.mp3", "a/b.mp3"), (T.stored_path, "https://h.example/x", None),
    (T.file_name, "a b/ü.mp3", "a%20b/%C3%BC.mp3"), (lambda c: T.plain_speech(c, "it"), "__POPE__ Uno\ndue «x»", "Uno. due x"),
    (lambda c: T.normalize(c, "it"), "Cfr. Mt 5,1-3 - <b>pace</b>", "confronta Matteo 5 1 a 3, pace"),
]


def test_literal_cases(spark):
    rows = [(i, v) for i, (_, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, v string").coalesce(1)
    got = {}
    for start in range(0, len(CASES), 10):
        part = range(start, min(start + 10, len(CASES)))
        some = df.where(F.col("i").between(start, start + 9))
        found = some.select("i", *[CASES[i][0](F.col("v")).alias(f"c{i}") for i in part]).collect()
        got |= {r["i"]: r[f"c{r['i']}"] for r in found}
    wrong = [(CASES[i][1], CASES[i][2], got[i]) for i in got if got[i] != CASES[i][2]]
    assert not wrong


@pytest.mark.parametrize("lang,spoken", [("en", "March 9, 2026"), ("de", "9. März 2026"), ("es", "9 de marzo de 2026"), ("pt", "9 de março de 2026"), ("it", "9 marzo 2026"), ("fr", "9 mars 2026")])
def test_dates(spark, lang, spoken):
    df = spark.createDataFrame([(datetime.date(2026, 3, 9), lang)], "d date, l string")
    r = df.select(T.spoken_date(F.col("d"), F.col("l")).alias("s"), T.rfc822(F.col("d")).alias("r")).first()
    assert (r.s, r.r) == (spoken, "Mon, 09 Mar 2026 00:00:00 +0000")


def test_numbers_flags_and_tables(spark):
    df = spark.createDataFrame([(0.85, "TRUE", "ST. OLIVER PLUNKETT", "/it/santo-del-giorno/03/09/x.html", "Duration: 01:02:03.5")], "x double, f string, h string, u string, l string")
    r = df.select(
        T.speed_percent(F.col("x")), T.forced(F.col("f")), T.is_navigation(F.col("h")), T.is_saint_link(F.col("u"), "it"), T.is_saint_link(F.col("u"), "de"),
        T.duration_seconds(F.col("l")),
    ).first()
    assert tuple(r) == ("-15%", True, True, True, False, 3723)
    assert {c: len(dims.books(c)) for c in dims.LANGUAGES} == {"it": 46, "en": 22, "es": 11, "fr": 10, "pt": 11, "de": 10}
    assert len(dims.NAVIGATION) == 29 and all(len(m) == 12 for m in dims.MONTHS.values())
    # the chain of replacements is safe only if no name holds another abbreviation of its language as a word
    for c in dims.LANGUAGES:
        short = {a for a, _ in dims.books(c)}
        held = {(n, w) for _, n in dims.books(c) for w in n.lower().split() if w in short}
        assert held <= {("Acts", "acts")}


def test_languages(spark):
    rows = [(" IT ", None, "it"), ("xx", "http://h/PT/feed", "pt"), (None, "http://h/feed", None)]
    df = spark.createDataFrame(rows, "l string, u string, w string")
    assert all(r.g == r.w for r in df.select("w", T.detect_language(F.col("l"), F.col("u")).alias("g")).collect())


def test_long_runs_end(spark):
    from lectern.functions import text as T

    rows = [(0, "a" + ", " * 100_000 + "b"), (1, "Genesi" + " 1" * 20_000), (2, "x" + " 1" * 3_000 + " y"), (3, "a" + "," * 100_000)]
    df = spark.createDataFrame(rows, "i int, t string").select(
        "i", T.normalize_punctuation(F.col("t")).alias("p"), T.strip_header_verses(F.col("t"), "it").alias("h"), T.smooth(F.col("t"), "it").alias("s")
    )
    got = {r.i: r for r in df.collect()}
    assert got[0].p == "a, b" and got[3].p == "a," and got[1].h == "Genesi" and got[2].h == rows[2][1] and got[0].s == "a, b"


def test_possessive_patterns_read_as_before(spark):
    import itertools
    import re

    from lectern.functions import text as T
    from lectern.functions.rx import sub

    made = ["".join(x) for n in range(6) for x in itertools.product("a, ", repeat=n)]
    headers = [" ".join(x) for n in range(5) for x in itertools.product(("x", "12", "a", "7 "), repeat=n)]
    df = spark.createDataFrame([(x,) for x in made], "t string").select("t", sub(F.col("t"), T._MARKS[2][0], ", ").alias("c"))
    assert all(r.c == re.sub(r"(?:,\s*){2,}", ", ", r.t) for r in df.collect())
    df = spark.createDataFrame([(x,) for x in headers], "t string").select("t", T.strip_header_verses(F.col("t"), "it").alias("h"))
    old = re.compile(r"\s+\d+(?:\s+\d+)*(?:\s+a\s+\d+(?:\s+\d+)*)?\s*$", re.I)
    assert all(r.h == old.sub("", r.t).strip() for r in df.collect())


def test_quotes_balance_as_a_walk_over_them(spark):
    import itertools

    from lectern.functions import text as T

    def walk(text):
        out, inside = "", False
        for p in __import__("re").split("(__QSTART__|__QEND__)", text):
            if p == "__QSTART__":
                out, inside = out + ("__QEND__" if inside else "") + p, True
            elif p == "__QEND__":
                out, inside = out + (p if inside else ""), False
            else:
                out += p
        return out + ("__QEND__" if inside else "")

    texts = ["".join(x) for n in range(6) for x in itertools.product(("__QSTART__", "__QEND__", "a"), repeat=n)] + ["a__QSTART__" * 20_000]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.balance_quotes(F.col("t")).alias("b"))
    assert all(r.b == walk(r.t) for r in df.collect())


def test_long_runs_take_seconds(spark):
    """A megabyte of anything is read in time proportional to its length."""
    import time

    from lectern.functions.rx import strip

    steps = {
        "html": lambda c: T.html_to_text(c, False), "marks": T.normalize_punctuation, "smooth": T.smooth, "markup": T.strip_markup, "strip": strip,
        "heading": lambda c: T.strip_header_verses(c, "it"),
    }
    for unit in (" ", "\n", "<", "<li ", "; ", ":\t", "- ", "1 "):
        rows = spark.createDataFrame([("x" + unit * (1_000_000 // len(unit)) + "b",)], "x string").cache()
        rows.count()
        for name, step in steps.items():
            began = time.time()
            rows.select(F.length(step(F.col("x")))).collect()
            assert time.time() - began < 15, (unit, name)
        rows.unpersist()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headings_are_lowered_once_and_not_once_a_word(spark):
    rows = [(None, False), ("", False), (" \n MENU\t", True), ("Oggi", False), ("Santo del giorno", False), ("x SANTO DEL GIORNO", True), ("AUDIÊNCIA GERAL", True)]
    df = spark.createDataFrame(rows, "x string, wanted boolean").select("x", "wanted", T.is_navigation(F.col("x")).alias("got"))
    assert [r.got for r in df.collect()] == [w for _, w in rows]
    assert "regexp_replace" not in plan_of(df)


def test_white_space_is_what_patterns_take_for_it(spark):
    from lectern.functions.rx import WHITE, matches

    df = spark.range(0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    found = df.where(matches(F.col("c"), r"\s")).select("c").collect()
    assert sorted(r.c for r in found) == sorted(WHITE)


def test_rules_are_tried_only_where_a_text_holds_their_marks(spark):
    from lectern.functions.rx import rewrite_held

    df = spark.createDataFrame([("abc", "abc"), ("abcx", "a!cx"), ("aby", "a!y"), ("", ""), (None, None)], "t string, w string")
    assert all(r.g == r.w for r in df.select("w", rewrite_held(F.col("t"), (("x", "b", "!"), ("y", "B", "!", "i"))).alias("g")).collect())


def test_long_numbers_take_seconds(spark):
    """A number of any length is read once, not again from each of its digits."""
    import time

    df = spark.createDataFrame([("1" * 200_000 + " 5,1-13",)], "t string")
    began = time.time()
    assert df.select(T.normalize_verses(F.col("t"), "it").alias("v")).first().v == "1" * 200_000 + " 5 1 a 13"
    assert time.time() - began < 15
