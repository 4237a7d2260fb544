import pytest
from pyspark.sql import functions as F

from lectern.operators import segments as S
from lectern.plans import markup as M

BASE = "Prima Lettura\nDal libro della Genesi\nGen 1,1-3\nIn principio.\nSalmo Responsoriale\nLodate.\nDal Vangelo secondo Matteo\nIn quel tempo."
FIRST, GOSPEL = "Prima Lettura\nDal libro della Genesi\nIn principio.", "Dal Vangelo secondo Matteo\nIn quel tempo."


def test_italian_sections(spark):
    cases = {
        BASE: [FIRST, GOSPEL],
        BASE + "\nFratelli, amate.\n(Papa Francesco, Angelus 5 marzo 2019)": [
            FIRST, GOSPEL + "\nFratelli, amate.", "__POPE__ Commento di Papa Francesco, Angelus 5 marzo 2019."],
        BASE + "\nPapa Francesco - Angelus, 8 luglio 2012\nFratelli, amate Mt 5,17 sempre.": [
            FIRST, GOSPEL, "__POPE__ Commento di Papa Francesco, Angelus, 8 luglio 2012.\nFratelli, amate sempre."],
        BASE + "\nFratelli, amate. (Papa Francesco, Angelus)": [FIRST, GOSPEL, "__POPE__ Commento di Papa Francesco, Angelus.\nFratelli, amate."],
        "niente": ["niente"], "": [""],
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").coalesce(1)
    got = {r.v: r.s for r in df.select("v", S.sections_of(F.col("v"), "it").alias("s")).collect()}
    assert got == cases


def test_known_fault_can_be_kept(spark):
    text = BASE + "\nFratelli, amate.\n(Papa Francesco, Angelus 5 marzo 2019)"
    r = spark.createDataFrame([(text,)], "v string").select(S.sections_of(F.col("v"), "it", faithful=True).alias("s")).first()
    assert not any("Fratelli" in x for x in r.s) and len(r.s) == 3


def test_flat_text(spark):
    text = "First reading from Genesis 1 In the beginning. Responsorial Psalm Praise. From the Gospel of Mark He said. The Gospel of the Lord. Dear brothers and sisters be good. (Pope Francis, Angelus 2019)"
    r = spark.createDataFrame([(text,)], "v string").select(S.sections_of(F.col("v"), "en").alias("s")).first()
    assert r.s == [
        "First reading from Genesis 1 In the beginning.", "From the Gospel of Mark He said. The Gospel of the Lord",
        "__POPE__ Comment by Pope Francis, Angelus 2019.\nDear brothers and sisters be good.",
    ]


def test_parts(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("r")).first().r
    assert tuple(one("Prima lettura a\nSalmo Responsoriale b\nSeconda lettura c", lambda c: S.split_readings(c, "it"))) == ("Prima lettura a", "Seconda lettura c")
    assert tuple(one("A reading from X aaa\nA reading from Y bbb", lambda c: S.split_readings(c, "en"))) == ("A reading from X aaa", "A reading from Y bbb")
    assert tuple(one("a Salmo b", lambda c: S.cut_at(c, "salmo"))) == ("a", "Salmo b")
    assert one("uno\ndue (Papa Francesco, Angelus)", lambda c: S.comment_section(c, "it")) == "__POPE__ Commento di Papa Francesco, Angelus.\nuno due"
    for line, bare in (("Gn 37,3-4", True), ("2Re", True), ("Matteo 21 33 a 43", True), ("17, 3-7", True), ("Amen", True), ("Prima Lettura", False), ("Dalla lettera", False), ("Lettera ai Romani 5 1", True)):
        assert one(line, lambda c: S.is_bare_reference(c, "it")) is bare, line


def test_markup(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("r")).first().r
    assert one('</prosody>x<prosody a="1">y', M.balance_prosody) == 'x<prosody a="1">y</prosody>'
    assert one('a & "b"', M.escape_heading) == "a &amp; &quot;b&quot;"
    head = lambda x: f'<emphasis level="moderate">{x}</emphasis>'
    assert one("Prima Lettura\nDal libro della Genesi\nIn principio", M.section_markup) == (
        head("Prima Lettura") + '<break time="0.5s"/>' + head("Dal libro della Genesi.") + '<break time="1.0s"/>In principio'
    )
    assert one("A\n\nB", M.section_text) == "A. B"
    assert '<phoneme alphabet="ipa" ph="dʒeˈzu">Gesù</phoneme>' in one("Gesù", lambda c: M.episode_markup(c, F.array(c), "it"))


def test_chunks_keep_to_the_budget_and_cut_only_outside_blocks(spark):
    body = "Head\nSub\n" + ". ".join(["Lorem __QSTART__ ipsum <x> __QEND__ dolor"] * 25)
    df = spark.createDataFrame([(body,)], "v string")
    sections = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.col("v"))
    r = df.select(M.episode_markup(F.lit("T"), sections, "en").alias("w")).select("w", M.chunks(F.col("w")).alias("c")).first()
    assert len(r.c) > 2
    assert "<speak>" + "".join(x[7:-8] for x in r.c) + "</speak>" == r.w
    for x in r.c:
        assert x.count("<prosody") == x.count("</prosody>") and x.count("<emphasis") == x.count("</emphasis>")
    assert all(len(x.encode()) >= M.SPLIT_FROM for x in r.c[:-1])


@pytest.mark.parametrize("voice,kinds", [("plain", ["speech", "silence", "speech", "silence", "speech"]), ("markup", ["speech"])])
def test_plan(spark, voice, kinds):
    df = spark.createDataFrame([(1, "T", ["A\nb", "", "C"])], "episode_id long, title string, segments array<string>")
    rows = sorted(M.synthesis_plan(df, "it", voice).collect(), key=lambda r: r.part_no)
    assert [r.kind for r in rows] == kinds


def test_voices(spark):
    rows = [("it-IT-Neural2-C", "edge", "slow"), ("xx", "google", "?"), ("de-DE-ConradNeural", "edge-tts", "fast")]
    columns = M.voice_columns(F.col("v"), F.col("p"), F.col("s"))
    got = spark.createDataFrame(rows, "v string, p string, s string").select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert sorted(map(tuple, got)) == [
        ("edge", "de", "de-DE-ConradNeural", "de-DE", 1.15), ("edge", "it", "it-IT-DiegoNeural", "it-IT", 0.85), ("google", "it", "it-IT-Neural2-C", "it-IT", 1.0),
    ]


def test_bare_references_of_a_language_column(spark):
    """A line that is a book's name, or one before verse numbers, in each row's language; nulls and unknown languages too."""
    import re

    from lectern.functions import dims

    rest = r"(?:|(?=[^\d]*\d)[\d\s,;.:\u2013\-a-z\xe0-\xfc]+)"
    lines = [f"{n.lower()}{x}" for c in dims.BOOKS for _, n in dims.books(c) for x in ("", " 5 1", "x", " e poi", "\t3")]
    lines += ["", "  ", "disse ai suoi", "12, 3-4 ", None]
    langs = [*dims.LANGUAGES, "xx", None]
    rows = [(c, x) for c in langs for x in dict.fromkeys(lines)]
    df = spark.createDataFrame(rows, "lang string, line string").select("lang", "line", S.is_bare_reference(F.col("line"), F.col("lang")).alias("bare"))
    # no pattern that depends on a row, which would be compiled for each line
    patterns, todo = [], [df._jdf.queryExecution().optimizedPlan().expressions().apply(2)]
    while todo:
        e = todo.pop()
        patterns += [e.right().foldable()] if e.getClass().getSimpleName() == "RLike" else []
        todo += [e.children().apply(i) for i in range(e.children().size())]
    assert patterns and all(patterns)
    general = re.compile(S._BARE)
    for r in df.collect():
        text = None if r.line is None else r.line.strip()
        names = [n.lower() for _, n in dims.books(r.lang or "")]
        if text is None:
            assert r.bare is None
        else:
            assert r.bare is (text != "" and (bool(general.search(text)) or any(text.startswith(n) and re.fullmatch(rest, text[len(n):]) for n in names))), r
