import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.operators import ledger as L
from lectern.operators.components import connected_components
from lectern.plans import batch as B
from lectern.plans import feed_xml as X
from lectern.plans import publish as R
from lectern.sources import feeds
from lectern.sources import pages as P
from lectern.streaming.ledger_stream import publish_stream, read_ledger

PAGE = (
    '<html><body><section class="section--isStatic"><div class="section__head"><h2>SAN PIO</h2></div><div class="section__wrapper">'
    '<p>Bio &agrave; <span>Lc 4,24-30</span> testo</p><a class="saintReadMore" href="/it/santo-del-giorno/03/09/pio.html">Leggi</a></div></section>'
    "<a href=\"/it/santo-del-giorno/03/09/anna.html\">SANT'ANNA</a><a href=\"/x\">z</a><h2>Cerca</h2></body></html>"
)
LINKED = '<div><h2>A</h2><div>beside</div></div><a href="/it/santo-del-giorno/01/02/b.html"><div class="section__head"><h2>B ></h2></div></a>'

FLAT = "<body><div><h2>Flat</h2><p>uno</p><p>due</p><h2>Next</h2><p>n</p></div></body>"


def parsed(spark):
    rows = [(1, datetime.date(2026, 3, 9), PAGE), (2, datetime.date(2026, 1, 2), LINKED), (3, None, None), (4, None, "<p>unclosed <b>bold<p>next"), (5, datetime.date(2026, 3, 9), FLAT)]
    return P.with_elements(spark.createDataFrame(rows, "page_id long, day date, html string"))


def test_sections_of_three_layouts(spark):
    got = {(r.page_id, r.heading): r.t for r in P.sections(parsed(spark)).select("page_id", "heading", P.html_to_text(F.col("read")).alias("t")).collect()}
    assert got[1, "SAN PIO"] == "Bio à testo\nLeggi" and got[2, "A"] == "beside" and got[5, "Flat"] == "uno\ndue"


def test_saints(spark):
    known = spark.createDataFrame([("https://s.example/it/santo-del-giorno/03/09/flat.html",)], "url string")
    got = {(r.page_id, r.name): r.detail_url for r in P.saints(parsed(spark), "it", "https://s.example", known).collect()}
    site = "https://s.example/it/santo-del-giorno"
    assert got == {
        (1, "San Pio"): f"{site}/03/09/pio.html", (5, "Flat"): f"{site}/03/09/flat.html", (5, "Next"): None, (1, "Sant'Anna"): f"{site}/03/09/anna.html",
        (2, "A"): None, (2, "B"): f"{site}/01/02/b.html",
    }


def test_tolerant_elements(spark):
    text = F.transform("nodes", lambda n: F.struct(n["tag"].alias("tag"), P.text_of(F.col("pieces"), n).alias("text")))
    nodes = parsed(spark).where("page_id = 4").select(F.inline(text)).collect()
    assert [(n.tag, n.text) for n in nodes] == [("p", "unclosed bold next"), ("b", "bold next"), ("p", "next")]


def test_new_entries(spark):
    history = spark.createDataFrame([("A", "g1")], "title string, guid string")
    entries = spark.createDataFrame([(1, "a ", "g9"), (2, "B", "g1"), (3, "B", ""), (4, "C", "g2")], "n int, title string, link string")
    assert sorted(r.n for r in L.new_entries(entries, history).collect()) == [3, 4]
    assert sorted((r.n, r.skipped) for r in L.with_known(entries, history).collect()) == [(1, True), (2, True), (3, False), (4, False)]


def test_retention_and_expiry(spark):
    ledger = spark.range(1, 183).select(F.lit("c").alias("channel"), F.col("id").alias("seq"), F.concat(F.lit("https://h/b/x/"), "id", F.lit(".mp3")).alias("audio_url"))
    assert L.retained(ledger).where("kept").count() == 180
    assert sorted(r.path for r in L.expired_files(ledger).collect()) == ["x/1.mp3", "x/2.mp3"]


def test_batches(spark):
    assert [str(r.date) for r in B.days_of_month(spark, 2026, 2, "2026-02-03").collect()] == ["2026-02-01", "2026-02-02", "2026-02-03"]
    assert B.days_of_month(spark, 2026, 3, "2026-02-03").count() == 0
    codes = spark.createDataFrame([("a", 200), ("a", 200), ("b", 200), ("b", 404)], "k string, code int")
    assert dict(map(tuple, B.overall_status(codes, ["k"]).collect())) == {"a": 200, "b": 207}


def test_feed_round_trip_and_empty_channel(spark, tmp_path):
    rows = [("it", 1, "A & <b>", "d\n😀", "https://h/b/a&b.mp3", "p", "g<1", 65, 7), ("it", 2, "B", "", "https://h/b/c.mp3", "p2", "g2", 0, 1)]
    ledger = spark.createDataFrame(rows, "channel string, seq long, title string, description string, audio_url string, pub_date string, guid string, duration long, file_size long")
    info = F.struct(*[F.lit("x&y").alias(n) for n in ("title", "author", "website", "description", "cover_art", "rss_url")])
    channels = spark.createDataFrame([("it", "it", "m@x"), ("fr", "fr", None)], "channel string, language string, email string").withColumn("podcast_info", info)
    X.write_feeds(X.feed_documents(ledger, channels), str(tmp_path / "f"))
    got = sorted(map(tuple, feeds.published(feeds.read_items(spark, str(tmp_path / "f"))).collect()))
    assert got == [("A & <b>", "d", "https://h/b/a&b.mp3", "p", "g<1", 65, 7), ("B", "", "https://h/b/c.mp3", "p2", "g2", 0, 0)]


def test_listing_and_configurations(spark, tmp_path):
    for name in ("one_azure_1.mp3", "two.mp3", "note.txt"):
        (tmp_path / name).write_text("x")
    got = feeds.stored_episodes(feeds.listing(spark, str(tmp_path))).collect()
    assert sorted(r.title for r in got) == ["one", "two.mp3"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "it.json").write_text('{"language": "it", "feed_url": "TODO", "podcast_info": {"title": "T"}}')
    configs = feeds.configurations(spark, str(tmp_path / "c"))
    assert configs.first().podcast_info.title == "T" and feeds.with_feed(configs).count() == 0


def test_publishing_twice_is_publishing_once(spark, tmp_path):
    schema = "channel string, pos long, title string, description string, link string, pub_date string, audio_url string"
    rows = [("it", 0, "New", "d", "l1", "p", "u"), ("it", 1, "Old", "d", "l2", "p", "u")]
    for name in ("a", "b"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        publish_stream(stream, str(tmp_path / "ledger"), str(tmp_path / "ck")).awaitTermination()
        got = [(r.title, r.seq) for r in read_ledger(spark, str(tmp_path / "ledger")).orderBy(F.desc("seq")).collect()]
        assert got == [("New", 2), ("Old", 1)], name


def test_streamed_entries_without_dates_and_links_are_told_apart(spark, tmp_path):
    schema = "channel string, pos long, title string, description string, link string, pub_date string, audio_url string"
    for name, title in (("a", "One"), ("b", "Two")):
        rows = [(c, 0, f"{title} {c}", "d", "", "", "u") for c in ("it", "en")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        publish_stream(stream, str(tmp_path / "ledger"), str(tmp_path / "ck"), website="https://s.example").awaitTermination()
    got = read_ledger(spark, str(tmp_path / "ledger")).collect()
    assert len({r.guid for r in got}) == len(got) == 4
    year = str(datetime.datetime.now(datetime.UTC).year)
    assert all(year in r.pub_date for r in got)


def test_a_stream_gathers_its_ledger(spark, tmp_path, monkeypatch):
    """Many batches leave few tables, the last of which may run again."""
    import os
    import shutil

    from lectern.streaming import ledger_stream

    monkeypatch.setattr(ledger_stream, "GATHER", 2)
    schema = "channel string, pos long, title string, description string, link string, pub_date string, audio_url string"
    path = str(tmp_path / "ledger")
    for i in range(6):
        spark.createDataFrame([("it", 0, f"T{i}", "d", f"l{i}", "x", "u")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        publish_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "ck"), keep=4).awaitTermination()
        if i == 5:  # as if the last batch hadn't been noted
            for ends in ("commits/5", "commits/.5.crc"):
                os.remove(tmp_path / "ck" / ends)
            publish_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "ck"), keep=4).awaitTermination()
    got = [(r.title, r.seq) for r in read_ledger(spark, path, keep=4).orderBy(F.desc("seq")).collect()]
    assert got == [("T5", 6), ("T4", 5), ("T3", 4), ("T2", 3)]
    assert sorted(os.listdir(f"{path}/gathered")) == ["v=3", "v=5"] and sorted(os.listdir(f"{path}/added")) == ["v=4", "v=5"]
    shutil.rmtree(path)


def test_rows_are_numbered_within_groups_of_any_size(spark):
    df = spark.range(0, 3_000, 1, 7).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))).alias("channel"), (F.col("id") * 37 % 3_000).alias("pos"))
    got = L.publish_order(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.channel, []).append((-r.pos, r.seq))
    assert sum(map(len, by.values())) == 3_000
    assert all([s for _, s in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


def test_feeds_are_read_in_document_order(spark, tmp_path):
    items = "".join(f"<item><title>{t}</title><link>l{i}</link></item>" for i, t in enumerate("zaqmb"))
    for name in ("x", "y"):
        (tmp_path / f"{name}.xml").write_text(f"<rss><channel><title>{name}</title>{items}</channel></rss>")
    (tmp_path / "z.xml").write_text("<rss><channel><title>none</title></channel></rss>")
    got = feeds.read_feeds(spark, str(tmp_path)).collect()
    for name in ("x", "y"):
        assert [r.title for r in sorted((r for r in got if f"{name}.xml" in r.feed), key=lambda r: r.pos)] == list("zaqmb")
    assert len(got) == 10


def test_the_first_heading_of_a_page_agrees_with_another_parser(spark):
    import html
    import os
    import re

    from lectern import queries
    from tests.duck import SF

    if not os.path.isdir(SF):
        return
    text = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.page_title(spark, SF).collect():
        found = re.search(r"<h1\b[^>]*>(.*?)</h1>", re.sub(r"(?s)<!--.*?-->", "", text[r.page_id]), re.S | re.I)
        parts = [html.unescape(x).strip() for x in re.split(r"<[^>]+>", found[1])] if found else []
        assert (r.title or "") == " ".join(x for x in parts if x)


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from lectern.storage import shared_dir

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

            class getConf:
                get = staticmethod(lambda k, d: d)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(Cluster)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 50), (50, 7), (3, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 50: 1, 7: 1}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_title_of_a_day_page(spark):
    html = '<div class="indicazioneLiturgica">Lunedì santo</div>'
    df = P.with_elements(spark.createDataFrame([(1, html, datetime.date(2026, 3, 9)), (2, "<p>x</p>", datetime.date(2026, 3, 9))], "i int, html string, d date"))
    got = df.select("i", P.title(F.col("nodes"), F.col("pieces"), F.lit("am 09/03/2026 Tag der Ruhe  x"), F.col("d"), F.lit("it"), F.lit("marzo")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["Lunedì santo", "Tag der Ruhe"]


def test_a_page_takes_no_more_room_than_its_source(spark):
    """A hundred thousand tags that are never closed, and as many ends of tags that were never opened."""
    import time

    rows = [(1, "<h1>t</h1>" + "<div>xyz " * 100_000), (2, "<div>" * 50_000 + "</p>" * 50_000 + "end"), (3, "<a href=x>" + "<b>" * 50_000 + "</a>" + "</i>" * 50_000)]
    began = time.time()
    found = P.with_elements(spark.createDataFrame(rows, "page_id long, html string"))
    got = found.select("page_id", F.size("nodes").alias("n"), F.size("pieces").alias("m"), F.expr("nodes[1].last - nodes[1].first").alias("inside")).collect()
    assert {(r.page_id, r.n, r.m, r.inside) for r in got} == {(1, 100_001, 100_001, 100_000), (2, 50_000, 1, 1), (3, 50_001, 0, 0)}
    assert time.time() - began < 30


def test_verse_elements_are_cut_out_whole(spark):
    html = (
        "<h2>x</h2><p>Dal libro <span>Mt <b>5</b></span><span><b>Lc 4,24-30</b></span>dei Re <small>2Re 5,1-15a</small>, "
        "<sup><span>Gv 1,2</span></sup>fine <span>Gesu disse</span></p><h2>y</h2><p><span>Mt 1,1</span>z</p>"
    )
    df = P.with_elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {r.heading: r.read for r in P.sections(df).collect()}
    assert got == {"x": "<p>Dal libro <span>Mt <b>5</b></span>dei Re , fine <span>Gesu disse</span></p>", "y": "<p>z</p>"}


def test_pages_are_parsed_in_small_slices_of_a_batch(spark):
    """As many pages as a batch of Spark holds are never parsed at once."""
    made = [None if i % 50 == 7 else f"<body><h1>T{i}</h1>" + f"<p>{i} &amp; x</p>" * (i % 5) for i in range(2 * P.SLICE + 9)]
    slices = list(P.parsed(iter([pa.array(made, pa.string()), pa.array([], pa.string()), pa.array(made[:3], pa.string())])))
    assert [len(x) for x in slices] == [P.SLICE, P.SLICE, 9, 3]
    rows = spark.createDataFrame(list(enumerate(made)), "page_id long, html string").coalesce(1)
    got = P.with_elements(rows).select("page_id", "pieces", F.size("nodes").alias("n")).collect()
    texts = {i: [] if x is None else [f"T{i}", *[f"{i} & x"] * (i % 5)] for i, x in enumerate(made)}
    assert {r.page_id: r.pieces for r in got} == texts
    assert {r.page_id: r.n for r in got} == {i: 0 if x is None else 2 + i % 5 for i, x in enumerate(made)}


def _day_page(*sections):
    one = lambda head, body: f'<section><div class="section__head x"><h2>{head}</h2></div><div class="a section__wrapper">{body}</div></section>'
    return "<body>" + "".join(one(*x) for x in sections) + "</body>"


def _days(spark):
    day, gospel = datetime.date(2026, 3, 9), ("VANGELO del giorno", "<p>Testo <b>del</b> giorno.</p>")
    marked = '<div class="x indicazioneLiturgica">Luned&igrave;</div>'
    rows = [
        (1, "it", day, marked + _day_page(("altro", "<p>no</p>"), gospel, ("Vangelo", "<p>second</p>"))), (2, "it", day, "<p>Era il 09/03/2026  Giorno  bello</p>"), (3, "it", day, None), (4, "xx", day, marked),
        (5, None, day, _day_page(gospel)), (6, "it", None, marked + _day_page(("Vangelo", "<p> </p>"))), (7, "it", day, marked), (7, "it", day, marked + _day_page(gospel)), (8, "it", day, _day_page(gospel)), (8, "it", day, _day_page(gospel)),
        (None, "it", day, marked + _day_page(gospel)),
    ]
    return P.with_elements(spark.createDataFrame(rows, "page_id long, lang string, day date, html string"))


def test_day_episodes_of_odd_pages(spark):
    """Pages without text, sections, language, day or id, two of one id, and one that comes twice."""
    got = sorted((str(r.page_id), r.lang, r.title, r.segments) for r in R.day_episodes(_days(spark), "s").collect())
    text = ["Testo del giorno."]
    assert sorted(got, key=str) == sorted([
        ("1", "it", "Luned\xec", text), ("2", "it", "Giorno bello", []), ("3", "it", "9 marzo 2026", []), ("4", "xx", None, []), ("5", None, None, []), ("6", "it", "Luned\xec", []),
        ("7", "it", "Luned\xec", text), ("7", "it", "Luned\xec", text), ("8", "it", "9 marzo 2026", text), ("8", "it", "9 marzo 2026", text), ("None", "it", "Luned\xec", []),
    ], key=str)


def test_texts_of_a_day_are_worked_out_once(spark):
    """No filter holds the steps that clean a text, which the projection under it would take again."""
    filters, todo = [], [R.day_episodes(_days(spark), "s")._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        filters += [node.condition().toString()] if node.nodeName() == "Filter" else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert not [x for x in filters if "lambda" in x]
    # a part's second text is blank on most pages: it is left out before all steps, and what they leave empty at the end
    assert [x for x in filters if x.startswith("NOT (trim(text")]


def test_a_day_page_is_parsed_once(spark):
    """Titles and sections come from what one pass over the pages wrote, not from parsing them again."""
    plan = R.day_episodes(_days(spark), "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "elements(" not in plan and "_unescape(" not in plan


def test_sections_with_a_row_for_pages_without_any(spark):
    pages = parsed(spark)
    every, some = (P.sections(pages, outer=x).select("page_id", "ord", "heading", "section", "read").collect() for x in (True, False))
    assert sorted((r for r in every if r.ord is not None), key=str) == sorted(some, key=str)
    assert sorted(tuple(r) for r in every if r.ord is None) == [(3, None, None, None, None), (4, None, None, None, None)]
