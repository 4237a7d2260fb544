import pytest
from pyspark.sql import functions as F

from lectern.plans import feed_xml as X
from lectern.plans import runs
from lectern.sinks import published
from lectern.sources import feeds

LEDGER = "channel string, seq long, title string, description string, audio_url string, pub_date string, guid string, duration long, file_size long"


def channels(spark, *names):
    rows = spark.createDataFrame([(c, "it", None, f"b-{c}", f"p/{c}") for c in names], "channel string, language string, email string, bucket_name string, storage_prefix string")
    return rows.withColumn("podcast_info", F.struct(*[F.lit(f"{x} & y").alias(x) for x in ("title", "author", "website", "description", "cover_art", "rss_url")]))


def ledger(spark, channel, n):
    rows = [(channel, i + 1, f"T {i} & <x>", f"d {i}\n", f"https://h.example/b/{i}.mp3", "Mon, 09 Mar 2026 00:00:00 +0000", f"g{i}", i * 3, i * 2) for i in range(n)]
    return spark.createDataFrame(rows, LEDGER)


def texts(df):
    return {r.channel: r.rss for r in df.collect()}


def test_documents_to_ledger_and_back_are_the_same_bytes(spark, tmp_path):
    path, named = str(tmp_path / "store"), channels(spark, "01", "b c")
    assert published.version(spark, path) == 0 and published.read(spark, path).count() == 0
    first = X.feed_documents(ledger(spark, "01", 5).unionByName(ledger(spark, "b c", 0)), named)
    assert published.commit(first, path, 0) == 1
    got, unread = feeds.published_ledgers(published.read(spark, path))
    assert unread.count() == 0 and [r.seq for r in got.orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    again = X.feed_documents(got, named)
    # a size of 2 or less was no size: written once more, nothing changes any more
    published.commit(again, path, 1)
    twice, _ = feeds.published_ledgers(published.read(spark, path))
    assert texts(X.feed_documents(twice, named)) == texts(published.read(spark, path)) == texts(again)
    assert set(texts(again)) == {"01", "b c"}


def test_of_two_writers_one_commits(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = lambda c, x: spark.createDataFrame([(c, x)], published.DOCUMENTS)
    published.commit(docs("a", "<1/>").unionByName(docs("b", "<2/>")), path, 0)
    base = published.version(spark, path)
    published.commit(docs("a", "<3/>"), path, base)
    with pytest.raises(published.Conflict):
        published.commit(docs("a", "<4/>"), path, base)
    assert texts(published.read(spark, path)) == {"a": "<3/>", "b": "<2/>"}
    assert texts(published.read(spark, path, base)) == {"a": "<1/>", "b": "<2/>"}


def test_a_writer_that_was_overtaken_while_it_wrote(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    docs = lambda x: spark.createDataFrame([("a", x)], published.DOCUMENTS)
    published.commit(docs("<1/>"), path, 0)
    rename, done = published._rename, []

    def overtaken(spark, source, target, base):
        if not done:
            done.append(1)
            published.commit(docs("<2/>"), path, 1)
        rename(spark, source, target, base)

    monkeypatch.setattr(published, "_rename", overtaken)
    with pytest.raises(published.Conflict):
        published.commit(docs("<3/>"), path, 1)
    assert published.version(spark, path) == 2 and texts(published.read(spark, path)) == {"a": "<2/>"}


def test_many_versions_are_gathered_and_cleaned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(published, "FOLDERS", 3)
    path = str(tmp_path / "store")
    for i in range(5):
        published.commit(spark.createDataFrame([(f"c{i}", f"<{i}/>")], published.DOCUMENTS), path, i)
    wanted = {f"c{i}": f"<{i}/>" for i in range(5)}
    assert texts(published.read(spark, path)) == wanted
    assert published._manifest(spark, path, 5).select("folder").distinct().count() <= 3
    published.clean(spark, path, keep=1)
    assert texts(published.read(spark, path)) == wanted and published._versions(spark, path) == [5]
    published.commit(spark.createDataFrame([("c0", "<x/>")], published.DOCUMENTS), path, 5)
    assert texts(published.read(spark, path)) == {**wanted, "c0": "<x/>"}


def test_unreadable_documents_are_rows(spark):
    good = "<rss><channel><title>t</title><item><title>x</title><enclosure url='u' length='9'/></item></channel></rss>"
    rows = [("a", good), ("b", good[:-20]), ("c", ""), ("d", None), ("e", "<html/>"), ("f", "<rss><channel><title>none</title></channel></rss>")]
    got, unread = feeds.published_ledgers(spark.createDataFrame(rows, "channel string, rss string"))
    assert [(r.channel, r.seq, r.title, r.file_size) for r in got.collect()] == [("a", 1, "x", 9)]
    errors = {r.channel: r.error for r in unread.collect()}
    assert errors == {"b": "the document is no XML", "c": "the document is empty", "d": "the document is empty", "e": "the document has no channel"}


def test_documents_are_parsed_once(spark):
    item = "<item><title>x</title><enclosure url='u' length='9'/></item>"
    rows = [("a", f"<rss><channel><title>t</title>{item}<item/>{item}</channel></rss>"), (None, f"<rss><channel>{item}</channel></rss>"), ("b", "<rss><chan"), ("c", "<rss><channel/></rss>")]
    items, unread = feeds.document_items(spark.createDataFrame(rows + rows, "channel string, rss string"))
    entries, _ = feeds.source_entries(spark.createDataFrame(rows, "channel string, rss string"), F.lit("it"))
    for df in (items, unread, entries):
        assert "from_xml" not in df._jdf.queryExecution().executedPlan().toString()
    # an item without fields is one, a channel without items has no row and no error, rows that repeat stay
    got = [(r.channel, r.n_items, r.pos, r.title) for r in items.where("channel = 'a'").orderBy("pos").collect()]
    assert got == [("a", 3, 0, "x")] * 2 + [("a", 3, 1, None)] * 2 + [("a", 3, 2, "x")] * 2
    assert [(r.n_items, r.pos, r.title) for r in items.where("channel IS NULL").collect()] == [(1, 0, "x")] * 2
    assert items.where("channel IN ('b', 'c')").count() == 0
    assert sorted((r.channel, r.error) for r in unread.collect()) == [("b", "the document is no XML")] * 2


def test_a_blocked_channel_is_left_as_it_is(spark):
    entries = spark.createDataFrame([(c, 0, "New", "", "l", "") for c in "ab"], "channel string, pos long, title string, summary string, link string, pub_date string")
    blocked = spark.createDataFrame([("b", "gone"), ("b", "also gone"), ("z", "never asked")], "channel string, error string")
    history = ledger(spark, "a", 2).unionByName(ledger(spark, "b", 2))
    done = runs.feed_run(entries, history, blocked, channels(spark, "a", "b"), "h.example", F.lit("2026-03-10 06:00:00").cast("timestamp"), F.lit("w"), keep=2)
    assert {(r.channel, r.status, r.code) for r in done.outcomes.collect()} == {("a", "OK", 200), ("b", "FAIL:also gone", 500), ("z", "FAIL:never asked", 500)}
    assert [(r.channel, r.title) for r in done.ledger.orderBy(F.desc("seq")).collect()] == [("a", "New"), ("a", "T 1 & <x>")]
    assert [r.path for r in done.expired.collect()] == ["0.mp3"]
    assert list(texts(done.documents(channels(spark, "a", "b")))) == ["a"]
    assert [(r.part_no, r.kind) for r in done.speech().orderBy("part_no").collect()] == [(0, "speech")]
