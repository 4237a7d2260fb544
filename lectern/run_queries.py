"""Queries of whole runs, from published documents to published documents.

Channels are a language and a number, so that they grow in number with the
tables and none grows without bound.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.flow_queries import LANGS, SITE, _day_pages, _pick, _saint_pages, _sql_pick
from lectern.functions import dims
from lectern.functions.text import spoken_date
from lectern.operators import segments as S
from lectern.plans import feed_xml as X
from lectern.plans import runs
from lectern.registry import query
from lectern.sinks import published
from lectern.sinks.deliveries import FolderStore, deliver
from lectern.sources import feeds, pages
from lectern.storage import shared_dir, spread, table

HOST = "h.example"
#: Documents that make a channel of each language, and how many of its episodes one keeps.
GROUP, KEPT = 600, 40


def _now() -> Column:
    return F.lit("2026-03-10 06:00:00").cast("timestamp")


def _lang() -> Column:
    return F.substring_index("channel", "-", 1)


def _new_store(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/published-{uuid4().hex}"


def _channels(names: DataFrame) -> DataFrame:
    """Configurations of names(channel), the language being what comes before the hyphen."""
    lang = _lang()
    info = F.struct(*[F.concat(F.lit(f"{x} & "), lang).alias(x) for x in ("title", "author", "website", "description", "cover_art", "rss_url")])
    return names.distinct().select(
        "channel", lang.alias("language"), F.lit("a@s.example").alias("email"), info.alias("podcast_info"),
        F.concat(F.lit("b-"), lang).alias("bucket_name"), F.concat(F.lit("p/"), "channel").alias("storage_prefix"),
    )


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, doc_id, and what an item of a feed says of each document."""
    n = F.col("doc_id")
    number = n.cast("string")
    return table(spark, sf_dir, "documents").select(
        F.concat(_pick(LANGS, n % 6), F.lit("-"), F.floor(n / GROUP).cast("string")).alias("channel"), n.alias("seq"),
        F.concat(F.lit("Title "), number).alias("title"), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("Sum & "), "source", F.lit(" #"), number)).alias("description"),
        F.concat(F.lit("https://l.example/"), number).alias("audio_url"), F.lit("Mon, 09 Mar 2026 00:00:00 +0000").alias("pub_date"),
        F.concat(F.lit("g-"), number).alias("guid"), F.lit(0).cast("bigint").alias("duration"), F.lit(0).cast("bigint").alias("file_size"),
    )


def _source_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, rss of the source feeds, an item for each document, the newest first."""
    rows = _entries(spark, sf_dir)
    return X.feed_documents(rows, _channels(rows.select("channel")))


def _published_before(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A store whose first version has three quarters of the documents, and the channels."""
    old = _entries(spark, sf_dir).where("seq % 4 <> 0").withColumn("guid", F.concat(F.lit("https://l.example/"), F.col("seq").cast("string")))
    old = old.withColumn("title", F.when(F.col("seq") % 4 == 1, F.concat(F.lit("  title "), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("Other "), F.col("seq").cast("string"))))
    channels = _channels(_entries(spark, sf_dir).select("channel"))
    path = _new_store(spark)
    published.commit(X.feed_documents(old, channels), path, 0)
    return path, channels


_DOCS = f"""
WITH d AS (SELECT doc_id, source, {_sql_pick(LANGS, "doc_id % 6")} AS lang, {_sql_pick(LANGS, "doc_id % 6")} || '-' || (doc_id // {GROUP}) AS channel,
  CASE WHEN doc_id % 5 = 0 THEN 'Title ' || doc_id ELSE 'Sum & ' || source || ' #' || doc_id END AS said FROM documents),
t AS (SELECT *, 'Title ' || doc_id AS title, 'https://l.example/' || doc_id AS link,
  'https://h.example/b-' || lang || '/p/' || channel || '/podcast_audio/20260309_' || channel || '_Title-' || doc_id || '.mp3' AS sound FROM d)
"""


@query(_DOCS + f""",
old AS (SELECT channel, doc_id, false AS isnew, CASE WHEN doc_id % 4 = 1 THEN 'title ' ELSE 'Other ' END || doc_id AS title,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE said END AS description, link AS audio_url, link AS guid FROM t WHERE doc_id % 4 <> 0),
new AS (SELECT channel, doc_id, true, title, said, sound, link FROM t WHERE doc_id % 4 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY isnew DESC, doc_id DESC) AS k, count(*) OVER c AS n, CASE WHEN bool_or(isnew) OVER c THEN {KEPT} ELSE count(*) OVER c END AS most
  FROM (SELECT * FROM old UNION ALL SELECT * FROM new) WINDOW c AS (PARTITION BY channel))
SELECT channel, CAST(least(n, most) - k + 1 AS BIGINT) AS seq, title, description, audio_url, guid FROM placed WHERE k <= most
""")
def republish(spark, sf_dir):
    """From published documents to published documents: read as ledgers, what the feeds have besides is put on top, the
    newest 40 stay, and the new version is read again. Channels without anything new stay as they are."""
    path, channels = _published_before(spark, sf_dir)
    ledger, unread = feeds.published_ledgers(published.read(spark, path))
    entries, blocked = feeds.source_entries(_source_feeds(spark, sf_dir), _lang())
    done = runs.feed_run(entries.drop("lang"), ledger, unread.unionByName(blocked), channels, HOST, _now(), F.lit(SITE), KEPT)
    number = published.commit(done.documents(channels), path, 1)
    after, _ = feeds.published_ledgers(published.read(spark, path, number))
    return after.select("channel", "seq", "title", "description", "audio_url", "guid")


@query(_DOCS + """,
c AS (SELECT DISTINCT channel FROM t), r AS (SELECT channel, CASE WHEN doc_id % 4 = 0 THEN 'OK' ELSE 'SKIP:known' END AS status FROM t),
k AS (SELECT channel, CASE WHEN lang = 'de' THEN 'FAIL:the document is no XML' WHEN lang = 'fr' THEN 'FAIL:the document is empty' END AS failed FROM (SELECT DISTINCT channel, lang FROM t))
SELECT channel, status, 200 AS code, count(*) AS n FROM r JOIN k USING (channel) WHERE failed IS NULL GROUP BY channel, status
UNION ALL SELECT channel, failed, 500, 1 FROM k WHERE failed IS NOT NULL
""")
def broken_feeds(spark, sf_dir):
    """A run in which some source feeds end in the middle and some published documents are empty: those channels fail, and
    nothing else does."""
    path, channels = _published_before(spark, sf_dir)
    before = published.read(spark, path)
    before = before.withColumn("rss", F.when(F.col("channel").startswith("fr"), "").otherwise(F.col("rss")))
    source = _source_feeds(spark, sf_dir)
    cut = F.when(F.col("channel").startswith("de"), F.left("rss", F.length("rss") - 30)).otherwise(F.col("rss"))
    ledger, unread = feeds.published_ledgers(before)
    entries, blocked = feeds.source_entries(source.withColumn("rss", cut), _lang())
    done = runs.feed_run(entries.drop("lang"), ledger, unread.unionByName(blocked), channels, HOST, _now(), F.lit(SITE), KEPT)
    return done.outcomes.groupBy("channel", "status", "code").agg(F.count(F.lit(1)).alias("n"))


@query(_DOCS + """
SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY doc_id) AS BIGINT) AS seq, title, said AS description, sound AS audio_url, link AS guid FROM t
""")
def history_run(spark, sf_dir):
    """Ledgers made anew of all that the feeds have, the last of a feed first."""
    entries, blocked = feeds.source_entries(_source_feeds(spark, sf_dir), _lang())
    channels = _channels(_entries(spark, sf_dir).select("channel"))
    done = runs.history_run(entries.drop("lang"), blocked, channels, HOST, _now(), F.lit(SITE))
    after, _ = feeds.published_ledgers(done.documents(channels))
    return after.select("channel", "seq", "title", "description", "audio_url", "guid")


def _asked(days: DataFrame) -> DataFrame:
    """A channel for each page: a page stands for its language's page of a day."""
    return days.withColumn("channel", F.concat("lang", F.lit("-"), F.col("page_id").cast("string")))


@query(f"""
WITH p AS (SELECT page_id, page_id % 6 AS i, DATE '2026-03-01' + CAST(page_id % 28 AS INTEGER) AS day FROM pages),
s AS (SELECT page_id, {_sql_pick(LANGS, "i")} AS lang, day, page_id % 7 <> 6 AS page,
  CASE WHEN page_id % 5 <> 4 THEN 'Giorno ' || page_id ELSE day(day) || ' ' || {_sql_pick([dims.MONTHS[c][2] for c in LANGS], "i")} || ' 2026' END AS title,
  'https://s.example/' || {_sql_pick(LANGS, "i")} || '/' || {_sql_pick([dims.DAY_PAGES[c][0] for c in LANGS], "i")} || '/' || strftime(day, '%Y/%m/%d') || '.html' AS guid FROM p),
k AS (SELECT *, CASE WHEN page THEN 'page' WHEN page_id % 2 = 0 THEN 'feed' END AS origin FROM s)
SELECT lang || '-' || page_id AS channel, CASE origin WHEN 'page' THEN title WHEN 'feed' THEN 'From the feed ' || page_id END AS title,
  CASE origin WHEN 'page' THEN guid WHEN 'feed' THEN 'https://l.example/' || page_id END AS guid,
  CASE WHEN origin IS NULL THEN 'FAIL:no content' WHEN page_id % 3 = 0 AND page_id % 9 <> 0 AND origin = 'page' THEN 'SKIP:known' ELSE 'OK' END AS status,
  CASE WHEN origin IS NULL THEN 404 ELSE 200 END AS code FROM k
""")
def page_or_feed(spark, sf_dir):
    """The episode of a day: from its page, or from the newest entry of the feed where the page has no sections; what is
    published is skipped, unless it is asked for again."""
    days = _asked(_day_pages(spark, sf_dir))
    n = F.col("page_id")
    asked = days.select("channel", "day", (n % 9 == 0).alias("force"))
    number = n.cast("string")
    entries = days.where("page_id % 2 = 0").select(
        "channel", F.explode(F.array(F.lit(1), F.lit(0))).alias("pos"), F.concat(F.lit("From the feed "), number).alias("title"), F.lit("").alias("summary"),
        F.concat(F.lit("https://l.example/"), number).alias("link"), F.lit("Mon, 09 Mar 2026 00:00:00 +0000").alias("pub_date"),
    )
    entries = entries.withColumn("title", F.when(F.col("pos") == 1, F.lit("Older")).otherwise(F.col("title")))
    slug = F.element_at(F.create_map(*[F.lit(x) for c, v in dims.DAY_PAGES.items() for x in (c, v[0])]), F.col("lang"))
    ledger = days.where("page_id % 3 = 0").select(
        "channel", F.lit(1).cast("bigint").alias("seq"), F.lit("t").alias("title"), F.lit("").alias("description"), F.lit("https://h.example/b/x.mp3").alias("audio_url"), F.lit("d").alias("pub_date"),
        F.concat_ws("/", F.lit(SITE), "lang", slug, F.date_format("day", "yyyy/MM/dd'.html'")).alias("guid"), F.lit(0).cast("bigint").alias("duration"), F.lit(0).cast("bigint").alias("file_size"),
    )
    nothing = spark.createDataFrame([], "channel string, error string")
    done = runs.day_run(asked, days, entries, ledger, nothing, _channels(days.select("channel")), SITE, HOST, _now(), F.lit(SITE))
    return done.outcomes


@query(f"""
WITH p AS (SELECT page_id, page_id % 6 AS i, DATE '2026-03-01' + CAST(page_id % 28 AS INTEGER) AS day FROM pages),
s AS (SELECT page_id, {_sql_pick(LANGS, "i")} AS lang, day, {_sql_pick([dims.SAINT_PAGES[c][1] for c in LANGS], "i")} AS head, {_sql_pick([dims.MONTHS[c][2] for c in LANGS], "i")} AS m FROM p)
SELECT lang || '-' || page_id AS channel, CASE WHEN page_id % 5 = 2 THEN NULL ELSE head || ' - ' || CASE WHEN lang = 'en' THEN m || ' ' || day(day) || ', 2026' WHEN lang = 'de' THEN day(day) || '. ' || m || ' 2026'
  WHEN lang IN ('es', 'pt') THEN day(day) || ' de ' || m || ' de 2026' ELSE day(day) || ' ' || m || ' 2026' END END AS title,
  CASE WHEN page_id % 5 = 2 THEN NULL ELSE 'saint-' || lang || '-' || strftime(day, '%Y-%m-%d') END AS guid,
  CASE WHEN page_id % 5 = 2 THEN 'FAIL:no content' WHEN page_id % 4 = 1 THEN 'SKIP:known' ELSE 'OK' END AS status, CASE WHEN page_id % 5 = 2 THEN 404 ELSE 200 END AS code FROM s
""")
def saint_run(spark, sf_dir):
    """The saints of a day: known by guid only, so that last year's title doesn't count; a day without a page fails."""
    days = _asked(_saint_pages(spark, sf_dir)).drop("url")
    asked = days.select("channel", "day")
    there = days.where("page_id % 5 <> 2")
    details = spark.createDataFrame([], "url string, text string")
    heading = F.element_at(F.create_map(*[F.lit(x) for c, v in dims.SAINT_PAGES.items() for x in (c, v[1])]), F.col("lang"))
    year = F.when(F.col("page_id") % 4 == 1, "2026").otherwise("2025")
    ledger = days.select(
        "channel", F.lit(1).cast("bigint").alias("seq"), F.concat(heading, F.lit(" - "), spoken_date(F.col("day"), F.col("lang"))).alias("title"), F.lit("").alias("description"),
        F.lit("https://h.example/b/x.mp3").alias("audio_url"), F.lit("d").alias("pub_date"), F.concat_ws("-", F.lit("saint"), "lang", year, F.date_format("day", "MM-dd")).alias("guid"),
        F.lit(0).cast("bigint").alias("duration"), F.lit(0).cast("bigint").alias("file_size"),
    )
    nothing = spark.createDataFrame([], "channel string, error string")
    return runs.saint_run(asked, there, details, ledger, nothing, _channels(days.select("channel")), SITE, HOST, _now(), F.lit(SITE)).outcomes


@query(_DOCS + """,
n AS (SELECT * FROM t WHERE doc_id % 4 = 0)
SELECT channel, link AS guid, CAST(0 AS INTEGER) AS part_no, 'speech' AS kind, title AS payload FROM n
UNION ALL SELECT channel, link, 1, 'silence', '2.5' FROM n UNION ALL SELECT channel, link, 2, 'speech', said FROM n
""")
def run_speech(spark, sf_dir):
    """What a run has spoken: the synthesis plan of all new entries, each in its channel's language."""
    path, channels = _published_before(spark, sf_dir)
    ledger, unread = feeds.published_ledgers(published.read(spark, path))
    entries, blocked = feeds.source_entries(_source_feeds(spark, sf_dir), _lang())
    done = runs.feed_run(entries.drop("lang"), ledger, unread.unionByName(blocked), channels, HOST, _now(), F.lit(SITE), KEPT)
    return done.speech("plain").drop("bytes")


@query("""
SELECT 'p/' || source || '/' || doc_id || '.txt' AS target, CASE WHEN doc_id % 3 = 0 THEN 'SKIP:there' ELSE 'OK' END AS status, CAST(1 AS INTEGER) AS attempts,
  strlen(text) AS bytes, sha256(text) AS sha256 FROM documents
""")
def deliveries(spark, sf_dir):
    """All documents delivered as files, after a third of them has been: those are there already."""
    store = FolderStore(f"{shared_dir(spark)}/delivered-{uuid4().hex}")
    target = F.concat(F.lit("p/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    plan = spread(table(spark, sf_dir, "documents")).select("doc_id", target.alias("target"), F.col("text").cast("binary").alias("content"))
    deliver(plan.where("doc_id % 3 = 0"), store)
    return deliver(plan, store)


@query("""
WITH f AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, 'a' || event_id || '_azure_1.mp3') AS k FROM events WHERE event_id % 3 = 0)
SELECT CAST(26 - k AS BIGINT) AS seq, 'a' || event_id || '_azure_1.mp3' AS file, 'a' || event_id AS title, event_id + 7 AS size FROM f WHERE k <= 25
""")
def newest_files(spark, sf_dir):
    """The newest 25 sound files of a listing, as they would stand in a ledger that is made anew."""
    name = F.concat(F.lit("s3://b/p/a"), F.col("event_id").cast("string"), F.lit("_azure_1"), F.when(F.col("event_id") % 3 == 0, ".mp3").otherwise(".txt"))
    files = table(spark, sf_dir, "events").select(name.alias("path"), (F.col("event_id") + 7).alias("length"), F.col("ts").alias("modificationTime"))
    return feeds.stored_episodes(files, 25)


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS language, 'https://f.example/' || n_nationkey AS feed_url, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE 'b-' || n_name END AS bucket_name,
  n_name || ' & co' AS title FROM nation WHERE n_nationkey % 3 = 0
""")
def channel_settings(spark, sf_dir):
    """Channels that name a feed, from files of settings."""
    n = F.col("n_nationkey")
    url = F.when(n % 3 == 0, F.concat(F.lit("https://f.example/"), n.cast("string"))).when(n % 3 == 1, "TODO: feed").otherwise("")
    info = F.struct(F.concat("n_name", F.lit(" & co")).alias("title"))
    one = F.struct(n.cast("string").alias("language"), url.alias("feed_url"), F.when(n % 4 != 1, F.concat(F.lit("b-"), "n_name")).alias("bucket_name"), info.alias("podcast_info"))
    path = f"{shared_dir(spark)}/settings-{uuid4().hex}"
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)
    found = feeds.with_feed(feeds.configurations(spark, path))
    return found.select("language", "feed_url", "bucket_name", F.col("podcast_info.title").alias("title"))


@query("""
WITH p AS (SELECT page_id AS n FROM pages)
SELECT n AS page_id, 'Santo ' || n AS name, 'Breve ' || n || '.' AS brief, CASE WHEN n % 2 = 0 THEN 'https://s.example/it/santo-del-giorno/03/09/santo-' || n || '.html' END AS detail_url FROM p
UNION ALL SELECT n, 'Beata Ada ' || n, '', 'https://s.example/it/santo-del-giorno/03/10/ada-' || n || '.html' FROM p
UNION ALL SELECT n, 'Unknown Saint', '', 'https://s.example/it/santo-del-giorno/03/11/x.html' FROM p WHERE n % 5 = 0
""")
def saint_list(spark, sf_dir):
    """The saints of pages: from headings, with addresses made from names where they are known to exist, and from links
    that no heading led to, each once."""
    n = F.col("page_id").cast("string")
    link = lambda x: F.concat(F.lit('<a href="/it/santo-del-giorno/'), *x, F.lit("</a>"))
    ada = link((F.lit("03/10/ada-"), n, F.lit('.html">BEATA ADA '), n))
    html = F.concat(
        F.lit('<section><div class="section__head"><h2>SANTO '), n, F.lit('</h2></div><div class="section__wrapper"><p>Breve '), n, F.lit(".</p></div></section><h2>Menu</h2><div>"),
        ada, ada, F.when(F.col("page_id") % 5 == 0, link((F.lit('03/11/x.html"><img src="i.png">'),))).otherwise(""), F.lit('<a href="/it/altro.html">Altro</a></div>'),
    )
    given = spread(table(spark, sf_dir, "pages")).select("page_id", F.lit("2026-03-09").cast("date").alias("day"), html.alias("html"))
    known = given.where("page_id % 2 = 0").select(F.concat(F.lit(f"{SITE}/it/santo-del-giorno/03/09/santo-"), n, F.lit(".html")).alias("url"))
    return pages.saints(pages.with_elements(given), "it", SITE, known).select("page_id", "name", "brief", "detail_url")


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Papa Francesco, Angelus ' || (2000 + doc_id % 25) WHEN 1 THEN 'Benedetto XVI - Omelia ' || doc_id END AS meta,
  CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS INTEGER) AS at, CASE WHEN doc_id % 4 = 2 THEN 'Fine ' || doc_id || '.' END AS body, CASE WHEN doc_id % 4 = 2 THEN 'Papa Leone ' || doc_id END AS end_meta FROM documents
""")
def attributions(spark, sf_dir):
    """Who said it: a parenthesis at the end of a line, a line of its own that names a pope and an event, or a parenthesis
    that ends the last line."""
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    alone = F.concat(F.lit("Benedetto XVI - Omelia "), n)
    lines = (
        F.when(kind == 0, F.array(F.lit("Un papa disse"), F.concat(F.lit("così (Papa Francesco, Angelus "), (2000 + F.col("doc_id") % 25).cast("string"), F.lit(") ")), alone))
        .when(kind == 1, F.array(F.lit("Papa Francesco"), F.lit("nel 2019 (nota)"), alone))
        .otherwise(F.array(F.lit("Parole"), F.lit("nel 2019")))
    )
    last = F.when(kind == 2, F.concat(F.lit("Fine "), n, F.lit(". (Papa Leone "), n, F.lit(")"))).otherwise("Fine (nota).")
    found, end = S.attribution_line(lines), S.attribution_at_end(last)
    return table(spark, sf_dir, "documents").select(
        "doc_id", found["meta"].alias("meta"), found["at"].alias("at"), F.when(end["meta"].isNotNull(), end["body"]).alias("body"), end["meta"].alias("end_meta")
    )


@query("""
WITH p AS (SELECT page_id AS n, unnest(range(1, 41)) AS k FROM pages)
SELECT n AS page_id, string_agg('Paragrafo ' || k || ' della pagina ' || n || ', lungo abbastanza per contare come un paragrafo vero.', chr(10) ORDER BY k) AS text FROM p WHERE k <= 30 GROUP BY n
""")
def thirty_paragraphs(spark, sf_dir):
    """Detail pages of forty paragraphs, of which thirty are taken."""
    n = F.col("page_id").cast("string")
    one = lambda k: F.concat(F.lit("<p>Paragrafo "), k.cast("string"), F.lit(" della pagina "), n, F.lit(", lungo abbastanza per contare come un paragrafo vero.</p><p>breve</p>"))
    html = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), one), "")
    return pages.detail_texts(pages.with_elements(spread(table(spark, sf_dir, "pages")).select("page_id", html.alias("html")))).select("page_id", "text")
