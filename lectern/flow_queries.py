"""Queries of whole runs, from pages and feeds to the ledger, and of the functions they are made of, in all six languages.

Inputs are put together from the tables' columns, in the same way on both sides.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dims
from lectern.functions import text as T
from lectern.operators import ledger as L
from lectern.operators import segments as S
from lectern.plans import feed_xml as X
from lectern.plans import markup as M
from lectern.plans import publish as R
from lectern.registry import query
from lectern.sources import feeds, pages
from lectern.storage import shared_dir, spread, table

SITE = "https://s.example"
LANGS = dims.LANGUAGES


def _pick(values, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def _sql_pick(values, n: str) -> str:
    listed = ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST({n} AS INTEGER) + 1]"


def _by_lang(rows: DataFrame, make) -> DataFrame:
    """make(rows of a language, language) of all languages; their number is fixed."""
    out = None
    for code in LANGS:
        part = make(rows.where(F.col("lang") == code), code)
        out = part if out is None else out.unionByName(part)
    return out


# fixed values of the inputs: what a page of each language says
_LABELS = {
    "it": ("Prima Lettura", "Salmo Responsoriale", "Seconda Lettura", "Dal Vangelo secondo Matteo", "Mt"),
    "en": ("A reading from the Book of Kings", "Responsorial Psalm", "Second Reading", "From the Gospel according to Matthew", "Mt"),
    "es": ("Lectura de los Reyes", "Salmo responsorial", "Segunda lectura", "Lectura del santo evangelio", "Mt"),
    "fr": ("Lecture du livre des Rois", "Psaume", "Deuxième lecture", "Évangile du jour", "Mt"),
    "pt": ("Leitura dos Reis", "Salmo responsorial", "Segunda leitura", "Evangelho do dia", "Mt"),
    "de": ("Lesung aus dem Buch der Könige", "Antwortpsalm", "Zweite Lesung", "Aus dem Evangelium", "Mt"),
}
_NAMES = [dims.BOOKS[c]["mt"] for c in LANGS]
_SEE = [dims.CROSS_REFERENCES[c][0][1] for c in LANGS]
_TO = [dims.RANGE_WORD[c] for c in LANGS]


_FEED = f"""
WITH d AS (SELECT doc_id, source, doc_id % 6 AS i, row_number() OVER (PARTITION BY doc_id % 6 ORDER BY doc_id DESC) - 1 AS pos FROM documents)
SELECT {_sql_pick(LANGS, "i")} AS lang, CAST(pos AS INTEGER) AS pos,
  {_sql_pick(_SEE, "i")} || ' ' || {_sql_pick(_NAMES, "i")} || ' ' || (doc_id % 9 + 1) || ' ' || (doc_id % 7 + 1) ||
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' ' || {_sql_pick(_TO, "i")} || ' ' || (doc_id % 7 + 4) END || ' café ' || source AS title,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Sum ' || source || chr(10) || 'two & ' || doc_id END AS summary,
  'https://h.example/b/' || doc_id || '.mp3' AS link, 'Mon, 09 Mar 2026 00:00:00 +0000' AS pub_date
FROM d
"""


def _written_feeds(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A source feed for each language, as RSS documents."""
    n, i = F.col("doc_id"), F.col("doc_id") % 6
    verse = F.concat((n % 9 + 1).cast("string"), F.lit(","), (n % 7 + 1).cast("string"))
    spoken = F.when(n % 4 == 0, verse).otherwise(F.concat(verse, F.lit("-"), (n % 7 + 4).cast("string")))
    ledger = table(spark, sf_dir, "documents").select(
        _pick(LANGS, i).alias("channel"), n.alias("seq"), F.concat(F.lit("Cfr. Mt. "), spoken, F.lit(" caf&eacute; "), "source").alias("title"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("<p>Sum "), "source", F.lit("</p><p>two &amp; "), n.cast("string"), F.lit("</p>"))).alias("description"),
        F.concat(F.lit("https://h.example/b/"), n.cast("string"), F.lit(".mp3")).alias("audio_url"),
        F.lit("Mon, 09 Mar 2026 00:00:00 +0000").alias("pub_date"), F.lit("g").alias("guid"), F.lit(0).cast("bigint").alias("duration"), F.lit(5).cast("bigint").alias("file_size"),
    )
    info = F.struct(*[F.lit("x").alias(c) for c in ("title", "author", "website", "description", "cover_art", "rss_url")])
    channels = spark.createDataFrame([(c, c, None) for c in LANGS], "channel string, language string, email string").withColumn("podcast_info", info)
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    X.write_feeds(X.feed_documents(ledger, channels), path)
    return path


def _feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = feeds.read_feeds(spark, _written_feeds(spark, sf_dir, "source-feeds"))
    channel = F.regexp_extract("feed", "channel=([a-z]+)", 1)
    return feeds.entries(items.select(
        F.concat(F.lit(f"{SITE}/"), channel, F.lit("/rss.xml")).alias("feed"), "pos", "title", F.col("itunes:summary").alias("summary"), "description",
        "link", F.col("pubDate").alias("published"),
    ))


@query(_FEED)
def feed_entries(spark, sf_dir):
    """Feeds read in document order, titles spoken in the feed's language."""
    return _feed_entries(spark, sf_dir).select("lang", "pos", "title", "summary", "link", "pub_date")


@query(f"""
WITH e AS ({_FEED}), h AS (SELECT * FROM e WHERE pos % 3 = 2),
fresh AS (SELECT e.* FROM e WHERE lower(title) NOT IN (SELECT lower(title) FROM h WHERE h.lang = e.lang)),
ranked AS (SELECT lang AS channel, title, CASE WHEN summary = '' THEN title ELSE summary END AS description, link AS guid, pub_date, pos, true AS isnew FROM fresh
  UNION ALL SELECT lang, title, summary, 'old-' || pos, pub_date, pos, false FROM h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY isnew, CASE WHEN isnew THEN -pos ELSE 1000 - pos END) AS k, count(*) OVER (PARTITION BY channel) AS n FROM ranked)
SELECT channel, CASE WHEN isnew THEN k ELSE 1000 - pos END AS seq0, title, description, guid, pub_date FROM (
  SELECT * REPLACE (CASE WHEN isnew THEN 1000 - (SELECT min(pos) FROM h WHERE h.lang = channel) + k - (SELECT count(*) FROM h WHERE h.lang = channel) ELSE k END AS k),
         row_number() OVER (PARTITION BY channel ORDER BY k DESC) AS place FROM numbered)
WHERE place <= 60
""")
def publish_all(spark, sf_dir):
    """A run over all feeds: what the ledgers lack is appended, oldest first, and the newest 60 stay."""
    entries = _feed_entries(spark, sf_dir).withColumn("channel", F.col("lang")).withColumn("audio_url", F.concat(F.lit("https://a.example/"), "lang"))
    old = entries.where("pos % 3 = 2").select(
        "channel", (1000 - F.col("pos")).cast("bigint").alias("seq"), "title", F.col("summary").alias("description"), "audio_url", "pub_date",
        F.concat(F.lit("old-"), F.col("pos").cast("string")).alias("guid"), F.lit(0).cast("bigint").alias("duration"), F.lit(0).cast("bigint").alias("file_size"),
    )
    done = R.publish_feed(entries, old, F.lit("2026-03-09 06:00:00").cast("timestamp"), F.lit(SITE), keep=60)
    return done.select("channel", F.col("seq").alias("seq0"), "title", "description", "guid", "pub_date")


def _detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    static = lambda head, body: F.concat(F.lit(f'<section class="section--isStatic x"><div class="section__head"><h2>{head}</h2></div>'), body, F.lit("</section>"))
    first = static("Vita", F.concat(F.lit('<div class="section__wrapper"><p>Citt&agrave; numero '), n, F.lit(", una vita lunga e piena di opere buone e di parole giuste.</p></div>")))
    menu = static("Cerca", F.lit(f'<div class="section__wrapper"><p>{"menu " * 30}</p></div>'))
    short = static("Oggi", F.lit('<div class="section__wrapper"><p>&Egrave; breve, e con riferimenti &agrave;&agrave;&agrave;&agrave;&agrave;.</p></div>'))
    second = static("Opere", F.concat(F.lit("<div>  </div><div><p>Fond&ograve; "), n, F.lit(" case per i poveri<br>e scuole per i bambini della sua citt&agrave; natale.</p></div>")))
    paragraphs = F.concat(
        F.lit("<body><p>Nacque nell&rsquo;anno "), n, F.lit(" in una casa povera, ma in una citt&agrave; ricca di <b>chiese</b>.</p><p>breve</p>"),
        F.lit("<p>Si veda http://s.example/x, che &egrave; lungo abbastanza per contare come un paragrafo vero.</p><p>Mor&igrave; vecchio e amato da tutti i suoi concittadini, lo stesso giorno.</p></body>"),
    )
    html = F.when(F.col("page_id") % 3 == 2, paragraphs).when(F.col("page_id") % 3 == 1, F.concat(first, menu, short)).otherwise(F.concat(menu, first, second))
    return pages.with_elements(spread(table(spark, sf_dir, "pages")).select("page_id", html.alias("html")))


_DETAIL = """
WITH p AS (SELECT page_id, 'Città numero ' || page_id || ', una vita lunga e piena di opere buone e di parole giuste.' AS a,
  'Fondò ' || page_id || ' case per i poveri' || chr(10) || 'e scuole per i bambini della sua città natale.' AS b,
  'Nacque nell’anno ' || page_id || ' in una casa povera, ma in una città ricca di chiese .' AS c FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 2 THEN c || chr(10) || 'Morì vecchio e amato da tutti i suoi concittadini, lo stesso giorno.'
  WHEN 1 THEN a ELSE a || chr(10) || chr(10) || b END AS text FROM p
"""


@query(_DETAIL)
def saint_detail(spark, sf_dir):
    """The text of detail pages with sections, with menus and short sections between, and without any section."""
    return pages.detail_texts(_detail_pages(spark, sf_dir)).select("page_id", "text")


def _day_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a day in six languages, some with one reading, some without a comment, some without anything."""
    n, i = F.col("page_id"), F.col("page_id") % 6
    number = n.cast("string")
    label = lambda k: _pick([_LABELS[c][k] for c in LANGS], i)
    head = lambda k: _pick([dims.DAY_PAGES[c][k] for c in LANGS], i)
    line = lambda *x: F.concat(F.lit("<p>"), *x, F.lit("</p>"))
    section = lambda k, *x: F.concat(
        F.lit('<section class="section--isStatic"><div class="section__head"><h2>'), F.when(n % 2 == 0, head(k)).otherwise(F.lower(head(k))),
        F.lit('</h2></div><div class="section__wrapper">'), *x, F.lit("</div></section>"),
    )
    second = F.when(n % 4 < 2, F.concat(line(label(2)), line(F.lit("Testo secondo "), number, F.lit(".")))).otherwise("")
    reading = section(1, line(label(0)), line(F.lit("Testo primo "), number, F.lit(" &egrave; qui.")), line(label(1)), line(F.lit("canto")), second)
    gospel = section(2, line(label(3)), line(label(4), F.lit(" 5,1-12")), line(F.lit("Il testo "), number, F.lit(" disse <b>ora</b>.")))
    comment = section(3, line(F.lit("Parole "), number, F.lit(".")), line(F.lit("(Papa Francesco, Angelus 5 marzo 2019)")))
    html = F.concat(
        F.lit("<body>"), F.when(n % 5 != 4, F.concat(F.lit('<div class="indicazioneLiturgica">Giorno '), number, F.lit("</div>"))).otherwise(""),
        F.when(n % 7 != 6, F.concat(reading, gospel)).otherwise(""), F.when((n % 3 == 0) & (n % 7 != 6), comment).otherwise(""), F.lit("</body>"),
    )
    day = F.date_add(F.lit("2026-03-01").cast("date"), (n % 28).cast("int"))
    return pages.with_elements(spread(table(spark, sf_dir, "pages")).select("page_id", _pick(LANGS, i).alias("lang"), day.alias("day"), html.alias("html")))


def _day_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.day_episodes(_day_pages(spark, sf_dir), SITE)


_DAY = f"""
WITH p AS (SELECT page_id, page_id % 6 AS i, DATE '2026-03-01' + CAST(page_id % 28 AS INTEGER) AS day FROM pages),
s AS (SELECT page_id, i, day, {_sql_pick(LANGS, "i")} AS lang,
  CASE WHEN page_id % 5 <> 4 THEN 'Giorno ' || page_id ELSE day(day) || ' ' || {_sql_pick([dims.MONTHS[c][2] for c in LANGS], "i")} || ' 2026' END AS title,
  {_sql_pick([_LABELS[c][0] for c in LANGS], "i")} || chr(10) || 'Testo primo ' || page_id || ' è qui.' AS a,
  CASE WHEN page_id % 4 < 2 THEN {_sql_pick([_LABELS[c][2] for c in LANGS], "i")} || chr(10) || 'Testo secondo ' || page_id || '.' END AS b,
  {_sql_pick([_LABELS[c][3] for c in LANGS], "i")} || chr(10) || 'Il testo ' || page_id || ' disse ora .' AS c,
  CASE WHEN page_id % 3 = 0 THEN '__POPE__ ' || {_sql_pick([dims.COMMENT_LABELS[c][0] for c in LANGS], "i")} || ' Papa Francesco, Angelus 5 marzo 2019.' || chr(10) || 'Parole ' || page_id || '.' END AS d,
  'https://s.example/' || {_sql_pick(LANGS, "i")} || '/' || {_sql_pick([dims.DAY_PAGES[c][0] for c in LANGS], "i")} || '/' || strftime(day, '%Y/%m/%d') || '.html' AS guid
  FROM p)
SELECT page_id, lang, day, title, guid, strftime(day, '%a, %d %b %Y 00:00:00 +0000') AS pub_date,
  CASE WHEN page_id % 7 = 6 THEN '' ELSE concat_ws('|', a, b, replace(c, ' .', '.'), d) END AS segments FROM s
"""


@query(_DAY)
def day_episodes(spark, sf_dir):
    """Day pages to episodes: title, readings without the psalm, gospel and comment."""
    return _day_episodes(spark, sf_dir).withColumn("segments", F.array_join("segments", "|"))


_CHANNELS = [("it", "b-it", "p/it"), ("en", "b-en", "p/en"), ("es", "b-es", "p/es"), ("fr", "b-fr", "p/fr"), ("pt", "b-pt", "p/pt")]
_RUN = f"""
WITH e AS ({_DAY}),
f AS (SELECT *, lang AS channel, 'p/' || lang || '/podcast_audio/' || strftime(day, '%Y%m%d') || '_' || lang || '_' || regexp_replace(replace(title, ' ', '-'), '[^a-zA-Z0-9-]', '', 'g') || '.mp3' AS path FROM e),
r AS (SELECT *, CASE WHEN segments = '' THEN 'FAIL:no content' WHEN page_id % 10 = 3 AND page_id % 11 <> 5 THEN 'SKIP:known' WHEN lang = 'de' THEN 'FAIL:no target' ELSE 'OK' END AS status FROM f)
"""


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What became of each day's episode, and the ledger before: every tenth page is published already, some forced anew."""
    # a guid of its own for each page, which stands for a day
    made = _day_episodes(spark, sf_dir).withColumn("guid", F.concat("guid", F.lit("#"), F.col("page_id").cast("string")))
    rows = made.withColumns({"channel": F.col("lang"), "title": F.concat("title", F.lit(""))})
    channels = spark.createDataFrame(_CHANNELS, "channel string, bucket_name string, storage_prefix string")
    placed = R.uploads(rows, channels, "h.example")
    ledger = placed.where("page_id % 10 = 3").select(
        "channel", (1000 - F.col("page_id")).cast("bigint").alias("seq"), F.concat(F.lit("t-"), F.col("page_id").cast("string")).alias("title"), F.lit("").alias("description"),
        F.lit("https://h.example/b/x.mp3").alias("audio_url"), "pub_date", "guid", F.lit(0).cast("bigint").alias("duration"), F.lit(0).cast("bigint").alias("file_size"),
    )
    return R.outcomes(placed, ledger, force=F.col("page_id") % 11 == 5), ledger


@query(_RUN + """
SELECT page_id, status, CASE WHEN status = 'FAIL:no content' THEN 404 WHEN status = 'FAIL:no target' THEN 500 ELSE 200 END AS code,
  CASE WHEN lang <> 'de' THEN path END AS target, CASE WHEN lang <> 'de' THEN 'https://h.example/b-' || lang || '/' || path END AS audio_url FROM r
""")
def publish_day(spark, sf_dir):
    """What a run over all days and languages does with each episode, and where its sound goes."""
    return _run(spark, sf_dir)[0].select("page_id", "status", "code", "target", "audio_url")


@query(_RUN + """
SELECT channel, CAST(count(*) FILTER (WHERE status = 'OK') AS BIGINT) AS published,
  coalesce(string_agg(title || ': ' || substr(status, 6), '; ' ORDER BY title, substr(status, 6)) FILTER (WHERE status LIKE 'FAIL%'), '') AS errors FROM r GROUP BY channel
""")
def run_errors(spark, sf_dir):
    found = R.run_errors(_run(spark, sf_dir)[0], ["channel"])
    return found.select("channel", "published", F.array_join(F.transform("errors", lambda e: F.concat_ws(": ", e["title"], e["error"])), "; ").alias("errors"))


@query(_RUN + """,
o AS (SELECT channel, 1000 - page_id AS seq, 't-' || page_id AS title, guid || '#' || page_id AS guid FROM r WHERE page_id % 10 = 3),
n AS (SELECT channel, coalesce((SELECT max(seq) FROM o WHERE o.channel = r.channel), 0) AS top, count(*) AS n FROM r WHERE status = 'OK' GROUP BY channel)
SELECT channel, CAST(coalesce(top + n, (SELECT max(seq) FROM o WHERE o.channel = c.channel)) AS BIGINT) AS top, CAST(least(20, coalesce(n, 0) + (SELECT count(*) FROM o WHERE o.channel = c.channel)) AS BIGINT) AS n
FROM (SELECT DISTINCT channel FROM r) c LEFT JOIN n USING (channel)
""")
def publish_ledger(spark, sf_dir):
    """The largest seq and the number of rows of each channel's ledger after the run, of which 20 stay."""
    results, ledger = _run(spark, sf_dir)
    after = R.published_ledger(ledger, results.withColumn("description", F.lit(None).cast("string")), F.current_timestamp(), F.lit(SITE), keep=20)
    return after.groupBy("channel").agg(F.max("seq").alias("top"), F.count(F.lit(1)).alias("n"))


def _saint_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.col("page_id"), F.col("page_id") % 6
    number, lang = n.cast("string"), _pick(LANGS, i)
    link = F.concat(F.lit("/"), lang, F.lit("/"), _pick([dims.SAINT_PAGES[c][0] for c in LANGS], i), F.lit("/03/09/s"), number, F.lit(".html"))
    html = F.concat(
        F.lit('<body><section class="section--isStatic"><div class="section__head"><h2>SANTO '), number, F.lit('</h2></div><div class="section__wrapper"><p>Breve &egrave; '), number,
        F.lit('.</p></div></section><section><div class="section__head"><h2>Beato '), number, F.lit('</h2></div><div class="section__wrapper">'),
        F.when(n % 2 == 0, F.concat(F.lit('<a class="saintReadMore" href="'), link, F.lit('">Leggi</a>'))).otherwise(""), F.lit("</div></section><h2>Menu</h2></body>"),
    )
    day = F.date_add(F.lit("2026-03-01").cast("date"), (n % 28).cast("int"))
    return pages.with_elements(spread(table(spark, sf_dir, "pages")).select("page_id", lang.alias("lang"), day.alias("day"), html.alias("html"), F.concat(F.lit(SITE), link).alias("url")))


@query(f"""
WITH p AS (SELECT page_id, page_id % 6 AS i, DATE '2026-03-01' + CAST(page_id % 28 AS INTEGER) AS day FROM pages),
s AS (SELECT page_id, day, {_sql_pick(LANGS, "i")} AS lang, {_sql_pick([dims.SAINT_PAGES[c][1] for c in LANGS], "i")} AS head, {_sql_pick([dims.MONTHS[c][2] for c in LANGS], "i")} AS m,
  {_sql_pick([dims.SAINT_PAGES[c][2].split("{name}")[0] for c in LANGS], "i")} || 'Beato ' || page_id || '.' AS told FROM p)
SELECT page_id, head || ' - ' || CASE WHEN lang = 'en' THEN m || ' ' || day(day) || ', 2026' WHEN lang = 'de' THEN day(day) || '. ' || m || ' 2026'
  WHEN lang IN ('es', 'pt') THEN day(day) || ' de ' || m || ' de 2026' ELSE day(day) || ' ' || m || ' 2026' END AS title,
  'Santo ' || page_id || chr(10) || 'Breve è ' || page_id || '.|Beato ' || page_id || chr(10) || CASE WHEN page_id % 4 = 0 THEN 'La vita di ' || page_id || ', in breve.' WHEN page_id % 2 = 0 THEN 'Leggi' ELSE told END AS segments,
  'saint-' || lang || '-' || strftime(day, '%Y-%m-%d') AS guid FROM s
""")
def saint_episodes(spark, sf_dir):
    """Saint pages to episodes: the life from the detail page, the brief text, or a sentence with the name."""
    rows = _saint_pages(spark, sf_dir)
    details = rows.where("page_id % 4 = 0").select("url", F.concat(F.lit("La vita di "), F.col("page_id").cast("string"), F.lit(" , in breve.")).alias("text"))
    return R.saint_episodes(rows, details, SITE).select("page_id", "title", F.array_join("segments", "|").alias("segments"), "guid")


@query(f"""
WITH e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k, conv_id % 6 AS i FROM conversations),
t AS (SELECT conv_id, 0 AS k, 'Titolo ' || conv_id AS x FROM conversations GROUP BY conv_id UNION ALL
  SELECT conv_id, k, 'Testo ' || turn || '. disse, ' || {_sql_pick(_NAMES, "i")} || ' ' || (turn + 1) || ' 2 fine.' FROM e)
SELECT conv_id, CAST(2 * k AS INTEGER) AS part_no, 'speech' AS kind, x AS payload FROM t UNION ALL SELECT conv_id, CAST(2 * k - 1 AS INTEGER), 'silence', '3' FROM t WHERE k > 0
""")
def plain_voice_plan(spark, sf_dir):
    """What voices without markup say, in six languages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role").alias("s"))
    ordered = F.sort_array(F.collect_list("s"))
    text = lambda s: F.concat(F.lit("<b>Testo "), s["turn"].cast("string"), F.lit("</b>\n\ndisse: Mt "), (s["turn"] + 1).cast("string"), F.lit(",2 fine."))
    grouped = rows.groupBy("conv_id").agg(F.transform(ordered, text).alias("segments"))
    episodes = grouped.select(
        F.col("conv_id").alias("episode_id"), F.concat(F.lit("Titolo "), F.col("conv_id").cast("string")).alias("title"), F.lit("").alias("text"), "segments",
        _pick(LANGS, F.col("conv_id") % 6).alias("lang"),
    )
    plan = _by_lang(episodes, lambda part, c: R.plain_voice_plan(part, c, 3))
    return plan.select(F.col("episode_id").alias("conv_id"), "part_no", "kind", "payload")


@query(f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS i FROM orders)
SELECT o_orderkey, 'https://s.example/' || {_sql_pick(LANGS, "i")} || '/' || {_sql_pick([dims.DAY_PAGES[c][0] for c in LANGS], "i")} || '/' || strftime(d, '%Y/%m/%d') || '.html' AS day_page,
  'https://s.example/' || {_sql_pick(LANGS, "i")} || '/' || {_sql_pick([dims.SAINT_PAGES[c][0] for c in LANGS], "i")} || '/' || strftime(d, '%m/%d') || '.html' AS saint_page FROM o
""")
def page_addresses(spark, sf_dir):
    lang, day = _pick(LANGS, F.col("o_orderkey") % 6), F.col("o_orderdate").cast("date")
    found = table(spark, sf_dir, "orders")
    return found.select("o_orderkey", pages.day_address(lang, day, SITE).alias("day_page"), pages.saint_address(lang, day, SITE).alias("saint_page"))


@query(r"""
SELECT page_id, replace(replace(replace(url, '%', '%25'), ':', '%3A'), ' ', '%20') AS name FROM (SELECT page_id, 'a b:' || page_id || '/50%/' || regexp_extract(url, '^[a-z]+', 0) AS url FROM pages)
""")
def file_names(spark, sf_dir):
    made = F.concat(F.lit("a b:"), F.col("page_id").cast("string"), F.lit("/50%/"), F.regexp_extract("url", "^[a-z]+", 0))
    return table(spark, sf_dir, "pages").select("page_id", T.file_name(made).alias("name"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN upper(substr(p, 1, 1)) || lower(substr(p, 2)) || ' D''Arc-' || upper(substr(p, 1, 1)) || lower(substr(p, 2)) || ' 2B' ELSE p || ' d''arc-X 2b' END AS title
FROM (SELECT o_orderkey, lower(regexp_extract(o_orderpriority, '[A-Z]+', 0)) AS p FROM orders)
""")
def title_cases(spark, sf_dir):
    word = F.lower(F.regexp_extract("o_orderpriority", "[A-Z]+", 0))
    capitals = F.upper(F.concat(word, F.lit(" d'arc-"), word, F.lit(" 2b")))
    made = F.when(F.col("o_orderkey") % 3 == 0, capitals).otherwise(F.concat(word, F.lit(" d'arc-X 2b")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.title_case(made).alias("title"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_linenumber * 3600 + (CAST(l_quantity AS INTEGER)) * 60 + l_orderkey % 60 END AS seconds,
  l_linenumber % 3 <> 2 AS force, trim(l_returnflag || ' & ' || l_linestatus || ' , e') AS plain FROM lineitem
""")
def small_values(spark, sf_dir):
    """Durations from logs, force flags, and markup to plain text."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    n = F.col("l_linenumber")
    log = F.concat(F.lit("Input\n  Duration: "), two(n), F.lit(":"), two(F.col("l_quantity").cast("int")), F.lit(":"), two(F.col("l_orderkey") % 60), F.lit(".93, start: 0"))
    flag = _pick((" ", "TRUE", "no"), n % 3)
    flag = F.when(n % 3 == 0, "Yes").otherwise(flag)
    shown = F.concat(F.lit("<p>"), "l_returnflag", F.lit(" &amp;<br> "), "l_linestatus", F.lit("__QSTART__ __PAUSE__ e</p>"))
    return spread(table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_linenumber", T.duration_seconds(F.when(n % 4 == 0, F.lit("none")).otherwise(log)).cast("bigint").alias("seconds"),
        T.forced(flag).alias("force"), T.strip_markup(shown).alias("plain"),
    )


@query(f"""
WITH p AS (SELECT page_id, page_id % 6 AS i, page_id % 4 AS k FROM pages)
SELECT page_id, k < 2 AS saint, k <> 3 AS bare FROM p
""")
def link_and_reference_tests(spark, sf_dir):
    """Which links lead to saints, and which lines are nothing but references, by language."""
    n = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", _pick(LANGS, n % 6).alias("lang"), (n % 4).alias("k"))
    slug = _pick([dims.SAINT_PAGES[c][0] for c in LANGS], n % 6)
    href = F.concat(F.lit("/"), "lang", F.lit("/"), slug, _pick(("/03/09/a.html", "/12/31/b-c.html", "/3/09/a.html", "/03/09/.html"), F.col("k")))
    line = _pick(("Mt 5,1-12", "2Re 5,1-15a", "12, 3-4", "Gesù disse ai suoi: Andate"), F.col("k"))
    return _by_lang(
        rows.withColumns({"href": href, "line": line}),
        lambda part, c: part.select("page_id", T.is_saint_link(F.col("href"), c).alias("saint"), S.is_bare_reference(F.col("line"), c).alias("bare")),
    )


@query("""
SELECT conv_id, turn, role || ' a' AS before, CASE WHEN turn % 2 = 0 THEN 'Salmo ' || turn || ' b' ELSE '' END AS after FROM conversations
""")
def cut_texts(spark, sf_dir):
    made = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(" a\nSalmo "), F.col("turn").cast("string"), F.lit(" b"))).otherwise(F.concat("role", F.lit(" a ")))
    cut = S.cut_at(made, r"salmo\s+\d")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cut["before"].alias("before"), cut["from"].alias("after"))


@query("""
SELECT conv_id, turn, '<speak><emphasis level="strong">T</emphasis><break time="2.5s"/><emphasis level="moderate">' || role || '</emphasis><break time="1.0s"/><phoneme alphabet="ipa" ph="dʒeˈzu">Gesù</phoneme> ' || turn || '.</speak>' AS markup
FROM conversations
""")
def italian_markup(spark, sf_dir):
    """A whole episode's markup, names with their sounds."""
    segments = F.array(F.concat("role", F.lit("\nGesù "), F.col("turn").cast("string"), F.lit(".")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", M.episode_markup(F.lit("T"), segments, "it").alias("markup"))


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 6 AS i, doc_id % 3 AS k FROM documents)
SELECT doc_id, {_sql_pick([_LABELS[c][0] for c in LANGS], "i")} || ' Testo primo ' || doc_id || '.' ||
    CASE WHEN k = 1 THEN ' ' || {_sql_pick([_LABELS[c][1] for c in LANGS], "i")} || ' canto ' || doc_id || '.' ELSE '' END AS first,
  CASE WHEN k = 1 THEN {_sql_pick([_LABELS[c][2] for c in LANGS], "i")} || ' Testo secondo ' || doc_id || '.' END AS second,
  {_sql_pick([_LABELS[c][3] for c in LANGS], "i")} || ' Il testo ' || doc_id || ' disse ora.' AS gospel, CASE WHEN k = 1 THEN 'section,section,section' ELSE 'section,section' END AS kinds FROM d
""")
def flat_segments(spark, sf_dir):
    """Sections of texts in one paragraph, by the places of their marks, in six languages.

    A first reading that a second one follows ends there, whatever stands between.
    """
    n, i = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    label = lambda k: _pick([_LABELS[c][k] for c in LANGS], i)
    second = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), label(2), F.lit(" Testo secondo "), n, F.lit("."))).otherwise("")
    text = F.concat(
        F.lit("<p>"), label(0), F.lit(" Testo primo "), n, F.lit(". "), label(1), F.lit(" canto "), n, F.lit("."), second, F.lit(" "), label(3), F.lit(" Il testo "), n, F.lit(" disse ora.</p>")
    )
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", _pick(LANGS, i).alias("lang"), text.alias("description"))
    s = F.col("segments")
    found = S.segment(rows).select("doc_id", s)
    return found.select(
        "doc_id", F.get(s, F.lit(0))["text"].alias("first"), F.when(F.size(s) == 3, F.get(s, F.lit(1))["text"]).alias("second"),
        F.get(s, F.size(s) - 1)["text"].alias("gospel"), F.array_join(F.transform(s, lambda x: x["kind"]), ",").alias("kinds"),
    )


@query("""
SELECT n_nationkey, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom">' || chr(10)
  || '<channel>' || chr(10) || '<title>' || n_name || ' &amp; co</title>' || chr(10) || '<description>About &lt;' || n_nationkey || '&gt;</description>' || chr(10) || '<link>https://s.example/' || n_nationkey || '</link>' || chr(10)
  || '<language>it</language>' || chr(10) || '<itunes:author>A</itunes:author>' || chr(10) || '<itunes:summary>About &lt;' || n_nationkey || '&gt;</itunes:summary>' || chr(10) || '<itunes:explicit>no</itunes:explicit>' || chr(10)
  || '<itunes:category text="Religion &amp; Spirituality"/>' || chr(10)
  || CASE WHEN n_nationkey % 2 = 0 THEN '<itunes:owner>' || chr(10) || '<itunes:name>A</itunes:name>' || chr(10) || '<itunes:email>m@s.example</itunes:email>' || chr(10) || '</itunes:owner>' || chr(10) || '<managingEditor>m@s.example</managingEditor>' || chr(10) ELSE '' END
  || CASE WHEN n_nationkey % 3 = 0 THEN '<itunes:image href="https://s.example/i.png"/>' || chr(10) || '<image>' || chr(10) || '<url>https://s.example/i.png</url>' || chr(10) || '<title>' || n_name || ' &amp; co</title>' || chr(10) || '<link>https://s.example/' || n_nationkey || '</link>' || chr(10) || '</image>' || chr(10) ELSE '' END
  || CASE WHEN n_nationkey % 5 = 0 THEN '<atom:link href="https://s.example/f.xml" rel="self" type="application/rss+xml"/>' || chr(10) ELSE '' END
  || '</channel>' || chr(10) || '</rss>' || chr(10) AS rss FROM nation
""")
def feed_headers(spark, sf_dir):
    """The documents of channels without episodes: owner, image and address only where configured."""
    n = F.col("n_nationkey")
    number = n.cast("string")
    info = F.struct(
        F.concat("n_name", F.lit(" & co")).alias("title"), F.lit("A").alias("author"), F.concat(F.lit(f"{SITE}/"), number).alias("website"),
        F.concat(F.lit("About <"), number, F.lit(">")).alias("description"), F.when(n % 3 == 0, f"{SITE}/i.png").alias("cover_art"), F.when(n % 5 == 0, f"{SITE}/f.xml").alias("rss_url"),
    )
    channels = table(spark, sf_dir, "nation").select(number.alias("channel"), F.lit("it").alias("language"), F.when(n % 2 == 0, "m@s.example").alias("email"), info.alias("podcast_info"))
    none = spark.createDataFrame([], "channel string, seq long, title string, description string, audio_url string, pub_date string, guid string, duration long, file_size long")
    return X.feed_documents(none, channels).select(F.col("channel").cast("int").alias("n_nationkey"), "rss")
