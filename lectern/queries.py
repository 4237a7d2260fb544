"""Queries over the given tables, one for each operator, with the SQL that DuckDB is to agree with.

The tables hold none of the texts that the operators are made for, so inputs
are put together from their columns, in the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dims
from lectern.functions import text as T
from lectern.operators import ledger as L
from lectern.operators import segments as S
from lectern.plans import batch as B
from lectern.plans import feed_xml as X
from lectern.plans import markup as M
from lectern.registry import QUERIES, SQL, query
from lectern.sources import feeds, pages
from lectern.storage import spread, table

def _first_line() -> Column:
    return F.substring_index("text", "\n", 1)


_TITLE = "split_part(text, chr(10), 1)"
_KEY = rf"trim(regexp_replace({_TITLE}, '\s+', ' ', 'g'))"


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entries, history): every fifth document is history, some entries link to one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", _first_line().alias("title"))
    link = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("doc-"), (F.col("doc_id") - F.col("doc_id") % 5).cast("string")))
    guid = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    history = docs.where("doc_id % 5 = 0").select("lang", "title", guid.alias("guid"))
    return docs.where("doc_id % 5 <> 0").withColumn("link", F.coalesce(link, F.lit(""))), history


_ENTRIES = f"""
WITH d AS (SELECT doc_id, lang, lower({_KEY}) AS k FROM documents),
history AS (SELECT k, 'doc-' || doc_id AS guid FROM d WHERE doc_id % 5 = 0),
entries AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'doc-' || (doc_id - doc_id % 5) END AS link FROM d WHERE doc_id % 5 <> 0),
seen AS (SELECT doc_id, lang, k IN (SELECT k FROM history) OR coalesce(link IN (SELECT guid FROM history), false) AS known FROM entries)
"""


@query(_ENTRIES + "SELECT doc_id, lang FROM seen WHERE NOT known")
def new_entries_anti(spark, sf_dir):
    return L.new_entries(*_entries(spark, sf_dir)).select("doc_id", "lang")


@query(_ENTRIES + "SELECT doc_id, known AND doc_id % 13 <> 0 AS skipped FROM seen")
def idempotent_flag(spark, sf_dir):
    entries, history = _entries(spark, sf_dir)
    return L.with_known(entries, history, force=F.col("doc_id") % 13 == 0).select("doc_id", "skipped")


@query("""
WITH g AS (SELECT event_id, 'saint-' || event_type || '-' || strftime(ts + to_days(CAST(event_id % 400 AS INTEGER)), '%Y-%m-%d') AS guid FROM events)
SELECT event_id FROM g WHERE event_id % 3 <> 0 AND guid NOT IN (SELECT guid FROM g WHERE event_id % 3 = 0)
""")
def saint_guid_check(spark, sf_dir):
    day = F.date_add(F.to_date("ts"), (F.col("event_id") % 400).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", L.saint_guid(F.col("event_type"), day).alias("guid"))
    # the shift is made on the moment in SQL and on its day here: the same day
    return L.missing_guids(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0")).select("event_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) <= 180 AS kept FROM documents")
def retain_top_n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("channel"), F.col("doc_id").alias("seq"))
    return L.retained(docs).select("doc_id", "kept")


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) AS path, page_id % 7 AS c FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY page_id DESC) AS k FROM p)
SELECT page_id, regexp_extract(path, '^/+[^/]+/(.*)$', 1) AS path FROM r
WHERE k > 3 AND regexp_extract(path, '^/+[^/]+/(.*)$', 1) <> ''
""")
def expired_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 7).alias("channel"), F.col("page_id").alias("seq"), F.col("url").alias("audio_url")
    )
    return L.expired_files(rows, 3).select(F.col("seq").alias("page_id"), "path")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS seq FROM documents")
def publish_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("channel"), F.col("doc_id").alias("pos"))
    return L.publish_order(docs).select("doc_id", "seq")


@query("""
WITH top AS (SELECT lang, max(doc_id) AS top FROM documents WHERE doc_id % 2 = 0 GROUP BY lang)
SELECT d.doc_id, top + row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id DESC) AS seq,
       CASE WHEN d.doc_id % 3 = 0 THEN 'Mon, 09 Mar 2026 06:00:00 GMT' ELSE 'given' END AS pub_date
FROM documents d JOIN top USING (lang) WHERE d.doc_id % 2 = 1
""")
def append_episodes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("channel"))
    given = F.when(F.col("doc_id") % 3 == 0, "").otherwise("given").alias("pub_date")
    rows = docs.select("doc_id", "channel", F.col("doc_id").alias("seq"), given, F.lit("g").alias("guid"))
    old, new = rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1").withColumn("pos", F.col("doc_id"))
    done = L.append(old, new, F.lit("2026-03-09 06:00:00").cast("timestamp"), F.lit("https://site.example"))
    return done.where("doc_id % 2 = 1").select("doc_id", "seq", "pub_date")


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def latest_per_feed(spark, sf_dir):
    return feeds.latest(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def top_k_by_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)


@query(f"SELECT lang, count(DISTINCT lower(trim({_TITLE}))) AS n FROM documents GROUP BY lang")
def title_key_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct(T.title_key(_first_line())).alias("n"))


@query("""
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS first FROM orders), t AS (SELECT (max(o_orderdate)::DATE - 40)::DATE AS today FROM orders),
d AS (SELECT unnest(range(first, least(last_day(first), today)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS date FROM m, t)
SELECT date, l.lang, l.pos::INTEGER AS lang_pos, (SELECT count(*) FROM orders WHERE o_orderdate::DATE = date) AS n_orders FROM d,
(VALUES (0, 'de'), (1, 'fr'), (2, 'en'), (3, 'it'), (4, 'pt'), (5, 'es')) l(pos, lang)
""")
def date_lang_grid(spark, sf_dir):
    """Every day of the months of the orders, up to a day, with every language, and what was ordered on it."""
    day = F.to_date("o_orderdate")
    orders = table(spark, sf_dir, "orders").groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("n_orders"))
    months = orders.select(F.year("date").alias("year"), F.month("date").alias("month")).distinct()
    today = orders.agg(F.date_sub(F.max("date"), 40)).first()[0]
    days = B.days_of_months(months, F.lit(today)).select("date").join(orders, "date", "left")
    return B.grid(days.select("date", F.coalesce("n_orders", F.lit(0)).alias("n_orders")))


_STATUS = "CASE event_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'SKIP:known' WHEN 2 THEN 'FAIL:x' ELSE 'OK again' END"


@query(f"""
SELECT event_type, count(*) FILTER (WHERE s LIKE 'OK%') AS n_ok, count(*) FILTER (WHERE s LIKE 'SKIP%') AS n_skip,
       count(*) FILTER (WHERE s LIKE 'FAIL%') AS n_fail
FROM (SELECT event_type, {_STATUS} AS s FROM events) GROUP BY event_type
""")
def status_rollup(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_type", F.expr(_STATUS).alias("status"))
    return B.status_rollup(runs, ["event_type"])


@query("SELECT user_id, CASE WHEN bool_and(event_id % 50 <> 7) THEN 200 ELSE 207 END AS status FROM events GROUP BY user_id")
def overall_status(spark, sf_dir):
    code = F.when(F.col("event_id") % 50 == 7, 500).otherwise(200)
    return B.overall_status(table(spark, sf_dir, "events").select("user_id", code.alias("code")), ["user_id"])


@query("""
WITH v AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'All' ELSE ' IT ,,' || n_name || ', de' END AS v FROM nation)
SELECT n_nationkey, CASE WHEN lower(v) = 'all' THEN 'de,en,es,fr,it,pt' ELSE 'it,' || lower(trim(split_part(v, ',', 3))) || ',de' END AS langs,
       CASE WHEN lower(v) = 'all' THEN 0 ELSE 1 END AS n_unknown FROM v
""")
def parse_langs(spark, sf_dir):
    value = F.when(F.col("n_nationkey") % 4 == 0, "All").otherwise(F.concat(F.lit(" IT ,,"), "n_name", F.lit(", de")))
    found = B.parsed_languages(value)
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.array_join(found["langs"], ",").alias("langs"), F.size(found["unknown"]).alias("n_unknown")
    )


@query("""
SELECT page_id, CASE WHEN contains(u, '/it/') THEN 'it' WHEN contains(u, '/en/') THEN 'en' WHEN contains(u, '/es/') THEN 'es'
  WHEN contains(u, '/fr/') THEN 'fr' WHEN contains(u, '/pt/') THEN 'pt' WHEN contains(u, '/de/') THEN 'de' END AS lang
FROM (SELECT page_id, lower(url) AS u FROM pages)
""")
def lang_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.detect_language(None, F.col("url")).alias("lang"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'edge' ELSE 'google' END AS provider, lang,
  CASE WHEN doc_id % 2 = 0 THEN CASE lang WHEN 'en' THEN 'en-US-GuyNeural' WHEN 'de' THEN 'de-DE-ConradNeural' WHEN 'fr' THEN 'fr-FR-HenriNeural' ELSE 'es-ES-AlvaroNeural' END
       ELSE CASE lang WHEN 'en' THEN 'en-US-Neural2-D' WHEN 'de' THEN 'de-DE-Neural2-B' WHEN 'fr' THEN 'fr-FR-Neural2-B' ELSE 'es-ES-Neural2-B' END END AS voice_name,
  CASE lang WHEN 'en' THEN 'en-US' WHEN 'de' THEN 'de-DE' WHEN 'fr' THEN 'fr-FR' ELSE 'es-ES' END AS language_code,
  CASE doc_id % 3 WHEN 0 THEN 0.85 WHEN 1 THEN 1.15 ELSE 1.0 END::DOUBLE AS speaking_rate
FROM documents
""")
def voice_lookup(spark, sf_dir):
    provider = F.when(F.col("doc_id") % 2 == 0, "Edge-TTS").otherwise("google")
    speed = F.element_at(F.array(F.lit("slow"), F.lit("fast"), F.lit("?")), (F.col("doc_id") % 3 + 1).cast("int"))
    columns = M.voice_columns(F.col("lang"), provider, speed)
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


@query(f"""
SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'toxic' ELSE d.t END AS title,
  CASE WHEN l.doc_id IS NOT NULL THEN 'page' ELSE 'feed' END AS origin
FROM labels l FULL JOIN (SELECT doc_id, {_TITLE} AS t FROM documents) d ON l.doc_id = d.doc_id
""")
def source_fallback(spark, sf_dir):
    page = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("title"))
    feed = table(spark, sf_dir, "documents").select("doc_id", _first_line().alias("title"))
    return L.prefer_structured(page, feed, ["doc_id"], ["title"])


@query("""
SELECT d.doc_id, d.source || chr(10) || CASE WHEN l.quality = 1 THEN 'good' WHEN d.doc_id % 2 = 0 THEN 'brief' ELSE 'Today ' || d.source || '.' END AS segment
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def detail_fallback(spark, sf_dir):
    saints = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit(0).alias("ord"), F.col("source").alias("name"),
        F.when(F.col("doc_id") % 2 == 0, "brief").otherwise("").alias("brief"), F.col("doc_id").cast("string").alias("detail_url"),
    )
    details = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("url"), F.when(F.col("quality") == 1, "good").otherwise(" ").alias("text")
    )
    found = L.saint_segments(L.saint_lives(saints, details, F.lit("Today {name}.")))
    return found.select(F.col("page_id").alias("doc_id"), F.array_join("segments", "|").alias("segment"))


@query("SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') AS pub_date FROM events")
def rfc822_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.rfc822(F.col("ts")).alias("pub_date"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE date_trunc('second', ts) END AS ts FROM events")
def rfc822_parse(spark, sf_dir):
    text = F.when(F.col("event_id") % 10 == 3, "soon").otherwise(T.rfc822(F.col("ts")))
    return table(spark, sf_dir, "events").select("event_id", T.parse_rfc822(text).cast("timestamp_ntz").alias("ts"))


_MONTHS_SQL = {c: "['" + "','".join(m) + "']" for c, m in dims.MONTHS.items()}


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderdate AS d, ['it','en','fr','es','pt','de'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS lang FROM orders),
m AS (SELECT *, day(d) AS n, year(d) AS y, CASE lang {' '.join(f"WHEN '{c}' THEN ({m})[month(d)]" for c, m in _MONTHS_SQL.items())} END AS mm FROM o)
SELECT o_orderkey, CASE WHEN lang = 'en' THEN mm || ' ' || n || ', ' || y WHEN lang = 'de' THEN n || '. ' || mm || ' ' || y
  WHEN lang IN ('es', 'pt') THEN n || ' de ' || mm || ' de ' || y ELSE n || ' ' || mm || ' ' || y END AS spoken FROM m
""")
def spoken_date(spark, sf_dir):
    langs = F.array(*map(F.lit, ("it", "en", "fr", "es", "pt", "de")))
    lang = F.element_at(langs, (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.spoken_date(F.col("o_orderdate"), lang).alias("spoken"))


@query(r"""
WITH s AS (SELECT doc_id, substr(regexp_replace(regexp_replace(trim(split_part(text, chr(10), 1)), '\s+', '-', 'g'), '[^a-zA-Z0-9\-]', '', 'g'), 1, 60) AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN 'episode' ELSE s END AS slug FROM s
""")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(_first_line(), 60, "episode").alias("slug"))


@query(r"""
WITH a AS (SELECT doc_id, translate(lower('St. ' || split_part(text, chr(10), 1)), 'àáâãåçèéêëìíîïñòóôõøùúûýÿ', 'aaaaaceeeeiiiinooooouuuyy') AS s FROM documents),
b AS (SELECT doc_id, replace(replace(replace(replace(s, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS s FROM a),
c AS (SELECT doc_id, regexp_replace(replace(replace(replace(s, '.', '--'), ',', '--'), ' ', '-'), '[^a-z0-9\-]', '', 'g') AS s FROM b)
SELECT doc_id, trim(regexp_replace(s, '-{3,}', '--', 'g'), '-') AS slug FROM c
""")
def saint_slug(spark, sf_dir):
    name = F.concat(F.lit("St. "), _first_line())
    return table(spark, sf_dir, "documents").select("doc_id", T.name_slug(name).alias("slug"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace('a b ' || text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '\s+', ' ', 'g')) AS clean,
       'x ' || regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g') || ' y' AS legal
FROM documents
""")
def sanitize(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        T.sanitize(F.concat(F.lit("a\x01b😀\t "), F.col("text"))).alias("clean"),
        T.xml_legal(F.concat(F.lit("x\x07"), F.col("text"), F.lit("\x7fy"))).alias("legal"),
    )


@query(r"""
WITH a AS (SELECT p_partkey, p_name || ' ,' || p_size || '.5;;' || p_brand || ' !!' || chr(10) || p_type || '?' AS s FROM part),
b AS (SELECT p_partkey, regexp_replace(s, '\s+([,;:.!?])', '\1', 'g') AS s FROM a),
c AS (SELECT p_partkey, regexp_replace(s, '([,;:.!?])', '\1' || chr(1), 'g') AS s FROM b),
d AS (SELECT p_partkey, replace(regexp_replace(s, chr(1) || '(\s|$)', '\1', 'g'), chr(1), ' ') AS s FROM c),
e AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?:,\s*){2,}', ', ', 'g'),
  ';\s*;{1,}', '; ', 'g'), ':\s*:{1,}', ': ', 'g'), '!\s*!{1,}', '! ', 'g'), '\?\s*\?{1,}', '? ', 'g') AS s FROM d)
SELECT p_partkey, trim(regexp_replace(regexp_replace(s, '\s*\n\s*', ' ', 'g'), '[ \t]+', ' ', 'g')) AS text FROM e
""")
def punct_normalize(spark, sf_dir):
    made = F.concat("p_name", F.lit(" ,"), F.col("p_size").cast("string"), F.lit(".5;;"), "p_brand", F.lit(" !!\n"), "p_type", F.lit("?"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_punctuation(made).alias("text"))


@query("""
SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 3 WHEN 0 THEN l_linenumber || ' ' || q || ' bis ' || (q + 3) WHEN 1 THEN l_linenumber || ' ' || q || ' bis ' || (q + 3)
       ELSE l_linenumber || ' ' || q END || ' x 7' AS text
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
""")
def verse_refs(spark, sf_dir):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    start = F.concat_ws(", ", n.cast("string"), q.cast("string"))
    made = (
        F.when(n % 3 == 0, F.concat(start, F.lit("–"), (q + 3).cast("string")))
        .when(n % 3 == 1, F.concat(start, F.lit("b - "), (q + 3).cast("string")))
        .otherwise(start)
    )
    return spread(table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_linenumber", T.normalize_verses(F.concat(made, F.lit(" x 7c")), "de").alias("text")
    )


@query("""
SELECT p_partkey, 'confronta ' || CASE p_size % 4 WHEN 0 THEN 'Matteo' WHEN 1 THEN 'Prima lettera ai Corinzi' WHEN 2 THEN 'amt' ELSE 'Apocalisse' END || ' ' || p_size || ' ' || p_brand AS text
FROM part
""")
def bible_refs(spark, sf_dir):
    short = F.element_at(F.array(*map(F.lit, ("Mt.", "1 COR", "amt", "ap"))), F.col("p_size") % 4 + 1)
    made = F.concat_ws(" ", F.lit("Cfr."), short, F.col("p_size").cast("string"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.expand_books(T.expand_cross_references(made, "it"), "it").alias("text"))


@query("""
SELECT l_orderkey, l_linenumber, 'Dal libro della Genesi' AS header, 'come dice' || CASE WHEN l_linenumber % 2 = 0 THEN ' oggi' ELSE ' Matteo ' || CAST(l_quantity AS INTEGER) || ' oggi' END AS body
FROM lineitem
""")
def header_strip(spark, sf_dir):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    header = F.concat_ws(" ", F.lit("Dal libro della Genesi"), n.cast("string"), q, F.lit("A"), q)
    body = F.concat_ws(" ", F.lit("come dice Matteo"), q, F.when(n % 2 == 0, n.cast("string")), F.lit("oggi"))
    return spread(table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_linenumber", T.strip_header_verses(header, "it").alias("header"), T.strip_inline_verses(body, "it").alias("body")
    )


@query(f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(dims.NAVIGATION)}') AS navigation FROM documents")
def nav_filter(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.is_navigation(F.col("text")).alias("navigation"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS text, count(*) AS n FROM conversations GROUP BY conv_id")
def conversation_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("s"))
    ordered = F.sort_array(F.collect_list("s"))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("n")
    )


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("s"))
    ordered = F.sort_array(F.collect_list("s"))
    return spread(rows.groupBy("conv_id").agg(F.transform(ordered, lambda s: F.concat_ws("\n", s["role"], s["text"])).alias("segments")))


@query("""
WITH s AS (SELECT conv_id, role || '. ' || text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
p AS (SELECT conv_id, 'T' AS t, 0 AS k FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, t, k FROM s)
SELECT conv_id, CAST(2 * k AS INTEGER) AS part_no, 'speech' AS kind, trim(regexp_replace(regexp_replace(t, '[ \\t]*\\n[ \\t]*(\\s*\\n)*', '. ', 'g'), '\\s+', ' ', 'g')) AS payload FROM p
UNION ALL SELECT conv_id, CAST(2 * k - 1 AS INTEGER), 'silence', '2.5' FROM p WHERE k > 0
""")
def interleave_plan(spark, sf_dir):
    episodes = _conversations(spark, sf_dir).select(F.col("conv_id").alias("episode_id"), F.lit("T").alias("title"), "segments")
    plan = M.synthesis_plan(episodes, "en", "plain")
    return plan.select(F.col("episode_id").alias("conv_id"), "part_no", "kind", "payload")


@query("""
SELECT conv_id, turn, '<emphasis level="moderate">' || replace(replace(replace(replace(replace(role || ' & "x"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</emphasis>' AS heading
FROM conversations
""")
def heading_markup(spark, sf_dir):
    heading = M.section_markup(F.concat("role", F.lit(' & "x"')))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", heading.alias("heading"))


@query()
def episode_plan(spark, sf_dir):
    episodes = _conversations(spark, sf_dir).select(F.col("conv_id").alias("episode_id"), F.lit("T & t").alias("title"), "segments")
    return M.synthesis_plan(episodes, "en")


@query(r"""
WITH RECURSIVE l AS (
  SELECT doc_id, k, trim(regexp_replace(ls[k], '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), ' ' || chr(9) || chr(13)) AS x
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
), e AS (
  SELECT doc_id, k, replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS x FROM l
), p AS (
  SELECT doc_id, k, '<break time="2.5s"/>' || CASE WHEN x = '' THEN '' ELSE '<emphasis level="moderate">' || x || '</emphasis>' END AS x FROM e
  UNION ALL SELECT doc_id, 0, '<emphasis level="strong">T</emphasis>' FROM documents
), b AS (
  SELECT *, coalesce(sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(strlen(x)) OVER (PARTITION BY doc_id))::BIGINT AS total FROM p
), cuts AS (
  SELECT doc_id, 0 AS part_no, 0::BIGINT AS c, 0::BIGINT AS at FROM documents
  UNION ALL
  SELECT doc_id, part_no + 1, n.k, n.before FROM (
    SELECT cuts.doc_id, cuts.part_no, min({'k': b.k, 'before': b.before}) AS n FROM cuts JOIN b ON b.doc_id = cuts.doc_id AND b.k > cuts.c AND 15 + b.before - cuts.at >= 3800 AND 15 + b.total > 4800
    GROUP BY cuts.doc_id, cuts.part_no)
), parts AS (
  SELECT *, coalesce(lead(c) OVER (PARTITION BY doc_id ORDER BY part_no), 1::BIGINT << 40) AS upto FROM cuts
), made AS (
  SELECT q.doc_id, part_no, '<speak>' || string_agg(x, '' ORDER BY k) || '</speak>' AS payload FROM parts q JOIN b ON b.doc_id = q.doc_id AND b.k >= c AND b.k < upto GROUP BY q.doc_id, part_no
)
SELECT doc_id, part_no::INTEGER AS part_no, strlen(payload)::INTEGER AS bytes, sha256(payload) AS sha256 FROM made
""")
def chunk_plan(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("t"), F.split("text", "\n").alias("segments"))
    whole = M.episode_markup(F.lit("T"), F.col("segments"), "en")
    return docs.select("doc_id", F.posexplode(M.chunks(whole)).alias("part_no", "payload")).select(
        "doc_id", "part_no", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("sha256")
    )


@query("""
SELECT p_partkey, CASE WHEN r < 0 THEN '-' ELSE '+' END || abs(r) || '%' AS rate
FROM (SELECT p_partkey, CAST(round_even(p_size - 25, 0) AS INTEGER) AS r FROM part)
""")
def edge_rate(spark, sf_dir):
    rate = (F.col("p_size") - 25).cast("double") / 100 + 1
    return table(spark, sf_dir, "part").select("p_partkey", T.speed_percent(rate).alias("rate"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("channel"), F.col("doc_id").alias("seq"), _first_line().alias("title"), F.col("source").alias("description"),
        F.concat(F.lit("https://h.example/b/a b&c/"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("audio_url"),
        F.lit("Mon, 09 Mar 2026 00:00:00 +0000").alias("pub_date"), F.concat(F.lit("g<"), F.col("doc_id").cast("string")).alias("guid"),
        (F.col("doc_id") % 90).alias("duration"), (F.col("doc_id") % 5).alias("file_size"),
    )


@query(f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS k FROM documents)
SELECT trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title, source AS description, 'https://h.example/b/a b&c/' || doc_id || '.mp3' AS audio_url,
  'Mon, 09 Mar 2026 00:00:00 +0000' AS pub_date, 'g<' || doc_id AS guid, doc_id % 90 AS duration, CASE WHEN doc_id % 5 > 1 THEN doc_id % 5 ELSE 0 END AS file_size
FROM d WHERE k <= 180
""")
def feed_roundtrip(spark, sf_dir):
    """Written as RSS, read as RSS."""
    from uuid import uuid4

    from lectern.storage import shared_dir

    ledger = L.retained(_ledger(spark, sf_dir)).where("kept").drop("kept")
    info = F.struct(*[F.lit(x).alias(n) for n, x in (
        ("title", "T & t"), ("author", "A"), ("website", "https://s.example"), ("description", "D"), ("cover_art", "https://s.example/i.png"), ("rss_url", "https://s.example/f.xml"),
    )])
    channels = ledger.select("channel").distinct().withColumns(
        {"language": F.col("channel"), "email": F.lit("a@s.example"), "podcast_info": info}
    )
    path = f"{shared_dir(spark)}/feeds-{uuid4().hex}"
    X.write_feeds(X.feed_documents(ledger, channels), path)
    return feeds.published(feeds.read_items(spark, path))


def _decoded_sql(x: str) -> str:
    """The references that the pages hold, resolved once."""
    return f"""regexp_replace(replace(replace(replace({x}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"""


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '<(br|/p|/div|/li|/h[1-6])\s*/?>', chr(10), 'gi') AS s FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(s, '<li\b[^>]*>', '- ', 'gi'), '<[^>]+>', ' ', 'g') AS s FROM a),
r AS (SELECT page_id, {_decoded_sql("s")} AS s FROM t), q AS (SELECT page_id, {_decoded_sql("s")} AS s FROM r), b AS (SELECT page_id, {_decoded_sql("s")} AS s FROM q),
c AS (SELECT page_id, regexp_replace(replace(s, chr(160), ' '), '([\p{{L}}\p{{N}}_])-\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS s FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(s, '\s*\n\s*', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(10) || chr(9)) AS text FROM c
""")
def html_to_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(html, '<(br|/p|/div|/li|/h[1-6])\s*/?>', chr(10), 'gi') AS s FROM pages),
b AS (SELECT page_id, replace(regexp_replace(regexp_replace(s, '<li\b[^>]*>', '- ', 'gi'), '<[^>]+>', ' ', 'g'), chr(160), ' ') AS s FROM a),
c AS (SELECT page_id, regexp_replace(s, '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g') AS s FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(s, '\s*\n\s*', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(10) || chr(9)) AS text FROM c
""")
def tagless_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", T.html_to_text(F.col("html"), entities=False).alias("text"))


@query(r"""
SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a\b[^>]*href="([^"]*)"', 1)) AS href FROM pages
""")
def page_links(spark, sf_dir):
    found = pages.with_elements(spread(table(spark, sf_dir, "pages")))
    return pages.links(found).select("page_id", "href")


@query(f"SELECT page_id, trim({_decoded_sql("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)")}) AS title FROM pages")
def page_title(spark, sf_dir):
    """The first heading of every page, as it reads."""
    found = pages.with_elements(spread(table(spark, sf_dir, "pages")))
    heading = F.get(F.filter("nodes", lambda n: n["tag"] == "h1"), F.lit(0))
    return found.select("page_id", pages.text_of(F.col("pieces"), heading).alias("title"))


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three layouts around the texts of pages' addresses."""
    rows = spread(table(spark, sf_dir, "pages")).select("page_id", F.concat(F.lit("Text "), F.col("page_id").cast("string"), F.lit(" &eacute;")).alias("b"))
    html = F.element_at(
        F.array(
            F.concat(F.lit('<section class="section--isStatic"><div class="section__head"><h2>VANGELO DEL GIORNO</h2></div><div class="section__wrapper"><p>'), "b", F.lit("<span><b>Lc 4,24-30</b></span></p></div></section>")),
            F.concat(F.lit("<div><h2>Vangelo del giorno</h2><div><p>"), "b", F.lit("<sup><small>Mt 5,1</small></sup></p><span>2Re 5, 1-15a</span></div></div>")),
            F.concat(F.lit("<div><h1>x</h1><h2>vangelo del giorno</h2><p>"), "b", F.lit("</p><h2>Altro</h2><p>n</p></div>")),
        ),
        (F.col("page_id") % 3 + 1).cast("int"),
    )
    return pages.with_elements(rows.select("page_id", html.alias("html")))


@query("SELECT page_id, 'Text ' || page_id || ' é' AS text FROM pages")
def page_sections(spark, sf_dir):
    """Sections of three layouts, without the elements that hold nothing but a verse reference."""
    found = pages.find_section(pages.sections(_layouts(spark, sf_dir)), "VANGELO DEL GIORNO")
    return found.select("page_id", T.html_to_text(F.col("read")).alias("text"))


@query("""
SELECT doc_id, 'Prima Lettura' || chr(10) || 'Dal libro della Genesi' || chr(10) || 'Il testo numero ' || doc_id || '.' AS first,
  'Dal Vangelo secondo Matteo' || chr(10) || 'In quel tempo.' AS gospel, CAST(2 AS INTEGER) AS n
FROM documents
""")
def segments_line(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id")
    text = F.concat(
        F.lit("<p>Prima Lettura</p><p>Dal libro della Genesi 1, 1-3</p><p>Il testo numero "), F.col("doc_id").cast("string"),
        F.lit(".</p><p>Salmo Responsoriale</p><p>Lodate.</p><p>Dal Vangelo secondo Matteo</p><p>In quel tempo.</p>"),
    )
    found = rows.withColumn("_plain", T.html_to_text(text)).select("doc_id", S.sections_of(F.col("_plain"), "it").alias("s"))
    return found.select("doc_id", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("gospel"), F.size("s").alias("n"))


@query()
def smooth_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.smooth(F.col("text"), "it").alias("text"))


@query()
def normalize_full(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).withColumn("_plain", T.html_to_text(F.col("text")))
    spoken = S._spoken(F.col("_plain"), F.col("lang"), True)
    return docs.select("doc_id", spoken.alias("text"))


@query("""
WITH m AS (SELECT doc_id, (doc_id % 2) AS a, (doc_id // 2) % 2 AS b, (doc_id // 4) % 2 AS c FROM documents)
SELECT doc_id, 'x' || CASE WHEN a = 1 THEN '__QSTART__' ELSE '' END || 'y'
  || CASE WHEN b = 1 THEN CASE WHEN a = 1 THEN '__QEND__' ELSE '' END || '__QSTART__' ELSE CASE WHEN a = 1 THEN '__QEND__' ELSE '' END END || 'z'
  || CASE WHEN c = 1 THEN CASE WHEN b = 1 THEN '__QEND__' ELSE '' END || '__QSTART__' ELSE CASE WHEN b = 1 THEN '__QEND__' ELSE '' END END || 'w'
  || CASE WHEN c = 1 THEN '__QEND__' ELSE '' END AS text
FROM m
""")
def quote_balance(spark, sf_dir):
    mark = lambda k: F.when(F.floor(F.col("doc_id") / k) % 2 == 1, "__QSTART__").otherwise("__QEND__")
    made = F.concat(F.lit("x"), mark(1), F.lit("y"), mark(2), F.lit("z"), mark(4), F.lit("w"))
    return table(spark, sf_dir, "documents").select("doc_id", T.balance_quotes(made).alias("text"))


@query("""
SELECT doc_id, 'a' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '<prosody rate="1">' ELSE '<prosody rate="1">b</prosody>' END || 'c' || CASE WHEN doc_id % 3 = 1 THEN '</prosody>' ELSE '' END AS text
FROM documents
""")
def prosody_balance(spark, sf_dir):
    n = F.col("doc_id") % 3
    made = F.when(n == 0, "a</prosody>c").when(n == 1, 'a<prosody rate="1">c').otherwise('a<prosody rate="1">b</prosody></prosody>c')
    return table(spark, sf_dir, "documents").select("doc_id", M.balance_prosody(made).alias("text"))


@query(r"""
SELECT doc_id, trim(CASE WHEN doc_id % 2 = 0 THEN 'Reading ' || doc_id ELSE 'Only ' || doc_id END) AS first,
       CASE WHEN doc_id % 2 = 0 THEN 'Second reading b' ELSE '' END AS second
FROM documents
""")
def split_readings(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    made = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("Reading "), number, F.lit("\nResponsorial Psalm p\nSecond reading b"))
    ).otherwise(F.concat(F.lit("Only "), number))
    parts = S.split_readings(made, "en")
    return table(spark, sf_dir, "documents").select("doc_id", parts["first"].alias("first"), parts["second"].alias("second"))


from lectern import flow_queries, run_queries  # noqa: E402, F401  register the queries of whole runs


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries of every channel as feed items: those that history lacks, the newest ten kept."""
    entries, history = _entries(spark, sf_dir)
    fresh = L.new_entries(entries, history).select(F.col("lang").alias("channel"), "doc_id", "title", "link")
    numbered = L.publish_order(fresh.withColumn("pos", -F.col("doc_id")))
    kept = L.retained(numbered, 10).where("kept")
    return kept.select("channel", "seq", "doc_id", T.sanitize(F.col("title")).alias("title"))
