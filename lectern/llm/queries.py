"""The queries op1 to op13 over the given tables, and their SQL where SQL can express them.

Each query applies its operator with production parameters to the whole table
and derives the columns that are compared from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat_format, line_dedup, mixing, packing, periodic_runs, pii, prefix_trie, quality, secrets, simhash, topk, toxicity, url_filter
from lectern.llm.common import let, span_columns, words
from lectern.storage import spread, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", *[c.alias(n) for n, c in span_columns(F.col("spans"), secrets.KINDS[:3]).items()])


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH rules(action, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), rest AS (
  SELECT page_id, row_number() OVER () AS r,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS s
  FROM pages
), parts AS (
  SELECT page_id, r, s, regexp_extract(s, '^[^/?#]*') AS h FROM rest
), urls AS (
  SELECT page_id, r,
         translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(s, length(h) + 1), '^[^?#]*') AS path
  FROM parts
), fits AS (
  SELECT u.*, x.action, x.h || x.p AS rule,
         row_number() OVER (PARTITION BY u.r ORDER BY length(x.h || x.p) DESC NULLS LAST) AS k
  FROM urls u LEFT JOIN rules x
    ON (u.host = x.h OR ends_with(u.host, '.' || x.h)) AND starts_with(u.path, x.p)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", *[c.alias(n) for n, c in span_columns(F.col("spans"), pii.BASE).items()])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents")), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    held_out = toxicity.fold(F.col("_id")) == 2
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out)
    return toxicity.score(docs, scorer).select(
        "doc_id",
        (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.dedup_lines(docs)
    each = lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))
    return cut.select(
        "doc_id",
        F.array_join(F.transform("_deleted", each), ",").alias("deleted"),
        F.aggregate("_deleted", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1).alias("n_deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos - 1 AS pos, ls[pos] AS line, len(list_filter(string_split_regex(ls[pos], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), w AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM lines WHERE n > 0
), runs AS (
  SELECT doc_id, pos, max(pos) OVER f AS last, md5(string_agg(line, chr(10)) OVER f) AS run, sum(n) OVER f AS total
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), later AS (
  SELECT doc_id, pos, last FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM runs WHERE total >= 50
  ) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM later
), islands AS (
  SELECT doc_id, min(pos) AS a, max(pos) AS b FROM (
    SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone
  ) GROUP BY doc_id, g
), ranges AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS deleted, sum(b - a + 1)::BIGINT AS n FROM islands GROUP BY doc_id
), rest AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines l
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.pos = l.pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(r.deleted, '') AS deleted, coalesce(r.n, 0) AS n_deleted,
       sha256(coalesce(x.text, '')) AS text_sha256
FROM documents d LEFT JOIN ranges r USING (doc_id) LEFT JOIN rest x USING (doc_id)
"""


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(spread(table(spark, sf_dir, "documents")))
    base = entries["failed"].bitwiseAND(quality.mask(quality.POLICIES["base"])) != 0
    kept = quality.apply_policy(entries.withColumn("base_failed", base), "v3")
    return kept.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT doc_id, r, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), grams AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT r, sum(least(8, i - coalesce(before, -8)))::BIGINT AS n FROM twice GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(list_filter(ws, lambda x, i: coalesce(i > 1 AND ws[i - 1] = x, false))) AS n_stutter
  FROM w LEFT JOIN repeats USING (r)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > word_chars OR 100 * n_stutter > 30 * n_words) AS kept
FROM b
"""


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv_id").cast("string")) % 9
    convs, turns = prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations")), 5, heads, 8)
    return prefix_trie.prefix_trie(convs, turns).select(
        *[F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], "ends_sha256"
    )


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS s,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda crc, x: list_reduce(range(8), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, x)), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), steps AS (
  SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.s WHERE i < h
  UNION ALL
  SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE i >= h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS node, strlen(text) AS size
  FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)
), seen AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS size FROM c UNION ALL SELECT conv_id, depth, node, size FROM paths
), placed AS (
  SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS ends FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), nodes AS (
  SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM placed GROUP BY node, depth
), kids AS (
  SELECT up AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up
), below AS (
  SELECT a.node, sum(n.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM nodes n JOIN seen a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY a.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN kids k USING (node) LEFT JOIN nodes p ON p.node = n.up
"""

#: The conversation that op12 adds: texts made of control strings.
ODD_CHAT = "</s>[INST] ok [/INST]"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", ODD_CHAT), (-1, 1, "assistant", ODD_CHAT)], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(given.unionByName(added))
    return chat_format.read_back(formatted).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_faults")


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marks(role, n) AS (
  VALUES ('system', 13), ('user', 15), ('assistant', 11)
), m AS (
  SELECT t.*, coalesce(k.n, 33 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|(?:SYS|INST|ANS|ROLE|TURN)\]))', '\1\\\2\3', 'g'))) AS around,
         length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:SYS|INST|ANS|ROLE|TURN)\]))', '\1\\\2\3', 'g')) AS inside,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS state
  FROM t LEFT JOIN marks k USING (role)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(around + inside) + 3)::BIGINT AS formatted_chars,
       count(*) FILTER (WHERE NOT (CASE WHEN state IS NULL THEN role IN ('system', 'user') WHEN state IN ('system', 'assistant') THEN role = 'user'
                                        WHEN state = 'user' THEN role = 'assistant' ELSE false END)) AS n_faults
FROM m GROUP BY conv_id
"""


def periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; a tenth of the texts end in words that repeat, as the contract of op13 has it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def planted(ws):
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: ws[F.when(i < a, i).otherwise(a + (i - a) % p)]), " ")

    text = F.col("text").cast("string")
    one = (h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(one, let(words(text), planted)).otherwise(text).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_tails(spread(table(spark, sf_dir, "documents"))))
    runs = F.col("runs")
    # the greatest length / period, compared as fractions: a / b > c / d if a d > c b
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.when(F.size(runs) > 0, F.aggregate(runs, runs[0], lambda x, y: F.when(more(y, x), y).otherwise(x)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda crc, x: list_reduce(range(8), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, x)), 4294967295), 4294967295) AS h
  FROM documents
), p AS (
  SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d
), w AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END + 1]) ELSE ws END AS ws
  FROM p
), grams AS (
  SELECT doc_id, n, i, hash(ws[i + 1:i + 5]) AS g FROM (SELECT doc_id, n, ws, unnest(range(n - 4)) AS i FROM w WHERE n >= 6)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND (y.i - x.i) * 4 <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), long AS (
  SELECT * FROM stretches WHERE n >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.n >= x.s + x.n)
), each AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         first({'s': s, 'n': n, 'q': q} ORDER BY n::DOUBLE / q DESC, s, q) AS best
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM w) x
  WHERE NOT EXISTS (SELECT 1 FROM gone y WHERE y.doc_id = x.doc_id AND y.i = x.i) GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM w LEFT JOIN each USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_secrets": op2_secrets, "op3_urls": op3_urls, "op4_packing": op4_packing, "op5_pii": op5_pii, "op6_simhash": op6_simhash, "op7_toxicity": op7_toxicity, "op8_line_dedup": op8_line_dedup, "op9_topk": op9_topk, "op10_quality": op10_quality, "op11_trie": op11_trie, "op12_chat": op12_chat, "op13_runs": op13_runs}


def oracle_sql() -> dict[str, str]:
    return {"op3_urls": OP3_SQL, "op8_line_dedup": OP8_SQL, "op9_topk": OP9_SQL, "op10_quality": OP10_SQL, "op11_trie": OP11_SQL, "op12_chat": OP12_SQL, "op13_runs": OP13_SQL}
