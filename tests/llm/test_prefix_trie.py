import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from lectern.llm import ordered, prefix_trie
from lectern.llm.queries import op11_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, x1 string, owner string, `_of` string, `final` string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def paths(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in conv.items()}


def rebuilt(conv):
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in conv}
    return {c: conv.get(c - c % 5, [])[: heads[c]] + conv[c][heads[c] :] for c in conv}


def brute(conv):
    nodes = defaultdict(list)
    for c, p in conv.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    for n, m in nodes.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += n not in kids
    ends = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[n] if len(conv[c]) == len(n)))).encode()).hexdigest()
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], ends(n)) for n, m in nodes.items()
    )


def rows(df):
    return sorted(tuple(r[c] for c in OUT) for r in df.collect())


def write(spark, data, path):
    spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in data], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def made(seed, n, long=40):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        out += [(c, t, rng.choice(["user", "assistant"]), rng.choice("abcé") * rng.randint(0, 2)) for t in range(rng.choice([0, 1, 2, 3, 9, long]))]
    rng.shuffle(out)
    return out


def test_like_brute_force_with_nulls_ties_and_absent_heads(spark, tmp_path):
    data = made(3, 60) + [(3, None, "user", "first"), (3, None, None, None), (7, 1, "user", None), (None, 1, "user", "nobody"), (5, 0, "user", "a"), (5, 0, "user", "a")]
    data = [r for r in data if r[0] != 20]  # 21 to 24 have no head
    path = write(spark, data, tmp_path)
    # equal numbers are in the order of role, then of a digest: only equal turns tie here, or turns of other roles
    seen = set()
    data = [r for r in data if (r[:3] not in seen and not seen.add(r[:3])) or r[0] == 5]
    assert rows(op11_trie(spark, write(spark, data, tmp_path / "b"))) == brute(rebuilt(paths(data)))
    assert op11_trie(spark, path).count() > 0


def test_one_conversation_of_most_rows_and_a_turn_that_many_share(spark, tmp_path):
    data = [(1, t, "user", str(t)) for t in range(150)] + [(c, 0, "user", "hello") for c in range(10, 400)]
    data += [(c, 1, "user", f"{c % 7}") for c in range(10, 400)] + [(2, t, "user", str(t)) for t in range(149)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        path = write(spark, data, tmp_path)
        df = spark.read.parquet(f"{path}/conversations.parquet")
        turns = prefix_trie.turns(df)
        convs = df.select("conv_id").distinct()
        assert rows(prefix_trie.prefix_trie(convs, turns)) == brute(paths(data))
        at = ordered.in_order(df.select("conv_id", "turn"), "conv_id", "turn", name="test")
        assert at.select(ordered.range_of(F.col("at"))).distinct().count() > 8
        run = ordered.running(at, "conv_id", sums={"n": F.lit(1)}, xors={"x": F.col("turn")}).collect()
        assert all(r.n == r.turn + 1 for r in run) and sum(r.final for r in run) == 392
        assert all(r.x == [r.turn, 1, r.turn + 1, 0][r.turn % 4] for r in run)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table(spark, tmp_path):
    assert rows(op11_trie(spark, write(spark, [], tmp_path))) == []


def test_many_ends_of_one_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    data = [(c, 0, "user", "same") for c in range(300)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert rows(prefix_trie.prefix_trie(df.select("conv_id"), prefix_trie.turns(df))) == brute(paths(data))
