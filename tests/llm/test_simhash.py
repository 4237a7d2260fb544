import random

import numpy as np
import xxhash

from lectern.llm import simhash
from tests.llm.conftest import odd_rows, prose


def plain_fingerprint(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def components(ids, fps):
    u = np.array(sorted(set(fps)), dtype=np.int64)
    label = np.arange(len(u))  # Python's numbers, so that signs don't matter
    for i in range(len(u)):
        near = np.array([((int(x) ^ int(u[i])) & (2**64 - 1)).bit_count() <= 3 for x in u])
        met = np.unique(label[near])
        label[np.isin(label, met)] = met[0]
    of = dict(zip(u.tolist(), label.tolist(), strict=True))
    least = {}
    for d, f in zip(ids, fps, strict=True):
        if d is not None:
            least[of[f]] = min(d, least.get(of[f], d))
    return [least.get(of[f]) for f in fps]


def test_fingerprints(docs):
    rows = [(i, x) for i, x in enumerate(prose(1, 40))] + [(50, "One TWO"), (51, "É à Ç é"), *[(100 + i, r[1]) for i, r in enumerate(odd_rows())]]
    got = {r.doc_id: r.fp for r in simhash.fingerprints(docs(rows), 3).collect()}
    assert got == {d: plain_fingerprint(t, 3) for d, t in rows}


def test_components_of_planted_fingerprints(spark, monkeypatch):
    rng = random.Random(7)
    values = []
    for _ in range(60):
        base = rng.getrandbits(64)
        values.append(base)
        for _ in range(rng.randint(0, 12)):  # chains that drift away by up to three bits a step
            for b in rng.sample(range(64), rng.randint(1, 4)):
                base ^= 1 << b
            values.append(base)
    center = rng.getrandbits(64)
    values += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)]
    fps = [v - (1 << 64) if v >> 63 else v for v in values]
    ids = list(range(len(fps)))
    monkeypatch.setattr(simhash, "SLICE", 20)  # so that crowded buckets are dealt out
    monkeypatch.setattr(
        simhash, "fingerprints", lambda docs, shingle: spark.createDataFrame(list(zip(ids, fps, strict=True)), "doc_id long, fp long")
    )
    got = {
        r.doc_id: r.component_id for r in simhash.near_duplicates(spark.range(1)).collect()
    }
    assert [got[i] for i in ids] == components(ids, fps)


def test_odd_rows(docs):
    rows = odd_rows()
    got = simhash.near_duplicates(docs(rows), 3).collect()
    assert len(got) == len(rows)
    wanted = components([r[0] for r in rows], [plain_fingerprint(r[1], 3) for r in rows])
    assert sorted(map(repr, [(r.doc_id, r.component_id) for r in got])) == sorted(
        map(repr, [(r[0], c) for r, c in zip(rows, wanted, strict=True)])
    )
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_of_each_group_stays(docs):
    a, b = prose(3, 2)
    df = docs([(3, a), (1, a), (2, b), (2, b), (None, b), (4, a + " ")])
    kept = simhash.first_of_each(df, 5)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2]
    assert simhash.first_of_each(docs([]), 5).count() == 0


def test_rows_are_told_apart_by_doc_id_and_words(docs):
    a, b, c, d, e = prose(23, 5)
    df = docs([(1, a), (1, b), (2, b), (5, a), (5, c), (None, d), (None, d), (None, a), (7, e), (7, e), (8, ""), (None, " ")])
    kept = sorted(((r.doc_id, r.text) for r in simhash.first_of_each(df, 5).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (5, c), (None, d), (7, e), (8, "")], key=repr)


def test_similar_documents_are_found_and_others_left(docs):
    rng = random.Random(5)
    rows, wanted = [], {}
    for g, base in enumerate(" ".join(prose(50 + g, 6)) for g in range(25)):
        words = base.split()
        for copy in range(4):
            changed = list(words)
            for _ in range(copy and max(1, len(words) // 150)):
                changed[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((g * 10 + copy, " ".join(changed)))
            wanted[g * 10 + copy] = g * 10
    far = rows[0][1].split()
    far[::8] = ["other"] * len(far[::8])
    rows.append((999, " ".join(far)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(rows), 5, 0.8).collect()}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert got[999] == 999
    for d, g in wanted.items():
        assert got[d] == g or not alike(d, g)


def test_no_similar_pair_is_missed(docs):
    rng = random.Random(17)
    vocabulary = " ".join(prose(60, 40)).split()
    rows, pairs = [], []
    for g in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(150, 700))]
        share, other = rng.uniform(0.80, 0.90), list(words)
        if g % 2:  # a block of text added
            block = [rng.choice(vocabulary) for _ in range(int(len(words) * (1 / share - 1)))]
            at = rng.randrange(len(words))
            other[at:at] = block
        else:  # single words changed, each in five shingles
            for i in rng.sample(range(len(words)), max(1, int(len(words) * (1 - share) / (1 + share) / 5))):
                other[i] = f"new{g}x{i}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    for g in range(80):
        a, b = sets[2 * g], sets[2 * g + 1]
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * g, g % 2))
    assert min(sum(k == kind for _, k in pairs) for kind in (0, 1)) > 25
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(rows), 5, 0.8).collect()}
    assert [d for d, _ in pairs if got[d + 1] != d] == []


def brute_similar(rows, k=5, similarity=0.8):
    """component_id by comparing every two texts."""
    sets = [{tuple(t.lower().split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                gone, to = max(label[i], label[j]), min(label[i], label[j])
                label = [to if x == gone else x for x in label]
    return {d: rows[label[i]][0] for i, (d, _) in enumerate(rows)}


def crowd():
    """Copies of three texts: chains, in which copies far apart are linked through those between, and stars, in which most
    copies of the middle are no links of each other."""
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = words = " ".join(prose(80 + g, 8)).split()
        for copy in range(25):
            words = list(words)
            words[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((g * 1000 + copy, " ".join(words)))
        for copy in range(60):
            changed = list(base)
            for i in rng.sample(range(len(base)), rng.randint(1, len(base) // 12)):
                changed[i] = f"new{rng.random()}"
            rows.append((g * 1000 + 100 + copy, " ".join(changed)))
    return rows


def test_a_crowd_of_likely_partners_loses_no_link(docs, monkeypatch):
    rows = crowd()
    wanted = brute_similar(rows)
    assert 3 < len(set(wanted.values())) < len(rows) - 100
    for block in (8, 20_000):  # crowded buckets dealt in blocks, and whole
        monkeypatch.setattr(simhash, "CROWD", block)
        got = simhash.similar_documents(docs(rows), 5, 0.8)
        assert {r.doc_id: r.component_id for r in got.collect()} == wanted


def test_long_texts_are_told_by_their_fingerprints_too(docs):
    rng = random.Random(3)
    rows = []
    for g in range(4):
        base = " ".join(prose(300 + g, 60)).split()
        for copy in range(20):
            changed = list(base)
            for i in rng.sample(range(len(base)), rng.randint(1, len(base) // 35)):
                changed[i] = f"new{rng.random()}"
            rows.append((g * 100 + copy, " ".join(changed)))
    assert min(len(t.split()) for _, t in rows) > simhash.LONG
    got = simhash.similar_documents(docs(rows), 5, 0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_similar(rows)


def test_bitmaps_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(5)
    for size in (3, 40, 400, 4000):
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        b = np.concatenate([a[size // 5 :], rng.integers(0, 1 << 63, size // 3).astype(np.uint64)])
        bits = int(np.bitwise_count((simhash._bitmap(a) ^ simhash._bitmap(b)).view(np.uint64)).sum())
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_similar_documents_of_odd_rows(docs):
    rows = odd_rows()
    got = simhash.similar_documents(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == by[3] == {1} and by[5] == by[6] == {5} and len(by[9]) == 1
    assert simhash.similar_documents(docs([])).count() == 0


def test_the_pipeline_finds_by_balls_of_fingerprints(spark, docs, monkeypatch):
    """What SimHashes within RADIUS bits link is found without any shared shingle, and confirmed by shingles."""
    base = " ".join(prose(90, 60))
    near = base + " added"
    other = " ".join(prose(91, 60))
    rows = [(1, base), (2, near), (3, other), (4, other.replace(" ", "  ")), (5, near + " more")]
    fps = [simhash.fingerprint(t, 5) & (2**64 - 1) for _, t in rows]
    assert 0 < max((fps[0] ^ fps[1]).bit_count(), (fps[1] ^ fps[4]).bit_count()) <= simhash.RADIUS
    monkeypatch.setattr(simhash, "likely_links", lambda *a, **k: spark.createDataFrame([], "u long, v long"))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(rows), 5, 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1}
    assert sorted(r.doc_id for r in simhash.first_of_each(docs(rows), 5, 0.8).collect()) == [1, 3]


def test_balls_link_all_nodes_of_near_fingerprints(spark):
    fps = [5, 5, 5, 4, 7, 1 << 40, (1 << 40) | 3, -1, -2, 0xFF00FF]
    nodes = spark.createDataFrame([(10 + i, f) for i, f in enumerate(fps)], "id long, fp long")
    got = [(r.u, r.v) for r in simhash.ball_links(nodes).collect()]
    assert len(got) == len(set(got)) and all(u < v for u, v in got)
    label = {10 + i: 10 + i for i in range(len(fps))}
    for u, v in got:
        assert ((fps[u - 10] ^ fps[v - 10]) & (2**64 - 1)).bit_count() <= simhash.RADIUS
        label = {k: min(label[u], label[v]) if x in (label[u], label[v]) else x for k, x in label.items()}
    ids = sorted(label)
    assert [label[i] for i in ids] == components(ids, fps)
