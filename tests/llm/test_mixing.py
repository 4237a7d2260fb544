from collections import defaultdict

import pytest

from lectern.llm import mixing
from tests.llm.conftest import odd_rows, prose


def targets(sizes, weights, share, cap):
    """Water filling, one source after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def rows(seed=1):
    texts = prose(seed, 300)
    sources = ["b", "a", None, "é", "Z", "hot"]
    return [(i, x, "hot" if i % 3 == 0 else sources[i % 6]) for i, x in enumerate(texts)]


def test_targets_and_cuts(docs):
    found = mixing.mix(docs(rows()), rows_per_range=7).collect()
    assert len(found) == 300
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    wanted = targets(sizes, mixing.WEIGHTS, 1.5, 2.0)
    for s in sizes:
        assert target[s] == pytest.approx(wanted[s])
        assert taken[s] == int(target[s])
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))


def test_reruns_agree_whatever_the_ranges(docs):
    df = docs(rows())
    one = sorted((r.doc_id, r.taken) for r in mixing.mix(df, rows_per_range=5).collect())
    two = sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(7), rows_per_range=10**6).collect())
    assert one == two


def test_documents_follow_the_mix(docs):
    df = docs(rows())
    mixed = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(df).collect()}
    copies = defaultdict(int)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        copies[r.doc_id] += 1
    for d, (size, taken) in mixed.items():
        assert abs(copies[d] * size - taken) <= size / 2 + 1


def test_odd_rows(docs):
    found = mixing.mix(docs(odd_rows())).collect()
    assert len(found) == len(odd_rows())
    assert all(r.taken == 0 for r in found if r["size"] == 0)
    mixing.mixed_documents(docs(odd_rows())).count()
    assert mixing.mix(docs([])).count() == 0 == mixing.mixed_documents(docs([])).count()
    assert [r.taken for r in mixing.mix(docs([(1, None), (2, "")])).collect()] == [0, 0]
