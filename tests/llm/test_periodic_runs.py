import hashlib
import random
import time

import numpy as np
import pytest

from lectern.llm.periodic_runs import periodic, periodic_runs
from tests.llm.conftest import odd_rows


def brute(w, least=6, periods=4):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least, periods * q) and not any(a <= s and a + m >= s + n for a, m, p in out if p < q):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(rng):
    a, out = rng.choice([1, 2, 2, 3, 5, 40]), []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.randrange(a) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.3:
            unit = unit * rng.randint(1, 4) + [rng.randrange(a)]
        out += unit * rng.randint(1, 9) + [rng.randrange(a) for _ in range(rng.randint(0, 5))]
    return out


def test_like_brute_force():
    rng = random.Random(6)
    for _ in range(1500):
        w, (least, periods) = words(rng), rng.choice([(6, 4), (6, 4), (3, 3), (4, 5)])
        assert periodic(np.array(w, np.int64), least, periods) == brute(w, least, periods), w


def test_all_words_of_short_texts():
    for n in range(9):
        for x in range(1 << n):
            w = [x >> i & 1 for i in range(n)]
            assert periodic(np.array(w, np.int64)) == brute(w)


@pytest.mark.parametrize("w", [[0] * 100_000, [0, 1] * 50_000, ([0] * 1000 + [1]) * 100, [0] * 50_000 + [1] + [0] * 50_000 + [2]])
def test_long_runs_take_seconds(w):
    began = time.time()
    assert (0, len(w), {100_000: 1}.get(len(w))) in periodic(np.array(w, np.int64)) or len(set(w)) > 1
    assert time.time() - began < 20


def test_collapsed_text_and_odd_rows(spark, docs):
    rows = odd_rows() + [(20, "a b c\ta b c\na b c  a b c a x"), (21, "x x x x x x y"), (22, "x x " * 6), (23, "\x1fx \x1fx " * 3)]
    got = periodic_runs(docs(rows)).collect()
    assert len(got) == len(rows)
    by_text = {(d, hashlib.md5((t or "").encode()).hexdigest()): t for d, t, *_ in rows}
    for r in got:
        texts = [t for (d, _), t in by_text.items() if d == r.doc_id]
        wanted = []
        for t in texts:
            ws = (t or "").encode().split()
            index = {}
            ids = [index.setdefault(w, len(index)) for w in ws]
            runs = [(0, 60_000, 1)] if t and t.startswith("w w ") else [(0, 3_000, 1)] if t and t.startswith("a\na") else brute(ids)
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            wanted.append(([tuple(x) for x in runs], b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
        assert ([tuple(x) for x in r.runs], r.collapsed) in wanted
    one = {r.doc_id: r for r in got}
    assert one[20].collapsed == "a b c x" and [tuple(x) for x in one[20].runs] == [(0, 13, 3)]
    assert one[21].collapsed == "x y" and len(one[22].runs) == 1 and one[22].collapsed == "x x"
    assert periodic_runs(docs([])).count() == 0


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        periodic(np.zeros(9, np.int64), 6, 2)
