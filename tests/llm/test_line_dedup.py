import random

from lectern.llm import line_dedup
from tests.llm.conftest import odd_rows, prose


def brute(rows, least=50):
    """(doc, text) -> the text without later repeated runs: every minimal run is looked up among all earlier ones."""
    seen, out = set(), {}
    for doc, text in sorted(dict.fromkeys(rows), key=lambda r: r[0]):
        lines = (text or "").split("\n")
        full = [(i, len([w for w in x.split(" ") if w])) for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for k in range(len(full)):
            total, j = 0, k
            while j < len(full) and total < least:
                total += full[j][1]
                j += 1
            if total < least:
                break
            run = tuple(lines[i] for i, _ in full[k:j])
            if run in seen:
                gone.update(range(full[k][0], full[j - 1][0] + 1))
            seen.add(run)
        out[doc, text] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_against_brute_force(docs):
    rng = random.Random(2)
    pool = prose(8, 30)
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                a = rng.randrange(len(pool))
                lines += pool[a : a + rng.randint(1, 5)]
            else:
                lines += prose(1000 + i, 2)
            if rng.random() < 0.3:
                lines.append("")
        rows.append((i, "\n".join(lines)))
    rows += [(200, rows[0][1]), (201, "\n".join(pool)), (201, "\n".join(pool)), (202, (pool[0] + "\n") * 40)]
    got = line_dedup.dedup_lines(docs(rows))
    found = {(r.doc_id): r.text for r in got.collect()}
    wanted = brute(rows)
    assert found == {d: t for (d, _), t in wanted.items()}
    assert sum(len(t or "") for t in found.values()) < sum(len(t) for _, t in rows)


def test_clean_documents_stay(docs):
    rows = [(i, "\n".join(prose(100 + i, 12))) for i in range(20)]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()} == dict(rows)


def test_passage_inside_other_texts(docs):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(i, f"intro {i}\n{passage}\nend {i}") for i in range(200)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"intro {i}\nend {i}" for i in range(1, 200))


def test_odd_rows(docs):
    got = line_dedup.dedup_lines(docs(odd_rows()))
    assert got.count() == len(odd_rows())
    assert {r.doc_id: r.text for r in got.collect()}[1] is None
    assert line_dedup.dedup_lines(docs([])).count() == 0
