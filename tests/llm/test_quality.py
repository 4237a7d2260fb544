import re

from lectern.llm import quality
from tests.llm.conftest import odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)),
        len(covered), len(re.findall("[A-Z]", text)), sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def test_measurements_against_brute_force(docs):
    texts = prose(3, 30)
    rows = [(i, x) for i, x in enumerate(texts)]
    rows += [(50, texts[0] + "\n" + texts[0]), (51, "a b c d e f g h " * 9), (52, "x " * 500), (53, "A&B <c> | #d\n\n \nA&B <c> | #d")]
    rows += [(60, "1 2 3 4 5 6 7 8 0 1 2 3 4 5 6 7 8 9 2 3 4 5 6 7 8 9"), *[(100 + i, r[1]) for i, r in enumerate(odd_rows())]]
    got = quality.ledger(docs(rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert tuple(r)[1:-1] == brute(text[r.doc_id]), r


def test_policies_and_ablations(docs):
    rows = [(0, " ".join(prose(1, 5))), (1, "too short"), (2, "# " * 40), (3, "GO NOW " * 30), (4, None)]
    entries = quality.ledger(docs(rows))
    kept = {r.doc_id: r.kept for r in quality.apply_policy(entries, "v3").collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False}
    found = {r.rule: (r.n_failed, r.n_alone, r.n_rejected) for r in quality.ablations(entries, "v3").collect()}
    assert found["too_few_words"] == (2, 2, 4) and found["shouting"][0] == 1
    assert all(r.n_rejected == 0 for r in quality.ablations(quality.ledger(docs([])), "v2").collect())
    assert quality.ledger(docs([])).count() == 0
