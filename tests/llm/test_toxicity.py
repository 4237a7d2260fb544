import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import toxicity
from tests.llm.conftest import odd_rows, prose

BAD = ["grumblewort", "snotface", "dimwitted", "clodhopper"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for i, line in enumerate(prose(9, 400)):
        toxic = i % 4 == 0
        words = line.split()
        if toxic:
            for w in rng.sample(BAD, 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_scores_held_out_and_disguised_texts(spark, docs, corpus):
    rows, labels = corpus
    disguised = ["you are a grumb1ew0rt", "such a s n o t f a c e", "he is diiiiimwitted", "clodh0pper!!", "CLODHOPPER"]
    clean = ["what a nice day 2024", "a b c d", "mail3.example.com", ""]
    df = docs(rows + [(1000 + i, x) for i, x in enumerate(disguised)] + [(2000 + i, x) for i, x in enumerate(clean)])
    table = spark.createDataFrame([(*x, "e") for x in labels], "doc_id long, toxic int, text string")
    scorer = toxicity.fit(df, table, toxicity.fold(F.col("_id")) == 2)
    assert set(BAD) <= set(scorer.weights)
    got = {r.doc_id: r["score"] for r in toxicity.score(df, scorer).collect()}
    truth = dict(labels)
    wrong = [d for d in truth if (got[d] >= toxicity.THRESHOLD) != bool(truth[d])]
    assert len(wrong) <= 8
    assert all(got[1000 + i] >= toxicity.THRESHOLD for i in range(len(disguised)))
    assert all(got[2000 + i] < toxicity.THRESHOLD for i in range(len(clean)))


def test_viterbi_is_the_best_of_all_paths(corpus):
    model = toxicity.language_model(toxicity.word_counts(w for _, t in corpus[0] for w in t.split()))

    def total(text):
        s = np.concatenate([[0, 0], toxicity._symbols(text), [0]])
        return sum(model[a, b, c] for a, b, c in zip(s, s[1:], s[2:]))

    for token in ("s1ll11", "h3ll0", "aaab4", "n0o0n", "x*y"):
        paths = [("", 0.0)]
        for readings in toxicity._readings(token):
            paths = [(t + x, c + k) for t, c in paths for x, k in readings]
        best = max(paths, key=lambda p: p[1] + total(p[0]))
        assert toxicity.decode(token, model) == best[0]


def test_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxicity.fit(docs(odd_rows()), none)
    got = toxicity.score(docs(odd_rows()), scorer).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] < toxicity.THRESHOLD for r in got)
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    toxicity.fit(docs(odd_rows()), nulls)
    assert toxicity.score(docs([]), scorer).count() == 0


def test_long_tokens_are_read_whole():
    model = toxicity.language_model(toxicity.word_counts(["clodhopper"]))
    token = "x1" * 50_000 + "cl0dhopper"
    assert "clodhopper"[-5:] in toxicity.restored(token, model, {}).pop()[-10:]


def test_words_across_what_were_cuts_doubled_letters_and_spaced_words():
    model = toxicity.language_model(toxicity.word_counts([*BAD, "you", "are", "a", "such", "and"] * 20))
    read = lambda t: toxicity.restored(t, model, {})
    for at in range(56, 66):
        assert any("clodhopper" in w for w in read("-1" * (at // 2) + "." * (at % 2) + "cl0dhopper-x"))
    assert "clodhopper" in read("ccllooddhhooppeerr") and "grumblewort" in read("you gruumbleewort!")
    assert {"snotface", "dimwitted"} <= read("s n o t f a c e d i m w i t t e d")
    assert {"grumblewort", "snotface"} <= read("a g.r.u.m.b.l.e.w.o.r.t.s.n.o.t.f.a.c.e")


def test_the_lexicon_keeps_every_word_that_passes(spark, docs):
    rng = random.Random(12)
    bad = ["".join(rng.choice("bcdfghklmnprst") for _ in range(9)) for _ in range(100)]
    rows = [(i, line + "".join(f" {w}" for w in rng.sample(bad, 40)) * (i % 8 == 0)) for i, line in enumerate(prose(10, 400))]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs(rows), labels)
    counts = {w: sum(w in t for _, t in rows) for w in bad}
    assert sum(counts[w] > 10 for w in bad) > 90
    assert {w for w in bad if counts[w] > 10} <= set(scorer.weights)


def test_the_score_is_that_of_the_listed_words(spark, docs, corpus):
    """The logistic curve over the listed words of the restored text, the strongest in full, each further one by half."""
    import math

    rows, labels = corpus
    rows = rows[:120] + [(900, "grumb1ew0rt and s n o t f a c e, CLODHOPPER clodhopper"), (901, None), (902, "")]
    scorer = toxicity.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r["score"] for r in toxicity.score(docs(rows), scorer).collect()}
    table = scorer.model.tolist()
    seen = 0
    for d, text in rows:
        listed = [scorer.weights[w] for w in toxicity.restored(text or "", table, {}) if w in scorer.weights]
        evidence, share = 0.0, 1.0
        while listed:
            evidence += share * listed.pop(listed.index(max(listed)))
            share /= 2
        assert abs(got[d] - 1 / (1 + math.exp(-(scorer.bias + scorer.scale * evidence)))) < 1e-12
        seen += evidence > 0
    assert seen > 20 and got[901] == got[902] and got[900] > 0.9
