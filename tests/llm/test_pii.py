import random
import re

from lectern.llm import pii
from tests.llm.conftest import odd_rows


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def spans(found):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}


TEXTS = [
    "a@b.c+d@e.f x", "a@b@c.d", "1.2.3.4.5.6.7.8.9", "999.1.1.1 1.1.1.255", "4111 1111 1111 1111", "+1 (234) 555-6789.",
    "é +49 30 1234567 ü a@b.de 😀 c@d.fr", ".@.a a@-.-", "0000255.1.1.1", "+1+2+3+44444444444", "1-1-1-1-1-1-1-1-1-1-1-7 ",
    "x" * 50 + "@" + "y." * 5 + "z", None, "", "12  34", "5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5", "+1 234 567 8901 2345 678",
]


def test_base_against_brute_force(docs):
    got = spans(pii.find_personal_data(docs(list(enumerate(TEXTS)))))
    for i, text in enumerate(TEXTS):
        assert [s for s in got[i] if s[0] in pii.BASE] == brute(text), text


def test_wider_patterns_are_added(docs):
    rows = [(i, f"mail me{i}@mail.example.com or call +1 (234) 555-{1000 + i}") for i in range(30)]
    rows += [(100, "please call (499) 555-6503 now"), (101, "write bob [at] mail (dot) com"), (102, "page 12 of 345")]
    got = spans(pii.find_personal_data(docs(rows)))
    assert got[100] == [("tel", 12, 26)] and got[101] == [("address", 6, 29)] and got[102] == []


def test_long_texts_take_linear_time(docs):
    texts = ["1 " * 50_000, "a." * 50_000, "a@b.c " * 10_000, "9" * 100_000, "1." * 50_000, "+1" * 50_000, "me@" + "b." * 100_000 + "com", "x@" + "b-" * 100_000]
    got = spans(pii.find_personal_data(docs(list(enumerate(texts)))))
    assert len(got[2]) == 10_000 and got[2][-1] == ("email", 59_994, 59_999)
    assert len([s for s in got[4] if s[0] == "ip"]) == 12_500
    assert ("email", 0, 200_006) in got[6] and got[7] == []


def test_reliabilities_favour_agreement():
    post, _ = pii.reliabilities({"111": 50, "000": 50, "122": 10, "022": 10})
    assert post["111"] > 0.9 > 0.1 > post["000"] and post["122"] > post["022"]


def test_odd_rows(docs):
    assert pii.find_personal_data(docs(odd_rows())).count() == len(odd_rows())
    assert pii.find_personal_data(docs([])).count() == 0


def test_spans_apart_like_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    span = "array<struct<start:long,end:long,kind:string>>"
    rows = []
    for i in range(400):
        make = lambda k: [(a := rng.randint(0, 40), a + rng.randint(1, 8), f"{k}{j}") for j in range(rng.randint(0, 7))]
        rows.append((i, make("f"), make("m")))
    df = spark.createDataFrame(rows, f"i long, f {span}, m {span}")
    got = {r.i: {s.kind for s in r.x} for r in df.select("i", pii._apart(F.col("f"), F.col("m")).alias("x")).collect()}
    for i, fixed, more in rows:
        assert got[i] == {k for a, e, k in more if not any(b < e and a < c for b, c, _ in fixed)}


def test_a_text_of_many_spans_takes_seconds(spark):
    import time

    text = " ".join(f"call (555) 123-{i % 9000 + 1000} or a{i}@b.example" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    spans = pii.candidates(docs).selectExpr("size(base) AS b", "size(proposed) AS p").first()
    assert spans.b >= 20_000 and spans.p == 20_000
    assert time.time() - began < 40
