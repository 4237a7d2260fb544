import random
import string

from lectern.llm import secrets
from tests.llm.conftest import odd_rows, prose


def spans(found):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}


def test_patterns(docs):
    texts = {
        0: 'token = "0123abcd0123abcd0123abcd0123abcd"',
        1: "Password: short1 secret:token:abcdefgh api_key='AbCd+/==12'",
        2: "AKIA0123456789AB and AKIA01234 and AKIAAKIA0123456789",
        3: "é" * 5 + " " + "deadbeef" * 4 + " ſecret=abcdefghij",
        4: "password==abcdefg passwd  =  abc.def-_x",
    }
    got = spans(secrets.find_secrets(docs(list(texts.items()))))
    assert got[0] == [("assign", 0, 42 - 1), ("hex", 9, 41)]
    assert [k for k, _, _ in got[1]] == ["assign"] and texts[1][got[1][0][1] :].startswith("api_key")
    assert got[2] == [("access", 0, 16), ("access", 35, 53)]
    assert got[3] == [("hex", 6, 38)]
    assert [texts[4][a:b] for _, a, b in got[4]] == ["password==abcdefg", "passwd  =  abc.def-_x"]


def test_markov_finds_random_strings_and_leaves_words(docs):
    rng = random.Random(3)
    lines = prose(2, 200)
    name = lambda x: "_".join(x.rstrip(".").split()[:5])
    rows = [(i, f"{x} {name(x)}{i} {name(x)}.size token={''.join(rng.choices('0123456789abcdef', k=40))}") for i, x in enumerate(lines)]
    planted = "".join(rng.choices(string.ascii_letters + string.digits, k=32))
    rows.append((999, f"here it is {planted} and {name(lines[7])}2 stays"))
    got = spans(secrets.find_secrets(docs(rows)))
    assert got[999] == [("markov", 11, 43)]
    assert not any(k == "markov" for d, s in got.items() if d != 999 for k, _, _ in s)


def test_copies_of_a_secret_do_not_vouch_for_it(docs):
    rng = random.Random(5)
    lines = prose(2, 200)
    name = lambda x: "_".join(x.rstrip(".").split()[:5])
    rows = [(i, f"{x} {name(x)}{i} {name(x)}.size token={''.join(rng.choices('0123456789abcdef', k=40))}") for i, x in enumerate(lines)]
    mixed = "".join(rng.choices(string.ascii_letters + string.digits, k=32))
    letters = "".join(rng.choices(string.ascii_letters, k=32))
    rows += [(1000 + i, f"here it is {mixed} again") for i in range(2)]
    rows += [(2000 + i, f"here it is {letters} again") for i in range(300)]
    rows += [(3000, f"{''.join(name(lines[3]).upper().split('_'))} stays")]
    got = spans(secrets.find_secrets(docs(rows)))
    assert all(got[d] == [("markov", 11, 43)] for d, _ in rows if 1000 <= d < 3000)
    assert not any(k == "markov" for d, s in got.items() if not 1000 <= d < 3000 for k, _, _ in s)


def test_odd_rows(docs):
    assert secrets.find_secrets(docs(odd_rows())).count() == len(odd_rows())
    assert secrets.find_secrets(docs([])).count() == 0
    assert spans(secrets.find_secrets(docs([(1, None), (2, "")]))) == {1: [], 2: []}


def brute_base(text):
    """Each fixed pattern as the contract has it, tried at every place; matches that fail are passed over whole."""
    import re

    letters = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([*(letters(w) for w in ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    kinds = [
        (rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    found = []
    for kind, (pattern, holds) in enumerate(kinds):
        at, compiled = 0, re.compile(pattern)
        while m := compiled.search(text, at):
            if holds(m):
                found.append((m.start(), kind, m.end()))
            at = m.end()
    return sorted(found)


def test_base_spans_against_brute_force():
    rng = random.Random(31)
    parts = [
        "password", "PassWd", "sEcret", "token", "api_key", "APIKEY", "api__key", "=", ":", " ", "  ", "'", '"', "\n", "AKIA", "AKIAAKIA", "a1b2c3d4", "0" * 31,
        "f" * 33, "Zz9_-.=", "é", "ſ", "K", "x", "12345678", "AKIA" + "Z" * 12, "Secret=tokenpassword=",
    ]
    for _ in range(4_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert secrets.base_spans(text) == brute_base(text), text


def test_the_ratio_is_that_of_the_two_models(spark, docs):
    import math

    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 15))).capitalize() for _ in range(40)]
    values = ["".join(rng.choices("0123456789abcdef", k=rng.randint(32, 40))) for _ in range(30)]
    models = secrets.train(secrets.transition_counts(docs([(i, f"{n} and {n} 2024 {v} a@mail.example") for i, (n, v) in enumerate(zip(names, values + values[:10], strict=True))])))

    def logs(samples, flat):
        pairs = [p for x in samples for p in zip(["", *x], [*x, ""], strict=True)]
        size = len(secrets.ALPHABET) + 1
        single = lambda c: (sum(b == c for _, b in pairs) + 0.5) / (len(pairs) + 0.5 * size)
        each = lambda a, b: (sum(p == (a, b) for p in pairs) + 2 * single(b)) / (sum(p[0] == a for p in pairs) + 2)
        return lambda a, b: math.log((1 - flat) * each(a, b) + flat / size)

    ordinary = logs([*(n.lower() for n in {*names}), "and", "2024", "mail", "example"], 0)
    drawn = logs({*values}, 0.5)
    shapes = [3, len({*names}), 0]  # and, mail, example; the names
    for token, parts in (("AbcDefgh12_abcdEFGH", ["Abc", "Defgh", "12", "_", "abcd", "EFGH"]), ("0a1b2c3dffffffff", ["0", "a", "1", "b", "2", "c", "3", "dffffffff"])):
        assert secrets._parts(token) == parts
        wanted = sum(drawn(a, b) for a, b in zip(["", *token], [*token, ""], strict=True))
        for p in parts:
            if p == "_":
                wanted += math.log(7)
                continue
            wanted -= sum(ordinary(a, b) for a, b in zip(["", *p.lower()], [*p.lower(), ""], strict=True))
            if p.isalpha():
                wanted -= math.log((shapes[0 if p.islower() else 2 if p.isupper() and len(p) > 1 else 1] + 1) / (sum(shapes) + 3))
        assert abs(models.ratio(token) - wanted) < 1e-9


def test_recall_does_not_fall_with_the_number_of_secrets(spark):
    """Different random tokens, one a document: 20 to 2,000 of them, of which nine tenths at least are found."""
    rng = random.Random(8)
    lines = prose(2, 600)
    name = lambda x: "_".join(x.rstrip(".").split()[:5])
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]
    for n in (20, 100, 360, 2000):
        rows = [(i, f"{lines[i % 600]} {name(lines[i % 600])}{i % 50} at a@{name(lines[i % 600]).replace('_', '.')}.example.com") for i in range(max(1000, n))]
        planted = {i: "".join(rng.choices(rng.choice(alphabets), k=rng.choice([20, 32, 40]))) for i in range(n)}
        rows = [(i, f"{x} {planted[i]} end" if i in planted else x) for i, x in rows]
        text = dict(rows)
        found = spans(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")))
        hits = [(d, text[d][a:e]) for d, s in found.items() for k, a, e in s if k == "markov"]
        assert sum(planted.get(d) == t for d, t in hits) >= 0.98 * n
        assert not [x for x in hits if planted.get(x[0]) != x[1]]
