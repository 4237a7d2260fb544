import random

import pytest

#: Columns that operators use inside, to clash with.
CLASH = (
    "doc", "t", "pos", "ranges", "fp", "key", "words", "size", "source_size", "target", "taken", "h", "n", "line", "score",
    "failed", "spans", "_deleted", "id", "_id", "__raw", "a", "b", "raw", "reach", "at", "base", "proposed", "best", "range", "node", "component", "u", "v", "first", "least", "block", "before",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def frame(spark, rows):
    """Documents from (doc_id, text[, source]) with clashing extra columns."""
    full = []
    for r in rows:
        doc_id, text, source = (*r, "s1")[:3]
        full.append((doc_id, text, "en", source, None if text is None else len(text), *("x" for _ in CLASH)))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda rows: frame(spark, rows)


def odd_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows and rows with one id."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "the same words here"), (6, "the same words here"),
        (5, "the same words here"), (None, "no id at all"), (None, None), (7, "w " * 60_000), (8, "x" * 120_000),
        (9, "two ids"), (9, "one id, another text"), (10, "ünïcödé 😀 \x00 \u2028 end", None), (11, "a\n" * 3_000, ""),
    ]


def prose(seed, n, vocabulary=400):
    """n lines of invented words."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return ["{}.".format(" ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for _ in range(n)]
