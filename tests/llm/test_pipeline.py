import os
import re
from collections import defaultdict

import corpus_pipeline
from lectern.llm import common
from lectern.llm.common import quoted
from lectern.storage import written
from tests.llm.conftest import odd_rows, prose
from tests.llm.test_line_dedup import brute as deduped

BAD = "grumblewort"


def test_stages(spark, docs, tmp_path):
    lines = prose(11, 900)
    texts = ["\n".join(lines[3 * i : 3 * i + 3]) for i in range(300)]
    rows = [(i, f"{x} {BAD} {BAD}" if i % 5 == 0 else x, f"s{i % 4}") for i, x in enumerate(texts)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(500, texts[1], "s0"), (501, f"start\n{passage}"), (502, f"other\n{passage}"), (503, "short copy here"), (504, "short copy here")]
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = docs(rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, df, str(tmp_path)), f"test-{name}")
        if name != "packing":
            assert out.columns == df.columns
        seen[name] = out.collect()
        df = out
    text = {d: t for d, t, *_ in rows}
    clean = {d for d in text if BAD not in text[d]}
    assert {r.doc_id for r in seen["toxicity"]} == clean
    wanted = deduped([(d, text[d]) for d in sorted(clean)])
    assert {r.doc_id: r.text for r in seen["line_dedup"]} == {d: t for (d, _), t in wanted.items()}
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    near = {r.doc_id for r in seen["near_dedup"]}
    assert 503 in near and 504 not in near and {d for d in clean if d < 300} <= near
    copies = defaultdict(int)
    for r in seen["mixing"]:
        copies[r.doc_id] += 1
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert set(copies) <= near and max(copies.values()) <= 2
    assert abs(words(seen["mixing"]) - 1.5 * words(seen["near_dedup"])) < 500
    tokens = {(r.doc_id, r.doc_tokens) for r in seen["packing"]}
    assert {d for d, _ in tokens} == set(copies)
    assert sum(r.length for r in seen["packing"]) == sum(n * copies[d] for d, n in tokens)


def test_odd_rows(spark, docs, tmp_path):
    docs(odd_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "mixing", "packing",
    ]


def test_empty_tables(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def internal_names():
    """Every name that a module of the subpackage writes down, and some that no code expects."""
    found = set()
    for module in ("common", "line_dedup", "mixing", "simhash", "toxicity", "ordered"):
        with open(os.path.join(os.path.dirname(common.__file__), f"{module}.py")) as f:
            found |= set(re.findall(r'"([A-Za-z_][A-Za-z_0-9]*)"', f.read()))
    found |= {"__toxicity", "a.b", "`tick`", "with space", "_mix_source_", "_line_t_"}
    seen = {"doc_id", "text", "lang", "source", "n_chars"}
    return [n for n in sorted(found) if n.lower() not in seen and not seen.add(n.lower())]


def test_stages_keep_the_values_of_columns_of_any_name(spark, tmp_path):
    names = internal_names()
    assert {"__raw", "_mix_copy", "_line_ranges", "_deleted", "key", "row"} <= set(names)
    lines = prose(12, 60)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{lines[i]}\n{passage}" if i % 9 == 0 else f"{lines[i]} {BAD}" if i % 7 == 0 else lines[i]) for i in range(60)]
    rows += [(100, lines[1]), (101, lines[1])]
    data = [(i, t, "en", f"s{i % 3}", len(t), *[f"{n} of {i}" for n in names]) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{quoted(n)} string" for n in names)
    df = spark.createDataFrame(data, schema)
    spark.createDataFrame([(i, int(i % 7 == 0 and i % 9 > 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = df.count()
        df = written(stage(spark, df, str(tmp_path)), f"test-{name}")
        got = df.collect()
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert 0 < len(got) and (len(got) < before or name in ("line_dedup", "mixing"))
        for r in got:
            assert r[2:4] == ("en", f"s{r[0] % 3}") and list(r[5:]) == [f"{n} of {r[0]}" for n in names]
