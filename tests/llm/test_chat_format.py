import random

import pytest

from lectern.llm import chat_format
from lectern.llm.chat_format import TEMPLATE, format_conversations, read_back, read_turn

SCHEMA = "conv_id long, turn long, role string, text string, at string, state string, tie string, segments string, `_range` string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in data], SCHEMA)


def parts(rng):
    return "".join(rng.choice(["[INST]", "[/INST]", "</s>", "<s>", "[", "<", "\\", "\\\\", " ", "/INST]", "a", "é\n", "[ROLE]", "[\\/ANS]"]) for _ in range(rng.randint(0, 12)))


def test_any_text_and_role_reads_back(spark):
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "tool", "", "[/ROLE] [TURN]", "\\"]
    data = [(c, t, rng.choice(roles), parts(rng)) for c in range(60) for t in range(6)]
    rows = format_conversations(frame(spark, data)).orderBy("at").collect()
    assert [(r.conv_id, *read_turn("".join(s.text for s in r.segments))) for r in rows] == [(c, r, x) for c, _, r, x in data]
    for r in rows:
        learnt = [s.text for s in r.segments if s.learn]
        assert len(learnt) == (r.role == "assistant")
        controls = sum("".join(s.text for s in r.segments).count(m) for m in TEMPLATE.controls)
        assert controls == (2 if r.role in TEMPLATE.turns else 4) + (r.state == chat_format.START)


def test_machine(spark):
    data = [(1, t, r, "x") for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    data += [(2, t, r, "x") for t, r in enumerate(["assistant", "assistant", "user", "system", "user", "tool", "user"])]
    rows = format_conversations(frame(spark, data)).orderBy("at").collect()
    assert [r.valid for r in rows] == [True] * 5 + [False, False, True, False, True, False, False]
    first = "".join(s.text for r in rows[:5] for s in r.segments)
    assert first == "<s>[SYS] x [/SYS][INST] x [/INST][ANS] x </s>[INST] x [/INST][ANS] x </s>"


def test_odd_rows(spark):
    data = [(None, 0, "user", "no id"), (None, None, None, None), (1, None, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (2, 1, "user", "w " * 200_000)]
    rows = format_conversations(frame(spark, data)).orderBy("at").collect()
    assert [(r.conv_id, r.role) for r in rows] == [(None, ""), (None, "user"), (1, "assistant"), (1, "user"), (1, "user"), (2, "user")]
    got = {r.conv_id: r for r in read_back(format_conversations(frame(spark, data))).collect()}
    assert {c: (r.n_turns, r.loss_chars) for c, r in got.items()} == {None: (2, 0), 1: (3, 1), 2: (1, 0)}
    assert got[2].formatted_chars == 400_000 + len("<s>[INST]  [/INST]")
    assert format_conversations(frame(spark, [])).count() == 0


def test_state_goes_on_over_ranges(spark):
    data = [(1, t, ["user", "assistant"][t % 2], "x") for t in range(2000)] + [(2, 0, "user", "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = format_conversations(frame(spark, data)).collect()
        assert len({r.at >> 33 for r in rows}) > 2 and all(r.valid for r in rows)
        assert sum(r.state == chat_format.START for r in rows) == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat_format.Template({"user": chat_format.Turn("user:", "[/U]")}, TEMPLATE.named, TEMPLATE.other, {}, "<s>").controls  # noqa: B018
