import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import packing
from tests.llm.conftest import odd_rows, prose


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_every_id_lies_in_one_piece_and_windows_are_powers_of_two(lengths):
    stream = ((i, np.arange(n, dtype="<u4")) for i, n in enumerate(lengths))
    seen = defaultdict(list)
    short = 0
    for window in packing.pack_stream(stream):
        size = sum(len(p.ids) for p in window)
        assert size & (size - 1) == 0 and 0 < size <= 2048
        short += size < packing.TIERS[0]
        for p in window:
            assert (p.ids == np.arange(p.start, p.start + len(p.ids))).all()
            seen[p.doc].append((p.start, len(p.ids)))
    assert short <= 8
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[i]):
            assert start == at
            at += size
        assert at == n


def test_pack_round_trip(docs):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, x) for i, x in enumerate(prose(5, 80))] + [(100, "a <|endoftext|> b"), (101, "\n".join(prose(6, 300)))]
    rows += [(200 + i, r[1]) for i, r in enumerate(odd_rows())]
    text = dict(rows)
    ids = {d: np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in text.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs(rows)).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
    for d, found in pieces.items():
        assert sum(r.length for r in found) == len(ids[d])
    assert set(pieces) == set(text)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == found[0].tier and at & (at - 1) == 0


def test_empty(docs):
    assert packing.pack(docs([])).count() == 0
    assert [r.doc_tokens for r in packing.pack(docs([(1, None)])).collect()] == [1]


def test_step_groups_are_balanced_over_partitions(spark, docs):
    rows = [(i, x) for i, x in enumerate(prose(15, 1600))]
    got = packing.pack(docs(rows).repartition(7)).collect()
    assert len({r.sequence_id >> 33 for r in got}) == 7
    tokens, tiers = defaultdict(int), defaultdict(set)
    for r in got:
        tokens[r.step_group] += r.length
        tiers[r.step_group].add(r.tier)
    n = len(tokens)
    assert n > 3 and sorted(tokens) == list(range(n))
    assert all(tokens[g] == packing.STEP for g in range(n - 1)) and 0 < tokens[n - 1] <= packing.STEP
    assert [max(tiers[g]) for g in range(n)] == sorted((max(tiers[g]) for g in range(n)), reverse=True)
    assert sum(len(t) > 1 for t in tiers.values()) < 4
    groups = defaultdict(set)
    for r in got:
        groups[r.sequence_id].add(r.step_group)
    assert all(len(g) == 1 for g in groups.values())
