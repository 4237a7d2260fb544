"""Runs of periodic words in whole texts, by block matching.

Words become integers. At every scale B (a power of two) the text's aligned
blocks of B words go into an Aho-Corasick automaton over integer sequences, and
the text is searched for them. A block that comes again at a distance d with
B <= d < 2 B is a seed of period d, which is extended word by word both ways. A
run of period q and three periods or more holds, for B <= q < 2 B, an aligned
block in its first period that comes again q words later, so no run is missed.

A run's words also repeat as short grams, so texts and stretches without any
gram that comes twice are passed over before.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has LEAST words or more, and PERIODS times its period or more.
LEAST, PERIODS = 6, 4
#: Texts whose results are handed on in one batch.
BATCH = 256


def _match(a: np.ndarray, i: int, j: int, most: int) -> int:
    """How many of the words from i on equal those from j on, most at most."""
    done, step = 0, 32
    while done < most:
        n = min(step, most - done)
        differ = a[i + done : i + done + n] != a[j + done : j + done + n]
        if (k := int(differ.argmax())) or differ[0]:
            return done + k
        done, step = done + n, step * 4
    return done


def _repeated(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Stretches (first, end) that all runs lie in: words in grams that come twice. Grams are compared by a 64-bit hash;
    a clash only makes a stretch longer."""
    n = len(ids)
    if n < gram + 1:
        return []
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        h = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            h = h * np.uint64(0xBF58476D1CE4E5B9) + x[k : n - gram + 1 + k]
    ranked = np.sort(h)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    begins = np.flatnonzero(twice[at] == h)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, begins, 1)
    np.add.at(depth, begins + gram, -1)
    inside = np.concatenate([[False], np.cumsum(depth[:n]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _search(names: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a text's aligned blocks of b words come: for each place the name of the block that begins there, or -1; and
    the names of the aligned blocks in order.

    names has the same for blocks of half the length. A block is a key of two such names, and a key is searched among the
    places half a block apart, so that an automaton has two letters a block and no long chains of suffixes, however often
    the text repeats itself.
    """
    n, half = len(names), b // 2
    rows = -(-n // half) + 1  # a row without names ends each column's places
    letters = np.zeros(rows * half, np.int64)
    letters[:n] = names + 1
    letters = letters.reshape(rows, half).T.ravel().tolist()
    firsts = names[: n - b + 1 : b] + 1
    seconds = names[half : n - half + 1 : b] + 1
    known: dict[tuple[int, int], int] = {}
    named = np.array([known.setdefault(k, len(known)) for k in zip(firsts.tolist(), seconds.tolist(), strict=True)], np.int64)
    blocks = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, name in known.items():
        blocks.add_word(key, name)
    blocks.make_automaton()
    hits = np.array(list(blocks.iter(tuple(letters))), np.int64).reshape(-1, 2)
    column, row = np.divmod(hits[:, 0] - 1, rows)
    out = np.full(n, -1, np.int64)
    out[row * half + column] = hits[:, 1]
    return out, named


def periodic(ids: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ids, by start, then period.

    A run is a stretch whose smallest period is q, with max(least, periods * q) words or more, that can't be made longer
    at either end without losing the period. periods is 3 or more.
    """
    if periods < 3 or least < 2:
        raise ValueError("a run needs three periods or more, and two words or more")
    found: set[tuple[int, int, int]] = set()
    gram = min(max(least - q, (periods - 1) * q) for q in range(1, least + 1))
    for a, e in _repeated(ids, min(gram, 8)):
        part = ids[a:e]
        found |= {(a + s, n, q) for s, n, q in _runs(part, least, periods)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def _runs(part: np.ndarray, least: int, periods: int) -> list[tuple[int, int, int]]:
    n, back = len(part), part[::-1]
    found: list[tuple[int, int, int]] = []
    # for each word the furthest end of a run of a smaller scale that holds it: of all, and of those two scales below
    reach, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    b, names, named = 1, part, part
    while b * periods <= n:
        if b > 1:
            names, named = _search(names, b)
        # for each place the one aligned block that begins b to 2 b - 1 words before
        at = np.flatnonzero(names >= 0)
        at = at[at >= b]
        if not len(at[at % b != 0]) and b > 1 and len(np.unique(named)) == len(named):
            break  # no block comes again, so no larger one does
        j = at // b - 1
        same = named[j] == names[at]
        s, d = j[same] * b, (at - j * b)[same]
        # in a run of smaller period, d words and a block long: the whole stretch has that period
        open_ = reach[s] < s + d + b
        s, d = s[open_], d[open_]
        # in a run of period b / 2 or less that holds the block: a stretch of period d that is none goes on over its end
        end = before[s]
        beyond = np.minimum(end + d, n - 1)
        over = (end < s + b) | ((end + d < n) & (part[np.minimum(end, n - 1)] == part[beyond]))
        new: list[tuple[int, int, int]] = []
        done: dict[int, int] = {}
        for s, d in zip(s[over].tolist(), d[over].tolist(), strict=True):
            # equal words at distance d up to here are one stretch, which has been looked at
            if s < done.get(d, 0):
                continue
            right = s + _match(part, s, s + d, n - s - d)
            left = s - _match(back, n - s, n - s - d, s)
            done[d] = right
            length = right - left + d
            if length >= max(least, periods * d) and reach[left] < left + length:
                new.append((left, length, d))
        found += new
        before = reach.copy()
        for s, length, _ in new:
            np.maximum(reach[s : s + length], s + length, out=reach[s : s + length])
        b *= 2
    return found


def periodic_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, runs and collapsed of every row of docs (doc_id, text).

    runs: array of (start, length, period) in words, numbered from 0, by start, then period; see ``periodic``. collapsed:
    the words that no run holds after its first period, joined by one space. Words are runs of characters other than
    ASCII white space. Null, empty and blank texts have no runs and an empty collapsed text; a null doc_id stays null;
    repeated rows give a row each; other columns are ignored; an empty table gives no rows. Texts are taken whole: a text
    of n words takes n log n steps, and memory for one scale's blocks at a time, some 100 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                some = b.slice(k, BATCH)
                runs, rest = [], []
                for text in some.column(1):
                    # bytes are split at ASCII white space only
                    words = (text.as_py() or b"").split()
                    index: dict[bytes, int] = {}
                    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
                    got = periodic(ids, least, periods)
                    if got:
                        kept = np.ones(len(words), bool)
                        for s, n, q in got:
                            kept[s + q : s + n] = False
                        words = [words[i] for i in np.flatnonzero(kept).tolist()]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                    rest.append(b" ".join(words).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(runs, RUNS), pa.array(rest, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
