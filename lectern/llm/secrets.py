"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The fixed patterns find assignments, access keys and long hexadecimal runs: the
labelled samples of random strings. Words of up to 15 letters and numbers of up
to 6 digits that stand alone, and host names, are the labelled samples of what
identifiers are made of; no secret is so short, so it doesn't matter how many secrets of unknown
form the documents hold. From both, over all documents, character transitions
are counted, once for each different sample.

Every long token that no fixed pattern touches is judged by the log-likelihood
ratio of the two models. The ordinary one reads an identifier as parts: it is
cut at separators, between letters and digits and where small letters are
followed by a capital, and each part begins and ends like a word.

Only samples are shuffled, those of a batch once each; counting leaves one
bounded table a partition, and what is shipped to the scan are two transition
matrices of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "markov")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens of which the models are trained and which they judge.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9+/_=-])")
LEAST = 16
#: What follows @ or :// names a host: a labelled ordinary identifier, which isn't judged.
HOST = re.compile(r"[A-Za-z0-9.-]*[+/_=]*")
#: Runs of the characters of tokens, and which of them, without the separators around, are ordinary samples.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
WORD = re.compile(r"[A-Za-z]{2,15}|[0-9]{1,6}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[+/_.=-]")
SEPARATORS = "+/_.=-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_N = len(ALPHABET) + 1  # and the edge of a token
_CODE = np.zeros(128, dtype=np.intp)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns' matches, sorted; leftmost non-overlapping for each kind.

    A run of the class that ends a pattern is as long as it can be, so a length
    asked of the run is part of the pattern; for assignments, whose failing
    matches use up text, it is asked afterwards.
    """
    spans = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                spans.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _tokens(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Long tokens that no span touches, and of those that begin with a host name what follows it. spans are sorted, so
    one pass over both is enough."""
    at, reach = 0, 0
    for m in TOKEN.finditer(text):
        a, e = m.span()
        while at < len(spans) and spans[at][0] < e:
            reach = max(reach, spans[at][2])
            at += 1
        if reach > a:
            continue
        if text[a - 1 : a] == "@" or text[max(a - 3, 0) : a] == "://":
            a = HOST.match(text, a, e).end()
        if e - a >= LEAST:
            yield a, e


def _codes(token: str) -> np.ndarray:
    inner = _CODE[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
    return np.concatenate([[0], inner, [0]])


def _secret_value(text: str, span: tuple[int, int, int]) -> str:
    a, kind, b = span
    if kind:
        return text[a:b]
    m = ASSIGN.match(text, a)
    return m[2] if m else text[a:b]


def _word(run: str) -> str | None:
    """The word or number that stands alone between separators."""
    word = run.strip(SEPARATORS)
    return word if len(word) <= 15 and WORD.fullmatch(word) else None


def _samples(text: str, spans: list[tuple[int, int, int]]) -> Iterator[str]:
    """The words and numbers of a text that stand alone, and the host names, that no span touches."""
    at, reach = 0, 0
    for m in RUN.finditer(text):
        a, e = m.span()
        while at < len(spans) and spans[at][0] < e:
            reach = max(reach, spans[at][2])
            at += 1
        if reach > a:
            continue
        if text[a - 1 : a] == "@" or text[max(a - 3, 0) : a] == "://":
            yield HOST.match(text, a, e)[0]
        elif word := _word(m[0]):
            yield word


def _parts(token: str) -> list[str]:
    """What an identifier is made of: words, numbers and separators."""
    return PART.findall(token)


def _shape(part: str) -> int:
    return 0 if part.islower() else 2 if part.isupper() and len(part) > 1 else 1


def transition_counts(docs: DataFrame) -> DataFrame:
    """model, pair, n: for model 0 (ordinary) and 1 (random) the character transitions (first * size + second) of each
    different sample; for model 2 how many words are small, capitalized and in capitals (pair 0, 1, 2)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, runs = set(), set()
            for x in b.column("text"):
                text = x.as_py() or ""
                spans = base_spans(text)
                if not spans and "@" not in text and "://" not in text:
                    runs.update(RUN.findall(text))  # nothing to leave out: each different run is looked at once
                    continue
                found.update((1, _secret_value(text, s)) for s in spans)
                found.update((0, w) for w in _samples(text, spans))
            found.update((0, w) for r in runs if (w := _word(r)))
            columns = [pa.array([m for m, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["model", "token"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, _N * _N), dtype=np.int64)
        for b in batches:
            tokens: list[list[str]] = [[], []]
            for model, token in zip(b.column("model").to_pylist(), b.column("token").to_pylist(), strict=True):
                for part in [p for p in _parts(token) if p not in SEPARATORS] if model == 0 else [token]:
                    tokens[model].append(part.lower() if model == 0 else part)
                    if model == 0 and part.isalpha():
                        counts[2, _shape(part)] += 1
            for model, some in enumerate(tokens):
                if some:
                    c = np.concatenate([_CODE[np.frombuffer(" ".join(some).encode("ascii"), dtype=np.uint8)], [0]])
                    counts[model] += np.bincount(np.concatenate([[0], c[:-1]]) * _N + c, minlength=_N * _N)
        model, pair = np.nonzero(counts)
        columns = [pa.array(model, pa.int64()), pa.array(pair, pa.int64()), pa.array(counts[model, pair], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["model", "pair", "n"])

    text = docs.select(F.col("text").cast("string").alias("text"))
    tokens = text.mapInArrow(find, "model long, token string").distinct()
    counted = tokens.mapInArrow(count, "model long, pair long, n long")
    return counted.groupBy("model", "pair").agg(F.sum("n").alias("n"))


class Models(NamedTuple):
    """Log probabilities: of a character after another in ordinary words and numbers and in random strings, and of a
    word's shape."""

    ordinary: np.ndarray
    random: np.ndarray
    shape: np.ndarray

    def likelihood(self, token: str) -> float:
        """Of an ordinary identifier: each part from edge to edge, a word's shape, and which separator stands between."""
        total = 0.0
        for part in _parts(token):
            if part in SEPARATORS:
                total -= np.log(len(SEPARATORS) + 1)
                continue
            c = _codes(part.lower())
            total += self.ordinary[c[:-1], c[1:]].sum()
            if part.isalpha():
                total += self.shape[_shape(part)]
        return float(total)

    def ratio(self, token: str) -> float:
        """The log-likelihood ratio, random against ordinary."""
        c = _codes(token)
        return float(self.random[c[:-1], c[1:]].sum()) - self.likelihood(token)


def train(counts: DataFrame, flat: float = 0.5) -> Models:
    """The models from transition counts, smoothed by how often a character occurs at all.

    The random model is mixed with ``flat`` parts of uniform choice: secrets
    that the patterns don't know use other alphabets. counts has at most two
    numbers for each pair of characters and three shapes, whatever the size of the corpus.
    """
    found = np.zeros((3, _N * _N))
    for r in counts.collect():
        found[r["model"], r["pair"]] = r["n"]
    ordinary, random = found[:2].reshape(2, _N, _N)
    single = [(x.sum(axis=0) + 0.5) / (x.sum() + 0.5 * _N) for x in (ordinary, random)]
    usual = (ordinary + 2 * single[0]) / (ordinary.sum(axis=1, keepdims=True) + 2)
    drawn = (random + 2 * single[1]) / (random.sum(axis=1, keepdims=True) + 2)
    shape = (found[2, :3] + 1) / (found[2, :3].sum() + 3)
    return Models(np.log(usual), np.log((1 - flat) * drawn + flat / _N), np.log(shape))


def scan(docs: DataFrame, models: Models, least: float = 12.0, least_each: float = 0.6) -> DataFrame:
    """doc_id, spans: array of (kind, start, end), code points, end exclusive, by start and then kind.

    A token of 16 characters or more that holds a letter, that no fixed
    pattern touches, and that is no host name (after @ or ://), is added as ``markov`` if its log-likelihood
    ratio is at least ``least``, and ``least_each`` a character. Null text
    counts as empty. Every row is kept, repeated ones as often as they appear,
    and equal tokens are judged alike. Spans of different kinds that start
    together are in the order of KINDS. Whole texts are read, in time
    proportional to their length. An empty table gives no rows; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("text"):
                text = x.as_py() or ""
                spans = base_spans(text)
                for a, e in list(_tokens(text, spans)):
                    token = text[a:e]
                    if not re.search("[A-Za-z]", token):
                        continue
                    score = models.ratio(token)
                    if score >= least and score >= least_each * len(token):
                        spans.append((a, 3, e))
                out.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def find_secrets(docs: DataFrame, **options) -> DataFrame:
    """doc_id and spans of every row of docs, by models trained on the same rows. See scan."""
    return scan(docs, train(transition_counts(docs)), **options)

