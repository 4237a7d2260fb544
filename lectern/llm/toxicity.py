"""Toxicity by noisy-channel deobfuscation.

A token that leetspeak, spacing or repetition may have disguised becomes a
lattice of characters: a digit or sign stands for itself, for the letters it
looks like or for nothing, a run of one letter for one or two of it, a gap
between spaced letters for nothing or for the edge of a word. A Viterbi search
under a character language model restores the likeliest reading; the other
tokens have one path only and are taken as they are. Restored words are looked
up in a lexicon of words that labelled texts tie to toxicity, and a calibrated
sum of what they say is the score.

The language model counts character triples of all documents: one table of
fixed size for each partition, summed up. The lexicon is fitted on a bounded
sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import quoted
from lectern.storage import written

#: The classifier is fitted on at most this many labelled rows, those with the least hashes of doc_id.
MAX_LABELLED = 200_000
THRESHOLD = 0.3

# Symbols of the language model: an edge, a to z, any other letter.
_OTHER = 27
_N = 28
#: What a character of a disguised word may stand for, and the cost of each reading.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "&": "a", "%": "o",
}
#: A starred letter is mostly a vowel.
_STARRED = {"*": "aeiou", "#": "aeiou"}
#: Costs: a look-alike, a starred letter, leaving out a look-alike, leaving out any other sign, a run cut short, a letter
#: written twice taken once.
_SWAP, _STAR, _DROP, _SILENT, _SINGLE, _HALVED = -1.0, -1.0, -8.0, -0.5, -0.3, -3.0
_EDGES = ".,;:!?\"'()[]{}<>|#*&%$-_=+/\\~`^«»„“”‘’…"
_SPACED = re.compile(r"(?<!\S)(?:\w[ ._\-*]){2,}\w(?![^\s.,;:!?])")
#: Stands for the gap between two spaced letters, and read as a space for the edge of a word.
_GAP = "\x00"
_DOUBLED = re.compile(r"([^\W\d_])\1")


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(len(codes), dtype=np.int64)
    small = (codes >= 97) & (codes <= 122)
    out[small] = codes[small] - 96
    out[(codes >= 0xC0) & (codes < 0x2000) & (codes != 0xD7) & (codes != 0xF7)] = _OTHER
    return out


def triple_counts(docs: DataFrame) -> DataFrame:
    """triple, n: how often three symbols follow each other, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_N**3, dtype=np.int64)
        for b in batches:
            for x in b.column("text"):
                s = _symbols((x.as_py() or "").lower())
                if len(s):
                    s = np.concatenate([[0, 0], s, [0]])
                    counts += np.bincount((s[:-2] * _N + s[1:-1]) * _N + s[2:], minlength=_N**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["triple", "n"])

    text = docs.select(F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first, second), smoothed by shorter histories."""
    c3 = counts.reshape(_N, _N, _N).astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + _N)
    p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 20)
    return np.log(p3)


def word_counts(words: Iterable[str]) -> np.ndarray:
    """The triple counts of single words."""
    counts = np.zeros(_N**3, dtype=np.int64)
    for w in words:
        s = np.concatenate([[0, 0], _symbols(w), [0]])
        counts += np.bincount((s[:-2] * _N + s[1:-1]) * _N + s[2:], minlength=_N**3)
    return counts


def _readings(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of one character: the strings it may stand for, with their costs."""
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = m[1], len(m[0])
        if c == _GAP:
            yield [("", 0.0), (" ", 0.0)]
        elif c.isalpha():
            if n == 1:
                yield [(c, 0.0)]
            else:  # what is written twice is mostly meant so
                yield [(c, _SINGLE if n > 2 else _HALVED), (c * 2, _SINGLE if n > 2 else 0.0)]
        else:
            found = [(x, _SWAP) for x in LOOKS_LIKE.get(c, "")]
            if n > 1:
                found += [(x * 2, _SWAP) for x in LOOKS_LIKE.get(c, "")]
            found += [(x, _STAR) for x in _STARRED.get(c, "")]
            yield [*found, ("", _DROP * min(n, 2) if found else _SILENT)]


def decode(token: str, model: np.ndarray | list) -> str:
    """The likeliest reading of a disguised token: Viterbi over its lattice, with pairs of symbols as states.

    Each step keeps the best way into a state and points back to where it came
    from, so a token takes time and memory in proportion to its length.
    """
    table = model.tolist() if isinstance(model, np.ndarray) else model  # lists are faster to look up in
    scores: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for readings in _readings(token):
        following: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, score in scores.items():
            for letters, cost in readings:
                (x, y), total = state, score + cost
                for c in letters:
                    if c == " ":
                        total += table[x][y][0]
                        x = y = 0
                        continue
                    code = ord(c)
                    z = code - 96 if 97 <= code <= 122 else _OTHER
                    total += table[x][y][z]
                    x, y = y, z
                if (x, y) not in following or following[x, y] < total:
                    following[x, y], came[x, y] = total, (state, letters)
        scores = following
        back.append(came)
    state = max(scores, key=lambda s: scores[s] + table[s[0]][s[1]][0])
    out = []
    for came in reversed(back):
        state, letters = came[state]
        out.append(letters)
    return "".join(reversed(out))


def plain_words(text: str) -> tuple[set[str], set[str]]:
    """The words of a text as they are, lower-cased, and the tokens that may be disguised."""
    low = text.lower()
    plain, disguised = set(), set()
    for token in set(low.split()):
        if token.isalpha():
            plain.add(token)
            if _DOUBLED.search(token):
                disguised.add(token)
            continue
        word = token.strip(_EDGES)
        if word.isalpha():
            plain.add(word)
        # a sign at the edge may be a letter of the word: @ss, cla$$
        core = token.strip(_EDGES.replace("$", "").replace("!", "") if not token.endswith(("!!", "$$$")) else _EDGES)
        if len(core) > 2 and (not core.isalpha() or _DOUBLED.search(core)) and any(c.isalpha() for c in core):
            disguised.add(core)
    for m in _SPACED.finditer(low):
        letters = re.sub(r"[ ._\-*]", "", m[0])
        if len(set(letters)) > 1:
            # words may begin and end at every gap; or it is one word, with one of a single letter before or after it
            disguised.add(_GAP.join(letters))
            disguised.update(x for a in (0, 1) for b in (0, 1) if len(x := letters[a : len(letters) - b]) > 2)
    return plain, disguised


#: Texts of which a task holds the words at a time.
_ROWS = 256
#: Readings of short tokens that a task keeps at hand; longer ones hardly come again.
_KEPT, _SHORT = 100_000, 64


def restored(text: str, model: np.ndarray | list, known: dict[str, str]) -> set[str]:
    """All words of a text, disguised ones also as restored. known: readings of tokens seen before."""
    plain, disguised = plain_words(text)
    for token in disguised:
        reading = known.get(token)
        if reading is None:
            reading = decode(token, model)
            if len(token) <= _SHORT:
                if len(known) > _KEPT:
                    known.clear()
                known[token] = reading
        plain.update(w for w in reading.split(" ") if w and (len(w) > 1 or _GAP not in token))
    return plain


class Scorer(NamedTuple):
    """What a scan needs: the language model, the lexicon's log odds, and the calibration."""

    model: np.ndarray
    weights: dict[str, float]
    bias: float
    scale: float


def _evidence(words: set[str], weights: dict[str, float]) -> float:
    """The strongest word counts fully, others by half less each: long texts don't add up to toxicity."""
    found = sorted((weights[w] for w in words if w in weights), reverse=True)
    return sum(x / (1 << min(i, 30)) for i, x in enumerate(found))


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4; null for a null doc_id, which no label can name."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> Scorer:
    """Language model over all docs; lexicon and calibration from labelled rows that are not held out.

    labels: doc_id, toxic (0, 1; rows with null are left out). Repeated labels
    of a document count once, as toxic if any says so. held_out: a condition on
    doc_id. Only texts and labels are used. Repeated texts train as one, toxic
    if all their labels say so; null texts count as empty; whole texts are read,
    in time proportional to their length. Of words with equal evidence none is
    preferred: all that pass the test are in the lexicon. Without documents or
    labels every text scores as one that is likely clean.
    """
    counts = np.zeros(_N**3, dtype=np.int64)
    for r in triple_counts(docs).collect():  # at most _N ** 3 rows
        counts[r["triple"]] = r["n"]
    corpus = language_model(counts)
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    train = marked if held_out is None else marked.where(~F.coalesce(held_out, F.lit(False)))
    train = train.orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # copies of a text would count its words as often: one row for each text
    joined = (
        rows.join(F.broadcast(train), F.col("doc_id") == F.col("_id"))  # MAX_LABELLED rows of two numbers at most
        .groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
        .agg(F.min("_toxic").alias("toxic"), F.first("text").alias("text"))
    )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = {}, corpus.tolist()
        for b in (b.slice(i, _ROWS) for b in batches for i in range(0, len(b), _ROWS)):
            texts = [sorted(restored(x.as_py() or "", table, known)) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("toxic"), pa.array(texts, pa.list_(pa.string()))], ["h", "toxic", "words"]
            )

    bags = written(
        joined.select("h", "toxic", "text").mapInArrow(words, "h long, toxic int, words array<string>"), "toxic-bags"
    )
    total = bags.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, toxic = total["n"], total["toxic"]
    base = (toxic + 0.2) / (n + 10)  # few labels say little, and then toxicity is taken to be rare
    # a word belongs to the lexicon if its share of toxic texts is far beyond chance
    spread = F.sqrt(F.col("n") * F.lit(base * (1 - base)))
    stats = (
        bags.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
        .where((F.col("t") >= 4) & (F.col("t") > 3 * base * F.col("n")) & (F.col("t") - base * F.col("n") > 5 * spread))
        .collect()
    )  # words of MAX_LABELLED texts at most
    odds = math.log(base / (1 - base))
    weights = {}
    for r in stats:
        p = (r["t"] + base) / (r["n"] + 1)
        weights[r["word"]] = math.log(p / (1 - p)) - odds
    # a restored word may have one letter where the word has two
    for word, weight in list(weights.items()):
        weights.setdefault(re.sub(r"(.)\1", r"\1", word), weight - 0.5)
    # what is left if no word of the lexicon occurs, and how much the sum of evidence is worth

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [_evidence(set(w.as_py() or ()), weights) for w in b.column("words")]
            step = np.minimum(np.floor(np.array(values, dtype=float) * 4), 400).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), b.column("toxic")], ["step", "toxic"])

    table = (
        bags.select("words", "toxic")
        .mapInArrow(evidence, "step long, toxic int")
        .groupBy("step")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
        .collect()
    )  # at most 401 rows
    bias, scale = calibrate([(r["step"] / 4 + 0.125 * (r["step"] > 0), r["n"], r["t"]) for r in table], odds)
    strong = [w for w, x in weights.items() if x > 2]
    lexical = word_counts(strong)
    if lexical.sum():
        # disguised words are likelier words that are worth disguising
        corpus = np.log(0.7 * np.exp(corpus) + 0.3 * np.exp(language_model(lexical)))
    return Scorer(corpus, weights, bias, scale)


def calibrate(table: list[tuple[float, int, int]], odds: float, rounds: int = 60) -> tuple[float, float]:
    """bias and scale of the logistic curve through (evidence, rows, toxic rows), by Newton's steps, kept rising."""
    if not table:
        return odds, 1.0
    x, n, t = (np.array(c, dtype=float) for c in zip(*table, strict=True))
    bias, scale = odds - 1, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + scale * x, -30, 30)))
        w = n * p * (1 - p)
        # a weak pull towards what the evidence says as it stands
        g = np.array([(t - n * p).sum() - 0.1 * (bias - odds + 1), ((t - n * p) * x).sum() - 1.0 * (scale - 1)])
        h = np.array([[w.sum() + 0.1, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1.0]])
        step = np.linalg.solve(h, g)
        bias, scale = bias + np.clip(step[0], -2, 2), max(0.05, scale + np.clip(step[1], -0.5, 0.5))
    return float(bias), float(scale)


def score(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """The columns of docs and ``name``, 0 to 1: how likely the text would be labelled toxic.

    A column of docs with that name is replaced, all others stay whatever their
    names. Null and empty texts score what texts without any listed word do, and
    equal texts score alike. Every row is kept, repeated ones as often as they
    appear; an empty table stays empty. Only ``text`` is looked at, and all of
    it, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # a matrix of fixed size, and words of MAX_LABELLED texts
    kept = [c for c in docs.columns if c != name]
    # mapInArrow looks columns up by their names, so that names with dots or ticks would fail there
    plain = docs.select(*map(quoted, kept)).toDF(*[f"c{i}" for i in range(len(kept))])
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, known = shared.value, {}
        table = s.model.tolist()
        for b in batches:
            values = []
            for x in b.column(place).cast(pa.string()):
                e = _evidence(restored(x.as_py() or "", table, known), s.weights)
                values.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s.bias + s.scale * e)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64())], [*b.schema.names, "score"])

    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*kept, name)
