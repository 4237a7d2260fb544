"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import line_dedup, mixing, packing, simhash, toxicity
from lectern.llm.common import quoted, unused
from lectern.storage import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; null and empty texts stay.

    Equal texts share their fate, rows that repeat stay or go together, long
    texts are scored whole, columns of any name stay. Empty documents give an
    empty result; without labels all documents stay.
    """
    [name] = unused(docs, "__toxicity")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, scorer, name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of runs of 50 words or more that stand earlier; n_chars follows.

    See line_dedup.dedup_lines for nulls, empty and long texts, ties and repeated rows. Columns of any name stay.
    """
    [deleted] = unused(docs, "_deleted")
    cut = line_dedup.dedup_lines(docs, deleted=deleted)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.size(deleted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", n_chars)
    return cut.select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id.

    Null, empty and blank texts are one group; texts with the same words are
    always one; of repeated rows one stays. See simhash.first_of_each.
    """
    return simhash.first_of_each(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, a row for each copy.

    Documents without words, null texts among them, come as often as their
    source's whole epochs; a null source is one of its own; rows that repeat are
    taken as often as they appear; documents with one key are in the order of
    their doc_id. Columns of any name stay; empty documents give no rows.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are one end token; long texts are cut over sequences;
    rows that repeat are packed each; other columns are ignored; empty documents
    give no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the character models, fingerprints and token ids; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
