"""Feeds, channel configurations and storage listings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.rx import text_or_empty
from lectern.functions.text import detect_language, html_to_text, localized, normalize, sanitize
from lectern.storage import written

ITEM = (
    "title string, description string, `itunes:summary` string, pubDate string, "
    "guid struct<_isPermaLink:string,_VALUE:string>, link string, "
    "enclosure struct<_url:string,_type:string,_length:string,_VALUE:string>, `itunes:duration` string"
)
#: The same as fields of a struct.
ITEM_FIELDS = (
    "title:string,description:string,`itunes:summary`:string,pubDate:string,guid:struct<_isPermaLink:string,_VALUE:string>,link:string,"
    "enclosure:struct<_url:string,_type:string,_length:string,_VALUE:string>,`itunes:duration`:string"
)
CONFIG = (
    "language string, feed_url string, bucket_name string, storage_prefix string, voice_key string, email string, "
    "podcast_info struct<title:string,author:string,website:string,description:string,cover_art:string,rss_url:string>"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of RSS documents, every field as text. A file that can't be read stops the job: a history that is
    missing must not look like an empty one."""
    return (
        spark.read.format("xml").options(rowTag="item", mode="FAILFAST", attributePrefix="_", valueTag="_VALUE", ignoreNamespace="false")
        .schema(ITEM).load(path)
    )


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """feed (the file), pos (from 0, in document order) and the fields of the items of RSS documents.

    A row is a whole feed document before its items are taken apart, so that
    their order is known. A file that can't be read stops the job.
    """
    channels = (
        spark.read.format("xml").options(rowTag="channel", mode="FAILFAST", attributePrefix="_", valueTag="_VALUE", ignoreNamespace="false")
        .schema(f"item array<struct<{ITEM_FIELDS}>>").load(path)
    )
    return channels.select(F.input_file_name().alias("feed"), F.posexplode("item").alias("pos", "i")).select("feed", "pos", "i.*")


def literal_source(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """pos, title, summary of texts given by hand, in their order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, title string, summary string")


def entries(items: DataFrame, feed: str = "feed", pos: str = "pos", lang: Column | None = None) -> DataFrame:
    """feed, pos, title, summary, link, pub_date of feed items (feed, pos, title, summary, description, link, published).

    Titles are normalized in the given language, or that of the feed's address,
    lines kept; the summary, or else the description, becomes plain text with
    its parentheses.
    """
    lang = detect_language(None, F.col(feed)) if lang is None else lang
    # markup and references are resolved once for all languages
    plain = items.withColumn("title", normalize(F.col("title"), None, flatten=False))
    spoken = F.coalesce(localized(F.col("title"), lang, False), "title")
    return plain.select(
        feed, pos, spoken.alias("title"), html_to_text(first_text(F.col("summary"), F.col("description"))).alias("summary"),
        text_or_empty(F.col("link")).alias("link"), text_or_empty(F.col("published")).alias("pub_date"), lang.alias("lang"),
    )


def first_text(*values: Column) -> Column:
    """The first that is neither null nor empty; empty if none is."""
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def latest(rows: DataFrame, feed: str = "feed", pos: str = "pos") -> DataFrame:
    """Each feed's first entry, by position."""
    first = rows.groupBy(feed).agg(F.min_by(F.struct(*[c for c in rows.columns if c != feed]), F.struct(pos)).alias("_first"))
    return first.select(feed, "_first.*").select(*rows.columns)


def published(items: DataFrame, *keys: str) -> DataFrame:
    """keys, and the other columns of ledger rows, of a published feed's items: those with an audio address; durations
    that are no whole number and sizes up to 1 count as 0."""
    size = F.coalesce(F.col("enclosure._length").try_cast("bigint"), F.lit(0))
    return items.select(
        *keys,
        text_or_empty(F.col("title")).alias("title"),
        text_or_empty(F.col("description")).alias("description"),
        text_or_empty(F.col("enclosure._url")).alias("audio_url"),
        text_or_empty(F.col("pubDate")).alias("pub_date"),
        text_or_empty(F.col("guid._VALUE")).alias("guid"),
        F.coalesce(F.col("itunes:duration").try_cast("bigint"), F.lit(0)).alias("duration"),
        F.when(size > 1, size).otherwise(0).cast("bigint").alias("file_size"),
    ).where(F.col("audio_url") != "")


def configurations(spark: SparkSession, path: str) -> DataFrame:
    """Channel configurations from JSON files. The environment's address for e-mail goes before the file's, that for
    the bucket only where the file names none."""
    found = spark.read.schema(CONFIG).json(path, multiLine=True)
    bucket, mail = F.col("bucket_name"), os.environ.get("PODCAST_EMAIL")
    unset = (text_or_empty(bucket) == "") | F.contains(bucket, F.lit("TODO"))
    return found.withColumns(
        {
            "bucket_name": F.when(unset, F.coalesce(F.lit(os.environ.get("PODCAST_BUCKET")), bucket)).otherwise(bucket),
            "email": F.coalesce(F.lit(mail), F.col("email")),
        }
    )


def with_feed(configs: DataFrame) -> DataFrame:
    """Those that name a feed."""
    url = text_or_empty(F.col("feed_url"))
    return configs.where((url != "") & ~F.contains(url, F.lit("TODO")))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of stored files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def stored_episodes(files: DataFrame, most: int = 10) -> DataFrame:
    """seq, file, title, size of the newest audio files; seq rises with age reversed, so the newest comes first in the
    ledger. Files of the same time are told apart by name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    audio = files.select(name.alias("file"), "length", "modificationTime").where(F.col("file").endswith(".mp3"))
    newest = audio.orderBy(F.desc("modificationTime"), "file").limit(most)
    seq = F.row_number().over(Window.orderBy("modificationTime", F.desc("file")))  # at most ``most`` rows
    title = F.trim(F.substring_index("file", "_azure_", 1))
    return newest.select(
        seq.cast("bigint").alias("seq"), "file", sanitize(F.when(title == "", F.col("file")).otherwise(title)).alias("title"),
        F.col("length").alias("size"),
    )


_XML = {"rowTag": "rss", "mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreNamespace": "false", "columnNameOfCorruptRecord": "_bad"}
_RSS = f"channel struct<title:string,item:array<struct<{ITEM_FIELDS}>>>, _bad string"


def document_items(documents: DataFrame, column: str = "rss") -> tuple[DataFrame, DataFrame]:
    """(items, unreadable) of documents(channel, rss), one row a channel.

    items: channel, n_items, pos (from 0, in document order) and the item's fields.
    unreadable: channel and error of documents that are no RSS; a channel is in
    one of the two only, so that one broken document stops its own channel.
    """
    found = documents.select("channel", F.col(column).alias("_text"), F.from_xml(column, _RSS, _XML).alias("_x"))
    fails = (
        F.when(text_or_empty(F.col("_text")) == "", "the document is empty")
        .when(F.col("_x._bad").isNotNull(), "the document is no XML")
        .when(F.col("_x.channel").isNull(), "the document has no channel")
    )
    judged = found.select("channel", fails.alias("error"), F.col("_x.channel.item").alias("_items"))
    whole = F.when(F.col("error").isNull(), F.col("_items"))
    each = judged.select("channel", "error", F.size("_items").alias("n_items"), F.posexplode_outer(whole).alias("pos", "i"))
    # written, so that a document is parsed once; a filter on the error would parse it again for each of its conditions
    read = written(each.select("channel", "error", "n_items", "pos", "i.*"), "document-items")
    # a document without items, or with an error, has one row without a place
    items = read.where(F.col("error").isNull() & F.col("pos").isNotNull()).drop("error")
    return items, read.where(F.col("error").isNotNull()).select("channel", "error")


def published_ledgers(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, unreadable) of published documents(channel, rss): the first item of a channel has the largest seq."""
    items, unreadable = document_items(documents)
    placed = items.withColumn("seq", (F.col("n_items") - F.col("pos")).cast("bigint"))
    return published(placed, "channel", "seq"), unreadable


def source_entries(documents: DataFrame, lang: Column) -> tuple[DataFrame, DataFrame]:
    """(entries, unreadable) of source feeds(channel, rss): channel, lang, pos, title, summary, link, pub_date.

    lang: a column over channel, the language that titles are spoken in.
    """
    items, unreadable = document_items(documents)
    read = items.withColumn("feed", F.struct("channel", lang.alias("lang"))).select(
        "feed", "pos", "title", F.col("itunes:summary").alias("summary"), "description", "link", F.col("pubDate").alias("published")
    )
    made = entries(read, lang=F.col("feed.lang"))
    return made.select("feed.channel", "feed.lang", "pos", "title", "summary", "link", "pub_date"), unreadable
