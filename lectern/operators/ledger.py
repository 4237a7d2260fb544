"""The feed ledger: which entries are new, how they are appended, what is kept.

A ledger row is channel, seq, title, description, audio_url, pub_date, guid,
duration, file_size. Order is data: the largest seq of a channel comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rx import strip, text_or_empty
from lectern.functions.text import sanitize, stored_path, title_key
from lectern.operators.ranks import numbered_rows

#: Episodes that a channel keeps.
KEEP = 180


def _key(title: Column) -> Column:
    # stored titles are sanitized, so candidates are compared sanitized too
    return title_key(sanitize(title))


def new_entries(entries: DataFrame, history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Entries (title, link) of which history (title, guid) has neither the title's key nor, if there is one, the link.

    by: columns, such as a channel, within which histories are apart. Two anti
    joins on one key each rather than one on either. Entries of one batch are
    not compared with each other.
    """
    titles = history.select(*by, _key(F.col("title")).alias("_title")).distinct()
    guids = history.select(*by, F.col("guid").alias("_guid")).where(F.col("_guid") != "").distinct()
    fresh = entries.withColumn("_title", _key(F.col("title"))).join(titles, [*by, "_title"], "left_anti")
    link = F.when(F.col("link") != "", F.col("link"))
    return fresh.withColumn("_guid", link).join(guids, [*by, "_guid"], "left_anti").select(*entries.columns)


def with_known(entries: DataFrame, history: DataFrame, by: tuple[str, ...] = (), force: Column | None = None, titles: bool = True) -> DataFrame:
    """entries with ``skipped``: whether history has the link or, if titles count, the title's key, unless force holds."""
    named = history if titles else history.limit(0)
    titles = named.select(*by, _key(F.col("title")).alias("_title"), F.lit(True).alias("_a")).distinct()
    guids = history.select(*by, F.col("guid").alias("_guid"), F.lit(True).alias("_b")).where("_guid != ''").distinct()
    keyed = entries.withColumns({"_title": _key(F.col("title")), "_guid": F.when(F.col("link") != "", F.col("link"))})
    found = keyed.join(titles, [*by, "_title"], "left").join(guids, [*by, "_guid"], "left")
    known = F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))
    skipped = known if force is None else known & ~force
    return found.withColumn("skipped", skipped).select(*entries.columns, "skipped")


def missing_guids(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates whose guid the history does not have."""
    known = history.select("guid").where(F.col("guid").isNotNull()).distinct()
    return candidates.join(known, "guid", "left_anti").select(*candidates.columns)


def saint_guid(lang: Column, day: Column) -> Column:
    return F.concat(F.lit("saint-"), lang, F.lit("-"), F.date_format(day, "yyyy-MM-dd"))


def append(ledger: DataFrame, episodes: DataFrame, now: Column, website: Column) -> DataFrame:
    """The ledger with episodes on top. See on_top."""
    return ledger.unionByName(on_top(ledger, episodes, now, website))


def on_top(ledger: DataFrame, episodes: DataFrame, now: Column, website: Column) -> DataFrame:
    """Ledger rows of episodes (the ledger's columns but seq, with ``pos``: 0 is the newest), to go on top of it.

    The newest episode gets the largest seq. An empty pub_date becomes ``now`` in UTC, an empty guid one made of it, the
    channel and seq, so that no two episodes share one.
    """
    top = ledger.groupBy(F.col("channel").alias("_channel")).agg(F.max("seq").alias("_top"))
    stamp = F.date_format(now, "yyyyMMddHHmmss")
    numbered = (
        numbered_rows(episodes, "channel", F.desc("pos"), "_n")
        .join(top, F.col("channel") == F.col("_channel"), "left")
        .withColumn("seq", F.coalesce("_top", F.lit(0)) + F.col("_n"))
        .withColumns(
            {
                "pub_date": F.coalesce(F.when(F.col("pub_date") != "", F.col("pub_date")), F.date_format(now, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")),
                "guid": F.coalesce(
                    F.when(F.col("guid") != "", F.col("guid")),
                    F.concat(website, F.lit("/episode/"), stamp, F.lit("-"), F.col("channel").cast("string"), F.lit("-"), F.col("seq").cast("string")),
                ),
            }
        )
    )
    return numbered.select(*ledger.columns)


def retained(ledger: DataFrame, keep: int = KEEP) -> DataFrame:
    """ledger with ``kept``: whether a row is among its channel's first ``keep``, by seq.

    Each task leaves the first ``keep`` of a channel, so one row a channel, its
    last kept seq, comes from at most that many of every task.
    """
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("seq")))
    first = ledger.select("channel", "seq").withColumn("_k", place).where(F.col("_k") <= keep)
    last = first.groupBy(F.col("channel").alias("_channel")).agg(F.min("seq").alias("_last"))
    joined = ledger.join(last, F.col("channel").eqNullSafe(F.col("_channel")), "left")
    return joined.select(*ledger.columns, F.coalesce(F.col("seq") >= F.col("_last"), F.lit(False)).alias("kept"))


def expired_files(ledger: DataFrame, keep: int = KEEP) -> DataFrame:
    """channel, seq, path of the files that a sink is to delete."""
    gone = retained(ledger, keep).where(~F.col("kept"))
    return gone.select("channel", "seq", stored_path(text_or_empty(F.col("audio_url"))).alias("path")).where("path IS NOT NULL")


def publish_order(entries: DataFrame, by: str = "channel", pos: str = "pos") -> DataFrame:
    """entries with ``seq``: they are handled from the oldest to the newest, so that the feed keeps their order."""
    return numbered_rows(entries, by, F.desc(pos), "seq")


def prefer_structured(structured: DataFrame, fallback: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, columns and ``origin``: each field of the structured source, or of the fallback where it is empty."""
    a = structured.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = fallback.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = a.join(b, keys, "full")
    picked = [F.coalesce(F.when(F.col(f"_a_{c}") != "", F.col(f"_a_{c}")), F.col(f"_b_{c}")).alias(c) for c in columns]
    return joined.select(*keys, *picked, F.when(F.col("_a"), "page").otherwise("feed").alias("origin"))


def saint_lives(saints: DataFrame, details: DataFrame, template: Column) -> DataFrame:
    """saints (name, brief, detail_url, ...) with ``life``: the detail page's text, else the brief one, else ``template``
    with the name put in. details: url, text; of several texts of a url the least counts."""
    found = details.groupBy(F.col("url").alias("_url")).agg(F.min("text").alias("_text"))
    joined = saints.join(found, F.col("detail_url") == F.col("_url"), "left")
    told = [F.when(strip(F.col(c)) != "", F.col(c)) for c in ("_text", "brief")]
    return joined.select(*saints.columns, F.coalesce(*told, F.replace(template, F.lit("{name}"), F.col("name"))).alias("life"))


def saint_segments(saints: DataFrame) -> DataFrame:
    """page_id, segments of saints(page_id, ord, name, life): one text per saint, the name and, on the lines after it, the
    life."""
    rows = saints.select("page_id", F.struct("ord", "name", F.concat_ws("\n", "name", "life").alias("text")).alias("s"))
    return rows.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]).alias("segments"))
