"""Whole runs from what is published to what is published next.

Every run begins with the published documents (see sinks.published): they are
the ledger. It ends with outcomes, a row for all that was asked, and with new
documents of the channels that have something new. What can't be read becomes a
row of the outcomes and stops its own channel, no other: a channel whose history
or source can't be read is left as it is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.rx import text_or_empty
from lectern.functions.text import parse_rfc822
from lectern.operators import ledger as L
from lectern.plans import publish as R
from lectern.plans.feed_xml import feed_documents
from lectern.plans.markup import synthesis_plan
from lectern.storage import written

RESULT = ("channel", "title", "guid", "status", "code")
_EPISODE = "channel string, pos bigint, title string, description string, audio_url string, pub_date string, guid string, duration bigint, file_size bigint"


class Run(NamedTuple):
    """outcomes: RESULT of all that was asked. episodes: what is new, with target, audio_url and segments (null: the
    description is spoken). ledger: that of the channels with something new, as it is kept. expired: paths of sound files
    to delete."""

    outcomes: DataFrame
    episodes: DataFrame
    ledger: DataFrame
    expired: DataFrame

    def documents(self, channels: DataFrame) -> DataFrame:
        """channel, rss of the channels with something new."""
        changed = self.ledger.select("channel").distinct()
        return feed_documents(self.ledger, channels.join(changed, "channel", "left_semi"))

    def speech(self, voice: str = "markup") -> DataFrame:
        """The synthesis plan of what is new: channel, guid, part_no, kind, payload, bytes."""
        one = self.episodes.select(
            F.struct("channel", "guid").alias("episode_id"), "lang", "title", F.coalesce("segments", F.array("description")).alias("segments")
        )
        return synthesis_plan(one, F.col("lang"), voice).select("episode_id.channel", "episode_id.guid", "part_no", "kind", "payload", "bytes")


def _refused(asked: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked without the channels of blocked(channel, error), and a result row for each of those."""
    errors = blocked.groupBy("channel").agg(F.min("error").alias("error"))
    rows = errors.select(
        "channel", F.lit("").alias("title"), F.lit("").alias("guid"), F.concat(F.lit("FAIL:"), "error").alias("status"), F.lit(500).alias("code")
    )
    return asked.join(errors.select("channel"), "channel", "left_anti"), rows


def _finish(judged: DataFrame, refused: DataFrame, history: DataFrame, now: Column, website: Column, keep: int | None) -> Run:
    """The run that judged's rows (RESULT, pos, lang, description, audio_url, pub_date, segments) make."""
    judged = written(judged, "run-outcomes")
    fresh = judged.where(F.col("status") == "OK")
    zero = F.lit(0).cast("bigint")
    new = fresh.select("channel", F.col("pos").cast("bigint").alias("pos"), "title", "description", "audio_url", "pub_date", "guid", zero.alias("duration"), zero.alias("file_size"))
    changed = history.join(fresh.select("channel").distinct(), "channel", "left_semi")
    merged = written(L.append(changed, new, now, website), "run-ledger")
    kept, expired = merged, merged.limit(0).select("channel", "seq", F.lit(None).cast("string").alias("path"))
    if keep is not None:
        kept, expired = L.retained(merged, keep).where("kept").drop("kept"), L.expired_files(merged, keep)
    return Run(judged.select(*RESULT).unionByName(refused), fresh, kept, expired)


def _placed(rows: DataFrame, channels: DataFrame, host: str, now: Column) -> DataFrame:
    """rows with target, audio_url and lang, by channels(channel, language, bucket_name, storage_prefix)."""
    day = rows.withColumn("day", F.coalesce(F.to_date(parse_rfc822(F.col("pub_date"))), F.to_date(now)))
    languages = channels.select(F.col("channel").alias("_c"), F.col("language").alias("lang"))
    placed = R.uploads(day, channels, host).drop("day")
    return placed.join(languages, F.col("channel") == F.col("_c"), "left").drop("_c")


def _judged(rows: DataFrame, history: DataFrame, force: Column | None, by_title: bool) -> DataFrame:
    """rows (title, guid, target, found) with status and code. A guid that the ledger has is known; a title too, where
    titles name episodes."""
    known = L.with_known(rows.withColumn("link", text_or_empty(F.col("guid"))), history, by=("channel",), force=force, titles=by_title)
    status = F.when(~F.col("found"), "FAIL:no content").when(F.col("skipped"), "SKIP:known").when(F.col("target").isNull(), "FAIL:no target").otherwise("OK")
    code = F.when(~F.col("found"), 404).when(~F.col("skipped") & F.col("target").isNull(), 500).otherwise(200)
    return known.withColumns({"status": status, "code": code}).drop("link", "skipped")


def _from_entry(entries: DataFrame) -> DataFrame:
    """Episodes of feed entries(channel, pos, title, summary, link, pub_date)."""
    summary = F.when(F.col("summary") != "", F.col("summary"))
    return entries.select(
        "channel", "pos", "title", F.coalesce(summary, "title").alias("description"), "pub_date", F.col("link").alias("guid"),
        F.lit(None).cast("array<string>").alias("segments"), F.lit(True).alias("found"),
    )


def feed_run(entries: DataFrame, history: DataFrame, blocked: DataFrame, channels: DataFrame, host: str, now: Column, website: Column, keep: int | None = L.KEEP) -> Run:
    """A run over all entries(channel, pos, title, summary, link, pub_date): those that a channel's ledger has neither by
    title nor by link are published, the last of the feed first."""
    history = written(history, "run-history")  # read from documents once
    asked, refused = _refused(entries, blocked)
    judged = _judged(_placed(_from_entry(asked), channels, host, now), history, None, True)
    return _finish(judged, refused, history, now, website, keep)


def history_run(entries: DataFrame, blocked: DataFrame, channels: DataFrame, host: str, now: Column, website: Column) -> Run:
    """Ledgers made anew of all entries, whatever was published; nothing is left out of them."""
    asked, refused = _refused(entries, blocked)
    nothing = entries.sparkSession.createDataFrame([], _EPISODE).withColumnRenamed("pos", "seq")
    judged = _judged(_placed(_from_entry(asked), channels, host, now), nothing, None, True)
    return _finish(judged, refused, nothing, now, website, None)


def day_run(asked: DataFrame, pages: DataFrame, entries: DataFrame, history: DataFrame, blocked: DataFrame, channels: DataFrame, site: str, host: str, now: Column, website: Column, keep: int | None = L.KEEP) -> Run:
    """The episode of a day for each of asked(channel, day, force).

    From the channel's page of that day, pages(channel, page_id, lang, day,
    html, nodes), or from the first of its entries where there is no page or the
    page has no sections. Which of the two it is, is settled on the pages'
    sections alone; entries are taken up for the channels that need them only.
    What a forced channel has already is published again.
    """
    history = written(history, "run-history")  # read from documents once
    wanted, refused = _refused(asked, blocked)
    own = pages.join(wanted.select("channel", "day"), ["channel", "day"], "left_semi")
    # a page stands for one channel and day, so its number leads back to them
    made = R.day_episodes(own.drop("channel"), site).join(own.select("page_id", "channel"), "page_id")
    some = made.where((text_or_empty(F.col("title")) != "") & (F.size("segments") > 0))
    paged = written(some.select("channel", "day", F.lit(0).cast("bigint").alias("pos"), "title", F.col("title").alias("description"), "pub_date", "guid", "segments"), "run-pages")
    without = wanted.join(paged, ["channel", "day"], "left_anti")
    needed = entries.join(without.select("channel").distinct(), "channel", "left_semi")
    latest = _from_entry(needed.groupBy("channel").agg(F.min_by(F.struct("pos", "title", "summary", "link", "pub_date"), "pos").alias("e")).select("channel", "e.*"))
    columns = ["channel", "day", "force", "pos", "title", "description", "pub_date", "guid", "segments"]
    from_page = wanted.join(paged, ["channel", "day"]).select(*columns, F.lit(True).alias("found"))
    from_feed = without.join(latest.drop("found").withColumn("_found", F.lit(True)), "channel", "left").select(*columns, F.coalesce("_found", F.lit(False)).alias("found"))
    picked = from_page.unionByName(from_feed).drop("day")
    judged = _judged(_placed(picked, channels, host, now), history, F.coalesce("force", F.lit(False)), True)
    return _finish(judged, refused, history, now, website, keep)


def saint_run(asked: DataFrame, pages: DataFrame, details: DataFrame, history: DataFrame, blocked: DataFrame, channels: DataFrame, site: str, host: str, now: Column, website: Column, keep: int | None = L.KEEP) -> Run:
    """The saints of a day for each of asked(channel, day), from pages(channel, page_id, lang, day, html, nodes) and
    details(url, text). An episode is known by its guid only: titles come again each year."""
    history = written(history, "run-history")  # read from documents once
    wanted, refused = _refused(asked, blocked)
    own = pages.join(wanted, ["channel", "day"], "left_semi")
    made = R.saint_episodes(own.drop("channel"), details, site).drop("lang", "day").join(own.select("page_id", "channel", "day"), "page_id")
    found = made.select("channel", "day", F.lit(0).cast("bigint").alias("pos"), "title", F.col("title").alias("description"), "pub_date", "guid", "segments", (F.size("segments") > 0).alias("found"))
    rows = wanted.join(found, ["channel", "day"], "left").drop("day").withColumn("found", F.coalesce("found", F.lit(False)))
    judged = _judged(_placed(rows, channels, host, now), history, None, False)
    return _finish(judged, refused, history, now, website, keep)
