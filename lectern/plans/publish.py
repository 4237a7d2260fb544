"""Whole runs: from pages and feeds to episodes, from episodes to ledger rows, uploads and what became of each.

What leaves Spark, speech and files, is a plan: which text is spoken, to which
path the sound goes, which paths are to be deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dims
from lectern.functions.rx import strip, text_or_empty
from lectern.functions.text import file_name, html_to_text, localized, month_name, normalize, normalize_punctuation, plain_speech, rfc822, spoken_date
from lectern.operators import ledger as L
from lectern.operators import segments as S
from lectern.plans.batch import local_copy_name
from lectern.plans.markup import interleaved
from lectern.sources import pages as P
from lectern.storage import written


def _of(lang: Column, values: dict[str, str]) -> Column:
    """The value of a row's language."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), lang)


def day_episodes(pages: DataFrame, site: str) -> DataFrame:
    """page_id, lang, day, title, segments, guid, pub_date of day pages(page_id, lang, day, html, nodes) of known languages.

    segments: the reading or readings without the psalm, the gospel, the comment;
    those that a page lacks are left out, and a page without any has none.
    """
    lang = F.col("lang")
    heads = F.array(*[
        F.struct(F.lit(i).alias("kind"), F.lower(_of(lang, {c: v[i + 1] for c, v in dims.DAY_PAGES.items()})).alias("word")) for i in range(3)
    ])
    # a page is parsed once, for its title and its sections, and what counts of it is written; its text is read where
    # nothing is marked as the title
    day, nodes, pieces = F.col("day"), F.col("nodes"), F.col("pieces")
    page_text = html_to_text(F.when(P.marked_title(nodes, pieces).isNull(), F.col("html")))
    titled = pages.withColumn("_title", normalize(P.title(nodes, pieces, page_text, day, lang, month_name(day, lang)), None))
    begins = F.get(F.filter(nodes, lambda n: n["tag"] == "h2"), F.lit(0))["ord"]
    key = F.struct("page_id", "lang", "day", localized(F.col("_title"), lang).alias("title"), begins.alias("begins"))
    found = P.sections(titled.withColumn("_key", key), key="_key", outer=True)
    kinds = F.filter(heads, lambda h: F.contains(F.lower("heading"), h["word"]))
    judged = found.select("_key.*", "ord", kinds.alias("kinds"), F.col("read").alias("section"))
    own_row = F.col("ord").eqNullSafe(F.col("begins"))
    kept = written(judged.where(own_row | (F.size("kinds") > 0)).withColumn("section", F.when(F.size("kinds") > 0, F.col("section"))), "day-pages")
    each = kept.select("page_id", "lang", "ord", "section", F.explode("kinds").alias("k"))
    first = each.groupBy("page_id", "lang", F.col("k.kind").alias("kind")).agg(F.min_by("section", "ord").alias("section"))
    plain = first.select("page_id", "lang", "kind", html_to_text(F.col("section")).alias("_plain"))
    both = S.split_readings(F.col("_plain"), lang)
    whole = lambda x: F.struct(x.alias("first"), F.lit("").alias("second"))
    said = F.when(F.col("kind") == 0, both).when(F.col("kind") == 2, whole(S.comment_section(F.col("_plain"), lang))).otherwise(
        whole(F.col("_plain"))
    )
    # written, so that each step is worked out once, and planned once
    parts = written(plain.select("page_id", "lang", "kind", said.alias("s")), "day-parts")
    rows = parts.select("page_id", "lang", "kind", F.posexplode(F.array("s.first", "s.second")).alias("nth", "text"))
    rows = rows.where(strip("text") != "")  # a text that is blank now is empty in the end
    spoken = normalize_punctuation(text_or_empty(F.col("text")), False)
    localized_ = rows.withColumn("spoken", F.when(F.col("kind") < 2, spoken)).withColumn("spoken", localized(F.col("spoken"), lang, False))
    cleaned = localized_.withColumn(
        "text", F.when(F.col("kind") < 2, S.clean_section(F.col("spoken"), lang)).otherwise(text_or_empty(F.col("text")))
    )
    # left out as it is collected: a filter would work out each text once more
    one = F.when(strip("text") != "", F.struct("kind", "nth", "text"))
    grouped = cleaned.groupBy(F.col("page_id").alias("_page")).agg(F.sort_array(F.collect_list(one)).alias("_parts"))
    slug = _of(lang, {c: v[0] for c, v in dims.DAY_PAGES.items()})
    return kept.where(own_row).join(grouped, F.col("page_id") == F.col("_page"), "left").select(
        "page_id", "lang", "day", "title",
        F.coalesce(F.transform("_parts", lambda x: x["text"]), F.array().cast("array<string>")).alias("segments"),
        F.concat_ws("/", F.lit(site), lang, slug, F.date_format(day, "yyyy/MM/dd'.html'")).alias("guid"), rfc822(day.cast("timestamp")).alias("pub_date"),
    )


def saint_episodes(pages: DataFrame, details: DataFrame, site: str, known: DataFrame | None = None) -> DataFrame:
    """page_id, lang, day, title, segments, guid, pub_date of saint pages(page_id, lang, day, html, nodes) of known languages.

    details: url and text of detail pages. A segment is a saint's name and, on
    the lines after it, the life. Pages on which no saint is found have no row.
    """
    lang, day = F.col("lang"), F.col("day")
    # written, so that each step is worked out once, and planned once
    found = written(P.saints(pages, lang, site, known).join(pages.select("page_id", "lang"), "page_id"), "saints")
    template = _of(lang, {c: v[2] for c, v in dims.SAINT_PAGES.items()})
    told = L.saint_lives(found, details, template)
    plain = told.select("page_id", "lang", "ord", normalize(F.col("name"), None).alias("_name"), normalize(F.col("life"), None, flatten=False).alias("_life"))
    spoken = plain.select("page_id", "ord", localized(F.col("_name"), lang).alias("name"), localized(F.col("_life"), lang, False).alias("life"))
    grouped = L.saint_segments(spoken)
    heading = _of(lang, {c: v[1] for c, v in dims.SAINT_PAGES.items()})
    return pages.select("page_id", "lang", "day").join(grouped, "page_id").select(
        "page_id", "lang", "day", F.concat(heading, F.lit(" - "), spoken_date(day, lang)).alias("title"), "segments",
        L.saint_guid(lang, day).alias("guid"), rfc822(day.cast("timestamp")).alias("pub_date"),
    )


def target_path(prefix: Column, file: Column) -> Column:
    """Where a sound file is uploaded to."""
    return F.concat(prefix, F.lit("/podcast_audio/"), file)


def public_url(host: str, bucket: Column, path: Column) -> Column:
    return F.concat(F.lit(f"https://{host}/"), bucket, F.lit("/"), file_name(path))


def plain_voice_plan(episodes: DataFrame, lang: str, pause_seconds: int = 0) -> DataFrame:
    """episode_id, part_no, kind, payload for voices without markup, of episodes(episode_id, title, text, segments).

    The title, if there is one, then every segment that is not blank, or the
    text where there is none, with silence between them. Without a pause only
    the first of these is spoken.
    """
    segments = F.filter(F.coalesce(F.col("segments"), F.array().cast("array<string>")), lambda s: strip(text_or_empty(s)) != "")
    rows = episodes.select(
        "episode_id", normalize(F.col("title"), lang).alias("_title"), normalize(F.col("text"), lang).alias("_whole"),
        F.transform(segments, lambda s: plain_speech(s, lang, entities=False)).alias("_segments"),
    )
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("payload"))
    body = F.when(F.size("_segments") > 0, F.col("_segments")).otherwise(F.array("_whole"))
    texts = F.transform(F.concat(F.when(F.col("_title") != "", F.array("_title")).otherwise(F.array().cast("array<string>")), body), lambda t: part("speech", t))
    planned = interleaved(texts, part("silence", F.lit(str(pause_seconds)))) if pause_seconds > 0 else F.slice(texts, 1, 1)
    return rows.select("episode_id", F.posexplode(planned).alias("part_no", "p")).select("episode_id", "part_no", "p.*")


def uploads(episodes: DataFrame, channels: DataFrame, host: str) -> DataFrame:
    """episodes (channel, day, title, ...) with ``target`` and ``audio_url``, by channels(channel, bucket_name, storage_prefix);
    both are null where a channel has no configuration."""
    known = channels.select(F.col("channel").alias("_channel"), F.col("bucket_name").alias("_bucket"), F.col("storage_prefix").alias("_prefix"))
    joined = episodes.join(known, F.col("channel") == F.col("_channel"), "left")
    target = target_path(F.col("_prefix"), local_copy_name(F.col("day"), F.col("channel"), F.col("title")))
    placed = joined.withColumn("target", target)
    return placed.withColumn("audio_url", public_url(host, F.col("_bucket"), F.col("target"))).select(*episodes.columns, "target", "audio_url")


def outcomes(episodes: DataFrame, ledger: DataFrame, force: Column | None = None) -> DataFrame:
    """uploads' rows with ``status`` and ``code``: SKIP and 200 for what the ledger has, unless forced; FAIL with 404
    without a title or segments, with 500 without a target; OK and 200 for the rest."""
    judged = L.with_known(episodes.withColumn("link", F.col("guid")), ledger, by=("channel",), force=force)
    empty = (text_or_empty(F.col("title")) == "") | (F.size("segments") < 1)
    status = F.when(empty, "FAIL:no content").when(F.col("skipped"), "SKIP:known").when(F.col("target").isNull(), "FAIL:no target").otherwise("OK")
    code = F.when(empty, 404).when(F.col("target").isNull() & ~F.col("skipped"), 500).otherwise(200)
    return judged.select(*episodes.columns, status.alias("status"), code.alias("code"))


def run_errors(results: DataFrame, by: list[str]) -> DataFrame:
    """by, published, errors: how many went well, and title and reason of those that did not, by title."""
    failed = F.col("status").startswith("FAIL")
    error = F.when(failed, F.struct(text_or_empty(F.col("title")).alias("title"), F.regexp_replace("status", "^FAIL:", "").alias("error")))
    return results.groupBy(*by).agg(
        F.count_if(F.col("status").startswith("OK")).alias("published"), F.sort_array(F.collect_list(error)).alias("errors")
    )


def published_ledger(ledger: DataFrame, results: DataFrame, now: Column, website: Column, keep: int = L.KEEP) -> DataFrame:
    """The ledger with what went well on top, oldest day first, and without what no longer is kept."""
    fresh = results.where(F.col("status") == "OK").select(
        "channel", (-F.unix_date("day")).cast("bigint").alias("pos"), "title", F.coalesce("description", "title").alias("description"), "audio_url",
        "pub_date", "guid", F.lit(0).cast("bigint").alias("duration"), F.lit(0).cast("bigint").alias("file_size"),
    )
    merged = L.append(ledger, fresh, now, website)
    return L.retained(merged, keep).where("kept").drop("kept")


def publish_feed(entries: DataFrame, ledger: DataFrame, now: Column, website: Column, keep: int = L.KEEP) -> DataFrame:
    """The ledger after a run over feed entries(channel, pos, title, summary, link, pub_date, audio_url): those it lacks are
    appended from the last of the feed to the first, and what is no longer kept is left out."""
    fresh = L.new_entries(entries, ledger, by=("channel",)).select(
        "channel", "pos", "title", F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.col("title")).alias("description"),
        "audio_url", "pub_date", F.col("link").alias("guid"), F.lit(0).cast("bigint").alias("duration"), F.lit(0).cast("bigint").alias("file_size"),
    )
    merged = L.append(ledger, fresh, now, website)
    return L.retained(merged, keep).where("kept").drop("kept")
