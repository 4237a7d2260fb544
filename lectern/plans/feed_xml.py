"""A channel's feed as an RSS document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.rx import text_or_empty
from lectern.functions.text import sanitize, xml_legal

# fixed values
_HEAD = (
    '<?xml version="1.0" encoding="utf-8"?>\n<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" '
    'xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom">\n<channel>\n'
)
_TAIL = "</channel>\n</rss>\n"
_CATEGORY = '<itunes:category text="Religion &amp; Spirituality"/>'


def _text(value: Column) -> Column:
    out = xml_legal(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), _text(text_or_empty(value)), F.lit(f"</{name.split()[0]}>\n"))


def _if_any(value: Column, made: Column) -> Column:
    return F.when(text_or_empty(value) != "", made).otherwise("")


def item_xml() -> Column:
    """An item from a ledger row's columns."""
    title, description, url = sanitize(F.col("title")), sanitize(F.col("description")), text_or_empty(F.col("audio_url"))
    size = F.coalesce(F.col("file_size"), F.lit(0)).cast("string")
    return F.concat(
        F.lit("<item>\n"), _tag("title", title), _tag("description", description), _tag("itunes:summary", description),
        _tag("pubDate", F.col("pub_date")), _tag('guid isPermaLink="false"', F.col("guid")), _tag("link", url),
        F.lit('<enclosure url="'), _text(url), F.lit('" type="audio/mpeg" length="'), size, F.lit('"/>\n'),
        F.when(F.col("duration") > 0, _tag("itunes:duration", F.col("duration").cast("string"))).otherwise(""),
        F.lit("</item>\n"),
    )


def feed_documents(ledger: DataFrame, channels: DataFrame) -> DataFrame:
    """channel, rss: a document for each of channels (channel, language, email, podcast_info), items in ledger order.

    Owner, image and address of the feed appear only where configured. A ledger
    is bounded by its retention, so a document fits one row.
    """
    items = ledger.groupBy("channel").agg(
        F.array_join(
            F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("seq", item_xml().alias("xml"))))), lambda x: x["xml"]), ""
        ).alias("items")
    )
    info = lambda x: F.col(f"podcast_info.{x}")
    mail, art, address = F.col("email"), info("cover_art"), info("rss_url")
    owner = F.concat(
        F.lit("<itunes:owner>\n"), _tag("itunes:name", info("author")), _tag("itunes:email", mail), F.lit("</itunes:owner>\n"),
        _tag("managingEditor", mail),
    )
    image = F.concat(
        F.lit('<itunes:image href="'), _text(text_or_empty(art)), F.lit('"/>\n<image>\n'), _tag("url", art),
        _tag("title", info("title")), _tag("link", info("website")), F.lit("</image>\n"),
    )
    self_link = F.concat(F.lit('<atom:link href="'), _text(text_or_empty(address)), F.lit('" rel="self" type="application/rss+xml"/>\n'))
    head = F.concat(
        F.lit(_HEAD), _tag("title", info("title")), _tag("description", info("description")), _tag("link", info("website")),
        _tag("language", F.col("language")), _tag("itunes:author", info("author")), _tag("itunes:summary", info("description")),
        _tag("itunes:explicit", F.lit("no")), F.lit(_CATEGORY + "\n"),
        _if_any(mail, owner), _if_any(art, image), _if_any(address, self_link),
    )
    joined = channels.join(items, "channel", "left")
    return joined.select("channel", F.concat(head, text_or_empty(F.col("items")), F.lit(_TAIL)).alias("rss"))


def write_feeds(documents: DataFrame, path: str) -> None:
    """One text file a channel under path/channel=...; a run replaces the channels it has and no others."""
    documents.select("channel", F.col("rss").alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("channel").text(path)
