"""HTML pages as rows of elements.

A small parser lists the elements of a page with their places in the source;
everything else is expressions over that array, or joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lectern.functions import dims
from lectern.functions.rx import let, matches, strip, sub
from lectern.functions.text import html_to_text, is_navigation, is_saint_link, name_slug, title_case

#: ord (order of opening), end (ord after the last element inside), parent (-1: none), place in the source
#: (start, stop: code points), pieces of text inside (first, and the one after the last).
ELEMENT = StructType(
    [StructField(n, IntegerType()) for n in ("ord", "end", "parent", "start", "stop", "first", "last")]
    + [StructField(n, StringType()) for n in ("tag", "cls", "href")]
)
#: The elements of a page and the pieces of its text, stripped, in document order. A piece is kept once, however many
#: elements it lies in, so that a page takes no more room than its source.
PAGE = StructType([StructField("nodes", ArrayType(ELEMENT)), StructField("pieces", ArrayType(StringType()))])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNREAD = ("script", "style")
#: Pages that are parsed and handed back at a time. Spark sends 10,000 rows in a batch, and a parsed page takes many times
#: the room of its source as Python's objects.
SLICE = 64


class _Elements(HTMLParser):
    """Elements with a tolerant stack: an end tag closes what was left open inside its element, strays are passed over."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.pieces: list[str] = []
        self.open: list[int] = []
        self.depths: dict[str, list[int]] = {}  # of the open elements of each tag
        self.lines = [0]
        for line in source.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.size = len(source)
        self.feed(source)
        self.close()
        while self.open:
            self._shut(self.size)

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, stop: int) -> None:
        row = self.rows[self.open.pop()]
        self.depths[row["tag"]].pop()
        row["stop"], row["end"], row["last"] = stop, len(self.rows), len(self.pieces)

    def handle_starttag(self, tag, attrs):
        found, parent = dict(attrs), self.open[-1] if self.open else -1
        at, n = self._here(), len(self.pieces)
        self.rows.append(
            {
                "ord": len(self.rows), "end": len(self.rows) + 1, "parent": parent, "tag": tag,
                "cls": found.get("class") or "", "href": found.get("href"), "start": at,
                "stop": at + len(self.get_starttag_text()), "first": n, "last": n,
            }
        )
        if tag not in _VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._shut(self._here() + len(self.get_starttag_text()))

    def handle_endtag(self, tag):
        depths = self.depths.get(tag)
        if not depths:
            return
        at, depth = self._here(), depths[-1]
        while len(self.open) > depth + 1:
            self._shut(at)
        self._shut(at + len(tag) + 3)

    def handle_data(self, data):
        piece = data.strip()
        if piece and not (self.open and self.rows[self.open[-1]]["tag"] in _UNREAD):
            self.pieces.append(piece)


def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """PAGE of each page, in arrays of SLICE pages at most, however large the batches are."""
    shape = to_arrow_type(PAGE)
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            read = [_Elements(x or "") for x in batch.slice(at, SLICE).to_pylist()]
            yield pa.array([{"nodes": x.rows, "pieces": x.pieces} for x in read], shape)


@F.arrow_udf(PAGE)
def elements(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The elements of each page, in document order, and its pieces of text."""
    return parsed(pages)


def with_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``nodes`` and ``pieces``, the page's elements and text."""
    return pages.withColumn("_page", elements(F.col(html))).select("*", "_page.nodes", "_page.pieces").drop("_page")


def text_of(pieces: Column, node: Column) -> Column:
    """The text of an element, its pieces joined by spaces."""
    return F.array_join(F.slice(pieces, node["first"] + 1, node["last"] - node["first"]), " ")


def _has_text(node: Column) -> Column:
    return node["last"] > node["first"]


def has_class(cls: Column, name: str) -> Column:
    # most elements don't hold the name at all, which is seen without taking their classes apart
    return F.contains(cls, F.lit(name)) & F.array_contains(F.split(cls, r"\s+"), name)


def _inside(nodes: Column, outer: Column) -> Column:
    return F.filter(nodes, lambda n: (n["ord"] > outer["ord"]) & (n["ord"] < outer["end"]))


def source_of(html: Column, node: Column) -> Column:
    return F.substring(html, node["start"] + 1, node["stop"] - node["start"])


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, ord, href, cls, text of every link with a target."""
    found = F.filter("nodes", lambda n: (n["tag"] == "a") & n["href"].isNotNull())
    shown = F.transform(found, lambda n: F.struct(n["ord"].alias("ord"), n["href"].alias("href"), n["cls"].alias("cls"), text_of(F.col("pieces"), n).alias("text")))
    return pages.select(key, F.inline(shown))


def _fitting(text: Column) -> Column:
    """The text, stripped, if it can be a title."""
    return let(strip(text), lambda x: F.when((x != "") & (F.length(x) < 120), x))


def marked_title(nodes: Column, pieces: Column) -> Column:
    """The text of the element that is marked as a day page's title; null if there is none that fits."""
    marked = F.get(F.filter(nodes, lambda n: has_class(n["cls"], "indicazioneLiturgica")), F.lit(0))
    return _fitting(let(marked, lambda n: text_of(pieces, n)))


def title(nodes: Column, pieces: Column, page_text: Column, day: Column, lang: Column, month_names: Column) -> Column:
    """A day page's title: the marked element, else what follows the date in the text, else the date."""
    date = F.date_format(day, "dd/MM/yyyy")
    after = F.call_function(
        "regexp_extract", page_text, F.concat(F.lit("(?dU)"), F.replace(date, F.lit("/"), F.lit(r"\/")), F.lit(r"\s+([^\s].{5,80}?)(?:\s{2,}|\z)")), F.lit(1)
    )
    written = F.concat_ws(" ", F.dayofmonth(day).cast("string"), month_names, F.year(day).cast("string"))
    return F.coalesce(marked_title(nodes, pieces), _fitting(after), written)


def section_range(html: Column, nodes: Column, heading: Column) -> Column:
    """(start, stop) of the HTML that belongs to a heading: its section's wrapper, else the first other div with text
    beside the heading's block, else everything after the heading up to the next one in the same parent."""
    reach = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))

    # each of these is used several times, and worked out once
    def parted(head: Column) -> Column:
        def chosen(inside: Column) -> Column:
            wrapper = F.filter(inside, lambda n: has_class(n["cls"], "section__wrapper"))
            beside = F.filter(inside, lambda n: (n["parent"] == head["parent"]) & (n["ord"] != head["ord"]) & (n["tag"] == "div") & _has_text(n))
            return let(F.get(wrapper, F.lit(0)), lambda first: F.when(_has_text(first), first).otherwise(F.get(beside, F.lit(0))))

        inside = F.when(head["parent"] >= 0, let(F.get(nodes, head["parent"]), lambda outer: _inside(nodes, outer))).otherwise(nodes)
        return let(let(inside, chosen), lambda n: F.when(n.isNotNull(), reach(n["start"], n["stop"])))

    parent = F.get(nodes, heading["parent"])
    later = F.filter(
        nodes, lambda n: (n["parent"] == heading["parent"]) & (n["ord"] > heading["ord"]) & (n["tag"] == "h2")
    )
    close = F.when(heading["parent"] >= 0, F.greatest(heading["stop"], parent["stop"] - F.length(parent["tag"]) - 3))
    end = F.coalesce(F.get(later, F.lit(0))["start"], close, F.length(html))
    flat = reach(heading["stop"], F.greatest(heading["stop"], end))
    return F.coalesce(F.when(heading["parent"] >= 0, let(parent, parted)), flat)


def section_of(html: Column, nodes: Column, heading: Column) -> Column:
    """The HTML of section_range."""
    return let(section_range(html, nodes, heading), lambda r: source_of(html, r))


#: The text of an inline element that is nothing but a verse reference (fixed value).
_VERSE = r"^\d*[A-ZÀ-Ü][a-zà-ü]{1,6}\s+\d[\d,;:.\-a-zA-Z\s]*$"


def without_verses(html: Column, nodes: Column, pieces: Column, reach: Column) -> Column:
    """The HTML of a range without the inline elements in it whose whole text, that of elements inside them too, is a
    verse reference."""
    whole = lambda n: F.array_join(F.slice(pieces, n["first"] + 1, n["last"] - n["first"]), "")
    inline = lambda n: n["tag"].isin("span", "sup", "small") & (n["start"] >= reach["start"]) & (n["stop"] <= reach["stop"])
    found = F.filter(F.filter(nodes, inline), lambda n: matches(whole(n), _VERSE))

    def cut(gone: Column) -> Column:
        # of nested ones the outer counts: an element that ends within one before it leaves nothing between
        def kept(i: Column) -> Column:
            a = F.coalesce(F.array_max(F.transform(F.slice(gone, F.greatest(i, F.lit(1)), F.least(i, F.lit(1))), lambda n: n["stop"])), reach["start"])
            b = F.coalesce(F.get(gone, i)["start"], reach["stop"])
            return F.substring(html, a + 1, F.greatest(F.lit(0), b - a))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(gone)), kept), "")

    outer = lambda every: F.filter(every, lambda n: ~F.exists(every, lambda o: (o["ord"] < n["ord"]) & (o["end"] > n["ord"])))
    return F.when(F.size(found) == 0, source_of(html, reach)).otherwise(let(let(found, outer), cut))


def sections(pages: DataFrame, key: str = "page_id", html: str = "html", outer: bool = False) -> DataFrame:
    """key, ord, heading, section (HTML), read (the same without inline verse references) for every h2 of a page.

    outer: a page without any has one row, in which all but the key is null.
    """
    source, nodes, pieces = F.col(html), F.col("nodes"), F.col("pieces")

    def made(h: Column) -> Column:
        return let(
            section_range(source, nodes, h),
            lambda r: F.struct(
                h["ord"].alias("ord"), text_of(pieces, h).alias("heading"), source_of(source, r).alias("section"),
                without_verses(source, nodes, pieces, r).alias("read"),
            ),
        )

    each = F.inline_outer if outer else F.inline
    return pages.select(key, each(F.transform(F.filter("nodes", lambda n: n["tag"] == "h2"), made)))


def find_section(found: DataFrame, keyword: str, key: str = "page_id") -> DataFrame:
    """key, ord, heading, section: each page's first section whose heading has the keyword, case ignored."""
    hits = found.where(F.contains(F.lower("heading"), F.lit(keyword.lower())))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return hits.withColumn("_k", rank).where("_k = 1").drop("_k")


def detail_link(nodes: Column, lang: str | Column, site: str) -> Column:
    """The address of a detail page among elements: a link marked as read-more, else the first that looks like one."""
    targets = F.filter(nodes, lambda n: (n["tag"] == "a") & n["href"].isNotNull())
    marked = F.filter(targets, lambda n: has_class(n["cls"], "saintReadMore"))
    fitting = F.filter(targets, lambda n: is_saint_link(n["href"], lang))
    href = F.coalesce(F.get(marked, F.lit(0))["href"], F.get(fitting, F.lit(0))["href"])
    return absolute(href, site)


def absolute(href: Column, site: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))


def day_address(lang: Column, day: Column, site: str) -> Column:
    slugs = F.create_map(*[F.lit(x) for c, v in dims.DAY_PAGES.items() for x in (c, v[0])])
    return F.concat_ws("/", F.lit(site), lang, F.element_at(slugs, lang), F.date_format(day, "yyyy/MM/dd'.html'"))


def saint_address(lang: Column, day: Column, site: str) -> Column:
    """Without a year."""
    slugs = F.create_map(*[F.lit(x) for c, v in dims.SAINT_PAGES.items() for x in (c, v[0])])
    return F.concat_ws("/", F.lit(site), lang, F.element_at(slugs, lang), F.date_format(day, "MM/dd'.html'"))


def saints(pages: DataFrame, lang: str | Column, site: str, known: DataFrame | None = None) -> DataFrame:
    """page_id, ord, name, brief, detail_url of pages(page_id, day, html, nodes), in one language or that of a column.

    First the headings that are no navigation and of 1 to 120 characters; the
    detail address is a link in the section, on the heading or around it, else
    one made from the name if known(url) has it. Then the links to detail pages
    that no heading led to, each address once.
    """
    lang = lang if isinstance(lang, Column) else F.lit(lang)
    pages = pages.withColumn("_lang", lang)
    lang = F.col("_lang")
    around = lambda h: F.filter(
        F.col("nodes"),
        lambda n: (n["tag"] == "a") & n["href"].isNotNull()
        & (((n["ord"] > h["ord"]) & (n["ord"] < h["end"])) | ((n["ord"] < h["ord"]) & (n["end"] >= h["end"]))),
    )

    def made(h: Column) -> Column:
        outer = F.get(F.filter(around(h), lambda n: is_saint_link(n["href"], lang)), F.lit(0))["href"]
        targets = F.filter(F.col("nodes"), lambda n: (n["tag"] == "a") & n["href"].isNotNull())

        def named(section: Column, inner: Column, outer: Column) -> Column:
            name = text_of(F.col("pieces"), h)
            bare = sub(name, r"[ >→»]+$", "")
            return F.struct(
                h["ord"].alias("ord"), F.when(inner.isNull() & outer.isNotNull(), bare).otherwise(name).alias("name"),
                section.alias("section"), F.coalesce(inner, absolute(outer, site)).alias("linked"),
            )

        def within(section: Column) -> Column:
            holds = F.filter(targets, lambda n: F.contains(section, F.concat(F.lit('"'), n["href"], F.lit('"'))))
            linked = F.when(F.contains(section, F.lit("href")), let(holds, lambda x: detail_link(x, lang, site)))
            return let(linked, lambda inner: let(outer, lambda o: named(section, inner, o)))

        return let(section_of(F.col("html"), F.col("nodes"), h), within)

    fits = lambda x: F.length(x).between(1, 120) & ~is_navigation(x)
    heads = F.filter(F.col("nodes"), lambda n: (n["tag"] == "h2") & let(text_of(F.col("pieces"), n), fits))
    first = pages.select("page_id", "day", "_lang", F.inline(F.transform(heads, made))).withColumn("guess", saint_address(lang, F.col("day"), site))
    guess = F.concat(F.regexp_replace("guess", r"\.html$", "/"), name_slug(F.col("name")), F.lit(".html"))
    first = first.withColumn("guess", guess)
    if known is not None:
        probe = known.select(F.col("url").alias("_known")).distinct()
        first = first.join(probe, F.col("guess") == F.col("_known"), "left")
    else:
        first = first.withColumn("_known", F.lit(None).cast("string"))
    headed = first.select(
        "page_id", "ord", title_case(F.col("name")).alias("name"), html_to_text(F.col("section")).alias("brief"),
        F.coalesce("linked", "_known").alias("detail_url"),
    )
    linked = (
        links(pages.withColumn("_page", F.struct("page_id", "_lang")), "_page")
        .select("_page.*", "ord", "href", "text")
        .where(is_saint_link(F.col("href"), lang))
        .select("page_id", "ord", title_case(strip(F.col("text"))).alias("name"), absolute(F.col("href"), site).alias("detail_url"))
    )
    seen = headed.select("page_id", "detail_url").where(F.col("detail_url").isNotNull()).distinct()
    rest = linked.join(seen, ["page_id", "detail_url"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("page_id", "detail_url").orderBy("ord"))
    rest = rest.withColumn("_k", rank).where("_k = 1").select(
        "page_id", "ord", F.when(F.col("name") == "", "Unknown Saint").otherwise(F.col("name")).alias("name"),
        F.lit("").alias("brief"), "detail_url",
    )
    return headed.unionByName(rest)


def detail_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, text of detail pages(key, html, nodes): the wrappers of static sections with 60 characters or more, else up to
    30 paragraphs. A page with neither has an empty text."""
    nodes = F.col("nodes")

    def wrapper(s: Column) -> Column:
        within = _inside(nodes, s)
        head = text_of(F.col("pieces"), F.get(F.filter(within, lambda n: n["tag"] == "h2"), F.lit(0)))
        marked = F.filter(within, lambda n: has_class(n["cls"], "section__wrapper"))
        divs = F.filter(
            within,
            lambda n: (n["parent"] == s["ord"]) & (n["tag"] == "div") & ~has_class(n["cls"], "section__head") & _has_text(n),
        )
        node = F.coalesce(F.get(marked, F.lit(0)), F.get(divs, F.lit(0)))
        return F.when(~is_navigation(F.coalesce(head, F.lit(""))), source_of(F.col("html"), node))

    static = F.filter(nodes, lambda n: has_class(n["cls"], "section--isStatic"))
    paragraphs = F.filter(
        F.transform(F.filter(nodes, lambda n: n["tag"] == "p"), lambda n: text_of(F.col("pieces"), n)),
        lambda x: (F.length(x) >= 60) & ~F.contains(x, F.lit("http")),
    )
    # a row for each wrapper, so that its references are resolved before its length counts
    blocks = pages.select(key, F.posexplode(F.transform(static, wrapper)).alias("ord", "block")).where(F.col("block").isNotNull())
    texts = blocks.select(key, "ord", html_to_text(F.col("block")).alias("text")).where(F.length("text") >= 60)
    joined = texts.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("_blocks"))
    long = F.array_join(F.transform("_blocks", lambda b: b["text"]), "\n\n")
    found = pages.select(key, F.array_join(F.slice(paragraphs, 1, 30), "\n").alias("_paragraphs"))
    return found.join(joined, F.col(key) == F.col("_key"), "left").select(key, F.coalesce(long, "_paragraphs").alias("text"))
