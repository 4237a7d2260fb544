"""Speech markup of sections and episodes, and its division by byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dims
from lectern.functions.arrays import depths, running
from lectern.functions.rx import let, matches, of_language, rx, strip, sub, text_or_empty
from lectern.functions.text import COMMENT, PAUSE, QUOTE_END, QUOTE_START, xml_legal

# fixed values ---------------------------------------------------------------
SILENCE_SECONDS = 2.5
BYTE_LIMIT = 4800
SPLIT_FROM = 3800
_PAUSE_TAG = '<break time="0.3s"/>'
_QUOTE_TAGS = ('<break time="200ms"/><prosody pitch="-6%" rate="97%">', '</prosody><break time="150ms"/>')
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
_HEADING = ('<emphasis level="moderate">', "</emphasis>")
_TITLE = ('<emphasis level="strong">', "</emphasis>")
_COMMENT_TONE = ('<prosody pitch="-4%" rate="95%">', "</prosody>")
# end of fixed values --------------------------------------------------------


def _swap(value: Column, pairs) -> Column:
    for a, b in pairs:
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _escaped(value: Column) -> Column:
    return _swap(xml_legal(value), _ESCAPES)


def escape_body(value: Column) -> Column:
    """Escaped text with pause and quote markers as tags."""
    tags = ((PAUSE, _PAUSE_TAG), (QUOTE_START, _QUOTE_TAGS[0]), (QUOTE_END, _QUOTE_TAGS[1]))
    return _swap(_escaped(value), tags)


def escape_heading(value: Column) -> Column:
    """Escaped text for inside emphasis: pauses as tags, quote markers removed."""
    return _swap(_escaped(value), ((PAUSE, _PAUSE_TAG), (QUOTE_START, ""), (QUOTE_END, "")))


def phonemes(markup: Column, lang: str | Column) -> Column:
    """Known names marked with their pronunciation; Italian only."""
    rules = [{"key": rx(rf"\b{word}\b"), "name": f'<phoneme alphabet="ipa" ph="{sound}">{word}</phoneme>'} for word, sound in dims.PHONEMES]
    listed = of_language(lang, {"it": rules}, [], "array<struct<key:string,name:string>>")
    return F.aggregate(listed, markup, lambda text, r: F.regexp_replace(text, r["key"], r["name"]))


def _tokens(markup: Column) -> Column:
    """Tags and what stands between them, in order."""
    return F.regexp_extract_all(markup, F.lit("<[^<>]*>|[^<]+|<"), F.lit(0))


def _steps(pieces: Column, tags: str) -> Column:
    """1 where a piece opens one of the tags, -1 where it closes one."""
    step = lambda p: F.when(matches(p, rf"^<(?:{tags})\b", "i"), 1).when(matches(p, rf"^</(?:{tags})\b", "i"), -1).otherwise(0)
    return F.transform(pieces, step)


def balance_prosody(markup: Column) -> Column:
    """Closing prosody tags without an opening one go, open ones are closed at the end."""

    def balanced(pieces: Column) -> Column:
        def kept(d: Column) -> Column:
            whole = F.filter(pieces, lambda p, i: ~F.get(d, i)["stray"])
            still_open = F.coalesce(F.get(d, F.size(d) - 1)["after"], F.lit(0)).cast("int")
            return F.concat(F.array_join(whole, ""), F.repeat(F.lit("</prosody>"), still_open))

        return let(depths(_steps(pieces, "prosody")), kept)

    return let(_tokens(text_or_empty(markup)), balanced)


def _wrapped(value: Column, tags: tuple[str, str]) -> Column:
    return F.concat(F.lit(tags[0]), value, F.lit(tags[1]))


def _lines(segment: Column) -> tuple[Column, Column]:
    """Whether a segment is a comment, and its stripped lines."""
    comment = segment.startswith(COMMENT)
    text = strip(F.when(comment, F.substring(segment, len(COMMENT) + 1, F.length(segment))).otherwise(segment))
    return comment, F.transform(F.split(text, "\n"), strip)


def section_markup(segment: Column) -> Column:
    """One section: heading, a short second line as a subheading, then the body."""
    comment, all_lines = _lines(text_or_empty(segment))

    def made(lines: Column) -> Column:
        heading = F.get(lines, F.lit(0))
        second = F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
        below = (second != "") & (F.length(second) < 60) & ~matches(second, r"[.!?:,]")
        rest = F.filter(F.slice(lines, F.when(below, 3).otherwise(2), F.size(lines)), lambda x: x != "")

        def body(parts: Column) -> Column:
            ended = F.transform(
                parts,
                lambda x, i: F.when(
                    (i < F.size(parts) - 1) & ~matches(x, rf"[.!?,:]$|{QUOTE_END}\s*$"), F.concat(x, F.lit("."))
                ).otherwise(x),
            )
            markup = escape_body(F.array_join(ended, " "))
            flat = _wrapped(sub(markup, r"<prosody[^>]*>|</prosody>", ""), _COMMENT_TONE)
            shown = F.when(comment, flat).otherwise(balance_prosody(markup))
            return F.when(F.size(parts) > 0, F.concat(F.lit('<break time="1.0s"/>'), shown)).otherwise("")

        subheading = F.concat(
            F.lit('<break time="0.5s"/>'), _wrapped(escape_heading(F.concat(second, F.lit("."))), _HEADING)
        )
        return F.concat(
            F.when(heading != "", _wrapped(escape_heading(heading), _HEADING)).otherwise(""),
            F.when(below, subheading).otherwise(""),
            let(rest, body),
        )

    return let(all_lines, made)


def title_markup(title: Column) -> Column:
    return _wrapped(escape_heading(strip(sub(text_or_empty(title), r"[ \t]*\n[ \t]*", " "))), _TITLE)


def episode_markup(title: Column, segments: Column, lang: str | Column) -> Column:
    """A whole episode: the title, then every section after a silence."""
    sections = F.transform(
        segments, lambda s: F.concat(F.lit(f'<break time="{SILENCE_SECONDS}s"/>'), section_markup(s))
    )
    return phonemes(
        F.concat(F.lit("<speak>"), title_markup(title), F.array_join(sections, ""), F.lit("</speak>")), lang
    )


def section_text(segment: Column) -> Column:
    """One section as plain text, its lines joined as sentences."""
    _, lines = _lines(text_or_empty(segment))
    return strip(sub(F.array_join(F.filter(lines, lambda x: x != ""), ". "), r"\s+", " "))


def chunks(markup: Column) -> Column:
    """Markup in parts for one call each: whole if it fits the limit, else cut only before breaks outside of any
    block and once SPLIT_FROM bytes have been gathered. A part can exceed the limit if no such break comes.

    Bytes and depths run along the pieces; the cuts are then found among the breaks, and each piece goes to one part.
    """
    shell = len("<speak></speak>")
    inner = F.regexp_extract(markup, r"(?s)^<speak>(.*)</speak>", 1)
    inner = F.when(matches(markup, r"(?s)^<speak>.*</speak>"), inner).otherwise(markup)

    def parted(pieces: Column) -> Column:
        def placed(at: Column) -> Column:
            before = lambda i: F.coalesce(F.get(at["ends"], i - 1), F.lit(0))
            fits = lambda p, i: matches(p, r"^<break\s", "i") & (F.get(at["depths"], i)["before"] == 0)
            spots = F.transform(pieces, lambda p, i: F.struct(i.alias("i"), before(i).alias("bytes"), fits(p, i).alias("fits")))
            begin = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).cast("long").alias("at"))

            def step(s: Column, x: Column) -> Column:
                cut = (x["i"] > 0) & (x["bytes"] - s["at"] + shell >= SPLIT_FROM)
                return F.struct(
                    F.when(cut, F.concat(s["cuts"], F.array(x["i"]))).otherwise(s["cuts"]).alias("cuts"),
                    F.when(cut, x["bytes"]).otherwise(s["at"]).alias("at"),
                )

            cuts = F.aggregate(F.filter(spots, lambda x: x["fits"]), begin, step, lambda s: s["cuts"])
            upto = lambda c, k: F.coalesce(F.get(c, k + 1), F.size(pieces))
            joined = lambda c: F.transform(c, lambda x, k: F.array_join(F.slice(pieces, x + 1, upto(c, k) - x), ""))
            return let(cuts, joined)

        ends = running(F.transform(pieces, lambda p: F.octet_length(p)))
        return let(F.struct(ends.alias("ends"), depths(_steps(pieces, "prosody|emphasis")).alias("depths")), placed)

    parts = F.transform(let(_tokens(inner), parted), lambda x: F.concat(F.lit("<speak>"), x, F.lit("</speak>")))
    return F.when(F.octet_length(markup) <= BYTE_LIMIT, F.array(markup)).otherwise(parts)


def interleaved(parts: Column, silence: Column) -> Column:
    """Parts (structs) with silence between them."""
    return F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, F.array(p)).otherwise(F.array(silence, p))))


def synthesis_plan(episodes: DataFrame, lang: str | Column, voice: str = "markup") -> DataFrame:
    """(episode_id, part_no, kind, payload, bytes) of episodes(episode_id, title, segments: array of text), in one language
    or that of a column.

    voice="markup": one call if the whole fits the limit, else title and sections
    with silence between them, each in parts that keep to the budget.
    voice="plain": text without markup; empty sections are left out.
    """
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("payload"))
    silence = part("silence", F.lit(str(SILENCE_SECONDS)))
    segments = F.coalesce(F.col("segments"), F.array().cast("array<string>"))
    if voice == "plain":
        texts = F.concat(
            F.array(part("speech", text_or_empty(F.col("title")))),
            F.filter(F.transform(segments, lambda s: part("speech", section_text(s))), lambda p: p["payload"] != ""),
        )
        planned = interleaved(texts, silence)
    else:
        spoken = lambda x: phonemes(F.concat(F.lit("<speak>"), x, F.lit("</speak>")), lang)
        whole = episode_markup(F.col("title"), segments, lang)
        blocks = F.concat(
            F.array(spoken(title_markup(F.col("title")))), F.transform(segments, lambda s: spoken(section_markup(s)))
        )
        groups = F.transform(
            blocks,
            lambda b, i: F.concat(
                F.when(i > 0, F.array(silence)).otherwise(F.array().cast("array<struct<kind:string,payload:string>>")),
                F.transform(chunks(b), lambda c: part("speech", c)),
            ),
        )
        planned = F.when(F.octet_length(whole) <= BYTE_LIMIT, F.array(part("speech", whole))).otherwise(F.flatten(groups))
    rows = episodes.select("episode_id", F.posexplode(planned).alias("part_no", "p"))
    return rows.select(
        "episode_id", "part_no", F.col("p.kind").alias("kind"), F.col("p.payload").alias("payload"),
        F.octet_length("p.payload").alias("bytes"),
    )


def voice_columns(voice: Column, provider: Column, speed: Column) -> dict[str, Column]:
    """provider, lang, voice_name, language_code and speaking_rate as a request resolves to them."""
    edge = F.lower(strip(text_or_empty(provider))).isin("edge", "edge-tts", "edgetts")
    prefix = F.lower(F.substring_index(text_or_empty(voice), "-", 1))
    lang = F.when(prefix.isin(*dims.VOICES), prefix).otherwise("it")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for c, v in dims.VOICES.items() for x in (c, v[i])]), lang)
    named = F.coalesce(voice.rlike("^[a-z]{2}-[A-Z]{2}-"), F.lit(False))
    branded = F.coalesce(voice.rlike(r"^[a-z]{2}-[A-Z]{2}-(?:Neural2|Wavenet|Standard|Studio|Polyglot|News)\b"), F.lit(False))
    rates = F.create_map(*[F.lit(x) for pair in dims.SPEEDS.items() for x in pair])
    return {
        "provider": F.when(edge, "edge").otherwise("google"),
        "lang": lang,
        "voice_name": F.when(edge, F.when(named & ~branded, voice).otherwise(pick(2))).otherwise(
            F.when(named, voice).otherwise(pick(0))
        ),
        "language_code": pick(1),
        "speaking_rate": F.coalesce(F.element_at(rates, speed), F.lit(1.0)),
    }


