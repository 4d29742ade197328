"""Article text extraction as native column expressions, linear in the length of the text.

No pattern here can look beyond the place where it must end, so a page of tags that are never closed costs the same as any other:

* Blocks (:func:`cut_blocks`: scripts, comments, platform markup) are found by splitting the text once at the closing needles. Every
  piece but the last is followed by a closing, so its first opening, if any, is closed there. An opening that needs a ``>`` of its own and
  has none in its piece takes the closing's, and its block goes on to the end of the next piece; which pieces that concerns is a
  regular language over one letter per piece.
* Tags are looked for only before the last ``>``, where every ``<`` is followed by its ``>``. Links and images are read from pieces between two ``<``.
* Character references are read from the start of the pieces that follow an ``&``.

Values that are used more than once are bound by a one-element ``transform`` (:func:`_let`), so no step is evaluated twice.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# The platform markup removed from article HTML before cleaning (sub-title spans,
# author links, title divs and PGC comment blocks): opening, closing.
PLATFORM_TAGS = [
    ('<span class="sub-title"', "</span>"),
    ('<a class="author-name-link pgc-link"', "</a>"),
    ('<div class="tt-title"', "</div>"),
]
PLATFORM_COMMENT = ("{!-- PGC_", "--}")

# Rich-content payload markers; where a payload is not valid JSON, the text between the text key and the spans
# key counts (left JSON-escaped).
RICH_MARKER = '"rich_content"'
RICH_TEXT_PATH = "$.rich_content.text"
RICH_OPENING = '{"rich_content":{"text":"'
RICH_CLOSING = '","spans'

# The empty-image placeholder and the voice / video blocks removed from
# converted text.
IMAGE_PLACEHOLDER = "![]({{image_domain}}{)"
MEDIA_BLOCKS = [
    (r"\{!--[ \t\r\n]*PGC_VOICE:\{", "--}"),
    (r"\{!--[ \t\r\n]*PGC_VIDEO:\{", "--}"),
]

BLOCK_TAGS = (
    "p|div|h[1-6]|li|tr|article|section|header|footer|blockquote|ul|ol|table|nav|main|aside|"
    "figure|figcaption|pre|dd|dt"
)
INLINE_TAGS = "b|strong|i|em|u|s|span|font|code|small|big|sub|sup|mark|tt"
DROPPED_TAGS = ("head", "script", "style", "noscript")
# Named references: the HTML 4 set of the standard library, and ``&apos;``. A no-break space becomes a space.
ENTITY_NAMES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}

# White space inside a tag: a tag name ends there, so <head> is not <header>.
_WS = "[ \\t\\r\\n]"
_END = "(?=[ \\t\\r\\n/>])"
_REFERENCE = r"\A(#(?:[xX]0*[0-9a-fA-F]{1,6}|0*[0-9]{1,7})|[a-zA-Z][a-zA-Z0-9]{1,9});"
_LINKS = [rf"(?is)\Aa{_WS}[^>]*href={q}([^{q}]*){q}[^>]*>(.*)\z" for q in "\"'"]
_PLACEHOLDER_IMAGE = r'(?is)\Aimg[^>]*src="\{\{image_domain\}\}[^>]*>'
_IMAGES = [rf"(?is)\Aimg[^>]*src={q}([^{q}]*){q}[^>]*>" for q in "\"'"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _then(value: Column, *steps: Callable[[Column], Column]) -> Column:
    for step in steps:
        value = _let(value, step)
    return value


def _built_once(function: Callable[[Column], Column]) -> Callable[[str | Column], Column]:
    """The expression over a column name is built once per Spark context: it takes thousands of calls into the JVM."""
    kept = functools.lru_cache(maxsize=64)(lambda context, name: function(F.col(name)))

    @functools.wraps(function)
    def call(c: str | Column) -> Column:
        context = SparkContext._active_spark_context
        return kept(context, c) if isinstance(c, str) and context is not None else function(_c(c))

    return call


def cut_blocks(c: Column, opening: str, closing: str, bracket: bool = False, partial: str | None = None) -> Column:
    """``c`` without the stretches from an opening to the next closing (both patterns); openings that are never closed stay.

    With ``bracket`` a ``>`` must follow the opening before the closing counts. ``partial`` is what a piece ends with when the
    closing needle overlaps an opening.
    """
    start = opening if partial is None else f"{opening}|{partial}"

    def halved(p: Column, last: Column) -> Column:
        # Before the first opening and after it; the third entry says what the piece ended with. Nothing closes the last piece.
        halves = F.split(p, start, 2)
        if partial is not None:
            found = F.when(p.rlike(opening), F.lit("")).otherwise(F.right(p, F.lit(8)))
            halves = _let(halves, lambda h: F.when(F.size(h) == 1, h).otherwise(F.concat(h, F.array(found))))
        return F.when(last, F.array(p)).otherwise(halves)

    def letter(halves: Column, last: Column) -> Column:
        if bracket:
            complete = halves[1].contains(">")
        else:
            complete = F.lit(True) if partial is None else ~halves[2].rlike(partial)
        # z: last piece; o: no opening; c: opened, closed by the piece's end; t: its tag ends in the closing needle
        return F.when(last, "z").when(F.size(halves) == 1, "o").when(complete, "c").otherwise("t")

    def rebuilt(pieces: Column, halves: Column, needles: Column, marks: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            mark = F.get(marks, i)
            whole = F.concat(p, F.coalesce(F.get(needles, i), F.lit("")))
            kept = F.get(F.get(halves, i), F.lit(0))
            return F.when(mark == "z", p).when(mark == "i", "").when(mark.isin("c", "a"), kept).otherwise(whole)

        return F.array_join(F.transform(pieces, piece), "")

    def cut(text: Column, pieces: Column) -> Column:
        final = F.size(pieces) - 1

        def with_letters(halves: Column, letters: Column) -> Column:
            # A t outside a block opens one that swallows the next piece, if that one has a closing.
            marks = F.split(F.regexp_replace(letters, "t[^z]", "ai"), "")
            # The closing needles of kept pieces, as they were written.
            needles = F.when(letters.rlike("[ot]"), F.regexp_extract_all(text, F.lit(closing), F.lit(0)))
            return _let(needles, lambda n: _let(marks, lambda m: rebuilt(pieces, halves, n, m)))

        def with_halves(halves: Column) -> Column:
            letters = F.array_join(F.transform(halves, lambda h, i: letter(h, i == final)), "")
            return _let(letters, lambda found: with_letters(halves, found))

        return _let(F.transform(pieces, lambda p, i: halved(p, i == final)), with_halves)

    def split(text: Column) -> Column:
        return _let(F.split(text, closing), lambda pieces: F.when(F.size(pieces) == 1, text).otherwise(cut(text, pieces)))

    return _let(c, lambda text: F.when(text.rlike(opening), split(text)).otherwise(text))


def _replace(pattern: str, by: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, F.lit(pattern), F.lit(by))


def _drop_blocks(c: Column) -> Column:
    for tag in DROPPED_TAGS:
        c = cut_blocks(c, f"(?i)<{tag}{_END}", f"(?i)</{tag}{_WS}*>", bracket=True)
    return cut_blocks(c, "<!--", "-->", partial=r"<!-?\z")


def _links_and_images(text: Column) -> Column:
    """Tags to Markdown or nothing, piece by piece; every ``<`` of ``text`` has a ``>`` after it."""

    def with_pieces(pieces: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            link = F.get(pieces, i + 1).rlike(rf"\A/[aA]{_WS}*>")
            halves = F.split(p, ">", 2)
            plain = _let(halves, lambda h: F.when(F.size(h) == 2, F.get(h, F.lit(1))).otherwise(""))
            return (
                F.when(i == 0, p)
                .when(link & p.rlike(_LINKS[0]), F.regexp_replace(p, F.lit(_LINKS[0]), F.lit("[$2]($1)")))
                .when(link & p.rlike(_LINKS[1]), F.regexp_replace(p, F.lit(_LINKS[1]), F.lit("[$2]($1)")))
                .when(~F.lower(F.left(p, F.lit(3))).eqNullSafe("img"), plain)
                .when(p.rlike(_PLACEHOLDER_IMAGE), F.regexp_replace(p, F.lit(_PLACEHOLDER_IMAGE), F.lit("")))
                .when(p.rlike(_IMAGES[0]), F.regexp_replace(p, F.lit(_IMAGES[0]), F.lit("![]($1)")))
                .when(p.rlike(_IMAGES[1]), F.regexp_replace(p, F.lit(_IMAGES[1]), F.lit("![]($1)")))
                .otherwise(plain)
            )

        return F.array_join(F.transform(pieces, piece), "")

    return _let(F.split(text, "<"), with_pieces)


def _tags(c: Column, markdown: bool) -> Column:
    """``c`` without tags; what follows the last ``>`` has none."""
    steps = [_replace(f"(?i)<br{_END}[^>]*>", "\n"), _replace(f"(?i)</(?:{BLOCK_TAGS}){_WS}*>", "\n")]
    if markdown:
        for n in range(1, 7):
            steps.append(_replace(f"(?i)<h{n}[^>]*>", "\n" + "#" * n + " "))
        steps.append(_replace(f"(?i)<li{_END}[^>]*>", "\n* "))
        steps.append(_replace(f"(?i)</?(?:{INLINE_TAGS}){_END}[^>]*>", ""))
        special = f"(?i)<(?:a{_WS}|img)"
        steps.append(lambda t: F.when(t.rlike(special), _links_and_images(t)).otherwise(F.regexp_replace(t, "<[^>]*>", "")))
    else:
        steps.append(_replace("<[^>]*>", ""))

    def split(text: Column) -> Column:
        def with_tail(tail: Column) -> Column:
            head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
            return F.concat(_then(head, *steps), tail)

        return _let(F.substring_index(text, ">", -1), with_tail)

    return _let(c, split)


def _decode_references(c: Column) -> Column:
    """Character references, each decoded once; unknown or unclosed ones and numbers that are no character stay."""
    names = F.from_json(F.lit(json.dumps(ENTITY_NAMES)), "map<string,string>")  # a constant once the plan is optimized

    def character(body: Column) -> Column:
        def of(code: Column) -> Column:
            valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
            char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
            return F.when(code == 160, F.lit(" ")).when(valid, char)

        hexadecimal = F.substring(body, 2, 1).isin("x", "X")
        digits = F.when(hexadecimal, F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(F.substr(body, F.lit(2)))
        return F.when(body.startswith("#"), _let(digits.cast("int"), of)).otherwise(F.try_element_at(names, body))

    def part(p: Column, i: Column) -> Column:
        """A piece that followed an ampersand."""

        def with_body(body: Column) -> Column:
            return F.when(body == "", F.concat(F.lit("&"), p)).otherwise(
                _let(
                    character(body),
                    lambda x: F.when(x.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(x, F.substr(p, F.length(body) + 2))),
                )
            )

        return F.when(i == 0, p).otherwise(_let(F.regexp_extract(p, _REFERENCE, 1), with_body))

    def decode(text: Column) -> Column:
        return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), part), "")).otherwise(text)

    return _let(c, decode)


def _collapse(c: Column) -> Column:
    steps = [_replace("[ \\t\\f\\r\\x0B]+", " "), _replace(" ?\\n[ \\n]*", "\n"), lambda t: F.btrim(t, F.lit(" \n"))]
    return _then(c, *steps)


def _text(c: Column, markdown: bool) -> Column:
    """Tag steps are skipped for texts without ``<``."""
    tagless = _let(c, lambda t: F.when(t.contains("<"), _tags(_drop_blocks(t), markdown)).otherwise(t))
    return _collapse(_decode_references(tagless))


@_built_once
def strip_platform_markup(c: Column) -> Column:
    """Without the platform's sub-title spans, author links, title divs and PGC blocks."""
    for opening, closing in PLATFORM_TAGS:
        c = cut_blocks(c, re.escape(opening), closing, bracket=True)
    return cut_blocks(c, re.escape(PLATFORM_COMMENT[0]), re.escape(PLATFORM_COMMENT[1]))


@_built_once
def strip_html(c: Column) -> Column:
    """HTML to plain text: drop head/script/style/comments, line breaks for ``br`` and block
    ends, drop other tags (``<[^>]*>``), decode character references, collapse
    blanks and trim."""
    return _text(c, markdown=False)


@_built_once
def html_to_text(c: Column) -> Column:
    """HTML to Markdown-like text (``#`` headings, ``*`` list items, ``[text](href)`` links,
    ``![](src)`` images; placeholder images dropped), then remove voice / video blocks."""
    out = F.replace(_text(c, markdown=True), F.lit(IMAGE_PLACEHOLDER), F.lit(""))
    for opening, closing in MEDIA_BLOCKS:
        out = cut_blocks(out, opening, re.escape(closing))
    return F.btrim(out, F.lit(" \n"))


def _json_text(c: Column, otherwise: Callable[[Column], Column]) -> Column:
    """``rich_content.text`` of a payload that is JSON as a whole.

    The payload is parsed once, as the first entry of an array whose second is the payload's own hash: a payload with
    something after its value does not bring that entry to its place.
    """

    def parsed(text: Column) -> Column:
        own = F.xxhash64(text)
        value = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), own.cast("string"), F.lit("]")))

        def read(v: Column) -> Column:
            whole = F.try_variant_get(v, "$[1]", "bigint") == own
            found = F.when(whole, F.try_variant_get(v, "$[0].rich_content.text", "string"))
            return F.coalesce(found, otherwise(text))

        return _let(value, read)

    return _let(c, parsed)


@_built_once
def rich_text(c: Column) -> Column:
    """``rich_content.text`` of a JSON payload; when the payload is not JSON as a whole (raw control characters in a
    string, a repeated key, text after the value), the text between the text key and the spans key (left JSON-escaped); null when
    neither works."""

    def fallback(text: Column) -> Column:
        after = F.get(F.split(text, re.escape(RICH_OPENING), 2), F.lit(1))
        inside = F.split(after, re.escape(RICH_CLOSING), 2)
        return _let(inside, lambda h: F.when(F.size(h) == 2, F.get(h, F.lit(0))))

    return _json_text(c, fallback)


@_built_once
def html_json_to_text(c: Column) -> Column:
    """Convert, remove newlines and triple backslashes, then read ``rich_content.text`` of the
    result as JSON; null when it does not parse."""
    flat = F.replace(F.replace(html_to_text(c), F.lit("\n"), F.lit("")), F.lit("\\\\\\"), F.lit(""))
    return _json_text(flat, lambda _: F.lit(None).cast("string"))


def route(c: str | Column) -> Column:
    """``rich`` when the payload mentions the rich-content key, else ``html``."""
    return F.when(_c(c).contains(RICH_MARKER), F.lit("rich")).otherwise(F.lit("html"))


@_built_once
def clean_article(c: Column) -> Column:
    return F.when(route(c) == "rich", rich_text(c)).otherwise(strip_html(strip_platform_markup(c)))
