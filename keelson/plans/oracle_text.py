"""DuckDB twins of ``keelson.functions.text``: the same contract as chains of patterns.

The library scans tags and cuts intervals; the twin states what comes out as one global replacement after the other, which DuckDB's
engine runs in linear time per match. They agree on markup whose tags are not nested inside one another's angle brackets.

Step kinds: ``("re", pattern, replacement)``, ``("lit", text, replacement)`` and ``("entities", "", "")``; group references
in replacements are written ``{1}``.
"""

from __future__ import annotations

import re

from keelson.functions.text import BLOCK_TAGS, ENTITY_NAMES, IMAGE_PLACEHOLDER, INLINE_TAGS

_IN = " \\t\\r\\n"
_WS = f"[{_IN}]"
_NUMBER = r"(?s)\A#(?:[xX]0*([0-9a-fA-F]{1,6})|0*([0-9]{1,7}));.*\z"
_NAME = r"(?s)\A([a-zA-Z][a-zA-Z0-9]{1,9});.*\z"
RICH_FALLBACK = r'(?s)\{"rich_content":\{"text":"(.*?)","spans'

_PLATFORM_PATTERNS = [
    r'(?s)<span class="sub-title".*?>.*?</span>',
    r'(?s)<a class="author-name-link pgc-link".*?>.*?</a>',
    r'(?s)<div class="tt-title".*?>.*?</div>',
    r"(?s)\{!-- PGC_.*?--\}",
]

_MEDIA_PATTERNS = [
    r"(?s)\{!--[ \t\r\n]*PGC_VOICE:\{.*?--\}",
    r"(?s)\{!--[ \t\r\n]*PGC_VIDEO:\{.*?--\}",
]

_DROP_BLOCKS = [
    ("re", rf"(?is)<head(?:[{_IN}/][^>]*)?>.*?</head{_WS}*>", ""),
    ("re", rf"(?is)<script(?:[{_IN}/][^>]*)?>.*?</script{_WS}*>", ""),
    ("re", rf"(?is)<style(?:[{_IN}/][^>]*)?>.*?</style{_WS}*>", ""),
    ("re", rf"(?is)<noscript(?:[{_IN}/][^>]*)?>.*?</noscript{_WS}*>", ""),
    ("re", r"(?s)<!--.*?-->", ""),
]
_BREAKS = [
    ("re", rf"(?i)<br(?:[{_IN}/][^>]*)?>", "\n"),
    ("re", rf"(?i)</({BLOCK_TAGS}){_WS}*>", "\n"),
]
_MARKDOWN = [
    *[("re", rf"(?i)<h{n}[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)],
    ("re", rf"(?i)<li(?:[{_IN}/][^>]*)?>", "\n* "),
    # Link text without nested tags: a bounded class instead of a lazy match, so an unclosed
    # <a> cannot make the scan run to the end of the text once per tag.
    # Formatting tags go first; so a link may hold them.
    ("re", rf"(?i)</?(?:{INLINE_TAGS})(?:[{_IN}/][^>]*)?>", ""),
    ("re", rf"(?i)<a[{_IN}][^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a{_WS}*>", "[{2}]({1})"),
    ("re", rf"(?i)<a[{_IN}][^>]*href='([^']*)'[^>]*>([^<]*)</a{_WS}*>", "[{2}]({1})"),
    ("re", r'(?i)<img[^>]*src="\{\{image_domain\}\}[^>]*>', ""),
    ("re", r'(?i)<img[^>]*src="([^"]*)"[^>]*>', "![]({1})"),
    ("re", r"(?i)<img[^>]*src='([^']*)'[^>]*>", "![]({1})"),
]
_TAGS = [("re", r"<[^>]*>", "")]
_ENTITIES = [("entities", "", "")]
_BLANKS = [
    ("re", "[ \\t\\f\\r\\x0B]+", " "),
    ("re", " ?\\n[ \\n]*", "\n"),  # no repeated group: those recurse once per round
    ("re", "\\A[ \\n]+|[ \\n]+\\z", ""),
]

STRIP_HTML_STEPS = [*_DROP_BLOCKS, *_BREAKS, *_TAGS, *_ENTITIES, *_BLANKS]
MARKDOWN_STEPS = [*_DROP_BLOCKS, *_BREAKS, *_MARKDOWN, *_TAGS, *_ENTITIES, *_BLANKS]
MEDIA_STEPS = [("lit", IMAGE_PLACEHOLDER, "")] + [("re", p, "") for p in _MEDIA_PATTERNS] + [
    ("re", "\\A[ \\n]+|[ \\n]+\\z", "")
]
PLATFORM_STEPS = [("re", p, "") for p in _PLATFORM_PATTERNS]


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2_repl(r: str) -> str:
    r = r.replace("\\", "\\\\")
    return re.sub(r"\{(\d)\}", r"\\\1", r)


def steps_sql(expr: str, steps) -> str:
    """The chain as DuckDB text."""
    for kind, pat, repl in steps:
        if kind == "entities":
            expr = _entities_sql(expr)
        elif kind == "re":
            expr = f"regexp_replace({expr}, {sql_str(pat)}, {sql_str(_re2_repl(repl))}, 'g')"
        else:
            expr = f"replace({expr}, {sql_str(pat)}, {sql_str(repl)})"
    return expr


def _entities_sql(expr: str) -> str:
    names = ", ".join(f"{sql_str(k)}: {sql_str(v)}" for k, v in ENTITY_NAMES.items())
    number, name = sql_str(_NUMBER), sql_str(_NAME)
    code = (
        f"CASE WHEN regexp_extract(p, {number}, 1) <> '' THEN CAST('0x' || regexp_extract(p, {number}, 1) AS INTEGER) "
        f"ELSE TRY_CAST(regexp_extract(p, {number}, 2) AS INTEGER) END"
    )
    valid = f"(({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111)"
    char = f"CASE WHEN {valid} THEN CASE WHEN ({code}) = 160 THEN ' ' ELSE chr({code}) END ELSE MAP {{{names}}}[regexp_extract(p, {name}, 1)] END"
    decoded = f"coalesce(({char}) || substr(p, strpos(p, ';') + 1), '&' || p)"
    return f"array_to_string(list_transform(str_split({expr}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {decoded} END), '')"
