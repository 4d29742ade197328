"""Golden payloads for the article extraction (invented text in the shapes the reference handles)."""

import pytest
from pyspark.sql import functions as F

from keelson.functions import text as T
from keelson.operators.text import clean_articles


def _one(spark, fn, payload):
    df = spark.createDataFrame([(payload,)], "c string")
    return df.select(fn(F.col("c")).alias("t")).first().t


def test_rich_valid_json(spark):
    p = '{"rich_content":{"text":"Line one\\nLine \\"two\\"","spans":[]},"id":1}'
    assert _one(spark, T.rich_text, p) == 'Line one\nLine "two"'


def test_rich_json_with_raw_newlines_is_still_read(spark):
    p = '{"rich_content":{"text":"first\nsecond","spans":[{"a":1}]}}'
    assert _one(spark, T.rich_text, p) == "first\nsecond"


def test_rich_truncated_json_uses_the_fallback_left_escaped(spark):
    p = '{"rich_content":{"text":"keep \\"this\\"","spans":[{"start":0'
    assert _one(spark, T.rich_text, p) == 'keep \\"this\\"'


def test_rich_truncated_without_spans_marker_fails_to_null(spark):
    assert _one(spark, T.rich_text, '{"rich_content":{"text":"no end here') is None


def test_rich_json_without_text_key(spark):
    p = '{"rich_content":{"title":"x","spans":[]}}'
    assert _one(spark, T.rich_text, p) is None


def test_platform_markup_multiline_and_pgc_blocks(spark):
    p = (
        '<p>keep</p><span class="sub-title" data-a="1">sub\nline</span>'
        '<a class="author-name-link pgc-link" href="/x">who\nis</a><div class="tt-title">T</div>'
        '{!-- PGC_VOICE:{"id":"1"} --}<p>also</p>'
    )
    assert _one(spark, T.strip_platform_markup, p) == "<p>keep</p><p>also</p>"


def test_strip_html_nested_tags_scripts_entities(spark):
    p = (
        "<html><head><title>t</title><style>p{}</style></head><body>"
        '<script>var s="</p>";</script><!-- c --><div><p>A <b>bold</b> &amp; <i>it</i></p>'
        "<p>x &amp;lt; y&nbsp;z</p><br/>tail</div></body></html>"
    )
    assert _one(spark, T.strip_html, p) == "A bold & it\nx &lt; y z\ntail"


def test_strip_html_image_with_json_src_and_video_in_paragraph(spark):
    p = (
        '<p>before</p><img src="{{image_domain}}{"uri": "a/b", "w": 3}"><p>{!-- PGC_VIDEO:{"vid":"v"} --}'
        "after</p>"
    )
    out = _one(spark, T.html_to_text, p)
    assert "PGC_VIDEO" not in out and "before" in out and "after" in out and "image_domain" not in out


def test_markdown_headings_lists_links(spark):
    p = '<h2>Title</h2><ul><li>one</li><li><a href="/u">two</a></li></ul>'
    assert _one(spark, T.html_to_text, p) == "## Title\n* one\n* [two](/u)"


@pytest.mark.parametrize("payload", [None, ""])
def test_null_and_empty(spark, payload):
    df = spark.createDataFrame([("k", payload)], "article_id string, content string")
    r = clean_articles(df).first()
    if payload is None:
        assert r.text is None and r.ok is False
    else:
        assert r.route == "html" and r.text == "" and r.ok is True


def test_routes_and_failure_flag(spark):
    rows = [
        ("j", '{"rich_content":{"text":"hi","spans":[]}}'),
        ("h", "<p>hello</p>"),
        ("bad", '{"rich_content": broken'),
    ]
    got = {r.article_id: (r.route, r.text, r.ok) for r in clean_articles(spark.createDataFrame(rows, "article_id string, content string")).collect()}
    assert got == {"j": ("rich", "hi", True), "h": ("html", "hello", True), "bad": ("rich", None, False)}


def test_unclosed_links_do_not_rescan_the_text(spark):
    import time

    junk = "<p>" + ('<a href="/x">unclosed ' * 5000) + "</p>"
    t0 = time.perf_counter()
    out = _one(spark, T.html_to_text, junk)
    assert "unclosed" in out and time.perf_counter() - t0 < 30


def test_character_references_are_decoded_once(spark):
    p = "It&#8217;s &#x27;so&#x27; &#128512; &#0; &#55296; &eacute; &amp;lt; &amp;#39; &bogus; & &#; R&D a&nbsp;&#160;b &#x110000;"
    want = "It’s 'so' 😀 &#0; &#55296; é &lt; &#39; &bogus; & &#; R&D a b &#x110000;"
    assert _one(spark, T.strip_html, p) == want


def test_links_with_single_quotes_and_tags(spark):
    p = "<a class='l' href='/u/2'>A <b>bold</b> link</a> <a href=\"/u/3\"><em>x</em></a><link href=\"/s.css\"> <body>y"
    assert _one(spark, T.html_to_text, p) == "[A bold link](/u/2) [x](/u/3) y"


def _soup(rng):
    """Markup of random tags, closed or not, whose angle brackets are not nested."""
    names = ["p", "div", "b", "h2", "li", "head", "header", "script", "style", "noscript", "span", "x-y", "BR", "Script"]
    parts = []
    for _ in range(rng.randint(0, 25)):
        name = rng.choice(names)
        parts.append(
            rng.choice(
                [
                    f"<{name}>", f"</{name}>", f"</{name} >", f'<{name} class="c">', "<br/>", "<!-- c ", " -->", "-->", "<!-->", "<!--->", "text ", "a > b ",
                    '<a href="/u">', "</a>", "<a href='/v' id=1>", "<A class=x>", '<img src="i.png">', "<img src='j'>", '<img src="{{image_domain}}{x">',
                    "&amp;", "&#65;", "&nope;", "&", " \n ", '<span class="sub-title" x>', '<span class="sub-title"', "</span>", '<div class="tt-title">',
                    "{!-- PGC_V", "--}", '<a class="author-name-link pgc-link" href="/w">',
                ]
            )
        )
    return "".join(parts)


def test_scanner_agrees_with_the_chain_of_patterns(spark, duck):
    import random

    from keelson.plans import oracle_text as O

    rng = random.Random(12)
    rows = [(i, _soup(rng)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, content string")
    got = df.select("k", "content", T.strip_platform_markup("content").alias("p"), T.strip_html("content").alias("s"), T.html_to_text("content").alias("m"))
    table = got.toArrow()
    duck.register("soup", table)
    cases = [("p", O.PLATFORM_STEPS), ("s", O.STRIP_HTML_STEPS), ("m", O.MARKDOWN_STEPS + O.MEDIA_STEPS)]
    for column, steps in cases:
        # An opened tag without its bracket lies inside another's: there the scanner reads tags, the chain patterns.
        plain = "" if column == "p" else "AND NOT regexp_matches(content, '<[^>]*<')"
        sql = f"SELECT k, content, {column}, {O.steps_sql('content', steps)} AS w FROM soup WHERE true {plain}"
        checked = duck.sql(sql).fetchall()
        assert len(checked) > 500
        assert [r for r in checked if r[2] != r[3]] == [], column


@pytest.mark.parametrize("unit", ['<a href=" ', "<script>", "<script ", "<!--", "<img ", '<span class="sub-title"', '<span class="sub-title" </span>', "<", "&#", "{!-- PGC_VIDEO:{", "\n ", '{"rich_content":{"text":"'])
def test_unclosed_markup_is_read_in_linear_time(spark, unit):
    import time

    def seconds(size):
        df = spark.range(1).select(F.repeat(F.lit(unit), F.lit(size // len(unit))).alias("c"))
        each = [f("c") for f in (T.strip_platform_markup, T.strip_html, T.html_to_text, T.rich_text)]
        t0 = time.perf_counter()
        df.select(*[F.length(c).alias(f"n{i}") for i, c in enumerate(each)]).collect()
        return time.perf_counter() - t0

    seconds(1000)
    assert seconds(2_000_000) < 40  # quadratic patterns took this long for 20 kB


def test_blocks_closed_by_their_own_tag_go_on_to_the_next_closing(spark):
    cases = {
        '<span class="sub-title" x</span>a</span>b': "b",
        '<span class="sub-title" x</span>a': '<span class="sub-title" x</span>a',
        '<span class="sub-title" x</span><span class="sub-title" y</span>c</span>d': "c</span>d",
        '</span>k<span class="sub-title">x</span></span>': "</span>k</span>",
    }
    for given, wanted in cases.items():
        assert _one(spark, T.strip_platform_markup, given) == wanted
    assert _one(spark, T.strip_html, "a<!-->b-->c<!-- <!--> d --> e") == "ac d --> e"
    assert _one(spark, T.strip_html, "a<script </script>b</script>c<script>d") == "acd"


@pytest.mark.parametrize("tail", [',"b":1', ",5", "],[1", "x", ",0]", "}", ' {"a":1}'])
def test_payload_with_something_after_its_value_uses_the_fallback(spark, tail):
    p = '{"rich_content":{"text":"kept \\"as is\\"","spans":[]}}'
    assert _one(spark, T.rich_text, p) == 'kept "as is"'
    assert _one(spark, T.rich_text, f" {p}\n") == 'kept "as is"'
    assert _one(spark, T.rich_text, p + tail) == 'kept \\"as is\\"'
    assert _one(spark, T.html_json_to_text, p + tail) is None


def test_references_with_leading_zeros_and_long_names(spark):
    assert _one(spark, T.strip_html, "&#00065;&#x0041;&thetasym;&apos;&notaname;&#;&#x;&#xD800;&#1114112;&amp") == "AAϑ'&notaname;&#;&#x;&#xD800;&#1114112;&amp"
