"""Page functions on hand-written and random markup; native rules against a tag tree."""

import html
import json
import random
import time

from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.operators import extract as X
from tests.plain_html import read_fields

EVENT = """<html><head><title>Talk</title></head><body>
<h1 id="page-title"> Big Data &amp; You </h1>
<div class="x event__label">Seminar</div>
<div class="event__date"><time datetime="2018-12-04">Tuesday, December 4 -</time>
 <span class="date-display-start">11:00am</span><span class="date-display-end">1:00pm</span></div>
<ul class="event__location-information semantic"><li>Hall 1</li><li>Floor 2</li></ul>
<li class="event__speaker-name"><a href="/p"> Ada </a></li>
<div class="event__content"><p>One.</p><p>Two.</p></div>
</body></html>"""

NESTED = EVENT.replace("<p>One.</p>", "<div><div><p>Zero.</p></div><p>One.</p></div>")

TALK = """<html><body><h1 id="page-title"> Systems </h1>
<div class="field field-name-field-date"><div class="field-item even"><span class="date-display-start" content="2018-09-01T10">10</span></div></div>
<div class="field-name-field-location">1240 CS</div>
<section class="field-name-field-speaker-name"><div class="field-items">Grace</div></section>
<section class="field-name-field-speaker-institution"><div class="field-items">Navy</div></section>
<section class="field-name-body"><p>All <b>text</b></p></section></body></html>"""


def one(spark, page, column):
    return spark.createDataFrame([(page,)], "html STRING").select(column(F.col("html")).alias("v")).first()["v"]


def native_fields(spark, page, rules):
    df = spark.createDataFrame([(page,)], "html STRING")
    return H.with_fields(df, F.col("html"), rules, "f").first()["f"].asDict()


def test_title(spark):
    assert one(spark, "<head><TITLE x=1> A &lt;b&gt; </TITLE></head><body>", H.title_text) == " A <b> "
    assert one(spark, "<head><title></title></head><body>", H.title_text) is None
    assert one(spark, "<head></head><body><svg><title>no</title></svg>", H.title_text) is None
    assert one(spark, "<head><!-- <title>no</title> --><title>yes</title></head>", H.title_text) == "yes"


def test_text(spark):
    page = "<head><title>t</title></head><body class=x>a<!-- c <b> -->b<script>var x;</script><p>d &amp;amp; e</body>tail"
    assert one(spark, page, H.body_text) == "abvar x;d &amp; etail"
    assert one(spark, page, lambda h: H.body_text(h, strip_script=True)) == "abd &amp; etail"
    assert one(spark, "<body>open", H.body_text) == "open"
    assert one(spark, "no body", H.body_text) == "no body"


def test_body_bounds_follow_the_lexical_rules(spark):
    """Bounds in scripts, comments and attributes count for nothing; a body not written starts with its content."""
    head = "<html><head><title>T</title></head>"
    for page, text in {
        "<p>no body tag</p>": "no body tag",
        head + "<p>a</p>b": "ab",
        head + "\n<div>a</div>\n": "a\n",
        "<body>a<script>var x='</body>';</script>b</body>": "avar x='</body>';b",
        "<!-- <body> -->x<body>y</body>": "xy",
        head + "<!-- <body> -->\n<body>y<!-- </body> -->z</body>": "yz",
        "<body>a</body><p>late</p>": "alate",
        head + "<body>a</body>\n</html>\n": "a",
        '<body><a title="x > y">t</a></body>': "t",
        "<body><a title=it's>t</a> <a title='x'>u</a></body>": "t u",
        head + "<script>if (a < b) '<body>'</script><body>x < y, <3, a<b</body>": "x < y, <3, a",
        "<body><textarea><b>&lt;</textarea><style>&lt;</style><!-->c<!--->d<!-- e": "<b><&lt;cd",
        "<body>a<?php x ?>b</>c</ d>e<!x>f": "abcef",
        "<BODY CLASS='x>'>up</BODY >": "up",
        "": "",
        head: "",
    }.items():
        assert one(spark, page, H.body_text) == text, page
    assert one(spark, None, H.body_text) is None


def test_title_follows_the_lexical_rules(spark):
    for page, title in {
        "<head><script>'<body'</script><title>T</title></head>": "T",
        "<head><!-- <body> --><title>a <b> &copy c</title>": "a <b> © c",
        "<head><meta content='<title>no</title>'><title lang=en>yes</title>": "yes",
        "<title>one</title><title>two</title>": "one",
        "<head></head><p>x</p><title>late</title>": None,
        "<head><title></title>": None,
        "": None,
    }.items():
        assert one(spark, page, H.title_text) == title, page


def test_references_are_those_of_the_standard_library(spark):
    texts = ["a &amp; b", "&amp;lt;", "&eacute;&Eacute;", "&#233;&#xE9;", "&nosuch; &", "x&copy;y&middot;", "&#128512;", "none", "", "&&amp;&"]
    texts += ["&apos;", "&#00000065;", "&amp x", "&notit;", "&notin;", "&ampamp;", "&#x0000041", "&#0;|&#55296;|&#1114112;", "&#150;&#x80;&#129;"]
    texts += ["&#1;&#11;&#13;&#127;&#64976;&#65535;", "&NotEqualTilde;&fjlig;", "&NewLine;&Tab;&equals;", "&lt&gt&LT&GT", "&#;&#x;&#xg;", "&#99999999999;"]
    rng, alphabet = random.Random(1), ["&", "#", "x", "4", "1", "0", "amp", "not", "in", "copy", "lt", ";", " ", "é", "=", "NotEqualTilde", "sup1", "frac1"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for r in df.select("t", H.decode_entities(F.col("t")).alias("d")).collect():
        assert r["d"] == html.unescape(r["t"]), r["t"]


def test_references_in_attributes(spark):
    """Without its ";" a name before "=", a letter or a digit stays as it is."""
    for token, want in {'"?a=1&copy=2"': "?a=1&copy=2", '"?a&amp;b"': "?a&b", "?x&ltd": "?x&ltd", "'&lt'": "<", '"&copy;=1"': "©=1", '"&#65a"': "Aa"}.items():
        assert one(spark, token, H.unquote) == want


def test_anchors(spark):
    page = """<a href="/1">x</a><A class='k' HREF='/2'><a href=/3>y<!-- <a href="/no"> --><abbr href="/no">
      <script>"<a href='/no'>"</script><a data-href="/no"><a href="?a=1&amp;b=2"><a href="">"""
    got = spark.createDataFrame([(page,)], "html STRING").select(
        F.transform(H.anchor_tokens(F.col("html")), H.unquote).alias("v")
    )
    assert got.first()["v"] == ["/1", "/2", "/3", "?a=1&b=2", ""]


def test_scoped_anchors(spark):
    page = '<ul class="l s"><li><a href="/in"></ul><a href="/out"><ul class="other"><a href="/out2"></ul>'
    assert one(spark, page, lambda h: H.scoped_anchor_tokens(h, "ul", "class", "l s")) == ['"/in"']


def test_dash_clean(spark):
    for day, want in {"Tuesday -": "Tuesday", "Tue--": "Tue", "Tue": "Tue", "a-b": "a-b", "-": ""}.items():
        assert one(spark, day, H.dash_clean) == want


def test_event_rules(spark):
    got = native_fields(spark, EVENT, X.EVENT_RULES)
    assert got == read_fields(EVENT, X.EVENT_RULES)[0] == {
        "title": "Big Data & You", "event_type": "Seminar", "start_time": "11:00am", "end_time": "1:00pm",
        "day": "Tuesday, December 4", "location": "Hall 1\nFloor 2", "speaker": "Ada", "body": "One.\nTwo.",
    }
    assert native_fields(spark, NESTED, X.EVENT_RULES)["body"].split("\n") == ["Zero.", "One.", "Two."]


def random_page(rng):
    """Tags, texts, references, comments and scripts in any order; ends that match nothing and starts that never end."""
    tags = ["div", "p", "ul", "li", "span", "section", "b", "ol", "h1", "br", "DIV"]
    attrs = ["", ' class="k"', " class='a k b'", " class=k id=x", ' id="x" data-v="1 > 0"', ' class="k&amp;m"', " hidden"]
    out = []
    for _ in range(rng.randrange(40)):
        out.append(
            rng.choice([
                lambda: f"<{rng.choice(tags)}{rng.choice(attrs)}>", lambda: f"</{rng.choice(tags)}>", lambda: rng.choice(["a", " b ", "&amp;", "c&lt", "\n", "é"]),
                lambda: f"<{rng.choice(tags)}{rng.choice(attrs)}>", lambda: f"</{rng.choice(tags)}>", lambda: "<!-- <div> -->", lambda: "<script>'<li>&amp;'</script>",
                lambda: "<img class=k>", lambda: "t < u ",
            ])()
        )
    return "".join(out)


def test_random_pages_against_a_tag_tree(spark):
    R = H.FieldRule
    scope = R("s", "div", "class", "k", "token")
    rules = [
        R("first", "div", "class", "k", text="own"), R("all", "li"), R("join", "p", take="join"), R("below", "div", take="join", text="below"),
        R("own", "div", take="join", text="own"), R("only", "span", take="must", text="only", trim=False), R("must", "section", take="must"),
        R("attr", "div", "class", take="attr", attr="id"), R("inside", "b", take="join", inside=scope), R("child", "li", take="join", text="own", inside=R("u", "ul"), child=True),
        R("has", "div", "hidden", text="own"), R("contains", "div", "class", "&", "contains", take="join"), R("deep", "span", take="join", inside=R("t", "p", inside=scope)),
        R("script", "script", take="join"), R("list", "li", take="join", text="below"),
    ]
    rng = random.Random(7)
    pages = [random_page(rng) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(pages)), "i INT, html STRING").repartition(8)
    got = {r["i"]: r["f"].asDict() for r in H.with_fields(df, F.col("html"), rules, "f").collect()}
    for i, page in enumerate(pages):
        for rule in rules:
            want = read_fields(page, [rule])[0][rule.name]
            assert got[i][rule.name] == want, (rule, page)


def test_regions_take_linear_time(spark):
    scoped = F.size(H.scoped_anchor_tokens(F.col("html"), "div", "class", "k"))
    count = F.size(H.regions(F.col("html"), "div"))
    flat, nested = '<div class="k"><a href="/x">y</a></div>' * 8_000, '<div class="k">' * 8_000 + "x" + "</div>" * 8_000
    spark.createDataFrame([(EVENT,)], "html STRING").select(scoped, count).collect()
    for page, column, want in ((flat, scoped, 8_000), (flat, count, 8_000), (nested, scoped, 0)):
        df = spark.createDataFrame([(page,)], "html STRING").select(column)
        start = time.perf_counter()
        assert df.first()[0] == want
        assert time.perf_counter() - start < 8  # quadratic work takes minutes; a shared machine may be slow


def test_empty_page_gives_empty_event_and_failed_talk(spark):
    event, talk = (extracted(spark, "<html></html>", e) for e in (X.event_extractor(), X.talk_extractor()))
    assert set(json.loads(event["record"]).values()) == {"", "http://h/1"} and event["failure"] is None
    assert talk["failure"] == "missing_title"


def extracted(spark, page, extractor):
    df = spark.createDataFrame([("h", page, "http://h/1"), ("other", "<p>", "http://h/2")], "handler STRING, html STRING, url STRING")
    out = X.with_extraction(df, [("h", extractor)], "handler", "html", "url", F.lit(True)).orderBy("url").collect()
    assert out[1]["record"] is None and not out[1]["has_record"]
    return out[0]


def test_talk_record_is_nested(spark):
    want = {
        "url": "http://h/1", "title": "Systems", "start_time": "2018-09-01T10", "end_time": None, "location": "1240 CS",
        "speaker": {"name": "Grace", "from": "Navy"}, "body": "All text",
    }
    assert json.loads(extracted(spark, TALK, X.talk_extractor())["record"]) == want


def test_missing_required_parts_fail_the_row(spark):
    for cut, put, failure in (
        ("field-name-field-location", "elsewhere", "missing_location"),
        (' content="2018-09-01T10"', "", "missing_start_time"),
        ("> Systems <", "> <b>Sys</b>tems <", "missing_title"),
    ):
        assert extracted(spark, TALK.replace(cut, put), X.talk_extractor())["failure"] == failure
    several = TALK.replace(">Grace<", "><i>Gra</i>ce<")
    got = extracted(spark, several, X.talk_extractor())
    assert got["failure"] is None and json.loads(got["record"])["speaker"]["name"] is None


def test_regions_follow_nesting(spark):
    def inside(page, *rule):
        return one(spark, page, lambda html: H.regions(html, *rule))

    outer = '<ul class="t"><li><a href="/1">a</a><ul><li><a href="/2">b</a></li></ul></li><li><a href="/3">c</a></ul><a href="/4">'
    assert inside(outer, "ul", "class", "t") == [outer[len('<ul class="t">') : -len('</ul><a href="/4">')]]
    assert one(spark, outer, lambda html: H.scoped_anchor_tokens(html, "ul", "class", "t")) == ['"/1"', '"/2"', '"/3"']
    assert inside('<ul class="t"><li><a href="/1">a</a>', "ul", "class", "t") == ['<li><a href="/1">a</a>']
    assert inside("<div>a<div>b</div>c</div></div><div>d", "div") == ["a<div>b</div>c", "b", "d"]
    assert inside("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>f<ol><li>g</li>h</ol>", "li") == ["a<ul><li>b<li>c</ul>d", "b", "c", "e", "g"]
    assert inside('<p>a<p>b</p>x<P id="1>2">c<b>d<p>e<div>f</div>g<p>h</section>i', "p") == ["a", "b", "c<b>d", "e", "h</section>i"]
    assert inside("no tags", "p") == inside("", "li") == inside("<pre>a</pre>", "p") == []


def test_script_text_is_no_title(spark):
    page = "<head><script>var x = '<title>no</title>';</script><title>Yes</title></head><body></body>"
    assert one(spark, page, H.title_text) == "Yes"


def test_anchors_are_read_attribute_by_attribute(spark):
    page = """<a title="a > b" href="/1"><a title='x href="/bad"' href="/good"><a HREF = /3 class=x><a name="n"><a data-href="/no">
    <abbr href="/no"><a\nclass='k'\nhref='/4'>"""
    assert one(spark, page, H.anchor_tokens) == ['"/1"', '"/good"', "/3", "'/4'"]
