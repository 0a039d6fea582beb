"""Inputs of the registered queries, all derived from the ``pages`` and ``events`` tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.html import FieldRule
from linkloom.functions.urls import with_url_parts
from linkloom.operators.extract import page_extractor
from linkloom.operators.frontier import COMPLETED, FAILED, PROCESSING, WAITING
from linkloom.plans.capture import latest_captures
from linkloom.operators.routing import canonicalize
from linkloom.presets import event_calendar, talk_calendar
from linkloom.registry import Handler, Registry, Source

# --- fixed values: the demo registry --------------------------------------------------------
UNLISTED_HOSTS = "(spam|casino|pills|bets)"
ARTICLE = ("article", r"^/[a-z]{2}/[0-9]+(\.html)?$", None)
PAGED = ("paged", r"^/[a-z]{2}/", ("page", "ref"))
ANY = ("any", r"^/", None)
PAGE_RULES = [
    FieldRule("heading", "h1"),
    FieldRule("footer", "footer"),
    FieldRule("title", "title"),
    FieldRule("paragraphs", "p", take="join"),
    FieldRule("charset", "meta", "charset", take="attr", attr="charset"),
]
# ---------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _handlers(order: tuple, title_policy: str) -> tuple[Handler, ...]:
    return tuple(Handler(name, ((pattern, keys),), page_extractor(title_policy)) for name, pattern, keys in order)


def demo_sources(order: tuple = (ARTICLE, PAGED, ANY)) -> list[Source]:
    return [
        Source("org", "strip", html_only=True, require_host=True, handlers=_handlers(order, "fail")),
        Source("net", "add", html_only=True, handlers=_handlers(order, "default")),
        Source("com", "keep", drop_query=True, handlers=_handlers(order, "fail")),
    ]


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, host``: distinct page hosts, the source being the host's last label."""
    hosts = with_url_parts(table(spark, sf_dir, "pages").select("url")).select("host").distinct()
    return hosts.where(~F.col("host").rlike(UNLISTED_HOSTS)).select(
        F.substring_index("host", ".", -1).alias("source"), "host"
    )


_registries: dict[tuple, Registry] = {}


def demo_registry(spark: SparkSession, sf_dir: str, variant: str = "default") -> Registry:
    """The demo registry; its host table is written and measured once per session.

    Variants: ``paged_first`` tries the query-set handler first, ``strip`` and ``listed`` put every
    source under that www mode.
    """
    key = (spark.sparkContext.applicationId, sf_dir, variant)
    if key not in _registries:
        sources = demo_sources((PAGED, ARTICLE, ANY) if variant == "paged_first" else (ARTICLE, PAGED, ANY))
        if variant == "strip":
            sources = [replace(s, www_mode="strip", require_host=True, html_only=False, drop_query=False) for s in sources]
        if variant == "listed":
            sources = [replace(s, www_mode="listed", require_host=True, html_only=False, drop_query=False) for s in sources]
        _registries[key] = Registry(sources, page_hosts(spark, sf_dir))
    return _registries[key]


def responses(spark: SparkSession, sf_dir: str, key: str = "page_id") -> DataFrame:
    """Captured responses: by ``page_id % 10``, 0 is a 404, 1 a 301 to the next page (the last
    page's next is the first), 2 was never captured, all others are 200."""
    return responses_of(table(spark, sf_dir, "pages"), table(spark, sf_dir, "pages"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`responses` with an earlier capture of every page, a 404, before each of them."""
    now = responses(spark, sf_dir)
    times = F.explode(F.array(F.lit(1), F.lit(2))).alias("taken")
    return now.select("*", times).withColumns(
        {
            "capture_id": F.col("page_id") * 2 + F.col("taken"),
            "status": F.when(F.col("taken") == 1, 404).otherwise(F.col("status")),
            "location": F.when(F.col("taken") == 2, F.col("location")),
        }
    )


def responses_of(pages: DataFrame, all_pages: DataFrame) -> DataFrame:
    """:func:`responses` of ``pages``, which may be a stream; ``all_pages`` is the whole table."""
    return _with_responses(pages, next_urls(all_pages)).where(F.col("page_id") % 10 != 2)


def next_urls(pages: DataFrame) -> DataFrame:
    """``page_id, next_url``: the URL of page ``(page_id + 1) % n``."""
    n = F.lit(pages.count())
    return pages.select(F.pmod(F.col("page_id") - 1, n).alias("page_id"), F.col("url").alias("next_url"))


def _with_responses(pages: DataFrame, follow: DataFrame) -> DataFrame:
    kind = F.col("page_id") % 10
    return pages.join(follow, "page_id").select(
        "page_id",
        "url",
        F.col("url").alias("final_url"),
        F.when(kind == 0, 404).when(kind == 1, 301).otherwise(200).alias("status"),
        F.when(kind == 1, F.col("next_url")).alias("location"),
        "html",
    )


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs as a link table; status by ``page_id % 4``."""
    return frontier_of(table(spark, sf_dir, "pages"))


def frontier_of(pages: DataFrame) -> DataFrame:
    """:func:`frontier` of ``pages``, which may be a stream."""
    kind = F.col("page_id") % 4
    return pages.select(
        F.col("url").alias("link"),
        F.when(kind == 0, WAITING)
        .when(kind == 1, PROCESSING)
        .when(kind == 2, COMPLETED)
        .otherwise(FAILED)
        .alias("status"),
        F.lit(0).alias("round"),
    )


def crawl_responses(spark: SparkSession, sf_dir: str, registry: Registry) -> DataFrame:
    """Responses keyed by canonical URL, with two more anchors on every page: to pages
    ``(2 * page_id + 1) % n`` and ``(2 * page_id + 2) % n``.

    Pages that share a canonical URL are captures of one page; the highest ``page_id`` counts.
    All of this is settled on narrow columns before the pages themselves are joined, once.
    """
    pages = table(spark, sf_dir, "pages")
    n = F.lit(pages.count())
    urls = pages.select("page_id", "url")
    wanted = urls.select(
        "page_id", F.explode(F.array((2 * F.col("page_id") + 1) % n, (2 * F.col("page_id") + 2) % n)).alias("dst")
    )
    names = urls.select(F.col("page_id").alias("dst"), F.concat(F.lit('<a href="'), "url", F.lit('">')).alias("anchor"))
    anchors = wanted.join(names, "dst").groupBy("page_id").agg(
        F.concat(F.min("anchor"), F.max("anchor")).alias("anchors")
    )
    made = _with_responses(urls.withColumn("html", F.lit("")), next_urls(pages)).where(F.col("page_id") % 10 != 2)
    keyed = (
        canonicalize(made, registry, "url", "canonical")
        .where(F.col("canonical").isNotNull())
        .select("page_id", F.col("canonical").alias("url"), "status", "location")
    )
    narrow = latest_captures(keyed, [], "page_id").join(anchors, "page_id")
    return narrow.join(pages.select("page_id", "html"), "page_id").select(
        "page_id", "url", F.col("url").alias("final_url"), "status", "location", F.concat("html", "anchors").alias("html")
    )


def crawl_seeds(spark: SparkSession, sf_dir: str, registry: Registry) -> DataFrame:
    """One seed per host: the canonical URL of its first page."""
    pages = with_url_parts(table(spark, sf_dir, "pages").select("page_id", "url"))
    known = canonicalize(pages, registry, "url", "link").where(F.col("link").isNotNull())
    return known.groupBy("host").agg(F.min_by("link", "page_id").alias("link")).select("link").distinct()


def calendar_registry(spark: SparkSession, sf_dir: str) -> Registry:
    """An event and a talk calendar on hosts of their own for every listed page host."""
    key = (spark.sparkContext.applicationId, sf_dir, "calendars")
    if key not in _registries:
        kinds = F.explode(F.array(F.lit("events"), F.lit("talks")))
        hosts = page_hosts(spark, sf_dir).select(kinds.alias("source"), "host")
        hosts = hosts.select("source", F.concat("source", F.lit("."), "host").alias("host"))
        _registries[key] = Registry([event_calendar("events"), talk_calendar("talks")], hosts)
    return _registries[key]


# --- fixed values: calendar page layouts, filled with page title, host and number ---------------
EVENT_PAGE = (
    '<html><body><h1 id="page-title"> {t} </h1><div class="big event__label">{h}</div><div class="event__date">'
    '<time datetime="2018">Day {i} -</time> <span class="date-display-start">{i}am</span>'
    '<span class="date-display-end">{i}pm</span></div><ul class="event__location-information semantic"><li>{h}</li>'
    '<li>{i}</li></ul><ul><li class="event__speaker-name"><b>{t}</b></li></ul><div class="event__content">'
    "<p>{t}</p><div><p>{h}</p></div></div></body></html>"
)
TALK_PAGE = (
    '<html><body><h1 id="page-title">{t}</h1><div class="x field-name-field-date"><div class="field-item">'
    '<span class="date-display-start" content="{i}">d</span></div></div><div class="field-name-field-location">{h}</div>'
    '<section class="field-name-field-speaker-name"><div class="field-items">{t}</div></section>'
    '<section class="field-name-field-speaker-institution"><div class="field-items">{h}</div></section>'
    '<section class="field-name-body"><p>{t} <i>{i}</i></p></section></body></html>'
)
MONTH_PAGE = (
    '<html><body><a href="">now</a><a href="/events/{i}?from=list">{t}</a><a href="../month/2018-{i}/">next</a>'
    '<ul><li><a href="/about">about</a></ul><a href="/events/{i}#top">{t}</a></body></html>'
)
LIST_PAGE = (
    '<html><body><a href="/calendar/other"></a><ul class="events-teasers-list semantic">'
    '<li><a href="tue-2018-12-04-1100/p{i}/"></a></li><li><a href="/calendar?page={i}"></a></li></ul></body></html>'
)
# -------------------------------------------------------------------------------------------------


# --- fixed values: what is put into pages to try the lexical rules -------------------------------
MESSY_TEXT = [
    (r"(?is)</?body[^>]*>", ""),
    (r"(?i)(<body[^>]*>)", r"""$1<script>var x="</body>";</script>"""),
    (r"(?i)<head>", '<head><!-- <body class="x"> -->'),
    (r"\z", "<p>late &amp more</p>"),
    (r"(?i)(<body[^>]*>)", '$1<a title="x > y">quoted &apos;&#00000065;</a>'),
]
MESSY_TITLE = [
    (r"(?i)<head>", """<head><script>var b="<body>";</script>"""),
    (r"(?i)<head>", "<head><!-- <title>no</title> -->"),
    (r"(?i)<head>", "<head><meta content='<title>no</title>'>"),
    (r"(?i)</title>", " &apos;&#00000065;&amp x&notit;</title>"),
    (r"(?i)</title>", " <b></title >"),
]
# -------------------------------------------------------------------------------------------------


def messy_pages(spark: SparkSession, sf_dir: str, shapes: list[tuple[str, str]]) -> DataFrame:
    """Every page with the change that its number picks."""
    html = F.col("html")
    made = html
    for k, (pattern, put) in enumerate(shapes):
        made = F.when(F.col("page_id") % len(shapes) == k, F.regexp_replace(html, pattern, put)).otherwise(made)
    return table(spark, sf_dir, "pages").select("page_id", made.alias("html"))


def month_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month page of every listed page's title and number."""
    return _calendar_pages(spark, sf_dir, [("https://talks.%s/calendar/month/2018-%d", MONTH_PAGE)])


def calendar_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event page, a talk page and a calendar page made of every page's title, host and number."""
    layouts = [
        ("https://events.%s/calendar/tue-2018-12-04-1100/p%d", EVENT_PAGE),
        ("https://talks.%s/events/%d", TALK_PAGE),
        ("https://events.%s/calendar/?page=%d", LIST_PAGE),
    ]
    return _calendar_pages(spark, sf_dir, layouts)


def _calendar_pages(spark: SparkSession, sf_dir: str, layouts: list[tuple[str, str]]) -> DataFrame:
    pages = with_url_parts(table(spark, sf_dir, "pages"))
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    facts = pages.select("page_id", "host", title.alias("title"))

    def made(url: str, layout: str) -> Column:
        html = F.lit(layout)
        for mark, value in (("{t}", F.col("title")), ("{h}", F.col("host")), ("{i}", F.col("page_id").cast("string"))):
            html = F.replace(html, F.lit(mark), value)
        return F.struct(F.format_string(url, "host", "page_id").alias("url"), html.alias("html"))

    each = F.array(*(made(url, layout) for url, layout in layouts))
    return facts.select(F.explode(each).alias("p")).select(
        "p.url", F.col("p.url").alias("final_url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"), "p.html"
    )
