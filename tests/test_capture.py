"""Outcomes of captured pages and their three outputs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.operators import extract as X
from linkloom.operators.extract import Extractor, page_extractor
from linkloom.plans import capture as C
from linkloom.registry import Handler, Registry, Source
from linkloom.session import fresh_path
from tests.test_html import EVENT

PAGE = '<html><head><title>T</title></head><body>b<a href="/x/">1</a><a href="/x#f">2</a><a href="http://o.org/">3</a><a href="/y.pdf">4</a></body></html>'
NO_TITLE = PAGE.replace("<title>T</title>", "")
ROWS = [
    ("http://h.org/ok", 200, None, PAGE),
    ("http://h.org/notitle", 200, None, NO_TITLE),
    ("http://h.org/missing", 404, None, PAGE),
    ("http://h.org/broken", 503, None, PAGE),
    ("http://h.org/moved", 301, "http://www.h.org/to/", None),
    ("http://h.org/relative", 302, "/to", PAGE),
    ("http://h.org/nowhere", 302, None, PAGE),
    ("http://h.org/away", 302, "http://o.org/", PAGE),
    ("http://o.org/other", 200, None, PAGE),
    ("http://d.org/notitle", 200, None, NO_TITLE),
    ("http://d.org/nothing", None, None, None),
]


@pytest.fixture(scope="module")
def registry(spark):
    sources = [
        Source("fails", "strip", html_only=True, handlers=(Handler("page", (("/", None),), page_extractor("fail")),)),
        Source("defaults", handlers=(Handler("page", (("/", None),), page_extractor("default")),)),
    ]
    return Registry(sources, spark.createDataFrame([("fails", "h.org"), ("defaults", "d.org")], "source STRING, host STRING"))


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame([(u, u, *r) for u, *r in ROWS], C.RESPONSES_SCHEMA)


def test_outcomes(registry, responses):
    got = {r["url"]: r for r in C.page_results(responses, registry).collect()}
    assert len(got) == len(ROWS)
    errors = {u.split("//")[1]: r["error"] for u, r in got.items()}
    assert errors == {
        "h.org/ok": None, "h.org/notitle": "no_title", "h.org/missing": "http_error", "h.org/broken": "http_error",
        "h.org/moved": None, "h.org/relative": None, "h.org/nowhere": None, "h.org/away": None, "o.org/other": "no_handler",
        "d.org/notitle": None, "d.org/nothing": "not_captured",
    }
    assert all((r["error"] is None) == r["success"] for r in got.values())
    assert json.loads(got["http://h.org/ok"]["record"]) == {"url": "http://h.org/ok", "title": "T", "text": "b1234"}
    assert json.loads(got["http://d.org/notitle"]["record"])["title"] == "Title Not Found"
    assert got["http://h.org/moved"]["record"] is None and got["http://h.org/moved"]["redirected"]


def test_three_outputs(registry, responses):
    out = C.split_results(C.page_results(responses, registry), registry)
    assert {r["url"]: r["status"] for r in out.statuses.collect()}["http://h.org/missing"] == "failed"
    assert {r["url"] for r in out.records.collect()} == {
        "http://h.org/ok", "http://h.org/relative", "http://h.org/nowhere", "http://h.org/away", "http://d.org/notitle"
    }
    links = sorted((r["url"], r["link"]) for r in out.links.collect())
    assert links == sorted(
        [("http://h.org/moved", "http://h.org/to")]
        + [(f"http://h.org/{p}", "http://h.org/x") for p in ("ok", "relative", "nowhere", "away")]
        + [("http://d.org/notitle", f"http://d.org/{p}") for p in ("x", "y.pdf")]
    )


def test_relative_location_can_be_resolved(registry, responses):
    results = C.page_results(responses, registry, resolve_location=True)
    links = {r["url"]: r["link"] for r in C.result_links(results.where("redirected"), registry).collect()}
    assert links == {"http://h.org/moved": "http://h.org/to", "http://h.org/relative": "http://h.org/to"}


def test_link_graph_equals_links(registry, responses):
    results = C.page_results(responses, registry)
    graph = {r["url"]: (r["success"], sorted(r["links"])) for r in C.link_graph(results, registry).collect()}
    links = {}
    for r in C.result_links(results, registry).collect():
        links.setdefault(r["url"], []).append(r["link"])
    assert graph == {r["url"]: (r["success"], sorted(links.get(r["url"], []))) for r in results.collect()}


def test_fetch_gives_one_row_per_link(spark, responses):
    links = spark.createDataFrame([("http://h.org/ok",), ("http://never.org/",)], "link STRING")
    got = {r["url"]: (r["final_url"], r["status"]) for r in C.fetch(links, responses).collect()}
    assert got == {"http://h.org/ok": ("http://h.org/ok", 200), "http://never.org/": ("http://never.org/", None)}


def test_latest_capture_of_a_hot_url(spark):
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "http://hot/").otherwise(F.concat(F.lit("http://u/"), F.col("id") % 50)).alias("url"),
        (F.col("id") % 7).alias("at"), F.col("id").alias("capture"), F.lit("x").alias("html"),
    )
    got = {r["url"]: r["capture"] for r in C.latest_captures(hot, ["at"], "capture").collect()}
    want = {}
    for r in hot.collect():
        want[r["url"]] = max(want.get(r["url"], (-1, -1)), (r["at"], r["capture"]))
    assert got == {u: c for u, (_, c) in want.items()}


def test_pandas_extractor_sees_only_its_rows(spark):
    def fn(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        assert html.notna().all() and (html == "py").all()
        return pd.DataFrame({"record": ['{"n":%d}' % len(h) for h in html], "hrefs": [['"/z"']] * len(html), "error": [None] * len(html)})

    handlers = (Handler("py", (("/py", None),), Extractor(pandas=fn)), Handler("page", (("/", None),), page_extractor("default")))
    reg = Registry([Source("s", handlers=handlers)], spark.createDataFrame([("s", "h")], "source STRING, host STRING"))
    rows = [("http://h/py", "http://h/py", 200, None, "py"), ("http://h/a", "http://h/a", 200, None, PAGE)]
    results = C.page_results(spark.createDataFrame(rows, C.RESPONSES_SCHEMA), reg)
    got = {r["url"]: r["record"] for r in results.collect()}
    assert got["http://h/py"] == '{"n":2}' and json.loads(got["http://h/a"])["title"] == "T"
    assert ("http://h/py", "http://h/z") in [tuple(r) for r in C.result_links(results, reg).collect()]
    assert C.split_results(results, reg).records.count() == 2


def test_event_pages_end_to_end(spark):
    handlers = (
        Handler("event", ((X.EVENT_PATTERN, None),), X.event_extractor()),
        Handler("list", ((X.EVENT_LIST_PATTERN, None),), X.links_extractor(*X.EVENT_LIST_REGION)),
    )
    reg = Registry([Source("e", handlers=handlers)], spark.createDataFrame([("e", "e.edu")], "source STRING, host STRING"))
    listing = '<ul class="events-teasers-list semantic"><li><a href="tue-2018-12-04-1100/talk/"></li></ul><a href="/calendar">'
    rows = [(u, u, 200, None, h) for u, h in (("https://e.edu/calendar/", listing), ("https://e.edu/calendar/tue-2018-12-04-1100/talk", EVENT))]
    results = C.page_results(spark.createDataFrame(rows, C.RESPONSES_SCHEMA), reg)
    out = C.split_results(results, reg)
    assert [tuple(r) for r in out.links.collect()] == [("https://e.edu/calendar/", "https://e.edu/calendar/tue-2018-12-04-1100/talk")]
    records = out.records.collect()
    assert len(records) == 1 and json.loads(records[0]["record"])["day"] == "Tuesday, December 4"
    assert list(json.loads(records[0]["record"])) == ["url", "title", "event_type", "start_time", "end_time", "day", "location", "speaker", "body"]


def test_join_behind_the_extraction_gives_the_same_results(spark, registry, responses):
    links = spark.createDataFrame([(u,) for u, *_ in ROWS] + [("http://h.org/never",), ("http://o.org/never",)], "link STRING")
    before = C.page_results(C.fetch(links, responses), registry).select(*C.RESULT_COLUMNS)
    behind = C.fetched_results(links, responses, registry)
    assert sorted(map(repr, before.collect())) == sorted(map(repr, behind.collect()))


def test_repeated_captures_and_links(spark, registry, responses):
    """Every link row gets one row, from the last capture; no HTML and no record is shuffled."""
    rows = [(i, t, *r) for t in (1, 2) for i, r in enumerate(responses.collect(), 100 * t)]
    captures = spark.createDataFrame(rows, "id INT, taken INT, " + C.RESPONSES_SCHEMA)
    captures = captures.withColumn("status", F.when(F.col("taken") == 1, 404).otherwise(F.col("status"))).repartition(4)
    path = fresh_path(spark, "captures")
    captures.write.parquet(path)
    links = spark.createDataFrame([(n, u) for n in (1, 2) for u, *_ in ROWS] + [(3, "http://h.org/never")], "n INT, link STRING")
    got = C.fetched_results(links, spark.read.parquet(path), registry, capture_id="id", order=("taken",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == 2 * len(ROWS) + 1 and {r["n"] for r in rows} == {1, 2, 3}
    once = {r["url"]: (r["error"], r["record"], r["handler"]) for r in C.page_results(responses, registry).collect()}
    assert all((r["error"], r["record"], r["handler"]) == once[r["url"]] for r in rows if r["n"] < 3)
    shuffled = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert not any("html" in line or "record" in line for line in shuffled)


def test_batch_output_has_one_row_per_input(spark, registry, responses):
    links = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(ROWS)] + [(99, "http://h.org/never")], "idx INT, link STRING")
    out = C.batch_output(C.store_results(C.fetched_results(links, responses, registry)), registry).orderBy("idx").collect()
    assert [r["idx"] for r in out] == [*range(len(ROWS)), 99]
    assert out[0]["links"] == ["http://h.org/x"] and out[-1]["error"] == "not_captured" and out[-1]["links"] == []
