"""URL functions against the standard library and hand-written rows."""

from urllib.parse import parse_qsl, urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import urls as U

PLAIN = [
    "http://h.org/a/b?x=1#f",
    "HTTP://User:pw@H.Org:8080/A;p?q",
    "//h.org/p",
    "/rooted",
    "rel/a/b",
    "?q=1",
    "#frag",
    "mailto:a@b.org",
    "http://h.org/with space/x y",
    "http://h.org",
    "http://h.org?only=query",
    "http://h.org#only",
    "/a;p/b;q",
    "/a;p1;p2",
    "",
    "https://h.org/a;x;y?k=v;w=z#t?u",
]


def rows(spark, values, name="url"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {name} STRING")


def test_parts_match_standard_split(spark):
    got = U.with_url_parts(rows(spark, PLAIN)).orderBy("i").collect()
    for row in got:
        want = urlparse(row["url"])
        have = tuple(row[c] for c in U.URL_PARTS)
        assert have == (want.scheme, want.netloc, want.path, want.params, want.query, want.fragment), row["url"]


def test_bare_port_is_no_scheme_and_null_stays_null(spark):
    got = U.with_url_parts(rows(spark, ["localhost:8080", None])).orderBy("i").collect()
    assert (got[0]["scheme"], got[0]["path"]) == ("", "localhost:8080")
    assert all(got[1][c] is None for c in U.URL_PARTS)


BASES = ["http://h.org/d/e/page.html?q=1#x", "https://h.org", "https://h.org/", "http://h.org/d/e/;p?k"]
HREFS = [
    "", "x", "./x", "../x", "../../x", "../../../x", "/x", "/x/../y", "/./x", "x/.", "x/..", "//o.org/z", "//o.org",
    "?n=2", "#f", "http://o.org/a/./b", "mailto:a@b", "g;x=1/../y", "g?y/./x", "a/b/../../../c", ";p", "..", ".",
]


def resolve(spark, pairs):
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i INT, base STRING, href STRING")
    parts = U.with_resolved_parts(U.with_url_parts(df, "base", "b_"), "href", "b_")
    out = parts.select("i", U.resolved_url(F.col("href"), F.col("base")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def test_links_resolve_as_in_the_standard_library(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    for (base, href), got in zip(pairs, resolve(spark, pairs)):
        want = base if href == "" else href if urlparse(href).scheme else urljoin(base, href)
        assert got == want, (base, href)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab./?#", max_size=9), min_size=150, max_size=200, unique=True))
def test_random_links_resolve_as_in_the_standard_library(spark, hrefs):
    base = "http://h.org/d/e/page"
    for href, got in zip(hrefs, resolve(spark, [(base, h) for h in hrefs])):
        # An empty query or fragment leaves no delimiter, and "//" is a host only if one follows.
        if href.startswith("//") or "//" in href.split("?")[0].split("#")[0] or href.endswith(("?", "#")) or "?#" in href:
            continue
        assert got == (base if href == "" else urljoin(base, href)), href


CANONICAL = [
    # url, keep, drop query, add, strip
    ("http://h.org/a/", "http://h.org/a", "http://h.org/a", "http://www.h.org/a", "http://h.org/a"),
    ("https://www.h.org/a//?q=1#f", "https://www.h.org/a?q=1", "https://www.h.org/a", "https://www.h.org/a?q=1", "https://h.org/a?q=1"),
    ("http://h.org/", "http://h.org", "http://h.org", "http://www.h.org", "http://h.org"),
    ("http://H.org:80/a;p?", "http://H.org:80/a", "http://H.org:80/a", "http://www.H.org:80/a", "http://H.org:80/a"),
    ("//h.org/a", "//h.org/a", "//h.org/a", "//www.h.org/a", "//h.org/a"),
]


def canonical(spark, urls, mode, drop=False):
    parts = U.with_url_parts(rows(spark, urls))
    cols = [F.col(c) for c in ("scheme", "host", "path", "query")]
    cols[1] = U.canonical_host(cols[1], mode)
    return [r["c"] for r in parts.select("i", U.canonical_url(*cols, drop).alias("c")).orderBy("i").collect()]


def test_canonical_forms(spark):
    urls = [c[0] for c in CANONICAL]
    for k, (mode, drop) in enumerate([("keep", False), ("keep", True), ("add", False), ("strip", False)], 1):
        assert canonical(spark, urls, mode, drop) == [c[k] for c in CANONICAL]


@pytest.mark.parametrize("mode", ["keep", "add", "strip"])
def test_canonical_form_is_stable(spark, mode):
    once = canonical(spark, [u for u in PLAIN if "//" in u], mode)
    assert canonical(spark, once, mode) == once


def test_html_paths(spark):
    paths = {"/a": True, "/a.html": True, "/v1.2/foo": False, "/a.HTML": False, "/a.php": False, "": True, "/a.b.html": True}
    df = rows(spark, list(paths), "p")
    got = {r["p"]: r["ok"] for r in df.select("p", U.is_html_path(F.col("p")).alias("ok")).collect()}
    assert got == paths


def test_query_names(spark):
    queries = ["page=2&ref=x", "ref=x&page=1&page=3", "a=&b=1", "a", "", "x=1;y=2", "a=b=c", "n%20m=1", "a+b=1", "=v"]
    df = rows(spark, queries, "q").withColumn("k", F.expr(U.query_keys_sql("q"))).orderBy("i")
    for row in df.collect():
        want = sorted({k for part in row["q"].split(";") for k, _ in parse_qsl(part)})
        assert row["k"] == want, row["q"]


def test_null_link_resolves_to_null(spark):
    assert resolve(spark, [("http://h.org/a", None)]) == [None]
