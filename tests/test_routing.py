"""Registry and routing: golden routes, order, query sets, shared hosts, lookups of any size."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from linkloom import presets
from linkloom.operators import frontier as fr
from linkloom.plans import seeding
from linkloom.functions.urls import canonical_url
from linkloom.operators import extract as X
from linkloom.operators.lookup import Lookup
from linkloom.session import fresh_path
from linkloom.operators.routing import canonicalize, with_route
from linkloom.registry import Handler, Registry, Source, calendar_seeds, load_registry

HOSTS = "source STRING, host STRING"


def handler(name, pattern, query=None):
    return Handler(name, ((pattern, query),))


def calendars(order=("list", "event")):
    events = {"list": handler("parse_list", X.EVENT_LIST_PATTERN), "event": handler("parse_event", X.EVENT_PATTERN)}
    return [
        Source("talks", drop_query=True, handlers=(handler("parse_talk", X.TALK_PATTERN), handler("parse_month", X.TALK_LIST_PATTERN))),
        Source("events", handlers=tuple(events[o] for o in order)),
    ]


def registry(spark, sources, hosts):
    return Registry(sources, spark.createDataFrame(hosts, HOSTS))


def routes(spark, reg, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i INT, url STRING")
    return [r["handler"] for r in with_route(df, reg).orderBy("i").collect()]


def canon(spark, reg, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i INT, url STRING")
    return [(r["canonical"], r["why"]) for r in canonicalize(df, reg, reason="why").orderBy("i").collect()]


CAL_HOSTS = [("talks", "talks.example.edu"), ("talks", "www.talks.example.edu"), ("events", "events.example.edu")]


def test_golden_calendar_routes(spark):
    urls = [
        "https://www.talks.example.edu/calendar/month/2018-09",
        "https://www.talks.example.edu/events/3984",
        "https://www.talks.example.edu/events/3984/more",
        "https://events.example.edu/calendar?page=1",
        "https://events.example.edu/calendar/tue-2018-12-04-1100/monthly-workshop",
        "https://events.example.edu/other",
        "https://elsewhere.example.edu/calendar",
    ]
    want = ["talks.parse_month", "talks.parse_talk", None, "events.parse_list", "events.parse_list", None, None]
    assert routes(spark, registry(spark, calendars(), CAL_HOSTS), urls) == want
    # The order given decides; tried first, the event pattern is no longer shadowed.
    want[4] = "events.parse_event"
    first = registry(spark, calendars(("event", "list")), CAL_HOSTS)
    assert routes(spark, first, urls) == want
    by_name = first.with_sources([s.in_name_order() for s in first.sources])
    assert routes(spark, by_name, [urls[4]]) == ["events.parse_event"]


def test_query_set_must_be_equal_and_falls_through(spark):
    source = Source("s", handlers=(handler("pair", "/", ("b", "a")), handler("none", "/x", ()), handler("any", "/")))
    urls = [f"http://h{q}" for q in ("/x?a=1&b=2", "/x?b=1&a=2&a=3", "/x?a=1", "/x", "/x?a=&b=1", "/x?a=1&b=2&c=3", "/y?c=")]
    want = ["s.pair", "s.pair", "s.any", "s.none", "s.any", "s.any", "s.any"]
    assert routes(spark, registry(spark, [source], [("s", "h")]), urls) == want


def test_several_patterns_of_one_handler(spark):
    reg = registry(spark, [Source("s")], [("s", "h")]).register_handler("s", "p", "/a").register_handler("s", "p", "/b$", ["k"])
    assert routes(spark, reg, ["http://h/abc", "http://h/b?k=1", "http://h/b", "http://h/c"]) == ["s.p", "s.p", None, None]


def test_host_shared_by_two_sources(spark):
    one = Source("one", www_mode="keep", handlers=(handler("a", "/a"),))
    two = Source("two", www_mode="add", handlers=(handler("b", "/"),))
    reg = registry(spark, [one, two], [("one", "h.org"), ("two", "h.org")])
    # Handlers in load order; the last canonicalizer wins.
    assert routes(spark, reg, ["http://h.org/a", "http://h.org/z"]) == ["one.a", "two.b"]
    assert canon(spark, reg, ["http://h.org/a/"]) == [("http://www.h.org/a", None)]
    plain = reg.with_sources([one, replace(two, canonicalizes=False)])
    assert canon(spark, plain, ["http://h.org/a/"]) == [("http://h.org/a", None)]


def test_policies_and_reasons(spark):
    hosts = [("strip", "a.org"), ("strip", "myHost.org"), ("listed", "www.b.org"), ("listed", "c.org"), ("html", "www.d.org")]
    reg = registry(
        spark,
        [Source("strip", "strip", require_host=True), Source("listed", "listed"), Source("html", "keep", html_only=True)],
        hosts,
    )
    cases = {
        "http://www.a.org/x/": ("http://a.org/x", None),
        "http://myHost.org/": ("http://myHost.org", None),
        "http://myhost.org/": ("http://myhost.org/", None),
        "http://b.org/x": ("http://www.b.org/x", None),
        "http://www.b.org/x": ("http://www.b.org/x", None),
        "http://www.c.org/x": ("http://c.org/x", None),
        "http://d.org/v1.2/foo": (None, "not_html"),
        "http://d.org/a.html/": ("http://d.org/a.html", None),
        "http://d.org/a.HTML": (None, "not_html"),
        "http://unknown.org/a.php/#f": ("http://unknown.org/a.php/#f", None),
    }
    assert canon(spark, reg, list(cases)) == list(cases.values())


def test_required_host_missing(spark):
    reg = registry(spark, [Source("s", "strip", require_host=True)], [("s", "www.only.org")])
    assert canon(spark, reg, ["http://www.only.org/x"]) == [(None, "host_not_listed")]


def test_own_canonicalizer(spark):
    reg = registry(spark, [Source("s", handlers=(handler("a", "/up"),))], [("s", "h")])
    own = reg.register_canonicalizer("s", lambda scheme, host, path, query: canonical_url(scheme, host, F.lower(path), query))
    assert canon(spark, own, ["http://h/UP/?Q=1"]) == [("http://h/up?Q=1", None)]


def test_lookup_past_its_bounds_is_equal(spark):
    """Bounds that hold the whole table, its rows that occur, or neither."""
    table = spark.range(400).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("v"))
    small = Lookup.measured(table, "k")
    occur, large = replace(small, max_rows=250), replace(small, max_rows=10)
    assert small.fits_broadcast and not occur.fits_broadcast
    # A third of all rows on one key, another third on keys the table lacks, some without a key.
    keys = F.when(F.col("id") % 3 == 0, "k7").when(F.col("id") % 3 == 1, "nokey").when(F.col("id") % 50 != 2, F.concat(F.lit("k"), F.col("id") % 200))
    path = fresh_path(spark, "lookup-rows")
    spark.range(0, 6000, 1, 16).select("id", keys.alias("key"), F.lit("<p>").alias("html")).write.parquet(path)
    rows = spark.read.parquet(path)
    for how in ("left", "inner"):
        a, b, c = (sorted(map(tuple, lk.join(rows, "key", {"v": "value"}, how).collect()), key=repr) for lk in (small, occur, large))
        assert a == b == c and len(a) == (6000 if how == "left" else 3960)

    def shuffles(lookup):
        plan = lookup.join(rows, "key", {"v": "value"})._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan

    assert not shuffles(occur)[0]
    moved, plan = shuffles(large)
    assert len(moved) <= 2 and "NOT" in plan.upper()  # rows of frequent keys, and those without a key, stay


def test_seeds(spark):
    hosts = spark.createDataFrame([("s", "a.org"), ("s", "a.org"), ("t", "b.org")], HOSTS)
    extra = spark.createDataFrame([("s", "https://a.org/list/"), ("s", "https://a.org")], "source STRING, url STRING")
    reg = Registry([Source("s"), Source("t")], hosts, extra)
    assert sorted(r["url"] for r in reg.seed_links("s").collect()) == ["https://a.org", "https://a.org/list/"]
    assert reg.seed_links().count() == 3
    with pytest.raises(ValueError):
        reg.seed_links("unknown")
    months = [r["url"] for r in calendar_seeds(hosts.where("source = 't'"), 2015, 2018).collect()]
    assert len(months) == 48 and "https://b.org/calendar/month/2018-1" in months


def test_bad_registries(spark):
    with pytest.raises(ValueError):
        registry(spark, [Source("s"), Source("s")], [("s", "h")])
    with pytest.raises(ValueError):
        registry(spark, [Source("s")], [("t", "h")]).validate()
    with pytest.raises(ValueError):
        Source("s", www_mode="maybe")


def test_registry_from_files(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.json(f"{tmp_path}/{name}")

    write("sources", [("s", "add", False, True, False, "default")], "source STRING, www_mode STRING, drop_query BOOLEAN, html_only BOOLEAN, require_host BOOLEAN, title_policy STRING")
    write("hosts", [("s", "a.org")], HOSTS)
    write("seeds", [("s", "https://a.org/x")], "source STRING, url STRING")
    write("handlers", [("s", "two", "/", None, 2), ("s", "one", "/x", ["k"], 1)], "source STRING, handler STRING, pattern STRING, query_keys ARRAY<STRING>, priority INT")
    reg = load_registry(spark, str(tmp_path))
    assert routes(spark, reg, ["http://a.org/x?k=1", "http://a.org/x"]) == ["s.one", "s.two"]
    assert canon(spark, reg, ["http://a.org/x/"]) == [("http://www.a.org/x", None)]


def test_presets(spark):
    sources = [presets.www_site("w"), presets.bare_site("b"), presets.listed_site("l"), presets.plain_site("p"), presets.talk_calendar("t")]
    hosts = [("w", "www.w.edu"), ("b", "b.edu"), ("l", "l.edu"), ("l", "www.m.edu"), ("p", "p.edu"), ("t", "t.edu")]
    reg = registry(spark, sources, hosts)
    cases = {
        "http://w.edu/x/": "http://www.w.edu/x", "https://www.b.edu/a.html#f": "https://b.edu/a.html", "http://www.l.edu": "http://l.edu",
        "http://m.edu/?q=1": "http://www.m.edu?q=1", "http://www.p.edu/a.jpg": None, "http://t.edu/events/12/?x=1": "http://t.edu/events/12",
    }
    assert [c for c, _ in canon(spark, reg, list(cases))] == list(cases.values())
    want = ["w.parse_everything", "b.parse_everything", "l.parse_everything", "l.parse_everything", "p.parse_everything", None]
    assert routes(spark, reg, list(cases)) == want
    assert routes(spark, reg, ["http://t.edu/events/12"]) == ["t.parse_events"]
    event = "http://e.edu/calendar/fri-2018-12-07-0900/chat"
    assert routes(spark, registry(spark, [presets.event_calendar("e")], [("e", "e.edu")]), [event]) == ["e.parse_events"]
    assert routes(spark, registry(spark, [presets.event_calendar("e", by_name=True)], [("e", "e.edu")]), [event]) == ["e.parse_calendar"]


def test_starting_a_source(spark):
    extra = spark.createDataFrame([("b", "https://b.edu/list/"), ("b", "https://b.edu/list"), ("b", "https://b.edu/x.pdf")], "source STRING, url STRING")
    reg = Registry([presets.bare_site("b")], spark.createDataFrame([("b", "b.edu")], HOSTS), extra)
    links = lambda t: sorted(r["link"] for r in t.collect())
    assert links(seeding.start_source(fr.empty_frontier(spark), reg, "b")) == ["https://b.edu", "https://b.edu/list"]
    raw = seeding.start_source(fr.empty_frontier(spark), reg, "b", canonicalize_seeds=False)
    assert links(raw) == ["https://b.edu", "https://b.edu/list", "https://b.edu/list/", "https://b.edu/x.pdf"]
    urls = spark.createDataFrame([("https://b.edu/list/",), ("https://any.where/",)], "url STRING")
    assert links(seeding.enqueue_urls(raw, urls)) == sorted(links(raw) + ["https://any.where/"])
    with pytest.raises(ValueError):
        seeding.start_source(raw, reg, "nope")
