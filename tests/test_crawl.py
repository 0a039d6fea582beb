"""Frontier expansion against a breadth-first walk."""

import random

from linkloom.plans.crawl import crawl

GRAPH = "url STRING, success BOOLEAN, error STRING, links ARRAY<STRING>"


def random_graph(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < 0.15:
            continue  # never captured
        ok = rng.random() > 0.15
        # "hub" takes a third of all links.
        out = {("hub" if rng.random() < 0.34 else f"n{rng.randrange(n)}") for _ in range(rng.randrange(5))}
        rows.append((f"n{i}", ok, None if ok else "http_error", sorted(out)))
    return rows + [("hub", True, None, [f"n{i}" for i in range(0, n, 9)])]


def walk(rows, seeds, rounds=None):
    pages = {u: (ok, err, links) for u, ok, err, links in rows}
    depth, wave, log, k = {s: 0 for s in seeds}, sorted(set(seeds)), {}, 0
    while wave and (rounds is None or k < rounds):
        k += 1
        found = set()
        for link in wave:
            ok, err, links = pages.get(link, (False, "not_captured", []))
            log[link] = ("completed" if ok else "failed", None if ok else err, depth[link])
            found |= set(links) if ok else set()
        wave = sorted(found - set(depth))
        depth.update({l: k for l in wave})
    return log, depth


def logged(done):
    rows = done.log.collect()
    got = {r["link"]: (r["status"], r["error"], r["found_round"]) for r in rows}
    assert len(got) == len(rows), "a link was taken twice"
    return got


def test_closure_is_the_breadth_first_walk(spark):
    rows = random_graph(120, 1)
    seeds = spark.createDataFrame([("n0",), ("n1",), ("n0",), ("nowhere",)], "link STRING")
    done = crawl(seeds, spark.createDataFrame(rows, GRAPH))
    log, depth = walk(rows, ["n0", "n1", "nowhere"])
    assert logged(done) == log
    assert {r["link"]: r["round"] for r in done.frontier.collect()} == depth
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("linkloom_")]


def test_stops_after_max_rounds_with_the_rest_waiting(spark):
    rows = random_graph(120, 2)
    done = crawl(spark.createDataFrame([("n0",), ("hub",)], "link STRING"), spark.createDataFrame(rows, GRAPH), max_rounds=2)
    log, depth = walk(rows, ["n0", "hub"], rounds=2)
    assert logged(done) == log and done.rounds == 2
    got = {r["link"]: r["status"] for r in done.frontier.collect()}
    assert got == {l: log[l][0] if l in log else "waiting" for l in depth}


def test_bounded_claims_reach_the_same_links(spark):
    rows = random_graph(25, 3)
    seeds, graph = spark.createDataFrame([("n0",), ("hub",)], "link STRING"), spark.createDataFrame(rows, GRAPH)
    bounded, whole = crawl(seeds, graph, claim=7), crawl(seeds, graph)
    outcome = lambda done: {l: s[:2] for l, s in logged(done).items()}
    assert outcome(bounded) == outcome(whole)
    assert bounded.log.groupBy("taken_round").count().agg({"count": "max"}).first()[0] <= 7


def test_a_round_neither_sorts_nor_shuffles_the_graph(spark, monkeypatch):
    from linkloom.plans import crawl as module

    plans, append = {}, module._Store.append

    def watched(self, table, df, key, by=None):
        plans.setdefault(table, []).append(df._jdf.queryExecution().executedPlan().toString())
        append(self, table, df, key, by)

    monkeypatch.setattr(module._Store, "append", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        crawl(spark.createDataFrame([("n1",)], "link STRING"), spark.createDataFrame(random_graph(60, 3), GRAPH))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    settled, seen = plans["settled"][0], plans["seen"][1]
    for text in (settled, seen):
        assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
    assert "Exchange" not in settled and "PartitionFilters: [isnotnull(found_round" in settled
    assert seen.count("Exchange") == 1
