"""Captured responses -> outcome, record and outlinks of each page.

Everything up to the link table is one map-only stage over the responses: split the URL, look its
host up, route, extract. The only shuffle is the final distinct over narrow (page, link) pairs;
the page text never moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from linkloom.functions.html import unquote
from linkloom.functions.urls import URL_PARTS, resolved_url, with_resolved_parts, with_url_parts
from linkloom.operators.extract import with_extraction
from linkloom.operators.lookup import Lookup
from linkloom.operators.metrics import result_totals
from linkloom.operators.routing import all_handlers, canonical_links, route, with_host, with_route
from linkloom.registry import Registry
from linkloom.session import fresh_path

# --- fixed values ------------------------------------------------------------------------
RESPONSES_SCHEMA = "url STRING, final_url STRING, status INT, location STRING, html STRING"
RESPONSE_COLUMNS = ["url", "final_url", "status", "location", "html"]
RESULT_COLUMNS = ["url", "final_url", "handler", "success", "error", "redirected", "has_record", "record", "hrefs"]
REDIRECT_STATUSES = [301, 302, 303, 307, 308]
NOT_CAPTURED, HTTP_ERROR, NO_HANDLER = "not_captured", "http_error", "no_handler"
COMPLETED, FAILED = "completed", "failed"
# -----------------------------------------------------------------------------------------


def latest_captures(responses: DataFrame, order: list[str], capture_id: str) -> DataFrame:
    """One response per URL: the last by ``order``, then by ``capture_id`` (unique).

    Winners are picked on narrow columns with a map-side combine, so a URL captured a billion
    times costs one row per task; pages then meet them on the unique id.
    """
    rank = F.struct(*(F.col(c) for c in order), F.col(capture_id).alias("_capture"))
    winners = (
        responses.groupBy("url").agg(F.max(rank).alias("last")).select(F.col("last._capture").alias(capture_id))
    )
    return responses.join(winners, capture_id, "left_semi")


def fetch(links: DataFrame, responses: DataFrame, link: str = "link") -> DataFrame:
    """Left join of links to their captured responses: exactly one row per link.

    ``responses`` holds one row per URL (see :func:`latest_captures`, and :func:`fetched_results`, which
    sees to it itself); a link without a response has a NULL status and becomes ``not_captured``.
    """
    found = responses.withColumnRenamed("url", "_captured_url")
    joined = links.withColumnRenamed(link, "url").join(found, F.col("url") == F.col("_captured_url"), "left")
    return joined.withColumn("final_url", F.coalesce("final_url", "url")).drop("_captured_url")


def page_results(responses: DataFrame, registry: Registry, resolve_location: bool = False) -> DataFrame:
    """One row per response: ``url, final_url, handler, success, error, redirected, has_record,
    record, hrefs``.

    ``hrefs`` are raw href values, for a followed redirect its location, and NULL for failed
    pages. Further columns of ``responses`` pass through.
    """
    extra = [c for c in responses.columns if c not in ("url", "final_url", "status", "location", "html")]
    df = with_host(with_url_parts(responses, "final_url", "p_"), registry, "p_host", "ph_")
    df = df.withColumn("handler", route(registry, "ph_sources", "p_path", "p_query"))
    if resolve_location:
        df = with_resolved_parts(df, "location", "p_", "l_")
        df = df.withColumn("_target", resolved_url(F.col("location"), F.col("final_url"), "l_"))
    else:
        df = with_url_parts(df, "location", "l_").withColumn("_target", F.col("location"))
    df = canonical_links(df, registry, F.col("_target"), "l_", "_redirect", "_redirect_handler", "left")

    status = F.col("status")
    http_error = status.between(400, 599)
    redirected = F.coalesce(status.isin(REDIRECT_STATUSES) & F.col("_redirect_handler").isNotNull(), F.lit(False))
    df = df.withColumn("redirected", redirected)
    live = status.isNotNull() & ~http_error & ~F.col("redirected") & F.col("handler").isNotNull()
    df = with_extraction(df, all_handlers(registry), "handler", "html", "final_url", live)
    error = (
        F.when(status.isNull(), F.lit(NOT_CAPTURED))
        .when(http_error, F.lit(HTTP_ERROR))
        .when(F.col("redirected"), F.lit(None).cast("string"))
        .when(F.col("handler").isNull(), F.lit(NO_HANDLER))
        .otherwise(F.col("failure"))
    )
    ok = F.col("error").isNull()
    return df.withColumn("error", error).select(
        "url",
        "final_url",
        *extra,
        "handler",
        ok.alias("success"),
        "error",
        "redirected",
        (ok & F.col("has_record")).alias("has_record"),
        F.when(ok, F.col("record")).alias("record"),
        F.when(F.col("redirected"), F.array("_target")).when(ok, F.col("hrefs")).alias("hrefs"),
    )


def fetched_results(
    links: DataFrame,
    responses: DataFrame,
    registry: Registry,
    link: str = "link",
    capture_id: str | None = None,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """:func:`page_results` of :func:`fetch`: exactly one row per row of ``links``; a link without a response
    fails as ``not_captured``. Columns of ``links`` pass through.

    With a unique ``capture_id`` the last capture of each URL counts (as in :func:`latest_captures`); without
    one the responses must hold one row per URL. Which capture answers which link is settled on narrow
    columns and measured; the answer is then looked up from the pages, before they are extracted, so only asked
    captures are read and, as long as the answer can be broadcast, neither HTML nor records are shuffled.
    """
    key = capture_id or "url"
    asked = links.withColumnRenamed(link, "url")
    extra = [c for c in asked.columns if c != "url"]
    rank = F.struct(*(F.col(c) for c in order), F.col(key).alias("_key"))
    found = responses.select("url", rank.alias("_rank")).join(asked.select("url"), "url", "left_semi")
    last = found.groupBy("url").agg(F.max("_rank").alias("_last")).select("url", F.col("_last._key").alias("_key"))
    told = asked.join(last, "url", "left").select("_key", F.struct("url", *extra).alias("_link"))
    answers = Lookup.measured(told.where(F.col("_key").isNotNull()), "_key", label="answers")
    captured = responses.select(F.col(key).alias("_key"), *RESPONSE_COLUMNS)
    met = answers.join(captured, "_key", {"_link": "_link"}, "inner").drop("_key")
    columns = [F.col(f"_link.{c}").alias(c) for c in (*extra, "url")]
    answered = page_results(met, registry).drop("url").select(*columns, *(c for c in RESULT_COLUMNS if c != "url"))
    # A link that no capture answers is routed all the same.
    types = {f.name: f.dataType for f in answered.schema}
    absent = told.where(F.col("_key").isNull()).select("_link.*").withColumn("final_url", F.col("url"))
    routed = with_route(absent, registry, "final_url").withColumns(
        {
            "error": F.lit(NOT_CAPTURED),
            **{c: F.lit(False) for c in ("success", "redirected", "has_record")},
            **{c: F.lit(None).cast(types[c]) for c in ("record", "hrefs")},
        }
    )
    return answered.unionByName(routed.select(*answered.columns))


def store_results(results: DataFrame, path: str | None = None, observed: Observation | None = None) -> DataFrame:
    """Writes results and reads them back, so that several outputs cost one pass over the pages.

    ``observed`` gets the :func:`metrics.result_totals` of the rows as they are written.
    """
    path = path or fresh_path(results.sparkSession, "results")
    rows = results if observed is None else results.observe(observed, *result_totals())
    rows.write.mode("overwrite").parquet(path)
    return results.sparkSession.read.schema(results.schema).parquet(path)


def resolve_hrefs(results: DataFrame, keep: tuple[str, ...] = ("url",), outer: bool = False) -> DataFrame:
    """One row per page and distinct raw href, with the target's parts (``t_`` columns).

    The page URL is split once per page, before its hrefs are laid out. ``outer`` keeps pages
    without hrefs.
    """
    base = with_url_parts(results, "final_url", "b_")
    lay_out = F.explode_outer if outer else F.explode
    each = base.select(
        *keep,
        "final_url",
        "redirected",
        *(f"b_{p}" for p in URL_PARTS),
        lay_out(F.array_distinct("hrefs")).alias("token"),
    )
    href = F.when(F.col("redirected"), F.col("token")).otherwise(unquote(F.col("token")))
    return with_resolved_parts(each.withColumn("href", href), "href", "b_", "t_").drop("token", "redirected")


def _with_links(hrefs: DataFrame, registry: Registry) -> DataFrame:
    target = resolved_url(F.col("href"), F.col("final_url"))
    return canonical_links(hrefs, registry, target, "t_")


def routed_links(results: DataFrame, registry: Registry, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Routable canonical links of each page, repeats included: ``keep + (link, handler)``.

    Links without a handler go out through the generator and not through a filter: a filter would
    be pushed below the projections and have every URL expression evaluated a second time.
    """
    routed = _with_links(resolve_hrefs(results, keep), registry)
    kept = F.when(F.col("handler").isNotNull(), F.array(F.struct("link", "handler")))
    return routed.select(*keep, F.explode(kept).alias("_l")).select(*keep, "_l.link", "_l.handler")


def link_graph(results: DataFrame, registry: Registry) -> DataFrame:
    """``url, success, error, links``: outcome and distinct routable links per page, in one pass.

    Results hold one row per URL. The links of a page leave the map side as one set, so the
    shuffle moves a row per page; a group is never larger than the page it came from.
    """
    keep = ("url", "success", "error")
    routed = _with_links(resolve_hrefs(results, keep, outer=True), registry)
    link = F.when(F.col("handler").isNotNull(), F.col("link"))
    return routed.groupBy("url").agg(
        F.max("success").alias("success"), F.max("error").alias("error"), F.collect_set(link).alias("links")
    )


def result_links(results: DataFrame, registry: Registry, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Distinct routable canonical links of each page: ``keep + (link)``."""
    return routed_links(results, registry, keep).select(*keep, "link").distinct()


def link_sources(results: DataFrame, registry: Registry) -> DataFrame:
    """Distinct (link, handler) pairs over all pages."""
    return routed_links(results, registry, ()).distinct()


def batch_output(results: DataFrame, registry: Registry) -> DataFrame:
    """One row per input: ``url, success, data, links`` (distinct, sorted) and ``error``, plus any
    columns that passed through the results. Needs results from :func:`store_results`."""
    extra = [c for c in results.columns if c not in RESULT_COLUMNS]
    links = link_graph(results, registry).select(F.col("url").alias("_u"), F.array_sort("links").alias("links"))
    joined = results.join(links, F.col("url") == F.col("_u"), "left")
    return joined.select(*extra, "url", "success", F.col("record").alias("data"), "links", "error")


@dataclass(frozen=True)
class Outputs:
    """The three outputs of a batch of results."""

    statuses: DataFrame
    records: DataFrame
    links: DataFrame


def status_of(success: Column) -> Column:
    return F.when(success, F.lit(COMPLETED)).otherwise(F.lit(FAILED))


def split_results(results: DataFrame, registry: Registry) -> Outputs:
    """Failed pages give a status only; successful ones a status, a record (unless empty) and links.

    Use :func:`store_results` first when all three outputs are wanted.
    """
    return Outputs(
        statuses=results.select("url", status_of(F.col("success")).alias("status")),
        records=results.where("has_record").select("url", "final_url", "handler", "record"),
        links=result_links(results, registry),
    )
