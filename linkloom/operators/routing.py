"""URL routing: canonical form and handler of each URL after one lookup of its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical_path, canonical_url, is_html_path, query_keys_sql, quoted, with_url_parts
from linkloom.registry import Registry


def pattern_fits(path: Column, pattern: str) -> Column:
    """The pattern holds at the start of the path; its end is free."""
    return path.rlike(f"^(?:{pattern})")


def _fits_sql(path: str, query: str, pattern: str, names: tuple[str, ...] | None) -> str:
    """One (pattern, query names) pair; the names must be exactly the URL's parameter names."""
    at_start = f"{path} RLIKE {quoted(f'^(?:{pattern})')}"
    if names is None:
        return at_start
    wanted = ", ".join(quoted(n) for n in sorted(set(names)))
    return f"({at_start} AND {query_keys_sql(query)} = cast(array({wanted}) AS array<string>))"


def route(registry: Registry, sources: str, path: str, query: str) -> Column:
    """``source.handler`` of the first handler that fits, trying a host's sources in load order.

    Patterns are literals of one CASE ladder, so each is compiled once.
    """
    ladders = []
    for i in range(registry.max_sources):
        by_source = []
        for s in registry.sources:
            cases = [
                f"WHEN {' OR '.join(_fits_sql(path, query, p, names) for p, names in h.patterns)} "
                f"THEN {quoted(f'{s.name}.{h.name}')}"
                for h in s.handlers
            ]
            if cases:
                by_source.append(f"WHEN {quoted(s.name)} THEN CASE {' '.join(cases)} END")
        if by_source:
            ladders.append(f"CASE get({sources}, {i}) {' '.join(by_source)} END")
    return F.expr(f"coalesce({', '.join(ladders)})" if ladders else "cast(null AS string)")


def all_handlers(registry: Registry) -> list[tuple[str, object]]:
    return [(f"{s.name}.{h.name}", h.extractor) for s in registry.sources for h in s.handlers]


def with_host(df: DataFrame, registry: Registry, host: str, prefix: str = "", how: str = "left") -> DataFrame:
    """Adds ``<prefix>sources, canon_source, canon_host, canon_sources`` of a host column."""
    names = ("sources", "canon_source", "canon_host", "canon_sources")
    return registry.lookup.join(df, host, {n: f"{prefix}{n}" for n in names}, how)


def canonical_form(registry: Registry, url: Column, prefix: str = "", known: bool = False) -> Column:
    """Canonical URL from parts and host columns; NULL if rejected.

    A host without a canonicalizer keeps the URL as it is. ``known``: URLs of unregistered hosts
    are of no interest and may come out NULL.
    """
    source, host = F.col(f"{prefix}canon_source"), F.col(f"{prefix}canon_host")
    scheme, path, query = (F.col(f"{prefix}{c}") for c in ("scheme", "path", "query"))
    drop = F.coalesce(registry.per_source(lambda s: s.drop_query or None, source), F.lit(False))
    html_only = F.coalesce(registry.per_source(lambda s: s.html_only or None, source), F.lit(False))
    trimmed = canonical_path(path)
    by_policy = F.when(~html_only | is_html_path(trimmed), canonical_url(scheme, host, path, F.when(drop, F.lit("")).otherwise(query)))
    cases = [] if known and all(s.canonicalizes for s in registry.sources) else [(source.isNull(), url)]
    for s in registry.sources:
        if s.canonical_form is not None:
            cases.append((source == s.name, s.canonical_form(scheme, F.col(f"{prefix}host"), path, query)))
    out = by_policy
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def reject_reason(registry: Registry, prefix: str = "") -> Column:
    """Why a URL has no canonical form: ``host_not_listed`` or ``not_html``; else NULL."""
    source = F.col(f"{prefix}canon_source")
    html_only = F.coalesce(registry.per_source(lambda s: s.html_only or None, source), F.lit(False))
    return F.when(source.isNotNull() & F.col(f"{prefix}canon_host").isNull(), F.lit("host_not_listed")).when(
        html_only & ~is_html_path(canonical_path(F.col(f"{prefix}path"))), F.lit("not_html")
    )


def canonicalize(df: DataFrame, registry: Registry, url: str = "url", out: str = "canonical", reason: str | None = None) -> DataFrame:
    """Adds the canonical URL (and the reason it was rejected). Unknown hosts keep their URL."""
    work = with_host(with_url_parts(df, url, "_c_"), registry, "_c_host", "_c_")
    cols = {out: canonical_form(registry, F.col(url), "_c_")}
    if reason is not None:
        cols[reason] = reject_reason(registry, "_c_")
    return work.withColumns(cols).drop(*(c for c in work.columns if c.startswith("_c_")))


def with_route(df: DataFrame, registry: Registry, url: str = "url", out: str = "handler", prefix: str | None = None) -> DataFrame:
    """Adds the handler of a URL as it stands (no canonical form), NULL if there is none.

    With ``prefix`` the URL parts stay in the result under that prefix.
    """
    p = prefix if prefix is not None else "_r_"
    parts = with_url_parts(df, url, p)
    work = with_host(parts, registry, f"{p}host", "_rh_")
    routed = work.withColumn(out, route(registry, "_rh_sources", f"{p}path", f"{p}query"))
    drop = [c for c in routed.columns if c.startswith("_rh_")]
    if prefix is None:
        drop += [c for c in routed.columns if c.startswith(p) and c not in df.columns]
    return routed.drop(*drop)


def canonical_links(df: DataFrame, registry: Registry, url: Column, prefix: str, link: str = "link", handler: str = "handler", how: str = "left", reason: str | None = None) -> DataFrame:
    """Canonical link and its handler from parts under ``prefix`` (scheme, host, path, query).

    The route is that of the canonical URL: its host's sources come with the same lookup, its
    path is the trimmed one. Links to unknown hosts have no handler.
    """
    work = with_host(df, registry, f"{prefix}host", prefix, how)
    work = work.withColumn(link, canonical_form(registry, url, prefix, known=True))
    if reason is not None:
        work = work.withColumn(reason, reject_reason(registry, prefix))
    if any(s.canonical_form is not None for s in registry.sources):
        # A source's own form may change path and host in any way: route the URL it made.
        return with_route(work, registry, link, handler)
    owner = F.col(f"{prefix}canon_source")
    kept = owner.isNull()
    drop = F.coalesce(registry.per_source(lambda s: s.drop_query or None, owner), F.lit(False))
    work = work.withColumns(
        {
            "_n_path": F.when(kept, F.col(f"{prefix}path")).otherwise(canonical_path(F.col(f"{prefix}path"))),
            "_n_query": F.when(drop, F.lit("")).otherwise(F.col(f"{prefix}query")),
            "_n_sources": F.when(kept, F.col(f"{prefix}sources")).otherwise(F.col(f"{prefix}canon_sources")),
        }
    )
    routed = F.when(F.col(link).isNotNull(), route(registry, "_n_sources", "_n_path", "_n_query"))
    return work.withColumn(handler, routed).drop("_n_path", "_n_query", "_n_sources")
