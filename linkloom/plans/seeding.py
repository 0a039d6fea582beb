"""Ways into the frontier: a source's seeds, and URLs handed in by a caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import frontier as fr
from linkloom.operators.routing import canonicalize
from linkloom.registry import Registry


def start_links(registry: Registry, source: str | None = None, canonicalize_seeds: bool = True) -> DataFrame:
    """``link``: seeds of a source (default: all), in canonical form unless told otherwise.

    Canonical seeds keep ``/list/`` and ``/list`` from being crawled twice; a seed that its own
    policy rejects is left out.
    """
    seeds = registry.seed_links(source)
    if not canonicalize_seeds:
        return seeds.select(F.col("url").alias("link")).distinct()
    found = canonicalize(seeds, registry, "url", "link")
    return found.where(F.col("link").isNotNull()).select("link").distinct()


def start_source(frontier: DataFrame, registry: Registry, source: str, canonicalize_seeds: bool = True) -> DataFrame:
    """The link table with a source's seeds queued. Unknown source: error."""
    return fr.insert(frontier, start_links(registry, source, canonicalize_seeds))


def enqueue_urls(frontier: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """The link table with a caller's URLs queued, as they are given."""
    return fr.insert(frontier, urls.select(F.col(url).alias("link")))
