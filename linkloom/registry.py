"""What to crawl: sources with their hosts, seed links, URL policy and page handlers.

Policies and handlers are configuration, a few rows per source, and are compiled into literal
expressions. Hosts and seeds are tables and stay DataFrames whatever their size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import WWW_MODES, add_www, canonical_url, has_www, twin_host, with_url_parts
from linkloom.operators.extract import Extractor, page_extractor
from linkloom.operators.lookup import Lookup

# --- fixed values: table layouts -------------------------------------------------------------
SOURCES_SCHEMA = (
    "source STRING, www_mode STRING, drop_query BOOLEAN, html_only BOOLEAN, require_host BOOLEAN, "
    "title_policy STRING"
)
HOSTS_SCHEMA = "source STRING, host STRING"
SEEDS_SCHEMA = "source STRING, url STRING"
HANDLERS_SCHEMA = "source STRING, handler STRING, pattern STRING, query_keys ARRAY<STRING>, priority INT"
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Handler:
    """A page handler: it takes a URL when any (path pattern, query names) pair fits.

    A pattern is anchored at the start of the path only. ``None`` as query names puts no
    constraint on the query; otherwise the URL's parameter names must be exactly that set.
    """

    name: str
    patterns: tuple[tuple[str, tuple[str, ...] | None], ...]
    extractor: Extractor = field(default_factory=page_extractor)


@dataclass(frozen=True)
class Source:
    """One source and its URL policy.

    ``www_mode``: ``keep``, ``add``, ``strip``, or ``listed`` (whichever form is declared).
    ``require_host``: the canonical host must be a declared one. ``canonicalizes=False`` leaves
    URLs as they are. ``canonical_form`` is an own Column function of (scheme, host, path, query)
    and replaces the policy.
    """

    name: str
    www_mode: str = "keep"
    drop_query: bool = False
    html_only: bool = False
    require_host: bool = False
    canonicalizes: bool = True
    canonical_form: Callable[[Column, Column, Column, Column], Column] | None = None
    handlers: tuple[Handler, ...] = ()

    def __post_init__(self):
        if self.www_mode not in WWW_MODES:
            raise ValueError(f"source {self.name!r}: unknown www_mode {self.www_mode!r}")

    def in_name_order(self) -> "Source":
        """Handlers tried by name, A to Z, instead of in the order given."""
        return replace(self, handlers=tuple(sorted(self.handlers, key=lambda h: h.name)))


class Registry:
    """Sources (in load order) plus their declared hosts and seed links."""

    def __init__(self, sources: Sequence[Source], hosts: DataFrame, seeds: DataFrame | None = None):
        names = [s.name for s in sources]
        if len(set(names)) != len(names):
            raise ValueError(f"a source is declared twice: {sorted(n for n in set(names) if names.count(n) > 1)}")
        self.sources = tuple(sources)
        self.hosts = hosts.select("source", "host")
        self.seeds = seeds

    @property
    def source_names(self) -> list[str]:
        return [s.name for s in self.sources]

    def source(self, name: str) -> Source:
        for s in self.sources:
            if s.name == name:
                return s
        raise ValueError(f"{name!r} is not a valid source")

    def validate(self) -> "Registry":
        """Every host and seed must belong to a declared source."""
        for label, table in (("host", self.hosts), ("seed", self.seeds)):
            if table is None:
                continue
            stray = table.where(~F.col("source").isin(self.source_names) | F.col("source").isNull()).limit(1).collect()
            if stray:
                raise ValueError(f"a {label} belongs to the undeclared source {stray[0]['source']!r}")
        return self

    def register_handler(
        self,
        source: str,
        name: str,
        pattern: str,
        query_keys: Sequence[str] | None = None,
        extractor: Extractor | None = None,
    ) -> "Registry":
        """Adds a handler, or one more pattern to a handler that is already there."""
        keys = None if query_keys is None else tuple(query_keys)
        owner = self.source(source)
        handlers = list(owner.handlers)
        known = [h.name for h in handlers]
        if name in known:
            at = known.index(name)
            old = handlers[at]
            handlers[at] = replace(
                old, patterns=old.patterns + ((pattern, keys),), extractor=extractor or old.extractor
            )
        else:
            handlers.append(Handler(name, ((pattern, keys),), extractor or page_extractor()))
        return self._with_source(replace(owner, handlers=tuple(handlers)))

    def register_canonicalizer(
        self, source: str, form: Callable[[Column, Column, Column, Column], Column]
    ) -> "Registry":
        """Gives a source its own ``(scheme, host, path, query) -> URL`` Column function."""
        return self._with_source(replace(self.source(source), canonical_form=form, canonicalizes=True))

    def _with_source(self, changed: Source) -> "Registry":
        return Registry([changed if s.name == changed.name else s for s in self.sources], self.hosts, self.seeds)

    def with_sources(self, sources: Sequence[Source]) -> "Registry":
        return Registry(sources, self.hosts, self.seeds)

    # --- host tables -------------------------------------------------------------------------

    def per_source(self, value: Callable[[Source], object], source: Column) -> Column:
        """A per-source constant as a literal ladder over a source column."""
        out = F.lit(None)
        for s in self.sources:
            v = value(s)
            if v is not None:
                out = F.when(source == s.name, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
        return out

    def host_variants(self) -> DataFrame:
        """Declared hosts plus the www/bare twin of each: ``source, host, listed_www, listed_bare``."""
        each = self.hosts.select(
            "source",
            F.explode(
                F.array(
                    F.struct(F.col("host").alias("host"), F.lit(True).alias("listed")),
                    F.struct(twin_host(F.col("host")).alias("host"), F.lit(False).alias("listed")),
                )
            ).alias("v"),
        ).select("source", "v.host", "v.listed")
        return (
            each.groupBy("source", "host")
            .agg(F.max("listed").alias("listed"))
            .select(
                "source",
                "host",
                (F.col("listed") & has_www(F.col("host"))).alias("listed_www"),
                (F.col("listed") & ~has_www(F.col("host"))).alias("listed_bare"),
            )
        )

    def host_table(self) -> DataFrame:
        """One row per routable host, everything a URL needs to know about its host.

        ``sources`` in load order (their handlers are tried in that order), ``canon_source`` the
        last source that canonicalizes, ``canon_host`` the host after its policy (NULL when the
        policy turns the host down), ``canon_sources`` the sources of that canonical host.
        """
        order = self.per_source(lambda s: self.source_names.index(s.name), F.col("source"))
        by_host = (
            self.host_variants()
            .groupBy("host")
            .agg(
                # A host belongs to at most as many entries as there are sources.
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            order.cast("int").alias("idx"),
                            "source",
                            (F.col("listed_www") | F.col("listed_bare")).alias("listed"),
                        )
                    )
                ).alias("entries")
            )
        )
        acting = [s.name for s in self.sources if s.canonicalizes]
        by_host = by_host.withColumn(
            "owner",
            F.try_element_at(F.filter("entries", lambda e: e["source"].isin(acting)), F.lit(-1)),
        ).select(
            "host",
            F.col("entries.source").alias("sources"),
            F.col("entries").alias("entries"),
            F.col("owner.source").alias("canon_source"),
            F.coalesce(F.col("owner.listed"), F.lit(False)).alias("listed"),
        )
        www, source = F.col("host"), F.col("canon_source")
        mode = self.per_source(lambda s: s.www_mode, source)
        wanted = (
            F.when(mode == "add", add_www(www))
            .when(mode == "strip", F.when(has_www(www), twin_host(www)).otherwise(www))
            .when((mode == "listed") & ~F.col("listed"), twin_host(www))
            .otherwise(www)
        )
        by_host = by_host.withColumn("wanted", wanted)
        target = by_host.select(
            F.col("host").alias("wanted"), F.col("sources").alias("canon_sources"), F.col("entries").alias("canon_entries")
        )
        joined = by_host.join(target, "wanted", "left")
        must = F.coalesce(self.per_source(lambda s: s.require_host or s.www_mode == "listed", source), F.lit(False))
        declared = F.coalesce(
            F.exists("canon_entries", lambda e: (e["source"] == F.col("canon_source")) & e["listed"]), F.lit(False)
        )
        return joined.select(
            "host",
            "sources",
            "canon_source",
            F.when(~must | declared, F.col("wanted")).alias("canon_host"),
            "canon_sources",
        )

    @cached_property
    def lookup(self) -> Lookup:
        """The host table, written once to the shared folder and measured."""
        return Lookup.measured(self.host_table(), key="host", size_of=("sources", "canon_sources"), label="hosts")

    @cached_property
    def max_sources(self) -> int:
        """Most sources any one host belongs to."""
        return max(1, self.lookup.max_list)

    # --- seeds ---------------------------------------------------------------------------------

    def host_seeds(self) -> DataFrame:
        """``https://<declared host>`` for every declared host."""
        return self.hosts.select("source", F.concat(F.lit("https://"), F.col("host")).alias("url")).distinct()

    def seed_links(self, source: str | None = None) -> DataFrame:
        """Seeds per declared host and extra seed URLs, without repeats. Unknown source: error."""
        seeds = self.host_seeds()
        if self.seeds is not None:
            seeds = seeds.unionByName(self.seeds.select("source", "url"))
        if source is not None:
            self.source(source)
            seeds = seeds.where(F.col("source") == source)
        return seeds.distinct()


def calendar_seeds(
    hosts: DataFrame, first_year: int, last_year: int, template: str = "https://%s/calendar/month/%d-%d"
) -> DataFrame:
    """A seed per host and month of the years given; the month is not padded."""
    months = F.sequence(
        F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
        F.make_date(F.lit(last_year), F.lit(12), F.lit(1)),
        F.expr("interval 1 month"),
    )
    return hosts.select("source", "host", F.explode(months).alias("month")).select(
        "source", F.format_string(template, F.col("host"), F.year("month"), F.month("month")).alias("url")
    )


def load_registry(spark: SparkSession, folder: str, extractors: dict[str, Extractor] | None = None) -> Registry:
    """Reads ``sources``, ``hosts``, ``seeds``, ``handlers`` JSON-lines tables from a folder.

    Handlers take the extractor named after them (``source.handler`` or ``handler``), else the
    page extractor under their source's title policy.
    """
    extractors = extractors or {}
    # Sources and handlers are hand-written configuration, so reading them here is bounded.
    declared = spark.read.schema(SOURCES_SCHEMA).json(f"{folder}/sources").collect()
    rows = spark.read.schema(HANDLERS_SCHEMA).json(f"{folder}/handlers").orderBy("source", "priority").collect()
    names = {r["source"] for r in declared}
    for r in rows:
        if r["source"] not in names:
            raise ValueError(f"handler {r['handler']!r} belongs to the undeclared source {r['source']!r}")
    sources = []
    for d in declared:
        default = page_extractor(d["title_policy"] or "fail")
        handlers: dict[str, Handler] = {}
        for r in rows:
            if r["source"] != d["source"]:
                continue
            entry = (r["pattern"], None if r["query_keys"] is None else tuple(r["query_keys"]))
            name = r["handler"]
            if name in handlers:
                handlers[name] = replace(handlers[name], patterns=handlers[name].patterns + (entry,))
            else:
                own = extractors.get(f"{d['source']}.{name}", extractors.get(name, default))
                handlers[name] = Handler(name, (entry,), own)
        sources.append(
            Source(
                d["source"],
                www_mode=d["www_mode"] or "keep",
                drop_query=bool(d["drop_query"]),
                html_only=bool(d["html_only"]),
                require_host=bool(d["require_host"]),
                handlers=tuple(handlers.values()),
            )
        )
    return Registry(
        sources,
        spark.read.schema(HOSTS_SCHEMA).json(f"{folder}/hosts"),
        spark.read.schema(SEEDS_SCHEMA).json(f"{folder}/seeds"),
    ).validate()
