"""Page extractors: raw HTML in, a record (JSON) and raw outlinks out.

An extractor is a set of Column builders, so extraction runs inside the scan stage. A user's own
pandas function can stand in its place; only rows routed to it carry their HTML to Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions.html import FieldRule
from linkloom.functions.records import EVENT_FIELDS, page_record, record_json, talk_record

NO_HREFS = "cast(array() as array<string>)"
PANDAS_SCHEMA = "record STRING, hrefs ARRAY<STRING>, error STRING"


@dataclass(frozen=True)
class Extractor:
    """``record(html, url)`` -> struct, ``hrefs(html)`` -> raw href values as written,
    ``failure(html, url)`` -> error class or NULL. A part left out yields nothing.

    ``prepare`` makes, step by step, a column of the page that ``record`` and ``failure`` are given in place of the HTML.
    ``pandas`` replaces all of them: ``(html: Series, url: Series) -> DataFrame`` with columns
    ``record`` (JSON), ``hrefs`` (list), ``error``.
    """

    record: Callable[[Column, Column], Column] | None = None
    hrefs: Callable[[Column], Column] | None = None
    failure: Callable[[Column, Column], Column] | None = None
    prepare: tuple[Callable[[Column], Column], ...] = ()
    pandas: Callable[[pd.Series, pd.Series], pd.DataFrame] | None = None


_PAGE: dict[tuple[str, bool], Extractor] = {}


def page_extractor(title_policy: str = "fail", strip_script: bool = False) -> Extractor:
    """``{url, title, text}`` and every anchor. A page without a title fails, or takes the
    default title under ``title_policy='default'``."""
    if title_policy not in ("fail", "default"):
        raise ValueError(f"unknown title_policy {title_policy!r}")
    key = (title_policy, strip_script)
    if key not in _PAGE:

        def record(html: Column, url: Column) -> Column:
            title = F.coalesce(H.title_text(html), F.lit(H.TITLE_DEFAULT))
            return page_record(url, title, H.body_text(html, strip_script))

        def failure(html: Column, url: Column) -> Column:
            return F.when(H.title_text(html).isNull(), F.lit("no_title"))

        _PAGE[key] = Extractor(record, H.anchor_tokens, failure if title_policy == "fail" else None)
    return _PAGE[key]


def links_extractor(tag: str | None = None, attr: str | None = None, value: str | None = None) -> Extractor:
    """No record; all anchors with a non-empty href, or those inside the matching elements."""
    if tag is None:
        return Extractor(hrefs=lambda html: F.filter(H.anchor_tokens(html), lambda t: H.unquote(t) != ""))
    return Extractor(hrefs=lambda html: H.scoped_anchor_tokens(html, tag, attr, value))


def rules_extractor(rules: list[FieldRule], hrefs: Callable[[Column], Column] | None = None) -> Extractor:
    """``url`` plus one field per rule, in rule order."""

    def record(page: Column, url: Column) -> Column:
        got = H.page_fields(page, rules)
        return H.let(got, lambda f: F.struct(url.alias("url"), *(f[r.name].alias(r.name) for r in rules)))

    return Extractor(record, hrefs, _failure(rules), tuple(H.page_steps(rules)))


def _failure(rules: list[FieldRule]) -> Callable[[Column, Column], Column] | None:
    if not any(r.take == "must" or r.strict for r in rules):
        return None
    return lambda page, url: H.page_failure(page, rules)


# --- fixed values: field rules and paths of the two calendar sites ---------------------------
_EVENT_DATE = FieldRule("date", "div", "class", "event__date", "contains")
_EVENT_PLACE = FieldRule("place", "ul", "class", "event__location-information semantic", "contains")
EVENT_RULES = [
    FieldRule("title", "h1", "id", "page-title", text="own"),
    FieldRule("event_type", "div", "class", "event__label", "contains", text="own"),
    FieldRule("start_time", "span", "class", "date-display-start", "contains", text="own", inside=_EVENT_DATE),
    FieldRule("end_time", "span", "class", "date-display-end", "contains", text="own", inside=_EVENT_DATE),
    FieldRule("day", "time", "datetime", text="own", inside=_EVENT_DATE, child=True, dash_clean=True),
    FieldRule("location", "li", take="join", text="own", inside=_EVENT_PLACE, child=True),
    FieldRule("speaker", "li", "class", "event__speaker-name", "contains", text="below"),
    FieldRule("body", "div", "class", "event__content", "contains", take="join", text="below"),
]
_TALK_DATE = FieldRule("date", "div", "class", "field-name-field-date", "token")
_TALK_ITEM = FieldRule("item", "div", "class", "field-item", "token", inside=_TALK_DATE)
_TALK_SPEAKER = FieldRule("speaker", "section", "class", "field-name-field-speaker-name", "token")
_TALK_FROM = FieldRule("from", "section", "class", "field-name-field-speaker-institution", "token")
TALK_RULES = [
    FieldRule("title", "h1", "id", "page-title", take="must", text="only"),
    FieldRule("start_time", "span", "class", "date-display-start", "token", take="attr", attr="content", inside=_TALK_ITEM, strict=True),
    FieldRule("end_time", "span", "class", "date-display-end", "token", take="attr", attr="content", inside=_TALK_ITEM, strict=True),
    FieldRule("location", "div", "class", "field-name-field-location", "token", take="must", text="only", trim=False),
    FieldRule("speaker_name", "div", "class", "field-items", "token", take="must", text="only", trim=False, inside=_TALK_SPEAKER),
    FieldRule("speaker_from", "div", "class", "field-items", "token", take="must", text="only", trim=False, inside=_TALK_FROM),
    FieldRule("body", "section", "class", "field-name-body", "token", take="must", trim=False),
]
EVENT_PATTERN = r"^/calendar/(mon|tue|wed|thu|fri|sat|sun)-[0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{4}/.*"
EVENT_LIST_PATTERN = r"^/calendar"
EVENT_LIST_REGION = ("ul", "class", "events-teasers-list semantic")
TALK_PATTERN = r"^/events/[0-9]+$"
TALK_LIST_PATTERN = r"^/calendar/month/[0-9]{4}-[0-9]+$"
# ---------------------------------------------------------------------------------------------


def event_extractor() -> Extractor:
    """The nine-field event record; no links."""

    def record(page: Column, url: Column) -> Column:
        return H.let(
            H.page_fields(page, EVENT_RULES),
            lambda f: F.struct(*((url if n == "url" else f[n]).alias(n) for n in EVENT_FIELDS)),
        )

    return Extractor(record, prepare=tuple(H.page_steps(EVENT_RULES)))


def talk_extractor() -> Extractor:
    """The talk record with its nested speaker; a missing required element, or a date element without its
    value, fails the row."""

    def record(page: Column, url: Column) -> Column:
        return H.let(H.page_fields(page, TALK_RULES), lambda f: talk_record(url, f))

    return Extractor(record, failure=_failure(TALK_RULES), prepare=tuple(H.page_steps(TALK_RULES)))


def _over_own_rows(fn: Callable) -> Callable:
    """Runs a batch function on the rows that carry HTML; all others stay NULL."""

    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(
            {"record": None, "hrefs": None, "error": None}, index=range(len(html)), dtype=object
        )
        mine = html.notna().to_numpy().nonzero()[0]
        if len(mine):
            got = fn(html.iloc[mine].reset_index(drop=True), url.iloc[mine].reset_index(drop=True))
            for name in out.columns:
                out.loc[mine, name] = pd.Series(list(got[name]), index=mine, dtype=object)
        return out

    return run


def with_extraction(
    df: DataFrame, handlers: list[tuple[str, Extractor]], handler: str, html: str, url: str, live: Column
) -> DataFrame:
    """Adds ``record``, ``hrefs``, ``failure`` under the extractor of each row's handler, and
    ``has_record``, which says whether there is a record without building it.

    Handlers that share an extractor share one branch, so its expressions are evaluated once.
    ``live`` marks the rows to extract at all.
    """
    record, hrefs, failure = F.lit(None).cast("string"), F.expr(NO_HREFS), F.lit(None).cast("string")
    page, at, has_record = F.col(html), F.col(url), F.lit(False)
    shared: dict[int, tuple[Extractor, list[str]]] = {}
    for name, extractor in handlers:
        shared.setdefault(id(extractor), (extractor, []))[1].append(name)
    made = []
    for n, (extractor, names) in enumerate(shared.values()):
        mine = live & F.col(handler).isin(names)
        if extractor.pandas is not None:
            made.append(f"_made_{n}")
            udf = F.pandas_udf(_over_own_rows(extractor.pandas), PANDAS_SCHEMA)
            df = df.withColumn(made[-1], udf(F.when(mine, page), F.when(mine, at)))
            out = F.col(made[-1])
            record = F.when(mine, out["record"]).otherwise(record)
            has_record = has_record | (mine & out["record"].isNotNull())
            hrefs = F.when(mine, F.coalesce(out["hrefs"], F.expr(NO_HREFS))).otherwise(hrefs)
            failure = F.when(mine, out["error"]).otherwise(failure)
            continue
        read = F.when(mine, page) if extractor.prepare else page
        for step in extractor.prepare:
            df = df.withColumn(f"_made_{n}", step(read))
            read = F.col(f"_made_{n}")
        if extractor.prepare:
            made.append(f"_made_{n}")
        if extractor.record is not None:
            record = F.when(mine, record_json(extractor.record(read, at))).otherwise(record)
            has_record = has_record | mine
        if extractor.hrefs is not None:
            hrefs = F.when(mine, extractor.hrefs(page)).otherwise(hrefs)
        if extractor.failure is not None:
            failure = F.when(mine, extractor.failure(read, at)).otherwise(failure)
    return df.withColumns(
        {"record": record, "hrefs": hrefs, "failure": failure, "has_record": has_record}
    ).drop(*made)
