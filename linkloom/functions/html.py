"""Page fields out of raw HTML with native expressions (see ``linkloom.functions.markup``)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import markup as M
from linkloom.functions.urls import quoted

TITLE_DEFAULT = "Title Not Found"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _over(column: Column, name: str, sql: str) -> Column:
    """SQL over one column, named in it, and the table of references."""
    return F.get(F.call_function("transform", F.array(column), F.expr(f"{name} -> {M.bind(M.REFERENCES, 'refs', sql)}")), F.lit(0))


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, decoded in one pass (``&amp;lt;`` -> ``&lt;``) by the rules of HTML:
    the longest known name counts, with or without its ``;``."""
    return _over(text, "html", M.decoded("html"))


def title_text(html: Column) -> Column:
    """First head title, references decoded; NULL when there is none or it is empty."""
    found = M.decoded(f"regexp_extract(html, {quoted(M.HEAD_TITLE)}, 2)")
    return _over(html, "html", M.bind(found, "tx", "CASE WHEN tx <> '' THEN tx END"))


def body_text(html: Column, strip_script: bool = False) -> Column:
    """All text under body, comments excluded; ``''`` without any.

    A body that is not written starts with the first content that can stand in no head; content after
    the body's end tag belongs to it, but for blanks. Script and style text counts as text unless
    ``strip_script`` is set.
    """
    after_end = r"(?i)\A</(?:body|html)[\s/>]"
    blank = f"f RLIKE {quoted(r'\A\s+\z')} AND j > 0 AND get(ts, j - 1) RLIKE {quoted(after_end)}"
    text = f"array_join(transform(ts, (f, j) -> CASE WHEN NOT ({blank}) THEN {M.text_of('f', strip_script)} END), '')"
    body = f"substr(html, length(regexp_extract(html, {quoted(M.HEAD_PART)}, 0)) + 1)"
    return _over(html, "html", f"CASE WHEN html IS NOT NULL THEN {M.bind(M.tokens(body), 'ts', text)} END")


def anchor_tokens(html: Column) -> Column:
    """Raw href values (quotes included) of every anchor, in document order."""
    return F.filter(F.regexp_extract_all(html, F.lit(M.ANCHOR_HREF), F.lit(1)), lambda t: t != "")


def unquote(token: Column) -> Column:
    """An attribute value as written -> its text."""
    return F.when(token.contains("&"), _over(token, "html", M.unquoted("html"))).otherwise(
        F.when(token.startswith('"') | token.startswith("'"), F.substr(token, F.lit(2), F.length(token) - 2)).otherwise(token)
    )


def _fit(tag: str, attr: str | None, value: str | None, match: str) -> Callable[[str], str]:
    return lambda token: M.fits(token, tag, attr, value, match)


def regions(html: Column, tag: str, attr: str | None = None, value: str | None = None, match: str = "equals") -> Column:
    """Insides of all matching elements, in document order; an element ends at its own end tag."""
    found = M.elements(_fit(tag, attr, value, match))
    return _over(html, "html", M.over_page("html", f"transform({found}, el -> {M.inside('el')})"))


def scoped_anchor_tokens(html: Column, tag: str, attr: str | None = None, value: str | None = None) -> Column:
    """Raw href values of anchors inside the matching elements only, each once."""
    outer = M.outermost(M.elements(_fit(tag, attr, value, "equals")))
    hrefs = f"filter(transform(slice(ts, el + 2, get(ns, el).e - el - 1), f -> CASE WHEN f RLIKE '(?i)^<a[ \\\\s/]' THEN {M.attribute('f', 'href')} END), f -> f <> '')"
    return _over(html, "html", M.over_page("html", f"flatten(transform({outer}, el -> {hrefs}))"))


@dataclass(frozen=True)
class FieldRule:
    """One record field.

    ``take``: ``first`` first text, trimmed, ``''`` if none; ``join`` all texts joined by a
    newline, then trimmed; ``attr`` value of attribute ``attr`` of the first match, NULL without one; ``must`` first match as
    it stands, where a missing element fails the row. ``strict`` fails the row of an ``attr`` rule whose
    element lacks the attribute.
    ``tag``/``attr_name``/``attr_value``/``match`` pick the element: the attribute equals the
    value, contains it, or has it among its blank-separated tokens. ``inside`` narrows the search
    to another rule's elements, to their direct children if ``child`` is set.
    ``text``: ``all`` text of the element, its ``own`` text nodes, those of its descendants
    (``below``), or its ``only`` text (NULL if it has several children; a trimmed ``must`` then fails).
    """

    name: str
    tag: str
    attr_name: str | None = None
    attr_value: str | None = None
    match: str = "equals"
    take: str = "first"
    attr: str | None = None
    text: str = "all"
    inside: "FieldRule | None" = None
    child: bool = False
    trim: bool = True
    dash_clean: bool = False
    strict: bool = False


_TRIM = quoted(r"\A\s+|\s+\z")


def trim_space(text: Column) -> Column:
    """Trims every white-space character, not only blanks."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def dash_clean(day: Column) -> Column:
    """Text that ends in dashes loses them, then is trimmed."""
    return let(day, lambda d: F.when(d.endswith("-"), trim_space(F.rtrim(d, F.lit("-")))).otherwise(d))


def _scopes(rules: list[FieldRule]) -> list[FieldRule]:
    """The rules that others stand inside of, outer ones first."""
    out: list[FieldRule] = []
    for r in rules:
        for scope in (*_scopes([r.inside]), r.inside) if r.inside else ():
            if scope not in out:
                out.append(scope)
    return out


def _found(rule: FieldRule, scopes: list[FieldRule]) -> str:
    fit = _fit(rule.tag, rule.attr_name, rule.attr_value, rule.match)
    return M.elements(fit, f"pg.s{scopes.index(rule.inside)}" if rule.inside else None, rule.child)


def _field(rule: FieldRule, scopes: list[FieldRule]) -> str:
    """SQL: ``struct(value, missing)`` of a rule over a page's tokens and nodes."""
    found = _found(rule, scopes)
    if rule.take == "attr":
        there = M.fits("get(ts, el)", rule.tag, rule.attr, None, "equals")
        value = f"CASE WHEN el IS NOT NULL AND {there} THEN {M.unquoted(M.attribute('get(ts, el)', rule.attr))} END"
        missing = f"el IS NOT NULL AND NOT {there}" if rule.strict else "false"
        return M.bind(f"get({found}, 0)", "el", f"struct({value} AS value, {missing} AS missing)")
    if rule.take == "must":
        text = f"CASE WHEN el IS NOT NULL THEN {M.texts('el', rule.text)}[0] END"
        trimmed = f"regexp_replace(tx, {_TRIM}, '')" if rule.trim else "tx"
        missing = "tx IS NULL" if rule.trim else "el IS NULL"
        return M.bind(f"get({found}, 0)", "el", M.bind(text, "tx", f"struct({trimmed} AS value, {missing} AS missing)"))
    if rule.take == "join":
        every = f"flatten(transform({found}, el -> {M.texts('el', rule.text)}))"
        return f"struct(regexp_replace(array_join({every}, '\\n'), {_TRIM}, '') AS value, false AS missing)"
    if rule.take != "first":
        raise ValueError(f"unknown take {rule.take!r}")
    first = f"aggregate({found}, cast(NULL AS string), (tx, el) -> CASE WHEN tx IS NOT NULL THEN tx ELSE get({M.texts('el', rule.text)}, 0) END)"
    text = f"regexp_replace(coalesce({first}, ''), {_TRIM}, '')"
    if rule.dash_clean:
        text = M.bind(text, "tx", f"CASE WHEN endswith(tx, '-') THEN regexp_replace(rtrim('-', tx), {_TRIM}, '') ELSE tx END")
    return f"struct({text} AS value, false AS missing)"


def page(html: Column) -> Column:
    """A page's tokens, nodes and texts: what several field lists can be read from without reading the page again."""
    every = f"transform(ts, f -> {M.text_of('f')})"
    return _over(html, "html", M.over_page("html", f"struct(ts AS ts, ns AS ns, {every} AS xs)"))


def _on_page(read: Column, sql: str) -> Column:
    return _over(read, "pg", f"CASE WHEN pg IS NOT NULL THEN {M.bind('pg.ts', 'ts', M.bind('pg.ns', 'ns', M.bind('pg.xs', 'xs', sql)))} END")


def page_steps(rules: list[FieldRule]) -> list[Callable[[Column], Column]]:
    """How the page that :func:`page_fields` reads is made of HTML: each step takes the column of the one before.

    After :func:`page`, a step per depth of nested rules adds the elements that others stand inside of. As
    columns of their own they are analyzed one after the other; a single expression would nest too deep.
    """
    scopes, steps, done = _scopes(rules), [page], 0
    while done < len(scopes):
        inner = [r for r in scopes[done:] if r.inside is None or r.inside in scopes[:done]]
        level = scopes[done : done + len(inner)] if inner == scopes[done : done + len(inner)] else scopes[done : done + 1]
        kept = ["pg.ts AS ts", "pg.ns AS ns", "pg.xs AS xs", *(f"pg.s{k} AS s{k}" for k in range(done))]
        new = [f"{_found(r, scopes)} AS s{done + k}" for k, r in enumerate(level)]
        steps.append(lambda read, sql=f"struct({', '.join(kept + new)})": _on_page(read, sql))
        done += len(level)
    return steps


def page_fields(read: Column, rules: list[FieldRule]) -> Column:
    """All rules as one struct, over a column made by :func:`page_steps` of the same rules."""
    scopes = _scopes(rules)
    return _on_page(read, f"struct({', '.join(f'{_field(r, scopes)}.value AS `{r.name}`' for r in rules)})")


def page_failure(read: Column, rules: list[FieldRule]) -> Column:
    """``missing_<field>`` of the first rule that a page fails, else NULL."""
    scopes = _scopes(rules)
    needed = [r for r in rules if r.take == "must" or r.strict]
    if not needed:
        return F.lit(None).cast("string")
    each = ", ".join(f"CASE WHEN {_field(r, scopes)}.missing THEN 'missing_{r.name}' END" for r in needed)
    return _on_page(read, f"coalesce({each}, cast(NULL AS string))")


def with_fields(df: DataFrame, html: Column, rules: list[FieldRule], out: str) -> DataFrame:
    """``df`` with all rules over a page as the struct ``out``; the page is read once."""
    read = html
    for step in page_steps(rules):
        df = df.withColumn("_read", step(read))
        read = F.col("_read")
    return df.withColumn(out, page_fields(read, rules)).drop("_read")
