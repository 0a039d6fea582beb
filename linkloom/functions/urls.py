"""URL splitting, joining and canonical forms as native Spark expressions.

Each URL costs one short anchored regex (the scheme); everything else is substring work, so a
projection over URLs stays in one whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------
# A scheme is the text before the first ":" when it holds only these characters and what
# follows is not a bare number ("host:8080" has no scheme).
SCHEME_PATTERN = r"^([a-zA-Z0-9+.-]+):(?:[0-9]*[^0-9]|\z)"
# Schemes whose last path segment may carry ";params".
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
# The only file suffix an html-only source takes.
HTML_SUFFIX = "html"
# -----------------------------------------------------------------------------------------

URL_PARTS = ("scheme", "host", "path", "params", "query", "fragment")
WWW_MODES = ("keep", "add", "strip", "listed")


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_steps(df: DataFrame, steps: list[dict[str, str]], *scratch: str) -> DataFrame:
    """Adds SQL columns, later steps naming columns of earlier ones, then drops the scratch ones.

    One select with lateral aliases: analyzed once, not once per step.
    """
    made = [f"{text} AS {name}" for step in steps for name, text in step.items()]
    return df.selectExpr("*", *made).drop(*scratch)


_SCHEME_SQL = quoted(SCHEME_PATTERN)
_PARAM_SCHEMES_SQL = ", ".join(quoted(s) for s in PARAM_SCHEMES)


def with_url_parts(df: DataFrame, url: str = "url", prefix: str = "") -> DataFrame:
    """Adds ``<prefix>scheme, host, path, params, query, fragment`` of column ``url``.

    The scheme is lower-cased, the host keeps case, port and user info, and the path keeps
    blanks (``parse_url`` gives NULL there). ``path`` comes without its ``;params``, which start
    at the first ``;`` of the last segment. Steps are columns of their own, so each is evaluated
    once.
    """
    p = f"_{prefix}u_"
    steps = [
        {f"{p}scheme": f"regexp_extract({url}, {_SCHEME_SQL}, 1)", f"{p}nofrag": f"substring_index({url}, '#', 1)"},
        {f"{p}head": f"substring_index({p}nofrag, '?', 1)"},
        {
            f"{p}rest": f"if({p}scheme = '', {p}head, substr({p}head, length({p}scheme) + 2))",
            f"{prefix}query": f"substr({p}nofrag, length({p}head) + 2)",
            f"{prefix}fragment": f"substr({url}, length({p}nofrag) + 2)",
        },
        {
            f"{prefix}scheme": f"lower({p}scheme)",
            f"{prefix}host": f"CASE WHEN startswith({p}rest, '//') THEN substring_index(substr({p}rest, 3), '/', 1) "
            f"WHEN {p}rest IS NOT NULL THEN '' END",
        },
        {f"{p}path": f"if(startswith({p}rest, '//'), substr({p}rest, length({prefix}host) + 3), {p}rest)"},
        {
            f"{p}last": f"if(contains({p}path, ';') AND {prefix}scheme IN ({_PARAM_SCHEMES_SQL}), "
            f"substring_index({p}path, '/', -1), '')"
        },
        {f"{p}cut": f"length({p}last) - length(substring_index({p}last, ';', 1))"},
        {
            f"{prefix}path": f"if({p}cut > 0, substr({p}path, 1, length({p}path) - {p}cut), {p}path)",
            f"{prefix}params": f"if({p}cut > 0, substr({p}path, length({p}path) - {p}cut + 2), left({p}path, 0))",
        },
    ]
    return with_steps(df, steps, *(name for step in steps for name in step if name.startswith(p)))


def join_parts(scheme: Column, host: Column, path: Column, query: Column, fragment: Column | None = None) -> Column:
    """Puts a URL back together; empty parts leave no delimiter, a NULL part gives NULL."""
    empty = F.lit("")
    pieces = [
        F.when(scheme == "", empty).otherwise(F.concat(scheme, F.lit(":"))),
        F.when(host == "", empty).otherwise(F.concat(F.lit("//"), host)),
        path,
        F.when(query == "", empty).otherwise(F.concat(F.lit("?"), query)),
    ]
    if fragment is not None:
        pieces.append(F.when(fragment == "", empty).otherwise(F.concat(F.lit("#"), fragment)))
    return F.concat(*pieces)


def canonical_path(path: Column) -> Column:
    """Path without trailing slashes."""
    return F.rtrim(path, F.lit("/"))


def is_html_path(trimmed: Column) -> Column:
    """True for a path with no dot, or whose text after its last dot is exactly ``html``."""
    return ~trimmed.contains(".") | (F.substring_index(trimmed, ".", -1) == HTML_SUFFIX)


def has_www(host: Column) -> Column:
    return host.startswith("www.")


def add_www(host: Column) -> Column:
    return F.when(has_www(host), host).otherwise(F.concat(F.lit("www."), host))


def strip_www(host: Column) -> Column:
    return F.when(has_www(host), F.substr(host, F.lit(5))).otherwise(host)


def twin_host(host: Column) -> Column:
    """The www form of a bare host, the bare form of a www host."""
    return F.when(has_www(host), strip_www(host)).otherwise(add_www(host))


def canonical_host(host: Column, www_mode: str, listed: Column | None = None) -> Column:
    """Host under a source's www policy. ``listed`` tells whether this very host is declared."""
    if www_mode == "keep":
        return host
    if www_mode == "add":
        return add_www(host)
    if www_mode == "strip":
        return strip_www(host)
    if www_mode == "listed":
        return F.when(F.coalesce(listed, F.lit(False)), host).otherwise(twin_host(host))
    raise ValueError(f"unknown www_mode {www_mode!r}")


def canonical_url(scheme: Column, host: Column, path: Column, query: Column, drop_query: bool = False) -> Column:
    """Scheme, host and query kept; params, fragment and trailing slashes dropped."""
    return join_parts(scheme, host, canonical_path(path), F.lit("") if drop_query else query)


def query_keys_sql(query: str) -> str:
    """Sorted distinct names of the parameters of a query column; blank-valued ones do not count."""
    name = "substring_index(kv, '=', 1)"
    return (
        f"array_sort(array_distinct(transform(filter(split({query}, '[&;]'), kv -> kv RLIKE '^[^=]*=.'), "
        f"kv -> coalesce(try_url_decode({name}), {name}))))"
    )


def remove_dot_segments_sql(path: str) -> str:
    """RFC 3986 5.2.4. Only paths that do hold a dot segment pay for the fold."""
    segments = f"split({path}, '/')"
    fold = (
        f"aggregate({segments}, cast(array() AS array<string>), (kept, s) -> CASE WHEN s = '.' THEN kept "
        "WHEN s = '..' THEN if(size(kept) > 1, slice(kept, 1, size(kept) - 1), kept) ELSE array_append(kept, s) END)"
    )
    closed = f"if(element_at({segments}, -1) IN ('.', '..'), array_append({fold}, ''), {fold})"
    return f"if({path} RLIKE '(?:^|/)[.][.]?(?:/|$)', array_join({closed}, '/'), {path})"


def with_resolved_parts(df: DataFrame, href: str, base: str, out: str = "t_") -> DataFrame:
    """Adds ``<out>scheme, host, path, query, fragment``: ``href`` resolved against a base.

    ``base`` is the prefix of columns made by :func:`with_url_parts` on the page URL. The target
    is built from parts, so the resolved URL is not parsed a second time. ``<out>path`` still
    carries ``;params``. A NULL ``href`` has a NULL scheme and host.
    """
    h, b = "_h_", base
    df = with_url_parts(df, href, h)
    whole = "if({0}params = '', {0}path, concat({0}path, ';', {0}params))"
    own = f"{h}host != '' OR {h}path != '' OR {h}params != ''"
    base_dir = (
        f"if({b}host != '' AND {b}path = '', '/', "
        f"left({b}path, length({b}path) - length(substring_index({b}path, '/', -1))))"
    )
    rooted = f"if(startswith({h}whole, '/') OR {h}host != '', {h}whole, concat({base_dir}, {h}whole))"
    steps = [
        {f"{h}absolute": f"{h}scheme != ''", f"{h}whole": whole.format(h)},
        {
            f"{h}merged": f"CASE WHEN {h}absolute THEN {h}whole WHEN {own} THEN {rooted} ELSE {whole.format(b)} END",
        },
        {
            f"{out}scheme": f"CASE WHEN {h}absolute THEN {h}scheme WHEN {href} IS NOT NULL THEN {b}scheme END",
            f"{out}host": f"CASE WHEN {h}absolute OR {h}host != '' THEN {h}host WHEN {href} IS NOT NULL THEN {b}host END",
            f"{out}path": f"if({h}absolute OR NOT ({own}), {h}merged, {remove_dot_segments_sql(h + 'merged')})",
            f"{out}query": f"if({h}absolute OR {own} OR {h}query != '', {h}query, {b}query)",
            f"{out}fragment": f"{h}fragment",
        },
    ]
    return with_steps(df, steps, *(f"{h}{k}" for k in (*URL_PARTS, "absolute", "whole", "merged")))


def resolved_url(href: Column, base_url: Column, out: str = "t_") -> Column:
    """The resolved link as text, from the columns of :func:`with_resolved_parts`."""
    target = join_parts(*(F.col(f"{out}{k}") for k in ("scheme", "host", "path", "query", "fragment")))
    return F.when(href == "", base_url).when(href.rlike(SCHEME_PATTERN), href).otherwise(target)
