"""A page as tokens and nodes, in native expressions.

``tokens`` cuts a page into text runs and tags by the lexical rules of HTML: comments, quoted attribute
values and the contents of script, style, title and textarea hold no tags. ``nodes`` folds the tokens
once with a stack of open elements and says of each token where its element ends and what it stands in;
finished elements leave the stack for a list kept in short pieces, so the fold is linear in the tokens.

Everything here is Spark SQL text, put together by ``linkloom.functions.html``.
"""

from __future__ import annotations

from html.entities import html5

from linkloom.functions.urls import quoted

# --- fixed values: lexical rules and elements --------------------------------------------------
# Patterns that run over a whole page start with their "<", so a scan leaves every other
# character after one comparison. Possessive groups loop without recursion, however long the page.
# What follows a tag's name; a quote counts after "=" only.
REST = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>"""
COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
BOGUS = r"<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\z)"
RAW_TEXT = ("script", "style")
RAW = ("script", "style", "title", "textarea")
# Elements that may stand before the body.
HEAD = "html|head|meta|link|base|noscript|template"
VOID = "area base br col embed hr img input link meta source track wbr".split()
LISTS = "menu ol ul".split()
# Elements whose start ends an open paragraph.
BLOCKS = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul"
).split()
# Windows characters that stand for the numbers 128 to 159; others among them stand for themselves.
WINDOWS = "".join(bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) for b in range(128, 160))
# -------------------------------------------------------------------------------------------------

SKIPPED = rf"{COMMENT}|{BOGUS}"
RAW_START = rf"<({'|'.join(RAW)})(?=[\s/>]){REST}"
TEXT_RUN = rf"(?:[^<]++|<(?![a-zA-Z/!?])|{SKIPPED})++"
TOKEN = rf"(?is){TEXT_RUN}|{RAW_START}.*?(?=</\1[\s/>]|\z)|</?[a-z]{REST}|<[a-z/][^>]*+\z"
IS_TAG = r"\A</?[a-zA-Z]"
_RAW_WHOLE = rf"<({{names}})(?=[\s/>]){REST}.*?(?:</\1(?=[\s/>]){REST}|\z)"
_BEFORE_BODY = rf"\s++|{SKIPPED}|{{raw}}|<(?:{HEAD})(?=[\s/>]){REST}|</[a-z]{REST}"
# Everything up to the body tag, or to the first content that can only stand in a body.
HEAD_PART = rf"(?is)\A(?:{_BEFORE_BODY.format(raw=_RAW_WHOLE.format(names='|'.join(RAW[:3])))})*+"
HEAD_TITLE = (
    rf"(?is)\A(?:{_BEFORE_BODY.format(raw=_RAW_WHOLE.format(names='|'.join(RAW_TEXT)))})*+"
    rf"<title(?=[\s/>]){REST}(.*?)(?=</title[\s/>]|\z)"
)
# Every tag is passed whole, and what holds no tags is skipped; only anchors with an href have a first group.
_RAW_ANY = rf"<(?:{'|'.join(rf'{n}(?=[\s/>]){REST}.*?(?:</{n}(?=[\s/>])|\z)' for n in RAW)})"
_OTHER_ATTRIBUTES = r"""(?:[\s/]++(?!{name}[\s=/>])[^\s/>][^\s=/>]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+)*+[\s/]++"""
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
ANCHOR_HREF = rf"(?is){SKIPPED}|{_RAW_ANY}|<a(?=[\s/]){_OTHER_ATTRIBUTES.format(name='href')}href\s*+=\s*+{_VALUE}|</?[a-z]{REST}"


def bind(value: str, name: str, use: str) -> str:
    """SQL: ``use``, in which ``name`` is ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {use})[0]"


# --- character references ------------------------------------------------------------------------

# Name and character of each reference, with its ";" if it needs one, by the first letter's code less 65.
_START, _IS = "\u0001", "\u0002"
_BY_LETTER = [""] * 58
for _name, _chars in html5.items():
    _BY_LETTER[ord(_name[0]) - 65] += f"{_START}{_name}{_IS}{_chars}"
REFERENCES = "array(" + ", ".join(quoted(x + _START if x else x) for x in _BY_LETTER) + ")"
# The longest name that needs no ";".
_LONGEST = max(len(n) for n in html5 if not n.endswith(";"))
_NAME = quoted(r"\A[a-zA-Z][a-zA-Z0-9]{0,31}+;?")
_NUMBER = quoted(r"\A#(?:[xX][0-9a-fA-F]++|[0-9]++);?")


def _look(name: str) -> str:
    at = bind(f"instr(s, concat('{_START}', {name}, '{_IS}'))", "a", f"CASE WHEN a > 0 THEN substring_index(substr(s, a + length({name}) + 2), '{_START}', 1) END")
    return bind(f"get(refs, ascii({name}) - 65)", "s", at)


def _named(attribute: bool) -> str:
    """The rest ``p`` after an ampersand, its longest known name replaced."""
    tries = [f"struct(m AS n, {_look('m')} AS v)"]
    for k in range(_LONGEST, 1, -1):
        tries.append(f"CASE WHEN length(m) > {k} THEN {bind(f'substr(m, 1, {k})', 'q', f'struct(q AS n, {_look("q")} AS v)')} END")
    found = f"get(filter(array({', '.join(tries)}), t -> t.v IS NOT NULL), 0)"
    kept = "concat('&', p)"
    # In an attribute a name without ";" before "=", a letter or a digit is no reference.
    open_end = "NOT endswith(r.n, ';') AND substr(p, length(r.n) + 1, 1) RLIKE '[=a-zA-Z0-9]'" if attribute else "false"
    use = f"CASE WHEN r IS NULL OR ({open_end}) THEN {kept} ELSE concat(r.v, substr(p, length(r.n) + 1)) END"
    return bind(f"regexp_extract(p, {_NAME}, 0)", "m", bind(found, "r", use))


def _numbered() -> str:
    digits = r"regexp_replace(m, '\\A#[xX]?0*+|;\\z', '')"
    code = "CASE WHEN d = '' THEN 0 WHEN length(d) > 7 THEN 1114112 WHEN m RLIKE '[xX]' THEN cast(conv(d, 16, 10) AS int) ELSE cast(d AS int) END"
    char = f"""CASE WHEN c BETWEEN 128 AND 159 THEN substr({quoted(WINDOWS)}, c - 127, 1)
      WHEN c = 0 OR c > 1114111 OR c BETWEEN 55296 AND 57343 THEN '�'
      WHEN c < 9 OR c = 11 OR c BETWEEN 14 AND 31 OR c = 127 OR c BETWEEN 64976 AND 65007 OR c % 65536 >= 65534 THEN ''
      ELSE decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') END"""
    use = bind(digits, "d", bind(code, "c", f"concat({char}, substr(p, length(m) + 1))"))
    return bind(f"regexp_extract(p, {_NUMBER}, 0)", "m", f"CASE WHEN m = '' THEN concat('&', p) ELSE {use} END")


def decoded(text: str, attribute: bool = False) -> str:
    """SQL: ``text`` with its character references replaced; ``refs`` must be bound to ``REFERENCES``.

    References met on almost every page are tried before the table.
    """
    piece = f"""(p, i) -> CASE WHEN i = 0 THEN p
  WHEN startswith(p, 'amp;') THEN concat('&', substr(p, 5))
  WHEN startswith(p, 'nbsp;') THEN concat(' ', substr(p, 6))
  WHEN startswith(p, 'quot;') THEN concat('"', substr(p, 6))
  WHEN startswith(p, 'lt;') THEN concat('<', substr(p, 4))
  WHEN startswith(p, 'gt;') THEN concat('>', substr(p, 4))
  WHEN startswith(p, '#') THEN {_numbered()}
  WHEN p RLIKE '^[a-zA-Z]' THEN {_named(attribute)}
  ELSE concat('&', p) END"""
    return bind(text, "x", f"CASE WHEN instr(x, '&') = 0 THEN x ELSE array_join(transform(split(x, '&'), {piece}), '') END")


def unquoted(value: str) -> str:
    """SQL: an attribute value as written -> its text."""
    plain = "CASE WHEN startswith(v, '\"') OR startswith(v, '''') THEN substr(v, 2, length(v) - 2) ELSE v END"
    return bind(value, "v", decoded(plain, attribute=True))


# --- tokens and nodes ------------------------------------------------------------------------------


def tokens(html: str) -> str:
    return f"regexp_extract_all({html}, {quoted(TOKEN)}, 0)"


def text_of(token: str, strip_script: bool = False) -> str:
    """SQL: the text a token holds, NULL if none. Only script and style text is taken as it stands."""
    inside = f"regexp_replace(k, {quoted(r'(?is)\A' + RAW_START)}, '')"
    as_is = "cast(NULL AS string)" if strip_script else inside
    raw = f"""CASE WHEN k RLIKE {quoted(rf"(?i)\A<(?:{'|'.join(RAW_TEXT)})[\s/>]")} THEN {as_is}
      WHEN k RLIKE {quoted(rf"(?i)\A<(?:{'|'.join(RAW)})[\s/>]")} THEN {decoded(inside)} END"""
    plain = f"CASE WHEN instr(k, '<') > 0 THEN regexp_replace(k, {quoted('(?s)' + SKIPPED)}, '') ELSE k END"
    whole = f"CASE WHEN k RLIKE {quoted(IS_TAG)} THEN CASE WHEN k RLIKE '(?i)^<[st]' THEN {raw} END ELSE {decoded(plain)} END"
    return bind(token, "k", bind(whole, "tx", "CASE WHEN tx <> '' THEN tx END"))


def _listed(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# Per token its number, its element's name and what it is: 0 text, 1 start, 2 end, 3 nothing, 4 an element without inside.
_INFO = f"""transform(ts, (t, i) -> transform(array(lower(regexp_extract(t, {quoted(r"\A</?([a-zA-Z][^\s/>]*+)")}, 1))), n -> struct(i AS i, n AS n,
  CASE WHEN n = '' THEN CASE WHEN instr(t, '<') > 0 AND regexp_replace(t, {quoted('(?s)' + SKIPPED)}, '') = '' THEN 3 ELSE 0 END
    WHEN startswith(t, '</') THEN 2
    WHEN n IN ({_listed(VOID)}) OR (endswith(t, '/>') AND NOT n IN ({_listed(list(RAW))})) THEN 4 ELSE 1 END AS c))[0])"""

# The fold. Spark copies what a fold carries at every step, so tokens are folded in blocks: within a block it
# carries the top of the stack (``s``; ``d`` open elements lie below it, in the stack the block began with), the
# first open paragraph (``p``), the open lists and items (``l``: twice the number, one more for an item) and
# the block's finished nodes (``c``, as text). The whole stack and all nodes are copied once per block.
_BLOCK, _NEAR = 64, 64
_TOP, _BELOW = "element_at(z.s, -1)", "slice(whole.s, 1, z.d)"
_HIT = f"""CASE WHEN x.c = 2 THEN CASE WHEN get(inf, {_TOP}).n = x.n THEN {_TOP}
    ELSE coalesce(array_max(filter(z.s, y -> get(inf, y).n = x.n)), array_max(filter({_BELOW}, y -> get(inf, y).n = x.n))) END
  WHEN x.c IN (1, 4) AND x.n = 'li' THEN CASE WHEN element_at(z.l, -1) % 2 = 1 THEN cast(element_at(z.l, -1) div 2 AS int) END
  WHEN x.c IN (1, 4) AND z.p >= 0 AND x.n IN ({_listed(BLOCKS)}) THEN z.p END"""
_LEFT = f"filter({_BELOW}, y -> y < hit)"
_KEPT = f"""CASE WHEN hit IS NULL THEN z.s WHEN hit > z.s[0] THEN CASE WHEN hit = {_TOP} THEN slice(z.s, 1, size(z.s) - 1) ELSE filter(z.s, y -> y < hit) END
  ELSE slice({_LEFT}, greatest(1, size({_LEFT}) - {_NEAR - 1}), {_NEAR}) END"""


def _node(number: str, end: str, parent: str) -> str:
    return f"concat({number}, ',', {end}, ',', {parent}, ';')"


_GONE = f"CASE WHEN hit >= z.s[0] THEN filter(z.s, y -> y >= hit) ELSE concat(filter({_BELOW}, y -> y >= hit), z.s) END"
_ENDED = f"""CASE WHEN hit IS NULL THEN '' WHEN hit = {_TOP} THEN {_node('hit', 'x.i', 'element_at(kept, -1)')}
  ELSE {bind(_GONE, 'g', f"array_join(transform(g, (y, j) -> {_node('y', 'x.i', 'CASE WHEN j = 0 THEN element_at(kept, -1) ELSE get(g, j - 1) END')}), '')")} END"""
_OWN = f"CASE WHEN x.c = 1 THEN '' WHEN x.c IN (0, 4) THEN {_node('x.i', '(x.i + 1)', 'element_at(kept, -1)')} ELSE {_node('x.i', '0', '-9')} END"
_OPEN_LISTS = "CASE WHEN hit IS NULL OR element_at(z.l, -1) < 2 * hit THEN z.l ELSE filter(z.l, y -> y < 2 * hit) END"
_STEP = bind(
    _HIT,
    "hit",
    bind(
        _KEPT,
        "kept",
        f"""struct(CASE WHEN x.c = 1 THEN array_append(kept, x.i) ELSE kept END AS s,
      CASE WHEN hit IS NULL OR hit > z.s[0] THEN z.d ELSE greatest(size({_LEFT}) - {_NEAR}, 0) END AS d,
      CASE WHEN x.c = 1 AND x.n = 'p' AND (z.p < 0 OR coalesce(hit <= z.p, false)) THEN x.i WHEN hit <= z.p THEN -1 ELSE z.p END AS p,
      CASE WHEN x.c = 1 AND x.n IN ('li', {_listed(LISTS)}) THEN array_append({_OPEN_LISTS}, 2 * x.i + CASE WHEN x.n = 'li' THEN 1 ELSE 0 END) ELSE {_OPEN_LISTS} END AS l,
      concat(z.c, {_ENDED}, {_OWN}) AS c)""",
    ),
)
_FOLD = f"""aggregate(filter(sequence(0, (size(inf) + {_BLOCK - 1}) div {_BLOCK}), b -> b * {_BLOCK} < size(inf)),
  struct(array(-1) AS s, '' AS done, -1 AS p, array(-2) AS l),
  (whole, b) -> aggregate(slice(inf, cast(b * {_BLOCK} AS int) + 1, {_BLOCK}),
    struct(slice(whole.s, greatest(1, size(whole.s) - {_NEAR - 1}), {_NEAR}) AS s, greatest(size(whole.s) - {_NEAR}, 0) AS d, whole.p AS p, whole.l AS l, '' AS c),
    (z, x) -> {_STEP},
    z -> struct(concat({_BELOW}, z.s) AS s, concat(whole.done, z.c) AS done, z.p AS p, z.l AS l)),
  whole -> concat(whole.done, array_join(transform(slice(whole.s, 2, size(whole.s)),
    (y, j) -> {_node('y', 'size(inf)', 'get(whole.s, j)')}), '')))"""
_READ = "transform(array(split(q, ',')), w -> struct(cast(w[0] AS int) AS k, nullif(cast(w[1] AS int), 0) AS e, nullif(cast(w[2] AS int), -9) AS up))[0]"
# One entry per token, in order: where its element ends (the end tag's number, or past the last token) and the
# number of the element it stands in (-1: none). End tags and comments have neither.
NODES = bind(_INFO, "inf", f"array_sort(transform(filter(split({_FOLD}, ';'), q -> q <> ''), q -> {_READ}))")


# --- elements ----------------------------------------------------------------------------------------


def attribute(token: str, name: str) -> str:
    """SQL: the value of a start tag's attribute as written; ``''`` if it has none."""
    found = rf"(?is)\A<[a-z][^\s/>]*+{_OTHER_ATTRIBUTES.format(name=name)}{name}(?:\s*+=\s*+{_VALUE})?+"
    return f"regexp_extract({token}, {quoted(found)}, 1)"


def fits(token: str, tag: str, attr: str | None, value: str | None, match: str) -> str:
    """SQL: whether a token starts an element of a name whose attribute is there, or is as wanted."""
    name = f"{token} RLIKE {quoted(rf'(?i)\A<{tag}[\s/>]')}"
    if attr is None:
        return name
    there = rf"(?is)\A<[a-z][^\s/>]*+{_OTHER_ATTRIBUTES.format(name=attr)}{attr}[\s=/>]"
    if value is None:
        return f"({name} AND {token} RLIKE {quoted(there)})"
    want = quoted(value)
    test = {
        "equals": f"w = {want}",
        "contains": f"instr(w, {want}) > 0",
        "token": f"array_contains(split(w, {quoted(r'\s+')}), {want})",
    }[match]
    return f"({name} AND {token} RLIKE {quoted(there)} AND {bind(unquoted(attribute(token, attr)), 'w', test)})"


def elements(fit, scopes: str | None = None, child: bool = False) -> str:
    """SQL: numbers of the elements whose start token ``fit(token)`` accepts, in document order.

    ``scopes`` (numbers of elements) narrows the search to what stands inside them, to their direct
    children if ``child`` is set.
    """
    if scopes is None:
        return f"filter(transform(ts, (f, j) -> CASE WHEN {fit('f')} THEN j END), j -> j IS NOT NULL)"
    own = "AND get(ns, o + 1 + j).up = o " if child else ""
    inside = f"filter(transform(slice(ts, o + 2, get(ns, o).e - o - 1), (f, j) -> CASE WHEN {fit('f')} {own}THEN o + 1 + j END), j -> j IS NOT NULL)"
    found = f"flatten(transform({scopes if child else outermost(scopes)}, o -> {inside}))"
    return f"array_sort({found})" if child else found


def outermost(numbers: str) -> str:
    """SQL: the elements that stand in no other of the list.

    An element is one of them if it lies past the ends of all before it: in blocks, so that no long list is carried.
    """
    block = 64
    kept = f"""aggregate(slice(g, cast(b * {block} AS int) + 1, {block}), struct({{start}} AS e, cast(array() AS array<int>) AS c),
      (o, j) -> CASE WHEN j < o.e THEN o ELSE struct(get(ns, j).e AS e, array_append(o.c, j) AS c) END, o -> o)"""
    step = kept.format(start="whole.e")
    return bind(
        numbers,
        "g",
        f"""transform(filter(split(aggregate(filter(sequence(0, (size(g) + {block - 1}) div {block}), b -> b * {block} < size(g)),
      struct(0 AS e, '' AS c), (whole, b) -> {bind(step, 'o', "struct(o.e AS e, concat(whole.c, array_join(transform(o.c, j -> concat(j, ';')), '')) AS c)")},
      whole -> whole.c), ';'), j -> j <> ''), j -> cast(j AS int))""",
    )


def texts(element: str, mode: str) -> str:
    """SQL: texts of an element as an array, from the texts ``xs`` of all tokens: ``all`` joined to one, its ``own``
    text nodes or those ``below`` its child elements, or its ``only`` text (NULL if it has several children or none)."""
    e = element
    region = f"slice(xs, {e} + 1, get(ns, {e}).e - {e})"
    if mode == "all":
        return f"array(array_join({region}, ''))"
    if mode in ("own", "below"):
        # A raw element's token holds its text as well: its own, or below any other.
        mine = f"(j = 0 OR (get(ns, {e} + j).up = {e} AND NOT get(ts, {e} + j) RLIKE {quoted(IS_TAG)}))"
        return f"filter({region}, (f, j) -> f IS NOT NULL AND {'' if mode == 'own' else 'NOT '}{mine})"
    if mode != "only":
        raise ValueError(f"unknown text {mode!r}")
    chain = f"filter(transform({region}, (f, j) -> struct({e} + j AS k, get(ns, {e} + j).up AS up, f AS x)), f -> f.up IS NOT NULL)"
    broken = "exists(transform(r, (f, j) -> (j > 0 AND f.up <> get(r, j - 1).k) OR (j < size(r) - 1 AND f.x IS NOT NULL)), f -> f)"
    return f"array({bind(chain, 'r', f'CASE WHEN NOT {broken} THEN element_at(r, -1).x END')})"


def inside(element: str) -> str:
    """SQL: the markup between an element's tags."""
    return f"array_join(slice(ts, {element} + 2, get(ns, {element}).e - {element} - 1), '')"


def over_page(html: str, use: str) -> str:
    """SQL: ``use`` of a page's tokens ``ts``, nodes ``ns`` and the table ``refs``; NULL for a NULL page."""
    return f"CASE WHEN {html} IS NOT NULL THEN {bind(REFERENCES, 'refs', bind(tokens(html), 'ts', bind(NODES, 'ns', use)))} END"
