"""Field rules over a tag tree of the standard-library parser: what the native columns are held against."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from linkloom.functions.html import FieldRule
from linkloom.functions.markup import BLOCKS

# --- fixed values: elements without an end tag, and elements that end an open one -------------
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LISTS = {"menu", "ol", "ul"}
# -----------------------------------------------------------------------------------------------


class Element:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.number = tag, attrs, [], 0

    def below(self) -> Iterator[Element]:
        """Descendant elements in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def own_texts(self) -> list[str]:
        return [c for c in self.children if isinstance(c, str)]

    def texts(self) -> list[tuple[str, Element]]:
        """Text nodes in document order, each with the element it stands in."""
        out, todo = [], [(c, self) for c in reversed(self.children)]
        while todo:
            c, up = todo.pop()
            if isinstance(c, str):
                out.append((c, up))
            else:
                todo.extend((d, c) for d in reversed(c.children))
        return out

    def all_text(self) -> str:
        return "".join(t for t, _ in self.texts())

    def only_text(self) -> str | None:
        e = self
        while len(e.children) == 1:
            if isinstance(e.children[0], str):
                return e.children[0]
            e = e.children[0]
        return None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open, self.made, self.cut = [self.root], 0, False

    def handle_starttag(self, tag, attrs):
        names = [e.tag for e in self.open]
        if tag in BLOCKS and "p" in names:
            del self.open[names.index("p") :]
        elif tag == "li":  # the open item of the same list, if any
            since = max((i for i, n in enumerate(names) if n in LISTS), default=0)
            if "li" in names[since:]:
                del self.open[since + names[since:].index("li") :]
        e = Element(tag, {k: (v or "") for k, v in attrs})
        self.made += 1
        e.number = self.made
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        self.cut = True  # any tag ends a text node
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        kids = self.open[-1].children
        if kids and isinstance(kids[-1], str) and not self.cut:
            kids[-1] += data
        else:
            kids.append(data)
        self.cut = False


def parse(html: str) -> Element:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _fits(e: Element, rule: FieldRule) -> bool:
    if e.tag != rule.tag:
        return False
    if rule.attr_name is None:
        return True
    if rule.attr_name not in e.attrs:
        return False
    have = e.attrs[rule.attr_name]
    if rule.attr_value is None:
        return True
    if rule.match == "contains":
        return rule.attr_value in have
    if rule.match == "token":
        return rule.attr_value in have.split()
    return have == rule.attr_value


def select(root: Element, rule: FieldRule) -> list[Element]:
    """Elements of a rule, each once, in document order."""
    if rule.inside is None:
        return [e for e in root.below() if _fits(e, rule)]
    seen, out = set(), []
    for scope in select(root, rule.inside):
        inner = (c for c in scope.children if isinstance(c, Element)) if rule.child else scope.below()
        for e in inner:
            if _fits(e, rule) and id(e) not in seen:
                seen.add(id(e))
                out.append(e)
    return sorted(out, key=lambda e: e.number)


def _texts(e: Element, rule: FieldRule) -> list[str]:
    if rule.text == "own":
        return e.own_texts()
    if rule.text == "below":
        return [t for t, up in e.texts() if up is not e]
    return [e.all_text()]


def _field(root: Element, rule: FieldRule) -> tuple[str | None, bool]:
    """(value, a required element is missing)."""
    found = select(root, rule)
    if rule.take == "attr":
        value = found[0].attrs.get(rule.attr) if found else None
        return value, rule.strict and bool(found) and value is None
    if rule.take == "must":
        if not found:
            return None, True
        text = found[0].only_text() if rule.text == "only" else found[0].all_text()
        if rule.trim:
            return (None, True) if text is None else (text.strip(), False)
        return text, False
    texts = [t for e in found for t in _texts(e, rule)]
    if rule.take == "join":
        return "\n".join(texts).strip(), False
    text = texts[0].strip() if texts else ""
    if rule.dash_clean and text.endswith("-"):
        text = text.rstrip("-").strip()
    return text, False


def read_fields(html: str, rules: list[FieldRule]) -> tuple[dict[str, str | None], str | None]:
    """(fields by rule name, name of the first missing required field or None)."""
    root = parse(html)
    out = {}
    for rule in rules:
        out[rule.name], missing = _field(root, rule)
        if missing:
            return out, rule.name
    return out, None
