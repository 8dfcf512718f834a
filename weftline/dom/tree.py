"""A small HTML tree: an end tag closes up to the nearest open tag of its name, unmatched ones are ignored, nothing closes by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))


class Element:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children, self.parent = name, attrs or {}, [], None

    def append(self, child: Element | str) -> Element | str:
        if isinstance(child, Element):
            child.parent = self
        self.children.append(child)
        return child

    def get(self, key: str, default: str = "") -> str:
        return self.attrs.get(key, default)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def remove(self) -> Element:
        if self.parent is not None:
            del self.parent.children[self.index()]
            self.parent = None
        return self

    def replace(self, *new: Element | str) -> None:
        parent, at = self.parent, self.index()
        parent.children[at : at + 1] = new
        for n in new:
            if isinstance(n, Element):
                n.parent = parent
        self.parent = None

    def before(self, new: Element) -> None:
        self.parent.children.insert(self.index(), new)
        new.parent = self.parent

    def after(self, new: Element) -> None:
        self.parent.children.insert(self.index() + 1, new)
        new.parent = self.parent

    def unwrap(self) -> None:
        if self.parent is not None:
            self.replace(*self.children)

    def set_text(self, text: str) -> Element:
        self.children = [text]
        return self

    def walk(self) -> Iterator[Element]:
        """Elements below this one in document order, as they are when the walk begins."""
        return iter(self._below())

    def _below(self) -> list[Element]:
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, Element):
                out.append(c)
                if c.children:
                    todo += c.children[::-1]
        return out

    def all(self, *names: str, where: Callable[[Element], bool] | None = None) -> list[Element]:
        return [e for e in self._below() if (not names or e.name in names) and (where is None or where(e))]

    def first(self, *names: str) -> Element | None:
        return next((e for e in self.walk() if not names or e.name in names), None)

    def kids(self, *names: str) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element) and (not names or c.name in names)]

    def up(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def next(self, name: str | None = None) -> Element | None:
        """The next sibling element (of a name)."""
        later = self.parent.children[self.index() + 1 :] if self.parent is not None else []
        return next((c for c in later if isinstance(c, Element) and (name is None or c.name == name)), None)

    def strings(self) -> Iterator[str]:
        """Text below this element; that of scripts and styles only if it is one itself."""
        todo = [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, str):
                    yield c
                elif c.name not in RAW:
                    todo.append(iter(c.children))
                    break
            else:
                todo.pop()

    def text(self, sep: str = "", strip: bool = False) -> str:
        if strip:
            return sep.join(t for s in self.strings() if (t := s.strip()))
        return sep.join(self.strings())

    def attached(self, root: Element) -> bool:
        return self is root or any(e is root for e in self.up())

    def html(self) -> str:
        if self.name == "":
            return "".join(c if isinstance(c, str) else c.html() for c in self.children)
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        if self.name in VOID:
            return f"<{self.name}{attrs}/>"
        inner = "".join((c if self.name in RAW else escape(c, quote=False)) if isinstance(c, str) else c.html() for c in self.children)
        return f"<{self.name}{attrs}>{inner}</{self.name}>"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("")
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        e = self.at.append(Element(tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.at = e
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            e = self.at
            self.at = e.parent
            self.open[e.name] -= 1
            if e.name == tag:
                return

    def handle_data(self, data):
        kids = self.at.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str) -> Element:
    """The tree of a page under a nameless root; comments and declarations are left out."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
