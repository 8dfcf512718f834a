"""CSS selectors: tags, classes, ids, attributes (presence and = *= ^= $= ~=), descendants, children, lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from .tree import Element

_simple = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>(?:\\.|[\w-])+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'|(?P<w>[^\]\s]+)))?\s*\]""")


@lru_cache(maxsize=512)
def compiled(selector: str) -> tuple:
    """For each part of the list: (combinator, tests) from left to right."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        steps, at, joint = [], 0, " "
        text = alternative.strip()
        if not text:
            continue
        while at < len(text):
            gap = re.compile(r"\s*(>)?\s*").match(text, at)
            if steps or gap.group(1):
                joint = ">" if gap.group(1) else " "
            at = gap.end()
            tests = []
            while at < len(text) and (m := _simple.match(text, at)):
                at = m.end()
                if m["tag"]:
                    tests.append(("tag", m["tag"].lower(), ""))
                elif m["cls"]:
                    tests.append(("class", m["cls"].replace("\\", ""), ""))
                elif m["id"]:
                    tests.append(("id", m["id"], ""))
                else:
                    tests.append((m["op"] or "has", m["attr"].lower(), next((m[g] for g in "qaw" if m[g] is not None), "")))
            if not tests:
                raise ValueError(f"unsupported selector: {selector}")
            steps.append((joint, tuple(tests)))
        out.append(tuple(steps))
    return tuple(out)


def _passes(e: Element, tests: tuple) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", e.name)
        elif kind == "class":
            ok = name in e.classes
        elif kind == "id":
            ok = e.attrs.get("id") == name
        else:
            have = e.attrs.get(name)
            ok = have is not None and (
                kind == "has" or (kind == "=" and have == value) or (bool(value) and (
                    (kind == "*=" and value in have) or (kind == "^=" and have.startswith(value)) or (kind == "$=" and have.endswith(value))
                    or (kind == "~=" and value in have.split())))
            )
        if not ok:
            return False
    return True


def _matches(e: Element, steps: tuple, root: Element) -> bool:
    joint, tests = steps[-1]
    if not _passes(e, tests):
        return False
    if len(steps) == 1:
        return True
    if joint == ">":
        return e.parent is not None and e.parent is not root and _matches(e.parent, steps[:-1], root)
    return any(_matches(a, steps[:-1], root) for a in e.up() if a is not root)


@lru_cache(maxsize=512)
def _possible(selector: str) -> tuple[frozenset[str], bool]:
    """Names of which every match without attributes has one, and whether it may have any name; most elements need no more tests."""
    plain = [tests for *_, (_, tests) in compiled(selector) if all(kind == "tag" for kind, *_ in tests)]
    return frozenset(name for (_, name, _), *_ in plain), any(name == "*" for (_, name, _), *_ in plain)


def _found(root: Element, selector: str) -> Iterator[Element]:
    parts = compiled(selector)
    names, every = _possible(selector)
    for e in root.walk():
        if (e.attrs or every or e.name in names) and any(_matches(e, p, root) for p in parts):
            yield e


def select(root: Element, selector: str) -> list[Element]:
    """All matches in document order."""
    return list(_found(root, selector))


def select_one(root: Element, selector: str) -> Element | None:
    return next(_found(root, selector), None)
