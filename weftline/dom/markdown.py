"""A tree as Markdown: ATX headings, ``-`` bullets, pipe tables, fenced code."""

from __future__ import annotations

import re
import sys

from .tree import RAW, Element

DROPPED = RAW | {"video", "source", "template", "head", "title", "noscript"}
BLOCKS = frozenset("p div section article main body html figure figcaption header footer nav aside address form fieldset details summary dl dt dd center".split())
sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))  # unclosed tags nest deep
_space = re.compile(r"[ \t\r\n\f\v]+")
_special = re.compile(r"([*_])")


def to_markdown(root: Element) -> str:
    text = re.sub(r"\n{3,}", "\n\n", _inside(root, False, 0))
    return "\n".join(line if line.strip() else "" for line in text.split("\n")).strip("\n")


def _inside(e: Element, inline: bool, depth: int) -> str:
    out: list[str] = []
    for c in e.children:
        piece = _text(c) if isinstance(c, str) else _element(c, inline, depth)
        if out and out[-1].endswith(("\n", " ")) and isinstance(c, str):
            piece = piece.lstrip(" ")
        if piece.startswith("\n") and out:
            out[-1] = out[-1].rstrip(" ")
        out.append(piece)
    return "".join(out)


def _text(s: str) -> str:
    return _special.sub(r"\\\1", _space.sub(" ", s))


def _marked(text: str, mark: str) -> str:
    """White space stays outside the marks."""
    core = text.strip()
    if not core:
        return text
    a = text[: len(text) - len(text.lstrip())]
    z = text[len(text.rstrip()) :]
    return f"{a}{mark}{core}{mark}{z}"


def _block(text: str) -> str:
    return f"\n\n{text}\n\n" if text.strip() else ""


def _element(e: Element, inline: bool, depth: int) -> str:
    n = e.name
    if n in DROPPED:
        return ""
    if n in ("h1", "h2", "h3", "h4", "h5", "h6"):
        text = _space.sub(" ", _inside(e, True, depth)).strip()
        if inline:
            return f" {text} "
        return f"\n\n{'#' * int(n[1])} {text}\n\n" if text else ""
    if n in ("b", "strong"):
        return _marked(_inside(e, inline, depth), "**")
    if n in ("i", "em"):
        return _marked(_inside(e, inline, depth), "*")
    if n in ("del", "s"):
        return _marked(_inside(e, inline, depth), "~~")
    if n in ("code", "kbd", "samp"):
        raw = e.text()
        return f"`{raw}`" if raw.strip() else ""
    if n == "br":
        return " " if inline else "  \n"
    if n == "hr":
        return "\n\n---\n\n"
    if n == "img":
        alt = _space.sub(" ", e.get("alt"))
        if inline:
            return alt
        title = e.get("title").replace('"', r"\"")
        return f"![{alt}]({e.get('src')}" + (f' "{title}")' if title else ")")
    if n == "a":
        return _link(e, inline, depth)
    if n in ("ul", "ol"):
        return _list(e, inline, depth)
    if n == "li":
        return "\n" + _list_item(e, "- ", inline, depth)
    if n == "pre":
        return f"\n\n```\n{e.text().strip(chr(10))}\n```\n\n"
    if n == "blockquote":
        body = _inside(e, inline, depth).strip()
        return "\n\n" + "\n".join(f"> {line}" if line else ">" for line in body.split("\n")) + "\n\n" if body else ""
    if n == "table":
        return _table(e, inline, depth)
    if n in BLOCKS:
        text = _inside(e, inline, depth)
        return f" {text.strip()} " if inline else _block(text.strip())
    return _inside(e, inline, depth)


def _link(e: Element, inline: bool, depth: int) -> str:
    text = _inside(e, inline, depth)
    href, core = e.get("href"), text.strip()
    if not core:
        return text
    if not href:
        return text
    a, z = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    if core.replace("\\_", "_") == href and not e.get("title"):
        return f"{a}<{href}>{z}"
    title = e.get("title").replace('"', r"\"")
    return f"{a}[{core}]({href}" + (f' "{title}")' if title else ")") + z


def _list(e: Element, inline: bool, depth: int) -> str:
    items = [c for c in e.children if isinstance(c, Element)]
    first = int(e.get("start")) if e.get("start").isdigit() else 1
    rows, k = [], first
    for c in items:
        if c.name == "li":
            rows.append(_list_item(c, f"{k}. " if e.name == "ol" else "- ", inline, depth + 1))
            k += 1
        else:
            rows.append(_element(c, inline, depth + 1).strip("\n") + "\n")
    text = "".join(r for r in rows if r.strip())
    if inline:
        return " " + _space.sub(" ", text) + " "
    return ("\n" if any(a.name == "li" for a in e.up()) else "\n\n") + text + ("" if any(a.name == "li" for a in e.up()) else "\n")


def _list_item(e: Element, bullet: str, inline: bool, depth: int) -> str:
    body = _inside(e, inline, depth).strip()
    if not body:
        return ""
    pad = " " * len(bullet)
    first, *rest = body.split("\n")
    return bullet + "\n".join([first, *(pad + r if r.strip() else "" for r in rest)]) + "\n"


def _table(e: Element, inline: bool, depth: int) -> str:
    rows = []
    for tr in e.all("tr"):
        if next((a for a in tr.up() if a.name == "table"), None) is not e:
            continue
        cells = [_space.sub(" ", _inside(c, True, depth)).strip().replace("|", r"\|") for c in tr.kids("td", "th")]
        if cells:
            rows.append((cells, bool(tr.kids("th")) or any(a.name == "thead" for a in tr.up())))
    if not rows:
        text = _inside(e, inline, depth).strip()
        return _block(text)
    width = max(len(c) for c, _ in rows)
    line = lambda c: "| " + " | ".join([*c, *[""] * (width - len(c))]) + " |"
    head, body = (rows[0][0], rows[1:]) if rows[0][1] or len(rows) > 1 else ([""] * width, rows)
    out = [line(head), "| " + " | ".join(["---"] * width) + " |", *(line(c) for c, _ in body)]
    caption = next((c.text(strip=True) for c in e.kids("caption")), "")
    if inline:
        return " " + " ".join(x for c, _ in rows for x in c if x) + " "
    return _block((caption + "\n\n" if caption else "") + "\n".join(out))
