"""What a Markdown text's headings tell: jumps, missing titles, sections without text."""

from __future__ import annotations

import re

_marked = re.compile(r"(#{1,6})\s+(.*)", re.S)
_any = re.compile(r"(#{1,6})\s*(.*)", re.S)
TITLE_LENGTH = 30


def heading_issues(text: str) -> list[dict]:
    """(pos, issue) of headings without a title and of jumps of more than one level."""
    out, before = [], None
    for pos, line in enumerate(text.split("\n")):
        m = _any.match(line.strip())
        if m is None:
            continue
        level = len(m[1])
        if not m[2].strip():
            out.append({"pos": pos, "issue": f"empty-heading:L{pos + 1}"})
        if before is not None and level > before + 1:
            out.append({"pos": pos, "issue": f"heading-jump:L{pos + 1}:{before}->{level}"})
        before = level
    return out


def empty_sections(text: str) -> list[dict]:
    """(pos, level, title) of headings below which no text comes before a shallower heading or the end.

    From the last line to the first: where the next text is, and where the next heading of each level.
    """
    out, text_at, next_at = [], None, [None] * 7
    lines = text.split("\n")
    for pos in range(len(lines) - 1, -1, -1):
        s = lines[pos].strip()
        m = _marked.match(s)
        if m is None:
            text_at = pos if s else text_at
            continue
        level = len(m[1])
        if m[2].strip():
            close = min((p for p in next_at[1:level] if p is not None), default=None)
            if text_at is None or (close is not None and text_at > close):
                out.append({"pos": pos, "level": level, "title": m[2].strip()})
        next_at[level] = pos
    return out[::-1]


def issues(text: str) -> list[str]:
    found = [x["issue"] for x in heading_issues(text)]
    return found + ["empty-section:" + x["title"][:TITLE_LENGTH] for x in empty_sections(text)]
