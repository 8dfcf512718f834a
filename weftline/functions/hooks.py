"""Named hooks on finished Markdown: column to column. Unknown names are reported and passed over."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Hook = Callable[[Column], Column]
STAGES = ("post_markdown",)
_HOOKS: dict[tuple[str, str], Hook] = {}


def register(name: str, hook: Hook, stage: str = "post_markdown") -> None:
    if stage not in STAGES:
        raise ValueError(f"no such stage: {stage}")
    _HOOKS[stage, name] = hook


def apply(text: Column, names: Iterable[str], stage: str = "post_markdown") -> Column:
    for name in names:
        hook = _HOOKS.get((stage, name))
        if hook is None:
            logging.getLogger(__name__).warning("unknown hook %s at %s", name, stage)
        else:
            text = hook(text)
    return text


register("strip_blank_runs", lambda c: F.regexp_replace(c, r"\n{3,}", "\n\n"))
