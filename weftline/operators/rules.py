"""Rules on whole Markdown texts as columns: one pass within the row, in Arrow batches, without a shuffle.

They are the rules that pages go through. ``lines`` has them as windows for tables that arrive as lines; tests hold the two
against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..dom import rewrite, structure

SECTION = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType())]))
ISSUE = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("issue", T.StringType())]))


def per_text(f: Callable, kind: T.DataType | None = None) -> Callable[[Column | str], Column]:
    """A column function of ``f``, which takes one text; null stays null."""
    kind = kind or T.StringType()

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], type=to_arrow_type(kind))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def clamp_jumps(text: Column | str) -> Column:
    return per_text(rewrite.clamp_jumps)(text)


def demote_subheadings(text: Column | str, patterns: Sequence[str]) -> Column:
    keys = list(patterns)
    return per_text(lambda t: rewrite.demote_subheadings(t, keys))(text)


def merge_same_titles(text: Column | str) -> Column:
    return per_text(rewrite.merge_same_titles)(text)


def drop_alt_echoes(text: Column | str) -> Column:
    return per_text(rewrite.drop_alt_echoes)(text)


def plain_spaces(text: Column | str) -> Column:
    return per_text(rewrite.plain_spaces)(text)


def skip_card_sections(text: Column | str) -> Column:
    return per_text(rewrite.skip_card_sections)(text)


def dedupe_blocks(text: Column | str) -> Column:
    return per_text(rewrite.dedupe_repeated_blocks)(text)


def normalise_headings(text: Column | str, **options) -> Column:
    return per_text(lambda t: rewrite.normalise_headings(t, **options))(text)


def assembled(text: Column | str, patterns: Sequence[str] = (), product: bool = True) -> Column:
    keys = list(patterns)
    return per_text(lambda t: rewrite.assembled(t, keys, product))(text)


def polish(text: Column | str, config: dict | None = None) -> Column:
    cfg = config or {}
    return per_text(lambda t: rewrite.polish(t, cfg))(text)


def empty_sections(text: Column | str) -> Column:
    """Headings below which no text comes before a shallower heading or the end, as structs (pos, level, title)."""
    return per_text(structure.empty_sections, SECTION)(text)


def heading_issues(text: Column | str) -> Column:
    """Headings without a title and jumps of more than one level, as structs (pos, issue)."""
    return per_text(structure.heading_issues, ISSUE)(text)


def structure_issues(text: Column | str) -> Column:
    """Issues of headings in order, then empty sections."""
    return per_text(structure.issues, T.ArrayType(T.StringType()))(text)
