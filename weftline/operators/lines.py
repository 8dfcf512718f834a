"""Markdown as a table of lines, and the rules on it that run line by line elsewhere, as windows.

All windows of a document share one partitioning, so a chain of these operators shuffles once. A document's lines meet
in one task, as its text did; no other grouping is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES, ZERO_WIDTH = "\u00a0\u202f\u2009\u2007\u3000", "\u200b\u200c\u200d\ufeff"
HEADING = r"^(#{1,6})\s+(.+)$"


def md_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, line): lines by line feeds, from 0."""
    return df.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))


def joined(lines: DataFrame, text: str = "md") -> DataFrame:
    """(doc, text) again, in the order of pos."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("doc").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias(text))


def _by(*keys: str) -> Window:
    return Window.partitionBy("doc", *keys).orderBy("pos")


def _so_far(*keys: str) -> Window:
    return _by(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _stripped(line: Column | None = None) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(F.col("line") if line is None else line, r"(?U)^\s+|\s+$", "")


def with_headings(lines: DataFrame) -> DataFrame:
    """``lines`` with level (null if the line is no heading) and title."""
    s = _stripped()
    mark = F.regexp_extract(s, HEADING, 1)
    return lines.withColumn("level", F.when(mark != "", F.length(mark))).withColumn("title", F.when(mark != "", F.trim(F.regexp_extract(s, HEADING, 2))))


def _written(level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("title"))


def clamp_jumps(lines: DataFrame) -> DataFrame:
    """No heading is more than one level below the heading before it: out_level, and the line written so.

    out(h) = min(level(h), out(h - 1) + 1) is h + the least of level - h so far, h counting headings.
    """
    h = with_headings(lines)
    heads = h.withColumn("h", F.when(F.col("level").isNotNull(), F.count("level").over(_so_far())))
    out = heads.withColumn("out_level", F.when(F.col("level").isNotNull(), (F.col("h") + F.min(F.col("level") - F.col("h")).over(_so_far())).cast("int")))
    return out.withColumn("line", F.when(F.col("level").isNotNull(), _written(F.col("out_level"))).otherwise(F.col("line"))).drop("h")


def normalise_headings(
    lines: DataFrame, body_max: int = 0, max_level: int = 5, long: int = 60, url: str = "^https?://", current_name: str = "", product: bool = False
) -> DataFrame:
    """Titles cleaned, URLs and over-long titles made text, jumps clamped within stretches of headings without prose between."""
    m = F.regexp_extract("line", r"^(#{1,6})\s+(.*)", 1)
    raw = F.regexp_replace(F.regexp_extract("line", r"^(#{1,6})\s+(.*)", 2), r"\\n", " ")
    from ..functions.columns import without_repeated_code

    content = F.trim(F.regexp_replace(raw, r"\s+", " "))
    named = (content == current_name) if product and current_name else F.lit(False)
    x = lines.withColumn("level", F.when(m != "", F.length(m))).withColumn("own", F.coalesce(named, F.lit(False)) & (m != ""))
    x = x.withColumn("title", F.when(m != "", without_repeated_code(content)))
    head = F.col("level").isNotNull()
    as_url, as_bold = head & F.col("title").rlike(url), head & (F.length("title") > long)
    s = _stripped()
    reset = (~head & (s != "") & ~s.startswith("#")) | F.col("own") | (as_url & (F.col("title") != "")) | as_bold
    x = x.withColumn("kind", F.when(F.col("own") | (head & (F.col("title") == "")), "gone").when(as_url, "url").when(as_bold, "bold").when(head, "head").otherwise("line"))
    x = x.withColumn("seg", F.count_if(reset).over(_so_far()))
    level = F.least(F.greatest(F.col("level"), F.lit(body_max)), F.lit(max_level))
    x = x.withColumn("lv", F.when(F.col("kind") == "head", level)).withColumn("h", F.count("lv").over(_so_far("seg")))
    x = x.withColumn("out_level", F.when(F.col("lv").isNotNull(), (F.col("h") + F.min(F.col("lv") - F.col("h")).over(_so_far("seg"))).cast("int")))
    line = (
        F.when(F.col("kind") == "url", F.col("title"))
        .when(F.col("kind") == "bold", F.concat(F.lit("**"), F.col("title"), F.lit("**")))
        .when(F.col("kind") == "head", _written(F.col("out_level")))
        .otherwise(F.col("line"))
    )
    return x.filter(F.col("kind") != "gone").withColumn("line", line).select("doc", "pos", "line", "out_level")


def shift_headings(lines: DataFrame) -> DataFrame:
    """A document whose highest heading is below level 2 is moved up so that it is level 2."""
    h = with_headings(lines)
    top = F.min("level").over(Window.partitionBy("doc"))
    return h.withColumn("up", F.greatest(top - 2, F.lit(0))).withColumn(
        "line", F.when(F.col("level").isNotNull() & (F.col("up") > 0), _written(F.col("level") - F.col("up"))).otherwise(F.col("line"))
    ).drop("up", "level", "title")


def demote_subheadings(lines: DataFrame, patterns: Sequence[str], longest: int = 24) -> DataFrame:
    """Headings with a sub-heading's title go below the last heading that has none of them."""
    h = with_headings(lines)
    named = F.lit(False)
    for p in patterns:
        named |= F.col("title").contains(p)
    h = h.withColumn("sub", F.coalesce((F.length("title") <= longest) & named, F.lit(False)))
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("level").isNotNull() & ~F.col("sub"), F.col("level")), ignorenulls=True).over(before)
    h = h.withColumn("last", last)
    level = F.when(F.col("sub") & (F.col("level") <= F.col("last")), F.least(F.col("last") + 1, F.lit(6))).otherwise(F.col("level"))
    return h.withColumn("out_level", level).withColumn("line", F.when(F.col("level").isNotNull(), _written(F.col("out_level"))).otherwise(F.col("line"))).drop("last")


def merge_same_titles(lines: DataFrame) -> DataFrame:
    """Of two headings of one title on lines that follow each other the shallower stays, pair by pair."""
    h = with_headings(lines)
    again = (F.lag("title").over(_by()) == F.col("title")) & F.lag("level").over(_by()).isNotNull()
    h = h.withColumn("run", F.count_if(~F.coalesce(again, F.lit(False))).over(_so_far()))
    h = h.withColumn("pair", F.floor((F.row_number().over(_by("run")) - 1) / 2))
    first = F.row_number().over(Window.partitionBy("doc", "run", "pair").orderBy("level", "pos"))
    return h.withColumn("n", F.when(F.col("level").isNull(), F.lit(1)).otherwise(first)).filter("n = 1").drop("run", "pair", "n")


def strip_alt_echoes(lines: DataFrame) -> DataFrame:
    """Drops a line that repeats the alternative text of the image before it."""
    s = _stripped()
    full = lines.withColumn("s", s).withColumn("alt", F.trim(F.regexp_extract("s", r"^!\[([^\]]+)\]\([^)]+\)$", 1)))
    text = F.when(F.col("s") != "", F.struct("alt"))
    prev = F.last(text, ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    x = full.withColumn("prev", prev["alt"])
    return x.filter(~((F.col("s") != "") & (F.col("alt") == "") & F.coalesce(F.col("prev") == F.col("s"), F.lit(False)))).select("doc", "pos", "line")


def skip_sections(lines: DataFrame, titles: Sequence[str], ending: str = "资源") -> DataFrame:
    """Drops sections with such titles, up to the next heading of their level or above."""
    h = with_headings(lines)
    trigger = F.col("level").isNotNull() & (F.col("title").isin(*titles) | F.col("title").endswith(ending))
    h = h.withColumn("hit", F.coalesce(trigger, F.lit(False))).withColumn("group", F.count_if(F.col("hit")).over(_so_far()))
    h = h.withColumn("at", F.first(F.when(F.col("hit"), F.col("level")), ignorenulls=True).over(Window.partitionBy("doc", "group")))
    closed = F.coalesce(F.max(F.when(~F.col("hit"), F.col("level") <= F.col("at"))).over(_so_far("group")), F.lit(False))
    return h.withColumn("open", (F.col("group") == 0) | closed).filter("open and not hit").select("doc", "pos", "line")


def plain_spaces(lines: DataFrame) -> DataFrame:
    """Spaces of other kinds become spaces and zero-width characters go, but inside fenced blocks."""
    fence = _stripped().startswith("```")
    inside = (F.count_if(fence).over(_so_far()) % 2 == 1) | fence
    return lines.withColumn("line", F.when(inside, F.col("line")).otherwise(F.translate("line", SPACES + ZERO_WIDTH, " " * len(SPACES))))


def dedupe_blocks(lines: DataFrame) -> DataFrame:
    """Of each run of lines without a blank one that occurs again in its document the first stays; blank lines all stay."""
    s = lines.withColumn("s", _stripped()).withColumn("blank", F.col("s") == "")
    # a run's lines have the same number of blank lines before them
    s = s.withColumn("run", F.count_if("blank").over(_so_far()))
    runs = s.filter("not blank").groupBy("doc", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "\n").alias("k"))
    first = runs.withColumn("n", F.row_number().over(Window.partitionBy("doc", F.xxhash64("k"), "k").orderBy("run"))).select("doc", "run", "n")
    both = s.join(first, ["doc", "run"], "left")
    return both.filter("blank or n = 1").select("doc", "pos", "line")


def table_islands(lines: DataFrame) -> DataFrame:
    """``lines`` with island (a number for each block of table rows, else null) and row (from 1 in it)."""
    s = _stripped()
    is_row = s.startswith("|") & (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2)
    x = lines.withColumn("is_row", is_row)
    begins = F.col("is_row") & ~F.coalesce(F.lag("is_row").over(_by()), F.lit(False))
    x = x.withColumn("island", F.when(F.col("is_row"), F.count_if(begins).over(_so_far())))
    return x.withColumn("row", F.when(F.col("is_row"), F.row_number().over(_by("island")))).drop("is_row")


def empty_sections(lines: DataFrame) -> DataFrame:
    """Headings below which no text comes before a shallower heading or the end: (doc, pos, level, title)."""
    h = with_headings(lines).withColumn("s", _stripped())
    mark = F.regexp_extract("s", r"^(#{1,6})\s+", 1)
    h = h.withColumn("any", F.when(mark != "", F.length(mark)))
    ahead = Window.partitionBy("doc").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    text = F.min(F.when((F.col("s") != "") & F.col("any").isNull(), F.col("pos"))).over(ahead)
    above = [F.min(F.when(F.col("any") < level, F.col("pos"))).over(ahead) for level in range(1, 7)]
    x = h.withColumn("text_at", text).withColumn("above", F.array(*above))
    close = F.element_at("above", F.col("level"))
    return x.filter(F.col("level").isNotNull()).withColumn("close", close).filter("text_at is null or text_at > close").select("doc", "pos", "level", "title")


def heading_issues(lines: DataFrame) -> DataFrame:
    """(doc, pos, issue): headings without a title, and jumps of more than one level."""
    s = _stripped()
    mark = F.regexp_extract(s, r"^(#{1,6})\s*(.*)", 1)
    h = lines.withColumn("lv", F.length(mark)).withColumn("t", F.trim(F.regexp_extract(s, r"^(#{1,6})\s*(.*)", 2))).filter("lv > 0")
    prev = F.lag("lv").over(_by())
    n = F.col("pos") + 1
    empty = F.when(F.col("t") == "", F.concat(F.lit("empty-heading:L"), n))
    jump = F.when(F.col("lv") > F.col("prev") + 1, F.concat(F.lit("heading-jump:L"), n, F.lit(":"), F.col("prev"), F.lit("->"), F.col("lv")))
    found = h.withColumn("prev", prev).select("doc", "pos", F.explode(F.array_compact(F.array(empty, jump))).alias("issue"))
    return found
