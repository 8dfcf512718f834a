"""Documents as Markdown, Obsidian notes or JSON; native."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hooks
from ..functions.columns import images, links, wiki_links


def obsidian(md: Column, title: Column, url: Column, run_date: str) -> Column:
    """Front matter, and wiki links for links to Markdown files."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    front = F.concat(F.lit("---\ntitle: "), quote(title), F.lit("\nsource: "), quote(url), F.lit(f"\ndate: {run_date}\n---\n\n"))
    return F.concat(front, F.regexp_replace(md, r"(?<!!)\[([^\]]+)\]\([^)\s]+\.md\)", "[[$1]]"))


def as_json(md: Column, title: Column, url: Column, run_date: str) -> Column:
    local = F.filter(links(md), lambda r: r.rlike(r"(?i)\.(pdf|zip|docx?|xlsx?|pptx?|rar)($|[?#])"))
    heads = F.regexp_extract_all(md, F.lit(r"(?m)^#{1,6}[^\S\n]+(.+)$"), F.lit(1))
    return F.to_json(F.struct(
        title.alias("title"), md.alias("content"), images(md).alias("images"), local.alias("resources"), wiki_links(md).alias("wiki_links"),
        heads.alias("headings"), url.alias("source_url"), F.lit(run_date).alias("extract_date"),
    ))


def formatted(docs: DataFrame, kind: str = "md", run_date: str = "1970-01-01", hook_names: Iterable[str] = (), out: str = "body") -> DataFrame:
    """``docs`` (md, title, url) with the finished text."""
    md = hooks.apply(F.col("md"), hook_names)
    if kind == "obsidian":
        return docs.withColumn(out, obsidian(md, F.col("title"), F.col("url"), run_date))
    if kind == "json":
        return docs.withColumn(out, as_json(md, F.col("title"), F.col("url"), run_date))
    if kind != "md":
        raise ValueError(f"no such format: {kind}")
    return docs.withColumn(out, md)


def spec_table(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, spec_md): attributes (page, layer, ord, k, v) as a table each."""
    safe = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), safe("k"), F.lit(" | "), safe("v"), F.lit(" |"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    body = F.array_join(listed, "\n")
    head = F.concat(F.lit("## 技术参数 ("), F.min_by("layer", "ord"), F.lit(")\n\n| 参数 | 值 |\n| --- | --- |\n"))
    return rows.groupBy(page).agg(F.concat(head, body).alias("spec_md"))
