"""A library of Markdown documents: titles, sections, categories, briefs, indexes and counts, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_of

NO_CATEGORY = "未分类"
BRIEF_NOISE = ("image similar", "图片相似", "may contain optional", "image:", "图片：", "photo:", "照片：")


def first_heading(text: Column, fallback: Column) -> Column:
    h = F.regexp_extract(text, r"(?m)^#{1,6}[^\S\n]+(.+)$", 1)
    return F.when(h != "", F.trim(h)).otherwise(fallback)


def brief(text: Column) -> Column:
    """The first line of prose of 15 characters or more, cut to 140."""
    trimmed = F.transform(F.split(text, "\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    noise = lambda s: F.lower(s).rlike("^(?:" + "|".join(BRIEF_NOISE) + ")")
    prose = F.filter(trimmed, lambda s: (F.length(s) >= 15) & ~s.rlike(r"^(?:[#!>|-]|\*数据来源)") & ~noise(s))
    return F.coalesce(F.left(F.try_element_at(prose, F.lit(1)), F.lit(140)), F.lit(""))


def collect(docs: DataFrame, path: str = "path", text: str = "text", products: str = "产品", solutions: str = "解决方案", industries: str = "行业") -> DataFrame:
    """(path, title, section, category, brief, headings)."""
    p, t = F.col(path), F.coalesce(F.col(text), F.lit(""))
    first = F.substring_index(p, "/", 1)
    section = F.when(first == products, "product").when(first == solutions, "solution").when(first == industries, "industry").otherwise("other")
    parts = F.split(p, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return docs.select(
        p.alias("path"), first_heading(t, stem).alias("title"), section.alias("section"),
        F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.lit(NO_CATEGORY)).alias("category"), brief(t).alias("brief"), count_of(t, r"(?m)^#{1,6}\s+").alias("headings"),
    )


def _entry() -> Column:
    return F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(")"), F.when(F.col("brief") != "", F.concat(F.lit(" - "), "brief")).otherwise(""))


def entries(library: DataFrame) -> DataFrame:
    """(section, category, entry): the links as Markdown, a row each, sorted by section, category, title and path."""
    return library.orderBy("section", "category", "title", "path").select("section", "category", _entry().alias("entry"))


def index(library: DataFrame) -> DataFrame:
    """(section, category, docs, entries): the links of each category as one Markdown text, for small libraries; ``entries`` has rows."""
    listed = F.sort_array(F.collect_list(F.struct("title", "path", _entry().alias("entry"))))
    return library.groupBy("section", "category").agg(F.count(F.lit(1)).alias("docs"), F.array_join(F.transform(listed, lambda x: x["entry"]), "\n").alias("entries"))


def summary(library: DataFrame) -> DataFrame:
    """(section, category, docs_in_section, docs_of_category): a category's total counts all sections."""
    per = library.groupBy("section", "category").agg(F.count(F.lit(1)).alias("docs_in_section"))
    total = library.groupBy("category").agg(F.count(F.lit(1)).alias("docs_of_category"))
    return per.join(total, "category").select("section", "category", "docs_in_section", "docs_of_category")
