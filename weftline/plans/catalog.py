"""Queries on the tables ``pages`` and ``documents``, with the SQL that gives the same rows.

Rules on Markdown run within the row, as pages' texts go through them (``operators.rules``), but for four that run as windows on tables of
lines (``operators.lines``). ``documents`` holds prose. Queries on Markdown turn every third line of a text into a heading whose level follows from the
document and the line (``as_markdown`` here, ``MD`` in SQL), so that headings occur at all levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import changes, discovery, formats, library, lines, quality, rules
from ..operators import pages as stage
from . import recipes

SUB = ("the", "of", "de")
BASE = "https://www.site3.example.com"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def as_markdown(docs: DataFrame) -> DataFrame:
    """(doc, text): every third line as a heading."""
    level = lambda i: (1 + (F.col("doc_id") + 5 * i) % 6).cast("int")
    one = lambda s, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), level(i)), F.lit(" "), s)).otherwise(s)
    return docs.select(F.col("doc_id").alias("doc"), F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), one), "\n").alias("text"))


def md(spark: SparkSession, d: str) -> DataFrame:
    return lines.md_lines(as_markdown(documents(spark, d)), "doc", "text")


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: source as first folder, language as second."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")))
    named = documents(spark, d).select("doc_id", path.alias("path"))
    return as_markdown(documents(spark, d)).join(named, F.col("doc") == F.col("doc_id")).select("doc", "path", "text")


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, d).select(
        "page_id", F.lower(fn.part(u, "PROTOCOL")).alias("scheme"), F.lower(fn.part(u, "AUTHORITY")).alias("host"), fn.slug(u).alias("slug"),
        fn.is_list_page(u).alias("is_list"), F.md5(F.lower(u)).alias("url_md5"),
    )


def same_origin_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select("page_id", "url")
    b = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("base"))
    return p.join(b, "page_id").select("page_id", fn.same_origin("url", "base").alias("same"))


def list_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).filter(fn.is_list_page("url") | F.col("url").contains(".html")).select("page_id", fn.is_list_page("url").alias("is_list"))


def discovery_controls(spark: SparkSession, d: str) -> DataFrame:
    items = pages(spark, d).select(F.col("page_id").alias("ord"), F.lit("product").alias("kind"), F.col("url").alias("id"), "url")
    return discovery.controlled(items, ["^product .*https"], [r"utm_", r"\?page="], 40).select("ord", "url")


def url_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("page_id", discovery.category_of(F.col("url"), "^https?://[^/]+/([a-z]+)", 1).alias("slug"), "url")
    return rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("url")), " ").alias("urls"))


def _headings(df: DataFrame, out: Column) -> DataFrame:
    """(doc, pos, level, out_level, line) of the headings of ``text`` as they were and as ``out`` has them."""
    level = lambda c: F.length(F.regexp_extract(F.regexp_replace(c, r"^\s+|\s+$", ""), lines.HEADING, 1))
    both = F.arrays_zip(F.split("text", "\n", -1).alias("before"), F.split(out, "\n", -1).alias("after"))
    rows = df.select("doc", F.posexplode(both).alias("pos", "x")).select("doc", "pos", level(F.col("x.before")).alias("level"), level(F.col("x.after")).alias("out_level"), F.col("x.after").alias("line"))
    return rows.filter("level > 0")


def _digest(text: Column) -> list[Column]:
    return [F.size(F.split(text, "\n", -1)).alias("n"), F.md5(text).alias("text_md5")]


def heading_clamp(spark: SparkSession, d: str) -> DataFrame:
    docs = as_markdown(documents(spark, d))
    return _headings(docs, rules.clamp_jumps("text")).select("doc", "pos", "level", "out_level", F.md5("line").alias("line_md5"))


def heading_demotion(spark: SparkSession, d: str) -> DataFrame:
    docs = as_markdown(documents(spark, d))
    return _headings(docs, rules.demote_subheadings("text", SUB)).select("doc", "pos", "level", "out_level")


def same_title_merge(spark: SparkSession, d: str) -> DataFrame:
    flat = md(spark, d).select("doc", "pos", F.regexp_replace("line", "^(#+) .*$", "$1 t").alias("line")).filter("pos % 3 = 0")
    return lines.merge_same_titles(flat.withColumn("pos", (F.col("pos") / 3).cast("int"))).select("doc", "pos", "level")


def _remade(docs: DataFrame, line: Callable[[Column, Column], Column]) -> DataFrame:
    """Documents with each line made anew from it and its place."""
    return docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"))


def merged_titles(spark: SparkSession, d: str) -> DataFrame:
    heads = F.transform(F.filter(F.split("text", "\n", -1), lambda s, i: i % 3 == 0), lambda s: F.regexp_replace(s, "^(#+) .*$", "$1 t"))
    docs = as_markdown(documents(spark, d)).withColumn("text", F.array_join(heads, "\n"))
    return docs.select("doc", rules.merge_same_titles("text").alias("out")).select("doc", *_digest(F.col("out")))


def _with_images(s: Column, i: Column) -> Column:
    return F.when(i % 2 == 0, F.lit("![a](x)")).when(F.length(F.regexp_extract(s, "([A-Za-z]+)", 1)) % 2 == 0, F.lit("a")).otherwise(s)


def alt_echoes(spark: SparkSession, d: str) -> DataFrame:
    """As windows, on a table of lines."""
    made = md(spark, d).select("doc", "pos", _with_images(F.col("line"), F.col("pos")).alias("line"))
    return lines.strip_alt_echoes(made).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def alt_echo_texts(spark: SparkSession, d: str) -> DataFrame:
    """Alternative texts of every kind: each image has the line behind it as its own."""
    line = lambda s, i: F.when(i % 3 == 0, F.concat(F.lit("!["), F.regexp_replace(s, r"[\[\]#]", ""), F.lit("x](u)"))).when(i % 3 == 1, F.concat(F.regexp_replace(s, r"[\[\]#]", ""), F.lit("x"))).otherwise(s)
    docs = _remade(as_markdown(documents(spark, d)), lambda s, i: line(F.concat(F.lit("t"), (i / 3).cast("int").cast("string")), i))
    return docs.select("doc", rules.drop_alt_echoes("text").alias("out")).select("doc", *_digest(F.col("out")))


def fenced_spaces(spark: SparkSession, d: str) -> DataFrame:
    docs = _remade(as_markdown(documents(spark, d)), lambda s, i: F.when(i % 5 == 2, F.lit("``` x")).otherwise(F.replace(s, F.lit("e"), F.lit("\u00a0"))))
    return docs.select("doc", F.posexplode(F.split(rules.plain_spaces("text"), "\n", -1)).alias("pos", "line")).select("doc", "pos", F.md5("line").alias("line_md5"))


def skipped_sections(spark: SparkSession, d: str) -> DataFrame:
    """As windows, on a table of lines."""
    made = md(spark, d).withColumn("line", F.when(F.col("pos") % 9 == 3, F.regexp_replace("line", "^(#+) .*$", "$1 Watch")).otherwise(F.col("line")))
    return lines.skip_sections(made, ["Watch", "Listen", "Read"]).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def skipped_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = _remade(as_markdown(documents(spark, d)), lambda s, i: F.when(i % 9 == 3, F.regexp_replace(s, "^(#+) .*$", "$1 Watch")).otherwise(s))
    return docs.select("doc", rules.skip_card_sections("text").alias("out")).select("doc", *_digest(F.col("out")))


def repeated_blocks(spark: SparkSession, d: str) -> DataFrame:
    """As windows, on a table of lines."""
    made = lines.md_lines(documents(spark, d).select(F.col("doc_id").alias("doc"), F.regexp_replace("text", r"([.!?]) ", "$1\n\n").alias("text")), "doc", "text")
    return lines.dedupe_blocks(made).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def repeated_block_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("doc_id").alias("doc"), F.regexp_replace("text", r"([.!?]) ", "$1\n\n").alias("text"))
    kept = F.filter(F.transform(F.split(rules.dedupe_blocks("text"), "\n", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return docs.select("doc", kept.alias("kept")).select("doc", F.size("kept").alias("n"), F.md5(F.array_join("kept", "\n")).alias("kept_md5"))


def empty_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines keep their places; one in three is blank in every other document."""
    docs = _remade(as_markdown(documents(spark, d)), lambda s, i: F.when((i % 3 != 1) | (F.col("doc") % 2 == 0), s).otherwise(F.lit("")))
    return docs.select("doc", F.explode(rules.empty_sections("text")).alias("x")).select("doc", "x.pos", "x.level", F.md5("x.title").alias("title_md5"))


def heading_issues(spark: SparkSession, d: str) -> DataFrame:
    return as_markdown(documents(spark, d)).select("doc", F.explode(rules.heading_issues("text")).alias("x")).select("doc", "x.issue")


def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.quality_rows(paths(spark, d))
    return rows.select("path", "score", F.md5(F.array_join("issues", ",")).alias("issues_md5"), "word_count", "heading_count", "image_count", "resource_count")


def worst_documents(spark: SparkSession, d: str) -> DataFrame:
    return quality.worst(quality.quality_rows(paths(spark, d))).select("path", "score", "word_count")


def site_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.site_summary(quality.quality_rows(paths(spark, d)))


def quality_verdict(spark: SparkSession, d: str) -> DataFrame:
    v = quality.verdict(site_summary(spark, d), expect_specs=True)
    return v.select("ok", F.array_join("reasons", ",").alias("reasons"), "next_action")


def line_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.metrics(paths(spark, d))


def library_documents(spark: SparkSession, d: str) -> DataFrame:
    return library.collect(paths(spark, d), products="src0", solutions="src1", industries="src2").select("path", F.md5("title").alias("title_md5"), "section", "category", F.md5("brief").alias("brief_md5"), "headings")


def library_index(spark: SparkSession, d: str) -> DataFrame:
    rows = library.index(library.collect(paths(spark, d), products="src0", solutions="src1", industries="src2"))
    return rows.select("section", "category", "docs", F.md5("entries").alias("entries_md5"))


def library_summary(spark: SparkSession, d: str) -> DataFrame:
    return library.summary(library.collect(paths(spark, d), products="src0", solutions="src1", industries="src2"))


def _snapshot(rows: DataFrame, html: str = "html") -> DataFrame:
    return rows.select(F.lit("product").alias("kind"), F.col("page_id").cast("string").alias("id"), F.col("url").alias("name"), F.lit("").alias("category"), F.md5(html).alias("fp"))


def _gone(p: DataFrame) -> DataFrame:
    """Entries of a baseline whose pages are no more."""
    return p.filter("page_id % 21 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), "url", "html")


def baseline_changes(spark: SparkSession, d: str) -> DataFrame:
    """All pages against a baseline that lacks a third, has other contents of a fifth, and holds pages that are gone."""
    p = pages(spark, d)
    known = p.filter("page_id % 3 <> 0").withColumn("html", F.when(F.col("page_id") % 5 == 0, F.lit("old")).otherwise(F.col("html")))
    return changes.detect(_snapshot(p), _snapshot(known.unionByName(_gone(p)))).select("kind", "id", "change_type")


def baseline_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A baseline of two thirds of the pages and some that are gone, brought up to date by all."""
    p = pages(spark, d)
    return changes.refreshed(_snapshot(p.filter("page_id % 3 <> 0").unionByName(_gone(p)), "url"), _snapshot(p)).select("id", "fp")


def quality_regressions(spark: SparkSession, d: str) -> DataFrame:
    """All documents against earlier ones, of which some were longer, some are new, and some are gone."""
    docs = paths(spark, d)
    was = docs.filter("doc % 13 <> 0").withColumn("text", F.when(F.col("doc") % 4 == 0, F.concat("text", F.lit("\n## more\n[[a]] "), "text")).otherwise(F.col("text")))
    gone = docs.filter("doc % 11 = 0").withColumn("path", F.concat(F.lit("gone/"), "path"))
    return quality.regressions(quality.metrics(docs), quality.metrics(was.unionByName(gone))).select("path", "status", F.array_join("issues", ",").alias("issues"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", fn.fingerprint("text").alias("fp"))
    return rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def file_names(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", fn.safe_name("url").alias("name"), fn.is_identifier(fn.slug("url")).alias("is_id"), fn.name_from_url("url").alias("title"))


def lost_tokens(spark: SparkSession, d: str) -> DataFrame:
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return documents(spark, d).select("doc_id", F.round(fn.lost_share("text", half), 6).alias("lost"))


#: The article is isolated, what surrounds it goes.
PROFILE = {"html_components": {"content_selector": "article"}, "filters": {"image_ignore_keywords": ["logo", "icon", "banner"]}}


def extracted(spark: SparkSession, d: str, *want: str) -> DataFrame:
    return stage.extract(pages(spark, d), PROFILE, want)


def html_link_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = extracted(spark, d, "links").select("page_id", F.explode_outer("links").alias("l"))
    return rows.groupBy("page_id").agg(F.count("l").alias("n"), F.coalesce(F.sum(F.length("l.text")), F.lit(0)).alias("letters"))


def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return extracted(spark, d, "md", "error").select("page_id", "url", "md", "error")


def page_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return stage.extract(recipes.literal_references(pages(spark, d)), PROFILE, ["fp"]).select("page_id", "fp")


def page_specs(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of pages whose links are given a table of specifications by a fixed recipe."""
    rows = pages(spark, d).withColumn(
        "html", F.concat("html", F.lit("<table><tr><td>Page</td><td>"), "page_id", F.lit("</td></tr><tr><td>Size</td><td>"), F.length("url"), F.lit("</td></tr><tr><td>Kind</td><td>page</td></tr></table>"))
    )
    return stage.specs(stage.extract(rows, {"spec_extraction": {"cascade": ["spec_table"]}}, ["specs"])).select("page_id", "layer", "ord", "k", "v")


def page_shells(spark: SparkSession, d: str) -> DataFrame:
    return extracted(spark, d, "js_shell").select("page_id", "js_shell")


def worst_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages to Markdown, scored; the 20 worst."""
    rows = extracted(spark, d, "md").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.col("md").alias("text"))
    return quality.worst(quality.quality_rows(rows)).select("path", "score", F.array_join("issues", ",").alias("issues"), "word_count")


def page_notes(spark: SparkSession, d: str) -> DataFrame:
    docs = extracted(spark, d, "md").withColumn("title", library.first_heading(F.col("md"), F.col("url")))
    return formatted_digest(formats.formatted(docs, "obsidian", "2024-01-01", ["strip_blank_runs"]))


def formatted_digest(docs: DataFrame) -> DataFrame:
    return docs.select("page_id", "title", F.length("body").alias("n"), F.md5("body").alias("body_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = recipes.QUERIES | {
    f.__name__: f
    for f in (
        url_parts, same_origin_pairs, list_pages, discovery_controls, url_buckets, heading_clamp, heading_demotion, same_title_merge, merged_titles, alt_echoes, alt_echo_texts,
        fenced_spaces, skipped_sections, skipped_texts, repeated_blocks, repeated_block_texts, empty_sections, heading_issues, quality_scores, worst_documents, site_summary, quality_verdict, line_metrics,
        library_documents, library_index, library_summary, baseline_changes, baseline_refresh, quality_regressions, exact_duplicates, file_names, lost_tokens,
        html_link_counts, page_markdown, page_fingerprints, page_specs, page_shells, worst_pages, page_notes,
    )
}

MD = r"""WITH l0 AS (
  SELECT doc_id AS doc, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS raw
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), UNNEST(range(1, len(parts) + 1)) AS t(i)),
m AS (SELECT doc, pos, CASE WHEN pos % 3 = 0 THEN repeat('#', CAST(1 + (doc + 5 * pos) % 6 AS INTEGER)) || ' ' || raw ELSE raw END AS line FROM l0),
"""
WS = r"'^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$'"
HEADS = rf"""h AS (
  SELECT doc, pos, line, CASE WHEN mark <> '' THEN CAST(length(mark) AS INTEGER) END AS level, CASE WHEN mark <> '' THEN title END AS title, s FROM (
    SELECT *, regexp_extract(s, '^(#{{1,6}})[ \t]+(.+)$', 1) AS mark, trim(regexp_extract(s, '^(#{{1,6}})[ \t]+(.+)$', 2)) AS title
    FROM (SELECT *, regexp_replace(line, {WS}, '', 'g') AS s FROM m))),
"""
PATHS = """paths AS (
  SELECT m.doc, d.source || '/' || d.lang || '/d' || d.doc_id || '.md' AS path, string_agg(m.line, chr(10) ORDER BY pos) AS text
  FROM m JOIN documents d ON d.doc_id = m.doc GROUP BY m.doc, d.source, d.lang, d.doc_id),
"""
EMPTY = """e AS (
  SELECT a.doc, a.pos, a.level, a.title FROM h a
  LEFT JOIN LATERAL (SELECT min(b.pos) AS at FROM h b WHERE b.doc = a.doc AND b.pos > a.pos AND b.s <> '' AND NOT regexp_matches(b.s, '^#{1,6}[ \t]+')) t ON true
  LEFT JOIN LATERAL (SELECT min(c.pos) AS at FROM h c WHERE c.doc = a.doc AND c.pos > a.pos AND regexp_matches(c.s, '^#{1,6}[ \t]+')
    AND length(regexp_extract(c.s, '^(#{1,6})', 1)) < a.level) u ON true
  WHERE a.level IS NOT NULL AND (t.at IS NULL OR t.at > u.at)),
"""
ISSUES = """g AS (SELECT doc, pos, length(regexp_extract(s, '^(#{1,6})', 1)) AS lv, trim(regexp_extract(s, '^(#{1,6})[ \t]*(.*)', 2)) AS t FROM h WHERE starts_with(s, '#')),
g2 AS (SELECT *, lag(lv) OVER (PARTITION BY doc ORDER BY pos) AS prev FROM g),
i AS (
  SELECT doc, pos, 1 AS k, 'empty-heading:L' || (pos + 1) AS issue FROM g2 WHERE t = ''
  UNION ALL SELECT doc, pos, 2, 'heading-jump:L' || (pos + 1) || ':' || prev || '->' || lv FROM g2 WHERE lv > prev + 1),
"""
SCORES = (
    EMPTY + ISSUES + PATHS
    + """st AS (
  SELECT doc, list(issue ORDER BY kind, pos, issue) AS structure FROM (
    SELECT doc, 1 AS kind, pos, issue FROM i UNION ALL SELECT doc, 2, pos, 'empty-section:' || left(title, 30) FROM e) GROUP BY doc),
q0 AS (
  SELECT p.path, coalesce(st.structure, []::VARCHAR[]) AS structure, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS words,
         len(regexp_extract_all(text, '(?m)^#{1,6}[ \\t\\n\\x0B\\f\\r]+')) AS heads, len(regexp_extract_all(text, '!\\[[^\\]]*\\]\\([^)]+\\)')) AS imgs,
         contains(text, '<div') OR contains(text, '<span') AS raw, list_filter(['产品资讯', '其他产品', '正在加载', '请稍候', '显示更多'], lambda k: contains(text, k)) AS dirt
  FROM paths p LEFT JOIN st USING (doc)),
q AS (
  SELECT path, CAST(greatest(0, 100 - least(30, 10 * len(structure)) - CASE WHEN words < 120 THEN 30 ELSE 0 END - CASE WHEN imgs = 0 THEN 10 ELSE 0 END
           - least(20, 8 * len(dirt) + CASE WHEN raw THEN 10 ELSE 0 END)) AS INTEGER) AS score,
         list_concat(list_concat(structure, CASE WHEN imgs = 0 THEN ['no-image'] ELSE []::VARCHAR[] END),
           list_concat(list_concat(list_transform(dirt, lambda k: 'pollution:' || k), CASE WHEN raw THEN ['raw-html'] ELSE []::VARCHAR[] END), CASE WHEN words < 120 THEN ['too-short'] ELSE []::VARCHAR[] END)) AS issues,
         CAST(words AS INTEGER) AS word_count, CAST(heads AS INTEGER) AS heading_count, CAST(imgs AS INTEGER) AS image_count, 0 AS resource_count
  FROM q0),
"""
)
LIBRARY = (
    PATHS
    + r"""b AS (SELECT doc, first(regexp_replace(line, '^[ \t]+|[ \t]+$', '', 'g') ORDER BY pos) AS brief FROM h
  WHERE length(s) >= 15 AND NOT regexp_matches(s, '^[#!>|-]') GROUP BY doc),
lib AS (
  SELECT p.path, coalesce((SELECT arg_min(title, pos) FROM h WHERE h.doc = p.doc AND level IS NOT NULL AND starts_with(line, '#')), 'd' || p.doc) AS title,
         CASE split_part(path, '/', 1) WHEN 'src0' THEN 'product' WHEN 'src1' THEN 'solution' WHEN 'src2' THEN 'industry' ELSE 'other' END AS section,
         split_part(path, '/', 2) AS category, coalesce(left(b.brief, 140), '') AS brief,
         CAST(len(regexp_extract_all(text, '(?m)^#{1,6}[ \t\n\x0B\f\r]+')) AS INTEGER) AS headings
  FROM paths p LEFT JOIN b USING (doc)),
"""
)
METRICS = r"""
  {h}, CAST(len(list_filter(string_split(text, chr(10)), lambda s: starts_with(trim(s), '|') AND ends_with(trim(s), '|'))) AS INTEGER) AS table_rows,
  CAST(len(list_filter(string_split(text, chr(10)), lambda s: starts_with(trim(s), '|') AND ends_with(trim(s), '|') AND regexp_matches(s, '^[ \t|]*$'))) AS INTEGER) AS empty_table_headers,
  CAST(len(regexp_extract_all(text, '!\[[^\n]*?\]\([^h\n][^t\n][^\n]*?\)')) AS INTEGER) AS images_local, CAST(len(regexp_extract_all(text, '!\[[^\n]*?\]\(https?://')) AS INTEGER) AS images_remote,
  CAST(len(regexp_extract_all(text, '\[\[[^\n]+?\]\]')) AS INTEGER) AS wiki_links, CAST(len(regexp_extract_all(text, '\[[^\n]*?\]\([^\n]*?\)')) AS INTEGER) AS link_count,
  0 AS noise_count, CAST(length(replace(replace(text, chr(10), ''), ' ', '')) AS INTEGER) AS word_count, CAST(length(text) AS INTEGER) AS char_count,
  CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(text, chr(10))) AS INTEGER) END AS lines
""".replace("{h}", ", ".join(f"CAST(len(regexp_extract_all(text, '(?m)^#{{{n}}} ')) AS INTEGER) AS h{n}" for n in range(1, 7)))
URL_LIST = r"(?i)/reports?/?$|/research/?$|/insights?/?$|/resources?/?$|/list/?$|/index\.html?$|/whitepapers?/?$|\?page=[0-9]+"
IS_LIST = rf"(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') <> '' AND regexp_matches(url, '{URL_LIST}'))"
SLUG = r"string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')[-1]"
HOST = r"lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#]+)', 1))"
SCHEME = r"lower(regexp_extract({0}, '^([a-zA-Z]+)://', 1))"

ORACLES: dict[str, str] = recipes.ORACLES | {
    "page_fingerprints": recipes.PAGE_TEXT,
    "page_shells": r"""WITH b AS (SELECT page_id, length(html) AS n, len(regexp_extract_all(html, '<script')) AS scripts, contains(html, '<body') AS has,
          regexp_replace(regexp_replace(regexp_extract(html, '<body[^>]*>(.*)', 1, 's'), '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>', chr(1), 'gs') AS t FROM pages),
        c AS (SELECT *, list_sum(list_transform(string_split(t, chr(1)), lambda x: length(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')))) AS letters FROM b)
        SELECT page_id, n < 500 OR NOT has OR letters < 500 OR (scripts > 10 AND letters < 2000) AS js_shell FROM c""",
    "html_link_counts": r"""WITH a AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)
        SELECT page_id, len(t) AS n, CAST(coalesce(list_sum(list_transform(t, lambda x: length(trim(replace(replace(replace(x, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'))))), 0) AS BIGINT) AS letters FROM a""",
    "page_specs": """SELECT page_id, 'Auto' AS layer, CAST(o AS INTEGER) AS ord, k, v FROM (
        SELECT page_id, 0 AS o, 'Page' AS k, CAST(page_id AS VARCHAR) AS v FROM pages UNION ALL SELECT page_id, 1, 'Size', CAST(length(url) AS VARCHAR) FROM pages
        UNION ALL SELECT page_id, 2, 'Kind', 'page' FROM pages)""",

    "url_parts": f"SELECT page_id, {SCHEME.format('url')} AS scheme, {HOST.format('url')} AS host, {SLUG} AS slug, {IS_LIST} AS is_list, md5(lower(url)) AS url_md5 FROM pages",
    "same_origin_pairs": f"""SELECT a.page_id, {SCHEME.format('a.url')} IN ('http', 'https') AND {SCHEME.format('a.url')} = {SCHEME.format('b.url')}
        AND {HOST.format('a.url')} = {HOST.format('b.url')} AS same FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""",
    "list_pages": f"SELECT page_id, {IS_LIST} AS is_list FROM pages WHERE {IS_LIST} OR contains(url, '.html')",
    "discovery_controls": r"""SELECT page_id AS ord, url FROM pages WHERE regexp_matches('product ' || url || ' ' || url, '^product .*https')
        AND NOT regexp_matches(url, 'utm_') AND NOT regexp_matches(url, '\?page=') ORDER BY page_id LIMIT 40""",
    "url_buckets": """SELECT CASE WHEN s <> '' THEN s ELSE 'All' END AS slug, count(*) AS n, string_agg(url, ' ' ORDER BY url) AS urls
        FROM (SELECT url, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS s FROM pages) GROUP BY 1""",
    "heading_clamp": MD + HEADS + """n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM h WHERE level IS NOT NULL),
        o AS (SELECT *, CAST(k + min(level - k) OVER (PARTITION BY doc ORDER BY pos) AS INTEGER) AS out_level FROM n)
        SELECT doc, pos, level, out_level, md5(repeat('#', out_level) || ' ' || title) AS line_md5 FROM o""",
    "heading_demotion": MD + HEADS + """n AS (SELECT *, length(title) <= 24 AND (contains(title, 'the') OR contains(title, 'of') OR contains(title, 'de')) AS sub FROM h WHERE level IS NOT NULL),
        o AS (SELECT *, last_value(CASE WHEN NOT sub THEN level END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM n)
        SELECT doc, pos, level, CASE WHEN sub AND level <= last THEN least(last + 1, 6) ELSE level END AS out_level FROM o""",
    "same_title_merge": MD + """t AS (SELECT doc, CAST(pos / 3 AS INTEGER) AS pos, length(regexp_extract(line, '^(#+) .*$', 1)) AS level FROM m WHERE pos % 3 = 0),
        n AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY pos) - 1) // 2 AS pair FROM t),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc, pair ORDER BY level, pos) AS r FROM n)
        SELECT doc, pos, CAST(level AS INTEGER) AS level FROM o WHERE r = 1""",
    "merged_titles": MD + """t AS (SELECT doc, pos, length(regexp_extract(line, '^(#+) .*$', 1)) AS level FROM m WHERE pos % 3 = 0),
        n AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY pos) - 1) // 2 AS pair FROM t),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc, pair ORDER BY level, pos) AS r FROM n)
        SELECT doc, CAST(count(*) AS INTEGER) AS n, md5(string_agg(repeat('#', CAST(level AS INTEGER)) || ' t', chr(10) ORDER BY pos)) AS text_md5 FROM o WHERE r = 1 GROUP BY doc""",
    "alt_echo_texts": MD + """a AS (SELECT doc, pos, CASE pos % 3 WHEN 0 THEN '![t' || pos // 3 || 'x](u)' WHEN 2 THEN 't' || pos // 3 END AS line FROM m)
        SELECT doc, CAST(count(*) AS INTEGER) AS n, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM a WHERE line IS NOT NULL GROUP BY doc""",
    "alt_echoes": MD + """a AS (SELECT doc, pos, CASE WHEN pos % 2 = 0 THEN '![a](x)' WHEN length(regexp_extract(line, '([A-Za-z]+)', 1)) % 2 = 0 THEN 'a' ELSE line END AS line FROM m)
        SELECT doc, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM a WHERE NOT (pos % 2 = 1 AND line = 'a') GROUP BY doc""",
    "fenced_spaces": MD + """f AS (SELECT doc, pos, CASE WHEN pos % 5 = 2 THEN '``` x' ELSE replace(line, 'e', chr(160)) END AS line FROM m),
        g AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS fences FROM f)
        SELECT doc, pos, md5(CASE WHEN fences % 2 = 1 OR starts_with(line, '```') THEN line ELSE replace(line, chr(160), ' ') END) AS line_md5 FROM g""",
    "skipped_sections": MD.rstrip().replace("m AS (", "m0 AS (") + """
        m AS (SELECT doc, pos, CASE WHEN pos % 9 = 3 THEN regexp_replace(line, '^(#+) .*$', '\\1 Watch') ELSE line END AS line FROM m0),
        """ + HEADS + """w AS (SELECT *, coalesce(level IS NOT NULL AND (title IN ('Watch', 'Listen', 'Read') OR ends_with(title, '资源')), false) AS hit FROM h),
        k AS (SELECT w.*, (SELECT max(v.pos) FROM w v WHERE v.doc = w.doc AND v.hit AND v.pos <= w.pos) AS from_pos FROM w),
        x AS (SELECT k.*, (SELECT level FROM w v WHERE v.doc = k.doc AND v.pos = k.from_pos) AS at FROM k)
        SELECT doc, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM x WHERE NOT hit AND (from_pos IS NULL
          OR EXISTS (SELECT 1 FROM w v WHERE v.doc = x.doc AND v.pos > x.from_pos AND v.pos <= x.pos AND v.level <= x.at)) GROUP BY doc""",
    "skipped_texts": MD.rstrip().replace("m AS (", "m0 AS (") + """
        m AS (SELECT doc, pos, CASE WHEN pos % 9 = 3 THEN regexp_replace(line, '^(#+) .*$', '\\1 Watch') ELSE line END AS line FROM m0),
        """ + HEADS + """w AS (SELECT *, coalesce(level IS NOT NULL AND (title IN ('Watch', 'Listen', 'Read') OR ends_with(title, '资源')), false) AS hit FROM h),
        k AS (SELECT w.*, (SELECT max(v.pos) FROM w v WHERE v.doc = w.doc AND v.hit AND v.pos <= w.pos) AS from_pos FROM w),
        x AS (SELECT k.*, (SELECT level FROM w v WHERE v.doc = k.doc AND v.pos = k.from_pos) AS at FROM k),
        y AS (SELECT doc, string_agg(line, chr(10) ORDER BY pos) AS t FROM x WHERE NOT hit AND (from_pos IS NULL
          OR EXISTS (SELECT 1 FROM w v WHERE v.doc = x.doc AND v.pos > x.from_pos AND v.pos <= x.pos AND v.level <= x.at)) GROUP BY doc),
        z AS (SELECT d.doc_id AS doc, regexp_replace(regexp_replace(coalesce(t, ''), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') AS t FROM documents d LEFT JOIN y ON y.doc = d.doc_id)
        SELECT doc, CAST(len(string_split(t, chr(10))) AS INTEGER) AS n, md5(t) AS text_md5 FROM z""",
    "repeated_blocks": rf"""WITH p AS (SELECT doc_id AS doc, string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10) || chr(10), 'g'), chr(10)) AS parts FROM documents),
        l AS (SELECT doc, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(parts[i], {WS}, '', 'g') AS s FROM p, UNNEST(range(1, len(parts) + 1)) AS t(i)),
        r AS (SELECT *, sum(CASE WHEN s = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS run FROM l),
        k AS (SELECT doc, run, string_agg(s, chr(10) ORDER BY pos) AS key FROM r WHERE s <> '' GROUP BY doc, run),
        f AS (SELECT doc, run, row_number() OVER (PARTITION BY doc, key ORDER BY run) AS n FROM k)
        SELECT r.doc, count(*) AS n, CAST(sum(r.pos) AS BIGINT) AS places FROM r LEFT JOIN f USING (doc, run) WHERE r.s = '' OR f.n = 1 GROUP BY r.doc""",
    "repeated_block_texts": rf"""WITH p AS (SELECT doc_id AS doc, string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10) || chr(10), 'g'), chr(10)) AS parts FROM documents),
        l AS (SELECT doc, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(parts[i], {WS}, '', 'g') AS s FROM p, UNNEST(range(1, len(parts) + 1)) AS t(i)),
        r AS (SELECT *, sum(CASE WHEN s = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS run FROM l),
        k AS (SELECT doc, run, string_agg(s, chr(10) ORDER BY pos) AS key FROM r WHERE s <> '' GROUP BY doc, run),
        f AS (SELECT doc, run, row_number() OVER (PARTITION BY doc, key ORDER BY run) AS n FROM k)
        SELECT d.doc_id AS doc, CAST(count(r.s) AS INTEGER) AS n, md5(coalesce(string_agg(r.s, chr(10) ORDER BY r.pos), '')) AS kept_md5
        FROM documents d LEFT JOIN (SELECT r.* FROM r JOIN f USING (doc, run) WHERE r.s <> '' AND f.n = 1) r ON r.doc = d.doc_id GROUP BY d.doc_id""",
    "empty_sections": MD.rstrip().replace("m AS (", "m0 AS (") + "\nm AS (SELECT doc, pos, CASE WHEN pos % 3 <> 1 OR doc % 2 = 0 THEN line ELSE '' END AS line FROM m0),\n" + HEADS + EMPTY.rstrip().rstrip(",") + "\nSELECT doc, pos, level, md5(title) AS title_md5 FROM e",
    "heading_issues": MD + HEADS + ISSUES.rstrip().rstrip(",") + "\nSELECT doc, issue FROM i",
    "quality_scores": MD + HEADS + SCORES.rstrip().rstrip(",") + "\nSELECT path, score, md5(array_to_string(issues, ',')) AS issues_md5, word_count, heading_count, image_count, resource_count FROM q",
    "worst_documents": MD + HEADS + SCORES.rstrip().rstrip(",") + "\nSELECT path, score, word_count FROM q ORDER BY score, path LIMIT 20",
    "site_summary": MD + HEADS + SCORES.rstrip().rstrip(",") + """
        SELECT round_even(avg(score), 1) AS site_score, count(*) AS files_scored, bool_or(len(list_filter(issues, lambda i: contains(i, 'broken-image'))) > 0) AS broken_image,
        bool_or(len(list_filter(issues, lambda i: contains(i, 'broken-resource'))) > 0) AS broken_resource FROM q""",
    "quality_verdict": MD + HEADS + SCORES.rstrip().rstrip(",") + """,
        v AS (SELECT list_filter([CASE WHEN count(*) = 0 THEN 'no-files-scored' END, CASE WHEN round_even(avg(score), 1) < 70 THEN 'site-score-below-70' END,
          CASE WHEN bool_or(len(list_filter(issues, lambda i: contains(i, 'broken-image'))) > 0) THEN 'broken-image' END,
          CASE WHEN bool_or(len(list_filter(issues, lambda i: contains(i, 'broken-resource'))) > 0) THEN 'broken-resource' END, 'missing-expected-specs'], lambda x: x IS NOT NULL) AS r FROM q)
        SELECT len(r) = 0 AS ok, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 'approve_full_run' WHEN list_contains(r, 'no-files-scored') THEN 'fix_discovery_or_selectors'
          ELSE 'fix_config_and_rerun_sample' END AS next_action FROM v""",
    "line_metrics": MD + PATHS.rstrip().rstrip(",") + f"\nSELECT path, {METRICS} FROM paths",
    "library_documents": MD + HEADS + LIBRARY.rstrip().rstrip(",") + "\nSELECT path, md5(title) AS title_md5, section, category, md5(brief) AS brief_md5, headings FROM lib",
    "library_index": MD + HEADS + LIBRARY.rstrip().rstrip(",") + """
        SELECT section, category, count(*) AS docs, md5(string_agg('- [' || title || '](' || path || ')' || CASE WHEN brief <> '' THEN ' - ' || brief ELSE '' END, chr(10) ORDER BY title, path)) AS entries_md5
        FROM lib GROUP BY section, category""",
    "library_summary": """WITH l AS (SELECT CASE source WHEN 'src0' THEN 'product' WHEN 'src1' THEN 'solution' WHEN 'src2' THEN 'industry' ELSE 'other' END AS section, lang AS category FROM documents)
        SELECT section, category, count(*) AS docs_in_section, (SELECT count(*) FROM l b WHERE b.category = a.category) AS docs_of_category FROM l a GROUP BY section, category""",
    "baseline_changes": """WITH o AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN md5('old') ELSE md5(html) END AS fp FROM pages WHERE page_id % 3 <> 0
          UNION ALL SELECT page_id + 1000000, md5(html) FROM pages WHERE page_id % 21 = 0),
        j AS (SELECT CAST(coalesce(n.page_id, o.page_id) AS VARCHAR) AS id, CASE WHEN n.page_id IS NULL THEN 'deleted' WHEN o.page_id IS NULL THEN 'new' WHEN md5(n.html) <> o.fp THEN 'changed' END AS change_type
              FROM pages n FULL JOIN o ON n.page_id = o.page_id)
        SELECT 'product' AS kind, id, change_type FROM j WHERE change_type IS NOT NULL""",
    "baseline_refresh": """SELECT CAST(page_id AS VARCHAR) AS id, md5(html) AS fp FROM pages UNION ALL SELECT CAST(page_id + 1000000 AS VARCHAR), md5(url) FROM pages WHERE page_id % 21 = 0""",
    "quality_regressions": MD + PATHS + f"""w AS (SELECT path, {METRICS} FROM (SELECT path, CASE WHEN doc % 4 = 0 THEN text || chr(10) || '## more' || chr(10) || '[[a]] ' || text ELSE text END AS text FROM paths WHERE doc % 13 <> 0
            UNION ALL SELECT 'gone/' || path, text FROM paths WHERE doc % 11 = 0)),
        n AS (SELECT path, {METRICS} FROM paths),
        j AS (SELECT coalesce(n.path, w.path) AS path, n.path IS NULL AS gone, w.path IS NULL AS fresh, array_to_string(list_filter([
            CASE WHEN n.h1 < w.h1 THEN 'h1: ' || w.h1 || '→' || n.h1 END, CASE WHEN n.h2 < w.h2 THEN 'h2: ' || w.h2 || '→' || n.h2 END, CASE WHEN n.h3 < w.h3 THEN 'h3: ' || w.h3 || '→' || n.h3 END,
            CASE WHEN n.table_rows < w.table_rows * 0.8 THEN 'table_rows: ' || w.table_rows || '→' || n.table_rows END,
            CASE WHEN n.wiki_links < w.wiki_links THEN 'wiki_links: ' || w.wiki_links || '→' || n.wiki_links END,
            CASE WHEN n.word_count < w.word_count * 0.7 THEN 'word_count: ' || w.word_count || '→' || n.word_count END], lambda x: x IS NOT NULL), ',') AS issues
          FROM n FULL JOIN w ON n.path = w.path)
        SELECT path, CASE WHEN fresh THEN 'new' WHEN gone THEN 'missing' WHEN issues <> '' THEN 'regression' ELSE 'same' END AS status, CASE WHEN fresh OR gone THEN '' ELSE issues END AS issues FROM j""",
    "exact_duplicates": r"""SELECT fp, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, md5(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS fp FROM documents) GROUP BY fp HAVING count(*) > 1""",
    "file_names": rf"""SELECT page_id, left(regexp_replace(rtrim(replace(regexp_replace(url, '[\x00-\x1f\\/*?:"<>|]', '_', 'g'), ' ', '_')), '[. ]+$', ''), 200) AS name,
        regexp_matches({SLUG}, '^[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}$') AS is_id,
        array_to_string(list_transform(regexp_extract_all(lower(trim(replace(replace(regexp_replace({SLUG}, '\.(html?|php|aspx?|jsp)$', ''), '-', ' '), '_', ' '))), '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '') AS title FROM pages""",
    "lost_tokens": r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[^\s\x0B]+')) AS a, list_distinct(regexp_extract_all(left(text, CAST(floor(length(text) / 2) AS INTEGER)), '[^\s\x0B]+')) AS b FROM documents)
        SELECT doc_id, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(a, lambda x: NOT list_contains(b, x)))::DOUBLE / len(a), 6) END AS lost FROM t""",
}
