"""Quality of Markdown documents: issues, scores, reports, verdicts, metrics and regressions, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WORDS, count_of, images, links
from .rules import structure_issues

POLLUTION = ("产品资讯", "其他产品", "正在加载", "请稍候", "显示更多")
NOISE = ("更多信息", "联系我们", "在线留言", "申请试用", "视频 0")
SKIPPED = ("README.md", "全库索引.md", "全库摘要.md", "清单索引.md", "_deep_discovery_audit.md", "_quality_report.md", "_config_validation.md")


def _local(refs: Column, *folders: str) -> Column:
    def inside(r: Column) -> Column:
        out = F.lit(False)
        for f in folders:
            out |= r.startswith(f)
        return out

    return F.filter(refs, inside)


def quality_rows(docs: DataFrame, files: DataFrame | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """(path, score, issues, word_count, heading_count, image_count, resource_count), one row for each path.

    ``files`` (path) lists what exists beside the documents; references that aren't in it count as broken. Without it none
    is checked.
    """
    base = docs.select(F.col(path).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # within the row: no text is taken apart into lines and shuffled
    structure = structure_issues(F.regexp_replace("text", "\r\n?|\n$", "\n")).alias("structure")
    refs = base.select("doc", "text", images("text").alias("imgs"), links("text").alias("refs"), structure)
    x = refs.withColumn("local_imgs", _local(F.col("imgs"), "图片/")).withColumn("local_refs", _local(F.col("refs"), "资料/", "../资料/"))
    if files is None:
        x = x.withColumn("lost_imgs", F.lit(0)).withColumn("lost_refs", F.lit(0))
    else:
        x = _broken(_broken(x, files, "local_imgs", "lost_imgs"), files, "local_refs", "lost_refs")
    polluted = F.filter(F.array(*[F.lit(k) for k in POLLUTION]), lambda k: F.contains(F.col("text"), k))
    x = x.withColumn("polluted", polluted).withColumn("raw", F.col("text").contains("<div") | F.col("text").contains("<span"))
    x = x.withColumn("word_count", count_of("text", WORDS)).withColumn("heading_count", count_of("text", r"(?m)^#{1,6}\s+"))
    short, n_img = F.col("word_count") < 120, F.size("imgs")
    tell = lambda when, say: F.when(when, say)
    issues = F.concat(
        "structure",
        F.array_compact(F.array(
            tell(F.col("lost_imgs") > 0, F.concat(F.lit("broken-image x"), "lost_imgs")), tell(n_img == 0, F.lit("no-image")),
            tell(F.col("lost_refs") > 0, F.concat(F.lit("broken-resource x"), "lost_refs")),
        )),
        F.transform("polluted", lambda k: F.concat(F.lit("pollution:"), k)),
        F.array_compact(F.array(tell(F.col("raw"), F.lit("raw-html")), tell(short, F.lit("too-short")))),
    )
    image_faults = (F.col("lost_imgs") > 0).cast("int") + (n_img == 0).cast("int")
    score = (
        100 - F.least(F.lit(30), 10 * F.size("structure")) - F.when(short, 30).otherwise(0) - F.least(F.lit(20), 10 * image_faults)
        - F.least(F.lit(20), 8 * F.size("polluted") + 10 * F.col("raw").cast("int"))
    )
    return x.select(
        F.col("doc").alias("path"), F.greatest(F.lit(0), score).cast("int").alias("score"), issues.alias("issues"), "word_count", "heading_count",
        n_img.alias("image_count"), F.size("local_refs").alias("resource_count"),
    )


def _broken(x: DataFrame, files: DataFrame, refs: str, out: str) -> DataFrame:
    """Counts distinct references, resolved beside the document, that aren't files."""
    one = x.select("doc", F.explode(F.array_distinct(refs)).alias("ref"))
    folder = F.regexp_extract("doc", "^(.*/)?[^/]*$", 1)
    full = F.regexp_replace(F.concat(folder, "ref"), r"[^/]+/\.\./", "")
    missing = one.withColumn("full", full).join(files.select(F.col("path").alias("full")).distinct(), "full", "left_anti")
    counted = missing.groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias(out))
    return x.join(counted, "doc", "left").withColumn(out, F.coalesce(out, F.lit(0)))


def worst(rows: DataFrame, n: int = 20) -> DataFrame:
    """The lowest scores; equal ones by path."""
    return rows.orderBy("score", "path").limit(n)


def site_summary(rows: DataFrame) -> DataFrame:
    """(site_score, files_scored, broken_images, broken_resources) in one row."""
    has = lambda kind: F.coalesce(F.bool_or(F.exists("issues", lambda i: i.contains(kind))), F.lit(False))
    return rows.agg(
        F.coalesce(F.bround(F.avg("score"), 1), F.lit(0.0)).alias("site_score"), F.count(F.lit(1)).alias("files_scored"),
        has("broken-image").alias("broken_image"), has("broken-resource").alias("broken_resource"),
    )


def verdict(summary: DataFrame, expect_specs: bool = False, expect_resources: bool = False, specs: int = 0, resources: int = 0) -> DataFrame:
    """(ok, reasons, next_action) of a summary."""
    say = lambda when, what: F.when(when, F.lit(what))
    reasons = F.array_compact(F.array(
        say(F.col("files_scored") <= 0, "no-files-scored"), say(F.col("site_score") < 70, "site-score-below-70"),
        say(F.col("broken_image"), "broken-image"), say(F.col("broken_resource"), "broken-resource"),
        say(F.lit(expect_specs and specs <= 0), "missing-expected-specs"), say(F.lit(expect_resources and resources <= 0), "missing-expected-resources"),
    ))
    step = F.when(F.size("reasons") == 0, "approve_full_run").when(F.array_contains("reasons", "no-files-scored"), "fix_discovery_or_selectors")
    return summary.select(reasons.alias("reasons")).select((F.size("reasons") == 0).alias("ok"), "reasons", step.otherwise("fix_config_and_rerun_sample").alias("next_action"))


def metrics(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Structural metrics of each document in one pass over its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    heads = [count_of(t, rf"(?m)^#{{{n}}} ").alias(f"h{n}") for n in range(1, 7)]
    line = F.split(t, "\n", -1)
    rows = F.filter(line, lambda s: F.trim(s).startswith("|") & F.trim(s).endswith("|"))
    return docs.select(
        F.col(path).alias("path"), *heads, F.size(rows).alias("table_rows"),
        F.size(F.filter(rows, lambda s: s.rlike(r"^[\s|]*$"))).alias("empty_table_headers"),
        count_of(t, r"!\[[^\n]*?\]\([^h\n][^t\n][^\n]*?\)").alias("images_local"), count_of(t, r"!\[[^\n]*?\]\(https?://").alias("images_remote"),
        count_of(t, r"\[\[[^\n]+?\]\]").alias("wiki_links"), count_of(t, r"\[[^\n]*?\]\([^\n]*?\)").alias("link_count"),
        F.size(F.filter(F.array(*[F.lit(k) for k in NOISE]), lambda k: F.contains(t, k))).alias("noise_count"),
        F.length(F.translate(t, "\n ", "")).alias("word_count"), F.length(t).alias("char_count"), F.when(t == "", 0).otherwise(F.size(line)).alias("lines"),
    )


def regressions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, status, issues) of two tables of metrics: new, missing, regression, improvement or same."""
    c, p = current.alias("c"), previous.alias("p")
    both = c.join(p, "path", "full")
    now, was = (lambda k: F.col(f"c.{k}")), (lambda k: F.col(f"p.{k}"))
    change = lambda name, k, bad: F.when(bad, F.concat(F.lit(f"{name}: "), was(k), F.lit("→"), now(k)))
    fewer, more = (lambda k: now(k) < was(k)), (lambda k: now(k) > was(k))
    issues = F.array_compact(F.array(
        *[change(h, h, fewer(h)) for h in ("h1", "h2", "h3")],
        change("table_rows", "table_rows", now("table_rows") < was("table_rows") * 0.8), change("empty_headers", "empty_table_headers", more("empty_table_headers")),
        change("local_images", "images_local", fewer("images_local")), change("remote_images", "images_remote", more("images_remote")),
        change("wiki_links", "wiki_links", fewer("wiki_links")), change("noise", "noise_count", more("noise_count")),
        change("word_count", "word_count", now("word_count") < was("word_count") * 0.7),
    ))
    better = more("images_local") | more("wiki_links") | fewer("noise_count")
    status = (
        F.when(was("lines").isNull(), "new").when(now("lines").isNull(), "missing").when(F.size("issues") > 0, "regression")
        .when(better, "improvement").otherwise("same")
    )
    return both.withColumn("issues", issues).select("path", status.alias("status"), F.when(status == "regression", F.col("issues")).otherwise(F.array().cast("array<string>")).alias("issues"))


def regression_totals(changes: DataFrame) -> DataFrame:
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return changes.agg(
        is_("regression", "improvement", "same").alias("total_compared"), is_("regression").alias("regressions"), is_("improvement").alias("improvements"),
        is_("new").alias("new_items"), is_("missing").alias("missing_items"),
    )

