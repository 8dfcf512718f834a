"""Writing: pages as files or Parquet, sidecars, reports, state. Files are written where rows are; the driver writes summaries only.

Tables, sidecars and reports go to any file system that Spark knows. Trees of files are for mounted folders that every executor sees;
elsewhere ``write_table`` keeps the same rows as Parquet.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.columns import safe_name


# Fixed values below, in what is written: names of folders and files, schemas, headings and fields of reports.


def page_path(kind: Column | str = "kind", category: Column | str = "category", name: Column | str = "name", products: str = "产品", industries: str = "行业", suffix: str = "md") -> Column:
    """products/category/name/name.md; industries have no category."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    n = safe_name(col(name))
    file = F.concat(n, F.lit(f".{suffix}"))
    return F.when(col(kind) == "industry", F.concat_ws("/", F.lit(industries), n, file)).otherwise(F.concat_ws("/", F.lit(products), safe_name(col(category)), n, file))


class TreeSink(DataSource):
    """``df.select("path", "body").write.format("weft_tree").mode("append").save(root)``: one file a row, each whole or not at all.

    ``root`` is a mounted folder that every executor sees. A retried task writes the same files again.
    """

    @classmethod
    def name(cls) -> str:
        return "weft_tree"

    def schema(self) -> str:
        return "path string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TreeWriter(self.options["path"])


class _Written(WriterCommitMessage):
    pass


class _TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = os.path.normpath("/" + root.split(":", 1)[-1].lstrip("/"))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        for row in iterator:
            target = os.path.normpath(os.path.join(self.root, row["path"]))
            if not target.startswith(self.root + os.sep):
                raise ValueError(f"outside of the output folder: {row['path']}")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            replace_file(target, row[1] or "")
        return _Written()


class FileSink(TreeSink):
    """The same for files: ``df.select("path", "content")`` with binary contents."""

    @classmethod
    def name(cls) -> str:
        return "weft_files"

    def schema(self) -> str:
        return "path string, content binary"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSink)
    spark.dataSource.register(FileSink)


def write_table(docs: DataFrame, path: str) -> None:
    """Documents as Parquet, by kind and category, on any file system."""
    docs.write.mode("overwrite").partitionBy("kind", "category").parquet(path)


def replace_file(path: str | Path, text: str | bytes) -> None:
    """Written beside the target, flushed, then moved over it; on failure the target stays as it was."""
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    try:
        with open(tmp, "wb") as f:
            f.write(text.encode("utf-8") if isinstance(text, str) else bytes(text))
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise


def _hadoop(spark: SparkSession, path: str):
    """The path's file system and a maker of its paths."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def state_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A state table that ``replace_table`` writes, or None. A replacement that was broken off between its two renames is finished first."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p(path)):
        listed = lambda kind: sorted(x.getPath().toString() for x in (fs.globStatus(p(f"{path}.{kind}-*")) or ()))
        old, new = listed("old"), [x for x in listed("new") if fs.exists(p(f"{x}/_SUCCESS"))]
        if not old:
            return None  # never written, or never wholly
        fs.rename(p(new[-1] if new else old[-1]), p(path))
        for x in [*listed("old"), *listed("new")]:
            fs.delete(p(x), True)
    return spark.read.parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """A Parquet state table is written beside the old one and then takes its place; the old one may be among its sources.

    Only between two renames is there none at ``path``; ``state_table`` finishes what was broken off there.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:8]
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    df.write.parquet(new)
    fs, p = _hadoop(spark, path)
    had = fs.exists(p(path))
    if had:
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    if had:
        fs.delete(p(old), True)
    spark.catalog.refreshByPath(path)


def put_text(spark: SparkSession, path: str | Path, parts: Iterable[str]) -> None:
    """A text in parts, written beside the target on whatever file system its path names, then moved over it."""
    fs, p = _hadoop(spark, str(path))
    target, tmp = p(str(path)), p(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    fs.mkdirs(target.getParent())
    out = fs.create(tmp)
    try:
        for part in parts:
            out.write(bytearray(part.encode("utf-8")))
        out.close()
        fs.delete(target, False)
        fs.rename(tmp, target)
    except BaseException:
        out.close()
        fs.delete(tmp, False)
        raise


def spec_records(rows: DataFrame) -> DataFrame:
    """(page_id, title, rel_path, source, specs) of attributes (the same, ord, k, v), each key's first value."""
    keys = ["page_id", "title", "rel_path", "source"]
    one = rows.groupBy(*keys, "k").agg(F.min_by("v", "ord").alias("v"), F.min("ord").alias("ord"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("ord", "k", "v"))), lambda x: F.struct(x["k"], x["v"]))
    return one.groupBy(*keys).agg(F.map_from_entries(entries).alias("specs"))


def resource_records(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["page_id", "resource_rel_path"])


def spec_summary(records: DataFrame, files: int) -> DataFrame:
    """(pages_with_specs, total_specs, avg_specs_per_page, spec_coverage)."""
    pages, total = F.countDistinct("rel_path"), F.coalesce(F.sum(F.size("specs")), F.lit(0))
    return records.agg(pages.alias("pages_with_specs"), total.alias("total_specs")).withColumns({
        "avg_specs_per_page": F.when(F.col("pages_with_specs") > 0, F.bround(F.col("total_specs") / F.col("pages_with_specs"), 1)).otherwise(0.0),
        "spec_coverage": F.bround(F.col("pages_with_specs") / F.lit(files), 3) if files else F.lit(0.0),
    })


def resource_summary(records: DataFrame, files: int) -> DataFrame:
    """(pages_with_resources, total_resources, total_bytes, avg_resources_per_page, resource_coverage)."""
    base = records.agg(F.countDistinct("rel_path").alias("pages_with_resources"), F.count(F.lit(1)).alias("total_resources"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    return base.withColumns({
        "avg_resources_per_page": F.when(F.col("pages_with_resources") > 0, F.bround(F.col("total_resources") / F.col("pages_with_resources"), 1)).otherwise(0.0),
        "resource_coverage": F.bround(F.col("pages_with_resources") / F.lit(files), 3) if files else F.lit(0.0),
    })


def write_sidecar(records: DataFrame, root: str, kind: str, run_at: str) -> str | None:
    """``_meta/_specs.json`` or ``_meta/_resources.json``: the header, then the records, streamed from the partitions in turn."""
    n = records.count()
    if not n:
        return None
    summary = (spec_summary if kind == "specs" else resource_summary)(records, n).first().asDict()
    keep = ("pages_with_specs", "total_specs") if kind == "specs" else ("pages_with_resources", "total_resources", "total_bytes")
    head = {"schema": f"webextract-{kind}-v1", "run_at": run_at, **{k: summary[k] for k in keep}}
    path = f"{str(root).rstrip('/')}/_meta/_{kind}.json"
    rows = records.orderBy("rel_path", "page_id").select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()

    def parts() -> Iterator[str]:
        yield json.dumps(head, ensure_ascii=False, indent=2)[:-2] + ',\n  "records": [\n'
        yield from (("    " if i == 0 else ",\n    ") + r.j for i, r in enumerate(rows))
        yield "\n  ]\n}\n"

    put_text(records.sparkSession, path, parts())
    return path


def write_quality_report(rows: DataFrame, root: str, site: str, run_at: str, specs: dict | None = None, resources: dict | None = None, expect: tuple[bool, bool] = (False, False)) -> dict:
    """``_meta/_quality_report.json`` and ``_quality_report.md`` from the summary, the verdict and the worst files."""
    from ..operators import quality

    summary = quality.site_summary(rows)
    facts = summary.first()
    specs, resources = specs or {}, resources or {}
    v = quality.verdict(summary, *expect, specs.get("pages_with_specs", 0), resources.get("total_resources", 0)).first()
    low = [r.asDict() for r in quality.worst(rows).collect()]
    report = {
        "schema": "quality-report-v1", "site": site, "run_at": run_at, "site_score": facts.site_score, "files_total": facts.files_scored, "files_scored": facts.files_scored,
        "worst": low, "spec_summary": specs, "resource_summary": resources, "expectations": {"specs": expect[0], "resources": expect[1]},
        "agent_verdict": {"ok": v.ok, "reasons": list(v.reasons), "next_action": v.next_action},
    }
    spark, base = rows.sparkSession, str(root).rstrip("/")
    rows.write.mode("overwrite").json(f"{base}/_meta/_quality_files")
    put_text(spark, f"{base}/_meta/_quality_report.json", [json.dumps(report, ensure_ascii=False, indent=2)])
    text = ["# 质量报告", "", f"总体分数：{facts.site_score}", f"文件数：{facts.files_scored}", f"判定：{v.next_action}", "", "## 最差样本"]
    text += [f"- {r['score']} · `{r['path']}` · {', '.join(r['issues'][:6]) or '无'}" for r in low]
    put_text(spark, f"{base}/_quality_report.md", ["\n".join(text) + "\n"])
    return report


SECTIONS = (("product", "产品"), ("solution", "解决方案"), ("industry", "行业"))


def write_library(library: DataFrame, root: str, site: str, run_date: str, base_url: str = "", score: float | None = None) -> dict[str, str]:
    """README, index and summary of a library. The index is streamed: sorted entries arrive a partition at a time, no category is one row."""
    from ..operators.library import entries, summary

    spark, out = library.sparkSession, str(root).rstrip("/")
    counts = {(r.section, r.category): (r.docs_in_section, r.docs_of_category) for r in summary(library).orderBy("section", "category").toLocalIterator()}
    head = ["", f"> 自动生成 | {run_date}"]
    readme = [f"# {site} 资料库", *head, *(["", f"**来源**：{base_url}"] if base_url else []), "", "- [全库索引](全库索引.md)", "- [全库摘要](全库摘要.md)"]

    def index() -> Iterator[str]:
        yield "\n".join([f"# {site} 全库索引", *head]) + "\n"
        for section, title in (*SECTIONS, ("other", "其他")):
            own = any(sec == section for sec, _ in counts)
            if own or section != "other":
                yield f"\n## {title}\n"
            if not own and section != "other":
                yield f"\n暂无{title}文档\n"
            seen = None
            for r in entries(library.filter(F.col("section") == section)).toLocalIterator() if own else ():
                if r.category != seen and section != "other":
                    yield f"\n### {r.category}\n\n"
                seen = r.category
                yield r.entry + "\n"

    total = lambda s: sum(n for (sec, _), (n, _) in counts.items() if s in ("", sec))
    lines = [f"# {site} 全库摘要", *head, "", "## 统计", "", f"- 文档总数：{total('')}"]
    lines += [f"- {t}文档：{total(s)}" for s, t in SECTIONS] + [f"- {t}分类：{sum(sec == s for sec, _ in counts)}" for s, t in SECTIONS]
    lines += ["", "## 质量", "", f"- 质量分数：{score}" if score is not None else "- 质量报告：未生成"]
    for s, t in SECTIONS:
        own = [f"- {c}：{n}" for (sec, c), (_, n) in counts.items() if sec == s]
        lines += ["", f"## {t}分类", "", *own] if own or s == "product" else []
    names = {"readme": ("README.md", ["\n".join(readme) + "\n"]), "index": ("全库索引.md", index()), "summary": ("全库摘要.md", ["\n".join(lines) + "\n"])}
    for file, parts in names.values():
        put_text(spark, f"{out}/{file}", parts)
    return {k: f"{out}/{f}" for k, (f, _) in names.items()}


def write_validation_report(report: dict, root: str) -> tuple[str, str]:
    os.makedirs(root, exist_ok=True)
    a, b = str(Path(root, "_config_validation.json")), str(Path(root, "_config_validation.md"))
    replace_file(a, json.dumps(report, ensure_ascii=False, indent=2))
    lines = ["# 配置验证报告", "", f"站点：{report['site']}", f"建议数：{len(report['suggestions'])}", ""]
    replace_file(b, "\n".join([*lines, *(f"- {s['severity']} · {s['rule']} · {s['message']}" for s in report["suggestions"])]) + "\n")
    return a, b
