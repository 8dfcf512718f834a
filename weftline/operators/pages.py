"""The one stage that reads HTML: each page is parsed once, in Arrow batches, and gives all that later operators use.

What follows is relational. Filters on URLs belong before ``extract``, which Catalyst can't look into; columns
that nobody asks for (``want``) are neither computed nor sent back. No page is lost: one that is missing, too large or broken is a
row with its error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions.batches import bounded_batches, tidied
from ..functions.columns import same_origin, usable_href

LINK = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
SPEC = T.StructType([T.StructField("layer", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
REF = T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "url", "name", "module")])
LINKED = T.ArrayType(T.StructType([T.StructField("catalogue", T.StringType()), T.StructField("html", T.StringType())]))
OUTPUTS = {
    "md": T.StringType(), "fp": T.StringType(), "links": T.ArrayType(LINK), "specs": T.ArrayType(SPEC), "best_source": T.StringType(),
    "js_shell": T.BooleanType(), "refs": T.ArrayType(REF), "text": T.StringType(), "error": T.StringType(),
}
MAX_BYTES = 26_214_400


def fault(html: Column | str = "html", limit: int = MAX_BYTES) -> Column:
    """Why a page can't be used: it is missing, or larger than the limit; else null."""
    h = F.col(html) if isinstance(html, str) else html
    return F.when(h.isNull(), F.lit("no page")).when(F.octet_length(h) > limit, F.lit(f"more than {limit} bytes"))


@dataclass(frozen=True)
class _Job:
    """What is asked of every page."""

    config: dict
    want: frozenset[str]
    selector: str = "a"
    detail: bool = False
    place_images: bool = False
    place_resources: bool = False
    provider: Callable[[str], str] | None = None
    forced: bool = False


def _one(job: _Job, html: str | None, url: str | None, name: str = "", page_type: str = "", images=None, resources=None, linked=None) -> dict:
    from ..dom import phases, specs
    from ..dom.select import select
    from ..dom.tree import parse

    want, config = job.want, job.config
    out: dict = dict.fromkeys(want)
    html = html or ""
    root = parse(html)
    page = lambda tree=None: phases.Page(html, config, name=name or "", page_type=page_type or "", root=tree, url=(url or "about:blank") if job.detail else "")
    if "fp" in want:
        out["fp"] = hashlib.md5(re.sub(r"\s+", "", root.text(" ")).encode(), usedforsecurity=False).hexdigest() if html else ""
    if "text" in want:
        out["text"] = root.text()
    if "links" in want:
        found = select(root, job.selector)
        out["links"] = [{"ord": i, "href": _resolved(url, a.get("href")), "text": a.text(strip=True)} for i, a in enumerate(found) if "href" in a.attrs]
    if want & {"specs", "best_source"}:
        best, rows = specs.extract(root, config.get("spec_extraction"), [(x["catalogue"], x["html"]) for x in linked or ()])
        out["best_source"] = best
        out["specs"] = [{"layer": layer, "ord": i, "k": k, "v": v} for i, (layer, k, v) in enumerate(rows)]
    if "js_shell" in want:
        out["js_shell"] = phases.is_js_shell(html)
    if "refs" in want:
        refs: list[dict] = []
        asking = page()

        def note(kind: str, address: str, title: str, module: str = "") -> str:
            refs.append({"kind": kind, "url": _resolved(url, address), "name": title, "module": module})
            return address

        asking.image = lambda src, title, module: note("image", src, title, module)
        asking.resource = lambda href, title: note("resource", href, title)
        phases.convert(asking)
        out["refs"] = refs
    if "md" in want:
        p = page(None if phases.rewrites_source(config) else root)
        if job.place_images:
            kept_images = dict(images or ())
            p.image = lambda src, _title, _module: kept_images.get(_resolved(url, src))
        if job.place_resources:
            kept_files = dict(resources or ())
            p.resource = lambda href, _title: kept_files.get(_resolved(url, href))
        out["md"] = phases.convert(p, job.provider, job.forced)
    return {k: out[k] for k in want if k in out}


def _resolved(base: str | None, href: str) -> str:
    try:
        return urljoin(base or "", href)
    except ValueError:
        return href


def extract(
    pages: DataFrame, config: dict | None = None, want: Sequence[str] = tuple(OUTPUTS), html: str = "html", url: str = "url", name: str | None = None,
    page_type: str = "", selector: str = "a", *, types: str | None = None, limit: int | None = None, detail: bool = False, images: str | None = None,
    resources: str | None = None, linked: str | None = None, provider: Callable[[str], str] | None = None, forced: bool = False, by: str | None = None,
) -> DataFrame:
    """``pages`` without its HTML, with the outputs in ``want``. A page that fails has its error, and nulls, and stops no job.

    Columns by name: ``types`` holds each page's type; ``images`` and ``resources`` are maps from addresses to where they are kept (what isn't
    kept goes); ``linked`` has structs (catalogue, html) of pages with more attributes. With ``limit`` pages that are missing or
    larger are rows with that error, and their bodies aren't sent to Python; without, a null page is an empty one.
    ``detail`` picks a detail page's content; ``provider`` refines the text, and its failure is an error if ``forced``.
    With ``by`` each page's profile is the one that ``config`` has for its value in that column: pages of many profiles go through one stage.
    """
    asked = tuple(w for w in OUTPUTS if w in want)
    inner = [c for c in (images, resources, linked) if c]
    rest = [c for c in pages.columns if c != html and c not in asked and c not in inner]
    keep = pages.select(*rest)
    schema = T.StructType([*keep.schema.fields, *(T.StructField(w, OUTPUTS[w]) for w in asked)])
    given = lambda c, none: F.col(c) if c else none
    bad = fault(html, limit) if limit is not None else F.lit(None).cast("string")
    nothing = F.lit(None).cast("map<string,string>")
    source = pages.select(
        *rest, F.col(url).alias("__url"), given(name, F.lit("")).alias("__name"), given(types, F.lit(page_type)).alias("__type"),
        given(images, nothing).alias("__images"), given(resources, nothing).alias("__resources"), given(linked, F.lit(None).cast(LINKED)).alias("__linked"),
        bad.alias("__bad"), given(by, F.lit("")).alias("__by"), F.when(bad.isNull(), F.col(html)).alias("__html"),
    )
    job = lambda c: _Job(c, frozenset(asked) - {"error"}, selector, detail, images is not None, resources is not None, provider, forced)
    jobs = {k: job(c) for k, c in ((config or {}) if by else {"": config or {}}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = {w: to_arrow_type(OUTPUTS[w]) for w in asked}
        for batch in batches:
            n = len(rest)
            rows = []
            for u, title, kind, kept, files, more, wrong, which, h in zip(*(batch.column(n + i).to_pylist() for i in range(9)), strict=True):
                try:
                    rows.append({"error": wrong} if wrong else _one(jobs[which], h, u, title, kind, kept, files, more))
                except Exception as e:  # a broken page is a row with an error
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            new = [pa.array([r.get(w) for r in rows], type=kinds[w]) for w in asked]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=schema.names)

    bounded_batches(pages.sparkSession)
    return source.mapInArrow(tidied(run), schema)


def menu_items(pages: DataFrame, groups: str, entries: str, id_attr: str = "data-id", html: str = "html", url: str = "url") -> DataFrame:
    """(ord, kind, id, name, category, url) of the products in a page's menu: entries within groups, which name the categories.

    An entry's identity is its attribute, else the last segment of its link.
    """
    from ..dom.select import select
    from ..dom.tree import parse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, text in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for g, group in enumerate(select(parse(text or ""), groups)):
                    title = group.text(strip=True)
                    for i, a in enumerate(select(group, entries)):
                        at = a.get(id_attr) or a.get("href").rstrip("/").split("/")[-1]
                        rows.append((g, i, at, a.text(strip=True), title, _resolved(base, a.get("href")) if a.get("href") else None))
            kinds = [pa.int32(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["a", "b", "id", "name", "category", "url"])

    bounded_batches(pages.sparkSession)
    found = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(tidied(run), "a int, b int, id string, name string, category string, url string")
    return found.filter("id <> ''").select(F.struct("a", "b").alias("ord"), F.lit("product").alias("kind"), "id", "name", "category", "url")


def links(extracted: DataFrame, page: str = "page_id", url: str = "url") -> DataFrame:
    """(page, ord, href, text) of usable links within the origin, each target once a page; images leave no text."""
    rows = extracted.select(page, url, F.explode("links").alias("link")).select(page, url, "link.*")
    rows = rows.withColumn("text", F.trim(F.regexp_replace("text", r"!\[[^\]]*\]\s*", "")))
    ok = rows.filter(usable_href("href", url) & same_origin("href", url))
    first = F.row_number().over(Window.partitionBy(page, "href").orderBy("ord"))
    return ok.withColumn("n", first).filter("n = 1").select(page, "ord", "href", "text")


def specs(extracted: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, layer, ord, k, v): attributes, one row each."""
    return extracted.select(page, F.explode("specs").alias("s")).select(page, "s.*")


def merge_layers(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """Of rows (page, rank of the layer, ord, k, v) the first of each key."""
    first = F.row_number().over(Window.partitionBy(page, "k").orderBy("rank", "ord"))
    return rows.withColumn("n", first).filter("n = 1").drop("n")


def linked_pages(extracted: DataFrame, text: DataFrame, pattern: str, template: str, most: int = 5, page: str = "page_id") -> DataFrame:
    """(page, ord, catalogue, url): catalogue numbers that a page names, as the pages they stand for; each once, ``most`` at most.

    ``text``: (page, text). The result is joined with the table of pages on url."""
    found = text.select(page, F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), 1, most).alias("all"))
    return found.select(page, F.posexplode("all").alias("ord", "catalogue")).withColumn("url", F.replace(F.lit(template), F.lit("{catalog}"), F.col("catalogue")))


def children(roots: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, depth, place, names): what hangs below each root, by (parent, id, ord, name), ``depth`` levels deep; each once.

    ``place`` numbers the way from the root (from 1 at each level), ``names`` names it; a node that several ways lead to has the shortest,
    then the first. One join for each level.
    """
    more = [c for c in ("ord", "name") if c in edges.columns]
    steps = edges.select("parent", F.col("id").alias("child"), (F.col("ord") if "ord" in more else F.col("id")).alias("o_"), (F.col("name") if "name" in more else F.col("id")).alias("n_"))
    steps = steps.withColumn("at", F.row_number().over(Window.partitionBy("parent").orderBy("o_", "child"))).drop("o_")
    level = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("names"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(steps, F.col("id") == F.col("parent")).select(
            "root", F.col("child").alias("id"), F.lit(d).alias("depth"), F.concat("place", F.array("at")).alias("place"), F.concat("names", F.array("n_")).alias("names")
        )
        out = out.unionByName(level)
    first = F.row_number().over(Window.partitionBy("root", "id").orderBy("depth", "place"))
    return out.withColumn("n_", first).filter("n_ = 1").drop("n_")


def register(spark: SparkSession) -> None:
    """The table functions html_links(url, html), html_specs(html) and md_lines(text) for SQL, with LATERAL."""

    @udtf(returnType="ord int, href string, text string")
    class HtmlLinks:
        def eval(self, url: str, html: str):
            for x in _one(_Job({}, frozenset(("links",))), html, url)["links"]:
                yield x["ord"], x["href"], x["text"]

    @udtf(returnType="layer string, ord int, k string, v string")
    class HtmlSpecs:
        def eval(self, html: str):
            for x in _one(_Job({}, frozenset(("specs",))), html, "")["specs"]:
                yield x["layer"], x["ord"], x["k"], x["v"]

    @udtf(returnType="pos int, line string")
    class MdLines:
        def eval(self, text: str):
            yield from enumerate((text or "").split("\n"))

    for name, f in (("html_links", HtmlLinks), ("html_specs", HtmlSpecs), ("md_lines", MdLines)):
        spark.udtf.register(name, f)
