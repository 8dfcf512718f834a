"""A whole run for a site: discover items, join them with pages, convert, assemble, write; and its incremental form.

Nothing is lost on the way: an item whose page is missing, too large or broken is a document with an ``error`` and no place in the
tree, and the command line ends non-zero for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as profiles
from ..functions.columns import renamed, safe_name, template
from ..operators import changes, discovery, formats, library, media, pages, quality, rules
from ..sources import corpus, sinks

ITEM = ("ord", "kind", "id", "name", "category", "url", "features", "cover")
# Blocks of documents, names of folders and of images, headings.
BLOCKS = {"product": ["cover_image", "features", "body_html", "subproducts"], "industry": ["body_html", "cases"]}
FOLDERS = {"products_dir": "产品", "solutions_dir": "解决方案", "image_subdir": "图片", "resource_subdir": "资料"}
SEPARATOR, CASES, SPEC_HEAD, COVER, PICTURE = "\n\n---\n", "## 💡 应用案例", "\n| 参数 | 值 |\n|------|-----|\n", "主图", "配图"
DEPTH = 3


class Outcome(NamedTuple):
    """Documents, with their errors; files to write beside them (path, content); records of resources."""

    docs: DataFrame
    files: DataFrame | None
    resources: DataFrame | None


def _out(config: Mapping, key: str) -> str:
    out = config.get("output_structure") or {}
    if key == "industries_dir":
        return out.get("industries_dir") or out.get("solutions_dir") or FOLDERS["solutions_dir"]
    return out.get(key) or FOLDERS[key]


def _item(found: DataFrame) -> DataFrame:
    """The columns of items; those that a way of discovery doesn't have are null."""
    return found.select(*[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in ITEM])


def items(
    spark: SparkSession, config: dict, page_table: DataFrame | None = None, bodies: DataFrame | None = None, menu: DataFrame | None = None,
    sub_bodies: DataFrame | None = None,
) -> DataFrame:
    """(ord, kind, id, name, category, url, features, cover) by the profile's mode: sitemap, crawl or nav, url_list, or a menu.

    ``sub_bodies`` (url, value): what an index of sitemaps points to; those that it follows are read too. Without a menu, the page at the
    fallback's address is read by its selectors. Products that list others on their pages bring these along.
    """
    d, base = config.get("discovery") or {}, config["base_url"]
    mode = d.get("mode") or "api"
    fallback = config.get("web_fallback") or {}
    rule = {"base_url": base, "product": d.get("product_pattern", "/products/"), "industry": d.get("industry_pattern", "/industries/"), "exclude": d.get("exclude_pattern", "")}
    rule |= {"rule": d.get("url_category_rule"), "case": d.get("name_case", "title")}
    if mode == "url_list":
        found = discovery.from_list(corpus.url_list(spark, d.get("urls") or []), base, d.get("category_name", "Pages"), d.get("skip_list_pages", True))
    elif mode == "sitemap" and bodies is not None:
        urls = discovery.sitemap_urls(bodies)
        if sub_bodies is not None:
            followed = discovery.sub_sitemaps(bodies, d.get("sitemap_url") or base, d.get("sitemap_pdp_pattern", ""), int(d.get("sitemap_max_sub") or 5))
            more = sub_bodies.join(F.broadcast(followed), "url").select(F.concat(F.lit("1 "), "url").alias("file"), "value")  # sitemap_max_sub rows
            urls = urls.unionByName(discovery.sitemap_urls(more))
        found = discovery.classified(urls, require_html=d.get("require_html", True), **rule)
    elif mode in ("crawl", "nav") and page_table is not None:
        start = page_table.filter(F.col("url") == d.get("start_url", base))
        seen = pages.links(pages.extract(start.withColumn("page_id", F.lit(0)), want=["links"], selector=d.get("nav_selector", "a")))
        found = discovery.classified(seen.select("ord", F.col("href").alias("url")), require_html=False, **rule)
    elif menu is not None:
        found = discovery.flatten_menu(menu)
    elif fallback.get("enabled") and page_table is not None:
        css = fallback.get("selectors") or {}
        start = page_table.filter(F.col("url") == base.rstrip("/") + fallback.get("menu_url", "/products"))
        found = pages.menu_items(start, css.get("menu_categories", "nav .category"), css.get("menu_items", "a.product-link"), css.get("item_id_attr", "data-id"))
    else:
        raise ValueError(f"discovery mode {mode} needs its input: bodies (sitemap), page_table (nav), or menu (api)")
    found = _item(found).withColumn("url", _address(config))
    if fallback.get("children_selector") and page_table is not None:
        found = with_children(found, page_table, fallback["children_selector"])
    cfg = config.get("extraction") or {}
    kept = discovery.of_types(found, profiles.entity_types(cfg.get("entity_types") or ("product", "industry")), cfg.get("category_filter") or ())
    return discovery.controlled(kept, d.get("url_include_patterns") or (), d.get("url_exclude_patterns") or (), int(d.get("max_pages") or 0))


def _address(config: Mapping) -> Column:
    """Where an item's page is: its address, an identity that is one, or the fallback's template for its kind."""
    fallback, base = config.get("web_fallback") or {}, config["base_url"]
    made = F.when(F.col("kind") == "industry", template(base + fallback.get("industry_url", "/solutions/{id}"), {"id": F.col("id")})).otherwise(
        template(base + fallback.get("product_url", "/products/{id}"), {"id": F.col("id")})
    )
    return F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).when(F.col("id").startswith("http"), F.col("id")).otherwise(made)


def _edges(page_table: DataFrame, selector: str) -> DataFrame:
    """(parent, ord, id, name): pages that a page lists, by address."""
    listed = pages.extract(page_table.select("url", "html"), want=["links"], selector=selector)
    rows = pages.links(listed.withColumn("page_id", F.col("url")))
    return rows.filter("text <> ''").select(F.col("page_id").alias("parent"), "ord", F.col("href").alias("id"), F.col("text").alias("name"))


def with_children(found: DataFrame, page_table: DataFrame, selector: str) -> DataFrame:
    """Items, and behind each product those that its page lists, of its category."""
    own = page_table.join(found.filter("kind = 'product'").select("url").distinct(), "url", "left_semi")
    below = found.filter("kind = 'product'").select(F.col("ord").alias("at"), "category", F.col("url").alias("parent")).join(_edges(own, selector), "parent")
    none = F.lit(None).cast("string")
    sub = below.select(
        F.struct(F.col("at"), (F.col("ord") + 1).alias("child")).alias("ord"), F.lit("product").alias("kind"), "id", "name", "category", F.col("id").alias("url"),
        none.alias("features"), none.alias("cover"),
    )
    return found.withColumn("ord", F.struct(F.col("ord").alias("at"), F.lit(0).alias("child"))).unionByName(sub)


def _nodes(found: DataFrame, page_table: DataFrame, config: dict) -> DataFrame:
    """What documents are made of: each item and, in its document or beside it (split), what its page lists below it.

    (kind, root, doc, place, level, number, id, name, category, url, features, cover, names); ``doc`` is the place of the node whose document it is in.
    """
    selector = (config.get("web_fallback") or {}).get("children_selector")
    split = (config.get("output_structure") or {}).get("subproduct_mode", "merge") == "split"
    none = F.array().cast("array<int>")
    first = F.row_number().over(Window.partitionBy("kind", "id").orderBy("ord"))
    one = found.withColumn("n_", first).filter("n_ = 1").drop("n_")
    top = one.select(
        "kind", F.col("id").alias("root"), none.alias("doc"), none.alias("place"), F.lit(1).alias("level"), F.lit("").alias("number"), "id", "name", "category", "url",
        "features", "cover", F.array("name").alias("names"),
    )
    if not selector or "subproducts" not in _blocks(config, "product"):
        return top
    products = one.filter("kind = 'product'")
    edges = _edges(page_table, selector).persist()
    way = pages.children(products.select(F.col("url").alias("id")).distinct(), edges, DEPTH).filter("depth > 0")
    below = way.join(products.select(F.col("url").alias("from_"), F.col("id").alias("item"), F.col("name").alias("top"), "category"), F.col("root") == F.col("from_"))
    missing = F.lit(None).cast("string")
    return top.unionByName(below.select(
        F.lit("product").alias("kind"), F.col("item").alias("root"), (F.col("place") if split else none).alias("doc"), "place",
        (F.lit(2) if split else F.col("depth") + 1).alias("level"), (F.lit("") if split else F.array_join(F.col("place").cast("array<string>"), ".")).alias("number"),
        "id", F.element_at("names", -1).alias("name"), "category", F.col("id").alias("url"), missing.alias("features"), missing.alias("cover"),
        F.concat(F.array("top"), "names").alias("names"),
    ))


def _blocks(config: Mapping, kind: str) -> list[str]:
    said = config.get("content_blocks") or BLOCKS
    return said if isinstance(said, list) else said.get(kind, BLOCKS[kind])


def _folder(config: Mapping) -> Column:
    """products/category/name, and below it the names on the way; industries/category or name/name."""
    safe = lambda c: safe_name(F.coalesce(c, F.lit("")))
    way = F.array_join(F.transform(F.slice("names", F.lit(1), F.size("doc") + 1), lambda n: safe_name(n)), "/")
    group = F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).otherwise(F.get("names", F.lit(0)))
    industry = F.concat_ws("/", F.lit(_out(config, "industries_dir")), safe(group), way)
    return F.when(F.col("kind") == "industry", industry).otherwise(F.concat_ws("/", F.lit(_out(config, "products_dir")), safe(F.col("category")), way))


def _per_kind(frame: DataFrame, config: dict, by_kind: Mapping[str, dict] | None, f: Callable[[DataFrame, dict, str], DataFrame]) -> DataFrame:
    """``f`` of the rows of each kind with that kind's profile."""
    parts = [f(frame.filter(F.col("kind") == kind), (by_kind or {}).get(kind, config), kind) for kind in ("product", "industry")]
    return parts[0].unionByName(parts[1])


def _bodies(nodes: DataFrame, page_table: DataFrame, config: dict, details: DataFrame | None) -> DataFrame:
    """(kind, id, name, url, html): one row for each page to convert; a payload's own HTML comes first, a missing page is null."""
    want = nodes.select("kind", "id", "name", "url").distinct()
    both = want.join(page_table.select("url", "html"), "url", "left")
    if details is None:
        return both.select("kind", "id", "name", "url", "html")
    field = lambda logical: renamed(F.try_parse_json("payload"), logical, config.get("field_mapping") or {})
    own = details.select("id", F.coalesce(field("product_html"), field("industry_html")).alias("own"))
    return both.join(own, "id", "left").select("kind", "id", "name", "url", F.coalesce(F.nullif("own", F.lit("")), "html").alias("html"))


def _with_linked(bodies: DataFrame, page_table: DataFrame, config: dict) -> DataFrame:
    """``bodies`` with linked: (catalogue, html) of pages that the texts' catalogue numbers stand for."""
    link = (config.get("spec_extraction") or {}).get("linked_page") or {}
    form, pattern = link.get("url_template", ""), link.get("catalog_pattern", "")
    if not (form and pattern):
        return bodies.withColumn("linked", F.lit(None).cast(pages.LINKED))
    form = form if form.startswith("http") else config["base_url"] + form
    texts = pages.extract(bodies.select(F.col("url").alias("page_id"), "url", "html").distinct(), want=["text"])
    named = pages.linked_pages(texts, texts.select("page_id", "text"), pattern, form, int(link.get("max_catalogs") or 5))
    got = named.join(page_table.select("url", "html"), "url")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "catalogue", "html"))), lambda x: F.struct(x["catalogue"], x["html"]))
    return bodies.join(got.groupBy(F.col("page_id").alias("url")).agg(listed.cast(pages.LINKED).alias("linked")), "url", "left")


def _media(nodes: DataFrame, bodies: DataFrame, blobs: DataFrame, config: dict, by_kind: Mapping[str, dict] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Maps of each page (kind, id, name: images, files), files to write (path, content), records of resources."""
    key = ["kind", "id", "name"]
    limit = _limit(config)
    asked = _per_kind(bodies, config, by_kind, lambda rows, cfg, kind: pages.extract(rows, cfg, ["refs"], name="name", page_type=kind, limit=limit, detail=True))
    refs = asked.select(*key, F.posexplode("refs").alias("ord", "r")).select(*key, "ord", F.col("r.kind").alias("what"), F.col("r.url").alias("blob"), F.col("r.name").alias("title"), F.col("r.module").alias("module"))
    cover = nodes.filter("cover <> ''").select(*key, F.lit(-1).alias("ord"), F.lit("image").alias("what"), F.col("cover").alias("blob"), F.col("name").alias("title"), F.lit(COVER).alias("module")).distinct()
    got = refs.unionByName(cover).join(blobs.select(F.col("url").alias("blob"), "content", "disposition"), "blob")
    filters = config.get("filters") or {}
    seen = got.withColumnRenamed("blob", "url").withColumn("folder", F.struct(*key))
    seen = seen.withColumn("prefix", F.when(F.col("module") == COVER, F.concat("name", F.lit(f"_{COVER}"))).otherwise(F.concat_ws("_", "name", F.nullif("module", F.lit("")), F.lit(PICTURE))))
    images = media.named_images(media.kept_images(seen.filter("what = 'image'"), filters.get("image_ignore_keywords") or (), filters.get("banned_image_md5") or ()))
    images = images.withColumn("file", F.when(F.col("module") == COVER, F.regexp_replace("file", r"_1(\.\w+)$", "$1")).otherwise(F.col("file")))
    files = media.kept_resources(seen.filter("what = 'resource'"), all_rows=True)
    held = images.select(*key, "ord", "what", "url", "module", "content", F.concat(F.lit(_out(config, "image_subdir") + "/"), "file").alias("at")).unionByName(
        files.select(*key, "ord", "what", "url", F.lit(None).cast("string").alias("module"), "content", F.concat(F.lit(_out(config, "resource_subdir") + "/"), "file").alias("at"))
    )
    slim = held.groupBy(*key, "what", "url").agg(F.min_by("at", "ord").alias("at"))
    entries = lambda what: F.map_from_entries(F.collect_list(F.when(F.col("what") == what, F.struct("url", "at"))))
    maps = slim.groupBy(*key).agg(entries("image").alias("images"), entries("resource").alias("files"))
    where = nodes.select(*key, "root", _folder(config).alias("folder"), F.get("names", F.lit(0)).alias("top")).distinct()
    written = held.join(where, key)
    records = written.filter("what = 'resource'").select(
        F.col("root").alias("page_id"), F.col("top").alias("title"), F.col("folder").alias("rel_path"), F.lit("download").alias("source"), F.substring_index("at", "/", -1).alias("filename"),
        F.col("at").alias("resource_rel_path"), F.regexp_extract("at", r"(\.\w+)$", 1).alias("kind"), F.octet_length("content").cast("long").alias("bytes"), F.col("url").alias("source_url"),
    )
    one = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    files_out = written.withColumn("path", F.concat_ws("/", "folder", "at")).withColumn("n_", one).filter("n_ = 1").select("path", "content")
    return maps, files_out, records


def _limit(config: Mapping) -> int:
    return int((config.get("rate_limit") or {}).get("max_response_bytes") or pages.MAX_BYTES)


def _spec_text(level: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    line = lambda s: F.concat(F.lit("| "), safe(s["k"]), F.lit(" | "), safe(s["v"]), F.lit(" |"))
    head = F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" 技术参数 ("), "best_source", F.lit(")"), F.lit(SPEC_HEAD))
    return F.when(F.size("specs") > 0, F.concat(head, F.array_join(F.transform("specs", line), "\n")))


def _text(config: dict, kind: str) -> Column:
    """A node's blocks in the profile's order, below its title."""
    tpl = config.get("templates") or {}
    sep = tpl.get("block_separator") or SEPARATOR
    shown = {"name": F.col("name"), "features": F.col("features"), "rel": F.col("cover_file"), "prefix": F.repeat(F.lit("#"), F.col("level"))}
    filled = lambda name: F.nullif(template(tpl.get(name) or "", shown), F.lit(""))
    body = F.nullif(F.trim(F.coalesce("md", F.lit(""))), F.lit(""))
    if kind == "industry":
        title = F.coalesce(filled("industry_heading"), F.concat(F.lit("# "), "name", F.lit(" 解决方案")))
        cases = F.when(F.coalesce("cases_md", F.lit("")) != "", F.concat(F.lit(sep + (tpl.get("industry_cases_heading") or CASES) + "\n"), "cases_md"))
    else:
        number = F.when(F.col("number") != "", F.concat("number", F.lit(" "))).otherwise("")
        title = F.coalesce(filled("product_heading"), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), number, "name"))
    made = {"body_html": body}
    if kind == "industry":
        made["cases"] = cases
    else:
        specs = _spec_text(F.col("level"))
        made["cover_image"] = F.when(F.col("cover_file").isNotNull(), F.concat(filled("product_cover_image"), F.lit("\n")))
        made["features"] = F.when(F.coalesce("features", F.lit("")) != "", F.concat(filled("product_features"), F.lit("\n")))
        made["spec_tables"] = F.when(specs.isNotNull(), F.concat(F.lit(sep), specs))
    return F.array_join(F.array_compact(F.array(F.concat(title, F.lit("\n")), *[made[b] for b in _blocks(config, kind) if b in made])), "\n")


def _cases(cases: DataFrame, config: dict, by_kind: Mapping[str, dict] | None) -> DataFrame:
    """(id, cases_md) of (id, ord, title, summary, html): each case's heading, summary and converted body, in order."""
    cfg = (by_kind or {}).get("industry", config)
    tpl = cfg.get("templates") or {}
    n = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    rows = pages.extract(cases.withColumn("n", n).withColumn("url", F.lit("")), cfg, ["md", "error"], name="title", page_type="industry")
    shown = {"n": F.col("n"), "title": F.col("title"), "summary": F.col("summary")}
    head = F.nullif(template(tpl.get("case_heading") or "", shown), F.lit(""))
    about = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.nullif(template(tpl.get("case_summary") or "", shown), F.lit("")), F.lit("\n")))
    text = F.array_join(F.array_compact(F.array(head, about, F.nullif("md", F.lit("")))), "\n")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"])
    return rows.groupBy("id").agg(F.array_join(listed, "\n").alias("cases_md"))


def outcome(
    found: DataFrame, page_table: DataFrame, config: dict, run_date: str, kind: str = "md", *, by_kind: Mapping[str, dict] | None = None, blobs: DataFrame | None = None,
    details: DataFrame | None = None, cases: DataFrame | None = None, provider: Callable[[str], str] | None = None, forced: bool = False,
) -> Outcome:
    """Documents (kind, id, name, category, url, path, body, fp, md, specs, best_source, error), and what lies beside them.

    Items are few beside pages: the join is on url, and only pages of items reach the Python stage. ``by_kind`` has profiles by kind of
    page; ``blobs`` (url, content, disposition) are images and resources, without which links stay as they are; ``details`` (id, payload) are
    answers of an interface that come before pages; ``cases`` (id, ord, title, summary, html) belong to industries.
    """
    tpl = config.get("templates") or {}
    sep = tpl.get("block_separator") or SEPARATOR
    key = ["kind", "id", "name"]
    nodes = _nodes(_item(found), page_table, config)
    bodies = _with_linked(_bodies(nodes, page_table, config, details), page_table, config)
    files = records = None
    if blobs is not None:
        maps, files, records = _media(nodes, bodies, blobs, config, by_kind)
        bodies = bodies.join(maps, key, "left")
    with_specs = bool((config.get("spec_extraction") or {}).get("enabled"))
    want = ["md", "fp", "error", *(["specs", "best_source"] if with_specs else [])]
    kept = {"images": "images", "resources": "files"} if blobs is not None else {}
    made = _per_kind(
        bodies, config, by_kind, lambda rows, cfg, of: pages.extract(rows, cfg, want, name="name", page_type=of, limit=_limit(cfg), detail=True, linked="linked", provider=provider, forced=forced, **kept)
    )
    if not with_specs:
        made = made.withColumns({"specs": F.lit(None).cast(pages.OUTPUTS["specs"]), "best_source": F.lit(None).cast("string")})
    rows = nodes.join(made.drop("url"), key, "left")
    rows = rows.withColumn("cover_file", F.lit(None).cast("string"))
    if blobs is not None:
        rows = rows.drop("cover_file").join(maps.select(*key, F.col("images").alias("kept_")), key, "left").withColumn("cover_file", F.try_element_at("kept_", F.col("cover"))).drop("kept_")
    rows = rows.join(_cases(cases, config, by_kind), "id", "left") if cases is not None else rows.withColumn("cases_md", F.lit(None).cast("string"))
    names = config.get("category_name_map") or {}
    if names:
        rows = rows.withColumn("category", F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("category")], F.col("category")))
    rows = rows.withColumn("text", F.when(F.col("kind") == "industry", _text((by_kind or {}).get("industry", config), "industry")).otherwise(_text((by_kind or {}).get("product", config), "product")))
    # a document's nodes in the order of their places; the first is its own
    first = lambda c: F.min_by(c, F.struct("place")).alias(c)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    docs = rows.withColumn("folder", _folder(config)).groupBy("kind", "root", "doc").agg(
        *[first(c) for c in ("id", "name", "category", "url", "fp", "specs", "best_source", "folder")], F.array_join(parts, "\n" + sep + "\n").alias("md"),
        F.min_by("error", F.struct(F.col("error").isNull(), "place")).alias("error"),
    )
    shown = {"site_name": F.lit(config.get("site_name") or config["base_url"]), "base_url": F.lit(config["base_url"]), "id": F.col("id"), "date": F.lit(run_date), "url": F.col("url")}
    source = F.when(F.col("kind") == "industry", template(tpl.get("industry_data_source") or "", shown)).otherwise(template(tpl.get("product_data_source") or "", shown))
    whole = F.concat("md", F.when(source != "", F.concat(F.lit("\n" + sep), source)).otherwise(""))
    demoted = (config.get("html_components") or {}).get("subheading_demote_patterns") or ()
    foot = F.when(F.col("kind") == "product", template(tpl.get("extract_time_footer") or "", shown)).otherwise("")
    done = docs.withColumn("whole_", whole)
    done = done.withColumn("md", F.when(F.col("kind") == "product", rules.assembled("whole_", demoted, True)).otherwise(rules.assembled("whole_", demoted, False))).drop("whole_")
    done = done.withColumn("md", F.when(F.col("error").isNull(), F.concat("md", foot))).withColumn("title", F.col("name"))
    hooks = config.get("adaptive_hooks")
    done = formats.formatted(done, kind, run_date, hooks if isinstance(hooks, list) else ())
    suffix = "json" if kind == "json" else "md"
    done = done.withColumn("path", F.concat("folder", F.lit("/"), safe_name("name"), F.lit(f".{suffix}"))).drop("root", "doc", "folder")
    return Outcome(done if with_specs else done.drop("specs", "best_source"), files, records)


def documents(found: DataFrame, page_table: DataFrame, config: dict, run_date: str, kind: str = "md", **more) -> DataFrame:
    """The documents of ``outcome``."""
    return outcome(found, page_table, config, run_date, kind, **more).docs


def write(docs: DataFrame, root: str, files: DataFrame | None = None) -> None:
    """Pages without an error go to the tree below ``root``, with the files beside them."""
    sinks.register(docs.sparkSession)
    docs.filter("error is null").select("path", "body").write.format("weft_tree").mode("append").save(root)
    if files is not None:
        files.select("path", "content").write.format("weft_files").mode("append").save(root)


def score(spark: SparkSession, root: str) -> DataFrame:
    return quality.quality_rows(corpus.markdown_tree(spark, root), corpus.files_below(spark, root))


def library_of(spark: SparkSession, root: str, config: dict) -> DataFrame:
    out = config.get("output_structure") or {}
    return library.collect(corpus.markdown_tree(spark, root), products=out.get("products_dir", "产品"), solutions=out.get("solutions_dir", "解决方案"), industries=out.get("industries_dir", "行业"))


def changed(found: DataFrame, page_table: DataFrame, baseline: DataFrame, limit: int = pages.MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """What is new, changed, failed or gone against the baseline, and the fingerprints of now; a page that can't be used has none."""
    both = found.join(page_table.select("url", "html"), "url", "left")
    now = pages.extract(both, want=["fp"], limit=limit).withColumn("fp", F.nullif("fp", F.lit(""))).select("kind", "id", "name", "category", "fp")
    return changes.detect(now, baseline), now
