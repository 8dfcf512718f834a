"""Discovery of pages: sitemaps, link lists, buckets, and the controls on what is taken."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import any_match, is_list_page, name_case, name_from_url, same_origin, slug

URL = r"https?://[^<>\s\"']+"


def controlled(items: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), max_pages: int = 0, order: str = "ord") -> DataFrame:
    """Items (kind, id, name, category, url, and an order) that pass include, then exclude, then the first of them."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("kind", "id", "name", "category", "url") if c in items.columns])
    out = items
    if include:
        out = out.filter(any_match(text, include))
    if exclude:
        out = out.filter(~any_match(text, exclude))
    return out.orderBy(order).limit(max_pages) if max_pages else out


def sitemap_urls(bodies: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """(ord, url): all URLs of the bodies, by file and then in the order in which they stand, however files are split over tasks."""
    name = F.col(file) if file in bodies.columns else F.sha2(F.col(text), 256)
    return bodies.select(name.alias("body"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(URL), F.lit(0))).alias("at", "url")).select(
        F.struct("body", "at").alias("ord"), "url"
    )


def sub_sitemaps(body: DataFrame, sitemap_url: str, pdp: str = "", most: int = 5, text: str = "value") -> DataFrame:
    """The sitemaps of a sitemap index that are followed."""
    loc = F.regexp_extract_all(F.col(text), F.lit(r"<loc>\s*(https?://[^<>\s\"']+)\s*</loc>"), F.lit(1))
    rows = body.filter(F.col(text).contains("<sitemap>") | F.col(text).contains("sitemapindex")).select(F.posexplode(loc).alias("ord", "url"))
    wanted = F.col("url").contains(pdp) if pdp else ~F.col("url").contains("docs") & ~F.col("url").contains("blog")
    return rows.filter(same_origin("url", F.lit(sitemap_url)) & wanted).orderBy("ord").limit(most)


def category_of(url: Column, pattern: str = "", group: int = 1, default: str = "All") -> Column:
    if not pattern:
        return F.lit(default)
    found = F.regexp_extract(url, pattern, group)
    return F.when(found != "", found).otherwise(F.lit(default))


def classified(
    urls: DataFrame, base_url: str, product: str = "/products/", industry: str = "/industries/", exclude: str = "", require_html: bool = True,
    rule: Mapping | None = None, case: str = "title",
) -> DataFrame:
    """(ord, kind, id, name, category, url) of same-origin product and industry URLs; each once."""
    rule = rule or {}
    u = F.col("url")
    ok = same_origin(u, F.lit(base_url))
    if exclude:
        ok &= ~u.contains(exclude)
    is_product = u.contains(product) & (F.lit(not require_html) | u.contains(".html"))
    kind = F.when(is_product, "product").when(u.contains(industry), "industry")
    where = category_of(u, rule.get("pattern", ""), rule.get("group", 1))
    names = F.create_map(*[F.lit(x) for kv in rule.get("name_map", {}).items() for x in kv]) if rule.get("name_map") else None
    shown = name_case(F.replace(where, F.lit("-"), F.lit(" ")), case)
    shown = F.coalesce(names[where], shown) if names is not None else shown
    key = F.regexp_replace(F.replace(u, F.lit(base_url), F.lit("")), "^/+|/+$", "")
    rows = urls.filter(ok).withColumn("kind", kind).filter("kind is not null").withColumn("key", key)
    first = F.row_number().over(Window.partitionBy("kind", "key").orderBy("ord"))
    rows = rows.withColumn("n", first).filter("n = 1")
    return rows.select("ord", "kind", u.alias("id"), name_from_url(u, case).alias("name"), where.alias("slug"), shown.alias("category"), "url")


def buckets(items: DataFrame) -> DataFrame:
    """(slug, category, place, id, name, url): items by category in the order of slugs, each numbered within its own; a row each, however many there are."""
    place = F.row_number().over(Window.partitionBy("slug", "category").orderBy("ord"))
    return items.withColumn("place", place).orderBy("slug", "category", "place").select("slug", "category", "place", "id", "name", "url")


def from_list(entries: DataFrame, base_url: str, category: str = "Pages", skip_list_pages: bool = True) -> DataFrame:
    """Items of a list of (ord, url, title, category); duplicates and overview pages go."""
    full = F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/"), F.ltrim(F.regexp_replace("url", "^/+", ""))))
    rows = entries.filter(F.coalesce(F.col("url"), F.lit("")) != "").withColumn("url", full)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("ord"))).filter("n = 1")
    if skip_list_pages:
        rows = rows.filter(~is_list_page("url"))
    named = F.coalesce(F.nullif("title", F.lit("")), F.nullif(name_from_url("url"), F.lit("")), slug("url"))
    return rows.select("ord", F.lit("product").alias("kind"), F.col("url").alias("id"), named.alias("name"), F.coalesce(F.nullif("category", F.lit("")), F.lit(category)).alias("category"), "url")


def flatten_menu(menu: DataFrame, column: str = "menu") -> DataFrame:
    """Items of a menu (struct or parsed JSON with productTypeList and industryList); identities become strings."""
    m = F.col(column)
    products = menu.select(F.posexplode_outer(m["productTypeList"]).alias("a", "group")).select("a", "group", F.posexplode_outer("group.children").alias("b", "item"))
    has = "features" in menu.select(F.explode_outer(F.flatten(F.transform(m["productTypeList"], lambda g: g["children"]))).alias("x")).select("x.*").columns
    more = lambda c: (F.col(f"item.{c}") if has else F.lit(None)).cast("string").alias(c)
    one = products.select(F.struct("a", "b").alias("ord"), F.lit("product").alias("kind"), F.col("item.id").cast("string").alias("id"), F.col("item.name").alias("name"), F.col("group.name").alias("category"), F.col("item.url").alias("url"), more("features"), more("cover"))
    inds = menu.select(F.posexplode_outer(m["industryList"]).alias("b", "item"))
    two = inds.select(F.struct(F.lit(2**30).alias("a"), "b").alias("ord"), F.lit("industry").alias("kind"), F.col("item.id").cast("string").alias("id"), F.col("item.name").alias("name"), F.lit("").alias("category"), F.col("item.url").alias("url"), F.lit(None).cast("string").alias("features"), F.lit(None).cast("string").alias("cover"))
    return one.unionByName(two).filter("id is not null")


def of_types(items: DataFrame, types: Sequence[str] = ("product", "industry"), categories: Sequence[str] = ()) -> DataFrame:
    """Entity types (``solution`` is ``industry``) and categories."""
    kinds = list(dict.fromkeys("industry" if t == "solution" else t for t in types))
    out = items.filter(F.col("kind").isin(*kinds))
    return out.filter(F.col("category").isin(*categories)) if categories else out
