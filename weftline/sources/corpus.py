"""Reading: pages, Markdown trees, sitemap bodies, menus, state; and a Spark data source that fetches pages over HTTP."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.quality import SKIPPED

ASSET_FOLDERS = ("图片", "资料", "_archive", "_meta")
RECORDS = {
    "specs": "page_id string, title string, rel_path string, source string, specs map<string,string>",
    "resources": "page_id string, title string, rel_path string, source string, filename string, resource_rel_path string, kind string, bytes long, source_url string",
    "baseline": "kind string, id string, name string, category string, fp string",
}


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of a Parquet table; only these columns are read."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def markdown_tree(spark: SparkSession, root: str, skip: Sequence[str] = SKIPPED, folders: Sequence[str] = ASSET_FOLDERS) -> DataFrame:
    """(path below ``root``, text) of all Markdown files but generated ones and those in asset folders.

    Paths are filtered before contents are read: the predicate is on the files' metadata.
    """
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    full = F.try_url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rel = F.substring_index(full, base, -1)
    parts = F.split(rel, "/")
    kept = ~F.element_at(parts, -1).isin(*skip) & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(f) for f in folders]))
    return raw.select(rel.alias("path"), F.col("value").alias("text"), kept.alias("kept")).filter("kept").drop("kept")


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path below ``root``) of every file, for references to be checked against; contents aren't read."""
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    full = F.try_url_decode(F.replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    return names.select(F.substring_index(full, base, -1).alias("path"))


def sitemap_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) whole texts."""
    return spark.read.text(path, wholetext=True).select(F.concat(F.lit("0 "), "_metadata.file_path").alias("file"), "value")


def menus(spark: SparkSession, path: str) -> DataFrame:
    """(menu) of JSON answers of an interface: what is under ``data``, with identities as strings."""
    shape = (
        "struct<productTypeList:array<struct<name:string,children:array<struct<id:string,name:string,url:string,features:string,cover:string>>>>,"
        "industryList:array<struct<id:string,name:string,url:string>>>"
    )
    body = spark.read.text(path, wholetext=True)
    return body.select(F.from_json(F.coalesce(F.get_json_object("value", "$.data"), F.col("value")), shape).alias("menu"))


def details(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload) of an interface's answers by item, one JSON file ``{id}.json`` each: what is under ``data``."""
    body = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("id"), "value")
    return body.select(F.try_url_decode("id").alias("id"), F.coalesce(F.get_json_object("value", "$.data"), F.col("value")).alias("payload"))


def cases(spark: SparkSession, path: str, fields: dict | None = None) -> DataFrame:
    """(id, ord, title, summary, html) of an interface's answers by item, lists of cases, one JSON file ``{id}.json`` each."""
    names = fields or {}
    rows = details(spark, path).select("id", F.posexplode(F.from_json("payload", "array<map<string,string>>")).alias("ord", "case"))
    field = lambda logical, usual: F.col("case")[names.get(logical, usual)]
    return rows.select("id", "ord", field("case_title", "title").alias("title"), field("case_summary", "summary").alias("summary"), field("case_html", "html").alias("html"))


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Stored records of specs, resources or a baseline."""
    return spark.read.schema(RECORDS[kind]).json(path)


def url_list(spark: SparkSession, entries: Sequence[str | dict]) -> DataFrame:
    """(ord, url, title, category) of a configured list."""
    rows = [{"url": e} if isinstance(e, str) else e for e in entries]
    data = [(i, str(r.get("url") or ""), r.get("title") or r.get("name"), r.get("category")) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ord int, url string, title string, category string")


class WebSource(DataSource):
    """``spark.read.format("weft_web").option("urls", json list)``: (url, status, content, disposition, error, type).

    Each partition fetches its share politely: a pause between requests, retries of 429, 503 and broken connections with
    growing waits, and a bound on bytes, declared or read. A failure is a row with an error. Options: partitions,
    delay, max_retries, backoff, timeout, max_bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "weft_web"

    def schema(self) -> str:
        return "url string, status int, content binary, disposition string, error string, type string"

    def reader(self, schema) -> DataSourceReader:
        return _WebReader(self.options)


class _Share(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _WebReader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options.get("urls", "[]"))
        self.n = int(options.get("partitions", 8))
        self.delay, self.backoff = float(options.get("delay", 0)), float(options.get("backoff", 2))
        self.tries, self.timeout, self.most = int(options.get("max_retries", 3)), float(options.get("timeout", 15)), int(options.get("max_bytes", 26_214_400))

    def partitions(self) -> list[InputPartition]:
        return [_Share(self.urls[i :: self.n]) for i in range(min(self.n, len(self.urls)))] or [_Share([])]

    def read(self, partition) -> Iterator[tuple]:
        for i, url in enumerate(partition.urls):
            if i and self.delay:
                time.sleep(self.delay)
            yield self._get(url)

    def _get(self, url: str) -> tuple:
        from urllib.error import HTTPError
        from urllib.parse import urlparse
        from urllib.request import Request, urlopen

        if urlparse(url).scheme not in ("http", "https"):
            return url, None, None, None, "only http(s) is fetched", None
        error = ""
        for attempt in range(self.tries):
            if attempt:
                time.sleep(self.backoff**attempt)
            try:
                with urlopen(Request(url, headers={"User-Agent": "weftline"}), timeout=self.timeout) as r:
                    if int(r.headers.get("Content-Length") or 0) > self.most or len(body := r.read(self.most + 1)) > self.most:
                        return url, r.status, None, None, f"more than {self.most} bytes", None
                    return url, r.status, body, r.headers.get("Content-Disposition"), None, r.headers.get("Content-Type")
            except HTTPError as e:
                error = f"HTTP {e.code}"
                if e.code not in (429, 503):
                    return url, e.code, None, None, error, None
            except OSError as e:
                error = str(e)
        return url, None, None, None, error, None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebSource)


def as_pages(fetched: DataFrame) -> DataFrame:
    """(url, html) of what was fetched: as UTF-8 or, if that fails, Latin-1."""
    html = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return fetched.filter("content is not null").select("url", html.alias("html"))
