"""Images and resources as a table of blobs (url, content, disposition, status): what is kept, and under which name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_meaningless_image, percent_decoded, safe_name


def kept_images(blobs: DataFrame, keywords: Sequence[str] = (), banned: Sequence[str] = (), least: int = 5 * 1024) -> DataFrame:
    """Images of some size that are no pages, aren't banned by md5, and mean something by name."""
    head = F.lower(F.decode(F.substring("content", 1, 64), "ISO-8859-1"))
    ok = (F.octet_length("content") >= least) & ~head.rlike(r"^\s*<(!doctype|html)") & ~is_meaningless_image("url", keywords)
    out = blobs.filter(ok).withColumn("digest", F.md5("content"))
    return out.filter(~F.col("digest").isin(*banned)) if banned else out


def named_images(blobs: DataFrame, folder: str = "folder", prefix: str = "prefix", order: str = "ord") -> DataFrame:
    """``blobs`` with a sequence number within folder and prefix, and the file's name."""
    kind = F.lower(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"(?i)\.(png|jpe?g|gif|webp|svg|bmp)$", 1))
    seq = F.row_number().over(Window.partitionBy(folder, prefix).orderBy(order))
    name = F.concat(safe_name(prefix), F.lit("_"), seq.cast("string"), F.lit("."), F.when(kind == "", F.lit("png")).otherwise(kind))
    return blobs.withColumn("seq", seq).withColumn("file", name)


def kept_resources(blobs: DataFrame, folder: str = "folder", order: str = "ord", least: int = 1024, all_rows: bool = False) -> DataFrame:
    """Resources of some size with a file name (by disposition, URL, or title), each content once a folder.

    With ``all_rows`` repeated contents stay, under the name of the first.
    """
    said = F.regexp_extract("disposition", r"""filename\*?=(?:UTF-8'')?["']?([^"';]+)""", 1)
    path = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"/([^/]+\.\w+)$", 1)
    name = F.coalesce(F.nullif(said, F.lit("")), F.nullif(path, F.lit("")), F.col("title"))
    rows = blobs.filter(F.octet_length("content") >= least).withColumn("file", safe_name(percent_decoded(name))).withColumn("digest", F.md5("content"))
    alike = Window.partitionBy(folder, "digest").orderBy(order)
    rows = rows.withColumn("bytes", F.octet_length("content").cast("long"))
    if all_rows:
        return rows.withColumn("file", F.first("file").over(alike))
    return rows.withColumn("n", F.row_number().over(alike)).filter("n = 1").drop("n")
