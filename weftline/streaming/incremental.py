"""Incremental runs as structured streams: pages arrive as files, each batch is compared with the baseline and brings it up to date.

``availableNow`` works off what is there and stops; the checkpoint keeps what is done, so an interrupted run goes on where it
stopped, and a batch that is repeated gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes, pages
from ..sources.sinks import replace_table, state_table

PAGES = "page_id long, url string, html string"


def snapshot(batch: DataFrame, kind: str = "product") -> DataFrame:
    """(kind, id, name, category, fp) of pages; of a page that occurs twice the greater fingerprint. One that is missing or too large has none."""
    rows = pages.extract(batch, want=["fp", "error"], limit=pages.MAX_BYTES)
    one = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("fp").desc_nulls_last()))
    return rows.withColumn("n", one).filter("n = 1").select(F.lit(kind).alias("kind"), F.col("page_id").cast("string").alias("id"), F.col("url").alias("name"), F.lit("").alias("category"), "fp")


def _baseline(spark: SparkSession, path: str) -> DataFrame:
    table = state_table(spark, path)
    return table if table is not None else spark.createDataFrame([], "kind string, id string, name string, category string, fp string")


def run(
    spark: SparkSession, source: str, baseline: str, checkpoint: str, on_changes: Callable[[DataFrame, int], None] | None = None, files_per_batch: int = 20,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Works off the pages below ``source``, each batch as ``prepare`` makes it; ``on_changes`` gets each batch's changes. Returns the number of batches."""
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    done = 0

    def batch(rows: DataFrame, n: int) -> None:
        nonlocal done
        session = rows.sparkSession
        now = snapshot(prepare(rows) if prepare else rows).persist()
        try:
            old = _baseline(session, baseline)
            found = changes.detect(now, old, with_deleted=False)
            if on_changes:
                on_changes(found, n)
            # only what went well is remembered
            replace_table(changes.refreshed(old, now.filter("fp is not null")), baseline)
            done += 1
        finally:
            now.unpersist()

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return done


def quality_stream(spark: SparkSession, source: str, config: dict | None = None, files_per_batch: int = 20) -> DataFrame:
    """A stream of (page_id, url, md, error): the page stage on pages as they arrive; stateless."""
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return pages.extract(stream, config, want=["md", "error"], limit=pages.MAX_BYTES)
