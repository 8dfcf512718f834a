"""Content baselines: what is new, changed, gone or failed, and how a baseline is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["kind", "id"]


def detect(current: DataFrame, baseline: DataFrame, with_deleted: bool = True) -> DataFrame:
    """(kind, id, name, category, change_type) by the fingerprints ``fp``; a null fingerprint is an error.

    Deleted entries are a label of their own here; new and changed are what they are without it.
    """
    c, b = current.alias("c"), baseline.select(*KEY, F.col("fp").alias("old"), F.col("name").alias("old_name"), F.col("category").alias("old_category"), F.lit(True).alias("known"))
    both = c.join(b, KEY, "full" if with_deleted else "left").withColumn("here", F.col("c.name").isNotNull() | F.col("c.fp").isNotNull())
    kind = (
        F.when(~F.col("here"), "deleted").when(F.col("fp").isNull(), "error").when(F.col("known").isNull(), "new")
        .when(~F.col("fp").eqNullSafe(F.col("old")), "changed")
    )
    return both.select(*KEY, F.coalesce("name", "old_name").alias("name"), F.coalesce("category", "old_category").alias("category"), kind.alias("change_type")).filter("change_type is not null")


def refreshed(baseline: DataFrame, done: DataFrame) -> DataFrame:
    """The baseline with the entries of ``done`` in place of its own."""
    return baseline.join(done.select(*KEY), KEY, "left_anti").unionByName(done.select(*baseline.columns))


def merged(baseline: DataFrame, update: DataFrame) -> DataFrame:
    """Field by field: what the update has, else what the baseline had."""
    rest = [c for c in baseline.columns if c not in KEY]
    u = update.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in rest])
    return baseline.join(u, KEY, "full").select(*KEY, *[F.coalesce(f"new_{c}", c).alias(c) for c in rest])


def to_process(changes: DataFrame) -> DataFrame:
    """What an incremental run does again."""
    return changes.filter(F.col("change_type").isin("new", "changed"))
