"""Operator 8: mixing sources to target weights.

Rows get hash-random keys; within a source they are ordered by key, distributed prefix sums of their sizes are
formed, and the order is cut where the source's budget ends. A budget of more than the source's size takes whole
epochs first. What decides about a row is its source, its key, and its source's cut, so rows are neither
shuffled nor sorted whole: sums per (source, key range) give the range in which the cut falls, that range is
summed at a finer resolution, and at last by single keys. A source with a third of all rows is spread over its
key ranges.

Nulls and rows: a null source is a source of its own, the last; a null text has size 0; rows of one key (repeated rows)
at a cut share what is left of the budget in proportion to their sizes, rounded down; a source of size 0 takes nothing;
an empty table gives an empty result; columns named like a result give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cols, free_name, staged, with_results

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that are broadcast with their cuts at most; more are joined by shuffling.
FEW_SOURCES = 50_000


def size_of(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Targets are proportional to weights, at most ``most`` times the size; the excess is reshared by weight until
    none is above. The level (target for a unit of weight) is found by passes that each set aside the sources it
    would fill; each pass is one aggregate.
    """
    spark = sizes.sparkSession
    kind = sizes.schema["source"].dataType
    named = sizes.filter("source is not null").orderBy(F.encode("source", "UTF-8")).select("source", "source_size").rdd.zipWithIndex()
    ranked = spark.createDataFrame(
        named.map(lambda x: (x[0][0], x[0][1], x[1])),
        T.StructType([T.StructField("source", kind), T.StructField("source_size", T.LongType()), T.StructField("rank", T.LongType())]),
    )
    last = sizes.filter("source is null").select("source", "source_size", F.lit(ranked.count()).alias("rank"))
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = staged(ranked.unionByName(last).withColumn("weight", choice.cast("long")), "sources")
    cap = F.col("source_size") * F.lit(most)
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = cap < F.col("weight") * F.lit(level)
        held, open_ = table.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        new = (total - held) / open_ if open_ else level
        if not open_ or new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _cuts(rows: DataFrame, goal: DataFrame, few: bool, steps: tuple[int, ...] = (3, 6)) -> DataFrame:
    """(source, epochs, cut, part, tied) of each source: rows with keys below ``cut`` are taken once more than
    ``epochs`` times, and those of the key ``cut``, ``tied`` in all, give ``part``."""
    want = goal.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    )
    open_ = staged(
        want.select("*", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long").alias("left"), F.lit("").alias("prefix")), "goals"
    )
    running = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for step in (*steps, None):
        near = open_.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        # a source's open range: in each pass the rows are those that share its prefix
        near = F.broadcast(near) if few else near
        inside = rows.join(near, rows["source"].eqNullSafe(F.col("s")) & rows["key"].startswith(F.col("p"))) if step != steps[0] else rows
        k = F.substring("key", 1, step) if step else F.col("key")
        sums = inside.groupBy("source", k.alias("k")).agg(F.sum("size").alias("n"))
        summed = sums.withColumn("upto", F.sum("n").over(running)).withColumnsRenamed({"source": "s2"})
        hit = summed.join(open_, F.col("s2").eqNullSafe(F.col("source")))
        first = hit.filter(F.col("upto") > F.col("left")).groupBy("s2").agg(F.min(F.struct("k", "n", (F.col("upto") - F.col("n")).alias("before"))).alias("at"))
        joined = open_.join(first, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
        left = F.col("left") - F.coalesce(F.col("at.before"), F.lit(0))
        open_ = staged(
            joined.select("source", "source_size", "target", "epochs", left.alias("left"), F.col("at.k").alias("prefix"), F.col("at.n").alias("tied")), "goals"
        )
        if step:
            open_ = open_.drop("tied")
    return open_.select("source", "source_size", "target", "epochs", F.col("prefix").alias("cut"), F.col("left").alias("part"), "tied")


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``df`` with size, source_size, target (double) and taken (long), in words; repeats are counted in taken."""
    base = with_results(df, ["size", "source_size", "target", "taken"])
    s, k = free_name(base, "source_"), free_name(base, "key_")
    named = df.select(*cols(base), F.col(f"`{source}`").alias(s), size_of(text).alias("size"), _key(key).alias(k))
    narrow = staged(df.select(F.col(f"`{source}`").alias("source"), size_of(text).alias("size"), _key(key).alias("key")), "sizes")
    cuts = cut_table(narrow, **how)
    return _taken(named, cuts, base, s, k)


def _key(key: str) -> F.Column:
    return F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary"))


def cut_table(narrow: DataFrame, **how) -> DataFrame:
    sizes = staged(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    return staged(_cuts(narrow, targets(sizes, **how), sizes.count() <= FEW_SOURCES), "cuts")


def _taken(named: DataFrame, cuts: DataFrame, base: DataFrame, s: str, k: str) -> DataFrame:
    few = cuts.count() <= FEW_SOURCES
    c = cuts.withColumnsRenamed({x: f"{x}__" for x in cuts.columns})
    both = named.join(F.broadcast(c) if few else c, F.col(s).eqNullSafe(F.col("source__")), "left")
    more = (
        F.when(F.col("cut__").isNull() | (F.col(k) > F.col("cut__")), F.lit(0))
        .when(F.col(k) < F.col("cut__"), F.col("size"))
        .otherwise(F.floor(F.col("part__").cast("double") * F.col("size") / F.greatest(F.col("tied__"), F.lit(1))))
    )
    return both.select(
        *cols(base), "size", F.col("source_size__").alias("source_size"), F.col("target__").alias("target"),
        (F.col("epochs__") * F.col("size") + more).cast("long").alias("taken"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed: sources weigh 5, 2, 1 in turn and share 150% of all words, each up to twice its own."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


def digests(docs: DataFrame) -> DataFrame:
    facts = staged(docs.select("doc_id", "source", size_of("text").alias("size"), _key("doc_id").alias("key")), "sizes")
    cuts = cut_table(facts.select("source", "size", "key"))
    base = facts.select("doc_id")
    named = facts.select("doc_id", F.col("source").alias("source_"), "size", F.col("key").alias("key_"))
    return _taken(named, cuts, base, "source_", "key_")


#: Sources beyond those that are filled share what is left by weight: with sources by fill (cap per weight),
#: the first k whose next source isn't filled by the level after k.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s),
o AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST) AS n
  FROM r),
p AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM o),
l AS (SELECT arg_min((total - held) / open_w, n) AS level FROM p WHERE (total - held) / open_w <= cap / w),
t AS (SELECT source, source_size, least(cap, w * level) AS target FROM o, l),
e AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM t),
c AS (
  SELECT d.*, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS part,
         sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY d.source, key) AS tied
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN upto <= part THEN size WHEN upto - tied >= part THEN 0
            ELSE floor((part - (upto - tied))::DOUBLE * size / greatest(tied, 1)) END AS BIGINT) AS taken
FROM c
"""
