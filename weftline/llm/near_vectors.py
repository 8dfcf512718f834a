"""Operator 4: embedding near-dedup by an exact metric range join.

Equal vectors of a label are one class, with its number of members, before anything is compared. Class
representatives are scaled to length 1, where cosine >= t means a Euclidean distance of at most
r = sqrt(2 - 2 t). Only vectors of one label and length can link, so each such group is a space of its own, and a group that one
task can hold is one cell. Larger groups are split into cells by pivots. By the triangle inequality a vector x at distance d(x, p)
from its own pivot p can have neighbours in the cell of q only if d(x, q) <= d(x, p) + 2 r and
d(x, q) <= r + (radius of the cell), and, as x lies at most r beyond the plane halfway between the two pivots,
(d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= r. It is copied there only if q comes after p, so each pair of cells is compared
once. Cells are independent; one that is still too large is compared as pairs of blocks by different tasks.

How many pivots there are is measured: on a bounded sample the copies of a vector are counted for 1, 2, 4 ... pivots, times
the blocks that the cells would need, and the least number wins. Where distances are too much alike for pivots to prune (many
dimensions, no clusters) that is one pivot, so the copies are those of plain blocks, group size / block size, and never more.

In a cell rows are ordered by their distance from one of them, and by the triangle inequality only those whose distances
differ by at most r meet. Products in single precision decide what is clear beyond their rounding bound; the rest is computed in
double precision. A task counts links and keeps a spanning forest of those it finds; pairs don't leave it.

Nulls and rows: a vector that is null, empty, zero, or has a null or non-finite component, or a null label, links with
nothing and is its own component; vectors of different lengths aren't linked; rows with one vec_id (repeated rows) are
different vectors that name the same component; a null vec_id is never a component's name unless all its members' are
null, then it is null and kept; an empty table gives an empty result; extra columns stay unless they have a result's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cols, components, free_name, merge_labels, run_starts, split_hot, staged, whole_runs, with_results
from .vectors import distances, matrix, pivots, usable

#: Numbers in a block of vectors, at least and at most: a group of n vectors has blocks of n / ``PARTS`` within these bounds.
NUMBERS, MOST_NUMBERS, PARTS = 1 << 19, 1 << 22, 64
#: Pivots at most; vectors that their number is chosen on; vectors whose distances from all pivots are held at a time; large groups whose list is broadcast.
MOST_PIVOTS, PROBES, PLACED, LISTED = 1024, 1024, 256, 100_000
EPS = 1e-7
GROUP = ["label", "width"]


def link(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """``df`` with n_links, component_id and kept."""
    base = with_results(df, ["n_links", "component_id", "kept"])
    h1, h2, vid = (free_name(base, x) for x in ("h1", "h2", "vid"))
    ok = usable(F.col(f"`{vec}`")) & F.exists(f"`{vec}`", lambda x: x != 0) & F.col(f"`{label}`").isNotNull()
    number = "float" if df.schema[vec].dataType.elementType == T.FloatType() else "double"
    parts = F.col(f"`{label}`"), F.transform(f"`{vec}`", lambda x: (x.cast("double") + 0.0).cast(number))  # + 0.0: no negative zero
    # two hashes, 128 bits, tell classes apart
    first, second = F.when(ok, F.xxhash64(*parts)), F.xxhash64(F.lit("second"), *parts)
    named = df.select(*cols(base), first.alias(h1), second.alias(h2), F.col(f"`{vec_id}`").alias(vid))
    rows = df.filter(ok).select(first.alias("h1"), second.alias("h2"), parts[0].alias("label"), parts[1].alias("vec"), F.col(f"`{vec_id}`").alias("vid"))
    alike = F.first("vec").alias("vec"), F.first("label").alias("label"), F.count(F.lit(1)).alias("members"), F.min("vid").alias("vid")
    slim = staged(rows.groupBy("h1", "h2").agg(*alike).withColumns({"width": F.size("vec"), "node": F.monotonically_increasing_id()}), "classes")
    counts, edges = _join(slim, threshold)
    full = (
        slim.select("h1", "h2", "node", "members", "vid").join(counts, "node", "left").join(components(edges), "node", "left")
        .select("h1", "h2", (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"), "vid")
    )
    names = full.groupBy("root").agg(F.min("vid").alias("component_id"))
    facts = staged(full.join(names, "root").select(F.col("h1").alias("k1_"), F.col("h2").alias("k2_"), "n_links", "component_id"), "facts")
    out = named.join(facts, (F.col(h1) == F.col("k1_")) & (F.col(h2) == F.col("k2_")), "left")
    comp = F.when(F.col("k1_").isNull(), F.col(vid)).otherwise(F.col("component_id"))
    return out.select(
        *cols(base), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col(vid).eqNullSafe(comp).alias("kept")
    )


def _join(slim: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, near: members of the classes linked with it) and the edges (src, dst) of spanning forests."""
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + EPS
    sizes = slim.groupBy(*GROUP).count()
    largest, widest = sizes.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.max("width"), F.lit(1))).first()
    most = max(2, min(MOST_NUMBERS // widest, max(NUMBERS // widest, largest // PARTS)))
    vectors = slim.select(*GROUP, "vec", "node", "members")
    placed = _whole(vectors)
    if largest > most:
        large = staged(sizes.filter(F.col("count") > most), "large")
        n, rows = large.agg(F.count(F.lit(1)), F.sum("count")).first()
        listed = large.drop("count")
        listed = F.broadcast(listed) if n <= LISTED else listed
        small, rest = vectors.join(listed, GROUP, "left_anti"), vectors.join(listed, GROUP, "left_semi")
        placed = _whole(small).unionByName(_cells(rest, rows / n, r, most, widest))
    keys = [*GROUP, "cell", "bi", "bj"]

    def compare(batches):
        for table in whole_runs(batches, keys):
            starts = run_starts(table, keys).tolist()
            for a, z in zip(starts, [*starts[1:], table.num_rows], strict=True):
                if z - a > 1:
                    yield from _links(table.slice(a, z - a).combine_chunks(), threshold, r)

    order = split_hot(placed, keys[:3], "node", most).repartition(*keys).sortWithinPartitions(*keys)
    linked = staged(order.mapInArrow(compare, "node long, near long, src long, dst long"), "links")
    counts = linked.filter("node is not null").groupBy("node").agg(F.sum("near").alias("near"))
    return counts, linked.filter("src is not null").select("src", "dst")


def _whole(vectors: DataFrame) -> DataFrame:
    """Every group one cell."""
    return vectors.select("*", F.lit(0).cast("long").alias("cell"), F.lit(1).alias("home"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _visits(x: np.ndarray, p: np.ndarray, r: float, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of unit vectors: its own pivot, the distance from it, and the cells it goes to (radii as far as known)."""
    d = distances(x, p)
    home = d.argmin(1)
    own = d[np.arange(len(d)), home]
    if radius is None:
        radius = np.full(len(p), -np.inf)
        np.maximum.at(radius, home, own)
    go = (d <= own[:, None] + 2 * r) & (d <= radius[None, :] + r) & (np.arange(len(p))[None, :] > home[:, None])
    gap = distances(p[home], p)
    go &= (d * d - own[:, None] ** 2 <= 2 * r * gap + EPS) | (gap < 1e-3)
    go[np.arange(len(d)), home] = True
    return home, own, go


def choose(sample: np.ndarray, size: float, r: float, most: int) -> np.ndarray:
    """Of the first vectors of the sample as many as make the fewest copies of a vector in a group of ``size``, the others being counted."""
    half = (len(sample) + 1) // 2
    drawn, probes = sample[: min(half, MOST_PIVOTS)], sample[half:]
    best, least, n = drawn[:1], float(np.ceil(size / most)), 2
    while n <= len(drawn) and len(probes):
        copies = _visits(probes, drawn[:n], r)[2].sum() / len(probes)
        total = copies * np.ceil(max(1.0, size * copies / n / most))
        if total < least:
            best, least = drawn[:n], total
        n *= 2
    return best


def _cells(vectors: DataFrame, size: float, r: float, most: int, widest: int) -> DataFrame:
    """Vectors of large groups, ``size`` in the mean, in the cells of pivots, with copies at the boundaries."""
    spark = vectors.sparkSession
    # pivots of all lengths of vectors are compared in one space, shorter ones filled with zeros
    p = choose(_unit(pivots(vectors, "vec", max(4, min(MOST_PIVOTS + PROBES, 2 * MOST_NUMBERS // widest)))), size, r, most)
    if len(p) < 2:
        return _whole(vectors)
    shared = spark.sparkContext.broadcast(p)  # MOST_PIVOTS vectors and MOST_NUMBERS numbers at most
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.LongType()), T.StructField("home", T.IntegerType())])

    def units(batches):
        for batch in (whole.slice(a, PLACED) for whole in batches for a in range(0, whole.num_rows, PLACED)):
            x, c = matrix(batch.column("vec")), shared.value
            width = max(x.shape[1], c.shape[1])
            yield batch, _unit(np.pad(x, ((0, 0), (0, width - x.shape[1])))), np.pad(c, ((0, 0), (0, width - c.shape[1])))

    def reach(batches):
        far = np.full(len(shared.value), -1.0)
        for _, x, c in units(batches):
            home, own, _ = _visits(x, c, r)
            np.maximum.at(far, home, own)
        g = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(far[g])], names=["pivot", "radius"])

    radius = np.full(len(p), EPS)
    for row in vectors.mapInArrow(reach, "pivot int, radius double").groupBy("pivot").agg(F.max("radius").alias("radius")).collect():
        radius[row.pivot] = row.radius + EPS  # a row for each pivot

    def assign(batches):
        for batch, x, c in units(batches):
            home, _, go = _visits(x, c, r, radius)
            i, cell = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(i)).columns, pa.array(cell), pa.array((cell == home[i]).astype(np.int32))], names=schema.names)

    return staged(vectors.mapInArrow(assign, schema), "cells")


def _links(cell: pa.Table, threshold: float, r: float, rows: int = 256):
    """Counts of links by node, and a spanning forest of them, for one cell or pair of blocks."""
    x = _unit(matrix(cell["vec"]))
    from_first = distances(x, x[:1])[:, 0]
    order = np.argsort(from_first, kind="stable")
    x, from_first = x[order], from_first[order]
    rough, error = x.astype(np.float32), (x.shape[1] + 8) * 6e-8
    node, members = cell["node"].to_numpy()[order], cell["members"].to_numpy()[order].astype(np.float64)
    home, block = cell["home"].to_numpy()[order].astype(bool), cell["block"].to_numpy()[order]
    apart, copied = cell["bi"][0].as_py() != cell["bj"][0].as_py(), not home.all()
    n = len(x)
    near, label = np.zeros(n, dtype=np.int64), np.arange(n)
    for a in range(0, n, rows):
        z = min(n, a + rows)
        lo, hi = np.searchsorted(from_first, [from_first[a] - r - EPS, from_first[z - 1] + r + EPS])
        score = rough[a:z] @ rough[lo:hi].T
        hit = score >= threshold - error
        i, j = np.nonzero(hit & (score < threshold + error))
        for b in range(0, len(i), 1 << 14):
            k, m = i[b : b + (1 << 14)], j[b : b + (1 << 14)]
            hit[k, m] = np.einsum("ij,ij->i", x[a + k], x[lo + m]) >= threshold
        if copied:
            hit &= home[a:z, None] | home[None, lo:hi]
        if apart:
            hit &= block[a:z, None] != block[None, lo:hi]
        hit[np.arange(z - a), np.arange(a - lo, z - lo)] = False
        near[a:z] = hit @ members[lo:hi]
        i, j = np.nonzero(hit)
        i, j = i + a, j + lo
        new = (j > i) & (label[i] != label[j])
        label = merge_labels(label, i[new], j[new])
    some = np.flatnonzero(near)
    if len(some):
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(near[some]), none, none], names=["node", "near", "src", "dst"])
        i = np.flatnonzero(label != np.arange(n))
        none = pa.nulls(len(i), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(node[label[i]]), pa.array(node[i])], names=["node", "near", "src", "dst"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` linked within labels at cosine 0.93."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return link(vectors).select("vec_id", "n_links", "component_id", "kept")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
w AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS v, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v),
c AS (SELECT v, min(root) AS component_id FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.v = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
