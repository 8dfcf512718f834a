"""Operator 10: exact top-k search by inner product, as a Voronoi kNN join.

Components become whole numbers, floor(scale * x). With M the largest length of a vector, a data vector y is
extended by sqrt(M * M - |y|^2) and a query by 0; then |q - y|^2 = |q|^2 + M * M - 2 q.y for the extended vectors, so
the largest inner products are the nearest neighbours, and the triangle inequality holds. Queries and data are
grouped by the same pivots. From each data group's summary (the k + 1 smallest distances from its pivot, of different ids) and a query
group's radius follows a bound within which every query of the group has k neighbours; a data vector is
copied to a query group only if its distance from that group's pivot allows one of them.

Query groups that need nearly the same data vectors, by a bounded sample of these, are solved together, up to ``QUERIES`` queries: a
vector then goes there once. Where bounds don't prune, the copies are those of a blocked scan, queries / ``QUERIES``. Groups are
solved locally; one with more than ``BLOCK`` data vectors or ``QUERIES`` queries is solved as pairs of blocks by different
tasks. The k best of each query and block are merged by a window.

Scores are exact: products are summed as doubles while every sum stays below 2^53, else as Python's whole numbers
(ranked in full, clipped to 64 bits at the end). Components travel as 32-bit numbers where all fit.

Nulls and rows: vectors that are null, empty, or hold a null or non-finite component take no part, as queries or as
candidates; a shorter vector counts as filled up with zeros; equal scores rank the smaller vec_id first; a query's own row
is no candidate, and with repeated ids no row of its id is; repeated candidates are candidates each; null ids take no part; an
empty table gives an empty result; the result has its own columns only, whatever the input's are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import run_starts, staged, whole_runs
from .vectors import distances, matrix, pivots, usable

#: Data vectors and queries that meet in one task at a time, and numbers of these vectors; queries scored at a time.
BLOCK, QUERIES, NUMBERS, SCORED = 8192, 4096, 1 << 21, 256
#: Queries for each pivot; pivots at most; data vectors that groups are joined by; vectors whose distances from all pivots are held at a time.
PER_PIVOT, MOST_PIVOTS, PROBES, PLACED = 64, 1024, 1024, 256
#: Groups are joined as long as pairs to score grow by this at most.
MORE_PAIRS = 1.25
EXACT = 2.0**53


def search(data: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vec: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``data`` with the highest scores for each row of ``queries``."""
    spark = data.sparkSession
    kind = data.schema[vec_id].dataType.simpleString()

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vec}`")
        return df.filter(usable(v) & F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").alias("id"), v.alias("vec"))

    def sizes(batches):
        """Of each batch: the largest square of a length, the largest width, the number of rows."""
        for batch in batches:
            if batch.num_rows:
                x = np.floor(matrix(batch.column("vec")) * scale)
                yield pa.RecordBatch.from_pydict({"top": [float((x * x).sum(1).max())], "width": pa.array([x.shape[1]], pa.int32()), "n": [batch.num_rows]})

    measured = lambda df: df.mapInArrow(sizes, "top double, width int, n long").agg(F.max("top"), F.max("width"), F.sum("n")).first()
    (top, width, n), (q_top, q_width, nq) = measured(clean(data)), measured(clean(queries))
    if not n or not nq:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    width = max(width, q_width)
    number = ("int", np.int32) if max(top, q_top) < 2.0**60 else ("double", np.float64)

    def whole(batches):
        for batch in batches:
            x = np.floor(matrix(batch.column("vec"), width) * scale).astype(number[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(x)], names=["id", "vec"])

    numbers = lambda df, name: staged(clean(df).mapInArrow(whole, f"id {kind}, vec array<{number[0]}>"), name)
    d, q = numbers(data, "data"), numbers(queries, "queries")

    sample = pivots(d, "vec", min(MOST_PIVOTS + PROBES, max(2, 4 * NUMBERS // width)))
    stretch = lambda x, query: np.concatenate([x, np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], axis=1)
    p = stretch(sample[: max(1, min(MOST_PIVOTS, nq // PER_PIVOT, (len(sample) + 1) // 2))], False)
    shared = spark.sparkContext.broadcast(p)  # MOST_PIVOTS vectors and 4 * NUMBERS numbers at most
    slack = 1e-6 * (1 + np.sqrt(top)) + 1e-6

    def placed(batches, query: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for a in range(0, batch.num_rows, PLACED):
                part = batch.slice(a, PLACED)
                yield part, distances(stretch(matrix(part.column("vec"), width), query), shared.value)

    def farthest(batches):
        """By group: the largest distance of queries from their pivot, and how many there are."""
        most, count = np.full(len(shared.value), -1.0), np.zeros(len(shared.value), dtype=np.int64)
        for _, dist in placed(batches, True):
            home = dist.argmin(1)
            np.maximum.at(most, home, dist[np.arange(len(dist)), home])
            count += np.bincount(home, minlength=len(count))
        g = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(most[g]), pa.array(count[g])], names=["g", "d", "n"])

    def nearest(batches):
        """By group: the k + 1 ids with the smallest distances of data vectors from their pivot."""
        best: dict[int, dict] = {}
        for part, dist in placed(batches, False):
            home, ids = dist.argmin(1), part.column("id").to_pylist()
            for g, at, own in zip(home.tolist(), ids, dist[np.arange(len(dist)), home].tolist(), strict=True):
                mine = best.setdefault(g, {})
                if len(mine) <= k or own < max(mine.values()):
                    mine[at] = min(own, mine.get(at, own))
                    if len(mine) > k + 1:
                        del mine[max(mine, key=mine.get)]
        rows = [(g, i, d) for g, mine in best.items() for i, d in mine.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], part_type), pa.array([r[2] for r in rows], pa.float64())], names=["g", "id", "d"])

    part_type = to_arrow_type(d.schema["id"].dataType)
    far = q.mapInArrow(farthest, "g int, d double, n long").groupBy("g").agg(F.max("d").alias("d"), F.sum("n").alias("n")).collect()
    least = d.mapInArrow(nearest, f"g int, id {kind}, d double").groupBy("g", "id").agg(F.min("d").alias("d"))
    near = least.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("d"))).filter(F.col("n") <= k + 1).collect()
    far.sort(key=lambda r: r.g)  # MOST_PIVOTS rows at most, and k + 1 times as many of near
    names, asked = np.array([r.g for r in far]), np.array([r.n for r in far])
    limits = np.array([r.d for r in far]) + slack
    between, at, own = distances(p, p)[names], np.array([r.g for r in near]), np.array([r.d for r in near])
    for i in range(len(names)):
        limits[i] += far[i].d + _bound([r.id for r in near], between[i, at] + own, k)

    probes = distances(stretch(sample, False), p)[:, names] <= limits[None, :]
    team = together(probes, asked)  # of each query group
    teams = int(team.max()) + 1
    lookup = np.zeros(len(p), dtype=np.int64)
    lookup[names] = team

    def useful(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, team) of each copy of a data vector."""
        go = dist[:, names] <= limits[None, :]
        each = np.zeros((len(go), teams), dtype=bool)
        for t in range(teams):
            each[:, t] = go[:, team == t].any(1)
        return np.nonzero(each)

    def copies(batches):
        count = np.zeros(teams, dtype=np.int64)
        for _, dist in placed(batches, False):
            count += np.bincount(useful(dist)[1], minlength=teams)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(teams)), pa.array(count)], names=["c", "n"])

    # how many blocks each team has, of data and of queries
    block, most_queries = max(1, min(BLOCK, NUMBERS // width)), max(1, min(QUERIES, NUMBERS // width))
    data_blocks = np.ones(teams, dtype=np.int64)
    for row in d.mapInArrow(copies, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        data_blocks[row.c] = max(1, -(-row.n // block))
    query_blocks = np.maximum(1, -(-np.bincount(team, asked, teams).astype(np.int64) // most_queries))

    def spread(batches, query: bool):
        for part, dist in placed(batches, query):
            i, c = (np.arange(len(dist)), lookup[dist.argmin(1)]) if query else useful(dist)
            mine = part.take(pa.array(i))
            counts = [pa.array(x[c].astype(np.int32)) for x in (data_blocks, query_blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c), mine.column("id"), mine.column("vec"), *counts], names=["g", "id", "vec", "dbs", "qbs"])

    schema = f"g long, id {kind}, vec array<{number[0]}>, dbs int, qbs int"
    of = lambda blocks: F.pmod(F.xxhash64("id", "vec"), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    ys = d.mapInArrow(lambda b: spread(b, False), schema).select("g", "id", "vec", F.lit(0).alias("side"), of("dbs").alias("db"), every("qbs").alias("qb"))
    xs = q.mapInArrow(lambda b: spread(b, True), schema).select("g", "id", "vec", F.lit(1).alias("side"), every("dbs").alias("db"), of("qbs").alias("qb"))
    keys = ["g", "db", "qb"]
    longest = float(max(top, q_top)) ** 0.5
    fits = longest * max(longest, 1.0) < EXACT

    def solve(batches):
        for table in whole_runs(batches, keys, 4096):
            starts = run_starts(table, keys).tolist()
            for a, z in zip(starts, [*starts[1:], table.num_rows], strict=True):
                side = table["side"].slice(a, z - a).to_numpy()
                m = int((side == 0).sum())
                if m and m < z - a:
                    yield from _best(table.slice(a, m), table.slice(a + m, z - a - m), k, width, fits)

    met = ys.unionByName(xs).repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    partial = met.mapInArrow(solve, f"query_id {kind}, vec_id {kind}, score long, beyond string")
    ranked = Window.partitionBy("query_id").orderBy(F.col("beyond").desc(), F.col("score").desc(), "vec_id")
    best = partial.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return staged(best.select("query_id", "rank", "vec_id", "score"), "best")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _bound(ids: list, far: np.ndarray, k: int) -> float:
    """The (k + 1)-th smallest of ``far`` of different ids; the one more is for a query's own."""
    seen = set()
    for i in np.argsort(far, kind="stable").tolist():
        seen.add(ids[i])
        if len(seen) > k:
            return float(far[i])
    return np.inf


def together(needs: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The team of each query group. needs: which of some data vectors (rows) a group (columns) needs; asked: its queries.

    Groups join the team where pairs to score grow least, if they grow by ``MORE_PAIRS`` at most, else they begin one.
    """
    team = np.zeros(needs.shape[1], dtype=np.int64)
    union, held, pairs = np.zeros((0, len(needs)), dtype=bool), np.zeros(0), np.zeros(0)
    for g in np.argsort(-needs.sum(0), kind="stable").tolist():
        mine = needs[:, g]
        alone = float(asked[g]) * max(1, mine.sum())
        grown = (held + asked[g]) * np.maximum(1, (union | mine).sum(1))
        ok = np.flatnonzero((held + asked[g] <= QUERIES) & (grown <= MORE_PAIRS * (pairs + alone)))
        if len(ok):
            t = ok[np.argmin(grown[ok] - pairs[ok])]
            union[t] |= mine
        else:
            t = len(held)
            union, held, pairs = np.concatenate([union, mine[None, :]]), np.append(held, 0.0), np.append(pairs, 0.0)
        team[g] = t
        held[t] += asked[g]
        pairs[t] += alone
    return team


def _best(data: pa.Table, queries: pa.Table, k: int, width: int, fits: bool) -> Iterator[pa.RecordBatch]:
    """``data`` is sorted by id, so that among equal scores the first are the smallest ids."""
    y, x = matrix(data["vec"], width), matrix(queries["vec"], width)
    ids, asked = data["id"].to_numpy(), queries["id"].to_numpy()
    safe = fits and np.abs(x).sum(1).max() * np.abs(y).max(initial=0) < EXACT
    if not safe:
        exact = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object)
        x, y = exact(x), exact(y)
    for a in range(0, len(x), SCORED):
        yield _picked(x[a : a + SCORED] @ y.T, ids, asked[a : a + SCORED], k)


def _picked(score: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int) -> pa.RecordBatch:
    out_q, out_i, out_s = [], [], []
    beyond: list[str | None] = []  # scores of any size as strings in their order
    for row, me in zip(score, asked, strict=True):
        at = np.flatnonzero(ids != me)
        s = row[at]
        if len(s) > k:
            least = np.sort(s)[-k] if s.dtype == object else np.partition(s, len(s) - k)[len(s) - k]
            over = np.flatnonzero(s > least)
            pick = np.concatenate([over, np.flatnonzero(s == least)[: k - len(over)]])
            at, s = at[pick], s[pick]
        out_q.append(np.full(len(at), me))
        out_i.append(ids[at])
        out_s += [max(-(2**63), min(2**63 - 1, int(v))) for v in s]
        beyond += [None] * len(s) if s.dtype != object else [str(v + 10**99).zfill(100) for v in s]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_i)), pa.array(out_s, pa.int64()), pa.array(beyond, pa.string())], names=["query_id", "vec_id", "score", "beyond"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all ``embeddings`` for each whose vec_id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
