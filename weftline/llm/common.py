"""What the operators of this subpackage share: scratch tables, runs, hot keys, components."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches, tidied  # noqa: F401, what the operators share

_SCRATCH: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of our own. On a cluster the setting names storage
    that the driver and every executor see; without it there is no such place, and that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to storage that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="weftline-")
            spark.sparkContext.setCheckpointDir(base)
        _SCRATCH[app] = f"{base.rstrip('/')}/weftline-{app}"
        atexit.register(_forget, spark, app)
    return _SCRATCH[app]


def _forget(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop_path(spark, _SCRATCH[app])
    except Exception:  # the JVM may have ended already; the folder is scratch only
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, a lost executor costs a re-read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared storage as a path that workers can memory-map.

    The storage must be mounted (``file:`` or a plain path); an object store can't be mapped.
    """
    path = new_path(spark, name)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    elif "://" in path:
        raise ValueError(f"memory-mapped models need spark.checkpoint.dir on a mounted shared file system, not {path}")
    os.makedirs(path, exist_ok=True)
    return path


def put_file(path: str, data: bytes | np.ndarray) -> None:
    """Write whole or not at all, so that a retried or doubled task leaves one good file."""
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with open(tmp, "wb") as f:
        f.write(np.ascontiguousarray(data).tobytes() if isinstance(data, np.ndarray) else data)
    os.replace(tmp, path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in have:
        n += 1
        name = f"{base}_{n}"
    return name


def with_results(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that the results replace; an input column of a result's name gives way."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def cols(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def chunks_by_bytes(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, held = 0, 0
    for i in range(n):
        if held and held + sizes[i] > limit:
            yield start, i
            start, held = i, 0
        held += int(sizes[i])
    yield start, n


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal ``keys`` from a partition sorted by them.

    Holds one run and a batch at a time; callers bound the length of a run.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = run_starts(table, keys)[-1]
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
        else:
            held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = table[k].to_numpy()
        differ = v[1:] != v[:-1]
        if v.dtype.kind == "f":
            differ &= ~(np.isnan(v[1:]) & np.isnan(v[:-1]))  # Spark's keys hold NaN equal to itself
        new[1:] |= differ
    return np.flatnonzero(new)


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each entry names its root, the smallest index) after linking every i with its j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt


def split_hot(rows: DataFrame, key: str | list[str], spread: str, most: int, small_list: int = 100_000, weight: str | None = None) -> DataFrame:
    """``rows`` with ``bi``, ``bj`` and ``block``, such that every two rows of a key meet in exactly one (key, bi, bj).

    A key of up to ``most`` rows stays whole (bi = bj = block = 0). The rows of a larger one are dealt by the
    hash of the long ``spread`` to blocks of about ``most`` rows; the rows of one block meet where bi = bj,
    those of two blocks where bi < bj, and there rows of one block aren't to be compared. With ``weight``, ``most`` bounds its sum
    instead of the number of rows. The list of larger keys is broadcast only when counted and short; a longer one is joined
    by shuffling.
    """
    key = [key] if isinstance(key, str) else key
    held = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hot = staged(rows.groupBy(*key).agg(held.alias("held_")).filter(F.col("held_") > most).select(*key, F.ceil(F.col("held_") / most).cast("int").alias("nb")), "hot")
    n = hot.count()
    whole = lambda df: df.withColumns({x: F.lit(0) for x in ("bi", "bj", "block")})
    if not n:
        return whole(rows)
    listed = F.broadcast(hot) if n <= small_list else hot
    dealt = (
        rows.join(listed, key)
        .withColumn("block", F.pmod(F.xxhash64(spread), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("bi", F.least("block", "other"))
        .withColumn("bj", F.greatest("block", "other"))
        .select(*rows.columns, "bi", "bj", "block")
    )
    return whole(rows.join(listed, key, "left_anti")).unionByName(dealt)


#: Bits of a sieve at least and at most: 16 MB are broadcast whatever the input; places of a sieve for each key while they last.
SIEVE_BITS, MOST_SIEVE_BITS, SPARSE = 1 << 15, 1 << 27, 64
_PAGE = 32768  # bits in one of Spark's bitmaps


def sieved(rows: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only if the long ``key`` is surely none of the longs of ``wanted`` (its only column).

    A bitmap of hashes, built where the keys are, and looked up without a shuffle of ``rows``. It has ``MOST_SIEVE_BITS`` at
    most, so with very many keys it lets more pass, and with more than half as many keys as bits everything: a saving, never a decision.
    """
    n = wanted.count()
    if n > MOST_SIEVE_BITS // 2:
        return rows.withColumn(flag, F.lit(True))
    bits = SIEVE_BITS
    while bits < min(MOST_SIEVE_BITS, SPARSE * n):
        bits *= 2
    at, page, held = (free_name(rows, x) for x in ("at_", "page_", "map_"))
    place = lambda c: F.pmod(F.xxhash64(F.lit("sieve"), c), F.lit(bits))
    paged = wanted.select(place(F.col(wanted.columns[0])).alias(at))
    pages = paged.groupBy(F.floor(F.col(at) / _PAGE).cast("int").alias(page)).agg(F.bitmap_construct_agg(F.col(at) % _PAGE).alias(held))
    looked = rows.withColumn(at, place(F.col(f"`{key}`"))).withColumn(page, F.floor(F.col(at) / _PAGE).cast("int"))
    byte = F.conv(F.hex(F.substring(held, ((F.col(at) % _PAGE) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    both = looked.join(F.broadcast(pages), page, "left")  # MOST_SIEVE_BITS / 32768 rows of 4 KB at most
    return both.withColumn(flag, F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))).select(*cols(rows), flag)


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst: long); root is the component's smallest node.

    Rounds of hooking each node to its smallest neighbour, jumping pointers, and contracting. Every table of
    a round is written to the shared folder, and goes when the next round's are there; nothing but row counts reaches the driver. Joins
    are plain equi-joins, which adaptive execution splits when a root is hot.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = new_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    ordered = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e, at = kept(ordered(edges, "src", "dst").filter("a < b").distinct(), "edges")
    found, found_at = None, ""
    while not e.isEmpty():
        used = [at]
        both = e.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("near")))
        up, at = kept(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "up")
        for _ in range(jumps):
            used.append(at)
            top = up.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            up, at = kept(up.join(top, "root").select("node", F.col("upper").alias("root")), "up")
        to_a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = e.join(to_a, "a").join(to_b, "b").filter("ra <> rb")
        if found is None:
            found, found_at = up, at
        else:
            used += [at, found_at]
            moved = up.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            found, found_at = kept(found.join(moved, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "found")
        # nodes that stopped short of their root keep an edge to where they stopped
        e, at = kept(ordered(left, "ra", "rb").distinct(), "edges")
        for path in used:
            drop_path(spark, path)
    if found is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    drop_path(spark, at)
    return found
