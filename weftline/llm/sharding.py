"""Operator 2: sharding by a minimax contiguous partition.

Rows are grouped by a 64-bit hash of their key (equal texts are one atomic group; two texts whose hashes collide
merely share a shard), and groups are ordered by that hash. The smallest feasible capacity is found by binary
search, a greedy check deciding each candidate, and the order is cut there.

At any size the driver sees only bin sums: the hash space is split into 2**FIRST_BITS bins, and only the bins in which
cuts can fall are split again, level by level, until their few groups can be listed. A group larger than an even share
(there are fewer of them than shards) gets a shard of its own before the rest is partitioned, which keeps the
remaining shards even. Rows are not shuffled: a row's shard follows from its hash and at most
``shards`` bounds, and its slot from its place in its task plus an offset per task and shard.

Nulls and rows: a null text has size 1 and checksum 0 and forms one group with the other nulls (texts that are empty are
another group); repeated rows each get a slot; empty input gives an empty result; columns named like a result give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cols, free_name, staged, with_results

#: Leading bits of the hash that the first bins share (so many bins, and groups that exceed a bin's even part, reach the
#: driver at most); bits that split an open bin; groups that are listed on the driver at most.
FIRST_BITS, MORE_BITS, LISTED = 16, 6, 50_000
RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _check(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where greedy filling ends each shard (as counts of groups), or None if ``shards`` are too few."""
    ends, held = [], 0
    for i, s in enumerate(sizes):
        if s > capacity:
            return None
        if held + s > capacity:
            ends.append(i)
            held = 0
            if len(ends) == shards:
                return None
        held += s
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which contiguous filling needs at most ``shards`` shards."""
    lo, hi = max([-(-sum(sizes) // shards), *sizes], default=0), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if _check(sizes, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def even_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts (counts of groups, shards - 1 of them) with the smallest capacity, each as near its even place as that allows."""
    n, total = len(sizes), sum(sizes)
    c = smallest_capacity(sizes, shards)
    sums = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]) if n else np.zeros(1, dtype=np.int64)
    earliest, at = [], n  # of each cut, if the shards behind it are to hold the rest
    for _ in range(shards - 1):
        at = int(np.searchsorted(sums, sums[at] - c, side="left"))
        earliest.append(at)
    cuts, last = [], 0
    for k, low in enumerate(reversed(earliest), 1):
        high = int(np.searchsorted(sums, sums[last] + c, side="right")) - 1
        want = total * k / shards
        i = int(np.searchsorted(sums, want))
        if i and abs(sums[i - 1] - want) <= abs(sums[min(i, n)] - want):
            i -= 1
        last = max(min(max(i, low), high), last)
        cuts.append(last)
    return cuts


def _bounds(groups: DataFrame, heavy: list[tuple[int, int]], shards: int, first_bits: int = FIRST_BITS, listed: int = LISTED) -> list[int]:
    """Hash values at which shards 1, 2, ... begin. ``groups``: (h, size) of the groups that aren't ``heavy``.

    Heavy groups are exact items throughout. The others are summed by the leading bits of h. A cut lies within
    shards * (largest bin) of where the bins put it, so only bins that near are split by further bits; the rest
    stay whole. When the open bins have few groups, those are listed and the cuts are exact.
    """
    shift, open_, closed = 64 - first_bits, None, []
    while True:
        rows = groups if open_ is None else groups.filter(F.shiftright("h", shift + MORE_BITS).isin(open_))
        if open_ is not None and (shift < 0 or rows.count() <= listed):
            items = sorted([*closed, *heavy, *((r.h, r.size) for r in rows.collect())])
            break
        found = [(r.b << shift, r.size) for r in rows.groupBy(F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("size")).collect()]
        items = sorted([*closed, *heavy, *found])
        slack = shards * max((s for _, s in found), default=0)
        ends = np.cumsum([s for _, s in items]).tolist()
        at = [ends[i - 1] if i else 0 for i in even_cuts([s for _, s in items], shards)]
        bins = set(found)
        near = {x for x, z in zip(items, ends, strict=True) if x in bins and any(z - x[1] - slack <= c <= z + slack for c in at)}
        closed += [x for x in found if x not in near]
        open_ = [h >> shift for h, _ in near]
        if not open_:
            break
        shift -= MORE_BITS
    return [items[i][0] if i < len(items) else 2**63 for i in even_cuts([s for _, s in items], shards)]


def plan(groups: DataFrame, shards: int, **how) -> tuple[list[int], list[int]]:
    """Hashes of the groups with shards of their own (shards 0, 1, ...), and the bounds of the other shards."""
    total = left = groups.agg(F.sum("size")).first()[0] or 0
    at_least = max(1, total >> how.get("first_bits", FIRST_BITS))
    heavy = sorted(((r.h, r.size) for r in groups.filter(F.col("size") > at_least).collect()), key=lambda x: (-x[1], x[0]))
    own: list[int] = []
    for h, size in heavy:
        if shards - len(own) > 1 and size * (shards - len(own)) >= left:
            own.append(h)
            left -= size
    light = groups.filter(F.col("size") <= at_least)
    return own, _bounds(light, [x for x in heavy if x[0] not in set(own)], shards - len(own), **how)


def shard(df: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """``df`` with size, text_crc32, shard and slot (long, gapless from 0 in each shard), sizes near equal."""
    base = with_results(df, RESULTS)
    h = free_name(base, "h")
    return _place(_facts(df, base, text, h), base.columns, h, shards)


def _facts(df: DataFrame, base: DataFrame, text: str, h: str) -> DataFrame:
    raw = F.encode(F.col(f"`{text}`"), "UTF-8")
    return df.select(
        *cols(base),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(42)).alias(h),
    )


def _place(table: DataFrame, names: list[str], h: str, shards: int) -> DataFrame:
    """``table`` (columns ``names``, size, text_crc32 and the group's hash ``h``) with shard and slot."""
    pid, place = (free_name(table, x) for x in ("task", "place"))
    kept = [F.col(f"`{c}`") for c in names]
    groups = staged(table.groupBy(F.col(h).alias("h")).agg(F.sum("size").alias("size")), "groups")
    own, bounds = plan(groups, shards)
    at = F.lit(len(own))
    for b in bounds:
        if b < 2**63:
            at = at + (F.col(h) >= F.lit(b)).cast("int")
        # a bound beyond the last group leaves its shard empty
    for k, v in enumerate(own):
        at = F.when(F.col(h) == F.lit(v), F.lit(k)).otherwise(at)
    dealt = table.select(*kept, "size", "text_crc32", at.cast("int").alias("shard"))
    schema = T.StructType([*dealt.schema.fields, T.StructField(pid, T.IntegerType()), T.StructField(place, T.LongType())])

    def number(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(shards, dtype=np.int64)
        for batch in batches:
            s = batch.column(batch.num_columns - 1).to_numpy()
            order = np.argsort(s, kind="stable")
            counts = np.bincount(s, minlength=shards)
            rank = np.empty(len(s), dtype=np.int64)
            rank[order] = np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)
            out = [*batch.columns, pa.array(np.full(len(s), task, dtype=np.int32)), pa.array(rank + seen[s])]
            seen += counts
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    placed = staged(dealt.mapInArrow(number, schema), "placed")
    tally = placed.groupBy("shard", pid).agg((F.max(place) + 1).alias("n"))
    before = Window.partitionBy("shard").orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("shard", pid, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    skip = F.col("skip") + F.col(place)
    return placed.join(offsets, ["shard", pid]).select(*kept, "size", "text_crc32", "shard", skip.cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards of near equal bytes, equal texts together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, 16)


def digests(docs: DataFrame, shards: int) -> DataFrame:
    """The contract's columns; texts are read once, for their sizes, checksums and hashes."""
    facts = staged(_facts(docs, docs.select("doc_id"), "text", "h"), "facts")
    placed = _place(facts, ["doc_id"], "h", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
