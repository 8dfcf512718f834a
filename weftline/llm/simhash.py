"""Operator 9: SimHash near-dedup by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at most three bits differ in at most
three bytes, so they share at least five of the eight (position, byte) items, and then at least three of one half:
of positions 0-3 or of 4-7. The index therefore keeps, for each half, posting lists of three positional bytes at once
(eight lists a fingerprint, each of 2^24 values), which no qualifying pair escapes. Within a list each pair's shared
positional bytes are tallied, pairs below five are dropped, and the others are verified bit by bit.

Equal fingerprints are one class before they are indexed. Tasks emit a spanning forest of each list's links, never
the pairs. A list longer than ``LIST`` is compared as pairs of blocks by different tasks, whole.

``keep_one`` with a similarity doesn't rest on three bits: shingles of Jaccard 0.8 differ in about 9.5 bits, which byte
positions can't find. There links of the index and equal bands of minimum hashes only propose candidates, which
are joined to components; with ``BANDS`` bands of ``ROWS`` hashes a pair at 0.8 is missed with probability
(1 - 0.8^ROWS)^BANDS = 0.00007. Each text of a component goes to tasks that count the Jaccard similarities of sets of shingles exactly.
A component that one task can't hold is dealt to blocks: first the texts of each block are compared, then one text of each group that was
found, and only texts of groups that are still apart meet again, all with all. So a large group of copies is read about once,
and no link is lost.

Nulls and rows: a null text and a text without words have fingerprint zero and link with each other; fewer words than a
shingle's are one shingle; a null doc_id takes its component's smallest id, null if it has none; rows, repeated or not, each
give a row; an empty table gives an empty result; columns named like a result give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cols, components, free_name, merge_labels, run_starts, sieved, split_hot, staged, tidied, whole_runs, with_results

SEED = 42
BITS = 3
LIST = 4096
SHARED = 8 - BITS
#: Bands of minimum hashes, and hashes in each; texts, and their bytes, in a block of those whose sets of shingles meet in a task.
BANDS, ROWS, SETS, BYTES = 24, 5, 1024, 8 << 20
_odd = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int) -> list[int]:
    """The hash of each shingle of ``width`` words, in order; none without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return [digest(line, SEED)]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    stops = np.cumsum(sizes + 1) - 1
    starts = (stops - sizes)[: n - width + 1].tolist()
    return [digest(line[a:z], SEED) for a, z in zip(starts, stops[width - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of a whole text, of shingles of ``width`` words."""
    return _print_of(shingles(text, width))


def _print_of(hashes: list[int]) -> int:
    if not hashes:
        return 0
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[a : a + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", width: int = 3, out: str = "fingerprint") -> DataFrame:
    """``df`` without ``text``, with ``out`` (long: the fingerprint's bits)."""
    bounded_batches(df.sparkSession)
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (text, out)])
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column(batch.num_columns - 1)]
            signed = np.array(prints, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(signed)], names=schema.names)

    return df.select(*cols(rest), F.col(f"`{text}`").alias("__text")).mapInArrow(tidied(run), schema)


def lists(prints: DataFrame) -> DataFrame:
    """(key, fp): the eight posting lists of each distinct fingerprint."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255)
    keys = []
    for half in (range(4), range(4, 8)):
        for left_out in half:
            key = F.lit(8 * (left_out // 4) + left_out % 4 + 1).cast("long")
            for i in half:
                if i != left_out:
                    key = F.shiftleft(key, 8).bitwiseOR(byte(i))
            keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(prints: DataFrame, most: int = LIST) -> DataFrame:
    """(src, dst) of forests that span the links among distinct fingerprints ``fp``."""
    keys = ["key", "bi", "bj"]
    dealt = split_hot(lists(prints), "key", "fp", most).repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, keys):
            yield forest(table, run_starts(table, keys))

    return dealt.mapInArrow(run, "src long, dst long")


def forest(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Compare each row with the next, the one after it, and so on, for all lists of the table at once."""
    n = table.num_rows
    signed = table["fp"].to_numpy()
    fp = signed.view(np.uint64)
    block = table["block"].to_numpy()
    apart = table["bi"].to_numpy() != table["bj"].to_numpy()
    ends = np.append(starts[1:], n)
    left = np.repeat(ends, ends - starts) - np.arange(n)  # rows from this one to its list's end
    label = np.arange(n)
    i, step = np.arange(n), 0
    while True:
        step += 1
        i = i[left[i] > step]
        if not len(i):
            break
        j = i + step
        x = fp[i] ^ fp[j]
        differ = np.zeros(len(i), dtype=np.uint8)
        for b in range(8):  # the tally: positional bytes that the two don't share
            differ += (x >> np.uint64(8 * b)).astype(np.uint8) != 0
        hit = (8 - differ >= SHARED) & (np.bitwise_count(x) <= BITS)
        hit &= ~apart[i] | (block[i] != block[j])
        if hit.any():
            label = merge_labels(label, i[hit], j[hit])
    linked = np.flatnonzero(label != np.arange(n))
    return pa.RecordBatch.from_arrays([pa.array(signed[label[linked]]), pa.array(signed[linked])], names=["src", "dst"])


def classes(rows: DataFrame) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint of ``rows``."""
    prints = staged(rows.select("fp").distinct(), "prints")
    roots = components(links(prints))
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``df`` without ``text``, with fingerprint (16 hexadecimal digits) and component_id."""
    base = with_results(df.drop(text), ["fingerprint", "component_id"])
    fp = free_name(df, "fp_")
    rows = staged(with_fingerprints(df.select(*cols(base), F.col(f"`{text}`").alias("__t")), "__t", width, fp), "rows")
    named = classes(rows.select(F.col(fp).alias("fp")))
    ids = rows.groupBy(F.col(fp).alias("fp")).agg(F.min(f"`{doc_id}`").alias("least"))
    both = named.join(ids, "fp")
    of_root = both.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = staged(both.join(of_root, "root").select(F.col("fp").alias("k_"), "component_id"), "facts")
    hexed = F.lower(F.lpad(F.hex(fp), 16, "0"))
    return rows.join(facts, F.col(fp) == F.col("k_")).select(*cols(base), hexed.alias("fingerprint"), "component_id")


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes of a set of shingles; equal sets have equal keys."""
    least = np.full(len(_odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(found), 4096):
        part = found[a : a + 4096]
        np.minimum(least, ((part ^ (part >> np.uint64(32)))[None, :] * _odd[:, None]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)]


def _distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes or [0], dtype=np.uint64))


def _set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles; a text without words has one of its own."""
    return _distinct(shingles(text, width))


def _with_bands(slim: DataFrame, width: int) -> DataFrame:
    """(id, h, size, fp, bands) of each row of (id, h, t)."""
    bounded_batches(slim.sparkSession)
    sized = slim.select("id", "h", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("size"), "t")
    schema = T.StructType([*sized.drop("t").schema.fields, T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = [], []
            for t in batch.column("t"):
                text = t.as_py()
                hashes = shingles(text, width)
                prints.append(_print_of(hashes))
                keys += bands(_distinct(hashes))
            flat = pa.array(np.array(keys, dtype=np.uint64).view(np.int64))
            lists_ = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), flat)
            signed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], signed, lists_], names=schema.names)

    return sized.mapInArrow(tidied(run), schema)


def _candidates(rows: DataFrame) -> DataFrame:
    """(node, root): components of different texts ``h`` that the index or an equal band proposes."""
    keyed = rows.select(F.explode("bands").alias("key"), "h")
    shared = staged(keyed.groupBy("key").agg(F.min("h").alias("dst"), F.max("h").alias("top")).filter("dst < top").drop("top"), "shared")
    by_band = sieved(keyed, "key", shared.select("key"), "may_").filter("may_").drop("may_").join(shared, "key").select(F.col("h").alias("src"), "dst")
    prints = rows.select("h", "fp").distinct()
    near = staged(prints.join(classes(prints), "fp").select("h", "root"), "near")
    by_print = near.join(near.groupBy("root").agg(F.min("h").alias("dst")), "root").select(F.col("h").alias("src"), "dst")
    return components(by_band.unionByName(by_print))


def _compared(slim: DataFrame, dealt: DataFrame, width: int, similarity: float) -> DataFrame:
    """(src, dst) of forests that span the similar pairs in each (root, bi, bj) of ``dealt`` (h, root, bi, bj, block), where rows of
    one block aren't compared unless bi = bj. Only the texts that are asked for are shuffled, each distinct one once, then to its tasks."""
    keys = ["root", "bi", "bj"]
    asked = staged(dealt.select("h", *keys, "block"), "dealt")
    texts = sieved(slim.select("h", "t"), "h", asked.select("h").distinct(), "may_").filter("may_").groupBy("h").agg(F.first("t").alias("t"))
    met = texts.join(asked, "h").select(*keys, "block", "h", "t").repartition(*keys).sortWithinPartitions(*keys, "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, keys, 256):
            starts = run_starts(table, keys).tolist()
            for a, z in zip(starts, [*starts[1:], table.num_rows], strict=True):
                if z - a > 1:
                    yield _alike(table.slice(a, z - a), width, similarity)

    return met.mapInArrow(tidied(run), "src long, dst long")


def _in_blocks(members: DataFrame, key: list[str], most: int) -> DataFrame:
    """``members`` with nb and block: a key's rows in nb blocks of about ``most`` texts and ``BYTES`` bytes at most."""
    many = members.groupBy(*key).agg(F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("size") / BYTES)).cast("int").alias("nb"))
    return members.join(many, key).withColumn("block", F.pmod(F.xxhash64("h"), F.col("nb")).cast("int"))


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members`` with label: the group of texts that the links so far have joined."""
    groups = components(edges).withColumnsRenamed({"node": "h", "root": "label"})
    return members.join(groups, "h", "left").withColumn("label", F.coalesce("label", "h"))


def _verified(slim: DataFrame, members: DataFrame, width: int, similarity: float, most: int) -> DataFrame:
    """(src, dst) that join all pairs of texts of a component (h, root, size) whose sets of shingles are similar enough."""
    placed = staged(_in_blocks(members, ["root"], most), "placed")
    within = placed.select("h", "root", F.col("block").alias("bi"), F.col("block").alias("bj"), "block")
    edges = staged(_compared(slim, within, width, similarity), "within")
    large = placed.filter("nb > 1").select("h", "root", "size")
    if large.isEmpty():
        return edges
    # one text of each group that was found, all with all: copies of one text are one group then
    heads = _labelled(large, edges).filter("h = label").select("h", "root", "size")
    edges = staged(edges.unionByName(_compared(slim, split_hot(staged(heads, "heads"), "root", "h", most), width, similarity)), "edges")
    now = staged(_labelled(large, edges), "labels")
    apart = now.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a < z").select("root")
    rest = staged(now.join(apart, "root"), "apart")
    if rest.isEmpty():
        return edges
    return edges.unionByName(_compared(slim, _across(rest, most), width, similarity))


def _across(rest: DataFrame, most: int) -> DataFrame:
    """(h, root, bi, bj, block) in which every two texts of a root (h, root, size, label) with different labels meet.

    A group that fills blocks has its own, and no two of these meet; other groups share blocks, which meet with all.
    """
    sized = _in_blocks(rest, ["root", "label"], most).select("h", "root", "size", (F.col("nb") > 1).alias("pure"), F.when(F.col("nb") > 1, F.col("label")).otherwise(F.lit(0)).alias("of"))
    placed = staged(_in_blocks(sized, ["root", "pure", "of"], most), "across")
    block = ["root", "pure", "of", "block"]
    order = F.row_number().over(Window.partitionBy("root").orderBy("pure", "of", "block"))
    named = staged(placed.select(*block).distinct().withColumn("n", order), "blocks")
    left = named.select("root", F.col("n").alias("bi"), F.col("pure").alias("p1"), F.col("of").alias("o1"))
    right = named.select("root", F.col("n").alias("bj"), F.col("pure").alias("p2"), F.col("of").alias("o2"))
    pairs = staged(left.join(right, "root").filter("bi <= bj and not (p1 and p2 and o1 = o2)").select("root", "bi", "bj"), "pairs")
    rows = placed.join(named, block).select("root", "h", F.col("n").alias("block"))
    one = rows.join(pairs.withColumn("block", F.col("bi")), ["root", "block"])
    two = rows.join(pairs.filter("bi < bj").withColumn("block", F.col("bj")), ["root", "block"])
    return one.unionByName(two).select("h", "root", "bi", "bj", "block")


def _alike(run: pa.Table, width: int, similarity: float) -> pa.RecordBatch:
    """A spanning forest of the pairs of one component, or pair of blocks, with at least ``similarity``: from each text's
    shingles follow, by their postings, the numbers of shingles shared with every other text."""
    node, block = run["h"].to_numpy(), run["block"].to_numpy()
    apart = run["bi"][0].as_py() != run["bj"][0].as_py()
    sets = [_set(t.as_py(), width) for t in run["t"]]
    n, sizes = len(sets), np.array([len(s) for s in sets])
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)[np.argsort(place, kind="stable")]
    counts = np.bincount(place)
    begin = np.cumsum(counts) - counts
    first = np.cumsum(sizes) - sizes
    label = np.arange(n)
    for i in range(n - 1):
        if (label[i:] == label[i]).all():
            continue
        mine = place[first[i] : first[i] + sizes[i]]
        many = counts[mine]
        at = np.arange(many.sum()) + np.repeat(begin[mine] - np.cumsum(many) + many, many)
        both = np.bincount(owner[at], minlength=n)
        hit = both / (sizes + sizes[i] - both) >= similarity
        if apart:
            hit &= block != block[i]
        hit[: i + 1] = False
        j = np.flatnonzero(hit)
        if len(j):
            label = merge_labels(label, np.full(len(j), i), j)
    linked = np.flatnonzero(label != np.arange(n))
    return pa.RecordBatch.from_arrays([pa.array(node[label[linked]]), pa.array(node[linked])], names=["src", "dst"])


def _least(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(h) of the texts that go: of each group (h, root) all but the one of smallest id (null last), then of smallest hash."""
    ids = groups.join(rows.groupBy("h").agg(F.min("id").alias("id")), "h")
    best = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h")).alias("best"))
    return groups.join(best, "root").filter(F.col("h") != F.col("best.h")).select("h")


def _similar(slim: DataFrame, width: int, similarity: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, h) of all rows, and (h) of texts that go as their sets of shingles are similar to another's."""
    rows = staged(_with_bands(slim, width), "rows")
    near = _candidates(rows).withColumnRenamed("node", "h")
    members = staged(near.join(rows.groupBy("h").agg(F.max("size").alias("size")), "h").select("h", "root", "size"), "members")
    groups = staged(components(_verified(slim, members, width, similarity, most)).withColumnRenamed("node", "h"), "groups")
    return rows.select("id", "h"), _least(rows, groups)


def _linked(slim: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(id, h) of all rows, and (h) of texts that go as their fingerprints are linked with another's."""
    rows = staged(with_fingerprints(slim, "t", width, "fp"), "rows")
    groups = staged(rows.select("h", "fp").distinct().join(classes(rows), "fp").select("h", "root"), "groups")
    return rows.select("id", "h"), _least(rows, groups)


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float | None = None, most: int = SETS) -> DataFrame:
    """``df`` with one row of each group of near-duplicates: of smallest id (null last), then of smallest text hash.

    Near-duplicates are texts whose fingerprints differ in at most three bits, or with ``similarity`` those whose sets of
    shingles have at least that Jaccard similarity; links through other texts count. Of rows with one text the first stays, by id (null
    last) and then by the other columns, so reruns agree.

    Decisions are made on narrow tables of ids and hashes; of the rows themselves only those are shuffled whose text may occur
    twice or may go.
    """
    key, may, n = (free_name(df, x) for x in ("key_", "may_", "n_"))
    h = F.xxhash64(F.col(f"`{text}`"))
    slim = df.select(F.col(f"`{doc_id}`").alias("id"), h.alias("h"), F.col(f"`{text}`").alias("t"))
    rows, gone = _linked(slim, width) if similarity is None else _similar(slim, width, similarity, most)
    gone = staged(gone, "gone")
    twice = rows.groupBy("h").count().filter("count > 1").select("h")
    touched = staged(gone.unionByName(twice).distinct(), "touched")
    flagged = sieved(df.withColumn(key, h), key, touched, may)
    by = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in (doc_id, text) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = Window.partitionBy(key).orderBy(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"), *by)
    once = flagged.filter(F.col(may)).withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).drop(n)
    left = once.join(gone, F.col(key) == F.col("h"), "left_anti")
    return flagged.filter(~F.col(may)).unionByName(left).drop(key, may)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document of ``documents`` by fingerprints of 3-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
