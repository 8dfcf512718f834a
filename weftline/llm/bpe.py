"""Operator 1: byte-level BPE encoding and decoding.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash (hash and displace: two
arrays, one probe, the bytes compared). Any other pre-token is merged by a heap of candidate pairs over its
bytes as a doubly linked list, O(n log n) for n bytes, so a pre-token of a megabyte is no special case.

The vocabulary file is read on the driver and broadcast: its size is that of the file, which is checked against
``MAX_VOCABULARY_BYTES``. Rows are encoded where they are: there is no shuffle.

Nulls and rows: a null text encodes as an empty one (no ids, ``n_tokens`` 0); rows, repeated or not, stay as they are,
one result each; an empty table gives an empty result; an input column that has a result's name gives way to the result.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks_by_bytes, cols, tidied, with_results

MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens that a worker remembers, in each of two generations.
REMEMBERED = 250_000
LONGEST_REMEMBERED = 64
#: Texts are split into pre-tokens about so many bytes at a time, a longer one alone.
CHUNK_BYTES = 1 << 20


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``find`` gives a string's position or -1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        n = self.n = len(keys)
        self.buckets = max(1, -(-n // per_bucket))
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=n)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.at: list[int] = [-1] * n
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        hashes = h.tolist()
        free = iter(range(n))
        for b in np.argsort(-np.diff(bounds), kind="stable").tolist():
            members = order[bounds[b] : bounds[b + 1]].tolist()
            if not members:
                break
            if len(members) == 1:  # any free place does; -1 - place stands for it
                slot = next(s for s in free if self.at[s] < 0)
                self.shift[b] = -1 - slot
                self.at[slot] = members[0]
                continue
            d = 0
            while True:
                slots = [self._slot(hashes[m], d) for m in members]
                if all(self.at[s] < 0 for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[b] = d
            for m, s in zip(members, slots, strict=True):
                self.at[s] = m
        self.shift_list = self.shift.tolist()
        self.keys = keys

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        x = ((h + d) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.n

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        m = self.at[self._slot(h, self.shift_list[h % self.buckets])]
        return m if self.keys[m] == key else -1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    if (size := os.path.getsize(path)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary of up to {MAX_VOCABULARY_BYTES} is broadcast")
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


# The code points below U+0250 that \p{L}, \p{N} and \s name: texts of these alone take the faster module `re`.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "


class Codec:
    """Encodes texts as packed little-endian 32-bit ids and decodes them again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        self.ranks = ranks
        self.words = list(ranks)
        self.ids = [ranks[w] for w in self.words]
        self.hash = PerfectHash(self.words)
        self.spell: dict[int, bytes] = {i: w for w, i in ranks.items()}
        self.find_any = regex.compile(pattern, regex.V0).findall
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]")
        latin = latin.replace(r"\p{N}", f"[{_NUMBER}]").replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(r"\s", f"[{_SPACE}]")
        self.find_latin = re.compile(latin).findall if "\\p" not in latin else self.find_any
        self.other_script = re.compile("[^\x00-ɏ]").search
        self.young: dict[str, bytes] = _Memo(self)
        self.old: dict[str, bytes] = {}
        self.pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        top = max(self.spell, default=-1) + 1
        self.letters = np.frombuffer(b"".join(self.spell.get(i, b"") for i in range(top)), dtype=np.uint8)
        self.n_letters = np.fromiter((len(self.spell.get(i, b"")) for i in range(top)), dtype=np.int64, count=top)
        self.first_letter = np.cumsum(self.n_letters) - self.n_letters

    def pieces(self, text: str) -> list[str]:
        return (self.find_any if self.other_script(text) else self.find_latin)(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a distinct pre-token of the lot is looked up once."""
        split = [self.pieces(t) for t in texts]
        stops = np.cumsum([len(p) for p in split])
        coded = pa.array(itertools.chain.from_iterable(split), type=pa.string()).dictionary_encode()
        del split
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, _Memo(self)
        known = [self.young[p] for p in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        which = coded.indices.to_numpy()
        ids, ends = gather(np.frombuffer(b"".join(known), dtype="<u4"), np.cumsum(sizes) - sizes, sizes, which)
        ends = np.concatenate([[0], ends])
        return np.split(ids, ends[stops][:-1]) if len(texts) else []

    def piece(self, text: str) -> bytes:
        raw = text.encode("utf-8")
        m = self.hash.find(raw)
        if m >= 0:
            return self.ids[m].to_bytes(4, "little")
        return b"".join([i.to_bytes(4, "little") for i in self.merge(raw)])

    def merge(self, raw: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left.

        The heap's entries are whole numbers: rank, then start, then end of the pair. A part that starts at i
        ends at ``end[i]``, where the next part starts; ``end`` of a part that was merged away is 0.
        """
        n = len(raw)
        bits = n.bit_length()
        low = (1 << bits) - 1
        rank, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        pairs = self.pairs
        heap = [(r << bits | i) << bits | i + 2 for i, (a, b) in enumerate(zip(raw, raw[1:])) if (r := pairs[a << 8 | b]) >= 0]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            stop = x & low
            i = x >> bits & low
            k = end[i]
            if not k or k >= n or end[k] != stop:
                continue  # one of the two has grown or gone meanwhile
            end[k] = 0
            end[i] = stop
            before[stop] = i
            if stop < n and (r := rank(raw[i : end[stop]])) is not None:
                push(heap, (r << bits | i) << bits | end[stop])
            j = before[i]
            if j >= 0 and (r := rank(raw[j:stop])) is not None:
                push(heap, (r << bits | j) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and int(ids.max()) >= len(self.n_letters):
            raise ValueError(f"no such id: {int(ids.max())}")
        return gather(self.letters, self.first_letter, self.n_letters, ids)[0].tobytes()


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[first[i] : first[i] + size[i]] for i of ``which``, end to end; where each ends."""
    n = size[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first[which] - (ends - n), n) + np.arange(total)], ends


class _Memo(dict):
    """Ids of pre-tokens seen; a generation before the last is dropped."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, text: str) -> bytes:
        got = self.codec.old.get(text)
        if got is None:
            got = self.codec.piece(text)
        if len(text) <= LONGEST_REMEMBERED:
            self[text] = got
        return got


_CODECS: dict[str, Codec] = {}


def _codec(name: str, shared, pattern: str) -> Codec:
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(shared.value, pattern)
    return _CODECS[name]


def _mapper(spark: SparkSession, path: str, pattern: str, work: Callable) -> Callable:
    bounded_batches(spark)
    ranks = read_ranks(path)
    name = xxhash.xxh3_64_hexdigest(pattern.encode() + b"".join(ranks))
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared, pattern)
        for batch in batches:
            for a, z in chunks_by_bytes(batch.column(batch.num_columns - 1), CHUNK_BYTES):
                part = batch.slice(a, z - a)
                new = work(codec, part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new.values()], names=[*part.schema.names[:-1], *new])

    return tidied(run)


def _packed(codec: Codec, texts: pa.Array, ids: str, count: str) -> tuple[dict[str, pa.Array], list[np.ndarray]]:
    found = codec.encode(texts.to_pylist())
    return {ids: pa.array([x.tobytes() for x in found], type=pa.binary()), count: pa.array([len(x) for x in found], type=pa.int64())}, found


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit) and ``count`` of each whole text."""
    rest = with_results(df, [ids, count])
    source = df.select(*[F.col(f"`{c}`") for c in rest.columns], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def work(codec: Codec, texts: pa.Array) -> dict[str, pa.Array]:
        return _packed(codec, texts, ids, count)[0]

    schema = T.StructType([*rest.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])
    return source.mapInArrow(_mapper(df.sparkSession, path, pattern, work), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the bytes (binary) that ``ids`` stand for; null ids are empty."""
    rest = with_results(df, [out])
    source = df.select(*cols(rest), F.coalesce(F.col(f"`{ids}`"), F.lit(b"")).alias("__ids"))

    def work(codec: Codec, packed: pa.Array) -> dict[str, pa.Array]:
        return {out: _binary([codec.decode(np.frombuffer(p, dtype="<u4")) for p in packed.to_pylist()])}

    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.BinaryType())])
    return source.mapInArrow(_mapper(df.sparkSession, path, pattern, work), schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows, as one Python worker does both."""
    rest = with_results(df, [ids, count, out])
    source = df.select(*[F.col(f"`{c}`") for c in rest.columns], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def work(codec: Codec, texts: pa.Array) -> dict[str, pa.Array]:
        new, found = _packed(codec, texts, ids, count)
        return new | {out: _binary([codec.decode(x) for x in found])}

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType()), T.StructField(out, T.BinaryType())]
    return source.mapInArrow(_mapper(df.sparkSession, path, pattern, work), T.StructType([*rest.schema.fields, *fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` as tokens and back, as digests."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    done = round_trip(docs.select("doc_id", "text"), path, pattern)
    return done.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
