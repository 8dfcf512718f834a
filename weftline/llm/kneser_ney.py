"""Operator 3: LM scoring with an interpolated modified Kneser-Ney trigram model.

Counting runs in Spark. Pass one counts words (64-bit hashes of lower-cased bytes); its reducers write sorted arrays
of hashes with their counts, and a word's id is its place in that order. Pass two counts triples (u, v, w) of ids and deals them
by their middle word v: its reducers then hold, of every v, all contexts (u, v) with their successors w, and all pairs (v, w) with the
number of different u before them, which are the counts of the next lower order. Both are written as sorted arrays. Pass three adds
up in how many contexts v each word w occurs. Map tasks pre-aggregate and send each reducer compressed, sorted blocks. The arrays
stay in the shared folder, and scoring workers memory-map them: nothing of the model's size is broadcast or collected.

A middle word with more than ``PART`` tokens (a very frequent one; also the start of a text) is split over reducers: by u, or by w where u is
very frequent too, so that one pair of words may make up any share of the corpus. Its pairs (v, w), and the sums of its contexts with very
frequent u, are put together from the pieces by a pass of their own. Texts are read whole; those of the training share add to the counts, all
are scored. Nothing is pruned.

Three orders are interpolated; the two words before a text are a start mark. Discounts D1, D2, D3+ of each order come from its counts of
counts as Chen and Goodman give them.

Nulls and rows: a null text is an empty one, which is scored as its end alone; a null doc_id counts as the empty string where
the share is drawn, so such rows train; repeated rows count each time; an empty table gives an empty result; without any
training text every score is that of the uniform distribution over the unknown word.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks_by_bytes, local_folder, put_file, staged, tidied, with_results

#: Tokens for each reducer; words that a map task holds before it sends them; bytes of text at a time.
PART, HELD, CHUNK = 2 << 20, 4 << 20, 4 << 20
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
END = np.uint64(0x656E64)  # stands in the vocabulary for the end of a text
_ROWS = "part long, block binary"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", _B), ("down", _B_INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(raw: bytes, window: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of lower-cased ``raw`` starts, and a 64-bit hash of it."""
    every = np.frombuffer(raw, dtype=np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(every):
        end = min(len(every), at + window)
        while end < len(every) and not _SPACE[every[end]]:  # never through a word
            end += 1
        b = every[at:end]
        word = np.concatenate([[False], ~_SPACE[b], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        a, z = edge[0::2], edge[1::2]
        up, down = _powers(len(b) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
        starts.append(a + at)
        hashes.append(_mix((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64)))
        at = end
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, an ``END`` behind each; where each text ends (exclusive)."""
    raw = [(t or "").encode("utf-8").lower() for t in texts]
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    starts, hashes = word_hashes(b" ".join(raw))
    upto = np.searchsorted(starts, first[1:])
    return np.insert(hashes, upto, END), upto + np.arange(1, len(raw) + 1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, byte planes apart, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
        body = zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)
        out += [len(a).to_bytes(8, "little"), a.itemsize.to_bytes(1, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def _unpack(block: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(block):
        n, size, body = int.from_bytes(block[at : at + 8], "little"), block[at + 8], int.from_bytes(block[at + 9 : at + 17], "little")
        at += 17
        planes = np.frombuffer(zstandard.decompress(block[at : at + body], max_output_size=n * size), dtype=np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(f"<u{size}"))
        at += body
    return out


def _delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Tally:
    """Counts of 64-bit keys that a map task sends on when it holds many."""

    def __init__(self, send):
        self.send, self.raw, self.n, self.keys, self.counts = send, [], 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.raw.append(keys)
        self.n += len(keys)
        if self.n >= HELD:
            self.fold()
            if len(self.keys) >= HELD // 2:
                yield from self.flush()

    def fold(self) -> None:
        if self.raw:
            k, c = np.unique(np.concatenate(self.raw), return_counts=True)
            self.raw, self.n = [], 0
            self.keys, self.counts = _summed(np.concatenate([self.keys, k]), np.concatenate([self.counts, c.astype(np.uint64)]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        rows = list(self.send(self.keys, self.counts)) if len(self.keys) else []
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["part", "block"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        column = batch.column("text")
        for a, z in chunks_by_bytes(column, CHUNK):
            yield tokens(column.slice(a, z - a).to_pylist())


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype("<u4" if int(a.max(initial=0)) < 2**32 else "<u8")


class Model:
    """What scoring needs besides the arrays, and how the arrays are found. Small: a row for each part, and for each very frequent word."""

    folder: str
    parts: int  # of the vocabulary, by leading bits of the hash
    bases: np.ndarray  # id of each part's first word
    words: int
    total: int
    texts: int
    shards: int  # of middle words, by id
    hot: np.ndarray  # ids of very frequent middle words, in order
    first: np.ndarray  # of each of these its first piece
    pieces: np.ndarray  # and their number
    hot_after: np.ndarray  # of each the sum of its successors' numbers of contexts, and how many have one, two, more
    pair_parts: int  # of sums of contexts of two very frequent words
    kinds: int
    high: np.ndarray  # discounts of triples by count: 0, 1, 2, 3 or more
    middle: np.ndarray  # of pairs by number of words before them
    low: np.ndarray  # and of words by number of contexts

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)

    def shard_of(self, word: np.ndarray) -> np.ndarray:
        return _scaled(word, self.shards, self.words + 1)

    def first_of(self, shard: int) -> int:
        return -(-shard * (self.words + 1) // self.shards)

    @property
    def id_kind(self) -> str:
        return "<u4" if self.words < 2**32 - 1 else "<u8"

    def place_in_hot(self, word: np.ndarray) -> np.ndarray:
        """Where each word stands among the very frequent ones; -1 if it isn't one."""
        if not len(self.hot):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
        return np.where(self.hot[at] == word, at, -1)

    def piece(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The piece of the very frequent words at ``place`` that holds ``word``."""
        return self.first[place] + np.minimum(np.maximum(word, 0) // self._steps()[place], self.pieces[place] - 1)

    def _steps(self) -> np.ndarray:
        return -(-(self.words + 1) // self.pieces)

    def shards_of(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where each triple is."""
        shard, hot = self.shard_of(v), self.place_in_hot(v)
        at = np.flatnonzero(hot >= 0)
        if len(at):
            by = np.where(self.place_in_hot(u[at]) >= 0, w[at], u[at])
            shard[at] = self.piece(hot[at], by)
        return shard

    def span(self, shard: int, v: np.ndarray) -> tuple[int, int]:
        """The first middle word of a shard, and how many ids it spans."""
        if shard < self.shards:
            return self.first_of(shard), self.first_of(shard + 1) - self.first_of(shard)
        return int(v[0]), 1


def _scaled(word: np.ndarray, shards: int, of: int) -> np.ndarray:
    """word * shards // of, in whole numbers that may be large."""
    if shards * of < 2**62:
        return word * shards // of
    return np.array([int(x) * shards // of for x in word], dtype=np.int64)


_MAPPED: dict[str, dict[str, np.ndarray]] = {}


def _file(model: Model, name: str, kind: str) -> np.ndarray:
    if model.folder not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[model.folder] = {}
    mapped = _MAPPED[model.folder]
    if name not in mapped:
        path = f"{model.folder}/{name}"
        size = os.path.getsize(path) if os.path.exists(path) else 0  # a part without rows has no files
        mapped[name] = np.memmap(path, dtype=kind, mode="r") if size else np.zeros(0, dtype=kind)
    return mapped[name]


def look_up(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted distinct hashes: ids (-1: unknown), counts, numbers of contexts."""
    n = len(hashes)
    ids, counts, near = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    part = model.part_of(hashes)
    edges = np.searchsorted(part, np.arange(model.parts + 1))
    for p in np.unique(part).tolist():
        a, z = edges[p], edges[p + 1]
        own = _file(model, f"h{p}", "<u8")
        if len(own):
            at = np.minimum(np.searchsorted(own, hashes[a:z]), len(own) - 1)
            hit = own[at] == hashes[a:z]
            ids[a:z] = np.where(hit, at + model.bases[p], -1)
            counts[a:z] = np.where(hit, _file(model, f"c{p}", "<u8")[at], 0)
            if os.path.exists(f"{model.folder}/k{p}"):
                near[a:z] = np.where(hit, _file(model, f"k{p}", "<u8")[at], 0)
    return ids, counts, near


def _find(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Places of ``want`` in the sorted stretches lo to hi of ``values``; -1 where it isn't."""
    lo, end = lo.copy(), hi
    hi = hi.copy()
    live = np.flatnonzero((lo < hi) & (want >= 0))
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = values[mid] < want[live]
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
        live = live[lo[live] < hi[live]]
    out = np.full(len(lo), -1, dtype=np.int64)
    at = np.flatnonzero((lo < end) & (want >= 0))
    at = at[values[lo[at]] == want[at]]
    out[at] = lo[at]
    return out


def _places(a: np.ndarray) -> np.ndarray:
    """Places in a shard's arrays: 32 bits do unless a shard is very large."""
    return a.astype("<u4" if int(a[-1]) < 2**32 else "<u8")


def _offsets(model: Model, name: str, n: int) -> np.ndarray:
    """The ``n`` places that a file holds."""
    path = f"{model.folder}/{name}"
    size = os.path.getsize(path) if os.path.exists(path) else 0
    return _file(model, name, "<u8" if size == 8 * n else "<u4")


def _put_capped(folder: str, name: str, large: str, values: np.ndarray) -> None:
    """Columns of small whole numbers as bytes; rows with a number beyond 254 also whole, with their places."""
    rows = values.reshape(len(values), -1)
    put_file(f"{folder}/{name}", np.minimum(rows, 255).astype("u1"))
    big = np.flatnonzero((rows > 254).any(axis=1))
    put_file(f"{folder}/{large}", np.concatenate([big[:, None], rows[big]], axis=1).astype("<u8"))


def _capped(model: Model, name: str, large: str, at: np.ndarray, width: int = 1) -> np.ndarray:
    got = _file(model, name, "u1").reshape(-1, width)[at].astype(np.int64)
    big = np.flatnonzero((got == 255).any(axis=1))
    if len(big):
        whole = _file(model, large, "<u8").reshape(-1, width + 1)
        got[big] = whole[np.searchsorted(whole[:, 0], at[big].astype(np.uint64)), 1:]
    return got


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard, and where it stands, in order."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    for s, a, z in zip(names.tolist(), first, [*first[1:], len(order)], strict=True):
        yield s, order[a:z]


def triples_of(m: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For triples with known v (u and w may be -1): the count, and the context's total, successors seen once, twice, and in all."""
    n = len(v)
    count, facts = np.zeros(n, dtype=np.int64), np.zeros((n, 4), dtype=np.int64)
    for s, at in _by_shard(m.shards_of(u, v, w)):
        us = _file(m, f"u{s}", m.id_kind)
        if not len(us):
            continue
        base, width = m.span(s, v[at])
        offsets, local = _offsets(m, f"a{s}", width + 1), v[at] - base
        pair = _find(us, offsets[local].astype(np.int64), offsets[local + 1].astype(np.int64), u[at])
        hit = np.flatnonzero(pair >= 0)
        at, pair = at[hit], pair[hit]
        starts = _offsets(m, f"b{s}", len(us) + 1)
        lo, hi = starts[pair].astype(np.int64), starts[pair + 1].astype(np.int64)
        facts[at, :3] = _capped(m, f"f{s}", f"g{s}", pair, 3)
        facts[at, 3] = hi - lo
        there = _find(_file(m, f"w{s}", m.id_kind), lo, hi, w[at])
        hit = np.flatnonzero(there >= 0)
        count[at[hit]] = _capped(m, f"n{s}", f"x{s}", there[hit])[:, 0]
    # the sums of a context of two very frequent words are over all pieces
    a, b = m.place_in_hot(u), m.place_in_hot(v)
    both = np.flatnonzero((a >= 0) & (b >= 0))
    key = b[both] * len(m.hot) + a[both]
    for part, at in _by_shard(key % m.pair_parts):
        known = _file(m, f"p{part}", "<u8").reshape(-1, 5)
        place = np.minimum(np.searchsorted(known[:, 0], key[at].astype(np.uint64)), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[place, 0] == key[at]) if len(known) else []
        facts[both[at[hit]]] = known[place[hit], 1:]
    return count, facts


def pairs_of(m: Model, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs with known v: words before the pair, and v's sum of these, and its successors with one, two, more."""
    n = len(v)
    before, after = np.zeros(n, dtype=np.int64), np.zeros((n, 4), dtype=np.int64)
    shard, hot = m.shard_of(v), m.place_in_hot(v)
    often = np.flatnonzero(hot >= 0)
    if len(often):
        shard[often] = m.piece(hot[often], w[often])
        after[often] = m.hot_after[hot[often]]
    for s, at in _by_shard(shard):
        base, width = m.span(s, v[at])
        offsets, local = _offsets(m, f"c{s}.o", width + 1), v[at] - base
        if not len(offsets):
            continue
        if s < m.shards:
            after[at] = _file(m, f"t{s}", "<u4").reshape(-1, 4)[local]
        there = _find(_file(m, f"c{s}.w", m.id_kind), offsets[local].astype(np.int64), offsets[local + 1].astype(np.int64), w[at])
        hit = np.flatnonzero(there >= 0)
        before[at[hit]] = _capped(m, f"c{s}.n", f"c{s}.x", there[hit])[:, 0]
    return before, after


def _distinct(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of triples of numbers up to ``n``: where each kind stands first in the order of v, u, w, and to which each row belongs."""
    bits = max(1, n.bit_length())
    if 3 * bits < 64:
        key = v << (2 * bits) | u << bits | w
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        return first, inverse
    order = np.lexsort((w, u, v))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (v[order][1:] != v[order][:-1]) | (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _triples(m: Model, words: np.ndarray, ends: np.ndarray):
    """The kinds of triples of a chunk in order: ids (u, v, w; -1: unknown), which each token belongs to, and the chunk's distinct words."""
    distinct, w = np.unique(words, return_inverse=True)
    found = look_up(m, distinct)
    ids = np.append(found[0], m.words)  # the start comes last
    first = np.concatenate([[0], ends[:-1]])[: len(ends)]
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[first] = len(distinct)
    u = np.empty_like(v)
    u[1:] = v[:-1]
    u[first] = len(distinct)
    one, inverse = _distinct(v, u, w, len(distinct))
    return ids[u[one]], ids[v[one]], ids[w[one]], inverse, w, one, found


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D1, D2, D3+ from how many kinds occur once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.75, 0.75])  # too few counts to estimate from
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0, *(min(max(v, 0.05), k - 0.05) for k, v in enumerate(d[1:], 1))])


def train(rows: DataFrame, text: str = "text") -> Model:
    """Count the whole texts of ``rows`` and write the model's arrays to the shared folder."""
    spark = rows.sparkSession
    bounded_batches(spark)
    docs = rows.select(F.col(f"`{text}`").alias("text"))
    size, texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    m = Model()
    m.folder, m.texts = local_folder(spark, "model"), texts
    m.parts = max(1, -(-(size // 6 + texts) // PART))

    def count_words(batches):
        def send(keys, counts):
            edges = np.searchsorted(m.part_of(keys), np.arange(m.parts + 1))
            for p in range(m.parts):
                a, z = edges[p], edges[p + 1]
                if z > a:
                    yield p, _pack(_delta(keys[a:z]), _small(counts[a:z]))

        tally = _Tally(send)
        for words, _ in _texts(batches):
            yield from tally.add(words)
        yield from tally.flush()

    def join_words(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        got = [_unpack(b.as_py()) for b in table["block"]]
        keys, counts = _summed(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in got]), np.concatenate([c.astype(np.uint64) for _, c in got]))
        put_file(f"{m.folder}/h{p}", keys)
        put_file(f"{m.folder}/c{p}", counts)
        often = np.flatnonzero(counts > PART)
        return pa.table({
            "part": pa.array([p], pa.int64()), "words": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()),
            "at": pa.array([often.tolist()], pa.list_(pa.int64())), "often": pa.array([counts[often].tolist()], pa.list_(pa.int64())),
        })

    schema = "part long, words long, total long, at array<bigint>, often array<bigint>"
    found = {r.part: r for r in docs.mapInArrow(count_words, _ROWS).groupBy("part").applyInArrow(join_words, schema).collect()}
    for p in set(range(m.parts)) - set(found):
        put_file(f"{m.folder}/h{p}", b"")
        put_file(f"{m.folder}/c{p}", b"")
    sizes = [found[p].words if p in found else 0 for p in range(m.parts)]
    m.bases = np.cumsum([0, *sizes])[:-1]
    m.words, m.total = sum(sizes), sum(r.total for r in found.values())
    m.shards = max(1, -(-m.total // PART))
    often = {int(m.bases[p] + a): n for p, r in found.items() for a, n in zip(r.at, r.often, strict=True)}
    end = look_up(m, np.array([END]))[0][0] if texts else -1
    often.pop(int(end), None)  # nothing follows an end
    if texts > PART:
        often[m.words] = texts
    m.hot = np.array(sorted(often), dtype=np.int64)
    m.pieces = np.array([-(-often[h] // PART) for h in m.hot.tolist()], dtype=np.int64)
    m.first = m.shards + np.cumsum(m.pieces) - m.pieces
    m.pair_parts = max(1, -(-(len(m.hot) ** 2) // PART))

    def count_triples(batches):
        for words, ends in _texts(batches):
            if not len(words):
                continue
            u, v, w, inverse, *_ = _triples(m, words, ends)
            times = np.bincount(inverse)
            rows = [(s, _pack(_small(_delta(v[at].astype(np.uint64))), _small(u[at]), _small(w[at]), _small(times[at]))) for s, at in _by_shard(m.shards_of(u, v, w))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["part", "block"])

    def join_triples(table: pa.Table) -> pa.Table:
        s = table["part"][0].as_py()
        got = [_unpack(b.as_py()) for b in table["block"]]
        v = np.concatenate([np.cumsum(g[0].astype(np.uint64)) for g in got]).astype(np.int64)
        u, w, n = (np.concatenate([g[i].astype(np.int64) for g in got]) for i in (1, 2, 3))
        del got
        order = np.lexsort((w, u, v))
        v, u, w, n = v[order], u[order], w[order], n[order]
        del order
        other = np.ones(len(v), dtype=bool)  # begins another triple, another pair
        other[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
        new = other.copy()
        new[1:] |= w[1:] != w[:-1]
        first = np.flatnonzero(new)
        n, v, u, w, other = np.add.reduceat(n, first), v[first], u[first], w[first], other[first]
        pair = np.flatnonzero(other)
        base, width = m.span(s, v)
        offsets = lambda x: _places(np.concatenate([[0], np.cumsum(np.bincount(x - base, minlength=width))]))
        facts = np.stack([np.add.reduceat(x, pair) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64))], axis=1)
        put_file(f"{m.folder}/a{s}", offsets(v[pair]))
        put_file(f"{m.folder}/u{s}", u[pair].astype(m.id_kind))
        put_file(f"{m.folder}/b{s}", _places(np.append(pair, len(v))))
        put_file(f"{m.folder}/w{s}", w.astype(m.id_kind))
        _put_capped(m.folder, f"f{s}", f"g{s}", facts)
        _put_capped(m.folder, f"n{s}", f"x{s}", n)
        out = _Rows()
        out.note("high", [int((n == x).sum()) for x in (1, 2, 3, 4)])
        # different words before each pair (v, w)
        order = np.lexsort((w, v))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
        at = np.flatnonzero(first)
        before = np.diff(np.append(at, len(order)))
        cv, cw = v[order[at]], w[order[at]]
        if s < m.shards:
            _after(m, s, cv, cw, before, base, width, out)
            return out.table()
        place = int(m.place_in_hot(cv[:1])[0])
        for piece, at in _by_shard(m.piece(np.full(len(cw), place), cw)):
            out.block("pairs", piece, _pack(_small(cv[at[:1]]), _small(_delta(cw[at].astype(np.uint64))), _small(before[at])))
        a = m.place_in_hot(u[pair])
        both = np.flatnonzero(a >= 0)
        key = place * len(m.hot) + a[both]
        whole = np.concatenate([key[:, None], facts[both], np.diff(np.append(pair, len(v)))[both, None]], axis=1)
        for part, at in _by_shard(key % m.pair_parts):
            out.block("sums", part, _pack(*(np.ascontiguousarray(c) for c in whole[at].astype("<u8").T)))
        return out.table()

    def join_pairs(table: pa.Table) -> pa.Table:
        """A piece of a very frequent word's successors, from all pieces of its contexts."""
        s, out = table["part"][0].as_py(), _Rows()
        got = [_unpack(b.as_py()) for b in table["block"]]
        w, before = _summed(np.concatenate([np.cumsum(g[1].astype(np.uint64)) for g in got]), np.concatenate([g[2].astype(np.uint64) for g in got]))
        v, before = int(got[0][0][0]), before.astype(np.int64)
        _after(m, s, np.full(len(w), v), w.astype(np.int64), before, v, 1, out)
        out.note("after", [int(m.place_in_hot(np.array([v]))[0]), int(before.sum()), *(int(x.sum()) for x in (before == 1, before == 2, before > 2))])
        return out.table()

    def join_sums(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        rows = np.concatenate([np.stack(_unpack(b.as_py()), axis=1) for b in table["block"]]).astype("<u8")
        key, where = np.unique(rows[:, 0], return_inverse=True)
        sums = np.zeros((len(key), 4), dtype=np.uint64)
        np.add.at(sums, where, rows[:, 1:])
        put_file(f"{m.folder}/p{part}", np.concatenate([key[:, None], sums], axis=1).astype("<u8"))
        return pa.table({"part": pa.array([part], pa.int64())})

    follow = staged(docs.mapInArrow(count_triples, _ROWS).groupBy("part").applyInArrow(join_triples, _Rows.schema), "follow")
    whole, notes = follow, follow.filter("what = 'note'").select("name", "of").collect()  # some rows for each shard
    if len(m.hot):
        pairs = staged(follow.filter("what = 'pairs'").select("part", "block").groupBy("part").applyInArrow(join_pairs, _Rows.schema), "pairs")
        notes += pairs.filter("what = 'note'").select("name", "of").collect()
        whole = whole.unionByName(pairs)
        follow.filter("what = 'sums'").select("part", "block").groupBy("part").applyInArrow(join_sums, "part long").collect()
    told = lambda name: [r["of"] for r in notes if r.name == name]
    m.high, m.middle = (discounts([sum(x[i] for x in told(name)) for i in range(4)]) for name in ("high", "middle"))
    m.kinds = sum(x[4] for x in told("middle"))
    m.hot_after = np.zeros((len(m.hot), 4), dtype=np.int64)
    for place, *sums in told("after"):
        m.hot_after[place] += sums

    def join_contexts(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        near = np.zeros(sizes[p], dtype=np.uint64)
        for b in table["block"]:
            words, times = _unpack(b.as_py())
            near[np.cumsum(words.astype(np.uint64)).astype(np.int64) - m.bases[p]] += times.astype(np.uint64)
        put_file(f"{m.folder}/k{p}", near)
        return pa.table({"of": pa.array([[int((near == x).sum()) for x in (1, 2, 3, 4)] + [int((near > 2).sum())]], pa.list_(pa.int64()))})

    of = whole.filter("what = 'words'").select("part", "block").groupBy("part").applyInArrow(join_contexts, "of array<bigint>").collect()
    n = [sum(r["of"][i] for r in of) for i in range(5)]
    m.low = discounts(n[:4])
    m.spare = (m.low[1] * n[0] + m.low[2] * n[1] + m.low[3] * n[4]) / m.kinds if m.kinds else 1.0
    return m


class _Rows:
    """What reducers tell: notes of numbers, and blocks for later passes."""

    schema = "what string, name string, part long, block binary, of array<bigint>"

    def __init__(self):
        self.rows: list[tuple] = []

    def note(self, name: str, of: list[int]) -> None:
        self.rows.append(("note", name, None, None, of))

    def block(self, what: str, part: int, block: bytes) -> None:
        self.rows.append((what, None, part, block, None))

    def table(self) -> pa.Table:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.table({n: pa.array([r[i] for r in self.rows], k) for i, (n, k) in enumerate(zip(("what", "name", "part", "block", "of"), kinds, strict=True))})


def _after(m: Model, s: int, v: np.ndarray, w: np.ndarray, before: np.ndarray, base: int, width: int, out: _Rows) -> None:
    """Writes the pairs (v, w) of a shard with the number of words before each; tells how often numbers occur, and each w's number of v."""
    put_file(f"{m.folder}/c{s}.o", _places(np.concatenate([[0], np.cumsum(np.bincount(v - base, minlength=width))])))
    put_file(f"{m.folder}/c{s}.w", w.astype(m.id_kind))
    _put_capped(m.folder, f"c{s}.n", f"c{s}.x", before)
    if s < m.shards:
        put_file(f"{m.folder}/t{s}", np.stack([np.bincount(v - base, weights=x, minlength=width) for x in (before, before == 1, before == 2, before > 2)], axis=1).astype("<u4"))
    out.note("middle", [*(int((before == x).sum()) for x in (1, 2, 3, 4)), len(before)])
    follow, times = np.unique(w, return_counts=True)
    edge = np.searchsorted(follow, [*m.bases, m.words])
    for p, (a, z) in enumerate(zip(edge, edge[1:], strict=False)):
        if z > a:
            out.block("words", p, _pack(_small(_delta(follow[a:z].astype(np.uint64))), _small(times[a:z])))


def score_texts(m: Model, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, known tokens, unigram base score, model score."""
    return score_tokens(m, *tokens(texts))


def score_tokens(m: Model, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same of texts as tokens."""
    u, v, w, inverse, where, one, (_, count_of, near_of) = _triples(m, words, ends)
    alone_of = np.maximum(near_of - m.low[np.minimum(near_of, 3)], 0) / max(m.kinds, 1) + m.spare / (m.words + 1)
    base_of = np.log10((count_of + 0.1) / (m.total + 0.1 * (m.words + 1)))
    p = alone_of[where[one]]
    old = np.flatnonzero(v >= 0)
    if m.kinds and len(old):
        u, v, w = u[old], v[old], w[old]
        before, after = pairs_of(m, v, w)
        lower = p[old]
        spare, own = after[:, 1:] @ m.middle[1:], np.maximum(before - m.middle[np.minimum(before, 3)], 0)
        lower = np.where(after[:, 0] > 0, (own + spare * lower) / np.maximum(after[:, 0], 1), lower)
        count, facts = triples_of(m, u, v, w)
        more = facts[:, 3] - facts[:, 1] - facts[:, 2]
        spare, own = np.stack([facts[:, 1], facts[:, 2], more], axis=1) @ m.high[1:], np.maximum(count - m.high[np.minimum(count, 3)], 0)
        p[old] = np.where(facts[:, 0] > 0, (own + spare * lower) / np.maximum(facts[:, 0], 1), lower)
    first = np.concatenate([[0], ends[:-1]])
    add = lambda x: np.add.reduceat(x, first) if len(ends) else np.zeros(0)  # noqa: E731  no text is without its end
    return ends - first, add((count_of > 0).astype(np.int64)[where]), add(base_of[where]), add(np.log10(p)[inverse])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    bounded_batches(df.sparkSession)
    base = with_results(df.drop(text), names)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = [T.LongType()] * 3 + [T.DoubleType()] * 3
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches):
        for batch in batches:
            for a, z in chunks_by_bytes(batch.column(batch.num_columns - 1), CHUNK):
                part = batch.slice(a, z - a)
                n, known, plain, best = score_texts(shared.value, part.column(part.num_columns - 1).to_pylist())
                new = [n, known, np.full(len(n), shared.value.total), plain, best, 10.0 ** np.minimum(-best / n, 300)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, new)], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in base.columns], F.col(f"`{text}`").alias("__text")).mapInArrow(tidied(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of nine tenths of them."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def digests(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return score(rows, train(rows.filter(~F.col("held_out"))))
