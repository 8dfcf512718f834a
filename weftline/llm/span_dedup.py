"""Operator 5: substring dedup by sliding sentence spans.

Texts are split into words, and words into sentences (behind ``.``, ``!``, ``?`` before white space, behind the full stops of other scripts,
and at line ends; a sentence of more than ``LONG`` words also behind its commas, semicolons and colons, and what is still longer before words
that have the smallest hash of some ``WINDOW`` consecutive words, which depends on near words only). A character of a script without spaces
is a word. From every sentence starts one span, and with every sentence ends one: the shortest run of at least ``SENTENCES`` consecutive
sentences with at least ``WORDS`` words in all. So every passage of 50 words holds a span, whatever surrounds it, and every sentence in it is
covered but for those at either end, of at most ``LONG`` words each, that depend on the surroundings. Spans are hashed (by their lower-case words)
and joined globally. Of each repeated span the first occurrence stays, by doc_id, then text hash, then
place; every sentence covered by another occurrence is removed.

Words, sentences and spans of many texts are found at once, by arrays of code points. The join carries hashes and places only. Spans are
counted first, by their hashes alone, and only what a sieve of the repeated ones lets pass meets its first occurrence again. The
occurrences of a span of more than ``HOT`` are dealt to as many tasks as they fill, as long as the list of such spans is short (counted
first); else adaptive execution splits them. Texts are shuffled only where something may be removed.

Nulls and rows: a null text has no sentences and stays null; a null doc_id comes last in the order; rows of equal id
and text are one document and get equal results; an empty table gives an empty result; an input column that has a result's
name gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks_by_bytes, drop_path, free_name, new_path, sieved, staged, tidied, with_results

SENTENCES, WORDS, LONG, WINDOW = 2, 16, 11, 6
#: Occurrences of a span that meet in one task, and spans with more whose list is broadcast; bytes of text at a time.
HOT, LISTED, CHUNK = 20_000, 100_000, 1 << 20

OTHER, SPACE, LINE_END, STOP, PAUSE, WIDE_STOP, WIDE_PAUSE, UNSPACED = range(8)
#: Thai, Lao, Tibetan, Burmese, Khmer, Kana, Han; and Han beyond the first plane.
SCRIPTS = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)]
FAR_SCRIPT = (0x20000, 0x3FFFF)


def _table() -> np.ndarray:
    kinds = np.zeros(1 << 16, dtype=np.uint8)
    for a, z in SCRIPTS:
        kinds[a : z + 1] = UNSPACED
    kinds[[c for c in range(0x3001) if chr(c).isspace()]] = SPACE
    for marks, kind in (("\n", LINE_END), (".!?", STOP), (",;:", PAUSE), ("\u3002\uff01\uff1f\u0964\u0965", WIDE_STOP), ("\u3001\uff0c\uff1b\uff1a", WIDE_PAUSE)):
        kinds[[ord(c) for c in marks]] = kind
    return kinds


_KINDS = _table()
_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number, and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
            p = np.full(max(n, 1 << 14), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Cut:
    """The words and sentences of some texts, end to end. Sentences are numbered through; ``first`` has each text's first one."""

    def __init__(self, texts: list[str]):
        points = _points("\n".join(texts))
        kinds = _KINDS[np.minimum(points, 0xFFFF)]
        far = np.flatnonzero(points > 0xFFFF)
        kinds[far] = np.where((points[far] >= FAR_SCRIPT[0]) & (points[far] <= FAR_SCRIPT[1]), UNSPACED, OTHER)
        space = (kinds == SPACE) | (kinds == LINE_END)
        begins = ~space
        apart, wide = kinds == UNSPACED, (kinds == WIDE_STOP) | (kinds == WIDE_PAUSE)
        begins[1:] &= space[:-1] | apart[1:] | apart[:-1] | (wide[:-1] & ~wide[1:])
        ends = ~space
        ends[:-1] &= space[1:] | begins[1:]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.words = n = len(self.starts)
        self.texts = np.cumsum([0, *(len(t) + 1 for t in texts)])  # where each text starts
        self.word_hashes = self._hashed("\n".join(map(_lower, texts)), space)
        self.sentences = np.flatnonzero(self._sentence_starts(kinds)) if n else np.zeros(0, dtype=np.int64)  # first words
        self.first = np.searchsorted(self.starts[self.sentences], self.texts)

    def _hashed(self, low: str, space: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.zeros(0, dtype=np.uint64)
        sizes = self.ends - self.starts
        skip = int(self.starts[0])  # white space before the first word
        place = np.zeros(len(space), dtype=np.int64)
        place[skip:] = np.arange(skip, len(space)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(space))))
        value = _points(low).astype(np.uint64) + np.uint64(1)
        value[space] = 0
        place[space] = 0
        value *= _powers(int(sizes.max()) + 1)[0][place]
        return _mixed(np.add.reduceat(value, self.starts) + sizes.astype(np.uint64))

    def _sentence_starts(self, kinds: np.ndarray) -> np.ndarray:
        n = self.words
        lines = np.cumsum(kinds == LINE_END)
        last = kinds[self.ends[:-1] - 1]
        gap = self.starts[1:] > self.ends[:-1]
        new = np.ones(n, dtype=bool)
        new[1:] = (lines[self.starts[1:] - 1] > lines[self.ends[:-1] - 1]) | ((last == STOP) & gap) | (last == WIDE_STOP)
        pause = np.zeros(n, dtype=bool)
        pause[1:] = ((last == PAUSE) & gap) | (last == WIDE_PAUSE)
        new |= pause & self._long(new)
        # of every WINDOW words of what is still long, the last with the smallest hash
        long, group = self._long(new), np.cumsum(new)
        if n >= WINDOW:
            at = np.flatnonzero(long[: n - WINDOW + 1] & (group[: n - WINDOW + 1] == group[WINDOW - 1 :]))
            least, best = at.copy(), self.word_hashes[at]
            for k in range(1, WINDOW):
                here = self.word_hashes[at + k]
                less = here <= best
                best, least = np.where(less, here, best), np.where(less, at + k, least)
            new[least] = True
        return new

    @staticmethod
    def _long(new: np.ndarray) -> np.ndarray:
        """For each word whether its piece has more than LONG."""
        sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
        return np.repeat(sizes > LONG, sizes)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, first sentence, last sentence; numbered within the text) of the spans that start or end with each sentence.

        A span's hash sums its words' hashes times the powers of an odd number, so running sums give all at once.
        """
        n, word = len(self.sentences), np.append(self.sentences, self.words)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        end = np.maximum(np.searchsorted(word, word[:-1] + WORDS), np.arange(n) + SENTENCES)
        begin = np.minimum(np.searchsorted(word, word[1:] - WORDS, side="right") - 1, np.arange(1, n + 1) - SENTENCES)
        ahead = np.flatnonzero(end <= self.first[text + 1])
        back = np.flatnonzero((begin >= self.first[text]) & (end[np.maximum(begin, 0)] != np.arange(1, n + 1)))  # and no other's span ahead
        at, end = np.concatenate([ahead, begin[back]]), np.concatenate([end[ahead], back + 1])
        up, down = _powers(self.words + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.word_hashes * up[: self.words])])
        h = (sums[word[end]] - sums[word[at]]) * down[word[at]] + (word[end] - word[at]).astype(np.uint64)
        return text[at], _mixed(h).view(np.int64), at - self.first[text[at]], end - 1 - self.first[text[at]]

    def counts(self) -> np.ndarray:
        """Sentences of each text."""
        return np.diff(self.first)


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of each sentence, in order; the white space between them belongs to none."""
    cut = Cut([text])
    word = np.append(cut.sentences, cut.words)
    return list(zip(cut.starts[word[:-1]].tolist(), cut.ends[word[1:] - 1].tolist(), np.diff(word).tolist(), strict=True))


def spans(text: str, _found: object = None) -> Iterator[tuple[int, int, int]]:
    """(hash, first sentence, last sentence) of each span of a text."""
    return zip(*(x.tolist() for x in Cut([text]).spans()[1:]), strict=True)


def _all_spans(df: DataFrame, text: str, key: str, order: str) -> DataFrame:
    """(id, h, span, first, last) of every text's spans."""
    bounded_batches(df.sparkSession)
    kind = df.schema[order].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("span", T.LongType()),
        T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in chunks_by_bytes(batch.column("t"), CHUNK):
                part = batch.slice(a, z - a)
                row, span, first, last = Cut(part.column("t").to_pylist()).spans()
                i = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("id").take(i), part.column("h").take(i), pa.array(span), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=schema.names)

    rows = df.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{order}`").alias("id"), F.col(key).alias("h"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(tidied(run), schema)


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("no"), "id", "h", "first")


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, gone: sorted (first, last, kept_in) of spans that aren't the first of their kind) of texts that have any; h is the text's hash."""
    spark, key = df.sparkSession, free_name(df, "h_")
    paths = [new_path(spark, name) for name in ("spans", "repeated")]
    _all_spans(df.withColumn(key, F.xxhash64(F.col(f"`{text}`"))), text, key, doc_id).write.parquet(paths[0])
    every = spark.read.parquet(paths[0])
    every.groupBy("span").count().filter("count > 1").write.parquet(paths[1])
    repeated = spark.read.parquet(paths[1])
    passed = sieved(every, "span", repeated.select("span"), "may_").filter("may_").drop("may_")
    starts = staged(passed.groupBy("span").agg(F.min(_place()).alias("start"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "starts")
    salts = F.ceil(F.col("n") / HOT).cast("int")
    hot = starts.filter(F.col("n") > HOT).select("span", salts.alias("salts"))
    many = hot.count()
    if 0 < many <= LISTED:
        dealt = passed.join(F.broadcast(hot), "span", "left").withColumn("salt", F.pmod(F.xxhash64("h"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        both = dealt.join(starts.select("span", "start", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), ["span", "salt"])
    else:
        both = passed.join(starts, "span")
    gone = both.filter(~_place().eqNullSafe(F.col("start"))).groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("first", "last", F.col("start.id").alias("kept_in")))).alias("gone"))
    out = staged(gone, "repeats")
    for path in paths:  # what was read from them is written now
        drop_path(spark, path)
    return out


def remove(df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "kept_text") -> DataFrame:
    """``df`` with ``out`` (the text without repeated sentences), n_sentences, n_removed, removed (start:end in code points, comma-joined) and
    kept_in (ids of the documents in which the removed spans stay)."""
    base = with_results(df, [out, "n_sentences", "n_removed", "removed", "kept_in"])
    gone = repeats(df, doc_id, text).withColumnsRenamed({"id": "id_", "h": "hh_"})
    names = [f"c{i}" for i in range(len(base.columns))]  # no name of the input clashes with one of ours
    wide = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(base.columns, names, strict=True)], F.col(f"`{text}`").alias("__text"), F.col(f"`{doc_id}`").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__h"))
    marked = sieved(wide, "__h", gone.select("hh_"), "__may")
    listed = [F.array_distinct("gone.kept_in").alias("kept_in_"), F.col("gone.first").alias("first_"), F.col("gone.last").alias("last_")]
    some = marked.filter("__may").join(gone, F.col("__id").eqNullSafe(F.col("id_")) & (F.col("__h") == F.col("hh_")), "left").select(*names, "__text", *listed)
    none = [F.lit(None).cast(some.schema[c].dataType).alias(c) for c in ("kept_in_", "first_", "last_")]
    plain = some.unionByName(marked.filter("not __may").select(*names, "__text", *none))
    fields = [T.StructField(out, T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.StringType())]
    schema = T.StructType([*base.schema.fields, T.StructField("kept_in", T.ArrayType(df.schema[doc_id].dataType)), *fields])
    n = len(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in chunks_by_bytes(batch.column(n), CHUNK):
                part = batch.slice(a, z - a)
                texts, covers = part.column(n).to_pylist(), zip(part.column(n + 2).to_pylist(), part.column(n + 3).to_pylist(), strict=True)
                counts = Cut([t or "" for t in texts]).counts().tolist()
                cut = [_without(t, list(zip(f, g, strict=True))) if f else (t, m, 0, "") for t, (f, g), m in zip(texts, covers, counts, strict=True)]
                new = [pa.array([c[i] for c in cut], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], part.column(n + 1), *new], names=schema.names)

    return plain.mapInArrow(tidied(run), schema)


def _without(text: str | None, gone: list[tuple[int, int]]) -> tuple[str | None, int, int, str]:
    if text is None:
        return None, 0, 0, ""
    found = sentences(text)
    out, at, removed, places = [], 0, 0, []
    covered = np.zeros(len(found), dtype=bool)
    for a, z in gone:
        covered[a : z + 1] = True
    for i, (a, z, _) in enumerate(found):
        if covered[i]:
            removed += 1
            stop = found[i + 1][0] if i + 1 < len(found) else len(text)  # with the white space behind it
            out.append(text[at:a])
            at = stop
            if places and places[-1][1] >= a - 2 and covered[i - 1]:
                places[-1][1] = z
            else:
                places.append([a, z])
    return "".join([*out, text[at:]]), len(found), removed, ",".join(f"{a}:{z}" for a, z in places)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the sentences of passages that occur earlier."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_sentences", "n_removed", "removed", "kept_in", F.col("kept_text").alias("text"))
