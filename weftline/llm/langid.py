"""Operator 6: language ID by error-correcting output codes.

Every language has a codeword; for each bit a linear classifier over hashed byte n-grams says how surely the bit is 1.
A text's scores are decoded to the language whose codeword loses least (logistic loss, each bit weighted by how well its
classifier does on the sample), and a text whose two best languages lose nearly alike is flagged as ambiguous.

The classifiers are fitted on a bounded sample: at most ``SAMPLE`` labelled documents in all, shared evenly by the
languages and chosen by the hash of their ids and texts, so reruns agree; repeated rows count as often as they occur, within the same
bound. Only that sample's n-gram shares (``WIDTH`` numbers a document at most) reach the driver; the fitted weights are broadcast (``WIDTH`` x bits, below 1 MB for up to 30 bits). All texts are
read whole, in place, without a shuffle.

Nulls and rows: a null text or one without a letter (numerals as of fractions and Roman ones aren't letters) is ``und`` with score 0, not ambiguous; rows with a null language or
id train nothing; with one known language every text with letters gets it; without any, all are ``und``; an empty table gives
an empty result; columns named like a result give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks_by_bytes, cols, tidied, with_results

#: Buckets of hashed n-grams, lengths in bytes of the n-grams, documents that classifiers are fitted on at most.
WIDTH, GRAMS, SAMPLE = 8192, (1, 2, 3), 1600
STEPS, RIDGE = 300, 1e-4
#: A text is ambiguous if its best language gets less than this share of both the best two get.
CLEAR = 0.52
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")


def grams(raw: bytes) -> np.ndarray:
    """Buckets of the n-grams of each length, end to end."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                h = (h * np.uint32(0x01000193)) ^ b[i : len(b) - n + 1 + i]
            h *= np.uint32(0x9E3779B1)
            out.append(h >> np.uint32(32 - WIDTH.bit_length() + 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def prepared(text: str) -> bytes:
    """Lower case, with every run of what isn't a letter as one space, and a space at each end."""
    return (" " + " ".join(_words(text.lower())) + " ").encode("utf-8", "replace")


_words = re.compile(r"[^\W\d_]+").findall


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 for each language: all ways to split up to five, else the best of some drawn with a fixed seed."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= 5:
        n = 2 ** (languages - 1) - 1
        return np.array([[1 if c == 0 or (b >> (c - 1)) & 1 else -1 for b in range(n)] for c in range(languages)])
    bits = min(10 * int(np.ceil(np.log2(languages))), 60)
    rng = np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(200 if languages <= 200 else 5):
        m = rng.choice([-1, 1], size=(languages, bits))
        gram = m @ m.T
        np.fill_diagonal(gram, -bits)
        if bits - int(gram.max()) > apart:
            best, apart = m, bits - int(gram.max())
    return best


class Model:
    """Weights of the bits' classifiers, weights of the bits, codewords, languages."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages)).astype(np.float32)
        bits = self.code.shape[1]
        if not bits:  # nothing to tell apart
            return
        target = self.code[y]
        scale = 1 / np.maximum(x.std(0), 1e-4)
        mean = x.mean(0)
        z = (x - mean) * scale
        z /= np.sqrt(max(z.shape[1], 1))
        w, shift = np.zeros((x.shape[1], bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
        v = np.zeros_like(w)
        counts = np.bincount(y, minlength=len(languages)).astype(np.float32)
        share = (1 / counts[y] / len(languages))[:, None]  # languages count alike
        for _ in range(STEPS):
            margin = target * (z @ w + shift)
            pull = -target * share / (1 + np.exp(np.clip(margin, -30, 30)))
            v = 0.9 * v + z.T @ pull + RIDGE * w
            w -= 4.0 * v
            shift -= 0.5 * pull.sum(0)
        right = (np.sign(z @ w + shift) == target) * share
        self.bit = np.clip(right.sum(0), 0.5, 1).astype(np.float32)
        self.w = (w * scale[:, None] / np.sqrt(max(z.shape[1], 1))).astype(np.float32)
        self.shift = (shift - mean @ self.w).astype(np.float32)

    def decode(self, f: np.ndarray) -> tuple[int, float, bool]:
        """The language whose codeword loses least for the bits' scores ``f``, its share, and whether the second is near."""
        loss = (np.logaddexp(0, -self.code * f[None, :]) * self.bit).sum(1)
        p = np.exp(-(loss - loss.min()))
        p /= p.sum()
        a, b = np.argsort(-p, kind="stable")[:2]
        return int(a), float(p[a]), bool(p[a] < CLEAR * (p[a] + p[b]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        names, score, unclear = [UNKNOWN] * n, np.zeros(n), np.zeros(n, dtype=bool)
        for i, t in enumerate(texts):
            if not t or not _letter.search(t) or not self.languages:
                continue
            if len(self.languages) == 1:
                names[i], score[i] = self.languages[0], 1.0
                continue
            k = grams(prepared(t))
            if len(k) > 4 * WIDTH:
                f = np.bincount(k, minlength=WIDTH).astype(np.float32) @ self.w
            else:
                f = self.w[k].sum(0)
            f = f / len(k) + self.shift
            best, score[i], unclear[i] = self.decode(f)
            names[i] = self.languages[best]
        return names, score, unclear


def bucket(doc_id: str) -> Column:
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))


def fit(df: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a sample of the rows of known language that aren't ``held_out``."""
    bounded_batches(df.sparkSession)
    rows = df.filter(~held_out & F.col(f"`{lang}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}"))
    names = F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.lit("sample"), f"`{doc_id}`", f"`{text}`").alias("draw")
    known = rows.select(*names, F.col(f"`{text}`").alias("text"))
    found = known.select("lang").distinct().orderBy("lang").limit(SAMPLE + 1).collect()
    languages = [r.lang for r in found]
    if len(languages) > SAMPLE:
        raise ValueError(f"more than {SAMPLE} languages, the bound of the sample")
    if not languages:
        return Model([], np.zeros((0, WIDTH), dtype=np.float32), np.zeros(0, dtype=np.int64))
    each = SAMPLE // len(languages)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    # the largest draw that is taken in each language, found without texts; then the rows up to it, again ``each`` at most
    last = known.select("lang", "draw").withColumn("n", first).filter(F.col("n") <= each).groupBy("lang").agg(F.max("draw").alias("last"))
    drawn = known.join(F.broadcast(last), "lang").filter("draw <= last").withColumn("n", first).filter(F.col("n") <= each).select("lang", "draw", "text")
    fields = T.StructType([T.StructField("lang", T.StringType()), T.StructField("draw", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("share", T.BinaryType())])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share = [], []
            for t in batch.column("text").to_pylist():
                k, c = np.unique(grams(prepared(t)), return_counts=True)
                at.append(k.astype("<u2").tobytes())
                share.append((c / max(1, c.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=fields.names)

    x, y = [], []
    for r in sorted(drawn.mapInArrow(shares, fields).collect(), key=lambda r: (r.lang, r.draw)):  # SAMPLE rows at most
        row = np.zeros(WIDTH, dtype=np.float32)
        row[np.frombuffer(r["at"], dtype="<u2")] = np.frombuffer(r["share"], dtype="<f4")
        x.append(row)
        y.append(r.lang)
    present = sorted(set(y))
    index = {name: i for i, name in enumerate(present)}
    return Model(present, np.array(x, dtype=np.float32).reshape(len(x), WIDTH), np.array([index[v] for v in y], dtype=np.int64))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (double, 0 to 1) and ambiguous."""
    bounded_batches(df.sparkSession)
    base = with_results(df, ["lang_pred", "score", "ambiguous"])
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in chunks_by_bytes(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, z - a)
                names, score, unclear = shared.value.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(unclear)], names=schema.names)

    return df.select(*cols(base), F.col(f"`{text}`").alias("__text")).mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from two thirds of them."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))


def digests(docs: DataFrame) -> DataFrame:
    held = F.coalesce(bucket("doc_id") % 3 == 1, F.lit(False))
    model = fit(docs, held)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
