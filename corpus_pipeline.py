"""From raw documents to tokens: language ID, near-dedup, personal data, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between stages rows are
written as Parquet and read again. All but the last return the columns of ``documents``; other columns of their input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, langid, mixing, pii, simhash
from weftline.llm.common import drop_path, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised: neither ``und`` nor ambiguous. Stated languages stay as they are.

    Null texts and those without a letter go; repeated rows stay or go together, null ids don't matter; without any stated language
    every document goes; an empty table gives an empty one.
    """
    model = langid.fit(docs, F.lit(False))
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (sets of shingles of five words with a Jaccard similarity of at least 0.8).

    The one of the smallest id stays (null last), of rows with one text the first by id, then by the other columns, nulls first. Null
    texts and texts without words are one group; a text of fewer than five words is one shingle; an empty table gives an empty one.
    """
    return simhash.keep_one(docs.select(*COLUMNS), width=5, similarity=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars counts the new text.

    Every row stays, repeated ones and those with null ids too; a null text stays null, and a text without finds, and its n_chars, as they
    were; an empty table gives an empty one.
    """
    done = pii.detect(docs.select(*COLUMNS, F.col("text").isNull().alias("none_")))  # without finds a text comes back as it was
    text = F.when(~F.col("none_"), F.col("redacted"))
    length = F.when(F.col("spans") != "", F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return done.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears once for each epoch it is taken in; the one at which a source's
    budget ends is cut behind its last word taken.

    Null sources are a source, the last in order; null texts and texts without words have no words to take and stay once; repeated rows and
    null ids are drawn like others; an empty table gives an empty one.
    """
    mixed = mixing.mix(docs.select(*COLUMNS))
    each = mixed.withColumn("left_", F.explode(_rounds(F.col("size"), F.col("taken"))))
    text = F.when(F.col("left_") >= F.col("size"), F.col("text")).otherwise(_first_words("text", "left_"))
    return each.withColumn("whole_", F.col("left_") >= F.col("size")).select(
        "doc_id", text.alias("text"), "lang", "source", F.when(F.col("whole_"), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars")
    )


def _rounds(size: Column, taken: Column) -> Column:
    """Words to take in each epoch: the size as often as it fits, then the rest; a document without words once."""
    full = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(1)).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(F.lit(0))
    part = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array_repeat(size, full), part)


def _first_words(text: str, n: str) -> Column:
    """The text up to the end of its n-th word."""
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the white space before it
    return F.array_join(F.slice(words, F.lit(1), F.col(n).cast("int")), "")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked to decode to its text.

    A null text is an empty one, without tokens; repeated rows and null ids give rows; an empty table gives an empty one.
    """
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.round_trip(docs.select(*COLUMNS), path, P.PATTERN)
    same = F.decode("decoded", "UTF-8") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids", same.alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("PII", private),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express the classifiers, XXH64 fingerprints and BPE: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, beginning with ``documents``; what a stage wrote goes when the next one's rows are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            drop_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
