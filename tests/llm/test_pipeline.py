"""The pipeline's stages against plain versions, in turn, each on its own input."""

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from weftline.llm import bpe, pii, simhash
from weftline.llm.common import staged


@pytest.fixture(scope="module")
def steps(spark, data):
    out = [spark.read.parquet(f"{data}/documents.parquet")]
    for name, stage in cp.STAGES:
        out.append(staged(stage(spark, out[-1], data), "step"))
    return out


def test_shape(steps):
    assert len(cp.STAGES) == 5
    for df in steps[:5]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_language_keeps_clean_documents(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    gone = [r for r in steps[0].collect() if r.doc_id not in kept]
    assert len(gone) <= 0.01 * steps[0].count()


def test_one_of_each_group(steps):
    rows = [(r.doc_id, simhash.fingerprint(r.text, 5)) for r in steps[1].collect()]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({top(i) for i, _ in rows})


def test_private_data_is_replaced(steps):
    before = {r.doc_id: r for r in steps[2].collect()}
    for r in steps[3].collect():
        text = before[r.doc_id].text
        found = pii.find(text)
        assert r.text == pii.redacted(text, found) and (any(found.values()) or r.n_chars == before[r.doc_id].n_chars)
        assert not any(v for k, v in pii.find(r.text).items())


def test_mixture(steps):
    words = lambda df: dict(df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).collect())
    from weftline.llm import mixing

    want = {r.source: r.target for r in mixing.mix(steps[3]).select("source", "target").distinct().collect()}
    assert all(abs(words(steps[4])[s] - t) <= 2 for s, t in want.items())
    whole = {r.doc_id: r.text for r in steps[3].collect()}
    assert all(whole[r.doc_id].startswith(r.text) for r in steps[4].collect())


def test_tokens(steps):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in steps[4].collect())
    got = steps[5].collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want and all(r.round_trip for r in got)


def test_odd_rows_pass(spark):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "Some words that have no id at all.", "en", "a", 34), (3, "Words of the same kind, and more of them.", "en", "a", 41)] + [(4, "Twice the very same row, again.", "en", "b", 31)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "").count() >= 0
        assert stage(spark, docs.limit(0), "").count() == 0


def test_odd_rows_by_stage(spark):
    """Null and empty texts, repeated rows, null ids, unknown columns: what each stage's docstring says."""
    row = lambda i, t, lang="en", source="a", n=1: (i, t, lang, source, n)
    words = "Some words that stand here for a text of their own, and not for any other"
    rows = [row(1, None), row(2, ""), row(3, "  !! 12 "), row(4, words), row(4, words), row(None, words), row(5, words + " at all", None, None, None), row(6, "Write to a.b@c.example now " + "or later " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("more", F.lit("x"))
    key = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))
    kept = cp.language(spark, docs, "")
    assert kept.columns == cp.COLUMNS and key(kept) == sorted((r[0] is None, r[0] or 0, r[1]) for r in rows[3:])
    near = cp.near_dedup(spark, docs, "")
    # a null text and one without words are alike, as are the five-word shingles of 4, null and 5 by 0.8 and more; marks and numbers are words
    assert near.columns == cp.COLUMNS and [(i, t) for _, i, t in key(near)] == [(1, ""), (3, "  !! 12 "), (4, words), (6, rows[7][1])]
    private = {(r.doc_id, r.text): r.n_chars for r in cp.private(spark, docs, "").collect()}
    assert len(private) == 7 and private[1, None] == 1 and private[2, ""] == 1 and private[None, words] == 1
    clean = rows[7][1].replace("a.b@c.example", "<EMAIL>")
    assert private[6, clean] == len(clean)
    mixed = cp.mix(spark, docs, "").collect()
    assert {r.source for r in mixed} == {"a", None} and sum(r.doc_id == 1 for r in mixed) == sum(r.doc_id == 2 for r in mixed) == 1
    done = cp.encode(spark, docs, "").collect()
    assert len(done) == len(rows) and all(r.round_trip for r in done) and sorted(r.n_tokens for r in done)[:2] == [0, 0]


@pytest.mark.parametrize("most", [1024, 4])
def test_near_copies_down_to_similarity(spark, most):
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(10**6)}"
    texts = []
    for k in range(40):
        base = [word() for _ in range(300)]
        texts.append(base)
        for changed in range(1 + k % 8):  # Jaccard about 0.97 down to 0.75
            copy = list(base)
            for at in np.linspace(10, 290, 1 + changed).astype(int):
                copy[at] = word()
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.keep_one(docs, width=5, similarity=0.8, most=most).collect())
    assert got == sorted({top(i) for i in up})


@pytest.mark.parametrize("most", [1024, 3])
def test_large_groups_and_bridges(spark, most):
    """A large group of near copies, chains whose ends are unlike, texts that share a third, exact and whole copies: against all pairs."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{rng.integers(10**6)}" for _ in range(n)]
    base, texts = words(200), []
    for _ in range(40):
        copy = list(base)
        copy[int(rng.integers(200))] = "other"
        texts.append(copy)
    chain = words(200)
    for i in range(12):  # each link changes four words in a place of its own
        chain = list(chain)
        chain[16 * i : 16 * i + 4] = words(4)
        texts.append(chain)
    shared = words(120)
    texts += [shared + words(180) for _ in range(8)] + [base[:150] + words(40) for _ in range(3)]
    texts += [texts[3]] * 5 + [[]] * 2 + [["only"]] * 2
    sets = [{" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(0, " ".join(texts[0]))] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.keep_one(docs, width=5, similarity=0.8, most=most).collect())
    assert got == sorted({top(i) for i in up})


def test_across_lets_all_labels_meet(spark):
    rng = np.random.default_rng(14)
    rows = [(int(h), r, 10, int(l)) for r in (1, 2) for h, l in zip(rng.integers(-(2**60), 2**60, 90), np.where(rng.random(90) < 0.5, 7, rng.integers(8, 20, 90)))]
    dealt = simhash._across(spark.createDataFrame(rows, "h long, root long, size long, label long"), 10).collect()
    met, held = set(), {}
    for d in dealt:
        held.setdefault((d.root, d.bi, d.bj), []).append((d.h, d.block))
    for (_, bi, bj), g in held.items():
        met |= {frozenset((a, b)) for a, x in g for b, y in g if a != b and (bi == bj or x != y)}
    label = {h: (r, l) for h, r, _, l in rows}
    assert {frozenset((a, b)) for a in label for b in label if label[a][0] == label[b][0] and label[a][1] != label[b][1]} <= met
    assert max(len(g) for g in held.values()) < 50 and not any(label[a][1] == label[b][1] == 7 for a, b in met)


def test_which_of_repeated_rows_stays(spark):
    rows = [(4, "Twice the very same row, again.", lang, "b", 31) for lang in ("fr", "en", None)] + [(3, "Twice the very same row, again.", "de", "a", 31), (None, "Twice the very same row, again.", "aa", "a", 31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 3):
        assert [tuple(r) for r in cp.near_dedup(spark, docs.repartition(parts), "").collect()] == [rows[3]]
        got = cp.near_dedup(spark, docs.filter("doc_id = 4").repartition(parts), "").collect()
        assert [r.lang for r in got] == [None]  # nulls come first in the order of the other columns


def test_stage_drops_a_near_copy_beyond_three_bits(spark):
    rng = np.random.default_rng(10)
    base = [f"w{rng.integers(10**6)}" for _ in range(300)]
    copy = list(base)
    for at in (30, 90, 150, 210, 270):
        copy[at] = f"w{rng.integers(10**6)}"
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate((base, copy))]
    assert (simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count() > simhash.BITS
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in cp.near_dedup(spark, docs, "").collect()] == [0]
