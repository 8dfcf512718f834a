"""Rules as columns within the row, and as windows on tables of lines: the two agree on random documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.dom import rewrite, structure
from weftline.operators import lines, rules

WORDS = ["alpha", "beta", "Watch", "Notes", "Read", "gamma AB-12 x AB-12", "own name", "https://x.example/y", "l" * 70, "资源", "x资源"]


def _documents(seed, n=120):
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def line():
        kind = rng.integers(9)
        if kind < 3:
            return "#" * int(rng.integers(1, 7)) + " " + pick(WORDS)
        if kind == 3:
            return ""
        if kind == 4:
            return f"![{pick(WORDS[:2])}](u)"
        if kind == 5:
            return "```"
        if kind == 6:
            return pick(["  ", "#", "##", "### ", "#hash", "a\u00a0b\u200b", "\u3000"])
        return pick(WORDS[:3])

    return [(i, "\n".join(line() for _ in range(int(rng.integers(0, 25))))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_documents(1), "doc int, text string").cache()


PAIRS = [
    ("clamp", rewrite.clamp_jumps, lines.clamp_jumps),
    ("demote", lambda t: rewrite.demote_subheadings(t, ["Notes", "Read"]), lambda x: lines.demote_subheadings(x, ["Notes", "Read"])),
    ("merge", rewrite.merge_same_titles, lines.merge_same_titles),
    ("echoes", rewrite.drop_alt_echoes, lines.strip_alt_echoes),
    ("spaces", rewrite.plain_spaces, lines.plain_spaces),
    ("headings", rewrite.normalise_headings, lines.normalise_headings),
    ("headings_of_products", lambda t: rewrite.normalise_headings(t, body_max=2, max_level=4), lambda x: lines.normalise_headings(x, body_max=2, max_level=4)),
    ("headings_named", lambda t: rewrite.normalise_headings(t, name="own name", product=True), lambda x: lines.shift_headings(lines.normalise_headings(x, current_name="own name", product=True))),
]


@pytest.mark.parametrize(("name", "whole", "windows"), PAIRS, ids=[p[0] for p in PAIRS])
def test_windows_and_rows_agree(docs, name, whole, windows):
    got = dict(lines.joined(windows(lines.md_lines(docs, "doc", "text")).select("doc", "pos", "line")).collect())
    wrong = []
    for doc, text in docs.collect():
        want = whole(text).rstrip("\n").split("\n")
        if got.get(doc, "").rstrip("\n").split("\n") != want:
            wrong.append((text, want, got.get(doc)))
    assert not wrong


def test_blocks_and_sections_agree(docs):
    rows = lines.md_lines(docs, "doc", "text")
    kept = dict(lines.joined(lines.dedupe_blocks(rows)).collect())
    skipped = dict(lines.joined(lines.skip_sections(rows, ["Watch", "Listen", "Read"])).collect())
    bare = lambda t: [x.strip() for x in (t or "").split("\n") if x.strip()]
    for doc, text in docs.collect():
        assert bare(kept.get(doc)) == bare(rewrite.dedupe_repeated_blocks(text))
        assert bare(skipped.get(doc)) == bare(rewrite.skip_card_sections(text))


def test_structure_agrees(docs):
    rows = lines.md_lines(docs, "doc", "text")
    empty = {tuple(r) for r in lines.empty_sections(rows).select("doc", "pos", "level", "title").collect()}
    issues = sorted(tuple(r) for r in lines.heading_issues(rows).select("doc", "pos", "issue").collect())
    local = [(d, t) for d, t in docs.collect()]
    assert empty == {(d, x["pos"], x["level"], x["title"]) for d, t in local for x in structure.empty_sections(t)}
    assert issues == sorted((d, x["pos"], x["issue"]) for d, t in local for x in structure.heading_issues(t))


def test_columns_are_the_rules(docs):
    got = docs.select(
        "text", rules.clamp_jumps("text").alias("a"), rules.assembled("text", ["Notes"]).alias("b"), rules.polish("text").alias("c"), rules.normalise_headings("text", max_level=3).alias("d"),
        rules.structure_issues("text").alias("e"),
    ).collect()
    for r in got:
        assert (r.a, r.b, r.c) == (rewrite.clamp_jumps(r.text), rewrite.assembled(r.text, ["Notes"]), rewrite.polish(r.text, {}))
        assert r.d == rewrite.normalise_headings(r.text, max_level=3) and r.e == structure.issues(r.text)
    assert docs.select(rules.clamp_jumps(F.lit(None).cast("string")).alias("x")).first().x is None


def test_islands_of_table_rows(spark):
    text = "a\n| x |\n| y |\nb\n| z |\n|\n|| q"
    got = lines.table_islands(lines.md_lines(spark.createDataFrame([(1, text)], "doc int, text string"), "doc", "text")).orderBy("pos").collect()
    assert [(r.island, r.row) for r in got] == [(None, None), (1, 1), (1, 2), (None, None), (2, 1), (None, None), (3, 1)]
