import random

import brute
import pytest
from pyspark.sql import Row

from readloom.llm import components as star
from readloom.llm import minhash
from readloom.llm.components import components

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def varied(words, share):
    return [RNG.choice(VOCABULARY) if RNG.random() < share else x for x in words]


@pytest.fixture(scope="module")
def corpus():
    base = [RNG.choice(VOCABULARY) for _ in range(120)]
    texts = [" ".join(varied(base, s)) for s in (0.0, 0.01, 0.02, 0.03, 0.04, 0.05) for _ in range(25)]
    texts += [" ".join(RNG.choice(VOCABULARY) for _ in range(RNG.randrange(1, 200))) for _ in range(60)]
    texts += ["A b", "a  B", "a b c", "", "  \t", "x" * 300_000, "x" * 300_000 + " y"] + ["same words over here again"] * 5
    texts += [" ".join(["la"] * n) for n in (5, 6, 50)]
    RNG.shuffle(texts)
    return list(enumerate(texts, 100))


def result(spark, rows, schema="doc_id long, text string"):
    return minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()


def test_components_match_brute_force(spark, corpus):
    want = brute.components(corpus)
    got = {r.doc_id: r for r in result(spark, corpus)}
    assert len(got) == len(corpus)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_nulls_repeats_and_clashing_columns(spark):
    text = "one two three four five six"
    rows = [(1, text, 7), (None, text, 8), (3, None, 9), (4, None, None), (1, text, 7), (None, None, 0), (5, text.upper(), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").selectExpr("*", "component_id as node", "1 as key", "2 as bands")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 1, False)]


def test_clashing_and_missing_ids(spark):
    """Rows of one id are judged by their texts; of a group without ids one text stays."""
    make = lambda n: [RNG.choice(VOCABULARY) for _ in range(n)]
    a, b, c, d = make(100), make(90), make(80), make(70)
    join = " ".join
    rows = [(3, join(a)), (7, join(a)), (7, join(b)), (7, join(b + ["end"])), (9, join(c)), (None, join(c)), (None, join(d)), (None, join(d).upper()), (None, join(d + ["z"])), (7, join(c[:40])), (9, join(c))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("text_hash", "h")
    texts = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string").selectExpr("text", "xxhash64(text) as h")
    got = {(r.doc_id, r.text): (r.component_id, r.kept) for r in found.join(texts, "h").collect()}
    assert got[3, join(a)] == (3, True) and got[7, join(a)] == (3, False)
    assert sorted(got[7, t][1] for t in (join(b), join(b + ["end"]))) == [False, True]
    assert got[9, join(c)] == (9, True) and got[None, join(c)] == (9, False) and got[7, join(c[:40])][1]
    nameless = [got[None, t] for t in (join(d), join(d).upper(), join(d + ["z"]))]
    assert sorted(k for _, k in nameless) == [False, False, True] and {x for x, _ in nameless} == {None}


def test_large_buckets_are_broadcast(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, corpus)}
    assert got == brute.components(corpus)


def test_empty_table(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("large", [512, 3])
def test_large_and_small_star(spark, monkeypatch, large):
    monkeypatch.setattr(star, "LARGE", large)
    chain = [Row(u=i, v=i + 1) for i in range(1, 40)] + [Row(u=100 + i, v=100) for i in range(1, 30)] + [Row(u=7, v=7), Row(u=None, v=3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
