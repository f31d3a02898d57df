import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import _common
from readloom.llm import decontaminate as d

RNG = random.Random(8)
WORDS = [f"t{i}" for i in range(60)] + ["é", "9", "B"]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("bounds", [{}, {"BROADCAST_ROWS": 20, "FREQUENT": 3, "PART_WORDS": 40}])
def test_matches_brute_force(spark, monkeypatch, bounds):
    """Also beyond the bounds of broadcasts, where frequent prints are joined apart and hits come in parts."""
    for name, value in bounds.items():
        monkeypatch.setattr(d, name, value)
    if bounds:
        monkeypatch.setattr(_common, "BROADCAST_BYTES", 100)
    items = [(i, text(RNG.choice([13, 14, 20, 40, 60]))) for i in range(12)] + [(50, "alpha beta"), (51, "Gamma"), (52, None), (53, " .!"), (54, "re " * 20), (None, "delta eps zeta eta")]
    items += [(60, items[0][1].upper()), (61, items[1][1])]
    docs = []
    for i in range(120):
        parts = [text(RNG.randrange(0, 200))]
        if i % 2:
            words = RNG.choice(items[:12])[1].split()
            at, n = RNG.randrange(len(words)), RNG.randrange(5, 40)
            parts.append(" ".join(words[at : at + n]))
        docs.append((i, "-".join(parts) + " " + text(RNG.randrange(0, 30))))
    docs += [(200, None), (201, ""), (202, "x ALPHA, beta y gamma"), (203, "re " * 500), (204, "delta eps zeta eta"), (None, items[2][1]), (205, "z" * 200_000)]
    docs += [(202, "other text of one id"), (202, "other text of one id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit", "2 as passage", "3 as print", "4 as key")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as at")
    got = d.contamination(df, bench).collect()
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    want = [(i, *brute.contamination(t, items)) for i, t in docs]
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in d.contamination(docs, none).collect()] == [(3, 0, False)]
    assert d.contamination(docs.limit(0), none).count() == 0


@given(st.lists(st.integers(0, 5), min_size=9, max_size=80), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_every_shared_window_keeps_a_common_print(values, cut):
    grams = np.array(values, np.uint64)
    part = grams[cut : cut + d.WINDOW]
    if len(part) == d.WINDOW:
        assert set(d.winnow(part) + cut) & set(d.winnow(grams).tolist())
