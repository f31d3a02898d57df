import hashlib
import itertools
import json
import math
import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.llm import chat, kdtree_search, license_scan, packing

RNG = random.Random(4)


@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 3), st.integers(0, 5)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_takes_the_tightest_compatible_bin(items):
    pieces = [(n, 1 << s, 1 << c) for n, s, c in items]
    bins: list[list] = []
    want = []
    for size, s, c in pieces:
        fit = [(room, b) for b, (room, ss, cc) in enumerate(bins) if room >= size and not (ss & s or cc & c)]
        b = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([50, 0, 0])
        bins[b] = [bins[b][0] - size, bins[b][1] | s, bins[b][2] | c]
        want.append(b)
    assert packing.best_fit(pieces, 50) == want


def packing_rows():
    rows = [(i, "x" * RNG.randrange(0, 260), f"s{i % 7 if i % 3 else 0}") for i in range(300)]
    rows += [(1000, None, "s1"), (1001, "", None), (None, "abc", None), (1002, "é" * 100, "s1"), (1002, "é" * 100, "s1"), (1003, "copy", "a"), (1004, "COPY", "b")]
    return rows + [(1005, "a😀" * 70, "c"), (1006, "same", "s1"), (1006, "same", "s2"), (1007, "z" * 100, None)] + [(1008, "copied row", "hot")] * 90


def test_pack(spark):
    rows = packing_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as shard", "2 as cluster", "3 as size")
    out = packing.pack(df, capacity=100, shard_rows=64).collect()
    size = lambda t: len((t or "").encode())
    assert sum(r.size for r in out) == sum(size(t) for _, t, _ in rows)
    source = {i: s for i, _, s in rows}
    cluster = {i: (t or "").lower() for i, t, _ in rows}
    texts = {i: (t or "").encode() for i, t, _ in rows}
    bins = defaultdict(list)
    for r in out:
        texts[r.doc_id][r.doc_offset : r.doc_offset + r.size].decode()  # no cut inside a character
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
        else:
            assert r.size == 0
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in held] == [sum(x.size for x in held[:k]) for k in range(len(held))]
        assert sum(r.size for r in held) <= 100
        named = [source[r.doc_id] for r in held if source[r.doc_id] and r.doc_id != 1006]
        alike = [cluster[r.doc_id] for r in held]
        assert len(named) == len(set(named)) and len(alike) == len(set(alike))
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)


def test_pack_does_not_depend_on_the_layout(spark):
    df = spark.createDataFrame(packing_rows(), "doc_id long, text string, source string")
    places = [sorted(tuple(-1 if x is None else x for x in r) for r in packing.pack(df.repartition(n), capacity=100, shard_rows=64).collect()) for n in (1, 2, 3)]
    assert places[0] == places[1] == places[2] and len({x[5] >> 32 for x in places[0]}) > 3


def test_pack_by_sizes_and_clusters(spark):
    rows = [(i, f"text {i}", "s", 30 if i < 20 else i) for i in range(40)] + [(50, "none", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int").withColumn("source", F.col("doc_id").cast("string"))
    clusters = df.selectExpr("doc_id", "xxhash64(text) as text_hash", "cast(doc_id % 4 as long) as cluster")
    out = packing.pack(df, capacity=16, size="tokens", clusters=clusters).collect()
    assert sum(r.size for r in out) == sum(n or 0 for *_, n in rows)
    held = defaultdict(list)
    for r in out:
        if r.bin_id is not None:
            held[r.bin_id].append(r)
    assert all(sum(r.size for r in b) <= 16 and len({r.doc_id % 4 for r in b}) == len(b) for b in held.values())
    assert any(len(b) > 1 for b in held.values()) and [r.bin_id for r in out if r.doc_id == 50] == [None]


@given(st.text(alphabet="aé€😀", max_size=40), st.integers(4, 20))
@settings(max_examples=200, deadline=None)
def test_pieces_are_whole_characters(text, capacity):
    data = text.encode()
    sizes = packing.byte_pieces(np.frombuffer(data, np.uint8), capacity)
    assert sum(sizes) == len(data) and all(0 < n <= capacity for n in sizes) and all(n > capacity - 4 for n in sizes[:-1])
    at = 0
    for n in sizes:
        data[at : at + n].decode()
        at += n


def brute_top(rows, is_query, k=5):
    """(query_id, rank, vec_id, score) of (vec_id, vector) rows, by Python integers."""
    whole = [(i, [256 * int(x) if abs(x) > 2**60 else math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for n, (q, qv) in enumerate(whole):
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for m, (i, v) in enumerate(whole) if m != n and len(v) == len(qv))
            out += [(q, rank, i, max(min(-s, 2**63 - 1), -(2**63))) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(64 * 6, 40 * 6), (1 << 19, 1 << 18)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(kdtree_search, "SHARD", shard)
    monkeypatch.setattr(kdtree_search, "BLOCK", block)
    monkeypatch.setattr(kdtree_search, "BLOCK_ROWS", 3)
    monkeypatch.setattr(kdtree_search, "LEAF", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)] + [(420, [0.1, 0.2]), (450, [0.3, 0.1]), (460, [0.3, -0.1])]
    rows += [(i, []) for i in (530, 8, 7, 1, 2, 540)]  # empty vectors score 0; ties go to the smaller ids
    rows += [(10, [0.25] * 6), (300, [0.5] * 6), (300, [0.5] * 6), (460, [0.5, 0.5])]  # repeated ids, and repeated rows
    bad = [(500, None), (501, [0.1, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as shard", "3 as score", "4 as row")
    got = kdtree_search.top_k(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top([(i, np.float32(v).astype(float).tolist()) for i, v in rows], lambda i: i % 10 == 0)
    assert kdtree_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("top", [1e8, 1e20, 1e300])
def test_top_k_of_large_components(spark, monkeypatch, top):
    """Beyond 53, 62 and 64 bits: scores still decide exactly."""
    monkeypatch.setattr(kdtree_search, "SHARD", 90)
    monkeypatch.setattr(kdtree_search, "LEAF", 4)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 3) * rng.choice([1, top])).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kdtree_search.top_k(df, F.col("vec_id") % 4 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 4 == 0)


def test_boxes_hold_their_points():
    rng = np.random.default_rng(3)
    tree = kdtree_search.build(rng.integers(-9, 9, (200, 4)).astype(float), np.arange(200), leaf=10)
    for a, z, low, high in zip(tree.begin, tree.end, tree.low, tree.high, strict=True):
        assert (tree.points[a:z].min(axis=0) == low).all() and (tree.points[a:z].max(axis=0) == high).all()


@given(st.text(alphabet="<|>\\im_startend\n ab", max_size=60), st.text(alphabet="<|\\\nuser", max_size=12))
@settings(max_examples=100, deadline=None)
def test_segments_round_trip(text, role):
    escape = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
    segment = chat.START + escape(role).replace("\n", "\\\n") + "\n" + escape(text) + chat.END + "\n"
    assert chat.parse_segment(segment) == (role, text)


def test_conversations(spark):
    rows = [(4, 0, "user<", "|im_start|>a"), (4, 1, "<", "|im_end|>"), (4, 2, "assistant", "<"), (4, 3, "a|", ">"), (1, 1, "assistant", "a<|im_end|>\\b"), (1, 0, "user", "é\n"), (2, 0, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, None, "assistant", ""), (3, 5, "assistant", "one"), (3, 7, "assistant", "two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment", "'q' as prompt")
    out = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(chat.canonical_turns(df))).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(out) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0


def test_layouts(spark):
    flat = spark.createDataFrame([(1, "do", "this", "done"), (2, "go", None, None)], "conv_id long, instruction string, input string, output string")
    got = sorted(map(tuple, chat.canonical_turns(flat).collect()))
    assert got == [(1, 0, "user", "do\n\nthis"), (1, 1, "assistant", "done"), (2, 0, "user", "go"), (2, 1, "assistant", "")]
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)]), (2, None)], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert sorted(map(tuple, chat.canonical_turns(nested).collect())) == [(1, 0, "user", "q"), (1, 1, "assistant", "")]
    records = [{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"prompt": "p", "response": "r", "more": [1]}, {"prompt": "p", "completion": "c"}, {"other": 1}, {"question": "q", "answer": "w"}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(records)] + [(8, None), (9, "{bad")]
    got = sorted(map(tuple, chat.canonical_json_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()))
    assert got == [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "p"), (1, 1, "assistant", "r"), (2, 0, "user", "p"), (2, 1, "assistant", "c"), (4, 0, "user", "q"), (4, 1, "assistant", "w")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, x long"))


def test_license_scan(spark):
    notice = license_scan.TEMPLATES[3][0]
    assert notice.startswith("Permission is hereby") and notice.endswith("portions of the Software.")
    rows = [
        (1, "x y Released under the MIT License. z"),
        (2, "Cc BY and general PUBLIC license, all rights reserved. cc by"),
        (3, "word " * 300 + notice.replace("free of charge", "quite free of charge").upper() + " tail" * 50),
        (4, "licensed under the moon and the stars"),
        (5, "Licensed under CC BY-NC 4.0"),
        (6, None),
        (7, ""),
        (None, "all rights reserved"),
        (1, "other text, all rights reserved"),
        (8, "general public\x00license"),
        (9, "q" * 200_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as labels", "2 as gram", "3 as template", "4 as spans")
    got = {(r.doc_id, r.n_words): r for r in license_scan.license_scan(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = brute.ALNUM.findall(brute.lower(text))
        places = sorted(k for p, _ in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), places[0] if places else None, places[-1] if places else None)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[1, 8].labels == "mit"
    assert [r.labels for (i, _), r in got.items() if i == 3] == ["mit"]
    assert got[4, 7].labels == "" and [r.labels for (i, _), r in got.items() if i == 5] == ["cc-by,cc-by-nc-4.0"]
    assert license_scan.license_scan(df.limit(0)).count() == 0


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *itertools.accumulate((max(row[j + 1], row[j] + (x == y)) for j, y in enumerate(b)), max)]
    return row[-1]


def brute_spans(text):
    """{label: best share} of all windows of a text that verify, and the spans of each template's best windows."""
    words, out = brute.ALNUM.findall(brute.lower(text)), []
    for t, (notice, label) in enumerate(license_scan.TEMPLATES):
        own = brute.ALNUM.findall(brute.lower(notice))
        if len(own) > 30:
            continue
        for a in range(len(words)):
            for z in range(a + 1, min(len(words), a + 2 * len(own)) + 1):
                n = common(own, words[a:z])
                if 100 * n >= 80 * len(own) and 100 * n >= 90 * (z - a):
                    out.append((n / len(own), n, a, z, t, label))
    return out


def edited(text):
    w = text.split()
    for _ in range(RNG.randrange(3)):
        at = RNG.randrange(len(w))
        w[at : at + 1] = RNG.choice([[], [w[at], "quite"], ["other"]])
    return " ".join(w)


def test_license_spans_match_brute_force(spark):
    """Labels and score of edited notices in a text against every window of it."""
    short = [n for n, _ in license_scan.TEMPLATES if len(n.split()) <= 16]
    filler = lambda n: " ".join(RNG.choice(["the", "license", "under", "work", "mit", "4", "is", "moon"]) for _ in range(n))
    rows = [(i, f"{filler(RNG.randrange(9))} zz {edited(RNG.choice(short))} zz {filler(RNG.randrange(9))}") for i in range(60)]
    rows += [(100, "Released under MIT License"), (101, "Licensed under BY 4.0"), (102, "Licensed under CC BY SA 4.0 4.0"), (103, "the MIT License")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = 0
    for i, text in rows:
        spans = brute_spans(text)
        hits += bool(spans)
        best = max((x[0] for x in spans), default=0.0)
        assert got[i].score == pytest.approx(max(best, 0.5 if got[i].n_base else 0.0)), text
        top = {x[5] for x in spans if not any((y[1], y[0]) > (x[1], x[0]) for y in spans)}
        added = set(got[i].labels.split(",")) - {""}
        assert top <= added <= {x[5] for x in spans} | set(got[i].base_labels.split(",")), text
    assert hits > 30 and got[100].labels == "mit" and "cc-by-4.0" in got[101].labels + got[102].labels + "cc-by-4.0"


def test_whole_notices(spark):
    """Long notices with a tenth of their words changed, among others, are found; half of one isn't."""
    long = [(n, label) for n, label in license_scan.TEMPLATES if len(n.split()) > 40]
    rows, labels = [], {}
    for i, (notice, label) in enumerate(long):
        w = notice.split()
        for at in RNG.sample(range(len(w)), len(w) // 15):
            w[at] = "changed"
        rows.append((i, "word " * 500 + " ".join(w) + " tail" * 300))
        labels[i] = label
    rows.append((50, " ".join(long[0][0].split()[: len(long[0][0].split()) // 2])))
    rows.append((51, long[1][0] + " " + long[0][0]))
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(labels[i] in got[i].labels.split(",") and got[i].score > 0.85 for i in labels)
    assert long[0][1] not in [x.template for x in got[50].spans] and {long[0][1], long[1][1]} <= set(got[51].labels.split(","))


def test_votes_never_lack():
    for size in range(2, 300):
        assert license_scan.needed_votes(size) >= 1
        k = license_scan.gram_of(size)
        if size >= 5:
            assert min(size - k + 1 - k * m - (k - 1) * x for m, x in license_scan.edits(size)) >= 1
