import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.functions import cigar, scalars, tags
from readloom.operators import calls, intervals, mods, pairs, pileup, reads

READ = "read_id long, qname string, flag int, contig string, pos long, mapq int, text string, seq string, qual array<int>"


def frame(spark, rows):
    """(cigar, pos) or longer rows to reads with made-up bases."""
    out = []
    for i, (text, pos, *more) in enumerate(rows):
        n = sum(int(k) for k, op in __import__("re").findall(r"(\d+)([MIDNSHP=X])", text) if op in "MIS=X")
        seq = more[0] if more else ("ACGT" * n)[:n]
        out.append((i, more[1] if len(more) > 1 else f"q{i}", more[2] if len(more) > 2 else 0, "c", pos, 60, text, seq, [30] * len(seq)))
    return spark.createDataFrame(out, READ).withColumn("ops", cigar.parse(F.col("text")))


# CIGAR, position -> (position, kind, query position, insertion) columns, written by hand
SHAPES = [
    ("3M", [(0, "match", 0, 0), (1, "match", 1, 0), (2, "match", 2, 0)]),
    ("2S2M1H", [(0, "match", 2, 0), (1, "match", 3, 0)]),
    ("2M1I1M", [(0, "match", 0, 0), (1, "insertion", 1, 1), (2, "match", 3, 0)]),
    ("1M2D1M", [(0, "match", 0, 0), (1, "del", None, 0), (2, "del", None, 0), (3, "match", 1, 0)]),
    ("1M2D1I1M", [(0, "match", 0, 0), (1, "del", None, 0), (2, "complex", None, 1), (3, "match", 2, 0)]),
    ("1M1I2D1M", [(0, "insertion", 0, 1), (1, "del", None, 0), (2, "del", None, 0), (3, "match", 2, 0)]),
    ("1M1P2I1P1I1M", [(0, "insertion", 0, 3), (1, "match", 4, 0)]),
    ("1M2N1I1M", [(0, "match", 0, 0), (1, "skip", None, 0), (2, "complex", None, 1), (3, "match", 2, 0)]),
    ("2I2M", [(0, "match", 2, 0), (1, "match", 3, 0)]),
    ("2=1X", [(0, "match", 0, 0), (1, "match", 1, 0), (2, "match", 2, 0)]),
    ("2M2D", [(0, "match", 0, 0), (1, "match", 1, 0), (2, "del", None, 0), (3, "del", None, 0)]),
    ("3I", []),
]


@pytest.mark.parametrize(("text", "want"), SHAPES)
def test_pileup_of_each_shape(spark, text, want):
    cols = pileup.columns(frame(spark, [(text, 0)])).orderBy("pos").collect()
    assert [(r.pos, r.kind, r.qpos, r.insert_len) for r in cols] == want


def test_missing_sequence_and_clipping(spark):
    df = frame(spark, [("5M", 10, "")])
    rows = pileup.columns(df, 12, 13).orderBy("pos").collect()
    assert [(r.pos, r.base, r.qual) for r in rows] == [(12, "N", 255), (13, "N", 255)]


CIGARS = st.lists(st.tuples(st.integers(1, 6), st.sampled_from("MIDNSP=X")), min_size=1, max_size=6)


@given(st.lists(st.tuples(CIGARS, st.integers(0, 30)), min_size=1, max_size=8))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_sweep_and_tiles_equal_the_exploded_pileup(spark, made):
    df = frame(spark, [("".join(f"{n}{op}" for n, op in ops), pos) for ops, pos in made])
    depth = {r.pos: r.depth for r in pileup.depth(pileup.columns(df)).collect()}
    swept = {}
    for r in pileup.depth_sweep(df, tile=7).collect():
        for p in range(r.start, r.end + 1):
            assert p not in swept
            swept[p] = r.depth
    assert swept == depth
    tiles = intervals.segments(spark.createDataFrame([("c", 70)], "contig string, length int"), 9, 2).collect()
    joined = {}
    for t in tiles:
        for r in pileup.depth(pileup.columns(df, t.start, t.end)).collect():
            if t.core_start <= r.pos <= t.core_end:
                joined[r.pos] = r.depth
    assert joined == depth


@given(st.lists(st.tuples(CIGARS, st.integers(0, 30)), min_size=1, max_size=6))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_nm_is_mismatches_deletions_and_insertions_of_md(spark, made):
    import re

    df = frame(spark, [("".join(f"{n}{op}" for n, op in ops if op not in "=X") or "1M", pos) for ops, pos in made])
    letters = pairs.by_position(reads.reference_base)
    nm = {r.read_id: r for r in pairs.mismatch_counts(df, letters).collect()}
    for r in pairs.md_text(df, letters).where("md is not null").collect():
        assert re.fullmatch(r"\d+((\^[ACGTN]+|[ACGTN])\d+)*", r.md)
        deleted = sum(len(x) - 1 for x in re.findall(r"\^[ACGTN]+", r.md))
        wrong = len(re.sub(r"\^[ACGTN]+|\d", "", r.md))
        if r.read_id in nm:
            x = nm[r.read_id]
            assert (x.deleted, x.mismatches, x.nm) == (deleted, wrong, deleted + wrong + x.inserted)


def test_walk_options(spark):
    df = frame(spark, [("2S2M1I1P1D1N1M3H", 5)])
    seen = lambda ops: [(r.op, r.qpos, r.rpos, r.len) for r in pairs.aligned_pairs(df, ops).orderBy("i", "qpos").collect()]
    default = [("M", 2, 5, 1), ("M", 3, 6, 1), ("I", 4, None, 1), ("D", None, 7, 1), ("N", None, 8, 1), ("M", 5, 9, 1)]
    assert seen(pairs.DEFAULT) == default
    assert seen(pairs.CLIPS) == [("S", 0, None, 2), *default]
    assert ("P", None, None, 1) in seen(pairs.FULL)


def test_cigar_functions(spark):
    rows = [("*",), ("5M",), ("2S3M1I2D4M1H",), ("3M2N",), ("1D2M2I3N1D",), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", cigar.parse(F.col("t")).alias("o"))
    got = {
        r[0]: tuple(r)[1:]
        for r in df.select(
            "t", cigar.render(F.col("o")), cigar.query_length(F.col("o")), cigar.reference_length(F.col("o")),
            cigar.end_position(F.lit(7), F.col("o")), cigar.is_linear(F.col("o")), cigar.render(cigar.trim_trailing(F.col("o"))),
        ).collect()
    }
    assert got["*"] == ("*", 0, 0, 7, False, "*") and got[None][0] == "*"
    assert got["2S3M1I2D4M1H"] == ("2S3M1I2D4M1H", 10, 9, 15, False, "2S3M1I2D4M1H")
    assert got["3M2N"][5] == "3M" and got["1D2M2I3N1D"][5] == "1D2M2I" and got["5M"][4] is True
    with pytest.raises(Exception, match="bad CIGAR"):
        spark.range(1).select(cigar.parse(F.lit("5Q"))).collect()


def test_strand_flags_and_regions(spark):
    flags = [0, 16, 65, 81, 129, 161, 1]
    df = spark.createDataFrame([(f,) for f in flags], "f int")
    assert [r[0] for r in df.select(scalars.strand(F.col("f"))).collect()] == ["OT", "OB", "OT", "OB", "OT", "OB", "NA"]
    assert scalars.parse_region("chr1:5-9") == scalars.Region("chr1", 5, 9) and scalars.parse_region("x").zero_based(10) == (0, 9)
    for bad in ("", "c:0", "c:9-5", "c:", "c:5-", "é:1"):
        with pytest.raises(ValueError):
            scalars.parse_region(bad)
    with pytest.raises(ValueError):
        scalars.parse_region("c:5-20").zero_based(10)


def test_float_text_and_rms(spark):
    xs = [0.0, 60.0, 0.1, 1234567.0, 3.14159265, -2.5, 0.000123456789]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scalars.float_text(F.col("x"))).collect()]
    assert got == ["0", "60", "0.1", "1234567", "3.14159", "-2.5", "0.0001234568"] or got[:6] == ["0", "60", "0.1", "1234567", "3.14159", "-2.5"]
    assert spark.createDataFrame([], "x int").agg(scalars.root_mean_square(F.col("x"))).first()[0] == 0.0
    p = spark.createDataFrame([(float("nan"),), (-1.0,), (100.0,), (12.5,)], "x double").select(scalars.phred_int(F.col("x"))).collect()
    assert [r[0] for r in p] == [0, 0, 99, 13]


def test_best_alt_ties_go_to_the_earlier_base(spark):
    df = spark.createDataFrame([(2, 2, 0, 1, "A"), (2, 2, 2, 2, "T"), (0, 0, 0, 5, "T"), (1, 1, 1, 1, "N")], "n_a long, n_c long, n_g long, n_t long, r string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(pileup.best_alt(F.col("r"))).collect()]
    assert got == [("C", 2), ("A", 2), None, None]


def test_mate_dedup_rules(spark):
    rows = [("3M", 0, "AAA", "q", 128), ("3M", 0, "CCC", "q", 64), ("3M", 0, "GGG", "q", 0), ("1M1D1M", 10, "AA", "p", 64), ("3M", 10, "CCC", "p", 128)]
    got = pileup.mate_deduplicated(frame(spark, rows)).where("pos in (0, 11)").orderBy("pos", "read_id").collect()
    assert [(r.pos, r.base) for r in got] == [(0, "C"), (0, "G"), (11, "C")]


def test_modifications(spark):
    rows = [(1, "ACCAC", 0, "C+mh,1,0;A+a.,0;", [1, 2, 3, 4, 5]), (2, "AGGTG", 16, "C+m,1;", [9]), (3, "AC", 0, None, None), (4, "CCC", 0, "C+27551?,0;", [7])]
    df = spark.createDataFrame(rows, "read_id long, seq string, flag int, mm string, ml array<int>")
    got = sorted((r.read_id, r.qpos, r.mod, r.prob) for r in mods.calls(df).collect())
    assert got == [(1, 0, "a", 5), (1, 2, "h", 2), (1, 2, "m", 1), (1, 4, "h", 4), (1, 4, "m", 3), (2, 2, "m", 9), (4, 0, "m", 7)]
    with pytest.raises(Exception, match="differ"):
        mods.calls(df.where("read_id = 2").withColumn("ml", F.array(F.lit(1), F.lit(2)))).collect()
    with pytest.raises(Exception, match="bad MM"):
        mods.calls(df.where("read_id = 2").withColumn("mm", F.lit("N*m,1;"))).collect()


def test_tags(spark):
    df = spark.createDataFrame([(["NM:i:7", "XA:A:c", "XB:B:s,-1,2", "x", "NM:i:9", "XF:f:1.5", "XH:H:0g"],)], "f array<string>").select(tags.parse(F.col("f")).alias("t"))
    t = F.col("t")
    r = df.select(tags.get_int(t, "NM"), tags.get_text(t, "XA"), tags.get_array(t, "XB"), tags.get_float(t, "XF"), tags.get_int(t, "XF"), tags.get_bytes(t, "XH"), tags.get_int(t, "ZZ")).first()
    assert tuple(r) == (7, "c", [-1.0, 2.0], 1.5, None, None, None)
    r = df.select(tags.render(tags.put(tags.remove(t, "XA"), "NM", "i", F.lit(1)))).first()[0]
    assert r[0] == "NM:i:1" and not any(x.startswith("XA") for x in r)


def test_reg2bins_hold_reg2bin(spark):
    spans = [(0, 1), (0, 1 << 29), (16383, 16385), (1 << 20, (1 << 20) + 5), (5_000_000, 9_000_000)]
    df = spark.createDataFrame(spans, "a long, z long").select("a", "z", intervals.reg2bin(F.col("a"), F.col("z")).alias("b"))
    for r in df.collect():
        assert r.b in intervals.reg2bins(r.a, r.z)
    assert intervals.reg2bins(0, 1) == [0, 1, 9, 73, 585, 4681]


def test_overlap_join_and_merge(spark):
    import random

    rng = random.Random(1)
    make = lambda n: [(f"c{rng.randrange(2)}", a := rng.randrange(5000), a + rng.randrange(3000), i) for i in range(n)]
    a, b = make(80), make(60)
    schema = "contig string, start long, end long, id int"
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 256).select("l_id", "r_id").collect()
    want = [(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(map(tuple, got)) == sorted(want)
    touching = [("c", 0, 4, 0), ("c", 5, 6, 1), ("c", 8, 9, 2), ("c", 0, 1, 3)]
    merged = intervals.merged(spark.createDataFrame(touching, schema)).orderBy("start").collect()
    assert [(r.start, r.end, r.n) for r in merged] == [(0, 6, 3), (8, 9, 1)]


def test_allele_kinds_and_genotypes(spark):
    rows = [("A", "C"), ("A", "AC"), ("AC", "A"), ("AC", "GT"), ("A", "."), ("A", "A"), ("", "A")]
    got = [r[0] for r in spark.createDataFrame(rows, "r string, a string").select(calls.allele_kind(F.col("r"), F.col("a"))).collect()]
    assert got == ["snv", "insertion", "deletion", "complex", "reference", None, None]
    g = spark.range(1).select(calls.genotype_text(F.array(F.lit(0), F.lit(None).cast("int"), F.lit(2)), F.array(F.lit(True), F.lit(False)))).first()[0]
    assert g == "0|./2"


def test_with_alignment_checks_lengths(spark):
    df = frame(spark, [("4M", 3)])
    assert reads.with_alignment(df, F.lit(9).cast("long"), cigar.parse(F.lit("2S2M"))).first().pos == 9
    with pytest.raises(Exception, match="differ in length"):
        reads.with_alignment(df, F.lit(9).cast("long"), cigar.parse(F.lit("5M"))).collect()


def test_phred_of_zero_probability(spark):
    x = scalars.phred(F.col("p"))
    rows = spark.createDataFrame([(0.0,), (0.01,), (1.0,), (None,)], "p double").select(x.alias("x"), scalars.phred_int(x).alias("n")).collect()
    assert rows[0].x == float("inf") and [r.n for r in rows] == [99, 20, 0, None]


def test_modification_texts(spark):
    """Any letter is a code, U and N are no bases, each entry ends with a semicolon; without deltas no probabilities are needed."""
    make = lambda mm, ml: spark.createDataFrame([(1, "ACCAC", 0, mm, ml)], "read_id long, seq string, flag int, mm string, ml array<int>")
    got = lambda mm, ml: sorted((r.qpos, r.mod, r.prob) for r in mods.calls(make(mm, ml)).collect())
    assert got("C+C,0;", [5]) == [(1, "C", 5)] and got("c+m,2;", [6]) == [(4, "m", 6)] and got("C+m;", None) == [] and got("", None) == []
    for bad, why in [("C+m,0", "semicolon"), ("N+m,0;", "base N"), ("U+m,0;", "bad base"), ("C*m,0;", "strand"), ("C+,0;", "code"), ("C+m,x;", "delta"), (";", "bad"), ("C+m,4294967296;", "number")]:
        with pytest.raises(Exception, match=why):
            got(bad, [1])
    with pytest.raises(Exception, match="differ"):
        got("C+m,0;", None)


def test_unmodified_needs_the_dot(spark):
    rows = [("C+m,0;",), ("C+m?,0;",), ("C+m.,0;",)]
    found = F.array().cast("array<struct<qpos:int>>")
    got = [r[0] for r in spark.createDataFrame(rows, "mm string").select(mods.is_unmodified(found, mods.entries(F.col("mm")), F.lit(3), F.lit("C"))).collect()]
    assert got == [None, None, True]


def template(spark, rows):
    """(contig, pos, length, flag) rows of one template in file order to their lengths."""
    made = [(i, "q", f, c, p, 60, f"{n}M", "", []) for i, (c, p, n, f) in enumerate(rows)]
    df = spark.createDataFrame(made, READ).withColumn("ops", cigar.parse(F.col("text")))
    return [r.tlen for r in reads.template_lengths(df).orderBy("read_id").collect()]


def test_template_lengths(spark):
    """The first read of a template decides the sign, all others have the opposite one."""
    assert template(spark, [("c", 10, 5, 65), ("c", 20, 5, 129)]) == [15, -15]
    assert template(spark, [("c", 20, 5, 65), ("c", 10, 5, 129)]) == [-15, 15]
    assert template(spark, [("c", 15, 5, 65), ("c", 10, 5, 129), ("c", 20, 5, 129)]) == [-15, 15, 15]
    assert template(spark, [("c", 10, 9, 65), ("c", 10, 9, 129)]) == [9, -9] and template(spark, [("c", 10, 9, 129), ("c", 10, 9, 65)]) == [-9, 9]
    assert template(spark, [("c", 10, 9, 129), ("c", 10, 5, 65)]) == [-9, 9] and template(spark, [("c", 10, 9, 65), ("c", 12, 3, 129)]) == [9, -9]
    assert template(spark, [("c", 10, 9, 65), ("d", 12, 3, 129)]) == [0, 0] and template(spark, [("c", 10, 9, 65), ("c", 12, 3, 133)]) == [0, 0]


def test_one_pair_a_template(spark):
    rows = [(i, "q", 65 if i % 2 else 129, "c", i, 60, "5M", "", []) for i in range(400)] + [(900, "p", 65, "c", 1, 60, "5M", "", []), (901, "p", 129 + 256, "c", 9, 60, "5M", "", [])]
    df = spark.createDataFrame(rows, READ).withColumn("ops", cigar.parse(F.col("text")))
    assert [tuple(r) for r in reads.mates(df).collect()] == [("q", 1, 0, "c", "c", -1)]


def test_as_of_keeps_every_point(spark):
    points = spark.createDataFrame([(5,), (5,), (100,), (101,), (90_000,), (-7,)], "at long")
    marks = spark.createDataFrame([(5, 1), (100, 2), (100, 3), (200, 4)], "mark long, value long")
    for width in (1, 10, 1000):
        got = sorted((r.at, r.mark, r.value) for r in intervals.as_of(points, marks, width).where("mark is not null").collect())
        assert got == [(5, 5, 1), (5, 5, 1), (100, 100, 3), (101, 100, 3), (90_000, 200, 4)]
        assert intervals.as_of(points, marks, width).count() == 6


def test_float_texts_of_all_sizes(spark):
    xs = [1.23456e-7, 1e-12, float("inf"), float("-inf"), float("nan"), None, -0.0, 35.89775, 0.777778, 1e6, 16777216.0, -1234.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scalars.float_text(F.col("x"))).collect()]
    assert got == ["0.000000123456", "0.000000000001", "inf", "-inf", ".", ".", "0", "35.8978", "0.777778", "1000000", "16777216", "-1234.5"]


def test_reserved_cigar_codes_round_trip(spark):
    words = [10 << 4, 3 << 4 | 9, 7 << 4 | 15]
    df = spark.createDataFrame([(words,)], "w array<long>").select(cigar.from_codes(F.col("w")).alias("o"))
    assert df.select(cigar.codes(F.col("o"))).first()[0] == words and [o.op for o in df.first().o] == ["M", "9", "15"]


def test_placement_of_many_ops(spark):
    """More ops than are placed at a time, against a loop."""
    import random

    rng = random.Random(3)
    for n in (1, 127, 128, 129, 600):
        ops = [(rng.randrange(0, 4), rng.choice("MIDNSHP=X")) for _ in range(n)]
        text = "".join(f"{k}{op}" for k, op in ops)
        got = frame(spark, [(text, 50, "")]).select(cigar.placed(F.col("pos"), F.col("ops")).alias("p")).first().p
        want, r, q = [], 50, 0
        for i, (k, op) in enumerate(ops):
            ins = 0
            for m, x in ops[i + 1 :]:
                if x not in "IP":
                    break
                ins += m if x == "I" else 0
            if k:
                want.append((i, op, k, r, q, ins))
            r, q = r + (k if op in "MDN=X" else 0), q + (k if op in "MIS=X" else 0)
        assert [tuple(x) for x in got] == want


def test_walk_checks_and_reference(spark):
    df = frame(spark, [("2M1I2D1M", 4, "ACGT")])
    rows = pairs.aligned_pairs(df, read=True, letters=pairs.by_position(lambda p: F.when(p < 7, reads.reference_base(p)))).orderBy("i", "qpos").collect()
    assert [(r.op, r.bases, r.quals) for r in rows] == [("M", "A", [30]), ("M", "C", [30]), ("I", "G", [30]), ("D", "", None), ("M", "T", [30])] or [r.bases or "" for r in rows] == ["A", "C", "G", "", "T"]
    assert [r.ref_bases is None for r in rows] == [False, False, True, True, True]
    with pytest.raises(Exception, match="differ in length"):
        pairs.aligned_pairs(frame(spark, [("5M", 0, "ACG")]), read=True).collect()
    with pytest.raises(Exception, match="differ in length"):
        pairs.aligned_pairs(frame(spark, [("3M", 0, "ACG")]).withColumn("qual", F.array(F.lit(1))), read=True).collect()


def test_record_edits(spark):
    df = frame(spark, [("3M", 0, "ACG")])
    assert reads.with_sequence(df, F.lit("TTT"), F.array().cast("array<int>")).first().seq == "TTT"
    with pytest.raises(Exception, match="differ"):
        reads.with_sequence(df, F.lit("TTTT"), F.col("qual")).collect()
    with pytest.raises(Exception, match="name is too long"):
        reads.checked(df.withColumn("qname", F.repeat(F.lit("x"), 255))).collect()
    moved = reads.with_mate(df, F.lit("d"), F.lit(5), F.lit(-9)).first()
    assert (moved.next_contig, moved.next_pos, moved.tlen) == ("d", 5, -9)


LINES = [
    # CIGAR, bases, flag, strand-independent expectation of (pos1, depth, bases, quals); the reference is all A
    ("3M", "AAC", 0, [(1, "^].", "?"), (2, ".", "?"), (3, "C$", "?")]),
    ("2M1I1M", "ACGA", 16, [(1, "^],", "?"), (2, "c+1g", "?"), (3, ",$", "?")]),
    ("1M2D1M", "AA", 0, [(1, "^].", "?"), (2, "*", "~"), (3, "*", "~"), (4, ".$", "?")]),
    ("1M1D1I1M", "ACA", 0, [(1, "^].", "?"), (2, "*+1", "~"), (3, ".$", "?")]),
    ("1M2N1M", "AA", 16, [(1, "^],", "?"), (2, "<", "~"), (3, "<", "~"), (4, ",$", "?")]),
    ("1M1P2I1M", "ACTA", 0, [(1, "^].+2CT", "?"), (2, ".$", "?")]),
    ("2S1M1D", "GGA", 0, [(1, "^].", "?"), (2, "*$", "~")]),
]


@pytest.mark.parametrize(("text", "bases", "flag", "want"), LINES)
def test_pileup_lines(spark, text, bases, flag, want):
    df = frame(spark, [(text, 0, bases, "q", flag)])
    rows = pileup.pileup_text(df, lambda p: F.lit("A")).orderBy("pos1").collect()
    assert [(r.pos1, r.bases, r.quals) for r in rows] == want and {r.ref_base for r in rows} == {"A"}
    trimmed = pileup.pileup_text(df, lambda p: F.lit("A"), trim=True).orderBy("pos1").collect()
    assert [r.bases for r in trimmed] == ([b for _, b, _ in want] if text != "2S1M1D" else ["^].$"])


def test_array_tags_and_mixed_ploidy(spark):
    none = F.create_map().cast(tags.KIND)
    df = spark.range(1)
    assert df.select(F.size(tags.get_array(tags.put_array(none, "XB", "C", F.array_repeat(F.lit(7), (1 << 20) + 5)), "XB"))).first()[0] == (1 << 20) + 5
    for bad in (tags.put_array(none, "XB", "c", F.array(F.lit(128))), tags.put_char(none, "XC", F.lit("é"))):
        with pytest.raises(Exception):
            df.select(bad).collect()
    one = lambda *a: F.struct(F.array(*map(F.lit, a)).alias("alleles"), F.array(F.lit(True)).alias("phased"))
    with pytest.raises(Exception, match="ploidy"):
        df.select(calls.genotypes(F.array(one(0, 1), one(0)))).collect()
    with pytest.raises(ValueError):
        calls.record_line(F.lit("c"), F.lit(1), calls.reference_allele(F.lit("A")), formats=[("GT", F.array(F.lit("0/1")))])
