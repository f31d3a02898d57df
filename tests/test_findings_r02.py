"""Cases of the findings of round 2."""

import re

import pytest
from pyspark.sql import functions as F

from readloom.oracle import SQL
from readloom.queries import QUERIES


def _against_sql(spark, tmp_path, name, tables):
    """Rows of a query and of its SQL over tables made by DuckDB statements."""
    import duckdb

    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(SQL[name])
    key = lambda r: tuple((x is None, x) for x in r)
    columns = [c[0] for c in want.description]
    return sorted(map(tuple, got.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)


def test_array_tags_of_large_keys(spark, tmp_path):
    """doubles of keys from 16384 on exceed the element kind that the SQL writes."""
    part = "SELECT k::BIGINT AS p_partkey, 'Brand#' || k AS p_brand FROM (VALUES (1), (16383), (16384), (19999), (1199940)) t(k)"
    ours, theirs = _against_sql(spark, tmp_path, "array_tags", {"part": part})
    assert ours == theirs and len(ours) == 5


def test_calls_stay_within_their_rows(spark):
    """calls of rows that share a read_id aren't mixed up, and insertions and clips have no reference place."""
    from readloom.operators import mods

    rows = [(1, "c", 10, "ACGC", 0, "C+m.,0,0;", [7, 8], [(1, "M"), (1, "I"), (2, "M")]), (1, "c", 50, "GGAA", 16, "C+m,1;", [9], [(1, "S"), (3, "M")]), (1, "c", 90, "CC", 0, None, None, [(2, "M")])]
    df = spark.createDataFrame(rows, "read_id long, contig string, pos long, seq string, flag int, mm string, ml array<int>, ops array<struct<len:int,op:string>>")
    got = sorted(((r.pos, r.qpos, r.prob, r.rpos) for r in mods.placed_calls(df, carry=("pos",)).collect()), key=lambda x: x[:2])
    assert got == [(10, 1, 7, None), (10, 3, 8, 12), (50, 0, 9, None)]
    each = {r.pos: ([c.qpos for c in r.calls], r.dotted) for r in mods.with_calls(df, carry=("pos",)).collect()}
    assert each == {10: ([1, 3], "C"), 50: ([0], ""), 90: ([], "")}


@pytest.mark.parametrize("name", ["unmodified_calls", "modified_columns"])
def test_modifications_shuffle_only_counts(spark, name):
    """one exchange, that of the counts; before, calls were joined with reads or with pileup rows."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["pileup_text", "pileup_text_trimmed"])
def test_lines_shuffle_reads(spark, name):
    """F6, F8: one exchange, whose rows are reads; before, every base of a read was a row of it."""
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1 and below.count("Generate") == 1 and not re.search(r"\b(seq|qual)#", below)


def test_lines_of_reads_across_tiles(spark):
    """F6, F8: reads longer than a tile are cut to it, with their insertions, skips, marks of both ends and qualities."""
    from readloom.functions import cigar
    from readloom.operators import pileup

    letters = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(3000))
    shapes = ["500M2I700M", "3S509M4I2D900M1S", "300M1400N1I20M", "2D510M3D5I600M2D", "1200M", "20M", "*"]
    rows = []
    for i in range(60):
        text = shapes[i % len(shapes)]
        n = sum(int(k) for k, o in re.findall(r"(\d+)(\D)", text) if o in "MIS")
        seq = "" if i % 11 == 5 else letters[i : i + n]
        qual = [] if i % 13 == 6 else [255 if q % 50 == 7 else (q + i) % 120 for q in range(n)]
        rows.append((i, "cd"[i % 2], (i * 37) % 700, 16 * (i % 3 == 0), 7 * i, text, seq, qual))
    df = spark.createDataFrame(rows, "read_id long, contig string, pos long, flag int, mapq int, cigar string, seq string, qual array<int>").withColumn("ops", cigar.parse(F.col("cigar"))).drop("cigar")

    def plain(low, high):
        """Base by base, in Python."""
        columns = {}
        for rid, contig, pos, flag, mapq, text, seq, qual in sorted(rows, key=lambda r: (r[2], r[0])):
            ops, r, q, case = [(int(k), o) for k, o in re.findall(r"(\d+)(\D)", text)], pos, 0, str.lower if flag else str.upper
            last = pos + sum(k for k, o in ops if o in "MDN") - 1
            for i, (k, o) in enumerate(ops):
                put = ops[i + 1][0] if i + 1 < len(ops) and ops[i + 1][1] == "I" else 0
                for j in range(k if o in "MDN" else 0):
                    end = put and j == k - 1
                    base = (seq[q + j] if seq else "N") if o == "M" else "*" if o == "D" or end else "<" if flag else ">"
                    shown = ("," if flag else ".") if base == "ACGT"[(r + j) % 4] else case(base)
                    added = f"+{put}" + (case(seq[q + k : q + k + put]) if o == "M" else "") if end else ""
                    value = qual[q + j] if o == "M" and qual else 255
                    begun = "^" + chr(33 + min(mapq, 93)) if r + j == pos else ""
                    if low <= r + j <= high:
                        c = columns.setdefault((contig, r + j + 1), ["ACGT"[(r + j) % 4], 0, "", ""])
                        c[1:] = c[1] + 1, c[2] + begun + shown + added + "$" * (r + j == last), c[3] + chr(33 + min(value, 93))
                r, q = r + k * (o in "MDN"), q + k * (o in "MIS")
        return sorted((*at, *c) for at, c in columns.items())

    base = lambda p: F.substring(F.lit("ACGT"), (p % 4 + 1).cast("int"), F.lit(1))
    assert sorted(map(tuple, pileup.pileup_text(df, base).collect())) == plain(0, 9999)
    assert sorted(map(tuple, pileup.pileup_text(df, base, 505, 1030).collect())) == plain(505, 1030)
