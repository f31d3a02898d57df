import random
import struct

import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar
from readloom.operators import intervals
from readloom.plans import layout
from readloom.sources import bcf, bgzf, indexes, vcf
from readloom.streaming import coverage

RNG = random.Random(9)


def lines(n):
    out = []
    for i in range(n):
        c, p = RNG.choice(["c1", "c2"]), RNG.randrange(1, 200_000)
        out.append((c, p, f"{c}\t{p}\tid{i}\tAC\tA\t{i / 4}\tPASS\tDP={i};AF=0.5,.\tGT:AD\t0/1:1,2\t.|2:3"))
    return out


HEADER = (
    vcf.Header().contig("c1", 300_000).contig("c2", 300_000).info("DP", "1", "Integer", "d").info("AF", "A", "Float", "f")
    .format("GT", "1", "String", "g").format("AD", "R", "Integer", "a").sample("x").sample("y")
)


def test_block_compressed_text_and_its_index(spark, tmp_path):
    rows = lines(3000)
    bcf.write(spark.createDataFrame(rows, "contig string, pos1 long, line string"), HEADER, str(tmp_path / "v"), binary=False)
    back = spark.read.text(str(tmp_path / "v" / "*.vcf.gz")).where("value not like '#%'")
    assert sorted(r.value for r in back.collect()) == sorted(x for _, _, x in rows)
    seen = []
    for path in sorted((tmp_path / "v").glob("*.vcf.gz")):
        index = indexes.BinIndex.parse_tabix(path.with_name(path.name + ".tbi").read_bytes())
        if "c2" not in index.names:
            continue
        with open(path, "rb") as f:
            for a, z in index.query(index.names.index("c2"), 50_000, 60_000):
                r = bgzf.Reader(f, a)
                data = b""
                while r.offset < z:
                    data += r.read(1)
                seen += [x.split("\t") for x in data.decode().splitlines()]
    want = sorted(p for c, p, _ in rows if c == "c2" and p - 1 < 60_000 and p + 1 > 50_000)
    assert sorted(int(x[1]) for x in seen if x[0] == "c2" and int(x[1]) - 1 < 60_000 and int(x[1]) + 1 > 50_000) == want


def test_binary_records(spark, tmp_path):
    rows = lines(50)
    bcf.write(spark.createDataFrame(rows, "contig string, pos1 long, line string"), HEADER, str(tmp_path / "b"))
    found = []
    for path in sorted((tmp_path / "b").glob("*.bcf")):
        with open(path, "rb") as f:
            data = b"".join(bgzf.blocks(f))
        assert data[:5] == b"BCF\2\2"
        at = 9 + struct.unpack_from("<I", data, 5)[0]
        while at < len(data):
            shared, own = struct.unpack_from("<II", data, at)
            tid, pos, rlen, qual, counts, more = struct.unpack_from("<iiifII", data, at + 8)
            assert (rlen, counts >> 16, counts & 0xFFFF, more >> 24, more & 0xFFFFFF) == (2, 2, 2, 2, 2)
            found.append((tid, pos + 1, qual))
            at += 8 + shared + own
        index = indexes.BinIndex.parse_csi(path.with_name(path.name + ".csi").read_bytes())
        assert (index.min_shift, index.depth) == (14, 5)
    assert sorted(found) == sorted((int(c == "c2"), p, float(x.split("\t")[5])) for c, p, x in rows)


def test_typed_values():
    assert bcf.ints([1, -120]) == b"\x21\x01\x88" and bcf.ints([-121]) == b"\x12" + struct.pack("<h", -121)
    assert bcf.ints([None, 300]) == b"\x22" + struct.pack("<hh", -(2**15), 300)
    assert bcf.text("x" * 20)[:3] == b"\xf7\x11\x14" and bcf.genotypes(["0/1", ".|2"]) == b"\x21\x02\x04\x00\x07"
    with pytest.raises(ValueError):
        bcf.genotypes(["0", "0/1"])


def test_csi_query_finds_every_record():
    index = indexes.BinIndex()
    spans = sorted((a := RNG.randrange(3_000_000), a + RNG.choice([1, 50, 40_000])) for _ in range(500))
    for i, (a, z) in enumerate(spans):
        index.add(0, a, z, i << 16, i + 1 << 16)
    again = indexes.BinIndex.parse_csi(index.encoded_csi(b"x"))
    for a, z in [(0, 10), (1_000_000, 1_000_001), (16_384, 900_000)]:
        for made in (index, again, indexes.BinIndex.parse_bai(index.encoded_bai(1))):
            chunks = made.query(0, a, z)
            for i, (s, e) in enumerate(spans):
                if s < z and e > a:
                    assert any(x <= i << 16 < y for x, y in chunks)


def test_small_indexes(tmp_path):
    entries = indexes.parse_crai(b"0\t1\t100\t5\t6\t7\n1\t50\t10\t8\t9\t9\n-2\t0\t0\t1\t1\t1\n")
    assert [e.container for e in indexes.query_crai(entries, 0, 99, 200)] == [5, 1]
    assert [e.container for e in indexes.query_crai(entries, 1, 0, 48)] == [1]
    block = indexes.BlockIndex.parse(struct.pack("<QQQQQ", 2, 100, 1000, 220, 2000))
    assert block.translate(999) == (0, 999) and block.translate(1000) == (100, 0) and block.translate(5000) == (220, 3000)
    with pytest.raises(bgzf.FormatError):
        indexes.BlockIndex.parse(struct.pack("<Q", 3))
    assert indexes.batches([(0, 5 << 16), (5 << 16, 9 << 16), (9 << 16, 30 << 16)], most=9) == [[(0, 5 << 16), (5 << 16, 9 << 16)], [(9 << 16, 30 << 16)]]
    (tmp_path / "a.bai").touch()
    assert indexes.find_bam_index(str(tmp_path / "a.bam")) == str(tmp_path / "a.bai")
    (tmp_path / "s.sam.gz.csi").touch()
    with pytest.raises(bgzf.FormatError):
        indexes.find_sam_index(str(tmp_path / "s.sam.gz"))


def made(spark, n=400):
    rows = [(i, RNG.choice(["c1", "c2"]), RNG.randrange(3_000_000), f"{RNG.randrange(5, 90)}M{RNG.randrange(1, 40_000)}N9M") for i in range(n)]
    return spark.createDataFrame(rows, "read_id long, contig string, pos long, t string").withColumn("ops", cigar.parse(F.col("t"))).drop("t")


def test_clustered_layout(spark, tmp_path):
    df = made(spark).cache()
    layout.write_clustered(df, str(tmp_path / "x"))
    for a, z in ((0, 100_000), (1_048_576, 1_048_576), (2_000_000, 2_900_000)):
        want = df.where((F.col("contig") == "c1") & (F.col("pos") <= z) & (cigar.end_position(F.col("pos"), F.col("ops")) >= a))
        got = layout.fetch_clustered(spark, str(tmp_path / "x"), "c1", a, z)
        assert sorted(r.read_id for r in got.collect()) == sorted(r.read_id for r in want.collect())
    assert intervals.reg2bins(0, 1 << 29)[0] == 0


def test_streamed_coverage_equals_batch(spark, tmp_path):
    df = made(spark, 200).cache()
    for i in range(3):
        df.where(F.col("read_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = coverage.binned_coverage(stream).writeStream.outputMode("complete").format("memory").queryName("cover").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("cover").collect())) == sorted(map(tuple, coverage.binned_coverage(df).collect()))
