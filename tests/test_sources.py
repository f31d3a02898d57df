import gzip
import random

import pytest
from pyspark.sql import functions as F

from readloom.sources import bam, bgzf, indexes, opening, sam, sequence, vcf

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:c1\tLN:60
@SQ\tSN:c2\tLN:40
r1\t99\tc1\t3\t30\t4M2I3M\t=\t20\t25\tACGTACGTR\tIIIIIIIII\tNM:i:2\tRG:Z:a b
r2\t0\tc1\t5\t20\t3M2D4M\t*\t0\t0\tACGTACG\t*
r3\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII
r4\t16\tc2\t1\t60\t2S5M\t*\t0\t0\t*\t*
"""


def test_sam_records(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM)
    assert sam.contigs(sam.header_lines(spark, str(path))) == [(0, "c1", 60), (1, "c2", 40)]
    rows = sam.read(spark, str(path)).orderBy("contig", "pos").collect()
    assert [(r.qname, r.pos, r.seq) for r in rows] == [("r1", 2, "ACGTACGTN"), ("r2", 4, "ACGTACG"), ("r4", 0, "")]
    assert rows[0].qual == [40] * 9 and rows[1].qual == [255] * 7 and rows[0].aux["RG"].value == "a b"
    assert rows[0].next_contig == "c1" and rows[1].next_contig is None
    again = sam.lines(sam.read(spark, str(path), keep_unmapped=True)).collect()
    want = [x.replace("TR\tI", "TN\tI") for x in SAM.splitlines()[3:]]
    assert sorted(r.value for r in again) == sorted(want)
    zipped = tmp_path / "y.sam.gz"
    zipped.write_bytes(bgzf.compress(SAM.encode()) + bgzf.EOF_BLOCK)
    assert sam.read(spark, str(zipped)).count() == 3
    assert bam.detect(str(zipped)) == "sam.gz"


def test_sam_header_errors():
    with pytest.raises(ValueError):
        sam.contigs(["@HD\tVN:1.6"])
    with pytest.raises(ValueError):
        sam.contigs(["@SQ\tSN:x"])
    with pytest.raises(ValueError):
        sam.check_sorted(["@HD\tVN:1.6\tSO:queryname"])
    sam.check_sorted(["@HD\tVN:1.6"])
    assert sam.add_program(["@PG\tID:a"], "a")[-1] == "@PG\tID:a.1\tPN:a\tPP:a"


def test_bgzf_round_trip(tmp_path):
    data = random.Random(1).randbytes(200_000)
    with open(tmp_path / "x", "wb") as f:
        w = bgzf.Writer(f)
        w.write(data[:70_000])
        mark = w.offset
        w.write(data[70_000:])
        w.close()
    with open(tmp_path / "x", "rb") as f:
        assert b"".join(bgzf.blocks(f)) == data
        assert bgzf.Reader(f, mark).read(200_000) == data[70_000:]
    broken = bytearray((tmp_path / "x").read_bytes())
    broken[30] ^= 1
    (tmp_path / "y").write_bytes(broken)
    with open(tmp_path / "y", "rb") as f, pytest.raises(Exception):
        list(bgzf.blocks(f))


def test_bam_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        n = rng.randrange(20, 60)
        rows.append(
            (f"q{i}", rng.choice([0, 16]), 0, rng.choice(["c1", "c2"]), rng.randrange(0, 90_000), i % 61, [(10, "M"), (i % 900 + 1, "D"), (n - 10, "M")],
             "".join(rng.choice("ACGTN") for _ in range(n)), [rng.randrange(42) for _ in range(n)], -1, -1, 0,
             {"NM": ("i", str(i - 50)), "XB": ("B", "s,-1,2"), "XZ": ("Z", "x y")})
        )
    spark.dataSource.register(bam.BamSource)
    df = spark.createDataFrame(rows, bam.SCHEMA)
    out = str(tmp_path / "bam")
    df.repartitionByRange(2, "contig", "pos").sortWithinPartitions("contig", "pos").write.format("bam").option("contigs", "c1:100000,c2:100000").mode("append").save(out)
    back = spark.read.format("bam").load(out)
    key = lambda r: (r.qname, r.contig, r.pos, r.seq, tuple(r.qual), tuple(map(tuple, r.ops)), r.aux["NM"].value, r.aux["XB"].value, r.aux["XZ"].value)
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    for low, high in ((1, 100), (16384, 16385), (50_000, 51_000), (90_000, 100_000)):
        got = spark.read.format("bam").option("region", f"c2:{low}-{high}").load(out)
        want = [r for r in df.collect() if r.contig == "c2" and r.pos <= high - 1 and r.pos + sum(o.len for o in r.ops) - 1 >= low - 1]
        assert sorted(r.qname for r in got.collect()) == sorted(r.qname for r in want)


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">c1 first > one\nACGTN\nacgta\nCC\n>c2\nGGGG\nT\n")
    tiles = sequence.read_fasta(spark, str(path), tile=4)
    whole = {}
    for r in tiles.orderBy("contig", "start").collect():
        whole[r.contig] = whole.get(r.contig, "") + r.seq
    assert whole == {"c1": "ACGTNACGTACC", "c2": "GGGGT"}
    assert sequence.fetch(tiles, "c1", 3, 9).collect()[0].seq == "TNACGT"
    assert sequence.positions(tiles).where("contig = 'c2'").count() == 5
    index = {r.name: tuple(r)[1:] for r in sequence.index_fasta(spark, str(path)).collect()}
    assert index == {"c1": (12, 16, 5, 6), "c2": (5, 35, 4, 5)}


def test_fastq(spark, tmp_path):
    a, b = tmp_path / "a.fq", tmp_path / "b.fq"
    a.write_text("@x:1:2:3:4:5:6:ACG/1 1:N:0:TTT\nACGT\n+\nIIII\n@y/1 1:Y:0:\nAC\n+\n@I\n")
    b.write_text("@x:1:2:3:4:5:6:ACG/2 2:N:0:TTT\nGG\n+\nII\n@y/2\nA\n+\nI\n")
    first = sequence.read_fastq(spark, str(a))
    rows = sequence.unmapped_records(first).orderBy("qname").collect()
    assert [(r.qname, r.flag, r.barcode, r.molecule) for r in rows] == [("x:1:2:3:4:5:6:ACG", 77, "TTT", "ACG"), ("y", 589, None, None)]
    assert rows[1].qual == [31, 40]
    assert sequence.unmapped_records(first, skip_filtered=True).count() == 1
    both = sequence.paired(first, sequence.read_fastq(spark, str(b))).orderBy("nth").collect()
    assert [(r.seq1, r.seq2) for r in both] == [("ACGT", "GG"), ("AC", "A")]


def test_vcf_sink(spark, tmp_path):
    header = vcf.Header().contig("c2", 10).contig("c1").info("DP", "1", "Integer", 'say "depth"').format("GT", "1", "String", "genotype").sample("s")
    rows = [("c1", 5, "c1\t5\t.\tA\tC\t.\tPASS\tDP=3\tGT\t0/1"), ("c2", 9, "c2\t9\t.\tA\tC\t.\tPASS\tDP=4;X\tGT\t1/1"), ("c2", 2, "c2\t2\t.\tA\t.\t1.5\t.\t.\tGT\t./.")]
    vcf.write(spark.createDataFrame(rows, "contig string, pos1 long, line string"), header, str(tmp_path / "v"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*")))
    lines = text.splitlines()
    assert lines[: len(header.lines())] == header.lines()
    assert [x.split("\t")[:2] for x in lines[len(header.lines()) :]] == [["c2", "2"], ["c2", "9"], ["c1", "5"]]
    back = {(r.contig, r.pos1): r for r in vcf.read(spark, str(tmp_path / "v")).collect()}
    assert back["c2", 9].info == {"DP": "4", "X": ""} and back["c2", 2].alts == [] and back["c2", 2].qual == 1.5
    with pytest.raises(ValueError):
        vcf.Header().contig("a").contig("a")


def test_detect_errors(tmp_path):
    for data in (b"@HD\tVN:1", gzip.compress(b"abc"), b"xy"):
        (tmp_path / "f").write_bytes(data)
        with pytest.raises(bgzf.FormatError):
            bam.detect(str(tmp_path / "f"))
    (tmp_path / "f").write_bytes(b"CRAM\3\0")
    assert bam.detect(str(tmp_path / "f")) == "cram"


def test_region_of_compressed_text(spark, tmp_path):
    rng = random.Random(5)
    body = sorted((rng.randrange(1, 90_000), f"q{i}") for i in range(4000))
    rows = "".join(f"{n}\t0\tc1\t{p}\t9\t30M2D8M\t*\t0\t0\t{'ACGT' * 9}AC\t*\n" for p, n in body)
    top = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c1\tLN:100000\n@SQ\tSN:c2\tLN:50\n"
    (tmp_path / "x.sam").write_text(top + rows)
    full = sam.read(spark, str(tmp_path / "x.sam"))
    out = str(tmp_path / "out")
    sam.write_indexed(full, [("c1", 100_000), ("c2", 50)], out)
    for low, high in ((1, 10), (30_000, 30_000), (16_380, 60_000), (89_000, 100_000)):
        got = sam.read_region(spark, out, f"c1:{low}-{high}")
        assert sorted(r.qname for r in got.collect()) == sorted(n for p, n in body if p <= high and p + 39 >= low)
    assert sam.read_region(spark, out, "c2").count() == 0
    with pytest.raises(ValueError):
        sam.read_region(spark, out, "zz")
    assert sam.checked_header(spark, str(tmp_path / "x.sam"))[1].startswith("@SQ")


def test_a_long_header(spark, tmp_path):
    top = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:c{i}\tLN:{i + 1}\n" for i in range(700))
    (tmp_path / "x.sam").write_text(top + "r\t0\tc1\t1\t9\t1M\t*\t0\t0\tA\tI\n@looks\tlike a header\n")
    assert len(sam.contigs(sam.header_lines(spark, str(tmp_path / "x.sam")))) == 700


def alignments(spark, n=3000):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        c = rng.choice(["c1", "c2"])
        rows.append((f"q{i}", rng.choice([0, 16]), int(c[1]) - 1, c, rng.randrange(0, 90_000), i % 61, [(20, "M"), (i % 900 + 1, "N")], "A" * 20, [30] * 20, -1, -1, 0, {}))
    return spark.createDataFrame(rows, bam.SCHEMA)


def write_bam(df, out, **options):
    df.repartitionByRange(2, "contig", "pos").sortWithinPartitions("contig", "pos").write.format("bam").options(contigs="c1:100000,c2:100000", **options).mode("append").save(out)


@pytest.mark.parametrize(("index", "split"), [("bai", 1 << 10), ("csi", 1 << 10), ("csi", 64 << 20), ("none", 64 << 20)])
def test_bam_by_each_index(spark, tmp_path, monkeypatch, index, split):
    spark.dataSource.register(bam.BamSource)
    df = alignments(spark).cache()
    out = str(tmp_path / "bam")
    write_bam(df, out, index=index, level="1")
    reader = bam.BamReader({"path": out})
    monkeypatch.setattr(bam, "SPLIT", split)
    parts = reader.partitions()
    assert len(parts) > 4 if split < 1 << 20 and index != "none" else len(parts) <= 4
    names = [reader_row[0] for p in parts for reader_row in reader.read(p)]
    assert sorted(names) == sorted(r.qname for r in df.collect())
    got = spark.read.format("bam").option("region", "c2:16384-20000").load(out)
    want = [r.qname for r in df.collect() if r.contig == "c2" and r.pos <= 19_999 and r.pos + sum(o.len for o in r.ops) - 1 >= 16_383]
    assert sorted(r.qname for r in got.collect()) == sorted(want)
    df.unpersist()


def test_pushed_filters(spark, tmp_path):
    out = str(tmp_path / "bam")
    spark.dataSource.register(bam.BamSource)
    df = alignments(spark).cache()
    write_bam(df, out)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for where in ("mapq >= 30", "contig = 'c2' and pos > 5000 and pos <= 9000", "contig in ('c1') and flag = 16 and qname like '%7'", "pos = 77 or mapq = 3", "pos < 100 and pos > 50000"):
            got = bam.load(spark, out).where(where)
            assert sorted(r.qname for r in got.collect()) == sorted(r.qname for r in df.where(where).collect())
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = bam.PushingReader({"path": out})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    left = list(reader.pushFilters([EqualTo(("contig",), "c1"), GreaterThan(("pos",), 80_000), StringContains(("qname",), "1")]))
    assert len(left) == 1 and all(p.tid == 0 for p in reader.partitions())
    assert all(r[3] == "c1" and r[4] > 80_000 for p in reader.partitions() for r in reader.read(p))
    df.unpersist()


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    out = str(tmp_path / "bam")
    with pytest.raises(Exception):
        alignments(spark, 50).repartition(1).orderBy("qname").write.format("bam").options(contigs="c1:100000,c2:100000").mode("append").save(out)
    with pytest.raises(bgzf.FormatError):
        bam.files_of(out, ".bam")


def test_reserved_ops_of_binary_records():
    row = {"qname": "q", "flag": 0, "contig": "c", "pos": 3, "mapq": 1, "ops": [{"len": 4, "op": "M"}, {"len": 2, "op": "11"}], "seq": "ACGT", "qual": [], "next_tid": -1, "next_pos": -1, "tlen": 0, "aux": {}}
    assert bam.decode(bam.encode(row, {"c": 0}), [("c", 9)])[6] == [(4, "M"), (2, "11")]


def test_sequences_split_anywhere(spark, tmp_path):
    """Contigs over many splits of a file, of one line and of many, with and without carriage returns."""
    rng = random.Random(9)
    want, text = {}, ""
    for i, n in enumerate([1, 60, 61, 5000, 0, 23_456, 7]):
        seq = "".join(rng.choice("ACGTNacgt") for _ in range(n))
        want[f"c{i}"] = seq.upper()
        text += f">c{i} some text\n" + "".join(seq[k : k + 60] + "\n" for k in range(0, n, 60))
    path = tmp_path / "x.fa"
    path.write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {}
        for r in sequence.read_fasta(spark, str(path), 777).orderBy("contig", "start").collect():
            assert len(got.get(r.contig, "")) == r.start
            got[r.contig] = got.get(r.contig, "") + r.seq
        assert got == {k: v for k, v in want.items() if v}
        data = path.read_bytes()
        for r in sequence.index_fasta(spark, str(path)).collect():
            size = -(-r.length // r.linebases) * (r.linewidth - r.linebases) + r.length
            assert data[r.offset : r.offset + size].replace(b"\n", b"").decode().upper() == want[r.name]
        fastq = "".join(f"@r{i}\n{'ACGT' * (i % 30)}\n+\n{'I' * (i % 30 * 4)}\n" for i in range(1, 900))
        (tmp_path / "x.fq").write_text(fastq)
        rows = sequence.read_fastq(spark, str(tmp_path / "x.fq")).orderBy("nth").collect()
        assert [(r.nth, r.name, len(r.seq)) for r in rows] == [(i - 1, f"r{i}", i % 30 * 4) for i in range(1, 900)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    path.write_text(">a\nACG\nAC\nACG\n")
    with pytest.raises(Exception, match="unequal"):
        sequence.index_fasta(spark, str(path)).collect()


def test_other_fastq_shapes(spark, tmp_path):
    (tmp_path / "m.fq").write_text("@a one XY:Z:t\nACG\nTA\n+a\nII\n@II\n\n@b/1\nC\n+\n+\n")
    rows = sequence.read_multiline_fastq(spark, str(tmp_path / "m.fq")).orderBy("nth").collect()
    assert [(r.name, r.seq, len(r.qual)) for r in rows] == [("a", "ACGTA", 5), ("b/1", "C", 1)]
    (tmp_path / "cut.fq").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="whole"):
        sequence.read_multiline_fastq(spark, str(tmp_path / "cut.fq")).collect()
    (tmp_path / "i.fq").write_text("@a/1\nAC\n+\nII\n@a/2\nG\n+\nI\n@b\nA\n+\nI\n@b\nT\n+\nI\n")
    both = sequence.interleaved(sequence.read_fastq(spark, str(tmp_path / "i.fq"))).orderBy("nth").collect()
    assert [(r.name, r.seq1, r.seq2) for r in both] == [("a", "AC", "G"), ("b", "A", "T")]
    (tmp_path / "odd.fq").write_text("@a/1\nAC\n+\nII\n")
    with pytest.raises(Exception, match="no mate"):
        sequence.interleaved(sequence.read_fastq(spark, str(tmp_path / "odd.fq"))).collect()
    tagged = sequence.unmapped_records(sequence.read_multiline_fastq(spark, str(tmp_path / "m.fq"))).where("qname = 'a'").first()
    assert tagged.aux["XY"].value == "t"
    assert [sequence.compression(x) for x in (bgzf.compress(b"a"), gzip.compress(b"a"), b"@a")] == ["bgzf", "gzip", "plain"]


def test_variant_formats_by_path(spark, tmp_path):
    header = vcf.Header.of_alignments(["@SQ\tSN:c1\tLN:9"]).info("DP", "1", "Integer", "d")
    rows = spark.createDataFrame([("c1", 5, "c1\t5\t.\tA\tC\t.\tPASS\tDP=3")], "contig string, pos1 long, line string")
    for name, kind in (("x.vcf", "vcf"), ("x.vcf.gz", "vcf.gz"), ("x.bcf", "bcf")):
        assert vcf.format_of(name) == kind
        vcf.write_as(rows, header, str(tmp_path / name))
        assert (tmp_path / name / "_SUCCESS").exists()
    with pytest.raises(ValueError):
        vcf.format_of("x.txt")
    bad = rows.withColumn("contig", F.lit("zz"))
    with pytest.raises(Exception, match="no contig"):
        vcf.write_as(bad, header, str(tmp_path / "bad.bcf"))
    assert not (tmp_path / "bad.bcf").exists()


def test_opening_by_content(spark, tmp_path):
    """Each format behind one interface, with its reference's contigs checked."""
    df = alignments(spark, 400)
    b, t = str(tmp_path / "b"), str(tmp_path / "t")
    spark.dataSource.register(bam.BamSource)
    write_bam(df, b)
    sam.write_indexed(df.withColumn("next_contig", F.lit(None).cast("string")), [("c1", 100_000), ("c2", 100_000)], t)
    fa = tmp_path / "r.fa"
    fa.write_text(">c1\n" + "ACGTT" * 20_000 + "\n>c2\n" + "GGCCA" * 20_000 + "\n")
    made = [opening.open_alignments(spark, x, str(fa)) for x in (b, t)]
    assert [m.kind for m in made] == ["bam", "sam.gz"] and made[0].contigs == made[1].contigs == (("c1", 100_000), ("c2", 100_000))
    for region in (None, "c2:5000-9000"):
        one, two = (sorted((r.qname, r.contig, r.pos, r.seq) for r in m.read(region).collect()) for m in made)
        assert one == two and one
        depths = [sorted((r.pos, r.ref_base, r["count"]) for r in m.pileup("c2:5000-5400").groupBy("pos", "ref_base").count().collect()) for m in made]
        assert depths[0] == depths[1] and all("GGCCA"[p % 5] == base for p, base, _ in depths[0])
    assert made[0].bases("c1", 3, 9) == "TTACGT" and made[0].segments("c1:1-5000", 2000).count() == 3
    with pytest.raises(ValueError):
        made[0].bases("c1", 99_999, 100_001)
    with pytest.raises(ValueError):
        made[0].pileup("zz")
    fa.write_text(">c1\nACGT\n>c2\nA\n")
    with pytest.raises(ValueError, match="lengths"):
        made[0].reference()
    with pytest.raises(bgzf.FormatError):
        opening.open_alignments(spark, str(tmp_path))


def test_compressed_reference(tmp_path):
    from readloom.sources import cram

    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(200_000))
    text = ">c\n" + "".join(seq[k : k + 70] + "\n" for k in range(0, len(seq), 70))
    data, entries, at = text.encode(), [(0, 0)], 0
    with open(tmp_path / "x.fa.gz", "wb") as f:
        for k in range(0, len(data), bgzf.PAYLOAD):
            f.write(block := bgzf.compress(data[k : k + bgzf.PAYLOAD]))
            at += len(block)
            entries.append((at, min(k + bgzf.PAYLOAD, len(data))))
        f.write(bgzf.EOF_BLOCK)
    (tmp_path / "x.fa.gz.gzi").write_bytes(indexes.BlockIndex(tuple(entries)).encoded())
    (tmp_path / "x.fa.gz.fai").write_text(f"c\t{len(seq)}\t3\t70\t71\n")
    fetch = cram.Fasta(str(tmp_path / "x.fa.gz"), ["c"])
    for a, z in ((0, 5), (65_000, 66_000), (199_990, 200_000), (10, 12)):
        assert fetch(0, a, z) == seq[a:z]
