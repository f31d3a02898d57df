"""Sequence files: FASTA with its index, and FASTQ."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions import scalars, tags

FAI = "name string, length long, offset long, linebases long, linewidth long"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines of files, where (block, at) is their order in a file.

    A split of a file is a block; lines keep a carriage return.  Rows of a block
    come in order, so nothing is sorted or gathered for this.
    """
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _carried(blocks: DataFrame, **sums: str) -> DataFrame:
    """blocks(file, block, ...) with the sums of columns over a file's earlier blocks; one row a block."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for name, c in sums.items()))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(contig, number, byte, size, start, value): the sequence lines of FASTA files, with the bases before them in their contig.

    number is the line's number within its contig, byte its offset in the file and
    size its bytes with the newline.  Lines are summed up within each split of a
    file; what is carried from split to split is a row each.
    """
    bases = F.when(F.col("value").startswith(">"), 0).otherwise(F.length(F.regexp_replace("value", r"\s", "")))
    lines = numbered_lines(spark, path).withColumns({"head": F.col("value").startswith(">"), "bases": bases.cast("long"), "size": (F.octet_length("value") + 1).cast("long")})
    name = F.when(F.col("head"), F.regexp_extract("value", r"^>(\S*)", 1))
    block = Window.partitionBy("file", "block")
    within = block.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"group": F.sum(F.col("head").cast("int")).over(within), "byte": F.sum("size").over(within) - F.col("size")})
    part = Window.partitionBy("file", "block", "group").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    plain = (~F.col("head")).cast("long")
    lines = lines.withColumns({"start": F.sum("bases").over(part) - F.col("bases"), "number": F.sum(plain).over(part) - plain})
    tail = lines.groupBy("file", "block", "group").agg(F.sum("bases").alias("bases"), F.sum(plain).alias("n"), F.max(name).alias("name"), F.sum("size").alias("size"))
    blocks = tail.groupBy("file", "block").agg(
        F.sum("size").alias("size"), F.max(F.struct("group", "bases", "n", "name")).alias("last"), (F.max("group") > 0).cast("int").alias("headed")
    )
    along = Window.partitionBy("file").orderBy("block")
    blocks = _carried(blocks, bytes_before="size").withColumn("run", F.sum("headed").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns({"open_bases": F.sum("last.bases").over(run), "open_lines": F.sum("last.n").over(run), "open_name": F.first("last.name").over(run)})
    carried = blocks.select(
        "file", "block", "bytes_before", *(F.lag(c).over(along).alias(c) for c in ("open_bases", "open_lines", "open_name"))
    )
    heads = tail.select("file", "block", "group", "name")
    known = lines.join(heads, ["file", "block", "group"]).join(carried, ["file", "block"])
    first = F.col("group") == 0
    carry = lambda c: F.when(first, F.coalesce(c, F.lit(0))).otherwise(0)
    return known.select(
        F.when(first, F.col("open_name")).otherwise(F.col("name")).alias("contig"),
        "head",
        (F.col("number") + carry("open_lines")).alias("number"),
        (F.col("byte") + F.col("bytes_before")).alias("byte"),
        "size",
        (F.col("start") + carry("open_bases")).alias("start"),
        "bases",
        "value",
    ).where("contig is not null")


def read_fasta(spark: SparkSession, path: str, tile: int = 100_000) -> DataFrame:
    """(contig, start, seq) tiles of upper-case bases.

    Files are split anywhere; lines are put in their place by sums over the lines
    before them, so no contig is one value or one task's.
    """
    lines = _records(spark, path).where("bases > 0").withColumn("seq", F.upper(F.regexp_replace("value", r"\s", "")))
    last = F.col("start") + F.col("bases") - 1
    each = lines.select("contig", "start", "bases", "seq", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor(last / tile))).alias("tile"))
    low = F.greatest(F.col("tile") * tile, F.col("start"))
    high = F.least((F.col("tile") + 1) * tile, F.col("start") + F.col("bases"))
    pieces = each.select("contig", "tile", low.alias("at"), F.substring("seq", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda p: p["s"]), "")
    return pieces.groupBy("contig", "tile").agg(joined.alias("seq")).select("contig", (F.col("tile") * tile).alias("start"), "seq")


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """sequences(name, seq) as part files of lines of that width."""
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(width)), lambda at: F.substring(F.col("seq"), at + 1, F.lit(width)))
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.array_join(lines, "\n")).alias("value")).write.text(path)


def fetch(tiles: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    """(contig, start, seq): one row with the bases of the half-open range, fewer at the contig's end."""
    here = tiles.where((F.col("contig") == contig) & (F.col("start") < stop) & (F.col("start") + F.length("seq") > start))
    low = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
    high = F.least(F.lit(stop) - F.col("start"), F.length("seq")).cast("int")
    pieces = here.select("contig", F.struct("start", F.substring("seq", low + 1, high - low).alias("s")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "")
    return pieces.groupBy("contig").agg(joined.alias("seq")).select("contig", F.lit(start).cast("long").alias("start"), "seq")


def fetch_many(tiles: DataFrame, ranges: DataFrame, tile: int) -> DataFrame:
    """ranges(contig, a, z, ...) with the bases of each half-open range, from tiles of that length; empty ranges have none.

    Ranges meet the tiles they touch by an equi-join on (contig, start).
    """
    key = F.xxhash64(*ranges.columns)
    touched = F.when(F.col("z") > F.col("a"), F.sequence(F.floor(F.col("a") / tile), F.floor((F.col("z") - 1) / tile))).otherwise(F.array().cast("array<long>"))
    wanted = ranges.withColumn("key", key).withColumn("start", F.explode_outer(F.transform(touched, lambda t: t * tile)))
    met = wanted.join(tiles, ["contig", "start"], "left")
    low, high = F.greatest(F.col("a") - F.col("start"), F.lit(0)).cast("int"), F.least(F.col("z") - F.col("start"), F.length("seq")).cast("int")
    piece = F.struct("start", F.coalesce(F.substring("seq", low + 1, high - low), F.lit("")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["s"]), "")
    return met.groupBy("key", *ranges.columns).agg(joined.alias("seq")).drop("key")


def positions(tiles: DataFrame) -> DataFrame:
    """(contig, pos, base): a row for each base, letters but A, C, G, T as N."""
    each = tiles.select("contig", "start", F.posexplode(F.split("seq", "")).alias("i", "b"))
    return each.select("contig", (F.col("start") + F.col("i")).alias("pos"), scalars.bases(F.col("b")).alias("base"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """The index table; impossible line lengths raise an error, repeated names too."""
    fai = spark.read.csv(path, sep="\t", schema=FAI)
    ok = (F.col("linebases") > 0) & (F.col("linewidth") >= F.col("linebases")) & (F.col("length") > 0)
    checked = fai.withColumn("length", F.when(ok, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("bad index line "), "name")).cast("long")))
    n = F.count(F.lit(1))
    once = F.when(n == 1, F.first("length")).otherwise(F.raise_error(F.lit("repeated name")).cast("long"))
    return checked.groupBy("name").agg(once.alias("length"), *(F.first(c).alias(c) for c in ("offset", "linebases", "linewidth")))


def index_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, offset, linebases, linewidth): the index of one FASTA file.

    All lines of a sequence but the last have equal lengths, which is checked.  The
    file may be split anywhere.
    """
    lines = _records(spark, path).where("not head")
    by = lines.groupBy(F.col("contig").alias("name")).agg(
        F.sum("bases").alias("length"),
        F.min_by("byte", "number").alias("offset"),
        F.min_by("bases", "number").alias("linebases"),
        F.min_by("size", "number").alias("linewidth"),
        F.max("number").alias("last"),
    )
    uneven = (F.col("number") < F.col("last")) & ((F.col("bases") != F.col("linebases")) | (F.col("size") != F.col("linewidth")))
    bad = lines.select(F.col("contig").alias("name"), "number", "bases", "size").join(by, "name").groupBy("name").agg(F.max(uneven).alias("uneven"))
    length = F.when(~F.col("uneven"), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("lines of unequal length: "), "name")).cast("long"))
    return by.join(bad, "name").where("length > 0").select("name", length.alias("length"), "offset", "linebases", "linewidth")


def _record_columns(head: Column, seq: Column, plus: Column, q: Column) -> list[Column]:
    """name, comment, seq and qual of a record's lines; wrong markers or lengths raise an error."""
    clean = lambda c: F.regexp_replace(c, "\r$", "")
    head, seq, plus, q = clean(head), clean(seq), clean(plus), clean(q)
    fine = head.startswith("@") & plus.startswith("+") & (F.length(seq) == F.length(q))
    checked = F.when(fine, F.upper(seq)).otherwise(F.raise_error(F.concat(F.lit("bad record "), F.coalesce(head, F.lit("")))))
    letters = F.filter(F.split(q, ""), lambda c: c != "")
    return [
        F.regexp_extract(head, r"^@(\S*)", 1).alias("name"),
        F.regexp_extract(head, r"^@\S*\s*(.*)$", 1).alias("comment"),
        checked.alias("seq"),
        F.transform(letters, lambda c: (F.ascii(c) - 33).cast("int")).alias("qual"),
    ]


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, name, comment, seq, qual) of four-line records; unequal lengths or markers raise an error.

    Files are split anywhere: a line's number in its file tells its place in a
    record, and the four lines of a record are put together by that.  Blank lines
    at the end are left out.
    """
    lines = numbered_lines(spark, path)
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    numbers = _carried(blocks, before="n").select("file", "block", (F.col("before") - F.col("first")).alias("shift"))
    placed = lines.join(F.broadcast(numbers), ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("number"), "value")
    line = lambda k: F.max(F.when(F.col("number") % 4 == k, F.col("value")))
    whole = placed.groupBy("file", F.floor(F.col("number") / 4).alias("nth")).agg(*(line(k).alias(f"l{k}") for k in range(4)))
    some = whole.where(~F.coalesce(F.regexp_replace(F.concat_ws("", "l0", "l1", "l2", "l3"), r"\s", "") == "", F.lit(True)))
    columns = _record_columns(*(F.coalesce(f"l{k}", F.lit("")) for k in range(4)))
    return some.select("file", "nth", *columns)


def read_multiline_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_fastq() of records whose bases and qualities may take several lines.

    Where a record ends only shows in the lines before it, so a file is one task's;
    its lines stream through it.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, nth, state, lines, out = None, 0, None, ["", "", "", ""], []

        def close() -> None:
            if state is not None and (state != 3 or len(lines[1]) != len(lines[3])):
                raise ValueError(f"{file}: record {lines[0]!r} isn't whole")

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), *[pa.string()] * 4)
            names = ["file", "nth", "l0", "l1", "l2", "l3"]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for where, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if where != file:
                    close()
                    file, nth, state = where, 0, None
                value = value.rstrip("\r")
                if state is None:
                    if value:
                        lines, state = [value, "", "", ""], 1
                elif state == 1 and value.startswith("+"):
                    lines[2], state = value, 3
                elif state in (1, 3):
                    lines[state] += value
                if state == 3 and len(lines[3]) >= len(lines[1]):
                    out.append((file, nth, *lines))
                    nth, state = nth + 1, None
            yield batch_of()
            out.clear()
        close()

    lines = numbered_lines(spark, path).repartition("file").sortWithinPartitions("file", "block", "at").select("file", "value")
    found = lines.mapInArrow(parse, "file string, nth long, l0 string, l1 string, l2 string, l3 string")
    return found.select("file", "nth", *_record_columns(*(F.col(f"l{k}") for k in range(4))))


def write_fastq(records: DataFrame, path: str) -> None:
    """records(name, comment, seq, qual) as part files of four-line records."""
    quals = F.array_join(F.transform("qual", lambda q: F.chr(q + 33)), "")
    head = F.concat(F.lit("@"), "name", F.when(F.col("comment") != "", F.concat(F.lit(" "), "comment")).otherwise(""))
    records.select(F.concat_ws("\n", head, "seq", F.lit("+"), quals).alias("value")).write.text(path)


def compression(data: bytes) -> str:
    """`bgzf`, `gzip` or `plain` by a file's first bytes; neither of the first two can be read from the middle without an index."""
    if data[:2] != b"\x1f\x8b":
        return "plain"
    return "bgzf" if len(data) >= 14 and data[3] & 4 and data[12:14] == b"BC" else "gzip"


def read_number(name: Column, comment: Column) -> Column:
    """1 or 2, from a `/1` suffix or a sequencer comment `1:N:0:...`; else null."""
    suffix = F.nullif(F.regexp_extract(name, r"/([12])$", 1), F.lit(""))
    told = F.nullif(F.regexp_extract(comment, r"^([12]):[YN]:", 1), F.lit(""))
    return F.coalesce(suffix, told).cast("int")


def unmapped_records(fastq: DataFrame, skip_filtered: bool = False) -> DataFrame:
    """Unmapped alignments: suffix stripped, read bits, quality-fail bit, barcode, molecular tag where the name has them, tags of the comment."""
    number = read_number(F.col("name"), F.col("comment"))
    failed = F.col("comment").rlike(r"^[12]:Y:")
    flag = (
        F.lit(scalars.UNMAPPED)
        + F.when(number.isNotNull(), scalars.PAIRED | scalars.MATE_UNMAPPED).otherwise(0)
        + F.when(number == 1, scalars.FIRST).when(number == 2, scalars.SECOND).otherwise(0)
        + F.when(failed, scalars.QC_FAIL).otherwise(0)
    )
    rows = fastq.where(~failed) if skip_filtered else fastq
    molecule = F.when(F.size(F.split("name", ":")) >= 8, F.element_at(F.split(F.regexp_replace("name", "/[12]$", ""), ":"), -1))
    return rows.select(
        F.regexp_replace("name", "/[12]$", "").alias("qname"),
        flag.cast("int").alias("flag"),
        scalars.bases(F.col("seq")).alias("seq"),
        "qual",
        F.nullif(F.regexp_extract("comment", r"^[12]:[YN]:\d+:(\S+)$", 1), F.lit("")).alias("barcode"),
        molecule.alias("molecule"),
        tags.parse(F.split("comment", r"[ \t]+")).alias("aux"),
    )


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads of two files in lock step, joined on their number; different names raise an error."""
    strip = lambda c: F.regexp_replace(c, "/[12]$", "")
    a = first.select("nth", strip("name").alias("name"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    b = second.select("nth", strip("name").alias("name2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    both = a.join(b, "nth")
    same = F.when(F.col("name") == F.col("name2"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("names differ: "), "name", F.lit(" "), "name2")))
    return both.withColumn("name", same).drop("name2")


def interleaved(fastq: DataFrame) -> DataFrame:
    """(file, nth, name, seq1, qual1, seq2, qual2) of files whose records alternate; different names or an odd number raise an error."""
    strip = F.regexp_replace("name", "/[12]$", "")
    side = lambda k: F.max(F.when(F.col("nth") % 2 == k, F.struct(strip.alias("name"), "seq", "qual"))).alias(f"r{k}")
    both = fastq.groupBy("file", F.floor(F.col("nth") / 2).alias("pair")).agg(side(0), side(1))
    same = F.coalesce(F.col("r0.name") == F.col("r1.name"), F.lit(False))
    name = F.when(same, F.col("r0.name")).otherwise(F.raise_error(F.concat(F.lit("no mate for "), F.coalesce("r0.name", "r1.name"))))
    return both.select(
        "file", F.col("pair").alias("nth"), name.alias("name"), F.col("r0.seq").alias("seq1"), F.col("r0.qual").alias("qual1"), F.col("r1.seq").alias("seq2"), F.col("r1.qual").alias("qual2")
    )
