"""Alignments as rows: derivation from star-schema tables, region fetch, filters, edits, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions import cigar, scalars


def reference_base(pos: Column) -> Column:
    """The base of the derived reference at a position."""
    return F.substring(F.lit("ACGT"), ((pos * 7 + F.floor(pos / 3)) % 4 + 1).cast("int"), F.lit(1))


#: CIGAR shapes of derived reads; a negative number is added to the read's length.
SHAPES = (
    ((0, "M"),),
    ((10, "M"), (2, "D"), (-10, "M")),
    ((10, "M"), (3, "I"), (-13, "M")),
    ((10, "M"), (50, "N"), (-10, "M")),
    ((5, "S"), (-5, "M")),
    ((3, "H"), (4, "S"), (-6, "M"), (2, "S"), (5, "H")),
    ((8, "="), (1, "X"), (-9, "=")),
    ((10, "M"), (2, "D"), (2, "I"), (-12, "M")),
    ((10, "M"), (2, "I"), (2, "D"), (-12, "M")),
    ((10, "M"), (1, "P"), (2, "I"), (1, "P"), (1, "I"), (-13, "M")),
    ((10, "M"), (30, "N"), (1, "I"), (-11, "M")),
    ((-4, "M"), (2, "D"), (4, "S")),
    ((2, "D"), (0, "M"), (3, "D")),
    ((6, "="), (2, "X"), (1, "I"), (-12, "M"), (3, "S")),
    (),
    ((0, "M"),),
)
#: The shape of unmapped reads, and that of reads without a sequence.
UNMAPPED_SHAPE, BARE_SHAPE = 14, 15


def derived_reads(lineitem: DataFrame, sequence: bool = True) -> DataFrame:
    """One alignment for each row of lineitem, by integer arithmetic.

    Columns: read_id, qname, contig, pos, flag, mapq, ops, qlen, and with sequence
    seq and qual.  Deterministic, so other engines can derive the same.  The shapes
    hold clips, pads, skips, =, X, deletions at the ends and before insertions,
    unmapped reads without a CIGAR and reads without a sequence; flags mark
    secondary, supplementary, duplicate and failed reads; some reads have no
    qualities, and some bases are N.
    """
    out = skeleton(lineitem)
    return (sequenced(out) if sequence else out).drop("k", "no_quality")


def skeleton(lineitem: DataFrame) -> DataFrame:
    """derived_reads() without bases, and with what sequenced() needs for them, in columns k and no_quality."""
    c = F.col
    qlen = (F.lit(20) + F.floor("l_quantity")).cast("int")
    k = ((c("l_orderkey") + c("l_linenumber")) % len(SHAPES)).cast("int")
    bit = lambda when, b: F.when(when, b).otherwise(0)
    flag = (
        bit(c("l_linestatus") == "F", scalars.REVERSE)
        + scalars.PAIRED
        + F.when(c("l_linenumber") % 2 == 1, scalars.FIRST).otherwise(scalars.SECOND)
        + bit(c("l_returnflag") == "R", scalars.DUPLICATE)
        + bit(c("l_partkey") % 17 == 0, scalars.SECONDARY)
        + bit(c("l_partkey") % 19 == 0, scalars.SUPPLEMENTARY)
        + bit(c("l_suppkey") % 23 == 0, scalars.QC_FAIL)
        + bit(c("l_partkey") % 5 == 0, scalars.MATE_REVERSE)
        + bit(k == UNMAPPED_SHAPE, scalars.UNMAPPED)
    )
    reads = lineitem.select(
        ((((c("l_orderkey") * 8 + c("l_linenumber")) * 1024 + c("l_partkey") % 1024) * 256 + c("l_suppkey") % 256) * 64 + F.floor("l_quantity")).alias("read_id"),
        c("l_orderkey").cast("string").alias("qname"),
        F.concat(F.lit("chr"), (c("l_suppkey") % 3 + 1).cast("string")).alias("contig"),
        ((c("l_partkey") * 37 + c("l_orderkey") * 11) % 9000).alias("pos"),
        flag.cast("int").alias("flag"),
        (c("l_orderkey") % 61).cast("int").alias("mapq"),
        k.alias("k"),
        qlen.alias("qlen"),
        (c("l_partkey") % 29 == 0).alias("no_quality"),
    )
    return shaped(reads)


def shaped(reads: DataFrame) -> DataFrame:
    """reads with ops, by k and qlen."""
    c = F.col
    # looked up: nested conditions on all shapes make a method too large for the JVM to compile
    part = lambda n, op: F.struct(F.lit(n).alias("n"), F.lit(int(n <= 0)).alias("grows"), F.lit(op).alias("op"))
    shapes = F.array(*(F.array(*(part(*x) for x in parts)).cast("array<struct<n:int,grows:int,op:string>>") for parts in SHAPES))
    shape = F.transform(F.get(shapes, c("k")), lambda p: F.struct((p["n"] + p["grows"] * c("qlen")).alias("len"), p["op"].alias("op"))).cast(cigar.OPS)
    return reads.withColumn("ops", shape)


#: Bases of derived reads repeat with these periods of the reference position and of read_id plus the query position.
_BY_REF, _BY_READ = 12, 11 * 97
_PERIOD = _BY_REF * _BY_READ
#: Ops up to this length are slices of the tables, longer ones of tables that are put together for them; a multiple of 14.
_TABLED = 504


def _table(op: str) -> bytes:
    """Bases of an op by x, where x is the reference position modulo _BY_REF and read_id plus the query position modulo _BY_READ."""
    out = []
    for x in range(_PERIOD + _TABLED):
        other = op == "X" or (op != "=" and x % 11 == 0)
        out.append("N" if op == "M" and x % 97 == 0 else "ACGT"[(x * 7 + x // 3 + other) % 4])
    return "".join(out).encode()


_TABLES = {op: _table(op) for op in "MIX="}
#: Qualities by read_id modulo 6.
_QUALITIES = [[(r * 7 + q * 3) % 42 for q in range(_TABLED)] for r in range(6)]


def _places(parts: tuple) -> Column:
    """The query ops of a shape: table and length (plus the read's, if it grows), and query and reference places alike."""
    out, qs, qg, rs, rg = [], 0, 0, 0, 0
    for n, op in parts or ((0, "M"),):
        grows = int(n <= 0)
        if op in cigar.QUERY_OPS:
            out.append((list(_TABLES).index("I" if op == "S" else op), n, grows, qs, qg, rs, rg))
            qs, qg = qs + n, qg + grows
        if op in cigar.REF_OPS:
            rs, rg = rs + n, rg + grows
    return F.array(*(F.struct(*(F.lit(x).alias(f) for x, f in zip(p, ("table", "n", "ng", "q", "qg", "r", "rg"), strict=True))) for p in out))


def sequenced(reads: DataFrame) -> DataFrame:
    """skeleton() with seq and qual.

    Bases are slices of tables, whose places follow from the shape and the length; all
    is looked up in lambdas, since one method generated for every shape would be too
    large for the JVM to compile.
    """
    c = F.col
    by_ref, by_read = _BY_READ * pow(_BY_READ, -1, _BY_REF), _BY_REF * pow(_BY_REF, -1, _BY_READ)
    tables = F.array(*(F.lit(t) for t in _TABLES.values()))

    def part(p: Column) -> Column:
        of = lambda f: p[f] + p[f + "g"] * c("qlen")
        x = (F.pmod(c("pos") + of("r"), F.lit(_BY_REF)) * by_ref + F.pmod(c("read_id") + of("q"), F.lit(_BY_READ)) * by_read) % _PERIOD
        at, size, table = (x + 1).cast("int"), of("n"), F.get(tables, p["table"])
        periods = F.repeat(F.substring(table, 1, _PERIOD).cast("string"), F.ceil((x + size) / _PERIOD).cast("int"))
        return F.when(size <= _TABLED, F.substring(table, at, size).cast("string")).otherwise(F.call_function("substring", periods, at, size))

    def values(table: Column) -> Column:
        more = F.flatten(F.array_repeat(table, F.ceil(c("qlen") / _TABLED).cast("int")))
        known = F.slice(F.when(c("qlen") <= _TABLED, table).otherwise(more), 1, c("qlen"))
        return F.when(c("k") == BARE_SHAPE, F.array().cast("array<int>")).when(c("no_quality"), F.array_repeat(F.lit(scalars.NO_QUALITY), c("qlen"))).otherwise(known)

    places = F.array(*(_places(parts) for parts in SHAPES))
    seq = F.when(c("k") == BARE_SHAPE, "").otherwise(F.array_join(F.transform(F.get(places, c("k")), part), ""))
    qualities = F.array(*(F.array(*map(F.lit, some)) for some in _QUALITIES))
    return reads.withColumns({"seq": seq, "qual": cigar.bind(F.get(qualities, (c("read_id") % 6).cast("int")), values)})


def completed(reads: DataFrame) -> DataFrame:
    """skeleton() that has lost its ops, with ops, seq and qual."""
    return sequenced(shaped(reads))


def fetch(reads: DataFrame, contig: str, start: int, end: int, keep_unmapped: bool = False) -> DataFrame:
    """Reads that overlap the inclusive 0-based range.

    The conditions on contig and pos reach the scan; the end follows from the CIGAR.
    """
    out = reads.where((F.col("contig") == contig) & (F.col("pos") <= end))
    if not keep_unmapped and "flag" in reads.columns:
        out = out.where(~scalars.has(F.col("flag"), scalars.UNMAPPED))
    return out.where(cigar.end_position(F.col("pos"), F.col("ops")) >= start)


def customized(reads: DataFrame, raw: Column | None = None, compute: dict[str, Column] | None = None, keep: Column | None = None) -> DataFrame:
    """The per-record hooks: a raw filter, computed extras, a filter on these."""
    if raw is not None:
        reads = reads.where(raw)
    if compute:
        reads = reads.withColumns(compute)
    return reads if keep is None else reads.where(keep)


def deduplicated(reads: DataFrame) -> DataFrame:
    """Of neighbours in (contig, pos, read_id, flag) order that agree in pos, flag and qname, the first."""
    by = Window.partitionBy("contig", "pos").orderBy("read_id", "flag")
    same = (F.lag("flag").over(by) == F.col("flag")) & (F.lag("qname").over(by) == F.col("qname"))
    return reads.withColumn("same", F.coalesce(same, F.lit(False))).where(~F.col("same")).drop("same")


def sorted_by_position(reads: DataFrame) -> DataFrame:
    return reads.orderBy("contig", "pos", "read_id")


def with_alignment(reads: DataFrame, pos: Column, ops: Column) -> DataFrame:
    """Another position and CIGAR of at most 65535 ops; the query length must stay that of seq."""
    fits = (cigar.query_length(ops) == F.length("seq")) & (F.size(ops) <= 65535)
    checked = F.when(fits, ops).otherwise(F.raise_error(F.lit("CIGAR and sequence differ in length")).cast(cigar.OPS))
    return reads.withColumns({"pos": pos, "ops": checked})


def realigned(reads: DataFrame, min_match: int) -> DataFrame:
    """A leading match longer than min_match loses that many bases to a soft clip, and the read starts later."""
    first = F.get("ops", F.lit(0))
    moves = F.coalesce((first["op"] == "M") & (first["len"] > min_match), F.lit(False))
    return reads.withColumns(
        {"pos": F.when(moves, F.col("pos") + min_match).otherwise(F.col("pos")), "ops": cigar.clip_start(F.col("ops"), min_match)}
    )


def with_mate(reads: DataFrame, next_contig: Column, next_pos: Column, tlen: Column) -> DataFrame:
    """Other mate fields and template length."""
    return reads.withColumns({"next_contig": next_contig.cast("string"), "next_pos": next_pos.cast("long"), "tlen": tlen.cast("int")})


def checked(reads: DataFrame) -> DataFrame:
    """reads as they can be written: raises an error for a name over 254 bytes, more than 65535 ops, or lengths that don't fit.

    Qualities are as many as bases, or none; a CIGAR's query length is that of the
    bases, unless the read is unmapped, or either is missing.
    """
    bases = F.length("seq")
    wrong = (
        F.when(F.octet_length("qname") > 254, "the name is too long")
        .when(F.size("ops") > 65535, "too many CIGAR ops")
        .when((F.size("qual") > 0) & (F.size("qual") != bases), "qualities and sequence differ in length")
        .when(
            ~scalars.has(F.col("flag"), scalars.UNMAPPED) & (F.size("ops") > 0) & (bases > 0) & (cigar.query_length(F.col("ops")) != bases),
            "CIGAR and sequence differ in length",
        )
    )
    name = F.when(wrong.isNull(), F.col("qname")).otherwise(F.raise_error(F.concat(wrong, F.lit(": "), F.substring("qname", 1, 254))).cast("string"))
    return reads.withColumn("qname", name)


def with_sequence(reads: DataFrame, seq: Column, qual: Column) -> DataFrame:
    """Other bases and qualities, checked against each other and the CIGAR."""
    return checked(reads.withColumns({"seq": seq, "qual": qual}))


def template_lengths(reads: DataFrame) -> DataFrame:
    """reads with tlen: the span of the mapped reads of a qname on a contig, 0 for unmapped reads and single ones.

    The sign belongs to the first read (smallest read_id): positive if it is the
    leftmost, and either ends before the last or is the only one that begins
    there; if it spans all and others begin and end with it, positive for the
    first in template; else negative.  The other reads have the opposite sign.
    The spans are a map-side aggregate joined back, so a frequent qname is never
    gathered.
    """
    end = cigar.exclusive_end(F.col("pos"), F.col("ops"))
    mapped = ~scalars.has(F.col("flag"), scalars.UNMAPPED)
    up, down = F.col("read_id"), -F.col("read_id")
    spans = (
        reads.where(mapped)
        .withColumn("end", end)
        .groupBy("qname", "contig")
        .agg(
            F.min("pos").alias("low"),
            F.max("end").alias("high"),
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.struct("read_id", "pos", "end", "flag"), "read_id").alias("f"),
            (F.min_by("read_id", F.struct("pos", up.alias("x"))) != F.min_by("read_id", F.struct("pos", down.alias("x")))).alias("left_tie"),
            (F.max_by("read_id", F.struct("end", up.alias("x"))) != F.max_by("read_id", F.struct("end", down.alias("x")))).alias("right_tie"),
        )
        .where("n > 1 and high > low")
    )
    leftmost = F.col("f.pos") == F.col("low")
    sign = (
        F.when(leftmost & ((F.col("f.end") < F.col("high")) | ~F.col("left_tie")), 1)
        .when(leftmost & (F.col("f.end") == F.col("high")) & F.col("left_tie") & F.col("right_tie") & scalars.has(F.col("f.flag"), scalars.FIRST), 1)
        .otherwise(-1)
    )
    spans = spans.select("qname", "contig", F.col("f.read_id").alias("first_id"), (sign * (F.col("high") - F.col("low"))).cast("long").alias("own"))
    tlen = F.when(~mapped | F.col("own").isNull(), 0).when(F.col("read_id") == F.col("first_id"), F.col("own")).otherwise(-F.col("own"))
    return reads.join(spans, ["qname", "contig"], "left").withColumn("tlen", tlen.cast("long")).drop("first_id", "own")


def mates(reads: DataFrame) -> DataFrame:
    """(qname, first_id, second_id, first_contig, second_contig, distance): the pair of primary reads of each template.

    Of several first (or second) in template, the one of the smallest read_id
    counts; distance is null between contigs.  One aggregate with map-side
    partials: a qname gives one row, however many reads it has.
    """
    primary = ~scalars.has(F.col("flag"), scalars.SECONDARY) & ~scalars.has(F.col("flag"), scalars.SUPPLEMENTARY)
    side = lambda bit: F.min(F.when(primary & scalars.has(F.col("flag"), bit), F.struct("read_id", "contig", "pos")))
    both = reads.groupBy("qname").agg(side(scalars.FIRST).alias("a"), side(scalars.SECOND).alias("b")).where("a is not null and b is not null")
    return both.select(
        "qname",
        F.col("a.read_id").alias("first_id"),
        F.col("b.read_id").alias("second_id"),
        F.col("a.contig").alias("first_contig"),
        F.col("b.contig").alias("second_contig"),
        F.when(F.col("a.contig") == F.col("b.contig"), F.col("b.pos") - F.col("a.pos")).alias("distance"),
    )
