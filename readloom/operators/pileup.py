"""Column-wise pileup: reads become rows of (contig, pos, read) and columns are groups of these.

Ops are placed within each read's row and clipped to the region; each takes its
own slice of bases and qualities along before it is exploded to positions, so the
work grows in proportion to the bases.  Only the final group-by shuffles.  Where
depth alone is asked for, depth_sweep() needs two events an op instead of a row a
base.  pileup_text() shuffles reads, not bases; lines.py makes the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions import cigar, scalars
from readloom.operators import lines

CARRIED = ("read_id", "qname", "flag", "mapq")


def columns(reads: DataFrame, start: int | Column | None = None, end: int | Column | None = None, carry: tuple[str, ...] = CARRIED, bases: bool = True) -> DataFrame:
    """(contig, pos, kind, qpos, del_len, insert_len, is_refskip, ...): a row for each read at each position it covers.

    kind: match, insertion (last base before an insertion), del, complex (last
    base of a deletion or skip before an insertion), skip.  With bases, base and
    qual of matches and insertions (N and 255 for a missing sequence), and inserted,
    the bases put in after them.  start and end clip to an inclusive range before
    anything is exploded.  Reads flagged unmapped are in no column.
    """
    have = [c for c in carry if c in reads.columns]
    if "flag" in reads.columns:
        reads = reads.where(~scalars.has(F.col("flag"), scalars.UNMAPPED))
    bound = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    low = lambda o: o["rs"] if start is None else F.greatest(o["rs"], bound(start))
    last = lambda o: o["rs"] + o["len"] - 1
    high = lambda o: last(o) if end is None else F.least(last(o), bound(end))
    based = lambda o: o["op"].isin(*cigar.BASE_OPS)

    def piece(o: Column, letters: Column | None) -> Column:
        fields = [
            low(o).alias("low"), high(o).alias("high"), last(o).alias("last"), o["op"].alias("op"), o["len"].alias("len"), o["ins_after"].alias("ins"),
            F.when(based(o), o["qs"] + low(o) - o["rs"]).cast("int").alias("q"),
        ]
        if letters is not None:
            n, at = (high(o) - low(o) + 1).cast("int"), (o["qs"] + low(o) - o["rs"] + 1).cast("int")
            none = F.size(letters) == 0
            known = F.when(none, F.array_repeat(F.lit("N"), n)).otherwise(F.slice(letters, at, n))
            quals = F.when(F.size("qual") == 0, F.array_repeat(F.lit(scalars.NO_QUALITY), n)).otherwise(F.slice("qual", at, n))
            put = F.array_join(F.slice(letters, at + n, o["ins_after"]), "")
            fields += [
                F.when(based(o), known).otherwise(F.array().cast("array<string>")).alias("bases"),
                F.when(based(o), quals).otherwise(F.array().cast("array<int>")).alias("quals"),
                F.when(based(o) & (high(o) == last(o)), put).otherwise("").alias("put"),
            ]
        return F.struct(*fields)

    def pieces(letters: Column | None) -> Column:
        covering = lambda o: o["op"].isin(*cigar.REF_OPS) & (low(o) <= high(o))
        return F.transform(F.filter(cigar.placed(F.col("pos"), F.col("ops")), covering), lambda o: piece(o, letters))

    made = cigar.bind(F.filter(F.split("seq", ""), lambda x: x != ""), pieces) if bases else pieces(None)
    each = reads.select("contig", *have, F.explode(made).alias("o"))
    o = lambda f: F.col(f"o.{f}")
    span = F.sequence(o("low"), o("high"))
    if bases:
        rows = each.select("contig", *have, "o", F.explode(F.arrays_zip(span.alias("pos"), o("bases").alias("base"), o("quals").alias("qual"))).alias("b"))
        rows = rows.select("contig", *have, "o", F.col("b.pos").alias("pos"), F.col("b.base").alias("base"), F.col("b.qual").alias("qual"))
    else:
        rows = each.select("contig", *have, "o", F.explode(span).alias("pos"))
    at_end = (F.col("pos") == o("last")) & (o("ins") > 0)
    kind = (
        F.when(based(F.col("o")), F.when(at_end, "insertion").otherwise("match"))
        .when(at_end, "complex")
        .when(o("op") == "D", "del")
        .otherwise("skip")
    )
    out = {
        "kind": kind,
        "qpos": (o("q") + F.col("pos") - o("low")).cast("int"),
        "del_len": F.when(o("op") == "D", o("len")),
        "insert_len": F.when(at_end, o("ins")).otherwise(0),
        "is_refskip": o("op") == "N",
    }
    if bases:
        out |= {"base": F.col("base"), "qual": F.col("qual"), "inserted": F.when(at_end, o("put")).otherwise("")}
    return rows.select("contig", "pos", *have, *(v.alias(k) for k, v in out.items()))


def depth(cols: DataFrame) -> DataFrame:
    """(contig, pos, depth, match_depth, deletions, refskips, inserted) of pileup rows."""
    count = lambda cond: F.count_if(cond)
    return cols.groupBy("contig", "pos").agg(
        F.count(F.lit(1)).alias("depth"),
        F.count("qpos").alias("match_depth"),
        count(F.col("kind").isin("del", "complex")).alias("deletions"),
        count(F.col("is_refskip")).alias("refskips"),
        F.sum("insert_len").cast("long").alias("inserted"),
    )


def depth_sweep(reads: DataFrame, tile: int = 10_000) -> DataFrame:
    """(contig, start, end, depth): maximal runs of equal positive depth within tiles of the contig.

    Ops are cut at tile borders, so the running sum of +1 and -1 events has a
    bounded partition and no contig lands in one task.
    """
    if "flag" in reads.columns:
        reads = reads.where(~scalars.has(F.col("flag"), scalars.UNMAPPED))
    ops = F.filter(cigar.placed(F.col("pos"), F.col("ops")), lambda o: o["op"].isin(*cigar.REF_OPS))
    spans = reads.select("contig", F.explode(ops).alias("o")).select("contig", F.col("o.rs").alias("a"), (F.col("o.rs") + F.col("o.len")).alias("z"))
    cut = spans.select("contig", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / tile), F.floor((F.col("z") - 1) / tile))).alias("tile"))
    low, high = F.greatest("a", F.col("tile") * tile), F.least("z", (F.col("tile") + 1) * tile)
    events = cut.select("contig", "tile", F.explode(F.array(F.struct(low.alias("p"), F.lit(1).alias("d")), F.struct(high.alias("p"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy("contig", "tile", F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))
    by = Window.partitionBy("contig", "tile").orderBy("p")
    runs = steps.where("d <> 0").select("contig", "p", F.sum("d").over(by).alias("depth"), F.lead("p").over(by).alias("q"))
    return runs.where("depth > 0").select("contig", F.col("p").alias("start"), (F.col("q") - 1).alias("end"), "depth")


def truncated(cols: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of each column, by read_id."""
    by = Window.partitionBy("contig", "pos").orderBy("read_id")
    return cols.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= most).drop("nth")


def mate_deduplicated(reads: DataFrame, carry: tuple[str, ...] = CARRIED, bases: bool = True) -> DataFrame:
    """columns() in which, of the first two rows of a qname at a position, one stays: the one with a base, else first in template.

    Mates are found before anything is exploded: a template's reads can meet only
    between the largest start and the smallest end of two reads, or anywhere
    within more than two.  Only positions there are ranked; all others pass.
    """
    mapped = reads.where(~scalars.has(F.col("flag"), scalars.UNMAPPED))
    last = cigar.end_position(F.col("pos"), F.col("ops"))
    meets = (
        mapped.withColumn("last", last)
        .groupBy("contig", "qname")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.min("last").alias("y"), F.max("last").alias("z"))
        .where("n > 1")
        .select("contig", "qname", F.when(F.col("n") == 2, F.col("b")).otherwise(F.col("a")).alias("meet_low"), F.when(F.col("n") == 2, F.col("y")).otherwise(F.col("z")).alias("meet_high"))
        .where("meet_low <= meet_high")
    )
    wanted = tuple(dict.fromkeys((*carry, "read_id", "qname", "flag", "meet_low", "meet_high")))
    joined = mapped.join(meets, ["contig", "qname"], "left")
    cols = columns(joined, carry=wanted, bases=bases)
    inside = F.coalesce((F.col("pos") >= F.col("meet_low")) & (F.col("pos") <= F.col("meet_high")), F.lit(False))
    # the few that are ranked are clipped to their range before they are exploded
    ranked = columns(joined.where("meet_low is not null"), F.col("meet_low"), F.col("meet_high"), carry=wanted, bases=bases)
    first = Window.partitionBy("contig", "pos", "qname").orderBy("read_id")
    rank = Window.partitionBy("contig", "pos", "qname", "pair").orderBy(
        F.col("qpos").isNotNull().desc(), scalars.has(F.col("flag"), scalars.FIRST).desc(), "read_id"
    )
    n = F.col("nth")
    met = ranked.withColumn("nth", F.row_number().over(first)).withColumn("pair", F.when(n <= 2, 0).otherwise(n))
    stays = met.withColumn("r", F.row_number().over(rank)).where("r = 1").select(*cols.columns)
    extra = [c for c in ("read_id", "qname", "flag", "meet_low", "meet_high") if c not in carry]
    return cols.where(~inside).unionByName(stays).drop(*extra)


def with_reference(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """ref_base from reference(contig, pos, base), N outside it."""
    ref = reference.select("contig", "pos", F.col("base").alias("ref_base"))
    return rows.join(ref, ["contig", "pos"], "left").withColumn("ref_base", F.coalesce("ref_base", F.lit("N")))


def reference_range(reference: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(contig, first, last, ...) with bases, the text of reference(contig, pos, base) there; null unless all of it is known."""
    key = F.xxhash64(*ranges.columns)
    each = ranges.withColumn("key", key).withColumn("pos", F.explode(F.sequence("first", "last")))
    met = each.join(reference.select("contig", "pos", "base"), ["contig", "pos"], "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("base").isNotNull(), F.struct("pos", "base"))))
    text = F.array_join(F.transform(listed, lambda x: x["base"]), "")
    out = met.groupBy("key", *ranges.columns).agg(F.when(F.count("base") == F.count(F.lit(1)), text).alias("bases"))
    return out.drop("key")


def base_counts(cols: DataFrame, by: tuple[str, ...] = ("contig", "pos")) -> DataFrame:
    """n_a, n_c, n_g, n_t and depth of columns; N isn't counted."""
    return cols.groupBy(*by).agg(
        *(F.count_if(F.col("base") == b).alias(f"n_{b.lower()}") for b in "ACGT"), F.count("qpos").alias("match_depth")
    )


def best_alt(ref: Column) -> Column:
    """struct(base, n) of the most frequent base but ref; ties go to the earlier of A, C, G, T; null for ref N or none."""
    each = F.array(
        *(F.struct(F.when(ref == b, 0).otherwise(F.col(f"n_{b.lower()}")).cast("long").alias("n"), F.lit(-i).alias("i"), F.lit(b).alias("base")) for i, b in enumerate("ACGT"))
    )
    top = F.array_max(each)
    return F.when((ref != "N") & (top["n"] > 0), F.struct(top["base"].alias("base"), top["n"].alias("n")))


#: Positions of a tile, whose reads make their mpileup lines together.
TILE = 512


def _cut(reads: DataFrame) -> DataFrame:
    """Reads that are longer than a tile, each cut to the ops, bases and qualities within its own tile."""
    low, high = F.col("tile") * TILE, F.col("tile") * TILE + TILE - 1
    based = lambda o: o["op"].isin(*cigar.BASE_OPS)
    end = lambda o: o["rs"] + o["len"] - 1

    def part(o: Column) -> Column:
        a, z = F.greatest(o["rs"], low), F.least(end(o), high)
        n, put = (z - a + 1).cast("int"), F.when(z == end(o), o["ins_after"]).otherwise(0)
        at, size = o["qs"] + F.when(based(o), a - o["rs"]).otherwise(0).cast("int") + 1, F.when(based(o), n).otherwise(0) + put
        ops = F.array(F.struct(n.alias("len"), o["op"].alias("op")), F.struct(put.alias("len"), F.lit("I").alias("op")))
        return F.struct(ops.alias("ops"), F.call_function("substring", F.col("seq"), at, size).alias("seq"), F.slice("qual", at, size).alias("qual"))

    covering = lambda o: o["op"].isin(*cigar.REF_OPS) & (o["rs"] <= high) & (end(o) >= low)
    parts = F.transform(F.filter(cigar.placed(F.col("pos"), F.col("ops")), covering), part)
    whole = reads.withColumn("parts", F.when(F.col("last") - F.col("first") >= TILE, parts))
    either = lambda made, name: F.when(F.col("parts").isNull(), F.col(name)).otherwise(made)
    of = lambda f: F.transform("parts", lambda x: x[f])
    cut = {"ops": F.flatten(of("ops")).cast(cigar.OPS), "seq": F.array_join(of("seq"), ""), "qual": F.flatten(of("qual")), "pos": F.greatest("first", low)}
    return whole.withColumns({k: either(v, k) for k, v in cut.items()}).drop("parts")


def pileup_text(
    reads: DataFrame, reference_base, start: int | None = None, end: int | None = None, trim: bool = False, completed: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(contig, pos1, ref_base, depth, bases, quals): the mpileup lines of all columns, reads in (position, read_id) order.

    `^` and the mapping quality before a read's first base, `.` and `,` for bases
    that equal the reference, upper and lower case for others by strand, `+n` and
    the bases of an insertion, `*` for deletions, `>` and `<` for skips, `$` after a
    read's last base; qualities as text, `~` where there are none.
    reference_base(pos) is a Column.  With trim, reads end before deletions and
    skips that no query base follows.

    Reads are dealt by tiles of the contig and sorted there, so a read is shuffled
    once for each tile that it reaches, and a base never by itself.  completed gives
    rows that are sorted ops, seq and qual again, so that they needn't be shuffled.
    """
    mapped = reads.where(~scalars.has(F.col("flag"), scalars.UNMAPPED))
    trimmed = lambda df: df.withColumn("ops", cigar.trim_trailing(F.col("ops"))) if trim else df
    placed = trimmed(mapped).withColumns({"first": F.col("pos").cast("long"), "last": cigar.end_position(F.col("pos"), F.col("ops")).cast("long")})
    low, high = F.col("first"), F.col("last")
    if start is not None:
        placed, low = placed.where(F.col("last") >= start), F.greatest(low, F.lit(start))
    if end is not None:
        placed, high = placed.where(F.col("first") <= end), F.least(high, F.lit(end))
    tile = lambda p: F.floor(p / TILE).cast("long")
    tiled = placed.withColumns({"pos": F.col("first"), "tile": F.explode(F.sequence(tile(low), tile(high)))})
    if completed is None:
        # a byte a quality is enough, since larger ones are shown as the largest
        packed = F.transform("qual", lambda q: F.least(q, F.lit(93)).cast("tinyint"))
        tiled = _cut(tiled.withColumns({"seq": F.coalesce("seq", F.lit("")), "qual": F.coalesce(packed, F.array().cast("array<tinyint>"))}))
    else:
        tiled = tiled.drop("ops")
    # strand, mapping quality and span in one number, since shuffled bytes grow with the columns that vary
    mark = F.greatest(F.least(F.col("mapq"), F.lit(93)) + 33, F.lit(0)).cast("long")
    small = F.shiftleft(F.col("last") - F.col("first"), 9) + mark * 2 + scalars.has(F.col("flag"), scalars.REVERSE).cast("long")
    dealt = tiled.withColumn("small", small).drop("flag", "mapq", "last", *(["pos"] if completed else [])).repartition("contig", "tile")
    # the first of the reads that start together brings the bases of the reference up to the last of their ends
    together = Window.partitionBy("contig", "tile", "first").orderBy("read_id", "small")
    reach = F.max("small").over(together.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = dealt.withColumns({"nth": F.row_number().over(together), "reach": F.col("first") + F.shiftright(reach, 9)})
    whole = ranked if completed is None else trimmed(completed(ranked.withColumn("pos", F.col("first"))))
    word = lambda o: F.shiftleft(o["len"].cast("long"), 4) + F.call_function("instr", F.lit(cigar.CODES), o["op"])
    begin, stop = F.col("tile") * TILE, F.col("tile") * TILE + TILE - 1
    ref = F.transform(F.sequence(F.greatest("first", begin), F.least("reach", stop)), lambda p: reference_base(p).cast("string"))
    rows = whole.select(
        "contig", "tile", F.greatest("first", begin).alias("ref_pos"), "pos", "first",
        (F.col("first") + F.shiftright("small", 9)).alias("last"),
        (F.col("small") % 2 == 1).alias("reverse"),
        F.shiftright("small", 1).bitwiseAND(F.lit(255)).alias("mark"),
        F.coalesce(F.transform("ops", word), F.array().cast("array<bigint>")).alias("ops"),
        F.coalesce("seq", F.lit("")).alias("seq"),
        F.coalesce("qual", F.array()).alias("qual"),
        F.when(F.col("nth") == 1, ref).alias("ref"),
    )
    return rows.mapInArrow(lines.of_reads(TILE, start, end), lines.SCHEMA)


def with_modifications(cols: DataFrame, found: DataFrame) -> DataFrame:
    """Pileup rows (with read_id and qpos) with mods: array<struct<mod, prob>> of the calls at the base, by code; empty without any."""
    calls = found.groupBy("read_id", "qpos").agg(F.array_sort(F.collect_list(F.struct("mod", "prob"))).alias("mods"))
    joined = cols.join(calls, ["read_id", "qpos"], "left")
    return joined.withColumn("mods", F.coalesce("mods", F.array().cast("array<struct<mod:string,prob:int>>"))).select(*cols.columns, "mods")


def span_of(reads: DataFrame) -> DataFrame:
    """(contig, first, last, positions): the range of columns of each contig, and how many there may be."""
    mapped = reads.where(~scalars.has(F.col("flag"), scalars.UNMAPPED))
    by = mapped.groupBy("contig").agg(F.min("pos").alias("first"), F.max(cigar.end_position(F.col("pos"), F.col("ops"))).alias("last"))
    return by.select("contig", "first", "last", (F.col("last") - F.col("first") + 1).alias("positions"))
