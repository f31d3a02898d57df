"""Base modifications: MM/ML tags to calls at query and reference positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar, scalars


_FORM = r"^([ACGTacgt])([+-])([A-Za-z]+|[0-9]+)([.?]?)((?:,[0-9]+)*)$"


def _wrong(entry: Column) -> Column:
    """What is wrong with an MM entry; null if nothing."""
    large = F.exists(F.regexp_extract_all(entry, F.lit("([0-9]+)"), F.lit(1)), lambda n: F.coalesce(n.try_cast("long") > 0xFFFFFFFF, F.lit(True)))
    return (
        F.when(entry.rlike(_FORM) & ~large, None)
        .when(entry.rlike("^[Nn]"), "unsupported base N")
        .when(~entry.rlike("^[ACGTacgt]"), "bad base")
        .when(~entry.rlike("^.[+-]"), "bad strand")
        .when(~entry.rlike("^..([A-Za-z]+|[0-9]+)([.?,]|$)"), "bad modification code")
        .otherwise("bad delta or number")
    )


def entries(mm: Column) -> Column:
    """array<struct<base, strand, codes, mode, deltas>> of an MM text.

    Each entry ends with a semicolon.  Codes are letters or one number; mode is `.`,
    `?` or empty.  A malformed entry raises an error that says what is wrong.
    """
    open_ended = (mm != "") & ~mm.endswith(";")
    whole = F.when(open_ended, F.raise_error(F.concat(F.lit("bad MM text, no final semicolon: "), mm)).cast("string")).otherwise(mm)
    parts = F.when(mm == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(whole, ";$", ""), ";"))

    def one(x: Column) -> Column:
        text = F.when(_wrong(x).isNull(), x).otherwise(F.raise_error(F.concat(F.lit("bad MM entry, "), _wrong(x), F.lit(": "), x)))
        g = lambda n: F.regexp_extract(text, _FORM, n)
        codes = F.when(g(3).rlike("^[0-9]+$"), F.array(scalars.chebi_code(g(3).cast("long")))).otherwise(F.split(g(3), ""))
        deltas = F.transform(F.filter(F.split(g(5), ","), lambda d: d != ""), lambda d: d.cast("long"))
        return F.struct(F.upper(g(1)).alias("base"), g(2).alias("strand"), codes.alias("codes"), g(4).alias("mode"), deltas.alias("deltas"))

    return F.transform(parts, one)


def parse(mm: str) -> list[tuple[str, str, list[str], str, list[int]]]:
    """entries() of one text in Python, with the same errors."""
    if mm and not mm.endswith(";"):
        raise ValueError(f"bad MM text, no final semicolon: {mm}")
    out = []
    for x in mm[:-1].split(";") if mm else ():
        found = re.fullmatch(_FORM[1:-1], x)
        if not found or any(int(n) > 0xFFFFFFFF for n in re.findall("[0-9]+", x)):
            checks = (
                ("unsupported base N", re.match("[Nn]", x)),
                ("bad base", not re.match("[ACGTacgt]", x)),
                ("bad strand", not re.match(".[+-]", x)),
                ("bad modification code", not re.match("..([A-Za-z]+|[0-9]+)([.?,]|$)", x)),
            )
            raise ValueError(f"bad MM entry, {next((why for why, wrong in checks if wrong), 'bad delta or number')}: {x}")
        base, strand, codes, mode, deltas = found.groups()
        listed = [{27551: "m", 76792: "h"}.get(int(codes), "?")] if codes.isdigit() else list(codes)
        out.append((base.upper(), strand, listed, mode, [int(d) for d in deltas.split(",") if d]))
    return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(before - starts, sizes)


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of a list's or a text's values; a null has size 0."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    sizes = np.diff(ends)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return ends[:-1], sizes


def _found(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The calls of a batch's reads in order of reads: row, qpos, prob, rpos (-1 if not aligned) as numbers, the others as texts."""
    of = {c: batch.column(batch.schema.get_field_index(c)) for c in ("seq", "ml", "reverse", "mm", "ops", "pos")}
    coded = of["mm"].dictionary_encode()
    listed, sizes, total = [], [], []
    for mm in coded.dictionary.to_pylist():
        at, n = 0, len(listed)
        for base, strand, codes, _, deltas in parse(mm):
            nth = -1
            for d in deltas:
                nth += d + 1
                for code in codes:
                    listed.append((base, strand, code, nth, at))
                    at += 1
        sizes.append(len(listed) - n)
        total.append(at)
    kind = np.asarray(coded.indices.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    has = coded.indices.is_valid().to_numpy(zero_copy_only=False)
    ml_at, ml_size = _offsets(of["ml"])
    wanted = np.append(np.array(total, np.int64), 0)
    if (has & (wanted[kind] != ml_size)).any():
        raise ValueError("MM and ML differ in length")
    n = np.append(np.array(sizes, np.int64), 0)
    own = np.where(has, n[kind], 0)
    place = _ragged((np.cumsum(n) - n)[kind], own)
    row = np.repeat(np.arange(len(own)), own)
    base, strand, code = (np.array([x[i] for x in listed], object)[place] for i in range(3))
    nth, at = (np.array([x[i] for x in listed], np.int64)[place] for i in (3, 4))
    prob = np.asarray(of["ml"].values.fill_null(-1).to_numpy(zero_copy_only=False))[ml_at[row] + at] if len(row) else np.zeros(0, np.int64)
    # occurrences of each base in the texts of all reads
    seq_at, seq_size = _offsets(of["seq"])
    letters = np.frombuffer(of["seq"].buffers()[2] or b"", np.uint8)
    back = np.asarray(of["reverse"].fill_null(False).to_numpy(zero_copy_only=False), bool)[row]
    qpos = np.full(len(row), -1, np.int64)
    for letter, other in ("AT", "CG", "GC", "TA"):
        some = np.flatnonzero(np.where(back, base == other, base == letter))
        places = np.flatnonzero(letters == ord(letter))
        r = row[some]
        first, last = np.searchsorted(places, seq_at[r]), np.searchsorted(places, seq_at[r] + seq_size[r])
        which = np.where(back[some], last - 1 - nth[some], first + nth[some])
        inside = (which >= first) & (which < last)
        qpos[some[inside]] = places[which[inside]] - seq_at[r[inside]]
    kept = qpos >= 0
    out = {"row": row, "qpos": qpos, "mod": code, "prob": prob, "base": base, "strand": strand}
    out = {k: v[kept] for k, v in out.items()}
    out["rpos"] = _aligned(of["ops"], of["pos"], out["row"], out["qpos"])
    return out


def _aligned(ops: pa.Array, pos: pa.Array, row: np.ndarray, qpos: np.ndarray) -> np.ndarray:
    """Reference places of query places of rows; -1 where an insertion or clip lies, or no op."""
    at, size = _offsets(ops)
    if not len(ops.values):
        return np.full(len(row), -1, np.int64)
    lens, kinds = (ops.values.field(i) for i in range(2))
    lens, kinds = lens.to_numpy(zero_copy_only=False).astype(np.int64), kinds.to_numpy(zero_copy_only=False).astype(str)
    query = np.append(0, np.cumsum(np.where(np.isin(kinds, cigar.QUERY_OPS), lens, 0)))
    ref = np.append(0, np.cumsum(np.where(np.isin(kinds, cigar.REF_OPS), lens, 0)))
    target = query[at[row]] + qpos
    op = np.searchsorted(query[1:], target, "right")
    inside = (op < at[row] + size[row]) & (op >= at[row])
    op = np.where(inside, op, 0)
    inside &= np.isin(kinds[op], cigar.BASE_OPS) & (target >= query[op])
    starts = pos.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
    return np.where(inside, starts + ref[op] - ref[at[row]] + target - query[op], -1)


_CALL = "qpos int, mod string, prob int, base string, strand string, rpos long"


def _columns(found: dict[str, np.ndarray]) -> list[pa.Array]:
    types = {"qpos": pa.int32(), "prob": pa.int32(), "rpos": pa.int64()}
    made = [pa.array(found[c], types.get(c, pa.string())) for c in ("qpos", "mod", "prob", "base", "strand", "rpos")]
    return [pa.array(found["rpos"], pa.int64(), mask=found["rpos"] < 0) if i == 5 else x for i, x in enumerate(made)]


def _input(reads: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The carried columns and what _found() reads; without a CIGAR no base is aligned."""
    have = set(reads.columns)
    ops = F.col("ops") if "ops" in have else F.array().cast(cigar.OPS)
    pos = F.col("pos") if "pos" in have else F.lit(0)
    return reads.select(
        *carry,
        F.col("seq").alias("_seq"),
        F.col("ml").cast("array<int>").alias("_ml"),
        scalars.has(F.col("flag"), scalars.REVERSE).alias("_reverse"),
        F.col("mm").alias("_mm"),
        ops.alias("_ops"),
        pos.cast("long").alias("_pos"),
    )


def _own(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The columns of _found(), under its names."""
    return pa.RecordBatch.from_arrays(batch.columns[-6:], ["seq", "ml", "reverse", "mm", "ops", "pos"])


def placed_calls(reads: DataFrame, carry: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """(carried columns, qpos, mod, prob, base, strand, rpos): calls() with their place on the reference, null in insertions and clips.

    All follows within the read's row, so nothing is shuffled.
    """
    n = len(carry)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = _found(_own(batch))
            row = pa.array(some["row"])
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns[:n]), *_columns(some)], [*carry, *names])

    names = [x.split()[0] for x in _CALL.split(", ")]
    kept = reads.where("mm is not null").select(*carry).schema
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return _input(reads.where("mm is not null"), carry).mapInArrow(found, f"{types}, {_CALL}")


def with_calls(reads: DataFrame, carry: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """(carried columns, calls, dotted): a row for each read, its calls as a list, and the bases that entries of `.` mode cover.

    Reads without MM have no calls and no such bases.
    """
    n = len(carry)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _own(batch)
            some = _found(own)
            ends = np.append(0, np.cumsum(np.bincount(some["row"], minlength=batch.num_rows)))
            calls = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(_columns(some), names))
            coded = own.column(3).dictionary_encode()
            dotted = pa.array(["".join(sorted({e[0] for e in parse(mm) if e[3] == "."})) for mm in coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], calls, dotted.take(coded.indices).fill_null("")], [*carry, "calls", "dotted"])

    names = [x.split()[0] for x in _CALL.split(", ")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.select(*carry).schema)
    listed = _CALL.replace(" ", ":").replace(",:", ",")
    return _input(reads, carry).mapInArrow(found, f"{types}, calls array<struct<{listed}>>, dotted string")


def calls(reads: DataFrame) -> DataFrame:
    """(read_id, qpos, mod, prob, base, strand) of reads(read_id, seq, flag, mm, ml).

    Deltas skip occurrences of the base in the original orientation: on reverse
    reads complements are counted from the end.  ml holds one probability for
    each delta and code; a different number raises an error.  Deltas beyond the
    last such base have no call, and reads without MM have none; without deltas
    there need be no ml.
    """
    own = reads.select("read_id", "seq", "flag", "mm", "ml")
    return placed_calls(own).select("read_id", "qpos", "mod", "prob", "base", "strand")


def at_reference(found: DataFrame, reads: DataFrame) -> DataFrame:
    """Calls with contig and rpos, through the CIGAR; those in insertions or clips are left out."""
    ops = F.filter(cigar.placed(F.col("pos"), F.col("ops")), lambda o: o["op"].isin(*cigar.BASE_OPS))
    joined = found.join(reads.select("read_id", "contig", ops.alias("o")), "read_id")
    inside = F.filter("o", lambda o: (o["qs"] <= F.col("qpos")) & (F.col("qpos") < o["qs"] + o["len"]))
    here = F.get(inside, F.lit(0))
    return joined.where(F.size(inside) > 0).withColumn("rpos", here["rs"] + F.col("qpos") - here["qs"]).drop("o")


def frequencies(placed: DataFrame, least: int = 128) -> DataFrame:
    """(contig, rpos, mod, modified, unmodified, frequency): calls of at least this probability are modified."""
    hit = F.col("prob") >= least
    n = F.count_if(hit)
    return placed.groupBy("contig", "rpos", "mod").agg(n.alias("modified"), F.count_if(~hit).alias("unmodified"), (n / F.count(F.lit(1))).alias("frequency"))


def is_unmodified(found: Column, entries_: Column, qpos: Column, base: Column) -> Column:
    """False if qpos has a call, true if an entry of `.` mode covers the base, else null."""
    called = F.exists(found, lambda c: c["qpos"] == qpos)
    implied = F.exists(entries_, lambda e: (e["base"] == base) & (e["mode"] == "."))
    return F.when(called, False).when(implied, True)
