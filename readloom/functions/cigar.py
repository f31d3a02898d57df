"""CIGAR arrays: array<struct<len int, op string>> expressions that stay within a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REF_OPS, QUERY_OPS, BASE_OPS = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X"), ("M", "=", "X")
CODES = "MIDNSHP=X"
OPS = "array<struct<len:int,op:string>>"


def parse(text: Column) -> Column:
    """`10M2I` as an array; `*` and null as an empty one.  Other letters raise an error."""
    bad = ~text.rlike(r"^(\*|([0-9]+[MIDNSHP=X])+)$")
    lens = F.regexp_extract_all(text, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    made = F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("int").alias("len"), o.alias("op")))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad CIGAR "), text)).cast(OPS)).otherwise(made)
    return F.coalesce(checked, F.array().cast(OPS))


def render(ops: Column) -> Column:
    """Text of an array; `*` if it is empty."""
    text = F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return F.when(F.size(ops) == 0, "*").otherwise(text)


def total(ops: Column, kinds: tuple[str, ...]) -> Column:
    """Summed length of the ops of these kinds."""
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def query_length(ops: Column) -> Column:
    return total(ops, QUERY_OPS)


def reference_length(ops: Column) -> Column:
    return total(ops, REF_OPS)


def end_position(pos: Column, ops: Column) -> Column:
    """0-based inclusive end; pos itself if no reference base is consumed."""
    return pos + F.greatest(reference_length(ops) - 1, F.lit(0))


#: Ops that placed() handles at a time; lists are copied as they grow, so this bounds the work an op.
_CHUNK = 128
_PLACED = "array<struct<i:int,op:string,len:int,rs:bigint,qs:int,ins_after:int>>"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once, also where f uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def placed(pos: Column, ops: Column) -> Column:
    """Each op with its index, where it starts on the reference (rs) and the query (qs), and the bases inserted right after it.

    Zero lengths are dropped.  Insertions are looked for beyond pads, up to any
    other op.  One pass from the last op to the first, so the work grows in
    proportion to the ops.
    """
    number = lambda x: x.cast("int")
    step_by = lambda o, kinds: F.when(o["op"].isin(*kinds), o["len"]).otherwise(0)

    def state(i: Column, r: Column, q: Column, t: Column, some: Column, done: Column) -> Column:
        return F.struct(
            number(i).alias("i"), r.cast("bigint").alias("r"), number(q).alias("q"), number(t).alias("t"), some.cast(_PLACED).alias("some"), done.cast(f"array<{_PLACED}>").alias("done")
        )

    def one(a: Column, o: Column) -> Column:
        r, q = a["r"] - step_by(o, REF_OPS), a["q"] - step_by(o, QUERY_OPS)
        here = F.struct(
            (a["i"] - 1).alias("i"), o["op"].alias("op"), o["len"].alias("len"), r.alias("rs"), number(q).alias("qs"), a["t"].alias("ins_after")
        )
        some = F.when(o["len"] > 0, F.concat(a["some"], F.array(here).cast(_PLACED))).otherwise(a["some"])
        t = F.when(o["op"] == "I", a["t"] + o["len"]).when(o["op"] == "P", a["t"]).otherwise(0)
        return state(a["i"] - 1, r, q, t, some, a["done"])

    none = F.array().cast(_PLACED)

    def chunk(a: Column, some: Column) -> Column:
        begin = state(a["i"], a["r"], a["q"], a["t"], none, a["done"])
        return F.aggregate(some, begin, one, lambda b: state(b["i"], b["r"], b["q"], b["t"], none, F.concat(b["done"], F.array(b["some"]))))

    def walk(back: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(back) - 1, F.lit(0)), F.lit(_CHUNK))
        chunks = F.transform(starts, lambda at: F.slice(back, at + 1, F.lit(_CHUNK)))
        first = state(F.size(back), pos + reference_length(ops), query_length(ops), F.lit(0), none, F.array().cast(f"array<{_PLACED}>"))
        return F.aggregate(chunks, first, chunk, lambda a: F.reverse(F.flatten(a["done"])))

    return bind(F.reverse(ops), walk)


def is_linear(ops: Column) -> Column:
    """Only aligned bases, at most clipped at the ends."""
    return render(ops).rlike(r"^(\d+[SH])*(\d+[M=X])+(\d+[SH])*$")


def trim_trailing(ops: Column) -> Column:
    """ops without deletions and skips that no query base follows."""
    keep = F.aggregate(
        F.transform(ops, lambda o, i: F.when(o["op"].isin("M", "I", "S", "=", "X"), i + 1).otherwise(0)),
        F.lit(0),
        lambda a, x: F.greatest(a, x),
    )
    return F.filter(ops, lambda o, i: (i < keep) | ~o["op"].isin("D", "N"))


def clip_start(ops: Column, bases: int) -> Column:
    """The first `bases` aligned bases of a leading M as soft clip; unchanged if it has no more than these."""
    first = F.get(ops, F.lit(0))
    fits = F.coalesce((first["op"] == "M") & (first["len"] > bases), F.lit(False))
    as_op = lambda n, op: F.struct(n.cast("int").alias("len"), F.lit(op).alias("op"))
    made = F.concat(
        F.array(as_op(F.lit(bases), "S"), as_op(first["len"] - bases, "M")),
        F.slice(ops, F.lit(2), F.greatest(F.size(ops) - 1, F.lit(0))),
    )
    return F.when(fits, made).otherwise(ops)


def codes(ops: Column) -> Column:
    """Packed 32-bit words len << 4 | code; reserved ops are named by their code (`9` to `15`)."""
    code = lambda o: F.when(o.rlike("^[0-9]+$"), o.try_cast("long")).otherwise(F.call_function("instr", F.lit(CODES), o) - 1)
    return F.transform(ops, lambda o: F.shiftleft(o["len"].cast("long"), 4) + code(o["op"]).cast("long"))


def from_codes(words: Column) -> Column:
    code = lambda w: w.bitwiseAND(F.lit(15)).cast("int")
    name = lambda w: F.when(code(w) < len(CODES), F.substring(F.lit(CODES), code(w) + 1, F.lit(1))).otherwise(code(w).cast("string"))
    return F.transform(words, lambda w: F.struct(F.shiftrightunsigned(w, 4).cast("int").alias("len"), name(w).alias("op")))


def exclusive_end(pos: Column, ops: Column) -> Column:
    """0-based end after the last reference base; pos itself if no reference base is consumed."""
    return pos + reference_length(ops)


def events(ops: Column, kinds: tuple[str, ...]) -> Column:
    """Number of walk events of these ops: one a base of M, = and X, one an op of the others; zero lengths have none."""
    one = lambda o: F.when(~o["op"].isin(*kinds), 0).when(o["op"].isin(*BASE_OPS), o["len"]).otherwise((o["len"] > 0).cast("int"))
    return F.aggregate(ops, F.lit(0), lambda a, o: a + one(o))
