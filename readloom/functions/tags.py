"""Optional fields of alignments: `XX:T:V` texts as a map of typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Type of a record's tags.
KIND = "map<string,struct<type:string,value:string>>"


def parse(fields: Column) -> Column:
    """map<tag, struct<type, value>> of an array of tag texts; the first of equal tags counts, malformed ones are skipped."""
    ok = F.filter(fields, lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9]:[AifZHBcCsSIdZ]:"))

    def more(m: Column, x: Column) -> Column:
        tag = F.substring(x, 1, 2)
        value = F.struct(F.substring(x, 4, 1).alias("type"), F.call_function("substring", x, F.lit(6)).alias("value"))
        return F.when(F.map_contains_key(m, tag), m).otherwise(F.map_concat(m, F.create_map(tag, value)))

    return F.aggregate(ok, F.create_map().cast(KIND), more)


def get_int(tags: Column, tag: str) -> Column:
    """The integer value of a tag, null if it is missing or no integer."""
    x = F.try_element_at(tags, F.lit(tag))
    return F.when(x["type"].isin(*"iIcCsS"), x["value"].try_cast("long"))


def get_float(tags: Column, tag: str) -> Column:
    x = F.try_element_at(tags, F.lit(tag))
    return F.when(x["type"].isin(*"iIcCsSfd"), x["value"].try_cast("double"))


def get_text(tags: Column, tag: str) -> Column:
    x = F.try_element_at(tags, F.lit(tag))
    return F.when(x["type"].isin("Z", "A", "H"), x["value"])


def get_bytes(tags: Column, tag: str) -> Column:
    """The bytes of an H tag; null for odd lengths or other digits."""
    x = F.try_element_at(tags, F.lit(tag))
    return F.when((x["type"] == "H") & x["value"].rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(x["value"]))


def get_array(tags: Column, tag: str) -> Column:
    """The numbers of a B tag as doubles."""
    x = F.try_element_at(tags, F.lit(tag))
    parts = F.split(x["value"], ",")
    return F.when(x["type"] == "B", F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda v: v.try_cast("double")))


def put(tags: Column, tag: str, kind: str, value: Column) -> Column:
    """The map with the tag set, or replaced."""
    return F.map_concat(remove(tags, tag), F.create_map(F.lit(tag), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))


#: Ranges of the integer kinds of B arrays.
_RANGES = {"c": (-(2**7), 2**7), "C": (0, 2**8), "s": (-(2**15), 2**15), "S": (0, 2**16), "i": (-(2**31), 2**31), "I": (0, 2**32)}


def put_array(tags: Column, tag: str, kind: str, values: Column, strict: bool = True) -> Column:
    """The map with a B tag of this element kind (c C s S i I f); an element out of its range raises an error.

    Without strict it is kept as text, which SAM can show and BAM can't hold.
    """
    if kind == "f":
        text = F.transform(values.cast("array<float>"), lambda v: v.cast("string"))
    elif not strict:
        text = values.cast("array<bigint>").cast("array<string>")
    else:
        low, high = _RANGES[kind]
        bad = F.lit(f"{tag}: an element is out of the range of {kind}")
        text = F.transform(values.cast("array<bigint>"), lambda v: F.when((v >= low) & (v < high), v.cast("string")).otherwise(F.raise_error(bad).cast("string")))
    return put(tags, tag, "B", F.array_join(F.concat(F.array(F.lit(kind)), text), ","))


def put_char(tags: Column, tag: str, value: Column) -> Column:
    """The map with an A tag: one visible ASCII character, else an error."""
    fine = F.when(value.rlike("^[!-~]$"), value).otherwise(F.raise_error(F.lit(f"{tag}: not a visible character")).cast("string"))
    return put(tags, tag, "A", fine)


def remove(tags: Column, tag: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != tag)


def render(tags: Column) -> Column:
    """Sorted tag texts."""
    return F.sort_array(F.transform(F.map_entries(tags), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])))


def int_width(x: Column, unsigned_first: bool) -> Column:
    """The smallest integer type letter that holds x; unsigned or signed types are tried first."""
    u = [("C", 0, 2**8), ("S", 0, 2**16), ("I", 0, 2**32)]
    s = [("c", -(2**7), 2**7), ("s", -(2**15), 2**15), ("i", -(2**31), 2**31)]
    order = [k for pair in (zip(u, s) if unsigned_first else zip(s, u)) for k in pair]
    out = F.lit(None).cast("string")
    for name, low, high in reversed(order):
        out = F.when((x >= low) & (x < high), name).otherwise(out)
    return out
