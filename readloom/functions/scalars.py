"""Scalar functions on bases, qualities, probabilities, flags, strands and positions, as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
FLAG_NAMES = {
    "paired": PAIRED,
    "proper_pair": PROPER,
    "unmapped": UNMAPPED,
    "mate_unmapped": MATE_UNMAPPED,
    "reverse": REVERSE,
    "mate_reverse": MATE_REVERSE,
    "first_in_template": FIRST,
    "second_in_template": SECOND,
    "secondary": SECONDARY,
    "qc_fail": QC_FAIL,
    "duplicate": DUPLICATE,
    "supplementary": SUPPLEMENTARY,
}
NO_QUALITY = 255


def bases(seq: Column) -> Column:
    """Upper-case A, C, G, T; every other letter becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def base_index(base: Column) -> Column:
    """A 0, C 1, G 2, T 3, else null."""
    return F.when(base == "A", 0).when(base == "C", 1).when(base == "G", 2).when(base == "T", 3)


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def quality(raw: Column) -> Column:
    """A Phred byte, with 255 (unavailable) as null."""
    return F.nullif(raw, F.lit(NO_QUALITY))


def phred(p: Column) -> Column:
    """Infinity for a probability of 0."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(p))


def phred_int(x: Column) -> Column:
    """Not-a-number or at most 0 gives 0, 99 and more gives 99, else rounded."""
    return F.when(F.isnan(x) | (x <= 0), 0).when(x >= 99, 99).otherwise(F.round(x)).cast("int")


def probability(x: Column) -> Column:
    """x if it lies in [0, 1], else null."""
    return F.when((x >= 0) & (x <= 1) & ~F.isnan(x), x)


def root_mean_square(x: Column) -> Column:
    """Aggregate; 0 over no rows."""
    return F.coalesce(F.sqrt(F.avg(x.cast("double") * x)), F.lit(0.0))


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def with_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseOR(F.lit(bits))


def without_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(0xFFF & ~bits))


def strand(flag: Column) -> Column:
    """OT, OB or NA: by own orientation, for second in template by the mate's."""
    own = F.when(has(flag, REVERSE), "OB").otherwise("OT")
    mate = F.when(has(flag, MATE_REVERSE), "OB").otherwise("OT")
    return F.when(~has(flag, PAIRED) | has(flag, FIRST), own).when(has(flag, SECOND), mate).otherwise("NA")


def strand_symbol(label: Column) -> Column:
    return F.when(label == "OT", "+").when(label == "OB", "-").otherwise(".")


@dataclass(frozen=True)
class Region:
    """A 1-based inclusive region; None where open."""

    contig: str
    start: int | None = None
    end: int | None = None

    def zero_based(self, length: int) -> tuple[int, int]:
        """Inclusive 0-based bounds on a contig of this length."""
        start, end = (self.start or 1) - 1, (self.end or length) - 1
        if end >= length or start > end:
            raise ValueError(f"{self} is not within {length} bases")
        return start, end


def parse_region(text: str) -> Region:
    """`chr`, `chr:start` or `chr:start-end`; the name ends at the first colon."""
    found = re.fullmatch(r"([\x21-\x39\x3b-\x7e]+)(?::(\d+)(?:-(\d+))?)?", text)
    if not found:
        raise ValueError(f"not a region: {text!r}")
    start, end = (int(x) if x else None for x in found.groups()[1:])
    if start == 0 or (start is not None and end is not None and start > end):
        raise ValueError(f"empty region: {text!r}")
    return Region(found[1], start, end)


def chebi_code(number: Column) -> Column:
    """Modification letters of ChEBI numbers."""
    return F.when(number == 27551, "m").when(number == 76792, "h").otherwise("?")


def float_text(x: Column) -> Column:
    """A single-precision number with six significant digits, without trailing zeros or exponent; missing as a dot.

    Whole parts are written in full; infinity is `inf`.
    """
    v = x.cast("float").cast("double")
    endless = F.abs(v) == float("inf")
    safe = F.when(F.isnan(v) | endless | (v == 0), F.lit(1.0)).otherwise(v)
    places = F.greatest(F.lit(5) - F.floor(F.log10(F.abs(safe))).cast("int"), F.lit(0))
    fixed = F.replace(F.call_function("format_number", safe, places), F.lit(","), F.lit(""))
    trimmed = F.when(fixed.contains("."), F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")).otherwise(fixed)
    return F.when(v.isNull() | F.isnan(v), ".").when(endless, F.when(v > 0, "inf").otherwise("-inf")).when(v == 0, "0").otherwise(trimmed)


def percent_encode(text: Column) -> Column:
    """The characters that VCF reserves, percent sign first."""
    for c, code in (("%", "%25"), (":", "%3A"), (";", "%3B"), ("=", "%3D"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        text = F.replace(text, F.lit(c), F.lit(code))
    return text
