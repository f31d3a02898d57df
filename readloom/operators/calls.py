"""Variant calls, alleles and per-column summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import scalars
from readloom.operators import pileup

DROPPED = scalars.UNMAPPED | scalars.SECONDARY | scalars.SUPPLEMENTARY | scalars.QC_FAIL | scalars.DUPLICATE


def usable(flag: Column, mapq: Column, least: int = 20) -> Column:
    return (flag.bitwiseAND(F.lit(DROPPED)) == 0) & (mapq >= least)


def snv_calls(counts: DataFrame, min_depth: int = 5, min_af: float = 0.1, hom_af: float = 0.8) -> DataFrame:
    """(contig, pos, ref_base, alt, depth, alt_count, af, gt) of columns with counts and ref_base that pass."""
    alt = pileup.best_alt(F.col("ref_base"))
    depth = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    called = counts.withColumns({"best": alt, "depth": depth}).where(F.col("best").isNotNull() & (F.col("depth") >= min_depth))
    af = F.col("best.n") / F.col("depth")
    return called.where(af >= min_af).select(
        "contig", "pos", "ref_base", F.col("best.base").alias("alt"), "depth", F.col("best.n").alias("alt_count"), af.alias("af"),
        F.when(af >= hom_af, "1/1").otherwise("0/1").alias("gt"),
    )


def column_extras(cols: DataFrame, group: Column, fraction: Column) -> DataFrame:
    """(contig, pos, groups, mean_fraction): group counts, most frequent first, and the mean of a per-read value."""
    by = cols.groupBy("contig", "pos", group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(fraction).alias("s"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "g")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["g"], F.lit(":"), (-x["k"]).cast("string"))), ",")
    return by.groupBy("contig", "pos").agg(text.alias("groups"), (F.sum("s") / F.sum("n")).alias("mean_fraction"))


def allele_kind(ref: Column, alt: Column) -> Column:
    """snv, insertion, deletion, complex or reference; null for invalid combinations."""
    a, b = F.length(ref), F.length(alt)
    anchored = F.substring(ref, 1, 1) == F.substring(alt, 1, 1)
    return (
        F.when(alt.isNull() | (alt == "."), "reference")
        .when((a == 0) | (b == 0) | (ref == alt), F.lit(None))
        .when((a == 1) & (b == 1), "snv")
        .when((a == 1) & anchored, "insertion")
        .when((b == 1) & anchored, "deletion")
        .otherwise("complex")
    )


ALLELES = "struct<ref:string,alts:array<string>>"


def _alleles(valid: Column, ref: Column, alts: Column) -> Column:
    """Null where the combination isn't valid."""
    return F.when(valid, F.struct(ref.alias("ref"), alts.cast("array<string>").alias("alts")))


def reference_allele(base: Column) -> Column:
    return _alleles(F.length(base) == 1, base, F.array())


def snv(base: Column, alts: Column) -> Column:
    """One or more other bases, none repeated."""
    fine = (F.length(base) == 1) & (F.size(alts) > 0) & (F.size(F.array_distinct(alts)) == F.size(alts)) & F.forall(alts, lambda a: (F.length(a) == 1) & (a != base))
    return _alleles(fine, base, alts)


def insertion(anchor: Column, inserted: Column) -> Column:
    return _alleles((F.length(anchor) == 1) & (F.length(inserted) > 0), anchor, F.array(F.concat(anchor, inserted)))


def deletion(anchor: Column, deleted: Column) -> Column:
    return _alleles((F.length(anchor) == 1) & (F.length(deleted) > 0), F.concat(anchor, deleted), F.array(anchor))


def complex_alleles(ref: Column, alts: Column) -> Column:
    return _alleles(F.length(ref) > 0, ref, alts)


def reference_span(alleles: Column) -> Column:
    """Reference bases of a record."""
    return F.length(alleles["ref"])


def n_alleles(alleles: Column) -> Column:
    return F.size(alleles["alts"]) + 1


# Values of INFO and FORMAT fields as text; null where there is no field.


def int_value(x: Column) -> Column:
    return x.cast("int").cast("string")


def float_value(x: Column) -> Column:
    return F.when(x.isNotNull(), scalars.float_text(x))


def list_value(values: Column, of: Callable[[Column], Column] = int_value) -> Column:
    """Values with commas between them, missing ones as dots."""
    return F.array_join(F.transform(values, lambda x: F.coalesce(of(x), F.lit("."))), ",")


def string_value(x: Column) -> Column:
    return scalars.percent_encode(x)


def flag_value(x: Column) -> Column:
    """An INFO field without a value, where x is true."""
    return F.when(x, F.lit(""))


def info_text(fields: list[tuple[str, Column]]) -> Column:
    """`key=value` texts with semicolons between them, `.` without any; of equal keys the last that has a value counts."""
    shown = []
    for n, (key, value) in enumerate(fields):
        text = F.when(value == "", F.lit(key)).otherwise(F.concat(F.lit(key + "="), value))
        for _, later in (x for x in fields[n + 1 :] if x[0] == key):
            text = F.when(later.isNull(), text)
        shown.append(text)
    joined = F.concat_ws(";", *shown) if shown else F.lit("")
    return F.when(joined == "", ".").otherwise(joined)


def filter_text(failed: Column | None) -> Column:
    """`PASS` for an empty array of filters, their names for others, `.` for null or without filters applied."""
    if failed is None:
        return F.lit(".")
    return F.when(failed.isNull(), ".").when(F.size(failed) == 0, "PASS").otherwise(F.array_join(failed, ";"))


def genotypes(samples: Column) -> Column:
    """Texts of array<struct<alleles:array<int>,phased:array<boolean>>>, one a sample; differing ploidies raise an error."""
    ploidy = lambda s: F.size(s["alleles"])
    same = F.forall(samples, lambda s: ploidy(s) == ploidy(F.get(samples, F.lit(0))))
    fine = F.when(same, samples).otherwise(F.raise_error(F.lit("samples differ in ploidy")).cast("array<struct<alleles:array<int>,phased:array<boolean>>>"))
    return F.transform(fine, lambda s: genotype_text(s["alleles"], s["phased"]))


def record_line(
    contig: Column, pos1: Column, alleles: Column, qual: Column | None = None, filters: Column | None = None, info: list[tuple[str, Column]] = (),
    formats: list[tuple[str, Column]] = (), n_samples: int = 0,
) -> Column:
    """A VCF body line.

    formats holds a key and an array of texts, one for each sample; GT comes first.
    Invalid alleles, fields without samples or of another number raise an error.
    """
    if formats and not n_samples:
        raise ValueError("FORMAT fields without samples")
    if "GT" in (keys := [k for k, _ in formats]) and keys[0] != "GT":
        raise ValueError("GT must be the first FORMAT field")
    fine = F.when(alleles.isNotNull(), contig).otherwise(F.raise_error(F.lit("invalid alleles")).cast("string"))
    alts = F.when(F.size(alleles["alts"]) == 0, ".").otherwise(F.array_join(alleles["alts"], ","))
    quality = F.coalesce(float_value(qual), F.lit(".")) if qual is not None else F.lit(".")
    parts = [fine, pos1.cast("string"), F.lit("."), alleles["ref"], alts, quality, filter_text(filters), info_text(list(info))]
    if formats:
        parts.append(F.lit(":".join(keys)))
        wrong = F.raise_error(F.lit("the number of samples differs from the header's")).cast("array<string>")
        values = [F.when(F.size(v) == n_samples, v).otherwise(wrong) for _, v in formats]
        parts += [F.concat_ws(":", *(F.coalesce(F.get(v, F.lit(i)), F.lit(".")) for v in values)) for i in range(n_samples)]
    return F.concat_ws("\t", *parts)


def vcf_line(calls: DataFrame) -> DataFrame:
    """(contig, pos1, line): a VCF body line of each call, with DP and AF in INFO and GT."""
    pos1 = F.col("pos") + 1
    alleles = snv(F.col("ref_base"), F.array("alt"))
    info = [("DP", int_value(F.col("depth"))), ("AF", float_value(F.col("af")))]
    line = record_line(F.col("contig"), pos1, alleles, filters=F.array().cast("array<string>"), info=info, formats=[("GT", F.array("gt"))], n_samples=1)
    return calls.select("contig", pos1.alias("pos1"), line.alias("line"))


def genotype_text(alleles: Column, phased: Column) -> Column:
    """`0/1`, `0|1`, `./.`; phased has an entry for each separator."""
    shown = F.transform(alleles, lambda a: F.coalesce(a.cast("string"), F.lit(".")))
    marks = F.transform(F.slice(alleles, 2, F.greatest(F.size(alleles) - 1, F.lit(0))), lambda _, i: F.when(F.coalesce(F.get(phased, i), F.lit(False)), "|").otherwise("/"))
    rest = F.zip_with(F.slice(shown, F.lit(2), F.greatest(F.size(shown) - 1, F.lit(0))), marks, lambda a, m: F.concat(m, a))
    return F.concat(F.element_at(shown, 1), F.array_join(rest, ""))
