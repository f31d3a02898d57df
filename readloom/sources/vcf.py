"""Variant text: a header builder and a sorted text sink."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.sources import sam

TYPES = ("Integer", "Float", "Flag", "Character", "String")


@dataclass
class Header:
    """Contigs, then filters, INFO and FORMAT fields, then samples; names must be new within their kind."""

    contigs: dict[str, int | None] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)
    infos: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    formats: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)

    @staticmethod
    def of_alignments(lines: list[str]) -> Header:
        """A header with the contigs of an alignment header's @SQ lines."""
        out = Header()
        for _, name, length in sam.contigs(lines):
            out.contig(name, length)
        return out

    @staticmethod
    def _new(where: dict, name: str, value: object) -> None:
        if name in where:
            raise ValueError(f"repeated: {name}")
        where[name] = value

    def contig(self, name: str, length: int | None = None) -> Header:
        self._new(self.contigs, name, length)
        return self

    def filter(self, name: str, text: str) -> Header:
        if name == "PASS":
            raise ValueError("PASS is always there")
        self._new(self.filters, name, text)
        return self

    def info(self, name: str, number: str, kind: str, text: str) -> Header:
        if kind not in TYPES:
            raise ValueError(f"no such type: {kind}")
        self._new(self.infos, name, (number, kind, text))
        return self

    def format(self, name: str, number: str, kind: str, text: str) -> Header:
        if kind not in TYPES or kind == "Flag":
            raise ValueError(f"no such type: {kind}")
        self._new(self.formats, name, (number, kind, text))
        return self

    def sample(self, name: str) -> Header:
        if name in self.samples:
            raise ValueError(f"repeated: {name}")
        self.samples.append(name)
        return self

    def lines(self) -> list[str]:
        quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
        typed = lambda kind, fields: [f"##{kind}=<ID={k},Number={n},Type={t},Description={quoted(d)}>" for k, (n, t, d) in fields.items()]
        columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + (["FORMAT", *self.samples] if self.samples else [])
        return [
            "##fileformat=VCFv4.3",
            '##FILTER=<ID=PASS,Description="All filters passed">',
            *self.other,
            *(f"##FILTER=<ID={k},Description={quoted(v)}>" for k, v in self.filters.items()),
            *typed("INFO", self.infos),
            *typed("FORMAT", self.formats),
            *(f"##contig=<ID={k}" + (f",length={n}" if n else "") + ">" for k, n in self.contigs.items()),
            "\t".join(columns),
        ]


def format_of(path: str) -> str:
    """`vcf`, `vcf.gz` or `bcf` by a path's end; raises ValueError for others."""
    for end, kind in ((".bcf", "bcf"), (".gz", "vcf.gz"), (".vcf", "vcf")):
        if path.endswith(end):
            return kind
    raise ValueError(f"neither .vcf, .vcf.gz nor .bcf: {path}")


def write_as(lines: DataFrame, header: Header, path: str) -> None:
    """Part files of the format that the path's end names."""
    from readloom.sources import bcf

    kind = format_of(path)
    if kind == "vcf":
        write(lines, header, path)
    else:
        bcf.write(lines, header, path, binary=kind == "bcf")


def write(lines: DataFrame, header: Header, path: str, compression: str | None = None) -> None:
    """Writes lines(contig, pos1, line) below the header, in contig order and position.

    The rows are range-partitioned, so the part files, one after another, are one
    sorted file; the first begins with the header.  Lines of contigs that the
    header lacks raise an error.
    """
    spark = lines.sparkSession
    order = F.create_map(*(F.lit(x) for i, c in enumerate(header.contigs) for x in (c, i))) if header.contigs else F.create_map()
    rank = F.try_element_at(order, F.col("contig"))
    known = F.when(rank.isNotNull(), rank).otherwise(F.raise_error(F.concat(F.lit("no contig "), "contig")).cast("int"))
    body = lines.select(known.cast("int").alias("rank"), F.col("pos1").cast("long").alias("pos1"), F.col("line").alias("value"))
    top = spark.createDataFrame([(-1, i, x) for i, x in enumerate(header.lines())], "rank int, pos1 long, value string")
    placed = top.unionByName(body).repartitionByRange("rank", "pos1").sortWithinPartitions("rank", "pos1", "value")
    placed.select("value").write.mode("error").option("compression", compression or "none").text(path)


def read(spark, path: str) -> DataFrame:
    """(contig, pos1, id, ref, alts, qual, filters, info, format, samples); `.` is null or empty."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(f.alias("f"))
    g = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit("."))
    pair = F.transform(F.split(g(7), ";"), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.regexp_extract(x, "=(.*)$", 1)))
    return rows.select(
        g(0).alias("contig"), g(1).cast("long").alias("pos1"), g(2).alias("id"), g(3).alias("ref"),
        F.coalesce(F.split(g(4), ","), F.array().cast("array<string>")).alias("alts"), g(5).cast("double").alias("qual"),
        F.coalesce(F.split(g(6), ";"), F.array().cast("array<string>")).alias("filters"),
        F.when(g(7).isNotNull(), F.map_from_entries(pair)).alias("info"),
        F.split(g(8), ":").alias("format"), F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))).alias("samples"),
    )
