"""Alignment files of any format, alone or with their reference, behind one interface."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import scalars
from readloom.operators import intervals, pileup, reads
from readloom.sources import bam, bgzf, cram, sam, sequence

_SUFFIX = {"bam": ".bam", "sam.gz": ".sam.gz"}


@dataclass(frozen=True)
class Alignments:
    """An alignment file (or a folder of part files) with its contigs and, if given, a FASTA file."""

    spark: SparkSession
    path: str
    kind: str
    contigs: tuple[tuple[str, int], ...]
    fasta: str | None = None

    def read(self, region: str | None = None, keep_unmapped: bool = False) -> DataFrame:
        """(read_id, qname, flag, contig, pos, mapq, ops, seq, qual, next_contig, next_pos, tlen, aux), of a region by the file's index."""
        keep = {"keep_unmapped": str(keep_unmapped).lower()}
        if self.kind == "sam.gz":
            if region:
                rows = sam.read_region(self.spark, self.path, region, keep_unmapped)
            else:
                files = bam.files_of(self.path, ".sam.gz")
                rows = sam.records(self.spark.read.text(files), keep_unmapped)
        else:
            if region:
                keep["region"] = region
            if self.kind == "bam":
                rows = bam.load(self.spark, self.path, **keep)
            else:
                self.spark.dataSource.register(cram.CramSource)
                rows = self.spark.read.format("cram").options(reference=self.fasta, **keep).load(self.path)
            names = F.array(*(F.lit(n) for n, _ in self.contigs))
            rows = rows.withColumn("next_contig", F.when(F.col("next_tid") >= 0, F.get(names, F.col("next_tid"))))
        columns = ("qname", "flag", "contig", "pos", "mapq", "ops", "seq", "qual", "next_contig", "next_pos", "tlen", "aux")
        return rows.select(F.monotonically_increasing_id().alias("read_id"), *columns)

    def customized(self, region: str | None = None, raw: Column | None = None, compute: dict[str, Column] | None = None, keep: Column | None = None) -> DataFrame:
        """read() with the per-record hooks; raw comparisons of fixed fields can be pushed into the file."""
        return reads.customized(self.read(region), raw, compute, keep)

    def contig_table(self) -> DataFrame:
        """(contig, length) in the order of the header."""
        return self.spark.createDataFrame(list(self.contigs), "contig string, length long")

    def segments(self, target: str | tuple[str, int, int] | None = None, max_len: int = 10_000, overlap: int = 0) -> DataFrame:
        return intervals.segments(self.contig_table(), max_len, overlap, target)

    def reference(self, tile: int = 100_000) -> DataFrame:
        """Tiles of the reference; raises ValueError if a contig of the alignments is missing there or has another length."""
        if self.fasta is None:
            raise ValueError("no reference file was given")
        index = sequence.read_fai(self.spark, self.fasta + ".fai") if os.path.exists(self.fasta + ".fai") else sequence.index_fasta(self.spark, self.fasta)
        lengths = {r.name: r.length for r in index.select("name", "length").toLocalIterator()}
        wrong = [n for n, k in self.contigs if lengths.get(n) != k]
        if wrong:
            raise ValueError(f"the reference doesn't have these contigs at their lengths: {wrong[:5]}")
        return sequence.read_fasta(self.spark, self.fasta, tile)

    def bases(self, contig: str, start: int, stop: int) -> str:
        """Reference bases of a half-open range, letters but A, C, G, T as N."""
        if contig not in dict(self.contigs) or not 0 <= start <= stop <= dict(self.contigs)[contig]:
            raise ValueError(f"{contig}:{start}-{stop} is not within a contig")
        found = sequence.fetch(self.reference(), contig, start, stop).select(scalars.bases(F.col("seq")).alias("seq")).collect()
        return found[0].seq if found else ""

    def pileup(self, region: str | None = None, carry: tuple[str, ...] = pileup.CARRIED, bases: bool = True) -> DataFrame:
        """Pileup rows of a region (or of all contigs) with ref_base, N outside the reference or without one."""
        wanted = scalars.parse_region(region) if region else None
        low = high = None
        if wanted:
            if wanted.contig not in dict(self.contigs):
                raise ValueError(f"no contig {wanted.contig}")
            low, high = wanted.zero_based(dict(self.contigs)[wanted.contig])
        cols = pileup.columns(self.read(region), low, high, carry=carry, bases=bases)
        if self.fasta is None:
            return cols.withColumn("ref_base", F.lit("N"))
        tiles = self.reference()
        if wanted:
            tiles = tiles.where((F.col("contig") == wanted.contig) & (F.col("start") <= high) & (F.col("start") + F.length("seq") > low))
        return pileup.with_reference(cols, sequence.positions(tiles))


def _header(spark: SparkSession, path: str, kind: str, fasta: str | None) -> tuple[tuple[str, int], ...]:
    if kind == "cram":
        r = cram.CramReader({"path": path, "reference": fasta} if fasta else {"path": path})
        return tuple(zip(r.names, r.lengths, strict=True))
    file = bam.files_of(path, _SUFFIX[kind])[0]
    if kind == "bam":
        with open(file, "rb") as f:
            header = bam.Header.read(bgzf.Reader(f))
        sam.check_sorted(header.text.splitlines())
        return tuple(header.contigs)
    return tuple((n, k) for _, n, k in sam.contigs(sam.checked_header(spark, file)))


def open_alignments(spark: SparkSession, path: str, fasta: str | None = None) -> Alignments:
    """Opens a file by its first bytes, or a folder of part files by those of its first part.

    Plain text, other formats and files that are known to be unsorted raise an
    error; CRAM needs a FASTA file with its index.
    """
    first = path
    if os.path.isdir(path):
        parts = sorted(x for x in os.listdir(path) if x.startswith("part-") and x.endswith(tuple(_SUFFIX.values())))
        if not parts:
            raise bgzf.FormatError(f"no alignment files in {path}")
        first = os.path.join(path, parts[0])
    kind = bam.detect(first)
    if kind == "cram" and fasta is None:
        raise ValueError("CRAM needs a reference: give an indexed FASTA file")
    return Alignments(spark, path, kind, _header(spark, path, kind, fasta), fasta)
