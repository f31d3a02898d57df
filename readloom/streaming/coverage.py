"""Coverage of alignments that arrive as a stream, with the batch operators' expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar


def binned_coverage(reads: DataFrame, width: int = 1000, arrived: str | None = None, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(contig, bin, reads, bases) of a batch or streaming frame.

    The state is a row for each covered bin.  With a column of arrival times, rows
    are kept for each window of it and dropped once they are late.
    """
    spans = F.filter(cigar.placed(F.col("pos"), F.col("ops")), lambda o: o["op"].isin(*cigar.BASE_OPS))
    if arrived:
        reads = reads.withWatermark(arrived, late)
    time = [F.col(arrived)] if arrived else []
    each = reads.select("contig", *time, F.explode(spans).alias("o")).select("contig", *time, F.col("o.rs").alias("a"), (F.col("o.rs") + F.col("o.len")).alias("z"))
    bins = F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("z") - 1) / width)))
    cut = each.select("contig", *time, "a", "z", bins.alias("bin"))
    inside = F.least("z", (F.col("bin") + 1) * width) - F.greatest("a", F.col("bin") * width)
    by = [F.window(arrived, window).alias("window")] if arrived else []
    return cut.groupBy(*by, "contig", "bin").agg(F.count(F.lit(1)).alias("segments"), F.sum(inside).cast("long").alias("bases"))
