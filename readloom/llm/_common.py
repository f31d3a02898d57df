"""What the operators share: folds, durable intermediate results, checked broadcasts, label samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns is broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text modulo folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the one the session names in spark.checkpoint.dir.  Only a
    local session, whose driver is its one executor, may do without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            root = set_dir.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = tempfile.mkdtemp(prefix="readloom-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows of a few narrow columns that make a fair partition of a small table.
PART_ROWS = 50_000

_kept: list[str] = []


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder.

    rows bounds the number of rows, if that is known: a small table is then
    written in few files rather than in one for each shuffle partition.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark).rpartition("/")[0])
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // PART_ROWS)))
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _kept.append(file.get())
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the durable() tables made within it; what is derived of them must have been written by then."""
    before = len(_kept)
    yield
    while len(_kept) > before:
        remove(spark, _kept.pop())


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df as it is, to be joined by shuffling.

    df should be cheap to count: a durable() result or a small table.  Its rows
    are narrow; see if_light() for others.
    """
    return F.broadcast(df) if len(df.select(F.lit(1)).take(rows + 1)) <= rows else df


#: Bytes up to which a table with long columns is broadcast.
BROADCAST_BYTES = 32 << 20


def if_light(df: DataFrame, size: Column) -> DataFrame:
    """df with a broadcast hint if its rows, of `size` bytes each, take at most BROADCAST_BYTES, else df as it is.

    df should be cheap to read, as for if_small().
    """
    total = df.agg(F.sum(size.cast("long") + 64)).first()[0]
    return F.broadcast(df) if (total or 0) <= BROADCAST_BYTES else df


def labelled_ids(
    labels: DataFrame, label: str, folds: int, held_out: int, rows: int, balanced: bool = False
) -> list[tuple[int, int]]:
    """At most rows (doc_id, label) pairs outside the held-out fold, those of the smallest id hashes.

    With balanced, either label has at most half of them, so that a rare one is
    learnt from more examples.  Null ids and labels other than 0 and 1 are left
    out; of contradicting labels the larger counts.
    """
    key = F.col("doc_id")
    usable = (
        labels.where(key.isNotNull() & F.col(label).isin(0, 1) & (fold(key, folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
    )
    parts = [(usable, rows)] if not balanced else [(usable.where(F.col("label") == y), rows // 2) for y in (0, 1)]
    return [(r.doc_id, r.label) for part, n in parts for r in part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]


#: Texts of up to a label's bytes divided by this are taken in order; longer ones after them, the shortest first.
FAIR_TEXTS = 64


def within(found: list[tuple[int, int, int]], max_bytes: int) -> list[tuple[int, int]]:
    """(doc_id, label) pairs of (doc_id, label, bytes) that fit into max_bytes, which the labels share.

    What a label leaves over goes to the other.  A text that doesn't fit is
    skipped for the next; a label of which none fits is an error.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    for i, y, n in found:
        groups.setdefault(y, []).append((i, n))
    out, left = [], max_bytes
    for k, (y, rows) in enumerate(sorted(groups.items(), key=lambda g: (sum(n for _, n in g[1]), g[0]))):
        share = left // (len(groups) - k)
        fair, before = share // FAIR_TEXTS, len(out)
        for i, n in sorted(rows, key=lambda r: max(r[1], fair)):
            if n <= share:
                share, left = share - n, left - n
                out.append((i, y))
        if len(out) == before:
            raise ValueError(f"none of {len(rows)} sampled texts labelled {y} fits into {max_bytes} bytes, so nothing can be learnt of them")
    return out


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, max_bytes: int, balanced: bool = False
) -> Iterator[tuple[str, int]]:
    """Whole texts with labels for fitting: a sample of at most rows documents and max_bytes bytes.

    The id list is broadcast and has at most rows entries; it reaches Spark as
    an Arrow table, for which no executor starts Python workers.  Sizes are read
    first, so that only the texts that within() chooses reach the driver, which
    orders them by id.  A repeated doc_id counts once, with its longest size.
    """
    ids = labelled_ids(labels, label, folds, held_out, rows, balanced)
    if not ids:
        return
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def of(pairs: list[tuple[int, int]], value: Column) -> DataFrame:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*pairs, strict=True), (pa.int64(), pa.int32()), strict=True)]
        chosen = F.broadcast(spark.createDataFrame(pa.table(columns, ["doc_id", "label"])))
        return texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.max(value).alias("value"))

    size = {r.doc_id: r.value for r in of(ids, F.octet_length("text")).collect()}
    taken = within([(i, y, size[i]) for i, y in ids if i in size], max_bytes)
    if not taken:
        return
    found = [(r.doc_id, r.value, r.label) for r in of(taken, F.col("text")).toLocalIterator()]
    found.sort()  # so that a fit doesn't depend on how the table is dealt out
    yield from ((text, y) for _, text, y in found)
