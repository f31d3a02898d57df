"""Best-fit packing of documents into bins under source and duplicate-cluster conflicts.

A document is as long as its UTF-8 text in bytes, or as a size that comes with it,
such as its tokens.  What exceeds the capacity is cut into full pieces, each a bin
of its own; bytes are cut at the borders of characters.  The remainder is packed,
largest first.  Bins are kept in order of their residual space and carry a bitmap
of the sources and one of the duplicate clusters they hold.  A piece goes to the
tightest bin that has room and neither its source nor its cluster: the search
starts at the smallest sufficient residual and goes on to successors until one
is compatible; else a new bin is opened.

Documents are dealt to shards of about SHARD rows, which are packed independently;
so a task's memory is bounded, sources and clusters spread evenly over shards, and
only each shard's last bins are fuller or emptier than in one global packing.  A
document's shard follows from its id, text and, for copies of one row, their running
number, so the packing doesn't depend on how the table is stored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import _text as T
from readloom.llm._common import durable

CAPACITY, SHARD = 8192, 4096
_BIN = 1 << 32
_NO_ID = (1 << 63) - 1
_KEYS = ("key", "text_hash", "source", "cluster")


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each (size, source bit, cluster bit), in the order given; sizes are 1 to capacity."""
    order: list[int] = []  # residual * 2**32 + bin, ascending; full bins are left out
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        at = bisect_left(order, size * _BIN)
        while at < len(order):
            b = order[at] % _BIN
            if not (sources[b] & source or clusters[b] & cluster):
                break
            at += 1
        if at < len(order):
            residual = order.pop(at) // _BIN
        else:
            b, residual = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        if residual > size:
            insort(order, (residual - size) * _BIN + b)
        out.append(b)
    return out


def byte_pieces(text: np.ndarray, capacity: int) -> list[int]:
    """Sizes of the pieces of UTF-8 bytes: as long as they may be without a cut inside a character."""
    out, at = [], 0
    while len(text) - at > capacity:
        end = at + capacity
        while end > at and text[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:
            raise ValueError("a character is larger than the capacity")
        out.append(end - at)
        at = end
    return out + [len(text) - at] * (len(text) > at)


def _cutter(capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in T.slices(column):
                data, offsets = T.padded(column.slice(lo, hi - lo))
                pieces = [byte_pieces(data[a + 1 : z - 1], capacity) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in _KEYS), pa.array(pieces, pa.list_(pa.int64()))],
                    [*_KEYS, "pieces"],
                )

    return cut


_OUT = "row_key long, doc_id long, piece long, doc_offset long, size long, bin_id long, bin_offset long"


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """Places of one shard's rows; the capacity comes with them."""
    shard = key[0].as_py()
    rows = rows.sort_by([("size", "descending"), ("key", "ascending"), ("row_key", "ascending"), ("source", "ascending"), ("copy", "ascending")])
    ids, keys, pieces = (rows.column(c).to_pylist() for c in ("key", "row_key", "pieces"))
    ids = [None if i == _NO_ID else i for i in ids]
    bit: dict[object, int] = {}

    def bit_of(value: object) -> int:
        return 0 if value is None else 1 << bit.setdefault(value, len(bit))

    source = [bit_of(x) for x in rows.column("source").to_pylist()]
    bit.clear()
    cluster = [bit_of(x) for x in rows.column("cluster").to_pylist()]
    capacity = rows.column("capacity")[0].as_py()
    rest = sorted((i for i, p in enumerate(pieces) if p), key=lambda i: -pieces[i][-1])
    bins = best_fit([(pieces[i][-1], source[i], cluster[i]) for i in rest], capacity)
    out, used, number, before = [], {}, max(bins, default=-1) + 1, [0] * len(pieces)
    for i, sizes in enumerate(pieces):
        for piece, size in enumerate(sizes[:-1]):
            out.append((keys[i], ids[i], piece, before[i], size, shard * _BIN + number, 0))
            before[i] += size
            number += 1
        if not sizes:
            out.append((keys[i], ids[i], 0, 0, 0, None, None))
    for i, b in zip(rest, bins, strict=True):
        size = pieces[i][-1]
        out.append((keys[i], ids[i], len(pieces[i]) - 1, before[i], size, shard * _BIN + b, used.get(b, 0)))
        used[b] = used.get(b, 0) + size
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.table({c: pa.array([x[n] for x in out], pa.int64()) for n, c in enumerate(names)})


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD, size: str | Column | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(row_key, doc_id, piece, doc_offset, size, bin_id, bin_offset): where each piece of each document lies.

    docs has doc_id, text and source; other columns are ignored, except the one
    that size names (a length in any unit, such as tokens; null counts as 0).
    Without it a document is as long as its bytes.  clusters(doc_id, text_hash,
    cluster) gives duplicate clusters of texts (text_hash by xxhash64); without it,
    documents of equal text but for letter case are a cluster.  No bin holds two
    pieces of one source or one cluster, save that a null source or cluster
    conflicts with nothing.  Documents of no length take no space: one row with a
    null bin.  Repeated rows are packed each; a null doc_id is packed like any
    other.  An empty table gives an empty result.  row_key is a hash of doc_id and
    text and tells rows of one doc_id apart; copies of a row differ in nothing.
    """
    if capacity < 4 or capacity >= 1 << 30:
        raise ValueError("capacity must be between 4 and 2**30")
    text, key = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key")
    source, text_hash = F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash")
    alike = F.when(F.length(text) > 0, F.xxhash64(F.lower(text))).alias("cluster")
    if size is None:
        cut = docs.select(key, text_hash, source, alike, text.alias("text")).mapInArrow(
            _cutter(capacity), "key long, text_hash long, source string, cluster long, pieces array<long>"
        )
    else:
        n = F.coalesce((F.col(size) if isinstance(size, str) else size).cast("long"), F.lit(0).cast("long"))
        full = F.array_repeat(F.lit(capacity).cast("long"), F.floor(n / capacity).cast("int"))
        cut = docs.select(key, text_hash, source, alike, F.filter(F.concat(full, F.array(n % capacity)), lambda x: x > 0).alias("pieces"))
    # copies of a row are counted first and then dealt by their running numbers
    named = cut.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"), F.first("pieces").alias("pieces"))
    if clusters is not None:
        of = clusters.select(key, "text_hash", F.col("cluster").cast("long").alias("cluster")).distinct()
        named = named.drop("cluster").join(of, ["key", "text_hash"], "left")
    named = durable(named)
    shards = max(1, -(-(named.agg(F.sum("n")).first()[0] or 0) // shard_rows))
    each = named.withColumn("row_key", F.xxhash64("key", "text_hash")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    dealt = each.select(
        F.pmod(F.xxhash64("row_key", "copy"), F.lit(shards)).cast("long").alias("shard"),
        "key",
        "row_key",
        "copy",
        "source",
        "cluster",
        "pieces",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"),
        F.lit(capacity).alias("capacity"),
    )
    return dealt.groupBy("shard").applyInArrow(_pack, _OUT)
