"""Benchmark contamination by winnowed fingerprints, joined and then extended word by word.

Of every 9 consecutive 5-gram hashes the (rightmost) smallest is kept on both
sides.  A span of 13 words that a document shares with a benchmark item holds
exactly such 9 hashes, so at least one common fingerprint survives in both: no
shared span of 13 words is missed.  An item of fewer words is one fingerprint,
of all its words, and documents are looked up at every position for it.

The texts are mapped once, in Arrow batches.  A document's fingerprints are
emitted only if a bitmap of fixed size (2**22 bits, whatever the size of the
benchmark) may hold them; the exact join is Spark's.  Documents with joined
fingerprints are read again, and each aligned hit is extended to its full run
of equal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import _text as T
from readloom.llm._common import BROADCAST_ROWS, durable, if_light, if_small

SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
BITS = 22
#: Places of a print, at least, from which it counts as frequent; words of a part of the passages.
FREQUENT, PART_WORDS = 1000, 1 << 20
_NO_ID = -(2**63)


def winnow(grams: np.ndarray) -> np.ndarray:
    """For each full window of WINDOW hashes the position of its rightmost minimum."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    return np.arange(len(view)) + WINDOW - 1 - view.argmin(axis=1)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = T.words(*T.padded(batch.column("text")), T.ALNUM)
        rows = [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        whole = [int(T.grams(r, len(r)).view(np.int64)[0]) if len(r) else 0 for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array(whole, pa.int64()), pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))],
            ["item_id", "passage", "words"],
        )


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passage, at, prints = [], [], []
        for p, words in zip(batch.column("passage").to_pylist(), batch.column("words"), strict=True):
            h = np.asarray(words.values.to_numpy()).view(np.uint64)
            if len(h) < SPAN:
                where, found = np.array([0]), T.grams(h, len(h))
            else:
                g = T.grams(h, GRAM)
                where = np.unique(winnow(g))
                found = g[where]
            passage += [p] * len(where)
            at.append(where)
            prints.append(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(passage, pa.int64()),
                pa.array(np.concatenate(at) if at else [], pa.int64()),
                pa.array(np.concatenate(prints).view(np.int64) if prints else [], pa.int64()),
            ],
            ["passage", "at", "print"],
        )


def _print_finder(bitmap: np.ndarray, short: list[int]):
    def may_hold(h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi in T.slices(column):
                w = T.words(*T.padded(column.slice(lo, hi - lo)), T.ALNUM)
                ends = np.repeat(w.first[1:], w.counts)
                g = T.grams(w.hashes, GRAM)
                # a window starts at word s and needs words s .. s + SPAN - 1 of one document
                picked = winnow(g)
                full = np.arange(len(picked)) + SPAN <= ends[: len(picked)]
                picked = np.unique(picked[full])
                picked = picked[may_hold(g[picked])]
                at, prints = [picked], [g[picked]]
                for n in short:
                    s = T.grams(w.hashes, n)
                    ok = np.flatnonzero((np.arange(len(s)) + n <= ends[: len(s)]) & may_hold(s))
                    at.append(ok)
                    prints.append(s[ok])
                at, prints = np.concatenate(at), np.concatenate(prints)
                order = np.argsort(at, kind="stable")
                at, prints = at[order], prints[order]
                doc = np.searchsorted(w.first, at, side="right") - 1
                begin = np.searchsorted(doc, np.arange(hi - lo + 1))
                lists = [
                    pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x, pa.int64()))
                    for x in (at - w.first[doc], prints.view(np.int64))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "key", "text_hash")),
                        pa.array(w.counts, pa.int64()),
                        *lists,
                    ],
                    ["doc_id", "key", "text_hash", "n_words", "at", "prints"],
                )

    return find


def runs(words: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, int]]:
    """Spans of words[i] = item[i - diagonal] that are as long as a window of the item."""
    a, z = max(0, diagonal), min(len(words), diagonal + len(item))
    if z <= a:
        return []
    same = np.concatenate(([False], words[a:z] == item[a - diagonal : z - diagonal], [False]))
    edge = np.flatnonzero(same[1:] != same[:-1]) + a
    need = min(SPAN, len(item))
    return [(int(x), int(y)) for x, y in zip(edge[0::2], edge[1::2], strict=True) if y - x >= need]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in T.slices(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            w = T.words(*T.padded(part.column("text")), T.ALNUM)
            spans, passages = [], []
            for i, hits in enumerate(part.column("hits").to_pylist()):
                words = w.hashes[w.first[i] : w.first[i + 1]]
                own, found = [], []
                for h in hits:
                    item = np.array(h["words"], np.int64).view(np.uint64)
                    some = [s for d in h["diagonals"] for s in runs(words, item, d)]
                    own += some
                    if some:
                        found.append(h["passage"])
                spans.append([{"a": a, "z": z} for a, z in own])
                passages.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    part.column("text_hash"),
                    pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))),
                    pa.array(passages, pa.list_(pa.int64())),
                ],
                ["key", "text_hash", "spans", "passages"],
            )


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Which of 2**BITS slots hold a print; at most 2**(BITS - 6) rows reach the driver."""
    slot = F.shiftrightunsigned("print", 64 - BITS)
    parts = (
        prints.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(print, {64 - BITS}) & 63))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in parts:
        out[r.word] = r.bits
    return out.view(np.uint64)


def _met(where: DataFrame, prints: DataFrame) -> DataFrame:
    """where(..., print) joined with prints.

    Beyond a broadcast of all prints, those that are frequent in the documents, of
    which there are at most BROADCAST_ROWS, are joined apart, so that no task gets
    all places of one print.
    """
    if prints.count() <= BROADCAST_ROWS:
        return where.join(F.broadcast(prints), "print")
    where = durable(where)
    most = max(FREQUENT, where.count() // BROADCAST_ROWS)
    large = F.broadcast(durable(where.groupBy("print").count().where(F.col("count") > most).select("print")))
    few, rest = durable(prints.join(large, "print")), where.join(large, "print", "left_anti")
    return where.join(large, "print", "left_semi").join(if_small(few), "print").unionByName(rest.join(prints, "print"))


def _covered(spans: Column) -> Column:
    """Words in the union of half-open spans."""
    done = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        done,
        lambda d, s: F.struct(
            F.greatest(d["end"], s["z"]).alias("end"), (d["n"] + F.greatest(s["z"] - F.greatest(s["a"], d["end"]), F.lit(0).cast("long"))).alias("n")
        ),
        lambda d: d["n"],
    )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) for each row of docs(doc_id, text, ...).

    benchmark has item_id and text.  A document word is hit if it lies in an
    occurrence of 13 consecutive words of an item, or of a shorter item's
    words.  Null texts have no words; a null item_id marks words but isn't
    counted among the items.  Items of equal words are compared once and all
    counted.  Rows that share doc_id and text get equal rows; rows that share
    only doc_id are judged by their own texts.  Other columns are ignored, an
    empty docs gives an empty result, an empty benchmark hits nothing.
    text_hash (xxhash64) tells rows of one doc_id apart.
    """
    items = durable(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_item_words, "item_id long, passage long, words array<long>")
        .where(F.size("words") > 0)
    )
    passages = items.groupBy("passage").agg(F.min("words").alias("words"))
    members = items.select("passage", "item_id").distinct()
    prints = durable(passages.mapInArrow(_item_prints, "passage long, at long, print long"))
    short = [r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < SPAN).distinct().collect()]

    keyed = _keyed(docs)
    rows = durable(
        keyed.mapInArrow(
            _print_finder(_bitmap(prints), sorted(short)),
            "doc_id long, key long, text_hash long, n_words long, at array<long>, prints array<long>",
        )
    )
    where = rows.where(F.size("prints") > 0).select("key", "text_hash", F.explode(F.arrays_zip("at", "prints")).alias("p"))
    diagonals = (
        _met(where.select("key", "text_hash", F.col("p.at").alias("pos"), F.col("p.prints").alias("print")), prints)
        .groupBy("key", "text_hash", "passage")
        .agg(F.collect_set(F.col("pos") - F.col("at")).alias("diagonals"))
    )
    # a row holds the hits of a document among one part of the passages, so of at most PART_WORDS words or so
    words = passages.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    part = F.pmod(F.xxhash64("passage"), F.lit(1 + words // PART_WORDS))
    hits = durable(
        diagonals.join(if_light(passages, 8 * F.size("words")), "passage")
        .groupBy("key", "text_hash", part.alias("part"))
        .agg(F.collect_list(F.struct("passage", "diagonals", "words")).alias("hits"))
    )
    wanted = if_small(durable(hits.select("key", "text_hash").distinct()))
    again = keyed.join(wanted, ["key", "text_hash"], "left_semi").select("key", "text_hash", "text")
    extended = (
        again.dropDuplicates(["key", "text_hash"])
        .join(hits, ["key", "text_hash"])
        .select("key", "text_hash", "text", "hits")
        .mapInArrow(_extend, "key long, text_hash long, spans array<struct<a long, z long>>, passages array<long>")
        .where(F.size("spans") > 0)
        .groupBy("key", "text_hash")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("passages")).alias("passages"))
    )
    extended = durable(extended.select("key", "text_hash", _covered(F.col("spans")).alias("n_hit"), "passages"))
    named = (
        extended.select("key", "text_hash", F.explode("passages").alias("passage"))
        .join(if_small(members, 20_000), "passage")
        .groupBy("key", "text_hash")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    found = extended.select("key", "text_hash", "n_hit").join(named, ["key", "text_hash"], "left")
    out = rows.select("doc_id", "key", "text_hash", "n_words").join(found, ["key", "text_hash"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "text_hash",
    )
