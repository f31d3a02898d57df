"""Fit a subword model on a bounded labelled sample and score all documents with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import _text as T
from readloom.llm import subword
from readloom.llm._common import fold, labelled_texts


def fitted(docs: DataFrame, labels: DataFrame, label: str, settings: subword.Settings, folds: int, held_out: int) -> subword.Model:
    """A model of at most settings.rows labelled documents outside the held-out fold."""
    texts = labelled_texts(docs, labels, label, folds, held_out, settings.rows, settings.max_bytes, settings.balanced)
    return subword.fit(settings, texts)


def scored(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    settings: subword.Settings,
    folds: int,
    held_out: int,
    threshold: float,
    keep: int | None = None,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text, ...), or the rows predicted as keep.

    The model is fitted on the driver from a sample bounded by settings.rows and
    settings.max_bytes and has a fixed size (4 * 2**bits bytes); scoring is one
    scan and one Arrow map without a shuffle.  With keep (0 or 1), the result is
    the rows of docs with that prediction, in its own columns.  Null and empty texts get the score of an empty
    bag; a null doc_id is not held out and never learnt from; contradicting
    labels of an id count as 1; an empty docs gives an empty result; without
    labels every score is 0.5.
    """
    model = fitted(docs, labels, label, settings, folds, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = subword.score(shared.value, batch.column("text"))
            hit = (p >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(hit)], ["doc_id", "score", "predicted"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch.column("text")):  # whole texts go back to Spark, so in small batches
                part = batch.slice(lo, hi - lo)
                p = subword.score(shared.value, part.column("text"))
                yield part.filter(pa.array((p >= threshold) == bool(keep)))

    if keep is not None:
        return docs.mapInArrow(choose, docs.schema)
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = key.mapInArrow(add, "doc_id long, score double, predicted int")
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
