"""Toxicity scores of whole documents from subword-bag embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from readloom.llm import subword
from readloom.llm.scoring import scored

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
SETTINGS = subword.Settings(lower=True, alnum=True, window=4, rows=6000, balanced=True, epochs=8)


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS, keep: int | None = None) -> DataFrame:
    """See scoring.scored(); the label is labels.toxic, held out are ids with crc32 mod 3 = 1.

    A document is as toxic as its most toxic passage: bags of 4 words are
    averaged at a stride of 2 over the whole text and the largest softmax output
    counts, so a few words can't hide in a long text.  Training alternates
    between finding each document's most toxic passage and a descent on it.
    """
    return scored(docs, labels, "toxic", settings, FOLDS, HELD_OUT, THRESHOLD, keep)
