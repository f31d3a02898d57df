"""Quality scores of whole documents from supervised subword embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from readloom.llm import subword
from readloom.llm.scoring import scored

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
SETTINGS = subword.Settings(lower=False, alnum=False, rows=4000, epochs=5)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS, keep: int | None = None) -> DataFrame:
    """See scoring.scored(); the label is labels.quality, held out are ids with crc32 mod 5 = 0.

    Vectors of hashed words and byte n-grams are averaged over the whole
    document; case and punctuation count.
    """
    return scored(docs, labels, "quality", settings, FOLDS, HELD_OUT, THRESHOLD, keep)
