"""From raw documents to packed training bins: five stages over one table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.  Model labels and the
benchmark come from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm._common import durable, if_small, remove, scratch, shared_dir, table
from readloom.llm.decontaminate import contamination
from readloom.llm.minhash import near_duplicates
from readloom.llm.packing import pack
from readloom.llm.quality import quality_scores
from readloom.llm.toxicity import toxicity_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return quality_scores(docs, table(spark, sf_dir, "labels"), keep=1)


def _rows_of(docs: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """docs joined (left_semi or left_anti) with the documents of named(doc_id, text_hash), in the columns of docs."""
    same = F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("n.text_hash"))
    return docs.alias("d").join(if_small(named).alias("n"), same, how).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; of repeated rows one stays.

    Rows that share an id are told apart by their texts.  Documents without words
    are in no group; of those without an id all stay.
    """
    found = durable(near_duplicates(docs))
    out = _rows_of(docs, durable(found.where("not kept").select("doc_id", "text_hash").distinct()), "left_anti")
    worded = found.where("kept and (doc_id is not null or n_shingles > 0)")
    repeated = durable(worded.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"))
    if repeated.isEmpty():
        return out
    once = _rows_of(out, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return _rows_of(out, repeated, "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_hash").distinct()
    return _rows_of(docs, durable(found), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in bins of fixed capacity, by bytes.

    Near duplicates are gone by now, so clusters are texts that differ in letter case only.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Trained models and similarity components can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what each keeps is written to the shared folder and read again.

    A stage's input and intermediate tables are removed once its output is
    written; the last stage's input stays until the session ends, as its result is
    computed when it is read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
