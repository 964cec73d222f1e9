"""The corpus pipeline: quality rules, quality classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives the next one's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import scratch
from stockroom.llm.importance import resample
from stockroom.llm.minhash_dedup import near_duplicates
from stockroom.llm.packing import pack
from stockroom.llm.quality import rate

#: Stands before the names of columns that stages add and take away again, so that documents may have columns of any other name.
OWN = "__stage_"
#: Least Jaccard similarity, as a fraction, of the five-word shingle sets of documents that near_dedup takes for near-duplicates.
ALIKE = (80, 100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return rate(docs, column=OWN).where(f"{OWN}.kept").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    return resample(docs, scratch.table(spark, sf_dir, "labels"), prefix=OWN).where(f"{OWN}selected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity `ALIKE` or more): that of the smallest doc_id. Blank texts and rows without a doc_id are in no group and stay.

    Rows that repeat a doc_id are one document: of those with text the first in order of text and then of the other columns stays, so reruns agree.
    """
    found = scratch.save(near_duplicates(docs, *ALIKE), "near-duplicates")
    gone = found.where("not kept").select("doc_id").distinct()
    out = docs.join(scratch.small_side(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    twice = scratch.save(found.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias(OWN + "twice")), "repeated")
    if not (n := twice.count()):
        return out
    several = F.coalesce(F.col(OWN + "twice") & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = scratch.save(out.join(scratch.small_side(twice, n), "doc_id", "left").withColumn(OWN + "twice", several), "kept")
    first = out.where(OWN + "twice").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns)))).alias(OWN + "first"))
    return out.where(f"not {OWN}twice").select(*docs.columns).unionByName(first.select(f"{OWN}first.*").select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("near-duplicates", near_dedup), ("packing", packing)]
#: Signatures, models and packing are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to shared storage before the next reads it."""
    docs = scratch.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
