"""The thin registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(scratch.table(spark, sf_dir, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(scratch.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rate

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks"]
    return rate(scratch.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(f"quality.{n}" for n in names))


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode

    return encode(scratch.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


@query
def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(scratch.table(spark, sf_dir, "documents").select("doc_id", "text"), scratch.table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "key", "selected")


@query
def op6_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = scratch.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, scratch.table(spark, sf_dir, "labels")))
    return out.select("doc_id", scratch.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query
def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = scratch.table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs.where(~scratch.held_out(F.col("doc_id")))))
    return out.select("doc_id", scratch.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "proportions")


@query
def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import nearest

    vectors = scratch.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chat

    return format_chat(scratch.table(spark, sf_dir, "conversations"))


@query
def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(scratch.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bytebpe import encode

    return encode(scratch.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import rank

    return rank(scratch.table(spark, sf_dir, "documents"), scratch.table(spark, sf_dir, "benchmark"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    vectors = scratch.table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", relabelled.alias("label")), F.col("vec_id") % 100 == 0)
