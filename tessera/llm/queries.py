"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, edit_tokens, exact_dedup, jaccard_join, mixing, ngram_lm, quality, surrogates, token_shards, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sampled(table(spark, sf_dir, "documents"))
    weight, p = (F.round(f"__mix_{c}", 6).alias(a) for c, a in (("weight", "cell_weight"), ("probability", "probability")))
    names = (F.col(f"__mix_{c}").alias(c) for c in ("source", "lang", "topic", "tokens"))
    return rows.select("doc_id", *names, weight, p, F.col("__mix_selected").alias("selected"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.chain_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_edit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("edits", edit_tokens.scripted_edits())
    edited = edit_tokens.apply_edits(edit_tokens.build_trees(docs, keep=("edits",)))
    return edited.select("doc_id", "tokens_before", "tokens_after", "segments", "reencoded", F.sha2("text", 256).alias("text_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(table(spark, sf_dir, "documents"))


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.automaton_scores(table(spark, sf_dir, "documents"), folds=7, fold=2)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shards(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", F.round("containment", 6).alias("containment"), "reparameterised")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_toxicity, op3_edit_tokens, op4_quality, op5_surrogates, op6_ngram_lm, op7_token_shards, op8_jaccard_join, op9_exact_dedup, op10_decontam, pipeline)
}
