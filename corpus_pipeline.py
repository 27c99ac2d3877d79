"""From raw documents to token shards in training order; every stage is one operator of tessera.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's documents. run() writes each
stage's result to the shared folder and reads it again, so a lost executor repeats one stage's tasks at most.

All stages take null and empty texts as texts without words, keep any columns that documents have besides, and give no rows for an empty
table. Ids are whole numbers; rows that share one are judged by what is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard_join, mixing, token_shards, toxicity
from tessera.llm.common import materialise
from tessera.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the classifier chain on the labelled documents; drop those that it rejects. Each row is judged by its own text, null ids and repeated rows too;
    texts without words stay. Without labels nothing is dropped."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(~toxicity.is_toxic(model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays. Texts without words have no links and stay, as
    do rows with a null id. Rows that repeat an id go or stay together."""
    groups = jaccard_join.jaccard_components(docs, width=5, percent=80)
    gone = materialise(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, re-parameterised ones too. Rows that share an id, null ones too, are judged as one document."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that tokens follow the source, language and topic targets. Null sources and languages are values of their own; texts without
    words have nothing to give and are left out; rows that share an id stay or go together, if of one cell."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride shards of token ids in training order. Each row is a document of its own; a null id is written as -1, and a text without words as its
    end."""
    return token_shards.shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: The classifier chain and the tokeniser can't be expressed in SQL; tests/llm compares each stage and run() with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
