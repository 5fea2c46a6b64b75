"""Five stages from raw documents to shards: toxicity, near duplicates, benchmark passages, mix, shards.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes and rereads it between stages.
Columns of docs other than those of documents are left out. An empty table goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontam, mixing, setjoin, sharding, toxicity
from weftline.llm.common import load, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; null and wordless texts score as the bias of the model, and all stay without labels of both kinds."""
    return toxicity.keep_clean(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard 0.8 of five-word shingles: the smallest doc_id.

    Null ids and wordless texts stay; rows of one id with different texts are documents of their own.
    """
    return setjoin.keep_one(docs.select(*COLUMNS), 5, 80, 100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; documents without words stay as they are."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of 40 of near equal bytes and its slot; null texts count as empty, equal texts share a shard."""
    return sharding.place(docs.select(*COLUMNS), 40)


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix_sources), ("shard", shard)]

#: The toxicity stage is a trained model, which SQL cannot express; tests/llm compares the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
