"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. A stage works on all rows the one before kept.
Null texts count as empty ones. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import decontam, linedup, packing, quality, setjoin
from sensorloom.llm.base import table, whole
from sensorloom.plans.staging import new_path
from sensorloom.session import tune_session

#: The end-of-document id of packed sequences.
END_ID = 2
#: Bytes of text encoded together and pieces that a worker keeps: less than op1 takes, as executors still hold what earlier stages took.
ENCODER = {"together": 2_000_000, "store": 200_000}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    tune_session(spark)
    return quality.quality_kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents without words left go."""
    tune_session(spark)
    return linedup.line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words with a similarity of 0.8 or more."""
    tune_session(spark)
    return setjoin.one_of_each_group(docs, setjoin.Rules(5, 80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    tune_session(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with their places in sequences."""
    import public_tokenizers

    tune_session(spark)
    return packing.pack_documents(docs.withColumn("text", whole(F.col("text"))), public_tokenizers.path("byte_bpe_50k.json"), END_ID, **ENCODER)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed_sequences),
]

#: Alignments and a tokenizer are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
