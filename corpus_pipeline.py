"""A corpus pipeline over `documents`: toxicity, near copies, benchmark passages, source mix,
shards. Every stage gets what its predecessor kept, as stored Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, resemblance, shards, toxicity
from tidemark.llm.classify import score
from tidemark.session import shared_dir

SHARDS = 24
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: No SQL: the first stage trains a classifier. tests/llm compares the other stages with brute
#: force, each on its own input.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most BATCH_ROWS rows from here on: a batch is held
    several times over, by the JVM and by every Python worker of an executor."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; empty ones stay."""
    _small_batches(spark)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.filter(score(model, docs["text"]) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that with the
    smallest id."""
    _small_batches(spark)
    return resemblance.without_copies(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    _small_batches(spark)
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources; a document that two epochs take comes twice."""
    rows = mixing.places(docs)
    return mixing.mixed_documents(docs, rows, mixing.targets(rows))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `shard` and `virtual_slot`."""
    return shards.sharded(docs, shards.first_map(shards.slot_bytes(docs), SHARDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("source_mix", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is stored in the shared folder and read by the next."""
    base = f"{shared_dir(spark)}/pipeline-{spark.sparkContext.applicationId}"
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return result
        place = f"{base}/{k}-{name}-{spark.sql('select uuid()').first()[0]}"
        result.write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
