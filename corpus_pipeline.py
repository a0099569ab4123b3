"""From raw documents to shards: toxicity, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
result of a stage is written as Parquet into the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engrama.llm import decontamination, mixing, nearcopies, sharding, simhash, toxicity
from engrama.llm.shared import stage, table


#: Rows that go to a Python worker at a time. Workers live on from stage to stage, and what they once took they keep.
ROWS = "1000"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where("tox_predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5-word shingles, similarity 0.8) the document with the smallest doc_id. Candidates are op2's
    links (fingerprints within 3 bits) and, for copies that fingerprints can't find, min-hash bands; all are checked exactly."""
    return simhash.firsts(docs, nearcopies.near_copies(docs)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), short_texts=True).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, dealt to domains, languages and sources by weight; each document once at most."""
    extra = [c for c in docs.columns if c != "doc_id"]
    return mixing.mix(docs, mixing.WEIGHTS, budget=0.9, max_epochs=1, carry=docs.columns, bare=True).select("doc_id", *extra)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Classifier, fingerprints and windows have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
