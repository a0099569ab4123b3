"""The model's tables from the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions.text import trimmed

NOW = "2024-03-15 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """df, dealt out if its file has fewer parts than there are cores: what follows is dear for a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def mem(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as memories: lines are blocks; times are spread by id; every tenth refers to the one ten before."""
    d = wide(table(spark, sf, "documents").select("doc_id", "text", "source"))
    blocks = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: trimmed(x)), lambda x: x != "")
    when = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 7919 % 100000) * 60)
    a = d.select(F.col("doc_id").alias("id"), blocks.alias("blocks"), "source", when.alias("time"))
    refers = F.when(F.col("id") % 10 == 0, F.array(F.col("id") - 10)).otherwise(F.array().cast("array<bigint>"))
    return a.select(
        "id", "blocks", F.array_join("blocks", " ").alias("text"), "source", refers.alias("revelant"),
        F.lit(None).cast("bigint").alias("deprecated_by"), "time",
    )


def block_vec(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.expr("vec_id div 4").alias("id"), F.expr("cast(vec_id % 4 as int)").alias("block_no"), F.col("embedding").alias("vec"))


def precog(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a retrieval log: one record per user and day; long form with the rank of each result."""
    e = table(spark, sf, "events")
    kinds = F.when(F.col("event_type") == "purchase", "true").when(F.col("event_type") == "click", "revelant").when(F.col("event_type") == "error", "false").otherwise("")
    day = F.to_date("ts")
    rows = e.select(
        F.concat_ws("_", F.col("user_id").cast("string"), day.cast("string")).alias("record_id"), F.col("ts").cast("timestamp").alias("at"), "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("id"), kinds.alias("accuracy"),
    )
    g = rows.groupBy("record_id").agg(F.min("at").alias("time"), F.array_sort(F.collect_list(F.struct("at", "event_id", "id", "accuracy"))).alias("r"))
    results = F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["accuracy"].alias("accuracy"), F.lit("").alias("summary")))
    return g.select("record_id", F.concat(F.lit("q "), "record_id").alias("query"), "time", results.alias("results"))


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as memories that refer to the turn before."""
    c = table(spark, sf, "conversations")
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    prev = F.when(F.col("turn") > 0, F.array(name(F.col("turn") - 1))).otherwise(F.array().cast("array<string>"))
    return c.select(name(F.col("turn")).alias("id"), F.array(F.coalesce("text", F.lit(""))).alias("blocks"), prev.alias("revelant"), F.lit(None).cast("string").alias("deprecated_by"))


def query_set(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as queries; their vector is the embedding with the item's number."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return b.join(e, "qid", "left")
