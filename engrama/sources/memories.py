"""Loading memories and logs from raw tables (JDBC or JSON), with tolerant parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions.text import time_of_id, time_of_record, time_of_text, tolerant_array, trimmed

#: White space and line ends of any kind, as chat tables are trimmed of.
BLANK = r"[\s\p{Z}\x{FEFF}]"
CORE_FILE = "struct<name: string, path: string, content: string>"


def active(mem: DataFrame) -> DataFrame:
    return mem.where(F.col("deprecated_by").isNull() & (F.size("blocks") > 0))


def read_raw(spark: SparkSession, where: str, table: str = "memories", **options: str) -> DataFrame:
    """A raw table by URL: jdbc:..., a folder or file of json or parquet."""
    if where.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=where, dbtable=table, **options).load()
    return spark.read.json(where) if where.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(where)


def memories(raw: DataFrame) -> DataFrame:
    """memory_id, revelant, blocks, source, core_file, deprecated_by with JSON text columns -> the mem table."""
    blocks = tolerant_array(F.col("blocks"))
    return raw.select(
        F.col("memory_id").cast("string").alias("id"), blocks.alias("blocks"), F.array_join(blocks, " ").alias("text"), F.coalesce("source", F.lit("")).alias("source"),
        tolerant_array(F.col("revelant")).alias("revelant"), tolerant_array(F.col("core_file"), CORE_FILE).alias("core_files"),
        F.nullif(F.col("deprecated_by"), F.lit("")).alias("deprecated_by"), time_of_id(F.col("memory_id")).alias("time"),
    )


def chat_memories(raw: DataFrame) -> DataFrame:
    """As memories(), for four-column chat tables: blocks are trimmed, empty ones dropped; none is deprecated."""
    blocks = F.filter(F.transform(tolerant_array(F.col("blocks")), lambda x: trimmed(x, BLANK)), lambda x: x != "")
    return raw.select(
        F.col("memory_id").cast("string").alias("id"), blocks.alias("blocks"), F.array_join(blocks, " ").alias("text"), F.coalesce("source", F.lit("")).alias("source"),
        tolerant_array(F.col("revelant")).alias("revelant"), F.array().cast(f"array<{CORE_FILE}>").alias("core_files"),
        F.lit(None).cast("string").alias("deprecated_by"), F.coalesce(time_of_text(F.col("memory_id")), time_of_id(F.col("memory_id"))).alias("time"),
    )


def merge_duplicates(rows: DataFrame, order: str, id_col: str = "id", blocks: str = "blocks", scalars: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one id merged: the first row's scalars, blocks united in order without repeats; empty ids are dropped."""
    kept = rows.where(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != ""))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(blocks).alias("_b"))))
    united = F.array_distinct(F.flatten(F.transform(parts, lambda x: x["_b"])))
    return kept.groupBy(id_col).agg(*[F.min_by(c, order).alias(c) for c in scalars], united.alias(blocks))


def stored_vectors(raw: DataFrame) -> DataFrame:
    """memory_id, block_vectors (binary, little-endian floats) -> id, vec; null and empty ones are skipped."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x[: len(x) // 4 * 4], dtype="<f4"))

    full = raw.where("block_vectors IS NOT NULL AND octet_length(block_vectors) >= 4")
    return full.select(F.col("memory_id").cast("string").alias("id"), decode("block_vectors").alias("vec"))


def precog_log(raw: DataFrame) -> DataFrame:
    """Log rows with JSON text columns -> the precog table, with the record's time."""
    results = tolerant_array(F.col("results"), "struct<id: string, accuracy: string, summary: string>")
    return raw.select(
        "record_id", F.coalesce("query", F.lit("")).alias("query"), tolerant_array(F.col("keywords")).alias("keywords"), F.coalesce(F.col("top_k").cast("int"), F.lit(0)).alias("top_k"),
        results.alias("results"), F.coalesce("description", F.lit("")).alias("description"), time_of_record(F.col("record_id")).alias("time"),
    )
