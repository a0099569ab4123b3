"""Helpers that the training-data operators share: inputs, shared staging folder, size-checked broadcast, ranks.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space is U+0020 and U+0009 to U+000D; everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Removes the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, tag: str, tidy: bool = False, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage and survives lost executors.

    With `tidy` the shuffle files of this job are removed when it is done (a lost executor meanwhile makes Spark run the
    stage again), so the disk holds one such job's exchange at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if tidy:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_stage(*frames: DataFrame) -> None:
    """Remove the files of frames that stage() returned and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Mark df for broadcast only if it has at most max_rows rows; else leave the choice of join to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def marks(hashes: DataFrame, bits: int = 1 << 27):
    """Broadcast bit map of a column of 64-bit hashes, by their low bits: 16 bits for each hash, at most `bits` (16 MB) in all.

    Rows that it does not mark are none of the hashes, so a join with these needs no other rows; more than `bits` / 16 hashes only mark
    more rows without need.
    """
    import numpy as np
    import pandas as pd

    n, size = hashes.count(), 1 << 16
    while size < min(16 * n, bits):
        size *= 2
    name, part = hashes.columns[0], 1 << 16

    def own(batches):
        found = np.zeros(size // 8, dtype=np.uint8)
        for b in batches:
            at = b[name].to_numpy() & (size - 1)
            np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for i in range(0, len(found), part):
            if found[i : i + part].any():
                yield pd.DataFrame({"i": [i], "m": [found[i : i + part].tobytes()]})

    def joined(b):
        out = np.bitwise_or.reduce([np.frombuffer(m, dtype=np.uint8) for m in b["m"]])
        return pd.DataFrame({"i": b["i"][:1], "m": [out.tobytes()]})

    whole = np.zeros(size // 8, dtype=np.uint8)
    for r in hashes.mapInPandas(own, "i long, m binary").groupBy("i").applyInPandas(joined, "i long, m binary").collect():  # `bits` / 8 bytes at most
        whole[r["i"] : r["i"] + part] = np.frombuffer(r["m"], dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole)


def marked(found, hashes):
    """Which of an array of 64-bit hashes the map of marks() marks."""
    at = hashes & (8 * len(found) - 1)
    return (found[at >> 3] >> (at & 7)) & 1 == 1


def words(text):
    """Array of the words of a text column; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda x: x != "")


def n_words(text):
    return F.size(words(text)).cast("long")


def ranked(df: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """Add `rank`, gapless from 0 within each value of `group` in the given order, without one task per group.

    Rows are range-partitioned by (group, order) and numbered within each partition; the few counts per
    (partition, group) become offsets. No task gets more than its range, however large a group is.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)

    def number(batches):
        from pyspark import TaskContext

        pid, at = TaskContext.get().partitionId(), {}
        for b in batches:
            inner = b.groupby(group, dropna=False).cumcount()
            start = b[group].map(lambda g: at.get(g, 0)).astype("int64")
            for g, k in b[group].value_counts(dropna=False).items():
                at[g] = at.get(g, 0) + int(k)
            yield b.assign(_pid=pid, _local=inner + start)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    numbered = stage(parts.mapInPandas(number, f"{fields}, _pid int, _local long"), tag)
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("_pid", group).agg(F.count("*").alias("_n"))
    offsets = counts.select("_pid", F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    out = numbered.alias("a").join(
        small(offsets, 200_000).alias("b"), (F.col("a._pid") == F.col("b._pid")) & F.col(f"a.{group}").eqNullSafe(F.col("b._g"))
    )
    return out.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("a._local") + F.col("b._before")).alias("rank"))
