"""Iteration over DataFrames: where to write between rounds, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Removes the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """df written to and read from the cluster's shared folder (spark.checkpoint.dir; a temporary one in local mode).

    The job's shuffle files go when it is done, so that the disk holds those of one job at a time."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/rounds/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Remove the files of frames that saved() returned and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected to), from source and target: smallest labels spread along edges and to the labels' own labels until nothing changes."""
    e = edges.select("source", "target").where("source <> target")
    both = saved(e.union(e.select("target", "source")).distinct())
    lab = saved(both.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(lab.toDF("target", "r"), "target").groupBy(F.col("source").alias("node")).agg(F.min("r").alias("r"))
        step = lab.join(near, "node").select("node", F.least("root", "r").alias("new"), "root")
        up = lab.toDF("new", "up")
        nxt = saved(step.join(up, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("new"), "root"))
        changed = not nxt.where("new <> root").isEmpty()
        lab = nxt.select("node", F.col("new").alias("root"))
        if not changed:
            return lab
