"""Persisted tables: graph, communities, embedding cache, retrieval log, derived blocks, and version snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrama.functions.vectors import text_hash
from engrama.schemas import DERIVED, EDGE, EMBEDDING_CACHE

#: The tables that a snapshot holds.
SNAPSHOT = ("memgraph", "communities", "feedback", "block_derived")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save_graph(edges: DataFrame, root: str) -> None:
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{root}/memgraph")


def load_graph(spark: SparkSession, root: str) -> DataFrame | None:
    return spark.read.parquet(f"{root}/memgraph").select("source", "target", "type", "weight", "evidence") if exists(spark, f"{root}/memgraph") else None


def save(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame | None:
    if not exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema) if schema else None
    return spark.read.parquet(f"{root}/{name}")


def append_derived(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").parquet(f"{root}/block_derived")


def load_derived(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "block_derived", DERIVED)


def append_log(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").parquet(f"{root}/precog")


def latest_log(log: DataFrame, order: str = "time") -> DataFrame:
    """The last row of each record id: appending replaces."""
    w = Window.partitionBy("record_id").orderBy(F.desc(order), F.desc("query"))
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def block_vectors(mem: DataFrame, cache: DataFrame | None, encode, dim: int) -> tuple[DataFrame, DataFrame]:
    """(id, block_no, vec) of all blocks, and the new cache rows. encode: DataFrame(hash, text) -> DataFrame(hash, text, vec).
    Each distinct text that the cache lacks (or has in another dimension) is encoded once."""
    b = mem.where("deprecated_by IS NULL").select("id", F.posexplode("blocks").alias("block_no", "text")).withColumn("hash", text_hash(F.col("text")))
    old = (cache if cache is not None else mem.sparkSession.createDataFrame([], EMBEDDING_CACHE)).where(F.size("vec") == dim)
    new = encode(b.select("hash", "text").dropDuplicates(["hash", "text"]).join(old, ["hash", "text"], "left_anti"))
    known = old.select("hash", "text", "vec").unionByName(new.select("hash", "text", "vec"))
    return b.join(known, ["hash", "text"]).select("id", "block_no", "vec"), new


def edges_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDGE)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Snapshot names in numeric order."""
    fs, p = _files(spark, f"{root}/versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((n for n in names if n[:1] == "v" and n[1:].isdigit()), key=lambda n: int(n[1:]))


def snapshot(spark: SparkSession, root: str, params: dict | None = None, now: str = "") -> str:
    """Copies the tables there are to the next version, with a manifest; an error if there are none."""
    have = [n for n in SNAPSHOT if exists(spark, f"{root}/{n}")]
    if not have:
        raise ValueError("there is nothing to snapshot")
    old = versions(spark, root)
    name = f"v{int(old[-1][1:]) + 1 if old else 0}"
    for n in have:
        _copy(spark, f"{root}/{n}", f"{root}/versions/{name}/{n}")
    body = {"version": name, "snapshot_at": now, "snapshotted": have, "params": params or {}, "lineage": old[-1:]}
    fs, p = _files(spark, f"{root}/versions/{name}/manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(body, ensure_ascii=False).encode()))
    out.close()
    return name


def manifest(spark: SparkSession, root: str, name: str) -> dict:
    rows = spark.read.text(f"{root}/versions/{name}/manifest.json", wholetext=True).collect()
    return json.loads(rows[0]["value"])


def restore(spark: SparkSession, root: str, name: str) -> list[str]:
    """Puts a version's tables back; what was there moves to <table>.bak; newer versions stay."""
    names = manifest(spark, root, name)["snapshotted"]
    for n in names:
        if exists(spark, f"{root}/{n}"):
            fs, p = _files(spark, f"{root}/{n}.bak")
            fs.delete(p, True)
            fs.rename(_files(spark, f"{root}/{n}")[1], p)
        _copy(spark, f"{root}/versions/{name}/{n}", f"{root}/{n}")
    return names


def _copy(spark: SparkSession, a: str, b: str) -> None:
    (fa, pa), (fb, pb) = _files(spark, a), _files(spark, b)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, pa, fb, pb, False, True, spark._jsc.hadoopConfiguration()):
        raise OSError(f"can't copy {a}")
