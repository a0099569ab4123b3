"""The memory graph: semantic, reference and temporal edges, merging, counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions.text import title
from engrama.functions.vectors import mean_vectors
from engrama.operators.entities import entity_edges, entity_pairs, entity_postings, entity_stats
from engrama.operators.iterate import dropped, saved
from engrama.sources.memories import active

EDGE = ["source", "target", "type", "weight", "evidence"]


def nearest(reps: DataFrame, k: int, threshold: float, chunk: int = 20_000) -> DataFrame:
    """id, other, cos: up to k most similar others of each id, by matrix products against chunks of all vectors."""
    spark = reps.sparkSession
    reps = saved(reps)
    n = reps.count()
    parts = max(1, -(-n // chunk))
    split = reps.withColumn("_c", F.pmod(F.xxhash64("id"), F.lit(parts)))
    out = None
    for c in range(parts):
        rows = split.where(F.col("_c") == c).select("id", "rep").collect()  # about `chunk` vectors
        if not rows:
            continue
        held = spark.sparkContext.broadcast(([r["id"] for r in rows], [r["rep"] for r in rows]))

        def run(batches, held=held):
            import numpy as np

            names, m = np.array(held.value[0]), np.array(held.value[1], dtype=np.float64)
            for b in batches:
                cos = np.stack([np.asarray(x, dtype=np.float64) for x in b["rep"]]) @ m.T
                mine = b["id"].to_numpy()
                cos[mine[:, None] == names[None, :]] = -np.inf
                i, j = np.nonzero(cos >= threshold)
                f = pd.DataFrame({"id": mine[i], "other": names[j], "cos": cos[i, j]})
                # the order of the final ranks: by rounded cos
                f = f.assign(r=np.floor(f["cos"] * 1e6 + 0.5)).sort_values(["id", "r", "other"], ascending=[True, False, True])
                yield f.groupby("id").head(k).drop(columns="r")

        kind = reps.schema["id"].dataType.simpleString()
        got = reps.mapInPandas(run, f"id {kind}, other {kind}, cos double")
        out = got if out is None else out.union(got)
    if out is None:
        return reps.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cos")).where("false")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("cos", 6)), "other"))
    return out.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def semantic_edges(block_vec: DataFrame, threshold: float = 0.62, k: int = 3) -> DataFrame:
    near = nearest(mean_vectors(block_vec), k, threshold).withColumn("w", F.round("cos", 4))
    g = near.groupBy(F.least("id", "other").alias("source"), F.greatest("id", "other").alias("target")).agg(F.max("w").alias("weight"))
    return g.select("source", "target", F.lit("semantic").alias("type"), "weight", F.concat(F.lit("语义相似 cos="), F.format_number("weight", 3)).alias("evidence"))


def reference_edges(mem: DataFrame) -> DataFrame:
    """References between active memories, weight 3 each; mutual ones add up."""
    live = active(mem)
    out = live.select(F.col("id").alias("f"), F.explode("revelant").alias("t")).where("f <> t").distinct()
    out = out.join(live.select(F.col("id").alias("t")), "t", "left_semi")
    return out.groupBy(F.least("f", "t").alias("source"), F.greatest("f", "t").alias("target")).agg(F.sum(F.lit(3.0)).alias("weight")).select(
        "source", "target", F.lit("reference").alias("type"), "weight", F.lit("显式引用").alias("evidence")
    )


def temporal_edges(mem: DataFrame, window_hours: float = 6, only_source: str | None = "LOG") -> DataFrame:
    """Neighbours in time at most window_hours apart. Rows are dealt by day, and each day's first row is joined to the
    last of the day before that has one, so no task holds the whole time line."""
    rows = active(mem).where("time IS NOT NULL")
    rows = rows if only_source is None else rows.where(F.col("source") == only_source)
    rows = rows.select("id", "time", F.to_date("time").alias("day"))
    w = Window.partitionBy("day").orderBy("time", "id")
    inside = rows.withColumn("p", F.lag(F.struct("id", "time")).over(w))
    last = rows.groupBy("day").agg(F.max(F.struct("time", "id")).alias("l"))
    before = last.withColumn("q", F.lag("l").over(Window.orderBy("day")))  # one row per day
    joined = inside.join(before.select("day", "q"), "day")
    prev = F.coalesce(F.col("p"), F.struct(F.col("q.id").alias("id"), F.col("q.time").alias("time")))
    gap = (F.col("time").cast("double") - prev["time"].cast("double")) / 60
    out = joined.select(prev["id"].alias("a"), F.col("id").alias("b"), gap.alias("gap")).where(F.col("a").isNotNull() & (F.col("gap") <= window_hours * 60))
    return out.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), F.lit("temporal").alias("type"), F.lit(0.25).alias("weight"), F.concat(F.lit("时间相邻 "), F.round("gap").cast("long").cast("string"), F.lit(" 分钟")).alias("evidence"))


def usage_graph_edges(usage: DataFrame, mem: DataFrame) -> DataFrame:
    """Co-hit edges whose both ends are active."""
    live = active(mem).select(F.col("id").alias("_id"))
    a = usage.join(live, usage["source"] == live["_id"], "left_semi")
    a = a.join(live, a["target"] == live["_id"], "left_semi")
    return a.select("source", "target", F.lit("usage").alias("type"), "weight", "evidence")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per unordered pair and type: weights add up, distinct evidence joined."""
    g = edges.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "type")
    return g.agg(F.round(F.sum("weight"), 4).alias("weight"), F.array_join(F.array_sort(F.collect_set("evidence")), "；").alias("evidence"))


def build_graph(mem: DataFrame, block_vec: DataFrame, usage: DataFrame, threshold: float = 0.62, floor: float = 3.0, only_source: str | None = "LOG") -> DataFrame:
    """All kinds of edges, merged. The large kinds are written one after the other, so that only one's shuffle files are there at a time."""
    live = active(mem)
    postings = saved(entity_postings(live))
    pairs = saved(entity_pairs(postings, entity_stats(postings, live), floor=floor, per_node=10))
    dropped(postings)
    entity = saved(entity_edges(pairs, floor))
    dropped(pairs)
    ids = live.select("id")
    vec = block_vec.join(ids, "id", "left_semi")
    parts = [entity, saved(semantic_edges(vec, threshold)), reference_edges(mem), temporal_edges(mem, only_source=only_source), usage_graph_edges(saved(usage), mem)]
    out = parts[0].select(*EDGE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*EDGE))
    return merge_edges(out)


def nodes(mem: DataFrame) -> DataFrame:
    return active(mem).select("id", title(F.col("blocks")).alias("title"), "time")


def type_counts(edges: DataFrame) -> DataFrame:
    """Edges per type, and all of them under null."""
    return edges.rollup("type").agg(F.count("*").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).groupBy("id").agg(F.count("*").alias("degree"))


def collapse(edges: DataFrame) -> DataFrame:
    """Weight per unordered pair over all types, loops dropped."""
    a = edges.where("source <> target")
    return a.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.round(F.sum("weight"), 6).alias("weight"))
