"""Structural diagnosis from usage: multi-topic, noisy, orphaned and duplicate memories, and bridges between communities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions.text import WORD, word_tokens
from engrama.functions.vectors import dot
from engrama.operators.graph import degree

KINDS = ("multi_topic", "noisy_anchor", "orphan_used", "duplicate_block", "bridge")
ACTIONS = {"multi_topic": "derived_split", "noisy_anchor": "anchor_rewrite", "orphan_used": "edge_attach", "duplicate_block": "merge_duplicate", "bridge": "keep_bridge"}


def used(stats: DataFrame, min_hits: int = 2) -> DataFrame:
    return stats.where(F.col("true_hits") + F.col("relevant_hits") >= min_hits)


def orphan_used(stats: DataFrame, edges: DataFrame, max_degree: int = 0, min_hits: int = 2) -> DataFrame:
    a = used(stats, min_hits).join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return a.where(F.col("degree") <= max_degree).select("id", "degree", F.round("weighted", 4).alias("score"))


def noisy_anchor(stats: DataFrame, ratio: float = 0.5, min_false: int = 2, min_hits: int = 2) -> DataFrame:
    """Only memories with min_hits positive hits are looked at."""
    a = used(stats, min_hits).withColumn("ratio", F.col("false_hits") / (F.col("true_hits") + F.col("relevant_hits") + F.col("false_hits")))
    return a.where((F.col("false_hits") >= min_false) & (F.col("ratio") >= ratio)).select("id", "false_hits", F.round("ratio", 6).alias("ratio"), F.round(F.col("weighted") * F.col("ratio"), 4).alias("score"))


def min_pair_cos(block_vec: DataFrame) -> DataFrame:
    """id, blocks, min_cos: the least dot product of two blocks of an id, 1 if there is one block."""
    a, b = block_vec.alias("a"), block_vec.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.block_no") < F.col("b.block_no")))
    low = pairs.groupBy(F.col("a.id").alias("id")).agg(F.min(dot(F.col("a.vec"), F.col("b.vec"))).alias("m"))
    n = block_vec.groupBy("id").agg(F.count("*").alias("blocks"))
    return n.join(low, "id", "left").select("id", "blocks", F.least(F.lit(1.0), F.coalesce("m", F.lit(1.0))).alias("min_cos"))


def topic_groups(block_vec: DataFrame, threshold: float = 0.55) -> DataFrame:
    """id, groups: complete-linkage groups of an id's blocks, in block order (a memory's few blocks per group)."""
    kind = block_vec.schema["id"].dataType.simpleString()

    def run(key, pdf):
        import numpy as np

        groups: list[list] = []
        for v in (np.asarray(x, dtype=np.float64) for x in pdf.sort_values("block_no")["vec"]):
            home = next((g for g in groups if all(float(v @ u) >= threshold for u in g)), None)
            if home is None:
                groups.append([v])
            else:
                home.append(v)
        return pd.DataFrame({"id": [key[0]], "groups": [len(groups)]})

    return block_vec.groupBy("id").applyInPandas(run, f"id {kind}, groups long")


def multi_topic(stats: DataFrame, block_vec: DataFrame, threshold: float = 0.55, min_hits: int = 2) -> DataFrame:
    vec = block_vec.join(used(stats, min_hits).select("id"), "id", "left_semi")
    low = min_pair_cos(vec).where((F.col("blocks") >= 2) & (F.col("min_cos") < threshold))
    a = used(stats, min_hits).join(low, "id").join(topic_groups(vec, threshold), "id")
    score = F.col("weighted") * (1 - F.col("min_cos")) * (1 + 0.1 * (F.col("groups") - 1))
    return a.select("id", F.round("min_cos", 6).alias("min_cos"), "groups", F.round(score, 4).alias("score"))


def attribution(mem: DataFrame, stats: DataFrame, pattern: str = WORD) -> DataFrame:
    """id, block_no, overlap: the block (the first of equals) that holds most of the words of the queries that found it."""
    blocks = mem.select("id", F.posexplode("blocks").alias("block_no", "block"))
    q = stats.select("id", F.array_distinct(F.flatten(F.transform("queries", lambda x: word_tokens(x, pattern)))).alias("q")).where("size(q) > 0")
    share = F.size(F.array_intersect("q", word_tokens(F.col("block"), pattern))) / F.size("q")
    s = blocks.join(q, "id").select("id", "block_no", F.round(share, 6).alias("overlap"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("overlap"), "block_no"))).where("r = 1").drop("r")


def duplicate_block(stats: DataFrame, block_vec: DataFrame, threshold: float = 0.92, min_hits: int = 2, chunk: int = 20_000) -> DataFrame:
    """Block pairs of different used memories at or above the threshold; blocks are compared by matrix products, in chunks."""
    u = used(stats, min_hits).select("id", "weighted")
    v = block_vec.join(u, "id")
    spark = v.sparkSession
    parts = max(1, -(-v.count() // chunk))
    kind = block_vec.schema["id"].dataType.simpleString()
    out = None
    for c in range(parts):
        rows = v.where(F.pmod(F.xxhash64("id", "block_no"), F.lit(parts)) == c).collect()  # about `chunk` vectors
        held = spark.sparkContext.broadcast([(r["id"], r["block_no"], list(r["vec"]), r["weighted"]) for r in rows])

        def run(batches, held=held):
            import numpy as np

            m = np.array([x[2] for x in held.value], dtype=np.float64)
            for b in batches:
                if not len(m) or not len(b):
                    continue
                cos = np.stack([np.asarray(x, dtype=np.float64) for x in b["vec"]]) @ m.T
                found = []
                for i, j in zip(*np.nonzero(cos >= threshold)):
                    o = held.value[j]
                    if b["id"].iloc[i] < o[0]:
                        found.append((b["id"].iloc[i], b["block_no"].iloc[i], o[0], o[1], cos[i, j], min(b["weighted"].iloc[i], o[3])))
                yield pd.DataFrame(found, columns=["id", "block_no", "other", "other_no", "cos", "w"])

        got = v.mapInPandas(run, f"id {kind}, block_no int, other {kind}, other_no int, cos double, w double")
        out = got if out is None else out.union(got)
    return out.select("id", "block_no", "other", "other_no", F.round("cos", 6).alias("cos"), F.round(F.col("cos") * F.col("w"), 4).alias("score"))


def bridges(usage_edges: DataFrame, members: DataFrame) -> DataFrame:
    """Usage edges between two communities; memories without community are left out."""
    m = members.select("cid", "node")
    x = usage_edges.join(m.toDF("ca", "source"), "source").join(m.toDF("cb", "target"), "target").where("ca <> cb")
    return x.select("source", "target", "ca", "cb", F.round("weight", 4).alias("score"))


def candidates(parts: dict[str, DataFrame], top: int = 20) -> DataFrame:
    """kind, memory_id, score, action, evidence (map), rank: the best `top` per kind. parts: kind -> its rows."""
    out = None
    for kind, df in parts.items():
        key = "id" if "id" in df.columns else "source"
        rest = [c for c in df.columns if c not in (key, "score")]
        evidence = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))])
        rows = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("memory_id"), "score", F.lit(ACTIONS[kind]).alias("action"), evidence.alias("evidence"), F.concat_ws("|", *[F.col(c).cast("string") for c in rest]).alias("_o"))
        out = rows if out is None else out.unionByName(rows)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "memory_id", "_o"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).drop("_o")


def plan(parts: dict[str, DataFrame]) -> DataFrame:
    """action, count: how many were found, before the cut."""
    out = None
    for kind, df in parts.items():
        row = df.agg(F.lit(ACTIONS[kind]).alias("action"), F.count("*").alias("count"))
        out = row if out is None else out.union(row)
    return out


def report(found: DataFrame, counts: DataFrame, lines: int = 8) -> str:
    """Readable report of a few lines per kind."""
    n = {r["action"]: r["count"] for r in counts.collect()}  # five rows
    out = ["反哺诊断", "候选：" + " | ".join(f"{k} {n.get(ACTIONS[k], 0)}" for k in KINDS)]
    rows = found.where(F.col("rank") <= lines).orderBy("kind", "rank").collect()
    for kind in KINDS:
        own = [r for r in rows if r["kind"] == kind]
        if own:
            out += ["", f"【{kind}】", *[f"- {r['memory_id']}  score={r['score']}  {dict(r['evidence'])}" for r in own]]
    return "\n".join(out)
