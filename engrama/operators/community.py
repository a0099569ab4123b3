"""Communities: assembly from a partition, keywords, text, and the graph between communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions.text import fmt_date, short
from engrama.functions.vectors import mean_vectors
from engrama.operators.graph import degree


def assemble(membership: DataFrame, min_size: int = 2) -> DataFrame:
    """cid, node, size: communities of min_size nodes or more, numbered C01... by size, then smallest node."""
    g = membership.groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("first")).where(F.col("size") >= min_size)
    g = g.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("size"), "first")))  # one row per community
    n = g.agg(F.max("rn").alias("n"))
    g = g.crossJoin(F.broadcast(n)).withColumn("cid", F.concat(F.lit("C"), F.lpad(F.col("rn").cast("string"), F.greatest(F.lit(2), F.length(F.col("n").cast("string"))), "0")))
    return membership.join(g.select("community", "cid", "size"), "community").select("cid", "node", "size")


def keywords(members: DataFrame, postings: DataFrame, stats: DataFrame, top: int = 5) -> DataFrame:
    """cid, keyword, score, rank: idf summed over members; a word inside another one with at least its score goes."""
    words = postings.where("NOT contains(entity, '/') AND length(entity) <= 24").join(stats.select("entity", "idf"), "entity")
    s = members.select("cid", F.col("node").alias("id")).join(words, "id").groupBy("cid", "entity").agg(F.round(F.sum("idf"), 6).alias("score"))
    subs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("entity")), lambda k: F.transform(F.sequence(F.lit(1), F.length("entity") - k + 1), lambda i: F.substring("entity", i, k)))))
    inner = s.select("cid", F.explode(subs).alias("sub"), "entity", F.col("score").alias("o")).where("sub <> entity")
    covered = inner.groupBy("cid", F.col("sub").alias("entity")).agg(F.max("o").alias("o"))
    kept = s.join(covered, ["cid", "entity"], "left").where("o IS NULL OR o < score")
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "entity"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("cid", F.col("entity").alias("keyword"), "score", "rank")


def spans(members: DataFrame, mem: DataFrame) -> DataFrame:
    t = members.join(mem.select(F.col("id").alias("node"), "time"), "node").groupBy("cid").agg(F.min("time").alias("a"), F.max("time").alias("b"))
    return t.select("cid", F.col("a").alias("start"), F.col("b").alias("end"))


def core_members(members: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    d = members.join(degree(edges).withColumnRenamed("id", "node"), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("degree"), "node"))).where(F.col("rank") <= top)


def internal_relations(members: DataFrame, edges: DataFrame, top: int = 6) -> DataFrame:
    m = members.select("cid", "node")
    e = edges.where("type <> 'temporal'").join(m.toDF("cid", "source"), "source").join(m.toDF("cid", "target"), ["cid", "target"])
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("weight"), "source", "target", "type"))
    return e.withColumn("rank", rank).where(F.col("rank") <= top)


def community_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target (cids), weight, bridge: the three commonest shared entities of the edges between, else the first evidence."""
    m = members.select("cid", "node")
    x = edges.join(m.toDF("ca", "source"), "source").join(m.toDF("cb", "target"), "target").where("ca <> cb")
    x = x.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "type", "weight", "evidence", F.struct("source", "target", "type").alias("o"))
    # weights have four decimals: summed as whole numbers, so that halves round alike in any order
    total = F.sum(F.round(F.col("weight") * 10000).cast("long"))
    w = x.groupBy("a", "b").agg((F.floor((total + 5) / 10) / 1000.0).alias("weight"), F.min_by("evidence", "o").alias("first"))
    names = x.where("type = 'entity'").select("a", "b", F.explode(F.split(F.replace("evidence", F.lit("共享实体: "), F.lit("")), "、")).alias("word"))
    n = names.groupBy("a", "b", "word").agg(F.count("*").alias("n"))
    n = n.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("n"), "word"))).where("r <= 3")
    bridge = n.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]), "、").alias("bridge"))
    return w.join(bridge, ["a", "b"], "left").select(F.col("a").alias("source"), F.col("b").alias("target"), "weight", F.coalesce("bridge", "first").alias("bridge"))


def vectors(members: DataFrame, block_vec: DataFrame) -> DataFrame:
    """cid, vec: the normalised mean of the vectors of all blocks of a community's members."""
    own = block_vec.join(members.select(F.col("node").alias("id"), "cid"), "id").select(F.col("cid").alias("id"), "vec")
    return mean_vectors(own).select(F.col("id").alias("cid"), F.col("rep").alias("vec"))


def _lines(df: DataFrame, name: str) -> DataFrame:
    """cid and the `line`s by rank, joined by newlines; every list was cut to a few ranks before."""
    return df.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias(name))


def describe(members: DataFrame, mem: DataFrame, edges: DataFrame, kw: DataFrame, cedges: DataFrame, modularity: float, neighbours: int = 4) -> DataFrame:
    """cid, title, size, keywords, start, end, neighbors, text."""
    first = lambda n: short(F.coalesce(F.try_element_at("blocks", F.lit(1)), F.col("id").cast("string")), n)
    names = mem.select("id", first(30).alias("name"), first(60).alias("long"), "time")
    base = members.groupBy("cid").agg(F.first("size").alias("size"))
    words = kw.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"]).alias("keywords"))
    core = core_members(members, edges).join(names, F.col("node") == F.col("id")).select("cid", "rank", F.concat(F.lit("- "), fmt_date(F.col("time")), F.lit(" "), "long").alias("line"))
    rel = internal_relations(members, edges).join(names.select(F.col("id").alias("source"), F.col("name").alias("sn")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("tn")), "target")
    rel = rel.select("cid", "rank", F.concat(F.lit("- 「"), "sn", F.lit("」 --"), "type", F.lit("（"), "evidence", F.lit("）--> 「"), "tn", F.lit("」")).alias("line"))
    a = base.join(words, "cid", "left").join(spans(members, mem), "cid", "left").join(_lines(core, "core"), "cid", "left").join(_lines(rel, "rel"), "cid", "left")
    a = a.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))).withColumn("top", F.array_join(F.slice("keywords", 1, 3), " · "))
    a = a.withColumn("title", F.when(F.col("top") != "", F.col("top")).otherwise(F.concat(F.lit("社群 "), "cid")))
    both = cedges.select(F.col("source").alias("cid"), F.col("target").alias("other"), "weight", "bridge").union(cedges.select("target", "source", "weight", "bridge"))
    near = both.join(a.select(F.col("cid").alias("other"), F.col("title").alias("ot")), "other")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("weight"), "other")))
    lists = near.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other", "weight", "bridge"))), lambda s: F.struct(s["other"].alias("id"), s["weight"].alias("weight"), s["bridge"].alias("bridge"))).alias("neighbors"))
    line = F.concat(F.lit("- "), "other", F.lit("「"), "ot", F.lit("」桥接: "), "bridge", F.lit("（权重 "), F.col("weight").cast("string"), F.lit("）"))
    shown = _lines(near.where(F.col("rank") <= neighbours).withColumn("line", line).select("cid", "rank", "line"), "nb")
    a = a.join(lists, "cid", "left").join(shown, "cid", "left")
    span = F.when(F.col("start").isNull(), F.lit("未知")).otherwise(F.concat(fmt_date(F.col("start")), F.lit(" → "), fmt_date(F.col("end"))))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("社群 "), "cid", F.lit("「"), F.when(F.col("top") != "", F.col("top")).otherwise("未命名"), F.lit("」")),
        F.concat(F.lit("规模: "), F.col("size").cast("string"), F.lit(" 条记忆 | 时间: "), span, F.lit(f" | 模块度: {modularity:.3f}")),
        F.concat(F.lit("关键词: "), F.when(F.size("keywords") > 0, F.array_join("keywords", "、")).otherwise("（无）")),
        F.lit(""), F.lit("【核心记忆】"), "core", F.lit(""), F.lit("【内部关系】"), F.coalesce("rel", F.lit("- （无强关系）")),
        F.when(F.col("nb").isNotNull(), F.concat(F.lit("\n【相邻社群】\n"), "nb")),
    )
    return a.select("cid", "title", "size", "keywords", "start", "end", "neighbors", text.alias("text"))
