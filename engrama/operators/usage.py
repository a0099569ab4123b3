"""Usage signals from the retrieval log: counts, graded and decayed statistics, co-hit edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions.text import accuracy_weight


def decay(time: Column, now: Column, half_life_days: float = 180) -> Column:
    """0.5 ** (age / half-life); no time counts as now, future times as age 0, half-lives under a day as one."""
    age = F.greatest(F.lit(0.0), (now.cast("double") - F.coalesce(time, now).cast("double")) / 86400.0)
    return F.pow(F.lit(0.5), age / F.lit(float(max(1, half_life_days))))


def usage_counts(log: DataFrame) -> DataFrame:
    """Results per id whose accuracy isn't false; repeats and unlabelled ones count."""
    r = log.select(F.explode("results").alias("r")).where(F.lower(F.coalesce("r.accuracy", F.lit(""))) != "false")
    return r.groupBy(F.col("r.id").alias("id")).agg(F.count("*").alias("n"))


def _hits(log: DataFrame, now: Column, half_life_days: float, weights) -> DataFrame:
    """One row per record and distinct id: its first occurrence, rank among distinct ids, weight and decay."""
    r = log.select("record_id", "query", "time", F.posexplode("results").alias("pos", "r")).where("r.id IS NOT NULL")
    first = r.groupBy("record_id", F.col("r.id").alias("id")).agg(F.min_by(F.struct("pos", "query", "time", F.col("r.accuracy").alias("accuracy")), "pos").alias("x"))
    h = first.select("record_id", "id", "x.*")
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("record_id").orderBy("pos")))
    return h.withColumn("aw", accuracy_weight(F.col("accuracy"), weights)).withColumn("decay", decay(F.col("time"), now, half_life_days))


def usage_stats(log: DataFrame, now: Column, half_life_days: float = 180, weights=None, max_queries: int = 8) -> DataFrame:
    h = _hits(log, now, half_life_days, weights)
    acc = F.lower(F.coalesce("accuracy", F.lit("")))
    relevant = acc.isin("revelant", "relevant")
    firsts = h.groupBy("id", "query").agg(F.min(F.struct(F.coalesce("time", now).alias("t"), F.col("record_id").alias("rid"))).alias("k"))
    ranked = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("k.t", "k.rid"))).where(F.col("rn") <= max_queries)
    queries = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "query"))), lambda x: x["query"]).alias("queries"))
    stats = h.groupBy("id").agg(
        F.count_if(acc == "true").alias("true_hits"), F.count_if(relevant).alias("relevant_hits"), F.count_if(acc == "false").alias("false_hits"),
        F.count_if(~acc.isin("true", "false") & ~relevant).alias("unlabeled_hits"), F.sum(F.col("aw") * F.col("decay")).alias("weighted"), F.max("time").alias("last_time"),
    )
    return stats.join(queries, "id")


def usage_edges(log: DataFrame, now: Column, window: int = 5, half_life_days: float = 180, weights=None, unique: bool = False) -> DataFrame:
    """Pairs of positive results among a record's first `window` distinct ones; at most window^2 / 2 per record.

    unique: each record is one row (no record id twice), so that its hits are found without dealing them out."""
    if unique:
        r = log.withColumn("results", F.filter("results", lambda x: x["id"].isNotNull())).withColumn("ids", F.transform("results", lambda x: x["id"])).where(F.size("ids") > 1)
        one = lambda i: F.try_element_at("results", F.array_position("ids", i).cast("int"))["accuracy"]
        first = F.transform(F.slice(F.array_distinct("ids"), 1, window), lambda i: F.struct(i.alias("id"), accuracy_weight(one(i), weights).alias("aw"), decay(F.col("time"), now, half_life_days).alias("decay"), F.col("query").alias("query")))
        r = r.select(F.filter(first, lambda x: x["aw"] > 0).alias("h"))
    else:
        h = _hits(log, now, half_life_days, weights).where((F.col("rank") <= window) & (F.col("aw") > 0))
        # a record's hits, window at most, are paired where they lie: they are found once, not once for each side of a join
        r = h.groupBy("record_id").agg(F.collect_list(F.struct("id", "aw", "decay", "query")).alias("h")).where(F.size("h") > 1)
    pair = lambda p, q: F.struct(p["id"].alias("source"), q["id"].alias("target"), (p["aw"] * q["aw"] * p["decay"]).alias("w"), p["query"].alias("query"))
    pairs = r.select(F.inline(F.flatten(F.transform("h", lambda p: F.transform(F.filter("h", lambda q: q["id"] > p["id"]), lambda q: pair(p, q))))))
    g = pairs.groupBy("source", "target").agg(F.round(F.sum("w"), 4).alias("weight"), F.count("*").alias("hits"), F.min("query").alias("_q"))
    return g.select("source", "target", "weight", "hits", F.concat(F.lit("共召回 "), F.col("hits").cast("string"), F.lit(" 次: "), "_q").alias("evidence"))


def usage_summary(stats: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    a = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("true_hits", "relevant_hits", "false_hits", "unlabeled_hits")], F.count("*").alias("used_memories"), F.count_if(F.col("true_hits") + F.col("relevant_hits") > 0).alias("positive_memories"))
    return a.crossJoin(edges.agg(F.count("*").alias("co_hit_edges"))).crossJoin(log.agg(F.count("*").alias("records")))  # one row each
