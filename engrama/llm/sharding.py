"""Sharding by balanced label propagation over document groups.

Documents are nodes; a link says that a document belongs to a group (here: equal texts), and a cut edge is a member
outside its group's main shard. Every round is a set of joins: count members per (group, shard), take as the group's main
shard the one with most members among those whose free quota can hold the others (if there is none, the one with most),
let members elsewhere ask to move there, and admit of each shard's applicants the share that its free quota allows, by a
hash of (document, round). Only linked documents use up quotas in the rounds, as unlinked ones can give way. Groups over
`whole` of a shard are dealt by hash into parts of that size first, since they must be cut anyway. At the end counts are
evened out: the documents beyond a shard's exact quota, unlinked ones first, fill the shards below theirs. So row counts
differ by one at most (law `rows`), every slot is gapless, and groups stay together as far as a shard can hold them.

All choices go by hashes of doc_id and text, so the same rows in other files or partitions get the same shards. Groups with
at least a `HOT`-th of all rows are `HOT` at most; what is found for them is broadcast, so their members stay where they are.

Nulls and edge cases: a null text has no bytes (size 8, crc 0) and links with other null texts but not with empty ones;
null doc_id rows are placed like others; repeated rows are one group; an empty table gives no rows; more shards than rows
leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.shared import ranked, stage, table


HOT = 2048


def _of_group(members: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """members (grp, hot) with what was found for their groups (column `on`), hot groups by broadcast: they are HOT at most."""
    hot = members.where("hot").select("grp").distinct()
    few = F.broadcast(found.join(F.broadcast(hot), found[on] == hot["grp"], "left_semi"))
    return members.where("hot").join(few, F.col("grp") == F.col(on)).unionByName(members.where("NOT hot").join(found, F.col("grp") == F.col(on)))


def propagate(linked: DataFrame, n_shards: int, quota: float, rounds: int = 12, seed: int = 7) -> DataFrame:
    """linked: node, key (a hash of what the node is), grp, hot, shard (one row per membership; a node has one shard). Gives the
    same after the rounds. quota: linked nodes that a shard may hold."""
    one = linked.select("node", "shard").distinct().groupBy("shard").agg(F.count("*").alias("n"))
    load = {s: 0 for s in range(n_shards)} | {x["shard"]: x["n"] for x in one.collect()}  # n_shards rows
    for r in range(rounds):
        room = F.create_map(*[F.lit(v) for s in range(n_shards) for v in (s, max(0.0, quota - load[s]))])
        votes = linked.groupBy("grp", "shard").agg(F.count("*").alias("n"))
        sizes = votes.groupBy("grp").agg(F.sum("n").alias("total")).withColumnRenamed("grp", "_s")
        votes = votes.join(sizes, votes["grp"] == sizes["_s"]).withColumn("fits", (F.col("total") - F.col("n") <= F.element_at(room, F.col("shard"))).cast("int"))
        # ties go by a hash of the group, so that equal votes spread over the shards
        main = votes.groupBy("grp").agg(F.max(F.struct("fits", "n", F.xxhash64("grp", "shard", F.lit(seed + r)), "shard")).alias("m")).select(F.col("grp").alias("_g"), F.col("m.shard").alias("want"), F.col("m.n").alias("votes"))
        asked = _of_group(linked, stage(main, "main"), "_g")
        # of several groups' wishes, a node follows the strongest
        wish = asked.groupBy("node", "key", "shard").agg(F.max(F.struct("votes", "want")).alias("m")).select("node", "key", "shard", F.col("m.want").alias("want"))
        wish = stage(wish.where("want <> shard"), "wishes")
        flows = {(x["shard"], x["want"]): x["n"] for x in wish.groupBy("shard", "want").agg(F.count("*").alias("n")).collect()}  # n_shards ** 2 rows at most
        if not flows:
            break
        into = {s: sum(n for (_, t), n in flows.items() if t == s) for s in range(n_shards)}
        out = {s: sum(n for (t, _), n in flows.items() if t == s) for s in range(n_shards)}
        admit = {s: min(1.0, max(0.0, quota - load[s] + out[s] / 2) / into[s]) for s in range(n_shards) if into[s]}
        share = F.create_map(*[F.lit(v) for kv in admit.items() for v in kv])
        coin = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(r)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moves = stage(wish.where(coin < F.element_at(share, F.col("want"))).select(F.col("node").alias("_n"), "shard", "want"), "moves")
        for x in moves.groupBy("shard", "want").agg(F.count("*").alias("n")).collect():
            load[x["shard"]] -= x["n"]
            load[x["want"]] += x["n"]
        to = moves.select("_n", F.col("want").alias("_to"))
        linked = stage(linked.join(to, linked["node"] == to["_n"], "left").select("node", "key", "grp", "hot", F.coalesce("_to", "shard").alias("shard")), "linked")
    return linked


def even_out(placed: DataFrame, n_shards: int) -> DataFrame:
    """placed: node, key, shard, loose (0 for nodes that should stay, 1 for others). Gives node, shard, slot; counts differ by one at most."""
    held = ranked(placed.select("node", "key", "shard", "loose", F.xxhash64("key").alias("_o")), "shard", ["loose", "_o", "key", "node"], "placed")
    held = stage(held, "held")
    have = {x["shard"]: x["n"] for x in held.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # n_shards rows
    total = sum(have.values())
    order = sorted(range(n_shards), key=lambda s: (-have.get(s, 0), s))
    quota = {s: total // n_shards + (i < total % n_shards) for i, s in enumerate(order)}
    stay = {s: min(quota[s], have.get(s, 0)) for s in range(n_shards)}
    gaps, at = [], 0
    for s in range(n_shards):
        if n := quota[s] - stay[s]:
            gaps.append((at, s, stay[s]))
            at += n
    lookup = F.create_map(*[F.lit(v) for s in range(n_shards) for v in (s, stay[s])])
    limit = F.element_at(lookup, F.col("shard"))
    kept = held.where(F.col("rank") < limit).select("node", "shard", F.col("rank").alias("slot"))
    if not at:
        return kept
    extra = held.where(F.col("rank") >= limit).select("node", "key", F.lit(0).alias("one"), F.xxhash64("key", F.lit(1)).alias("_o"))
    extra = ranked(extra, "one", ["_o", "key", "node"], "extra")
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for start, s, first in gaps:
        shard = F.when(F.col("rank") >= start, F.lit(s)).otherwise(shard) if start else F.lit(s)
        slot = F.when(F.col("rank") >= start, F.col("rank") - start + first).otherwise(slot) if start else F.col("rank") + first
    return kept.union(extra.select("node", shard.alias("shard"), slot.alias("slot")))


def shard_documents(docs: DataFrame, n_shards: int = 24, rounds: int = 12, whole: float = 0.9, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the `carry` columns for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("null")).alias("grp"), *[F.col(c).alias(f"_c_{c}") for c in carry or []],
    )
    # the number is only a name; rows with equal keys are equal, so which of them is which doesn't matter
    rows = stage(raw.withColumn("node", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("doc_id", "grp")), "shard_rows")
    start = F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")
    total = rows.count()
    quota = total / n_shards
    groups = rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    hot = F.col("n") * F.lit(HOT) >= F.lit(total)
    parts = stage(groups.select(F.col("grp").alias("_g"), hot.alias("_hot"), F.ceil(F.col("n") / F.lit(max(quota * whole, 1.0))).alias("_parts")), "groups")
    few = F.broadcast(parts.where("_hot"))  # HOT rows at most
    members = rows.select("node", "key", "grp", start.alias("shard"))
    cold = members.join(F.broadcast(parts.where("_hot").select("_g")), F.col("grp") == F.col("_g"), "left_anti").join(parts.where("NOT _hot"), F.col("grp") == F.col("_g"))
    linked = members.join(few, F.col("grp") == F.col("_g")).unionByName(cold)
    deal = F.pmod(F.xxhash64("key", F.lit(3)), F.col("_parts"))
    part = F.when(F.col("_parts") > 1, F.concat_ws("/", "grp", deal.cast("string"))).otherwise(F.col("grp"))
    linked = stage(linked.select("node", "key", part.alias("grp"), F.col("_hot").alias("hot"), "shard"), "linked")
    moved = propagate(linked, n_shards, quota, rounds).groupBy("node").agg(F.first("shard").alias("_to"))
    placed = rows.select("node", "key").join(moved, "node", "left").select("node", "key", F.coalesce("_to", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")).alias("shard"), F.when(F.col("_to").isNull(), 1).otherwise(0).alias("loose"))
    final = even_out(placed, n_shards)
    out = rows.join(final, "node")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_c_{c}").alias(c) for c in carry or []],
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
