"""Entity index: Latin names and paths, and selected CJK terms, with document frequency and idf."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions.text import cjk_terms, latin_entities
from engrama.operators.iterate import dropped, saved


def cjk_term_selection(mem: DataFrame, min_df: int = 4, max_share: float = 0.3, keep: int = 150) -> DataFrame:
    """Terms by df * ln(length + 1), longer first among equals; a term inside an earlier one is dropped; the first `keep`.

    Containment is transitive, so "inside an earlier kept term" is "inside any earlier term": an anti-join over the at
    most 14 proper substrings of each term."""
    df = mem.select("id", F.explode(F.array_distinct(cjk_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = saved(df.where(F.col("df") >= min_df))
    # texts are counted only if they have such terms
    n = df.select(F.lit(0).alias("n")).limit(1) if df.isEmpty() else mem.agg(F.count("*").alias("n"))
    ok = df.crossJoin(F.broadcast(n)).where(F.col("df") <= max_share * F.col("n")).drop("n")  # n is one row
    scored = ok.withColumn("score", F.col("df") * F.log(F.length("term") + F.lit(1.0)))
    order = F.struct((-F.col("score")).alias("s"), (-F.length("term")).alias("l"), F.col("term").alias("t"))
    scored = scored.withColumn("o", order)
    subs = F.flatten(F.transform(F.sequence(F.lit(2), F.length("term")), lambda k: F.transform(F.sequence(F.lit(1), F.length("term") - k + 1), lambda i: F.substring("term", i, k))))
    inner = scored.select(F.explode(subs).alias("sub"), "o", "term").where("sub <> term").groupBy("sub").agg(F.min("o").alias("first"))
    kept = scored.join(inner, scored["term"] == inner["sub"], "left").where("first IS NULL OR NOT first < o")
    return kept.orderBy("o").limit(keep).select("term", "df", "score")


def entity_postings(mem: DataFrame, cjk: bool = True) -> DataFrame:
    """Distinct (entity, id) of memories that aren't deprecated; CJK terms (150 at most) are looked for as substrings.

    Within a row entities are made distinct: only rows of repeated ids need a comparison."""
    live = mem.where("deprecated_by IS NULL")
    found = latin_entities(F.col("text"))
    terms = [r["term"] for r in cjk_term_selection(live).select("term").collect()] if cjk else []  # 150 at most
    if terms:
        found = F.concat(found, F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("text"), t)))
    out = live.select("id", F.explode(F.array_distinct(found)).alias("entity"))
    twice = live.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    if twice.isEmpty():
        return out
    same = F.col("id").eqNullSafe(F.col("_id"))
    return out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").distinct())


def entity_stats(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """entity, df, idf; corpus: the memories that count towards n."""
    n = corpus.where("deprecated_by IS NULL").agg(F.count("*").cast("double").alias("n"))
    df = postings.groupBy("entity").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # n is one row
    return df.select("entity", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _block_pairs(per_node: int | None, floor: float, top: int, plain: bool, chunk: int = 500_000):
    """The worker of entity_pairs: from the posting lists that reach one block of ids, the pairs of that block's ids.

    With `plain` the ids are whole numbers from 0 on that serve as they are; others are numbered by their order."""

    def starts(a):
        import numpy as np

        return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists, mine = table.column("ids").combine_chunks(), table.column("own").combine_chunks()
        entity, idf = table.column("entity").combine_chunks(), table.column("idf").to_numpy()
        rank = np.empty(len(table), dtype=np.int64)
        rank[pc.sort_indices(table.select(["idf", "entity"]), sort_keys=[("idf", "descending"), ("entity", "ascending")]).to_numpy()] = np.arange(len(table))
        code, own = lists.flatten().to_numpy(zero_copy_only=False), mine.flatten().to_numpy(zero_copy_only=False)
        if not plain:
            code, names = pd.factorize(code, sort=True)
            own = pd.Index(names).get_indexer(own)
        own = own.astype(np.int64)
        size, begin = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        row = np.repeat(np.arange(len(table)), np.diff(mine.offsets.to_numpy()))
        order = np.lexsort((rank[row], own))  # by id, then rarest entity first
        row, own = row[order], own[order]
        del order, rank
        at = starts(own)
        end = np.append(at[1:], len(own))
        work = np.concatenate([[0], np.cumsum(size[row])])
        bits, place = max(1, int(code.max()).bit_length()), int((end - at).max()).bit_length()
        scale = int(top * 1e4 * max(float(idf.max()), 1.0) + 1).bit_length()
        most = 1 << (62 - bits - max(place, scale))  # ids of a chunk
        i = 0
        while i < len(at):
            j = max(i + 1, min(i + most, int(np.searchsorted(work[end], work[at[i]] + chunk))))
            s, e = at[i], end[j - 1]
            r, n, first = row[s:e], size[row[s:e]], at[i:j] - s
            node = np.repeat(np.arange(j - i), end[i:j] - at[i:j])
            where = np.repeat(begin[r] - (work[s:e] - work[s]), n) + np.arange(work[e] - work[s])
            other = code[where].astype(np.int64)
            del where
            good = other > np.repeat(own[s:e], n) if per_node is None else other != np.repeat(own[s:e], n)
            key = (np.repeat(node, n) << (bits + place)) | (other << place) | np.repeat(np.arange(e - s) - first[node], n)
            key = key[good]
            del other, good
            key.sort()
            pair = key >> place
            head = starts(pair)
            tail = np.append(head[1:], len(key))
            weight = np.zeros(len(head))
            for t in range(top):
                has = np.flatnonzero(head + t < tail)
                k = key[head[has] + t]
                weight[has] += idf[r[first[k >> (bits + place)] + (k & ((1 << place) - 1))]]
            weight = np.floor(weight * 1e4 + 0.5).astype(np.int64)
            pick = np.flatnonzero(weight / 1e4 >= floor)
            if per_node is not None and len(pick):
                # one number by id, weight downwards and other id; the order of the other id is that of (source, target)
                ab, span = pair[head[pick]], int(weight[pick].max())
                lane = (((ab >> bits) << (scale + bits)) | ((span - weight[pick]) << bits)) | (ab & ((1 << bits) - 1))
                lane.sort()
                a = lane >> (scale + bits)
                begins = starts(a)
                lane = lane[np.arange(len(a)) - np.repeat(begins, np.diff(np.append(begins, len(a)))) < per_node]
                ab = ((lane >> (scale + bits)) << bits) | (lane & ((1 << bits) - 1))
                pick = np.searchsorted(pair[head], ab)
            a, b = own[at[i:j]][pair[head[pick]] >> bits], pair[head[pick]] & ((1 << bits) - 1)
            count = np.minimum(tail[pick] - head[pick], top)
            offsets = np.concatenate([[0], np.cumsum(count)])
            k = key[np.repeat(head[pick] - offsets[:-1], count) + np.arange(offsets[-1])]
            shared = entity.take(pa.array(r[first[k >> (bits + place)] + (k & ((1 << place) - 1))]))
            kind, name = table.schema.field("ids").type.value_type, (lambda x: x) if plain else names.__getitem__
            yield pa.table({
                "source": pa.array(name(np.minimum(a, b)), kind), "target": pa.array(name(np.maximum(a, b)), kind),
                "shared": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shared), "weight": pa.array(weight[pick] / 1e4),
            })
            i = j

    def block(table):
        import pyarrow as pa

        return pa.concat_tables(run(table))

    return block


def entity_pairs(postings: DataFrame, stats: DataFrame, min_idf: float = 0.7, max_df: int = 200, top: int = 4, floor: float = 0.0, per_node: int | None = None, per_block: int = 1_000_000, per_round: int = 4) -> DataFrame:
    """source, target, shared (the `top` rarest shared entities), weight (their idf sum). Entities above max_df aren't paired: that is the rule of the edge, not a limit on work.

    With per_node, of the pairs at or above the floor only those among the per_node strongest of either end. Pairs are never
    dealt out: ids are split into blocks of about per_block postings, the posting lists (max_df ids at most) go to the blocks
    of their ids, and each block counts its ids' pairs with all others, some ids at a time. As a list goes to several blocks,
    blocks take turns: in a round at most about per_round times the postings are under way, and then they are removed."""
    stats = saved(stats.where((F.col("df") > 1) & F.col("idf").isNotNull()))
    good = stats.where((F.col("idf") >= min_idf) & F.col("df").between(2, max_df)).select("entity", "idf")
    # the commonest entities make up most postings: they are dropped before the join, the others by it
    common = F.broadcast(stats.where(F.col("df") > max_df).orderBy(F.desc("df"), "entity").limit(50_000).select("entity"))
    p = postings.where("id IS NOT NULL").join(common, "entity", "left_anti").join(good, "entity")
    lists = saved(p.groupBy("entity", "idf").agg(F.collect_list("id").alias("ids")))
    kind = postings.schema["id"].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    low, high = (F.min(F.array_min("ids")), F.max(F.array_max("ids"))) if whole else (F.lit(None), F.lit(None))
    n, low, high = lists.agg(F.sum(F.size("ids")), low, high).first()
    # whole numbers of a short range go out as int
    plain = whole and low is not None and high - low < (1 << 31) - 1
    own = "int" if plain else kind
    blocks = max(1, -(-(n or 0) // per_block))
    sent = lists.agg(F.sum(F.size("ids").cast("long") * F.least(F.size("ids"), F.lit(blocks)))).first()[0] or 0
    rounds = min(blocks, max(1, -(-sent // (per_round * max(1, n or 0)))))
    of = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    out = None
    for k in range(rounds):
        ids = lists.withColumn("ids", F.transform("ids", lambda x: (x - F.lit(low)).cast("int"))) if plain else lists
        turn = F.filter(F.array_distinct(F.transform("ids", lambda x: of(x))), lambda b: b % rounds == F.lit(k))  # noqa: B023  used at once
        dealt = ids.select("entity", "idf", "ids", F.explode(turn).alias("block"))
        dealt = dealt.withColumn("own", F.filter("ids", lambda x: of(x) == F.col("block")))
        found = saved(dealt.groupBy("block").applyInArrow(_block_pairs(per_node, floor, top, plain), f"source {own}, target {own}, shared array<string>, weight double"))
        out = found if out is None else out.unionByName(found)
    dropped(lists, stats)
    if plain:
        out = out.withColumns({c: (F.col(c).cast("long") + F.lit(low)).cast(kind) for c in ("source", "target")})
    return out if per_node is None else out.dropDuplicates(["source", "target"])


def entity_edges(pairs: DataFrame, floor: float = 3.0, per_node: int = 10) -> DataFrame:
    """Edges at or above the floor; an edge goes only if both its ends have `per_node` stronger ones, that is, it stays if its rank at either end is within per_node."""
    ok = pairs.where(F.col("weight") >= floor)
    both = ok.select("source", "target", "weight", F.col("source").alias("n")).union(ok.select("source", "target", "weight", F.col("target").alias("n")))
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("weight"), "source", "target"))
    kept = both.withColumn("r", rank).where(F.col("r") <= per_node).select("source", "target").distinct()
    return ok.join(kept, ["source", "target"]).select("source", "target", F.lit("entity").alias("type"), "weight", F.concat(F.lit("共享实体: "), F.array_join("shared", "、")).alias("evidence"))
