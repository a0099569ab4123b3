"""SimHash near-duplicates: fingerprints of 3-word shingles, pigeonhole blocks, Hamming check, components.

A fingerprint has 64 bits. Two that differ in at most `radius` bits agree wholly in at least `blocks - radius` of
`blocks` blocks, so each fingerprint is keyed by every choice of that many blocks, pairs of one key are compared, and
no pair within the radius is missed. Equal fingerprints are one node from the start, so copies cost nothing.

The number of blocks follows the number of fingerprints, so that keys stay selective: 5 (keys of 25 or 26 bits) up to 2^30
fingerprints, 6 (32 bits) up to 2^37, else 7 (36 or 37 bits).

A key that holds more than `crowd` different fingerprints is not compared pair by pair. There, two fingerprints differ
in at most `radius` = 3 of the unkeyed bits if and only if some value lies at most 1 bit from one and at most 2 bits
from the other; so every member is linked to the values within 2 bits, and all members around a value to the smallest
member within 1 bit of it. That is exact and linear in the size of the key.

Nulls and edge cases: null or blank texts have fingerprint zero and link like any other; rows are kept one by one, also
repeated ones; a null doc_id row gets the component of its fingerprint and never names one (component null if it has
no other member); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.components import components
from engrama.llm.shared import marked, marks, stage, table


def simhash64(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text; words are runs of bytes other than ASCII white space, A-Z lower-cased."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*[w[i:] for i in range(shingle)])) if len(w) >= shingle else [b" ".join(w)]
    h = np.fromiter((xxh64_intdigest(g, seed) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, th (a hash of the text) and fp (the fingerprint as signed long) of every row."""

    def run(batches):
        for b in batches:
            fp = [simhash64(t, shingle) for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "fp": pd.Series(fp, dtype="uint64").astype("int64")})

    t = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("th"), t.alias("t")).mapInPandas(run, "id long, th long, fp long")


def block_masks(blocks: int = 5, radius: int = 3, bits: int = 64) -> list[int]:
    """One mask (signed long) per choice of blocks - radius blocks."""
    if blocks <= radius:
        raise ValueError("there must be more blocks than differing bits")
    edges = [bits * i // blocks for i in range(blocks + 1)]
    one = [sum(1 << i for i in range(edges[k], edges[k + 1])) for k in range(blocks)]
    whole = [sum(c) for c in combinations(one, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def blocks_for(n: int, radius: int = 3) -> int:
    return radius + (2 if n <= 1 << 30 else 3 if n <= 1 << 37 else 4)


def hamming_links(nodes: DataFrame, blocks: int = 5, radius: int = 3, crowd: int = 1024) -> DataFrame:
    """nodes: distinct longs `fp`. Gives links (a, b) whose components are those of all pairs within the radius; every
    pair itself, but in keys with over `crowd` members, where links go through hubs (radius 3 only)."""
    masks = block_masks(blocks, radius)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    keyed = stage(keyed, "blocks")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stage(sizes, "block_sizes")
    if radius != 3:
        crowd = 1 << 62
    usual = keyed.join(sizes.where(F.col("n") <= crowd).drop("n"), ["t", "key"], "left_semi")
    x, y = usual.alias("x"), usual.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near)
    links = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    dense = sizes.where(F.col("n") > crowd)
    if dense.isEmpty():
        return links.distinct()
    members = keyed.join(dense.drop("n"), ["t", "key"], "left_semi")
    flips = []
    for m in masks:
        free = [i for i in range(64) if not (m >> i) & 1]
        sign = lambda v: v - (1 << 64) if v >> 63 else v
        flips.append([0] + [sign(1 << i) for i in free] + [sign((1 << i) | (1 << j)) for i, j in combinations(free, 2)])
    frames = []
    for t, fl in enumerate(flips):
        around = F.explode(F.array(*[F.lit(v) for v in fl])).alias("flip")
        hub = members.where(F.col("t") == t).select("fp", around).withColumn("hub", F.col("fp").bitwiseXOR(F.col("flip")))
        frames.append(hub.select("hub", "fp", (F.bit_count("flip") <= 1).alias("close")))
    hubs = stage(_union(frames), "hubs")
    centre = hubs.where("close").groupBy("hub").agg(F.min("fp").alias("a"))
    stars = hubs.join(centre, "hub").where("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    return links.union(stars).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, blocks: int | None = None, radius: int = 3, crowd: int = 1024) -> DataFrame:
    """doc_id, th, fp, component_id for every row of docs."""
    rows = stage(fingerprints(docs, shingle=shingle), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    links = stage(hamming_links(nodes, blocks or blocks_for(nodes.count(), radius), radius, crowd), "near")
    roots = components(links).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stage(named.join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(of, "fp").select(F.col("id").alias("doc_id"), "th", "fp", "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; columns as before.

    Of repeated doc_ids with one text one row stays. Rows without doc_id can't be named and stay.
    """
    return firsts(docs, near_duplicates(docs, **how))


def firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component that found (doc_id, th, component_id) names, as in keep_first."""
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    gone = stage(gone, "gone")
    wanted = marks(gone.select("_t"))

    @F.pandas_udf("boolean")
    def may_go(t: pd.Series) -> pd.Series:
        return pd.Series(marked(wanted.value, t.to_numpy()))

    # only rows that may go meet in the join, so the others aren't shuffled
    left = docs.where(may_go(th)).join(gone, (F.col("doc_id") == F.col("_d")) & (th == F.col("_t")), "left_anti")
    left = docs.where(~may_go(th)).unionByName(left)
    twice = stage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_d")), "twice")
    if twice.isEmpty():
        return left
    once = left.join(twice, left["doc_id"] == twice["_d"], "left_anti")
    return once.unionByName(left.join(twice, left["doc_id"] == twice["_d"], "left_semi").dropDuplicates(["doc_id", "text"]))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
