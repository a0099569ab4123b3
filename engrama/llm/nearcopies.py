"""Near copies by text similarity: min-hash bands for candidates, exact Jaccard similarity of 5-word shingles, components.

Words are those of `simhash`; a text's shingles are the set of its 5-word runs (fewer words: the whole). Two texts whose
sets have a similarity of 0.8 or more are linked. Fingerprints can't find them: at 0.8 about 10 of 64 bits differ, and
blocks that cover such a radius have 4 to 6 bits, so nearly all pairs would be compared. The first candidates are those that
`simhash` links, within 3 bits; they go through the same exact check. The others share one of 30 bands
of 4 min-hashes each; a pair at 0.8 shares none with probability 1.4e-7, a closer one with less. Equal texts are one node.

Components need not all pairs. The hub of a band is its member that meets most others over all its bands (of edited copies
that is the text they come from). First the members of the first two bands are held against their hub, then, in all bands,
members of other components than the hub's. What is left are nodes of bands that still hold several components. These are joined
on prefixes instead of bands: by a common order, rarest shingle first, two sets with a similarity of 0.8 share one of the first
n - ceil(0.8 n) + 1 shingles of each, and the first shared one lies so early that enough can follow. That is exact, whatever
the bands say, and pairs meet on rare shingles only: a copy that is too far from its group leads with its own shingles.

Nulls and edge cases: null and blank texts are copies of each other; rows without doc_id stay, also repeated ones.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrama.llm.components import components
from engrama.llm.shared import drop_stage, marked, marks, stage
from engrama.llm.simhash import blocks_for, hamming_links, simhash64

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 30, 4


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(w: list[bytes], k: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    grams = map(b" ".join, zip(*[w[i:] for i in range(k)])) if len(w) >= k else [b" ".join(w)]
    return np.unique(np.fromiter((xxh64_intdigest(g) for g in grams), dtype="<u8"))


def band_keys(hashes, bands: int = BANDS, rows: int = ROWS):
    """One key for each band of min-hashes."""
    import numpy as np

    rng = np.random.default_rng(17)
    a, b = (rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) for _ in range(2))
    a |= np.uint64(1)
    least = np.full(bands * rows, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096, None] * a + b
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, h.min(axis=0))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + least.reshape(bands, rows)[:, r]
    return key.view(np.int64)


def _node(w: list[bytes]) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(b" ".join(w), 5)
    return h - (1 << 64) if h >> 63 else h


def sketches(docs: DataFrame) -> DataFrame:
    """id, th (a hash of the text), node (a hash of the words), fp (op2's fingerprint), n (distinct shingles) and keys of every row."""

    def run(batches):
        for b in batches:
            out = []
            for t in b["t"]:
                w = words(t)
                s = shingle_set(w)
                out.append((_node(w), simhash64(t), len(s), band_keys(s)))
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "node": [x[0] for x in out], "fp": pd.Series([x[1] for x in out], dtype="uint64").astype("int64"), "n": [x[2] for x in out], "keys": [x[3] for x in out]})

    t = F.col("text")
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("th"), t.alias("t")).mapInPandas(run, "id long, th long, node long, fp long, n long, keys array<long>")


def shingle_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, s (its sorted shingles) for the given distinct nodes. Texts of other nodes are left out before the join, but for a few."""
    nodes = stage(nodes, "wanted")
    wanted = marks(nodes.select("node"))

    def named(batches):
        for b in batches:
            out = pd.DataFrame({"node": pd.Series([_node(words(t)) for t in b["text"]], dtype="int64"), "text": b["text"]})
            yield out[marked(wanted.value, out["node"].to_numpy())]

    def sets(batches):
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "s": [shingle_set(words(t)).view("int64") for t in b["text"]]})

    texts = docs.select("text").mapInPandas(named, "node long, text string").join(nodes, "node", "left_semi")
    return texts.groupBy("node").agg(F.min("text").alias("text")).mapInPandas(sets, "node long, s array<long>")


def similar_pairs(pairs: DataFrame, bags: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets are similar, checked exactly."""
    x, y = bags.select(F.col("node").alias("a"), F.col("s").alias("x")), bags.select(F.col("node").alias("b"), F.col("s").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("c"))
    return both.where(F.col("c") >= similar * (F.col("nx") + F.col("ny") - F.col("c"))).select("a", "b")


def _fits(x, y, similar: float):
    return F.least(x, y) >= similar * F.greatest(x, y)


def prefix_pairs(bags: DataFrame, roots: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of nodes with different roots that can be similar by their prefixes and the place of a shared shingle.

    bags: node, s; roots: node, root. Shingles of one node only lead its order and never meet, so they are only counted.
    """
    rows = bags.join(roots, "node").select("node", "root", F.size("s").alias("n"), F.explode("s").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("m"), (F.min("root") < F.max("root")).alias("mixed")).where("m > 1")
    own = Window.partitionBy("node")
    placed = rows.join(common, "h").withColumn("k", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("m", "h")))
    placed = placed.withColumn("at", F.col("n") - F.col("k") + F.col("r"))
    last = F.col("n") - F.ceil(similar * F.col("n") - 1e-9) + 1
    first = stage(placed.where((F.col("at") <= last) & F.col("mixed")).select("h", "node", "root", "n", "at"), "prefixes", tidy=True)
    x, y = first.alias("x"), first.alias("y")
    need = similar / (1 + similar) * (F.col("x.n") + F.col("y.n")) - 1e-9
    enough = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1 >= need
    meet = (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    pairs = x.join(y, meet & _fits(F.col("x.n"), F.col("y.n"), similar) & enough)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def fingerprint_pairs(nodes: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """nodes: node, fp, n. Pairs (a, b) of nodes that simhash links and whose numbers of shingles allow for the similarity: all nodes of
    a fingerprint with its smallest node, and those of fingerprints within 3 bits with each other."""
    hubs = stage(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("h")).select("fp", "h.*"), "hubs", tidy=True)
    same = nodes.join(hubs.toDF("fp", "b", "m"), "fp").select(F.col("node").alias("a"), F.col("n").alias("k"), "b", "m")
    links = stage(hamming_links(hubs.select("fp"), blocks_for(hubs.count())), "near", tidy=True)
    near = links.join(hubs.toDF("a", "x", "k"), "a").join(hubs.toDF("b", "y", "m"), "b").select(F.col("x").alias("a"), "k", F.col("y").alias("b"), "m")
    fit = same.union(near).where((F.col("a") != F.col("b")) & _fits(F.col("k"), F.col("m"), similar))
    return fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, th, component_id for every row of docs."""
    rows = stage(sketches(docs), "sketches")
    nodes = stage(rows.groupBy("node").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "texts", tidy=True)
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = keyed.join(shared, "key").groupBy("node", "n").agg(F.sum("m").alias("met"), F.collect_list(F.struct("band", "key")).alias("keys"))
    met = stage(met, "bands", tidy=True)
    tried = stage(fingerprint_pairs(nodes.select("node", "fp", "n"), similar), "linked", tidy=True)
    bags = stage(shingle_sets(tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct(), docs), "sets", tidy=True)
    links, of = stage(similar_pairs(tried, bags, similar), "alike", tidy=True), None
    drop_stage(bags)
    for few in (True, False):
        rooted = met.withColumn("root", F.col("node")) if few else met.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = rooted.select("node", "n", "met", "root", F.inline("keys")).where("band < 2" if few else "true")
        hubs = rooted.groupBy("key").agg(F.max(F.struct("met", "node", "n", "root")).alias("h"))
        stars = rooted.join(hubs, "key").where((F.col("root") != F.col("h.root")) & _fits(F.col("n"), F.col("h.n"), similar))
        stars = stars.select(F.least("h.node", "node").alias("a"), F.greatest("h.node", "node").alias("b")).distinct()
        stars = stage(stars.join(tried, ["a", "b"], "left_anti"), "stars", tidy=True)
        bags = stage(shingle_sets(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), docs), "sets", tidy=True)
        found = stage(similar_pairs(stars, bags, similar), "alike", tidy=True)
        drop_stage(bags)
        links, tried = links.union(found), tried.union(stars)
        of = components(links)
    rooted = met.join(of, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.inline("keys"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = stage(rooted.join(mixed, "key", "left_semi").select("node", "root").distinct(), "left", tidy=True)
    bags = stage(shingle_sets(left.select("node"), docs), "sets", tidy=True)
    apart = stage(prefix_pairs(bags, left, similar).join(tried, ["a", "b"], "left_anti"), "apart", tidy=True)
    more = stage(similar_pairs(apart, bags, similar), "alike", tidy=True)
    drop_stage(met, bags)
    if not more.isEmpty():
        of = components(links.union(more))
    named = nodes.join(of, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(named.join(least, "root").select("node", "component_id"), "classes")
    return rows.select("id", "th", "node").join(classes, "node").select(F.col("id").alias("doc_id"), "th", "component_id")
