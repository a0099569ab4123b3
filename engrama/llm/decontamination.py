"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Texts and items are lower-cased and cut into words (letters, digits, underscores). A window has as many words as the
item it is held against, and its weighted shingles are its 5-word runs (fewer words: the whole) with their multiplicity.
Similarity is sum of minima over sum of maxima; 0.8 or more is a leak.

Windows get 64-bit SimHashes, by running sums of their shingles' bits. To share that work, an item of 12 words or more stands
in the index with 4 fingerprints, those of its parts from word 0, 1, 2, 3 on, and texts are fingerprinted at every 4th word:
whatever an item's start in a text, one of its parts starts at such a word. Part sizes are the largest multiple of 4 that all
four parts have. Items of less words are held against every window of their size.

Candidates come from the fingerprints alone: these are cut into 4 blocks of 16 bits, and a window looks up each block's value
in a table of all values within the block's radius of an item's. If two fingerprints differ in `radius` = 4 q + a bits at most,
one of the first a + 1 blocks differs in q bits at most or one of the others in q - 1, so the look-up gives all items within the
radius; their whole distance is checked, and what passes is verified exactly at the item's full size, with the windows up to 4
words away, of which the best counts.

The radius is 15. Similarity 0.8 gives 9.7 differing bits on average; of altered items with similarity 0.8 or more, the tests ask
for over 0.95 of those that brute force finds (README: measured recall).

With `short_texts`, as the query and the pipeline have it, a text with fewer words than an item is its one window; without,
it holds no window of the item. Such a text's fingerprint is compared with those of the longer items directly.

Items are taken in blocks of at most `block_rows`; each block is a pass over the documents, so memory is bounded by it.
Texts are taken in slices of words that overlap by the longest window, so a long text needs no more memory than others.

Nulls and edge cases: null or blank texts and items match nothing; a null item_id is reported as null; items that are
equal are reported each; repeated documents are reported each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from engrama.llm.shared import table

WORD = re.compile(r"\w+")
SHINGLE, SIMILAR, RADIUS, BLOCKS, NEAR, STRIDE = 5, 0.8, 15, 4, 4, 4
#: Words in a slice.
SLICE = 32_768


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str], k: int = SHINGLE) -> Counter:
    k = min(k, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def word_hashes(words: list[str]):
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def grams(h, k: int):
    """64-bit hashes of the runs of k words."""
    n = len(h) - k + 1
    g = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        g = (g ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    g *= np.uint64(0xC2B2AE3D27D4EB4F)
    return g ^ (g >> np.uint64(32))


def bit_sums(g, most: int):
    """Running sums of the bits of g, modulo a number over `most`; row i holds those of the first i."""
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    bits = np.unpackbits(g.view(np.uint8), bitorder="little").reshape(-1, 64)
    out = np.zeros((len(g) + 1, 64), dtype=kind)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def window_prints(sums, m: int, stride: int = 1):
    """SimHash of the windows of m shingles that start at every stride-th: a bit is 1 if set in over half of them."""
    over = (sums[m:][::stride] - sums[:-m][::stride]) > m // 2
    return np.packbits(over.reshape(-1), bitorder="little").view("<u8")


def fingerprint(words: list[str], shingle: int = SHINGLE) -> int:
    g = grams(word_hashes(words), min(shingle, len(words)))
    return int(window_prints(bit_sums(g, len(g)), len(g))[0])


def part_size(size: int) -> tuple[int, int]:
    """(size of an item's parts, their number)."""
    return (size, 1) if size < 12 else ((size - STRIDE + 1) // STRIDE * STRIDE, STRIDE)


class HammingBlocks:
    """Fingerprints by the values of their 16-bit blocks, each with all values within the block's share of the radius."""

    def __init__(self, prints: list[int], radius: int):
        self.prints, self.radius = np.array(prints, dtype=np.uint64), radius
        q, a = divmod(radius, BLOCKS)
        self.tables = []
        for b in range(BLOCKS):
            bits = q if b <= a else q - 1
            flips = np.array([sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(16), n)], dtype=np.uint16)
            values = (self.prints >> np.uint64(16 * b)).astype(np.uint16)
            keys = (values[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange((1 << 16) + 1))
            self.tables.append((starts[:-1].astype(np.int32), np.diff(starts).astype(np.int32), (order // max(len(flips), 1)).astype(np.int32)))

    def within(self, found):
        """(places in found, places in prints) of the pairs within the radius; a pair may come several times."""
        at, to = [], []
        for b, (starts, counts, entries) in enumerate(self.tables):
            values = found.view(np.uint16).reshape(-1, BLOCKS)[:, b]
            n = counts[values]
            p = np.flatnonzero(n)
            n = n[p]
            ends = np.cumsum(n)
            right = entries[np.arange(ends[-1] if len(n) else 0) + np.repeat(starts[values[p]] - ends + n, n)]
            near = np.flatnonzero(np.bitwise_count(np.repeat(found[p], n) ^ self.prints[right]) <= self.radius)
            at.append(p[np.searchsorted(ends, near, side="right")])
            to.append(right[near])
        return np.concatenate(at), np.concatenate(to)


class Index:
    """Items of one block. The tables are made where they are used and don't travel."""

    def __init__(self, items: list[tuple], shingle: int = SHINGLE, similar: float = SIMILAR, radius: int = RADIUS, short_texts: bool = False):
        self.k, self.similar, self.radius, self.short_texts = shingle, similar, radius, short_texts
        self.items = [(item_id, words) for item_id, text in items if (words := tokens(text))]
        self.groups: dict | None = None

    def __getstate__(self):
        return self.__dict__ | {"groups": None}

    def make(self) -> None:
        self.groups, by_part = {}, defaultdict(list)
        self.bags = [shingles(w, self.k) for _, w in self.items]
        self.vocabulary = [set(w) for _, w in self.items]
        self.sizes = np.array([len(w) for _, w in self.items], dtype=np.int64)
        self.whole = np.array([fingerprint(w, self.k) for _, w in self.items], dtype=np.uint64)
        for n, (_, w) in enumerate(self.items):
            s, parts = part_size(len(w))
            for offset in range(parts):
                by_part[s, parts].append((fingerprint(w[offset : offset + s], self.k), n, offset))
        for key, found in sorted(by_part.items()):
            items, offsets = (np.array([x[i] for x in found], dtype=np.int64) for i in (1, 2))
            self.groups[key] = (HammingBlocks([x[0] for x in found], self.radius), items, offsets)
        self.longest = max((s for s, _ in self.groups), default=0)

    def scan(self, slices: list[tuple], hits: dict) -> None:
        """slices: (document, first word, hashes). Adds the starts of candidate windows to hits, by document and item."""
        h = np.concatenate([x[2] for x in slices])
        doc = np.repeat(np.array([x[0] for x in slices]), [len(x[2]) for x in slices])
        part = np.repeat(np.arange(len(slices)), [len(x[2]) for x in slices])
        place = np.concatenate([np.arange(x[1], x[1] + len(x[2])) for x in slices])
        sums = {}
        for (s, stride), (blocks, items, offsets) in self.groups.items():
            if len(h) < s:
                continue
            k = min(self.k, s)
            if k not in sums:
                sums[k] = bit_sums(grams(h, k), max(self.longest, self.k))
            at, to = blocks.within(window_prints(sums[k], s - k + 1, stride))
            at *= stride
            if len(at):
                own = np.flatnonzero(part[at] == part[at + s - 1])
                at, to = at[own], to[own]
                for d, i, p in zip(doc[at].tolist(), items[to].tolist(), (place[at] - offsets[to]).tolist()):
                    hits.setdefault((d, i), set()).add(p)

    def best(self, words: list[str], item: int, starts: set[int]) -> tuple | None:
        """(start, words, similarity) of the best leak among the candidate windows and their neighbours."""
        size = min(len(self.items[item][1]), len(words))
        k, last, vocabulary = min(self.k, size), len(words) - size, self.vocabulary[item]
        own, bag = sum(self.bags[item].values()), self.bags[item]
        # similarity is at most c / (n + own - c) for c shared shingles
        need = (size - k + 1 + own) * self.similar / (1 + self.similar) - 1e-9
        seen: dict[int, float] = {}

        def look(p: int) -> float:
            if p not in seen:
                window = words[p : p + size]
                seen[p] = similarity(shingles(window, self.k), bag) if sum(w in vocabulary for w in window) >= 0.75 * need else 0.0
            return seen[p]

        for p in sorted({min(max(p, 0), last) for p in starts}):
            if look(p) >= 0.75 * self.similar:
                for near in range(max(p - NEAR, 0), min(p + NEAR, last) + 1):
                    look(near)
        found = max(seen.items(), key=lambda x: (x[1], -x[0]), default=(0, 0.0))
        return (found[0], size, found[1]) if found[1] >= self.similar else None

    def short(self, texts: dict[int, list[str]], hits: dict) -> None:
        """Whole texts against longer items, by the whole fingerprints."""
        for d, words in texts.items():
            n, k = len(words), min(self.k, len(words))
            # only items of which so few words can be similar
            fits = np.flatnonzero((self.sizes > n) & (self.sizes - k + 1 <= (n - k + 1) / self.similar + 1e-9))
            if len(fits):
                mine = np.uint64(fingerprint(words, self.k))
                for i in fits[np.bitwise_count(self.whole[fits] ^ mine) <= self.radius].tolist():
                    hits.setdefault((d, i), set()).add(0)

    def leaks_of(self, texts: list) -> list[list[tuple]]:
        """For each text (item_id, start word, words, similarity) of the best window of each item with a leak, in order of items."""
        if self.groups is None:
            self.make()
        out: list[list[tuple]] = [[] for _ in texts]
        hits: dict[tuple[int, int], set[int]] = {}
        kept: dict[int, list[str]] = {}
        slices, size = [], 0

        def flush():
            nonlocal slices, size
            if slices:
                self.scan(slices, hits)
            if self.short_texts:
                self.short({d: w for d, w in kept.items() if len(w) < self.sizes.max(initial=0)}, hits)
            for (d, i), starts in sorted(hits.items()):
                words = kept[d]
                if (self.short_texts or len(words) >= self.sizes[i]) and (leak := self.best(words, i, starts)):
                    out[d].append((self.items[i][0], *leak))
            slices, size = [], 0
            hits.clear()
            kept.clear()

        for d, t in enumerate(texts):
            words = tokens(t)
            if not words or not self.groups:
                continue
            h, step = word_hashes(words), max(SLICE, 4 * self.longest)
            kept[d] = words
            for p in range(0, len(h), step):
                # parts of an item that starts here may start up to STRIDE - 1 words later
                piece = h[p : p + step + self.longest + STRIDE - 2]
                slices.append((d, p, piece))
                size += len(piece)
                if size >= step and p + step < len(h):
                    self.scan(slices, hits)
                    slices, size = [], 0
            if size >= step:
                flush()
        flush()
        return out

    def leaks(self, text: str | None) -> list[tuple]:
        return self.leaks_of([text])[0]


def leak_column(text: Column, index_bc) -> Column:
    """Struct of the arrays items, starts, sizes, similarities."""

    @F.pandas_udf("items array<bigint>, starts array<int>, sizes array<int>, similarities array<double>")
    def run(t: pd.Series) -> pd.DataFrame:
        found = index_bc.value.leaks_of(list(t))
        cols = ("items", "starts", "sizes", "similarities")
        return pd.DataFrame({c: [[x[i] for x in f] for f in found] for i, c in enumerate(cols)})

    return run(text)


def item_blocks(items: DataFrame, block_rows: int = 2_000, short_texts: bool = False):
    """Indexes of about block_rows items each, as broadcast variables; duplicates of (item_id, text) count once."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    n = -(-items.count() // block_rows)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Index([tuple(r) for r in rows], short_texts=short_texts))


def leaks(docs: DataFrame, items: DataFrame, block_rows: int = 2_000, short_texts: bool = False) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start_word, n_words, similarity."""
    out = None
    for bc in item_blocks(items, block_rows, short_texts):
        hit = docs.select("doc_id", leak_column(F.col("text"), bc).alias("x"))
        rows = hit.select("doc_id", F.explode(F.arrays_zip("x.items", "x.starts", "x.sizes", "x.similarities")).alias("y"))
        rows = rows.select(
            "doc_id", F.col("y.items").alias("item_id"), F.col("y.starts").alias("start_word"), F.col("y.sizes").alias("n_words"),
            F.round("y.similarities", 6).alias("similarity"),
        )
        out = rows if out is None else out.union(rows)
    if out is None:
        out = docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")).where("false")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, block_rows: int = 2_000, short_texts: bool = False) -> DataFrame:
    """docs without the rows that hold an item; columns as before."""
    out = docs
    for bc in item_blocks(items, block_rows, short_texts):
        out = out.where(F.size(leak_column(F.col("text"), bc)["items"]) == 0)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_texts=True)
