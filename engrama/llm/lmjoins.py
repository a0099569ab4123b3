"""Language-model scores by stupid backoff over a trigram model of the corpus itself, as joins of count tables.

The scores are those of `lmscore`, which the query uses; here every n-gram is a row and Catalyst plans the joins.

S(c | ab) = n(abc) / n(ab) if n(abc) >= 2, else 0.4 S(c | b); S(c | b) = n(bc) / n(b) if n(bc) >= 2, else 0.4 n(c) / N.
A document's total is the sum of log S over its words. That sum is taken apart so that each order needs one join only:

* every word adds log n(c) (with 2 log 0.4 - log N; the first two words of a text back off less, a constant);
* every bigram that occurs twice or more adds what it is better than its unigram: a value of the bigram alone;
* every trigram that occurs twice or more adds what it is better than its bigram: a value of the trigram alone.

So each order is a count table partitioned by a hash of the n-gram, counted with partial sums, turned into values, and joined
to the exploded n-grams; the values are summed per document before the next exchange. Trigrams and bigrams go through in
`passes` ranges of their hash, one at a time, and each range's shuffle files are removed when it is done, so the disk holds
one range of one order. N-grams with at least a `hot`-th of all words are `hot` at most; their values are broadcast and their
occurrences never leave the document's task, so no key is large in the exchange of the others.

Documents are lower-cased (A-Z); words are runs of anything but U+0020 and U+0009 to U+000D; n-grams don't cross documents.
Counts are over all documents; words and n-grams are told apart by 64-bit hashes. Values are whole multiples of 1e-9, so the
order of adding doesn't matter.

Nulls and edge cases: null and blank texts have no words, total 0 and score 0; null doc_ids and repeated rows are scored row
by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import SPACE_RUN, SPACES, drop_stage, stage

BACKOFF, LEAST, UNIT = 0.4, 2, 1e9
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokens(docs: DataFrame) -> DataFrame:
    """uid, doc_id, h (64-bit hashes of the words in order) of every row."""
    low = F.translate(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)), UPPER, UPPER.lower())
    words = F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, SPACE_RUN))
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("h"))


def exploded(words: DataFrame, order: int) -> DataFrame:
    """uid, g (hash of the n-gram) and its words w1, w2, ... for every n-gram of every document."""
    each = words.where(F.size("h") >= order).select("uid", "h", F.posexplode("h").alias("i", "last")).where(F.col("i") >= order - 1)
    parts = [*[F.get("h", F.col("i") - k) for k in range(order - 1, 0, -1)], F.col("last")]
    named = each.select("uid", *[p.alias(f"w{k + 1}") for k, p in enumerate(parts)])
    return named.withColumn("g", F.col("w1") if order == 1 else F.xxhash64(*[f"w{k + 1}" for k in range(order)]))


def _range(df: DataFrame, k: int, passes: int) -> DataFrame:
    """The k-th of the ranges of g."""
    return df if passes == 1 else df.where(F.pmod("g", F.lit(passes)) == k)


def _ln(c: str) -> Column:
    return F.log(F.col(c).cast("double"))


def _units(c: Column) -> Column:
    return F.round(c * UNIT).cast("long").alias("v")


def _summed(words: DataFrame, order: int, values: DataFrame, total: int, hot: int, passes: int, tag: str) -> list[DataFrame]:
    """uid, v: for every document the sum of the values (g, n, v) of its n-grams, in parts."""
    frequent = F.col("n") * F.lit(hot) >= F.lit(total)
    own = exploded(words, order).select("uid", "g")
    few = F.broadcast(values.where(frequent).select("g", "v"))  # `hot` rows at most, by the condition
    parts = [stage(own.join(few, "g").groupBy("uid").agg(F.sum("v").alias("v")), f"{tag}_hot", tidy=True)]
    rest = values.where(~frequent).select("g", "v")
    others = own.join(F.broadcast(values.where(frequent).select("g")), "g", "left_anti")
    for k in range(passes):
        found = _range(others, k, passes).join(_range(rest, k, passes), "g")
        parts.append(stage(found.groupBy("uid").agg(F.sum("v").alias("v")), f"{tag}_{k}", tidy=True))
    return parts


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def score(docs: DataFrame, hot: int = 65_536, passes: int = 4) -> DataFrame:
    """doc_id, n_words, score (mean log S per word) and total (sum of log S) of every row."""
    back = math.log(BACKOFF)
    words = stage(tokens(docs), "lm_words", tidy=True, **{"parquet.dictionary.page.size": str(16 << 20), "parquet.block.size": str(32 << 20)})
    total = words.agg(F.sum(F.size("h").cast("long")).alias("n")).first()["n"] or 0
    log_total = math.log(max(total, 1))

    one = stage(exploded(words, 1).groupBy("g").agg(F.count("*").alias("n")), "lm_1", tidy=True)
    parts = _summed(words, 1, one.select("g", "n", _units(_ln("n"))).where("n > 1"), total, hot, max(passes // 2, 1), "lm_sum1")
    first, last = one.select(F.col("g").alias("w1"), F.col("n").alias("n1")), one.select(F.col("g").alias("w2"), F.col("n").alias("n2"))

    ranges = []
    for k in range(passes):
        seen = _range(exploded(words, 2), k, passes).groupBy("w1", "w2").agg(F.count("*").alias("n"), F.first("g").alias("g")).where(F.col("n") >= LEAST)
        value = _ln("n") - _ln("n1") - _ln("n2") + F.lit(log_total - back)
        ranges.append(stage(seen.join(first, "w1").join(last, "w2").select("g", "n", "n1", _units(value)), f"lm_2_{k}", tidy=True))
    two = _union(ranges)
    parts += _summed(words, 2, two, total, hot, passes, "lm_sum2")
    left = two.select(F.col("g").alias("ga"), F.col("n").alias("nab"))
    right = two.select(F.col("g").alias("gb"), F.col("n").alias("nbc"), F.col("n1").alias("nb"))

    three = []
    for k in range(passes):
        seen = _range(exploded(words, 3), k, passes).groupBy("w1", "w2", "w3").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
        keyed = seen.select("n", F.xxhash64("w1", "w2", "w3").alias("g"), F.xxhash64("w1", "w2").alias("ga"), F.xxhash64("w2", "w3").alias("gb"))
        # a trigram that occurs twice has bigrams that occur twice, so no row is lost here
        value = _ln("n") - _ln("nab") - F.lit(back) - _ln("nbc") + _ln("nb")
        three.append(stage(keyed.join(left, "ga").join(right, "gb").select("g", "n", _units(value)), f"lm_3_{k}", tidy=True))
    parts += _summed(words, 3, _union(three), total, hot, passes, "lm_sum3")

    size = F.size("h").cast("long")
    start = size * F.lit(2 * back - log_total) - F.when(size > 1, 3 * back).when(size == 1, 2 * back).otherwise(0.0)
    base = words.select("uid", "doc_id", size.alias("n_words"), _units(start))
    named = base.select("uid", "doc_id", "n_words", "v").unionByName(_union(parts).select("uid", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("n_words"), "v"))
    out = named.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), (F.sum("v") / F.lit(UNIT)).alias("s"))
    out = out.select(
        "doc_id", "n_words", F.when(F.col("n_words") > 0, F.round(F.col("s") / F.col("n_words"), 6)).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("n_words") > 0, F.round("s", 4)).otherwise(F.lit(0.0)).alias("total"),
    )
    out = stage(out, "lm_scores", tidy=True)
    drop_stage(words, one, *ranges, *three, *parts)
    return out
