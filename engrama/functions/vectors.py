"""Vector scalars: dot product, normalized sums, the hashing encoder (FNV-1a buckets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import lowered

DIM = 512
#: Offset basis and prime of 32-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, in doubles."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def normalize(v: Column) -> Column:
    """v over its L2 norm (a zero norm counts as 1)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def mean_vectors(block_vec: DataFrame) -> DataFrame:
    """id, rep: sum of the block vectors of an id, normalized. Sums by dimension, so nothing is collected per id but the result."""
    parts = block_vec.select("id", F.posexplode("vec").alias("dim", "x")).groupBy("id", "dim").agg(F.sum(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p"))
    return rows.select("id", normalize(F.transform("p", lambda s: s["x"])).alias("rep"))


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a over the characters' code units (characters of the basic plane)."""
    units = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(FNV_BASIS).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def hash_tokens(text: Column) -> Column:
    """Tokens of the encoder: CJK characters and their bigrams, and runs of a-z and 0-9."""
    low = lowered(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit("[\\u3000-\\u9fff\\uf900-\\ufaff]+|[a-z0-9]+"), F.lit(0))
    is_cjk = lambda r: r.rlike("^[\\u3000-\\u9fff\\uf900-\\ufaff]")
    one = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, 1))
    two = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, lambda r: F.when(is_cjk(r), F.concat(one(r), two(r))).otherwise(F.array(r))))


def hash_buckets(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Sparse embedding: key, bucket, value (normalized sums of signs). Texts without tokens have no rows."""
    t = rows.select(*key, F.explode(hash_tokens(F.col(text))).alias("tok"))
    h = t.groupBy(*key, "tok").agg(F.count("*").alias("n")).withColumn("h", fnv1a(F.col("tok")))
    sign = F.when(F.col("h") >= 2147483648, -1).otherwise(1)
    sums = h.groupBy(*key, (F.col("h") % DIM).cast("int").alias("bucket")).agg(F.sum(sign * F.col("n")).cast("double").alias("v")).where("v <> 0")
    norm = sums.groupBy(*key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norm, key).select(*key, "bucket", (F.col("v") / F.col("norm")).alias("value"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)
