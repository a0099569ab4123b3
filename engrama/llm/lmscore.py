"""Language-model scores by stupid backoff over a trigram model of the corpus itself, in blocks of n-grams.

Every word occurrence b with its neighbours a and c is one record. Records are dealt out by a hash of b, so one bucket
holds all occurrences of its words: the counts of b, ab, bc and abc are complete there, and the bucket's count tables are
joined to its own exploded n-grams. That gives, without a second look-up, the trigram and bigram terms for predicting c, and
the unigram term for b where the bigram ab was too rare. A document's total is the sum of its terms over all buckets.

Records travel in rows of typed columns, one row per `chunk` of words and bucket: the distinct word hashes, and for each
record the places of a, b, c among them and the step to its document. `lmjoins` has the same scores with a row per n-gram
and joins by Spark; that form takes over twice the time and more disk (figures in the README), so the query uses this one.

Words with more than a share `hot` / buckets of all occurrences would fill one bucket; the few there can be (at most
buckets / hot) are found by exact unigram counts first. Their records go out twice, once by (a, b) with the tables of ab
and abc, once by (b, c) with those of bc and abc; the count of b comes from the list. There are `buckets` buckets, and one
per `per_bucket` words from there on, so a task's memory is bounded; buckets go through in `passes` groups, and each group's
shuffle files are removed when it is done.

S(c | ab) = n(abc) / n(ab) if n(abc) >= 2, else 0.4 S(c | b); S(c | b) = n(bc) / n(b) if n(bc) >= 2, else 0.4 n(c) / N.
Documents are lower-cased (A-Z); n-grams don't cross documents; a text's first word has the unigram term only. Counts
are over all documents; n-grams are told apart by 64-bit hashes.

Nulls and edge cases: null and blank texts have no words and score 0; null doc_ids and repeated rows are scored row by
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.shared import stage, table

BACKOFF, LEAST = 0.4, 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Numbers(dict):
    """Gives each new word the next number."""

    def __missing__(self, word):
        n = self[word] = len(self) + 1
        return n


def mix(*parts):
    """64-bit hash of arrays of 64-bit hashes, order kept."""
    import numpy as np

    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return h


def unigrams(docs: DataFrame) -> DataFrame:
    """word hash, n."""

    def run(batches):
        from xxhash import xxh64_intdigest

        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(words_of(t))
            if len(seen) > 600_000:
                yield from flush(seen, xxh64_intdigest)
        yield from flush(seen, xxh64_intdigest)

    def flush(seen, digest):
        rows = [digest(w) for w in seen]
        yield pd.DataFrame({"h": pd.Series(rows, dtype="uint64").astype("int64"), "n": pd.Series(list(seen.values()), dtype="int64")})
        seen.clear()

    return docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


BLOCK = "bucket int, kind string, uid long, words binary, a binary, b binary, c binary, doc binary, ids array<long>, sizes array<long>"


def explode_ngrams(docs: DataFrame, buckets: int, hot: set[int], chunk: int, turn: int = 0, passes: int = 1) -> DataFrame:
    """Rows of BLOCK: the records of one chunk, bucket and kind, for buckets of this turn; in turn 0 also the documents."""

    def run(batches):
        import numpy as np
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        uid = TaskContext.get().partitionId() << 36
        numbers, parts, ids, counts = Numbers(), [], [], []
        hot_list = np.array(sorted(hot), dtype=np.uint64)

        def flush():
            nonlocal numbers, parts, ids, counts, uid
            n, rows = np.array(counts, dtype=np.int64), []
            if turn == 0:
                rows.append((uid % buckets, "documents", uid, *[None] * 5, ids, counts))
            b = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            if len(b):
                doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
                a, c = np.zeros_like(b), np.zeros_like(b)
                same = doc[1:] == doc[:-1]
                a[1:][same] = b[:-1][same]
                c[:-1][same] = b[1:][same]
                h = np.zeros(len(numbers) + 1, dtype=np.uint64)
                h[1:] = np.fromiter((xxh64_intdigest(w) for w in numbers), dtype=np.uint64, count=len(numbers))
                is_hot = np.isin(h, hot_list)[b] if len(hot_list) else np.zeros(len(b), bool)
                cold, warm = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
                right = warm[c[warm] > 0]
                for kind, at, key in (("both", cold, mix(h)[b[cold]]), ("left", warm, mix(h[b[warm]], h[a[warm]])), ("right", right, mix(h[b[right]], h[c[right]]))):
                    to = (key % np.uint64(buckets)).astype(np.int32)
                    mine = np.flatnonzero(to % passes == turn)
                    at, to = at[mine], to[mine]
                    order = np.argsort(to, kind="stable")
                    at, to = at[order], to[order]
                    for lo, hi in zip(*_runs(to)):
                        own = at[lo:hi]
                        used, index = np.unique(np.concatenate([a[own], b[own], c[own]]), return_inverse=True)
                        places = [packed(x) for x in index.reshape(3, -1)]
                        # steps from document to document are small numbers
                        rows.append((int(to[lo]), kind, uid, h[used].tobytes(), *places, packed(np.diff(doc[own], prepend=0)), None, None))
            uid += len(n)
            numbers, parts, ids, counts = Numbers(), [], [], []
            names = [x.split()[0] for x in BLOCK.split(", ")]
            for i in range(0, len(rows), 64):
                yield pd.DataFrame({x: pd.Series([r[k] for r in rows[i : i + 64]], dtype="int32" if k == 0 else "int64" if k == 2 else object) for k, x in enumerate(names)})

        size = 0
        for batch in batches:
            for d, t in zip(batch["doc_id"], batch["text"]):
                w = words_of(t)
                for i in range(0, max(len(w), 1), 1 << 20):
                    part = np.fromiter(map(numbers.__getitem__, w[i : i + (1 << 20)]), dtype=np.int32)
                    parts.append(part)
                ids.append(None if d is None else int(d))
                counts.append(len(w))
                size += len(w)
                if size >= chunk:
                    yield from flush()
                    size = 0
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, BLOCK)


def packed(numbers) -> bytes:
    """Non-negative numbers under 2^32, compressed byte by byte: the number of planes, then the lowest bytes of all, and so on."""
    import numpy as np
    import zstandard

    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = max((i + 1 for i in range(4) if raw[:, i].any()), default=1)
    return zstandard.ZstdCompressor(level=3).compress(bytes([planes]) + raw[:, :planes].T.tobytes())


def unpacked(blob: bytes):
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros(planes.shape[1], dtype=np.int64)
    for i, p in enumerate(planes):
        out |= p.astype(np.int64) << (8 * i)
    return out


def _runs(sorted_values):
    """Starts and ends of the runs of equal values."""
    import numpy as np

    cut = np.flatnonzero(np.diff(sorted_values)) + 1
    return np.concatenate([[0], cut]) if len(sorted_values) else cut, np.concatenate([cut, [len(sorted_values)]]) if len(sorted_values) else cut


def _counts(*parts, valid=None):
    """How often each row's key occurs; 0 for rows that aren't valid."""
    import numpy as np

    key = mix(*parts)
    if valid is not None:
        out = np.zeros(len(key), dtype=np.int64)
        at = np.flatnonzero(valid)
        _, inverse, n = np.unique(key[at], return_inverse=True, return_counts=True)
        out[at] = n[inverse]
        return out
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[inverse]


def terms(kind: str, a, b, c, total: int, hot_counts: dict[int, int]):
    """Log terms of the records of one bucket and kind; a or c is 0 where there is no neighbour."""
    import numpy as np

    has_a, has_c = a > 0, c > 0
    log = lambda n: np.log(np.maximum(n, 1).astype(np.float64))
    if kind == "both":
        n_b = _counts(b)
    else:
        keys = np.array(sorted(hot_counts), dtype=np.uint64)
        n_b = np.array([hot_counts[k] for k in sorted(hot_counts)])[np.searchsorted(keys, b)]
    n_abc = _counts(a, b, c, valid=has_a & has_c)
    tri = n_abc >= LEAST
    out = np.zeros(len(b))
    if kind != "right":
        n_ab = _counts(a, b, valid=has_a)
        out += np.where(tri, log(n_abc) - log(n_ab), 0.0)
        out += np.where(has_a, np.where(n_ab < LEAST, log(n_b), 0.0), log(n_b) - math.log(total))
    if kind != "left":
        n_bc = _counts(b, c, valid=has_c)
        alpha = math.log(BACKOFF)
        lower = np.where(n_bc >= LEAST, log(n_bc) - log(n_b), alpha - math.log(total)) + np.where(has_a, alpha, 0.0)
        out += np.where(has_c & ~tri, lower, 0.0)
    return out


def score(docs: DataFrame, buckets: int = 64, per_bucket: int = 3_000_000, hot: float = 0.5, chunk: int = 2_000_000, passes: int = 2) -> DataFrame:
    """doc_id, n_words, score (mean log S per word) and total (sum of log S) of every row."""
    counts = stage(unigrams(docs), "unigrams", tidy=True)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    p = max(buckets, -(-total // per_bucket))
    often = counts.where(F.col("n") > F.lit(total * hot / p)).collect()  # p / hot rows at most
    hot_counts = {r["h"] % (1 << 64): r["n"] for r in often}

    def run(batches):
        import numpy as np

        held: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.kind == "documents":
                    ids = pd.Series([None if x is None or x != x else int(x) for x in r.ids], dtype="Int64")
                    yield pd.DataFrame({"uid": np.arange(r.uid, r.uid + len(ids)), "doc_id": ids, "n": np.asarray(r.sizes, dtype=np.int64), "part": 0.0})
                else:
                    held.setdefault((r.bucket, r.kind), []).append(r)
        while held:
            (_, kind), found = held.popitem()
            a, b, c = (np.concatenate([np.frombuffer(r.words, dtype=np.uint64)[unpacked(getattr(r, x))] for r in found]) for x in "abc")
            got, at = terms(kind, a, b, c, total, hot_counts), 0
            for r in found:
                doc = np.cumsum(unpacked(r.doc))
                sums = np.bincount(doc, weights=got[at : at + len(doc)])
                here = np.flatnonzero(np.bincount(doc))
                at += len(doc)
                yield pd.DataFrame({"uid": here + r.uid, "doc_id": pd.Series([None] * len(here), dtype="Int64"), "n": 0, "part": sums[here]})

    # parts are added as whole multiples of 1e-9, so that their order doesn't matter
    exact, found = F.round(F.col("part") * 1e9).cast("long"), []
    for k in range(passes):
        blocks = explode_ngrams(docs, p, set(hot_counts), chunk, k, passes).repartition(-(-p // passes), "bucket")
        parts = blocks.mapInPandas(run, "uid long, doc_id long, n long, part double")
        added = parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.sum(exact).alias("s"))
        found.append(stage(added, f"lm_{k}", tidy=True))
    whole = found[0]
    for f in found[1:]:
        whole = whole.union(f)
    out = whole.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n_words"), (F.sum("s") / F.lit(1e9)).alias("s"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("s") / F.col("n_words"), 6)).otherwise(F.lit(0.0))
    return out.select("doc_id", "n_words", mean.alias("score"), F.round("s", 4).alias("total"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


OP3_SQL = """WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  t AS (SELECT doc_id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
  n AS (SELECT count(*) AS total FROM t),
  c1 AS (SELECT c, count(*) AS n1 FROM t GROUP BY c), c2 AS (SELECT b, c, count(*) AS n2 FROM t WHERE b IS NOT NULL GROUP BY b, c),
  c3 AS (SELECT a, b, c, count(*) AS n3 FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
  s AS (SELECT t.doc_id, CASE WHEN n3 >= 2 THEN ln(n3 / x2.n2) WHEN c2.n2 >= 2 THEN CASE WHEN t.a IS NULL THEN 0 ELSE ln(0.4) END + ln(c2.n2 / x1.n1)
      ELSE CASE WHEN t.b IS NULL THEN 0 WHEN t.a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END + ln(c1.n1 / total) END AS s
    FROM t JOIN c1 ON c1.c = t.c CROSS JOIN n LEFT JOIN c2 ON c2.b = t.b AND c2.c = t.c LEFT JOIN c3 ON c3.a = t.a AND c3.b = t.b AND c3.c = t.c
    LEFT JOIN c2 x2 ON x2.b = t.a AND x2.c = t.b LEFT JOIN c1 x1 ON x1.c = t.b)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CASE WHEN len(w) > 0 THEN round(total_s / len(w), 6) ELSE 0.0 END AS score, round(coalesce(total_s, 0), 4) AS total
FROM d LEFT JOIN (SELECT doc_id, sum(s) AS total_s FROM s GROUP BY doc_id) USING (doc_id)"""
