"""Ranking memories for a batch of queries: BM25, keywords, vectors, usage, recency, and seven variants over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions.text import WORD, bm25_tokens, lowered, title, word_tokens
from engrama.operators.iterate import saved
from engrama.sources.memories import active

VARIANTS = ("baseline", "dense", "bm25", "rrf", "mix", "hybrid", "hybrid_mmr")
MIX = {"dense": 0.6, "bm25": 0.1, "kw": 0.3}
MIX_CHAT = {"dense": 0.7, "bm25": 0.2, "kw": 0.1}


def bm25_index(mem: DataFrame, pattern: str = WORD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """tf (id, term, tf), doc_len (id, dl), term_df (term, df), corpus (n, avgdl). Texts are cut into terms once; the rest follows from tf."""
    live = active(mem)
    toks = live.select("id", F.explode(bm25_tokens(F.col("text"), pattern)).alias("term"))
    tf = saved(toks.groupBy("id", "term").agg(F.count("*").alias("tf")))
    own = tf.groupBy(F.col("id").alias("_i")).agg(F.sum("tf").alias("_n"))
    dl = saved(live.select("id").join(own, F.col("id") == F.col("_i"), "left").select("id", F.coalesce("_n", F.lit(0)).cast("long").alias("dl")))
    return tf, dl, tf.groupBy("term").agg(F.count("*").alias("df")), dl.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))


def bm25_scores(queries: DataFrame, index, pattern: str = WORD, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, id, bm25 of documents that share a term with the query."""
    tf, dl, df, corpus = index
    q = queries.select("qid", F.explode(F.array_distinct(bm25_tokens(F.col("query"), pattern))).alias("term"))
    asked = q.select("term").distinct()
    # only the queries' terms matter; few of them are sent to the index, more are joined
    asked = F.broadcast(asked) if asked.limit(100_001).count() <= 100_000 else asked
    hit = tf.join(asked, "term", "left_semi").join(df.join(asked, "term", "left_semi"), "term").join(dl, "id").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    part = hit.select("id", "term", (idf * F.col("tf") * (k1 + 1) / norm).alias("x"))
    return part.join(q, "term").groupBy("qid", "id").agg(F.sum("x").alias("bm25"))


def contained_words(texts: DataFrame, words: list[str]) -> DataFrame:
    """id, term: which of the words each text (id, text) contains, by one pass of an automaton over the text."""
    held = texts.sparkSession.sparkContext.broadcast(sorted(set(words)))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for w in held.value:
            found.add_word(w, w)
        if held.value:
            found.make_automaton()
        for b in batches:
            ids, terms = [], []
            for i, t in zip(b["id"], b["text"]):
                own = {w for _, w in found.iter(t)} if held.value and t else ()
                ids += [i] * len(own)
                terms += own
            yield pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype), "term": pd.Series(terms, dtype=object)})

    return texts.select("id", "text").mapInPandas(run, f"id {kind}, term string")


def keyword_scores(queries: DataFrame, mem: DataFrame, pattern: str = WORD, max_words: int = 200_000) -> DataFrame:
    """qid, id, kw: share of the query's distinct words that the lower-cased text contains (> 0 only).

    The queries are a stated set; their distinct words go out in blocks of max_words, each a pass over the texts."""
    q = queries.select("qid", F.array_distinct(word_tokens(F.col("query"), pattern)).alias("w"))
    terms = q.select("qid", F.size("w").alias("n"), F.explode("w").alias("term"))
    texts, words = active(mem).select("id", lowered(F.col("text")).alias("text")), terms.select("term").distinct()
    n = max(1, -(-words.count() // max_words))
    hit = None
    for k in range(n):
        block = [r["term"] for r in words.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k).collect()]
        part = contained_words(texts, block)
        hit = part if hit is None else hit.union(part)
    return hit.join(terms, "term").groupBy("qid", "id").agg((F.count("*") / F.max("n")).alias("kw"))


def dense_scores(queries: DataFrame, block_vec: DataFrame, max_queries: int = 20_000) -> DataFrame:
    """qid, id, cos: best dot product over an id's blocks, at least 0. Queries (with qvec) are a stated set, sent out in blocks of max_queries."""
    spark = queries.sparkSession
    q = queries.where("qvec IS NOT NULL").select("qid", "qvec")
    n = max(1, -(-q.count() // max_queries))
    out = None
    qk, ik = queries.schema["qid"].dataType.simpleString(), block_vec.schema["id"].dataType.simpleString()
    for c in range(n):
        rows = q.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == c).orderBy("qid").collect()
        held = spark.sparkContext.broadcast(([r["qid"] for r in rows], [list(r["qvec"]) for r in rows]))

        def run(batches, held=held):
            import numpy as np

            ids, m = np.array(held.value[0]), np.array(held.value[1], dtype=np.float64)
            for b in batches:
                if not len(ids) or not len(b):
                    continue
                cos = np.stack([np.asarray(x, dtype=np.float64) for x in b["vec"]]) @ m.T
                f = pd.DataFrame({"qid": np.tile(ids, len(b)), "id": np.repeat(b["id"].to_numpy(), len(ids)), "cos": cos.ravel()})
                yield f[f["cos"] > 0].groupby(["qid", "id"], as_index=False)["cos"].max()

        got = block_vec.select("id", "vec").mapInPandas(run, f"qid {qk}, id {ik}, cos double")
        out = got if out is None else out.union(got)
    return out.groupBy("qid", "id").agg(F.max("cos").alias("cos"))


def row_terms(queries: DataFrame, mem: DataFrame, block_vec: DataFrame, pattern: str, extra: DataFrame) -> tuple[list, DataFrame]:
    """The queries (qid, words, terms, qvec) as rows, and a row per active memory, written once: id, dl, terms (places of the
    queries' terms, a place for each occurrence), words (places of the words it contains), vecs, and extra's columns by id."""
    asked = queries.select("qid", F.array_distinct(word_tokens(F.col("query"), pattern)).alias("words"), F.array_distinct(bm25_tokens(F.col("query"), pattern)).alias("terms"), "qvec").orderBy("qid").collect()
    held = queries.sparkSession.sparkContext.broadcast([sorted({x for r in asked for x in r[c]}) for c in ("words", "terms")])
    kind = mem.schema["id"].dataType.simpleString()

    def run(batches):
        import ahocorasick
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words, terms = held.value
        found, known = ahocorasick.Automaton(), pa.array(terms, pa.string())
        for i, w in enumerate(words):
            found.add_word(w, i)
        if words:
            found.make_automaton()
        for b in batches:
            tokens = b.column("tokens")
            size = pc.list_value_length(tokens)
            at = pc.index_in(tokens.flatten(), known)
            row = np.repeat(np.arange(len(b)), size.to_numpy(zero_copy_only=False))[pc.is_valid(at).to_numpy(zero_copy_only=False)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(b)))])
            own = [sorted({i for _, i in found.iter(t)}) if words and t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), size.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), at.drop_null()), pa.array(own, pa.list_(pa.int32()))], names=["id", "dl", "terms", "words"]
            )

    live = active(mem).select("id", lowered(F.col("text")).alias("text"), bm25_tokens(F.col("text"), pattern).alias("tokens"))
    cut = live.mapInArrow(run, f"id {kind}, dl bigint, terms array<int>, words array<int>")
    vecs = block_vec.groupBy("id").agg(F.collect_list("vec").alias("vecs"))
    return asked, saved(cut.join(vecs, "id", "left").join(extra, "id", "left"))


def row_scores(asked: list, table: DataFrame, k1: float = 1.2, b: float = 0.75, cells: int = 200_000):
    """From row_terms(): the queries, the table, and a worker's function that gives for some rows at a time (batch, first row,
    scores), scores being (cos, bm25, kw) by row and query, rounded to 9 digits as in score_all()."""
    import numpy as np

    n, total = table.agg(F.count("*"), F.sum("dl")).first()
    names = [sorted({x for r in asked for x in r[c]}) for c in ("words", "terms")]
    df = np.zeros(len(names[1]))
    for r in table.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # the queries' terms
        df[r["t"]] = r["n"]
    idf, average = np.log(1 + (n - df + 0.5) / (df + 0.5)), (total or 0) / max(1, n)

    def reverse(c, k):
        """By word: the queries that have it, as starts and numbers."""
        at, own = {x: i for i, x in enumerate(names[k])}, [[] for _ in names[k]]
        for j, r in enumerate(asked):
            for x in r[c]:
                own[at[x]].append(j)
        return np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64), np.array([j for x in own for j in x], dtype=np.int64)

    dense = [j for j, r in enumerate(asked) if r["qvec"] is not None]
    vectors = np.array([list(asked[j]["qvec"]) for j in dense], dtype=np.float64)
    size = np.array([max(1, len(r["words"])) for r in asked], dtype=np.float64)
    held = table.sparkSession.sparkContext.broadcast((reverse("words", 0), reverse("terms", 1), idf, dense, vectors, size))

    def spread(lists, index, queries, weight=None):
        """Sums by row and query over the lists' entries; weight(row, entry) gives the entries that count and theirs."""
        start, number = index
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        entry = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row, entry, w = (row, entry, np.ones(len(row))) if weight is None else weight(row, entry)
        many = start[entry + 1] - start[entry]
        cell = np.repeat(row * queries, many)
        place = np.repeat(start[entry] - np.concatenate([[0], np.cumsum(many)])[:-1], many) + np.arange(many.sum())
        return np.bincount(cell + number[place], np.repeat(w, many), minlength=len(lists) * queries).reshape(len(lists), queries)

    def scored(batches):
        words, terms, idf, dense, vectors, size = held.value
        queries = len(size)
        step = max(1, cells // max(1, queries))
        for batch in batches:
            for first in range(0, len(batch), step):
                part = batch.slice(first, step)
                dl = part.column("dl").to_numpy(zero_copy_only=False).astype(np.float64)

                def weight(row, entry, dl=dl):
                    key, tf = np.unique(row * len(idf) + entry, return_counts=True)
                    row, entry = key // max(1, len(idf)), key % max(1, len(idf))
                    return row, entry, idf[entry] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / average))

                cos, lists = np.zeros((len(part), queries)), part.column("vecs")
                many = np.diff(lists.offsets.to_numpy())
                if many.sum() and dense:
                    have = np.flatnonzero(many)
                    flat = lists.flatten()
                    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) @ vectors.T
                    cos[np.ix_(have, dense)] = np.maximum(0.0, np.maximum.reduceat(x, np.concatenate([[0], np.cumsum(many[have])[:-1]]), axis=0))
                s = np.stack([cos, spread(part.column("terms"), terms, queries, weight), spread(part.column("words"), words, queries) / size])
                s[:, ~part.column("id").is_valid().to_numpy(zero_copy_only=False)] = 0.0  # no id, nothing joins
                yield batch, first, np.floor(s * 1e9 + 0.5) / 1e9

    return asked, table, scored


def recency(time: Column, now: Column, days: float = 90, missing: float = 365) -> Column:
    age = F.when(time.isNull(), F.lit(float(missing))).otherwise(F.greatest(F.lit(0.0), (now.cast("double") - time.cast("double")) / 86400.0))
    return F.exp(-age / F.lit(float(days)))


def score_all(queries: DataFrame, mem: DataFrame, block_vec: DataFrame, usage: DataFrame, now: Column, pattern: str = WORD) -> DataFrame:
    """qid, id, cos, kw, bm25, usage, recency for every query and active memory (the queries are a stated set)."""
    live = active(mem)
    base = live.select("id", "time").crossJoin(queries.select("qid").distinct())
    cos = dense_scores(queries, block_vec)
    s = base.join(cos, ["qid", "id"], "left").join(keyword_scores(queries, mem, pattern), ["qid", "id"], "left")
    s = s.join(bm25_scores(queries, bm25_index(mem, pattern), pattern), ["qid", "id"], "left").join(usage.select("id", F.col("n").alias("usage")), "id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c)
    return s.select("qid", "id", zero("cos"), zero("kw"), zero("bm25"), F.coalesce("usage", F.lit(0)).cast("long").alias("usage"), F.round(recency(F.col("time"), now), 9).alias("recency"))


def with_maxima(scores: DataFrame, *columns: str) -> DataFrame:
    """Adds max_<column> of each query: partial maxima and a join with one row per query, so no task gets a query's rows."""
    top = scores.groupBy(F.col("qid").alias("_q")).agg(*[F.max(c).alias(f"max_{c}") for c in columns])
    return scores.join(top, F.col("qid") == F.col("_q")).drop("_q")


def _share(c: str) -> Column:
    return F.when(F.col(f"max_{c}") > 0, F.col(c) / F.col(f"max_{c}")).otherwise(F.lit(0.0))


def all_scores(scores: DataFrame, variants, weights: dict[str, float] = MIX) -> DataFrame:
    """qid, id and a column per variant with its score, rounded to 6 digits (hybrid_mmr has hybrid's)."""
    if wrong := [v for v in variants if v not in VARIANTS]:
        raise ValueError(f"unknown variant {wrong[0]}")
    s = with_maxima(scores, "cos", "bm25", "kw")
    out = {
        "baseline": 0.3 * F.col("cos") + 0.7 * F.col("kw"), "dense": F.col("cos"), "bm25": _share("bm25"),
        "mix": weights["dense"] * _share("cos") + weights["bm25"] * _share("bm25") + weights["kw"] * _share("kw"),
    }
    if {"rrf", "hybrid", "hybrid_mmr"} & set(variants):
        # reciprocal ranks need every row's place in its query
        place = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "id"))
        s = s.withColumn("rr", 1 / (60 + place("cos")) + 1 / (60 + place("bm25"))).withColumn("lu", F.log1p(F.col("usage").cast("double")))
        s = with_maxima(s, "rr", "lu")
        out["rrf"] = _share("rr")
        if {"hybrid", "hybrid_mmr"} & set(variants):
            s = with_maxima(s.withColumn("hy", 0.75 * _share("rr") + 0.15 * _share("lu") + 0.10 * F.col("recency")), "hy")
            out["hybrid"] = out["hybrid_mmr"] = _share("hy")
    return s.select(*scores.columns, *[F.round(out[v], 6).alias(f"score_{v}") for v in variants])


def variant_scores(scores: DataFrame, variant: str, weights: dict[str, float] = MIX) -> DataFrame:
    """Adds score by the variant, rounded to 6 digits (hybrid_mmr has hybrid's)."""
    return all_scores(scores, (variant,), weights).withColumnRenamed(f"score_{variant}", "score")


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def mmr(scored: DataFrame, block_vec: DataFrame, k: int = 10, pool: int = 60, lam: float = 0.7) -> DataFrame:
    """qid, id, score, rank: the best `pool` rows of each query picked greedily for score and difference; similarity is the best dot product over blocks, at least 0."""
    vec = block_vec.groupBy("id").agg(F.collect_list("vec").alias("vecs"))
    rows = top_k(scored, pool).select("qid", "id", "score").join(vec, "id", "left")
    kind, q = scored.schema["id"].dataType.simpleString(), scored.schema["qid"].dataType.simpleString()

    def pick(key, pdf):
        import numpy as np

        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        m = [np.stack([np.asarray(x, dtype=np.float64) for x in v]) if v is not None and len(v) else None for v in pdf["vecs"]]
        near, left, out = np.zeros(len(pdf)), list(range(len(pdf))), []
        while left and len(out) < k:
            best = max(left, key=lambda i: (lam * pdf["score"][i] - (1 - lam) * near[i], -i))
            left.remove(best)
            out.append(best)
            for i in left:
                if m[i] is not None and m[best] is not None:
                    near[i] = max(near[i], float((m[i] @ m[best].T).max()))
        got = pdf.loc[out, ["qid", "id", "score"]]
        return got.assign(rank=range(1, len(got) + 1))

    return rows.groupBy("qid").applyInPandas(pick, f"qid {q}, id {kind}, score double, rank int")


def rank(scores: DataFrame, variant: str = "hybrid", k: int = 10, block_vec: DataFrame | None = None, weights: dict[str, float] = MIX) -> DataFrame:
    """The variants' dispatcher: k rows per query with rank."""
    scored = variant_scores(scores, variant, weights)
    return mmr(scored, block_vec, k) if variant == "hybrid_mmr" else top_k(scored, k)


def results(ranked: DataFrame, mem: DataFrame) -> DataFrame:
    """Ranked rows with title and blocks; parts rounded to 4 digits."""
    parts = [F.round(c, 4).alias(c) for c in ("cos", "bm25", "kw", "recency") if c in ranked.columns]
    return ranked.join(mem.select("id", "blocks"), "id").select("qid", F.col("id").alias("memory_id"), "rank", "score", *parts, title(F.col("blocks")).alias("title"), "blocks")
