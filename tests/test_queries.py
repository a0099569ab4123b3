"""Queries against their SQL over small tables written for the case."""

import pytest
from pyspark.sql import functions as F

from engrama.operators import entities
from engrama.plans import registry
from engrama.sources import memories

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(tmp_path, spark, texts=None, **others):
    """A folder with documents from texts and the other frames given."""
    if texts is not None:
        rows = [(i, t, "en", "web", len(t or "")) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
        others["documents"] = spark.createDataFrame(rows, DOCUMENTS)
    for name, df in others.items():
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    return str(tmp_path)


def both(spark, folder, name):
    """Sorted rows of the query and of its SQL."""
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{t}/*.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = registry.queries()[name](spark, folder).select(*names).collect()
    return sorted(map(tuple, got), key=repr), sorted(want.fetchall(), key=repr)


#: Line n must lose white space at its ends, and no digit that equals its number.
ENDS = ["call 555-8630\n1 step of 11\n22 of 2", "0", "\u00a0 in 100\u3000\n \u2003\n\tkept\r", None, "101 \n\n 12"]


def test_memories_keep_digits_at_the_ends(spark, tmp_path):
    got, want = both(spark, tables(tmp_path, spark, ENDS), "memories")
    assert got == want and [r[1:4] for r in got[:2]] == [(3, 34, "call 555-8630"), (1, 1, "0")]


def test_chat_memories_keep_digits_at_the_ends(spark):
    raw = spark.createDataFrame([("A_MEM_1", "[]", '["\\t10 \\u3000", "\\r\\n", "21\\ufeff"]', "s", "[]")], "memory_id string, revelant string, blocks string, source string, core_file string")
    assert memories.chat_memories(raw).first()["blocks"] == ["10", "21"]


def test_bm25_index_keeps_digits_at_the_ends(spark, tmp_path):
    got, want = both(spark, tables(tmp_path, spark, ENDS), "bm25_index")
    assert got == want and {"8630", "11"} <= {r[0] for r in got}


def test_hash_embed_keeps_digits_at_the_ends(spark, tmp_path):
    got, want = both(spark, tables(tmp_path, spark, ENDS), "hash_embed")
    assert got == want


#: Letters whose lower case has two characters or depends on the place in the word.
CASES = ["\u0130stanbul K\u0130T", "\u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3 A\u03a3", "\u212aELVIN \u1e9e \u00c9T\u00c9", "istanbul"]


def test_bm25_index_lowers_each_character_alone(spark, tmp_path):
    got, want = both(spark, tables(tmp_path, spark, CASES), "bm25_index")
    assert got == want and ("istanbul", 2, 2) in got


def test_hash_embed_lowers_each_character_alone(spark, tmp_path):
    got, want = both(spark, tables(tmp_path, spark, CASES), "hash_embed")
    assert got == want


@pytest.mark.parametrize("name", [lambda i: i, lambda i: (-1) ** i * i * 10**9, lambda i: f"m{i * 37 % 61}"])
def test_entity_pairs_by_blocks_equal_all_pairs(spark, name):
    """The strongest pairs of either end, by blocks of few postings, against all pairs counted one by one."""
    import math
    import random

    rng = random.Random(5)
    have = {name(i): {f"word{int(rng.paretovariate(0.6)) % 40:02d}" for _ in range(rng.randint(1, 8))} for i in range(60)}
    rows = [(i, w) for i, ws in have.items() for w in sorted(ws)]
    kind = "string" if isinstance(rows[0][0], str) else "long"
    p = spark.createDataFrame(rows, f"id {kind}, entity string")
    df = {w: sum(w in ws for ws in have.values()) for _, w in rows}
    idf = {w: math.log(1 + (60 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    stats = spark.createDataFrame([(w, df[w], idf[w]) for w in df], "entity string, df long, idf double")
    want = {}
    for a in have:
        for b in have:
            both = sorted((-idf[w], w) for w in have[a] & have[b] if a < b and idf[w] >= 0.7 and 2 <= df[w] <= 20)
            if both:
                want[a, b] = ([w for _, w in both[:4]], round(-sum(x for x, _ in both[:4]), 4))
    took = {(r["source"], r["target"]): (r["shared"], round(r["weight"], 4)) for r in entities.entity_pairs(p, stats, max_df=20, per_block=25).collect()}
    assert took == want and len(want) > 60
    few = entities.entity_pairs(p, stats, max_df=20, floor=2.0, per_node=3, per_block=25)
    assert few.count() < sum(w >= 2.0 for _, w in want.values())
    edges = lambda x: {(r["source"], r["target"], r["weight"], r["evidence"]) for r in entities.entity_edges(x, 2.0, 3).collect()}
    assert edges(few) == edges(entities.entity_pairs(p, stats, max_df=20)) != set()


def test_entity_edges_do_not_deal_out_pairs(spark, tmp_path):
    texts = {i: " ".join(f"name{j:03d}" for j in range(i % 7, i % 7 + 30)) for i in range(100)}
    folder = tables(tmp_path, spark, texts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()["entity_edges"](spark, folder)._jdf.queryExecution().executedPlan().toString()
        got, want = both(spark, folder, "entity_edges")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == want and "collect_list" not in plan


def test_near_copies_take_the_links_of_fingerprints(spark):
    """Nodes of one fingerprint, of fingerprints 3 and 4 bits apart, and of one that allows no similarity by its size."""
    from engrama.llm import nearcopies

    rows = [(1, 0b0, 100), (2, 0b0, 90), (3, 0b111, 100), (4, 0b1111 << 40, 100), (5, 0b1 << 60, 50)]
    got = nearcopies.fingerprint_pairs(spark.createDataFrame(rows, "node long, fp long, n long")).collect()
    assert {(r["a"], r["b"]) for r in got} == {(1, 2), (1, 3)}


def test_recall_cog_cuts_a_text_once(spark, monkeypatch):
    """However many queries have a text in their scope, it is cut into terms once."""
    from engrama.operators import recall

    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(text):
        cut.add(1)
        return (text or "").split()

    monkeypatch.setattr(recall.retrieval, "bm25_tokens", lambda c, pattern=None: tokens(c))
    saves = []
    monkeypatch.setattr(recall, "saved", lambda df, f=recall.saved: saves.append(df) or f(df), raising=False)
    mem = spark.createDataFrame([(i, [f"a{i} b"], f"a{i} b", None, None) for i in range(5)], "id long, blocks array<string>, text string, deprecated_by long, time timestamp")
    queries = spark.createDataFrame([(q, "b a1", [1.0]) for q in range(20)], "qid long, query string, qvec array<double>")
    scope = queries.select("qid").crossJoin(mem.select("id"))
    vec = spark.createDataFrame([(i, [1.0]) for i in range(5)], "id long, vec array<double>")
    rt = recall.Runtime(mem, vec, spark.createDataFrame([], "id long, n long"), None, F.lit("2024-01-01").cast("timestamp"))
    got = recall.cog_scores(queries, rt, scope).collect()
    assert len(got) == 100 and all((r["bm25"] > 0) for r in got)
    assert len(saves) == 2 and cut.value < 200


def test_nearest_cuts_by_the_rounded_cosine(spark):
    """Cosines that are equal when rounded go by id, also where a chunk's candidates are cut."""
    from engrama.operators.graph import nearest

    at = lambda c, sign: [c, sign * (1 - c * c) ** 0.5]
    reps = spark.createDataFrame([(1, [1.0, 0.0]), (2, at(0.8000001, 1)), (3, at(0.8000002, -1))], "id long, rep array<double>")
    assert [r["other"] for r in nearest(reps, 1, 0.5).where("id = 1").collect()] == [2]


def test_grid_search_shuffles_no_spread_scores(spark):
    """The 66 mixes of a score are compared where they arise: what is shuffled are counts by query and mix."""
    from engrama.operators import evaluation

    scores = spark.range(3000).selectExpr("id % 3 AS qid", "id", "(id * 37 % 101) / 101D AS cos", "(id * 53 % 97) / 97D AS bm25", "(id * 71 % 89) / 89D AS kw")
    expected = spark.createDataFrame([(0, 30), (0, 33), (1, 61), (2, 2)], "qid long, id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        got = evaluation.grid_search(scores, expected, keep=66)
        rows = {(r["d"], r["b"], r["k"]): r["mrr"] for r in got.collect()}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    right, every = {(r["qid"], r["id"]) for r in expected.collect()}, scores.collect()
    own = {q: [r for r in every if r["qid"] == q] for q in range(3)}
    top = {q: [max(r[c] for r in x) for c in ("cos", "bm25", "kw")] for q, x in own.items()}
    for (d, b, k), mrr in rows.items():
        total = 0
        for q, x in own.items():
            s = sorted((-round((d * r["cos"] / top[q][0] + b * r["bm25"] / top[q][1] + k * r["kw"] / top[q][2]) / 10, 6), r["id"]) for r in x)
            total += max(1 / (i + 1) for i, (_, n) in enumerate(s) if (q, n) in right)
        assert abs(mrr - total / 3) < 2e-6
    spread = [x for x in plan.splitlines() if "Join Inner" in x and "(d#" in x]  # rows of all mixes dealt by query and mix
    assert len(rows) == 66 and not spread


def test_grid_search_makes_no_table_of_scores(spark, tmp_path, monkeypatch):
    """Ties, copies, texts without words or ids, and queries without vectors, words or hits, against the SQL; no rows by query and memory are written."""
    from engrama.operators import evaluation, iterate

    texts = {i: f"alpha beta{i % 7} gamma{i % 3}\nred fox {'jumps' * (i % 4)} {'over ' * (i % 5)}" for i in range(400)}
    texts |= {400: None, 401: "\u4e2d\u6587 \u4e2d\u6587", 402: "?!", 403: "red  fox\n", 404: "?! - red fox alpha"}
    documents = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, "red fox alpha")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "0L AS n_chars")
    benchmark = spark.createDataFrame([(0, "red fox"), (1, "beta3 gamma1"), (2, "?!"), (3, "not there"), (4, "alpha"), (900, "gamma2 red"), (5, " ")], "item_id long, text string")
    vector = lambda i: [((i * 37 + d * 11) % 17 - 8.0) / 30 for d in range(8)]
    vectors = spark.createDataFrame([(i, vector(i)) for i in range(120)], "vec_id long, embedding array<float>")
    events = spark.createDataFrame([(0, "click")], "event_id long, event_type string").selectExpr("event_id", "timestamp '2024-01-01' AS ts", "1L AS user_id", "event_type", "0D AS value", "'{\"k\": 1}' AS props")
    saves = []
    keep = lambda df, f=iterate.saved: saves.append(f(df)) or saves[-1]
    monkeypatch.setattr(evaluation, "saved", keep)
    monkeypatch.setattr(iterate, "saved", keep)
    got, want = both(spark, tables(tmp_path, spark, documents=documents, benchmark=benchmark, embeddings=vectors, events=events), "grid_search")
    assert got == want and len(got) == 66 and len({r[3] for r in got}) > 1
    hits = sum(x.count() for x in saves if x.columns == ["qid", "id"])
    assert hits and all(x.where("id IS NOT NULL").count() <= hits for x in saves if "cos" in x.columns)


def test_expected_hits_read_a_text_once(spark, tmp_path):
    texts = {0: "a b\n c", 1: "xa  b cx", 2: "b c", 3: None, 4: "a"}
    benchmark = spark.createDataFrame([(0, "a b c"), (1, "b  c"), (2, "a b c"), (3, ""), (4, "zz"), (5, None)], "item_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    folder = tables(tmp_path, spark, texts, benchmark=benchmark, embeddings=vectors)
    got, want = both(spark, folder, "expected_hits")
    assert got == want and len(got) == 7
    assert "NestedLoop" not in registry.queries()["expected_hits"](spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_ppr_keeps_two_states_at_most(spark, tmp_path, monkeypatch):
    """Each round is a job of its own, and the state before the last one is removed."""
    from engrama.operators import ppr

    e = spark.createDataFrame([(i, i + 1, "usage", 1.0 + i % 3) for i in range(20)], "source long, target long, type string, weight double")
    gone, real = [], ppr.dropped
    monkeypatch.setattr(ppr, "dropped", lambda *x: (gone.extend(x), real(*x)))
    p = {r["id"]: r["p"] for r in ppr.ppr(e, spark.createDataFrame([(0, 3, 1.0)], "qid long, id long, score double"), rounds=6, tolerance=0.0).collect()}
    out = {i: {j: 1.0 + min(i, j) % 3 for j in (i - 1, i + 1) if 0 <= j <= 20} for i in range(21)}
    want = {3: 1.0}
    for _ in range(6):
        step = {3: 0.4}
        for a, x in want.items():
            for b, w in out[a].items():
                step[b] = step.get(b, 0) + 0.6 * x * w / sum(out[a].values())
        want = step
    assert p.keys() == want.keys() and all(abs(p[i] - want[i]) < 1e-12 for i in p) and len(gone) == 5


def test_entity_lists_are_dealt_in_rounds(spark, monkeypatch):
    """However many blocks a list goes to, no more than about per_round times the postings are under way at once."""
    rows = [(i, f"word{w}") for w in range(12) for i in range(200) if (i + w) % 4]
    p = spark.createDataFrame(rows, "id long, entity string")
    stats = p.groupBy("entity").agg(F.count("*").alias("df"), F.lit(2.0).alias("idf"))
    dealt, whole = [], entities.saved

    def counted(df):
        out = whole(df)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        dealt.append(plan.count("FlatMapGroupsInArrow"))
        return out

    monkeypatch.setattr(entities, "saved", counted)
    key = lambda x: sorted((r["source"], r["target"], r["weight"], tuple(r["shared"])) for r in x.collect())
    few = key(entities.entity_pairs(p, stats, per_block=100, per_round=4))
    rounds, dealt[:] = sum(dealt), []
    assert few == key(entities.entity_pairs(p, stats, per_block=10**6)) != [] and rounds >= 4 and sum(dealt) == 1
