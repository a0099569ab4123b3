"""Hermetic cases of the memory-graph engine."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engrama.functions.text import bm25_tokens, extract_json, time_of_id, time_of_record, tolerant_array, word_tokens
from engrama.functions.vectors import fnv1a
from engrama.operators import community, derived, entities, feedback, graph, iterate, leiden, ppr, retrieval, usage
from engrama.sources import memories, store

RESULT = "array<struct<id: string, accuracy: string, summary: string>>"


def log(spark, rows):
    rows = [(r, "猫", datetime.strptime(r[-19:], "%Y-%m-%d-%H:%M:%S"), [(i, a, "") for i, a in xs]) for r, xs in rows]
    return spark.createDataFrame(rows, f"record_id string, query string, time timestamp, results {RESULT}")


def at(text):
    return F.lit(text).cast("timestamp")


def test_usage_grading_and_window(spark):
    d = log(spark, [("PCX_2026-08-01-10:00:00", [("A", "true"), ("B", "revelant"), ("C", "false"), ("D", "true")])])
    now = at("2026-08-01 10:00:00")
    s = {r["id"]: r for r in usage.usage_stats(d, now).collect()}
    assert (s["A"]["true_hits"], s["A"]["weighted"]) == (1, 1.0)
    assert (s["B"]["relevant_hits"], s["B"]["weighted"]) == (1, 0.5)
    assert (s["C"]["false_hits"], s["C"]["weighted"]) == (1, 0.0)
    assert [(r["source"], r["target"], r["weight"]) for r in usage.usage_edges(d, now, 3).collect()] == [("A", "B", 0.5)]


@pytest.mark.parametrize("now,expected", [("2026-01-01 00:00:00", 1.0), ("2026-06-30 00:00:00", 0.5), ("2026-01-31 00:00:00", 0.890899)])
def test_usage_half_life(spark, now, expected):
    d = log(spark, [("PCX_2026-01-01-00:00:00", [("A", "true")])])
    assert usage.usage_stats(d, at(now)).first()["weighted"] == pytest.approx(expected, abs=1e-6)


def test_repeated_id_counts_once_in_stats_and_twice_in_counts(spark):
    d = log(spark, [("PCX_2026-01-01-00:00:00", [("A", "true"), ("A", "true")])])
    assert usage.usage_stats(d, at("2026-01-01 00:00:00")).first()["true_hits"] == 1
    assert usage.usage_counts(d).first()["n"] == 2


def test_diagnosis(spark):
    d = log(spark, [("R_2026-08-01-10:00:00", [("A", "true"), ("B", "true")]), ("R_2026-08-02-10:00:00", [("A", "true"), ("B", "revelant")])])
    s = usage.usage_stats(d, at("2026-08-01 00:00:00"))
    assert {r["id"]: r["weighted"] for r in s.collect()} == {"A": 2.0, "B": 1.5}
    v = spark.createDataFrame([("A", 0, [1.0, 0.0]), ("A", 1, [0.0, 1.0]), ("B", 0, [1.0, 0.0])], "id string, block_no int, vec array<float>")
    m = feedback.multi_topic(s, v).collect()
    assert [(r["id"], r["groups"], r["score"]) for r in m] == [("A", 2, 2.2)]
    dup = feedback.duplicate_block(s, v).collect()
    assert [(r["id"], r["other"], r["score"]) for r in dup] == [("A", "B", 1.5)]
    parts = {"multi_topic": feedback.multi_topic(s, v), "duplicate_block": feedback.duplicate_block(s, v)}
    assert {r["kind"] for r in feedback.candidates(parts).collect()} == {"multi_topic", "duplicate_block"}


def test_derived(spark):
    reply = '```json\n{"blocks": ["猫喜欢晒太阳", " 猫粮快吃完了 "], "reason": "two topics"}\n```'
    got = derived.generate(lambda s, p: reply, "multi_topic", "A", ["x", "y"], ["q"])
    assert got["blocks"] == ["猫喜欢晒太阳", "猫粮快吃完了"] and got["status"] == "pending" and got["source_blocks"] == [0, 1]
    for bad in ("no json", '{"blocks": []}'):
        with pytest.raises(ValueError):
            derived.generate(lambda s, p, bad=bad: bad, "multi_topic", "A", ["x"], [])


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/cog"
    with pytest.raises(ValueError):
        store.snapshot(spark, root)
    store.save(spark.range(1), root, "communities")
    assert store.snapshot(spark, root, {"gamma": 1}) == "v0"
    store.save(spark.range(2), root, "communities")
    for i in range(1, 11):
        assert store.snapshot(spark, root) == f"v{i}"
    assert store.versions(spark, root)[-1] == "v10" and store.versions(spark, root)[2] == "v2"
    assert store.restore(spark, root, "v0") == ["communities"]
    assert store.load(spark, root, "communities").count() == 1
    assert store.load(spark, root, "communities.bak").count() == 2
    assert store.manifest(spark, root, "v0")["params"] == {"gamma": 1}


MEM = "id string, blocks array<string>, text string, source string, revelant array<string>, deprecated_by string, time timestamp"


def mems(spark, texts):
    return spark.createDataFrame([(f"m{i:02d}", [t], t, "LOG", [], None, None) for i, t in enumerate(texts)], MEM)


def test_bm25(spark):
    m = mems(spark, ["alpha beta", "alpha", "gamma gamma"])
    q = spark.createDataFrame([(1, "alpha")], "qid long, query string")
    got = {r["id"]: r["bm25"] for r in retrieval.bm25_scores(q, retrieval.bm25_index(m)).collect()}
    assert got == {"m00": pytest.approx(0.434457, abs=1e-6), "m01": pytest.approx(0.561961, abs=1e-6)}


def test_recency(spark):
    now = at("2026-01-31 00:00:00")
    a = spark.range(1).select(retrieval.recency(at("2026-01-01 00:00:00"), now).alias("a"), retrieval.recency(F.lit(None).cast("timestamp"), now).alias("b")).first()
    assert a["a"] == pytest.approx(0.716531, abs=1e-6) and a["b"] == pytest.approx(0.017326, abs=1e-6)


def test_ppr_on_a_path(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "source long, target long, weight double")
    p = {r["id"]: r["p"] for r in ppr.ppr(e, spark.createDataFrame([(0, 1, 1.0)], "qid long, id long, score double")).collect()}
    assert p == {1: pytest.approx(0.5125, abs=1e-6), 2: pytest.approx(0.375, abs=1e-6), 3: pytest.approx(0.1125, abs=1e-6)}


TRIANGLES = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]


def test_modularity_and_leiden(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in TRIANGLES] + [(7, 7, 2.0), (1, 6, -1.0)], "source long, target long, weight double")
    split = spark.createDataFrame([(i, (i - 1) // 3) for i in range(1, 7)], "node long, community long")
    assert leiden.modularity(e, split).first()["modularity"] == pytest.approx(5 / 14, abs=1e-6)
    got = leiden.communities(leiden.clean_edges(e), iterate.connected(leiden.clean_edges(e)), (1.0,)).collect()
    assert {r["node"]: r["community"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    r = leiden.edge_report(e).first()
    assert (r["edges"], r["dropped_weight"], r["dropped_loops"], r["kept"]) == (9, 1, 1, 7)


def test_leiden_of_a_large_component_moves_in_rounds(monkeypatch):
    """Rings of cliques are found as before, and on a random graph quality is near that of moves node by node."""
    import random

    import numpy as np

    def quality(es, of, total):
        k, d = [0.0] * len(of), {}
        for a, b, w in es:
            k[a] += w
            k[b] += w
        for v, c in enumerate(of):
            d[c] = d.get(c, 0.0) + k[v]
        return sum(2 * w for a, b, w in es if of[a] == of[b]) / total - sum((x / total) ** 2 for x in d.values())

    def arrays(es):
        a, b, w = zip(*es)
        return np.array(a), np.array(b), np.array(w, dtype=float)

    ring = [(6 * c + i, 6 * c + j, 1.0) for c in range(50) for i in range(6) for j in range(i)] + [(6 * c, (6 * c + 7) % 300, 0.1) for c in range(50)]
    total = 2 * sum(e[2] for e in ring)
    for seed in range(3):
        of = leiden.leiden_large(*arrays(ring), 300, total, 5.0, seed, small=10)
        assert len(set(of)) == 50 and all(of[v] == of[v - v % 6] for v in range(300))
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(40 * (g % 50), 40 * (g % 50) + 40) if g % 5 else range(2000), 2))) for g in range(12_000)}
    es = [(a, b, rng.random() + 0.5) for a, b in sorted(pairs)]
    total = 2 * sum(e[2] for e in es)
    of = leiden.leiden_large(*arrays(es), 2000, total, 1.0, 0, small=100)
    assert of == leiden.leiden_large(*arrays(es), 2000, total, 1.0, 0, small=100)
    assert quality(es, of, total) > quality(es, leiden.leiden(es, 2000, total), total) - 0.01
    with pytest.raises(ValueError):
        leiden.leiden_large(*arrays(es), 2000, total, 0.0)


def test_usage_edges_of_unique_records(spark):
    """Hits found within a record equal those dealt out: repeats, nulls, ranks over the window, accuracies of any kind."""
    rows = [("R_2026-08-01-10:00:00", [("A", "false"), ("A", "true"), (None, "true"), ("B", "true"), ("C", None), ("D", "Revelant"), ("E", "true"), ("F", "true")])]
    rows += [("R_2026-08-02-10:00:00", [("B", "true"), ("D", "relevant")]), ("R_2026-08-03-10:00:00", [("B", "true")]), ("R_2026-08-04-10:00:00", [])]
    got = [sorted(map(tuple, usage.usage_edges(log(spark, rows), at("2026-08-10 00:00:00"), unique=u).collect())) for u in (False, True)]
    assert got[0] == got[1] and [(r[0], r[1], r[3]) for r in got[0]] == [("B", "D", 2), ("B", "E", 1), ("D", "E", 1)]


def test_leiden_ring_of_cliques():
    edges = [(6 * 0 + 4 * c + a, 4 * c + b, 1.0) for c in range(6) for a in range(4) for b in range(a)]
    edges += [(4 * c, (4 * c + 5) % 24, 1.0) for c in range(6)]
    total = 2.0 * len(edges)
    for seed in range(3):
        of = leiden.leiden(edges, 24, total, 1.0, seed)
        assert all(len({of[4 * c + i] for i in range(4)}) == 1 for c in range(6)) and len(set(of)) == 6
    with pytest.raises(ValueError):
        leiden.leiden(edges, 24, total, 0.0)
    assert leiden.leiden([], 0, 0.0) == []


@pytest.mark.parametrize("word,value", [("ab", 1294271946), ("猫", 780935338), ("cat", 108289031)])
def test_fnv(spark, word, value):
    assert spark.range(1).select(fnv1a(F.lit(word)).alias("h")).first()["h"] == value


def test_cjk_terms_and_edges(spark):
    m = mems(spark, ["社群检测"] * 4 + [f"note{i:02d}" for i in range(1, 11)])
    assert [r["term"] for r in entities.cjk_term_selection(m).collect()] == ["社群检测"]
    p = entities.entity_postings(m)
    s = entities.entity_stats(p, m)
    assert s.where("entity = '社群检测'").first()["idf"] == pytest.approx(1.203973, abs=1e-6)
    pairs = entities.entity_pairs(p, s)
    assert entities.entity_edges(pairs).count() == 0
    assert [r["weight"] for r in entities.entity_edges(pairs, 1.0).collect()] == [1.204] * 6


def test_degree_cap_equals_the_greedy_loop(spark):
    rows = [(i, j, float((i * 31 + j * 17) % 97 + 3)) for i in range(13) for j in range(i + 1, 13)]
    rows += [(100, 101 + i, 5.0 + i) for i in range(12)]
    df = spark.createDataFrame([(*r, ["x"]) for r in rows], "source long, target long, weight double, shared array<string>")
    got = {(r["source"], r["target"]) for r in entities.entity_edges(df).collect()}
    n, kept = {}, set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if n.get(a, 0) >= 10 and n.get(b, 0) >= 10:
            continue
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
        kept.add((a, b))
    assert got == kept


def test_text_scalars(spark):
    row = spark.range(1).select(
        word_tokens(F.lit("The cat's 3.14 的 path_x")).alias("w"), bm25_tokens(F.lit("社群检")).alias("b"), tolerant_array(F.lit("not json")).alias("t"),
        time_of_id(F.lit("PJ1_MEM_20261009_132702")).cast("string").alias("i"), time_of_record(F.lit("x_2026-08-01-10:00:00")).cast("string").alias("r"),
        extract_json(F.lit('```{"a": 1}```'), "a int").alias("j"), time_of_id(F.lit("nothing")).alias("n"),
    ).first()
    assert row["w"] == ["the", "cat's", "3.14", "path_x"] and row["b"] == ["社群检", "社群", "群检"] and row["t"] == []
    assert row["i"] == "2026-10-09 13:27:02" and row["r"] == "2026-08-01 10:00:00" and row["j"]["a"] == 1 and row["n"] is None


def test_edges_of_a_small_corpus(spark):
    rows = [("a", ["x"], "x", "LOG", ["b"], None, datetime(2026, 1, 1, 23, 0)), ("b", ["y"], "y", "LOG", ["a"], None, datetime(2026, 1, 2, 1, 0)), ("c", ["z"], "z", "LOG", ["c", "q"], "b", None), ("d", [], "", "LOG", [], None, datetime(2026, 1, 2, 2, 0))]
    m = spark.createDataFrame(rows, MEM)
    assert [(r["source"], r["target"], r["weight"]) for r in graph.reference_edges(m).collect()] == [("a", "b", 6.0)]
    assert [(r["source"], r["target"], r["evidence"]) for r in graph.temporal_edges(m).collect()] == [("a", "b", "时间相邻 120 分钟")]
    assert {r["id"] for r in memories.active(m).collect()} == {"a", "b"}
    e = spark.createDataFrame([("a", "b", "usage", 1.0, "u"), ("b", "a", "usage", 2.0, "v")], "source string, target string, type string, weight double, evidence string")
    assert [(r["weight"], r["evidence"]) for r in graph.merge_edges(e).collect()] == [(3.0, "u；v")]


def test_merge_duplicates_and_log(spark):
    rows = spark.createDataFrame([("a", 1, ["x", "y"], "one"), ("a", 2, ["y", "z"], "two"), ("", 3, ["q"], "no"), (None, 4, ["q"], "no")], "id string, seq int, blocks array<string>, source string")
    got = memories.merge_duplicates(rows, "seq", scalars=("source",)).collect()
    assert [(r["id"], r["source"], r["blocks"]) for r in got] == [("a", "one", ["x", "y", "z"])]
    lg = spark.createDataFrame([("r", "old", datetime(2026, 1, 1)), ("r", "new", datetime(2026, 1, 2))], "record_id string, query string, time timestamp")
    assert [r["query"] for r in store.latest_log(lg).collect()] == ["new"]


def test_mmr_prefers_difference(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.99), (1, "c", 0.9)], "qid long, id string, score double")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, vec array<float>")
    assert [r["id"] for r in retrieval.mmr(s, v, 3).orderBy("rank").collect()] == ["a", "c", "b"]
    with pytest.raises(ValueError):
        retrieval.rank(s, "nothing")
    assert math.isclose(sum(retrieval.MIX.values()), 1) and math.isclose(sum(retrieval.MIX_CHAT.values()), 1)


def test_communities_drop_singletons(spark):
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4)], "node long, community long")
    got = {(r["cid"], r["node"]) for r in community.assemble(m).collect()}
    assert got == {("C01", 4), ("C01", 5), ("C01", 6), ("C02", 1), ("C02", 2)}


def test_registry_names():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len([k for k in q if not k.startswith("op")]) >= 50
