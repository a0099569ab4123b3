"""The command line end to end: build, every recall mode, evaluation, diagnosis and gated rewriting."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engrama import cli
from engrama.functions.text import bm25_tokens
from engrama.operators import recall
from engrama.schemas import BLOCK_VEC, MEM
from engrama.sources import store

LOG = "record_id string, status string, query string, keywords array<string>, top_k int, results array<struct<id: string, accuracy: string, summary: string>>, description string, time timestamp"


def reply(system, prompt):
    """An injected language model."""
    return '{"blocks": ["first topic", "second topic"], "reason": "split"}'


def unit(a):
    return [math.cos(a), math.sin(a)]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('cli')}"
    mem, vec = [], []
    for i in range(12):
        topic, angle = ("alpha river", 0.1) if i < 6 else ("omega desert", 1.4)
        blocks = [f"{topic} note number{i}", f"more about {topic} and `tool{i // 6}.py`"]
        when = datetime(2026, 1, 1 + i)
        mem.append((f"M{i:02d}", blocks, " ".join(blocks), "s", [f"M{i - 1:02d}"] if i % 6 else [], [], None, when))
        vec += [(f"M{i:02d}", 0, unit(angle + 0.01 * i)), (f"M{i:02d}", 1, unit(angle + 0.01 * i + (1.5 if i == 2 else 0.0)))]
    spark.createDataFrame(mem, MEM).write.parquet(f"{where}/mem")
    spark.createDataFrame(vec, BLOCK_VEC).write.parquet(f"{where}/block_vec")
    hits = [("PC_1", "pre", "river", [], 5, [("M01", "true", ""), ("M02", "true", "")], "", datetime(2026, 2, 1)), ("PC_2", "pre", "river", [], 5, [("M02", "true", ""), ("M07", "revelant", "")], "", datetime(2026, 2, 2))]
    # appending replaces: only the later row of PC_2 counts
    hits.append(("PC_2", "pre", "river", [], 5, [("M02", "true", ""), ("M08", "true", "")], "", datetime(2026, 2, 3)))
    spark.createDataFrame(hits, LOG).write.parquet(f"{where}/precog")
    queries = [(1, "omega desert note number8", unit(1.4)), (2, "alpha river", unit(0.1))]
    spark.createDataFrame(queries, "qid long, query string, qvec array<double>").write.parquet(f"{where}/query_set")
    cli.main([where, "build"])
    return where


def test_build(spark, root, capsys):
    types = {r["type"] for r in store.load_graph(spark, root).select("type").distinct().collect()}
    assert types >= {"reference", "semantic", "usage"}
    com = store.load(spark, root, "communities")
    assert com.count() >= 1 and all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-6 for r in com.collect())
    cli.main([root, "stats"])
    cli.main([root, "communities"])
    assert "semantic" in capsys.readouterr().out


@pytest.mark.parametrize("mode", recall.MODES)
def test_recall(spark, root, mode, capsys):
    before = spark.read.parquet(f"{root}/precog").count()
    cli.main([root, "recall", mode, "-k", "3"])
    out = capsys.readouterr().out
    assert "cid" in out if mode == "community" else "M0" in out
    # only mem writes to the log
    assert spark.read.parquet(f"{root}/precog").count() - before == (2 if mode == "mem" else 0)


def test_recall_of_one_scope(spark, root):
    mem, vec, log = (store.load(spark, root, n) for n in ("mem", "block_vec", "precog"))
    queries = store.load(spark, root, "query_set")
    rt = recall.Runtime(mem, vec, spark.createDataFrame([], "id string, n long"), store.load_graph(spark, root), F.lit("2026-03-01").cast("timestamp"), store.load(spark, root, "communities"), store.load(spark, root, "members"))
    got = recall.recall("mem", queries, rt, 3)
    top = {r["qid"]: r["memory_id"] for r in got.results.where("rank = 1").collect()}
    assert top[1] == "M08" and top[2] < "M06"
    rows = {r["query"]: r for r in got.log.collect()}
    r = rows["omega desert note number8"]
    want = spark.range(1).select(bm25_tokens(F.lit(r["query"])).alias("t")).first()["t"]
    assert list(r["keywords"]) == list(want) and r["results"][0]["id"] == "M08"
    assert r["results"][0]["summary"] == "omega desert note number8 more about omega desert and `tool1.py`"[:60]
    best = recall.recall("community", queries, rt, 1).communities.collect()
    members = {r["node"]: r["cid"] for r in rt.members.collect()}
    assert {r["qid"]: r["cid"] for r in best}[2] == members["M01"]
    scope = recall.recall("cog", queries, rt, 12).results.where("qid = 2").collect()
    assert {members[r["memory_id"]] for r in scope} <= {r["cid"] for r in recall.best_communities(queries.where("qid = 2"), rt.communities, 3, 0.35).collect()}
    graph = recall.recall("graph", queries, rt, 4)
    assert graph.results.count() == 8 and all(1 <= len(r["path"]) <= 6 for r in graph.path.collect())
    with pytest.raises(ValueError):
        recall.recall("cog", queries, recall.Runtime(mem, vec, rt.usage, rt.edges, rt.now))
    with pytest.raises(ValueError):
        recall.recall("other", queries, rt)


def test_eval_and_feedback(spark, root, capsys):
    cli.main([root, "eval"])
    assert "hybrid_mmr" in capsys.readouterr().out
    cli.main([root, "feedback"])
    assert "multi_topic" in capsys.readouterr().out
    cli.main([root, "feedback", "rewrite", "--dry-run", "--call", "tests.test_cli:reply"])
    out = capsys.readouterr().out
    assert "M02 multi_topic: first topic | second topic" in out and "nothing saved" in out
    assert store.load_derived(spark, root).count() == 0
    cli.main([root, "feedback", "rewrite", "--limit", "1", "--call", "tests.test_cli:reply"])
    assert "saved 1" in capsys.readouterr().out
    assert [(r["derived_from"], r["status"]) for r in store.load_derived(spark, root).collect()] == [("M02", "pending")]
    with pytest.raises(SystemExit):
        cli.main([root, "feedback", "rewrite"])


def test_versions(spark, root, capsys):
    cli.main([root, "version", "snapshot"])
    cli.main([root, "version", "list"])
    assert "v0" in capsys.readouterr().out
