"""Command line: python -m engrama.cli ROOT build|stats|communities|recall|eval|feedback|version ...

ROOT holds the tables mem, block_vec, precog and (for recall and eval) query_set as Parquet; what is built is saved there.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from engrama.operators import community, derived, entities, evaluation, feedback, graph, iterate, leiden, recall, retrieval, usage
from engrama.session import session
from engrama.sources import store
from engrama.sources.memories import active


def build(spark, root: str, gamma: float = 1.0, threshold: float = 0.62):
    """Graph and communities from the tables; saves both and gives a few counts."""
    mem, vec, log = (store.load(spark, root, n) for n in ("mem", "block_vec", "precog"))
    edges = iterate.saved(graph.build_graph(mem, vec, usage.usage_edges(log, F.current_timestamp()), threshold))
    store.save_graph(edges, root)
    links = iterate.saved(graph.collapse(edges))
    part = iterate.saved(leiden.communities(links, iterate.connected(links), (gamma,)))
    q = leiden.modularity(links, part, gamma).first()["modularity"]
    members = iterate.saved(community.assemble(part.select("node", "community")))
    postings = entities.entity_postings(mem)
    words = community.keywords(members, postings, entities.entity_stats(postings, mem))
    described = community.describe(members, mem, edges, words, community.community_edges(members, edges), q)
    store.save(described.join(community.vectors(members, vec), "cid", "left"), root, "communities")
    store.save(members, root, "members")
    return {"memories": mem.count(), "active": active(mem).count(), "modularity": q, "edges": {r["type"] or "all": r["n"] for r in graph.type_counts(edges).collect()}}


def rewrite(spark, root: str, found, mem, stats, call: str | None, limit: int, dry_run: bool) -> str:
    """Derived blocks of the best candidates by an injected callable; says what was made, or saved, and what failed."""
    if not call or ":" not in call:
        raise SystemExit("feedback rewrite needs --call module:function")
    module, name = call.split(":", 1)
    queue = derived.rewrite_queue(found, store.load_derived(spark, root), limit)
    made, errors = derived.rewrite(queue, mem, stats, getattr(importlib.import_module(module), name))
    lines = [f"failed: {e}" for e in errors]
    if made is None:
        return "\n".join([*lines, "nothing to rewrite"])
    rows = made.collect()  # `limit` at most
    if dry_run:
        return "\n".join([*lines, *[f"{r['derived_from']} {r['kind']}: {' | '.join(r['blocks'])}" for r in rows], "dry run: nothing saved"])
    store.append_derived(made, root)
    return "\n".join([*lines, f"saved {len(rows)} pending rows"])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="engrama")
    p.add_argument("root")
    p.add_argument("command", choices=["build", "stats", "communities", "recall", "eval", "feedback", "version"])
    p.add_argument("rest", nargs="*")
    p.add_argument("--gamma", type=float, default=1.0)
    p.add_argument("--threshold", type=float, default=0.62)
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--limit", type=int, default=5, help="feedback rewrite: how many candidates")
    p.add_argument("--dry-run", action="store_true", help="feedback rewrite: show what is written, save nothing")
    p.add_argument("--call", help="feedback rewrite: module:function that takes (system prompt, prompt) and gives the reply")
    a = p.parse_args(argv)
    spark = session()
    root = a.root.rstrip("/")
    now = F.current_timestamp()
    if a.command == "build":
        print(build(spark, root, a.gamma, a.threshold))
        return
    if a.command == "version":
        what = a.rest[0] if a.rest else "list"
        print(store.snapshot(spark, root) if what == "snapshot" else store.restore(spark, root, a.rest[1]) if what == "restore" else store.versions(spark, root))
        return
    mem, vec, log = (store.load(spark, root, n) for n in ("mem", "block_vec", "precog"))
    log = store.latest_log(log) if "time" in log.columns else log
    edges = store.load_graph(spark, root)
    if edges is None:
        raise SystemExit("build first")
    if a.command == "stats":
        graph.type_counts(edges).orderBy("type").show(truncate=False)
    elif a.command == "communities":
        store.load(spark, root, "communities").orderBy("cid").show(a.k, truncate=False)
    elif a.command in ("recall", "eval"):
        queries = store.load(spark, root, "query_set")
        rt = recall.Runtime(mem, vec, usage.usage_counts(log), edges, now, store.load(spark, root, "communities"), store.load(spark, root, "members"))
        if a.command == "recall":
            got = recall.recall(a.rest[0] if a.rest else "mem", queries, rt, a.k)
            for part in (got.results, got.communities, got.subgraph, got.path):
                if part is not None:
                    part.show(50, truncate=80)
            if got.log is not None:
                store.append_log(got.log, root)
        else:
            scores = iterate.saved(retrieval.score_all(queries, mem, vec, rt.usage, now))
            print(evaluation.table(evaluation.compare(scores, evaluation.expectations(queries, mem), vec).collect(), "eval"))
    else:
        stats = usage.usage_stats(log, now)
        parts = {
            "multi_topic": feedback.multi_topic(stats, vec), "noisy_anchor": feedback.noisy_anchor(stats), "orphan_used": feedback.orphan_used(stats, edges),
            "duplicate_block": feedback.duplicate_block(stats, vec), "bridge": feedback.bridges(usage.usage_edges(log, now), store.load(spark, root, "members")),
        }
        found = iterate.saved(feedback.candidates(parts))
        if a.rest[:1] == ["rewrite"]:
            print(rewrite(spark, root, found, mem, stats, a.call, a.limit, a.dry_run))
            return
        store.save(found, root, "feedback")
        print(feedback.report(found, feedback.plan(parts)))


if __name__ == "__main__":
    main()
