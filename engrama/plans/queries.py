"""One query per operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions.text import PLAIN_WORD, title
from engrama.functions.vectors import hash_buckets, mean_vectors
from engrama.operators import community, entities, evaluation, feedback, graph, iterate, leiden, ppr, recall, retrieval, usage
from engrama.sources import adapters as data
from engrama.sources.memories import active, merge_duplicates

THRESHOLD, DUPLICATE, NOISY, COG = 0.30, 0.40, 0.30, 0.05


def now():
    return F.lit(data.NOW).cast("timestamp")


def _stats(s, d):
    return usage.usage_stats(data.precog(s, d), now())


def _uedges(s, d):
    return usage.usage_edges(data.precog(s, d), now(), unique=True)  # precog groups by record id


def _postings(s, d):
    m = data.mem(s, d)
    p = entities.entity_postings(m)
    return m, p, entities.entity_stats(p, m)


def _entity(s, d):
    m = active(data.mem(s, d))
    p = iterate.saved(entities.entity_postings(m))
    pairs = iterate.saved(entities.entity_pairs(p, entities.entity_stats(p, m), floor=3.0, per_node=10))
    iterate.dropped(p)
    return entities.entity_edges(pairs)


def _semantic(s, d):
    return graph.semantic_edges(data.block_vec(s, d), THRESHOLD)


def _graph(s, d):
    return graph.build_graph(data.mem(s, d), data.block_vec(s, d), _uedges(s, d), THRESHOLD, only_source=None)


def _edges(s, d):
    """The graph with all kinds of edges, written once: what PPR, Leiden, degrees and communities run over."""
    return iterate.saved(_graph(s, d))


def _members(s, d):
    """A fixed partition of the active memories, so that community queries don't depend on a random one."""
    return community.assemble(active(data.mem(s, d)).select(F.col("id").alias("node"), (F.col("id") % 8).alias("community")))


def _scores(s, d):
    return retrieval.score_all(data.query_set(s, d), data.mem(s, d), data.block_vec(s, d), usage.usage_counts(data.precog(s, d)), now(), PLAIN_WORD)


def _top(variant, k=10):
    return lambda s, d: retrieval.rank(_scores(s, d), variant, k, data.block_vec(s, d)).select("qid", "id", "score", "rank")


def usage_counts(s: SparkSession, d: str) -> DataFrame:
    return usage.usage_counts(data.precog(s, d))


def usage_stats(s, d):
    a = _stats(s, d)
    return a.select("id", "true_hits", "relevant_hits", "false_hits", "unlabeled_hits", F.round("weighted", 6).alias("weighted"), F.col("last_time").cast("long").alias("last_time"), F.array_join("queries", "|").alias("queries"))


def usage_edges(s, d):
    return _uedges(s, d)


def usage_summary(s, d):
    log = data.precog(s, d)
    return usage.usage_summary(usage.usage_stats(log, now()), usage.usage_edges(log, now()), log)


def memories(s, d):
    m = data.mem(s, d)
    return m.select("id", F.size("blocks").alias("n_blocks"), F.length("text").alias("n_chars"), title(F.col("blocks")).alias("title"), F.col("time").cast("long").alias("time"))


def merge_dups(s, d):
    c = data.table(s, d, "conversations").select(F.col("conv_id").alias("id"), "turn", F.array("text").alias("blocks"), "role")
    return merge_duplicates(c, "turn", scalars=("role",)).select("id", "role", F.array_join("blocks", "|").alias("blocks"))


def hash_embed(s, d):
    blocks = data.mem(s, d).select("id", F.posexplode("blocks").alias("block_no", "block"))
    return hash_buckets(blocks, ["id", "block_no"], "block").select("id", "block_no", "bucket", F.round("value", 6).alias("value"))


def bm25_index(s, d):
    tf, _, df, _ = retrieval.bm25_index(data.mem(s, d), PLAIN_WORD)
    return tf.groupBy("term").agg(F.sum("tf").alias("cf")).join(df, "term").select("term", "df", "cf")


def doc_lengths(s, d):
    _, dl, _, _ = retrieval.bm25_index(data.mem(s, d), PLAIN_WORD)
    return dl


def kw_overlap(s, d):
    return retrieval.keyword_scores(data.query_set(s, d), data.mem(s, d), PLAIN_WORD).select("qid", "id", F.round("kw", 6).alias("kw"))


def score_all(s, d):
    return _scores(s, d).select("qid", "id", *[F.round(c, 6).alias(c) for c in ("cos", "kw", "bm25", "recency")], "usage")


def entity_latin(s, d):
    _, p, _ = _postings(s, d)
    return p


def entity_idf(s, d):
    _, _, st = _postings(s, d)
    return st.select("entity", "df", F.round("idf", 6).alias("idf"))


def entity_edges(s, d):
    return _entity(s, d)


def mean_vector(s, d):
    return mean_vectors(data.block_vec(s, d)).select("id", F.posexplode("rep").alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


def semantic_edges(s, d):
    return _semantic(s, d)


def reference_edges(s, d):
    return graph.reference_edges(data.references(s, d))


def temporal_edges(s, d):
    return graph.temporal_edges(data.mem(s, d), only_source=None)


def edge_union(s, d):
    return _graph(s, d).select("source", "target", "type", "weight")


def edge_type_counts(s, d):
    return graph.type_counts(_edges(s, d)).select(F.coalesce("type", F.lit("all")).alias("type"), "n")


def degrees(s, d):
    return graph.degree(_edges(s, d))


def pair_collapse(s, d):
    return graph.collapse(_edges(s, d))


def _seeds(s, d):
    """Eight queries; the seeds of each are the log's ids with that remainder, scored by use."""
    return usage.usage_counts(data.precog(s, d)).select((F.col("id") % 8).alias("qid"), "id", F.col("n").cast("double").alias("score"))


def ppr_20(s, d):
    return ppr.ppr(_edges(s, d), _seeds(s, d), rounds=20, tolerance=0.0).select("qid", "id", F.round("p", 6).alias("p"))


def _ppr_top(s, d):
    e = _edges(s, d)
    return e, ppr.top_nodes(ppr.ppr(e, _seeds(s, d), rounds=20, tolerance=0.0), 10)


def ppr_subgraph(s, d):
    e, top = _ppr_top(s, d)
    return ppr.subgraph(e, top).select("qid", "source", "target", "type", "weight", "rank")


def main_path(s, d):
    e, top = _ppr_top(s, d)
    return ppr.main_path(ppr.subgraph(e, top), top).select("qid", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def leiden_partition(s, d):
    e = iterate.saved(graph.collapse(_edges(s, d)))
    return leiden.communities(e, iterate.connected(e))


def modularity(s, d):
    e = graph.collapse(_edges(s, d))
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return leiden.modularity(e, nodes.select("node", (F.col("node") % 8).alias("community")))


def communities(s, d):
    return _members(s, d)


def community_spans(s, d):
    return community.spans(_members(s, d), data.mem(s, d)).select("cid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def community_core(s, d):
    return community.core_members(_members(s, d), _edges(s, d)).select("cid", "node", F.col("degree").cast("long").alias("degree"), "rank")


def community_relations(s, d):
    return community.internal_relations(_members(s, d), _edges(s, d)).select("cid", "source", "target", "type", "weight", "rank")


def community_keywords(s, d):
    _, p, st = _postings(s, d)
    return community.keywords(_members(s, d), p, st)


def community_edges(s, d):
    return community.community_edges(_members(s, d), _edges(s, d))


def community_text(s, d):
    _, p, st = _postings(s, d)
    m, e = _members(s, d), _edges(s, d)
    return community.describe(m, data.mem(s, d), e, community.keywords(m, p, st), community.community_edges(m, e), 0.0).select("cid", "title", "size", "text")


def _community_vec(s, d):
    return community.vectors(_members(s, d), data.block_vec(s, d))


def community_scores(s, d):
    return recall.score_communities(data.query_set(s, d).where("qvec IS NOT NULL"), _community_vec(s, d))


def cog_scope(s, d):
    best = recall.best_communities(data.query_set(s, d).where("qvec IS NOT NULL"), _community_vec(s, d), 3, COG)
    return recall.cog_scope(best, _members(s, d))


def _runtime(s, d):
    com = _community_vec(s, d).select("cid", F.lit("").alias("title"), F.lit("").alias("text"), "vec")
    return recall.Runtime(data.mem(s, d), data.block_vec(s, d), usage.usage_counts(data.precog(s, d)), None, now(), com, _members(s, d), PLAIN_WORD)


def recall_mem(s, d):
    return recall.recall("mem", data.query_set(s, d), _runtime(s, d), 5).results.select("qid", "memory_id", "rank", "score", "title")


def recall_community(s, d):
    return recall.recall("community", data.query_set(s, d).where("qvec IS NOT NULL"), _runtime(s, d), 5).communities.select("qid", "cid", "cos", "rank")


def recall_cog(s, d):
    q = data.query_set(s, d).where("qvec IS NOT NULL")
    rt = _runtime(s, d)
    best = recall.best_communities(q, rt.communities, 3, COG)
    return retrieval.rank(recall.cog_scores(q, rt, recall.cog_scope(best, rt.members)), "mix", 5).select("qid", "id", "score", "rank")


def log_rows(s, d):
    log = recall.recall("mem", data.query_set(s, d), _runtime(s, d), 5).log
    return log.select("query", "status", F.array_join("keywords", " ").alias("keywords"), "top_k", F.array_join(F.transform("results", lambda x: F.concat(x["id"], F.lit(":"), x["summary"])), "|").alias("results"))


def orphan_used(s, d):
    return feedback.orphan_used(_stats(s, d), _semantic(s, d))


def noisy_anchor(s, d):
    return feedback.noisy_anchor(_stats(s, d), NOISY)


def multi_topic(s, d):
    return feedback.multi_topic(_stats(s, d), data.block_vec(s, d))


def duplicate_block(s, d):
    return feedback.duplicate_block(_stats(s, d), data.block_vec(s, d), DUPLICATE)


def bridge(s, d):
    return feedback.bridges(_uedges(s, d), _members(s, d))


def _parts(s, d):
    return {"multi_topic": multi_topic(s, d), "noisy_anchor": noisy_anchor(s, d), "orphan_used": orphan_used(s, d), "duplicate_block": duplicate_block(s, d), "bridge": bridge(s, d)}


def feedback_top(s, d):
    return feedback.candidates(_parts(s, d)).select("kind", "memory_id", "score", "action", "rank")


def feedback_plan(s, d):
    return feedback.plan(_parts(s, d))


def block_attribution(s, d):
    return feedback.attribution(data.mem(s, d), usage.usage_stats(_text_log(s, d), now()), PLAIN_WORD)


def _text_log(s, d):
    """A log whose queries are benchmark items and whose results are the documents that hold them."""
    q = data.query_set(s, d)
    hits = evaluation.expectations(q, data.mem(s, d)).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("id", F.lit("true").alias("accuracy"), F.lit("").alias("summary")))).alias("results"))
    return q.join(hits, "qid").select(F.col("qid").cast("string").alias("record_id"), "query", now().alias("time"), "results")


def eval_metrics(s, d):
    scores, expected = iterate.saved(_scores(s, d)), iterate.saved(evaluation.expectations(data.query_set(s, d), data.mem(s, d)))
    return evaluation.compare(scores, expected, data.block_vec(s, d), ("baseline", "dense", "bm25", "mix", "rrf", "hybrid"))


def grid_search(s, d):
    expected = iterate.saved(evaluation.expectations(data.query_set(s, d), data.mem(s, d)))
    return evaluation.grid_search_over(data.query_set(s, d), data.mem(s, d), data.block_vec(s, d), expected, PLAIN_WORD, keep=66)


def expected_hits(s, d):
    return evaluation.expectations(data.query_set(s, d), data.mem(s, d))


ALL = {
    "mix_topk": _top("mix"), "usage_counts": usage_counts, "usage_stats": usage_stats, "usage_edges": usage_edges, "usage_summary": usage_summary,
    "memories": memories, "merge_duplicates": merge_dups, "hash_embed": hash_embed, "bm25_index": bm25_index, "doc_lengths": doc_lengths,
    "kw_overlap": kw_overlap, "score_all": score_all, "baseline_topk": _top("baseline"), "dense_topk": _top("dense"), "bm25_topk": _top("bm25"),
    "rrf_topk": _top("rrf"), "hybrid_topk": _top("hybrid"), "mmr_topk": _top("hybrid_mmr"), "entity_latin": entity_latin, "entity_idf": entity_idf,
    "entity_edges": entity_edges, "mean_vectors": mean_vector, "semantic_edges": semantic_edges, "reference_edges": reference_edges,
    "temporal_edges": temporal_edges, "edge_union": edge_union, "edge_type_counts": edge_type_counts, "degree": degrees, "pair_collapse": pair_collapse,
    "ppr_20": ppr_20, "ppr_subgraph": ppr_subgraph, "main_path": main_path, "leiden_partition": leiden_partition, "modularity": modularity,
    "communities": communities, "community_spans": community_spans, "community_core": community_core, "community_relations": community_relations,
    "community_keywords": community_keywords, "community_edges": community_edges, "community_text": community_text, "community_scores": community_scores,
    "cog_scope": cog_scope, "recall_mem": recall_mem, "recall_community": recall_community, "recall_cog": recall_cog, "log_rows": log_rows, "orphan_used": orphan_used, "noisy_anchor": noisy_anchor, "multi_topic": multi_topic, "duplicate_block": duplicate_block,
    "bridge": bridge, "feedback_top": feedback_top, "feedback_plan": feedback_plan, "block_attribution": block_attribution,
    "eval_metrics": eval_metrics, "grid_search": grid_search, "expected_hits": expected_hits,
}
