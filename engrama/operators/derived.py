"""Gated rewriting of memories into append-only derived blocks by an injected language-model callable."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.schemas import DERIVED

#: (system prompt, prompt) -> reply
LlmCall = Callable[[str, str], str]
SYSTEM = "Rewrite memory blocks. Answer with one JSON object: {\"blocks\": [...], \"reason\": \"...\"}."
TASKS = {
    "multi_topic": "Split this memory into blocks of one topic each. The first block is a sentence as one would search for it. Keep every fact, add none, name people.",
    "noisy_anchor": "Reword the first block so that it matches the queries below. Leave the other blocks as they are and add no facts.",
}


def rewrite_queue(found: DataFrame, done: DataFrame, limit: int = 5) -> DataFrame:
    """The best candidates of the kinds that can be rewritten, without those done before (memory, kind)."""
    kinds = found.where(F.col("kind").isin(*TASKS))
    left = kinds.join(done.select(F.col("derived_from").alias("memory_id"), "kind").distinct(), ["memory_id", "kind"], "left_anti")
    return left.orderBy(F.desc("score"), "memory_id", "kind").limit(limit)


def prompt(kind: str, memory_id: str, blocks: list[str], queries: list[str], reason: str) -> str:
    numbered = "\n".join(f"[{i}] {b}" for i, b in enumerate(blocks))
    return f"{TASKS[kind]}\n\nMemory {memory_id}\n{numbered}\n\nQueries:\n" + ("\n".join(queries) or "(none)") + f"\n\nReason: {reason}"


def extract_json(reply: str) -> dict | None:
    """The object from the first { to the last }, or None."""
    a, b = reply.find("{"), reply.rfind("}")
    try:
        got = json.loads(reply[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def generate(call: LlmCall, kind: str, memory_id: str, blocks: list[str], queries: list[str], reason: str = "", now: datetime | None = None) -> dict:
    got = extract_json(call(SYSTEM, prompt(kind, memory_id, blocks, queries, reason)))
    if got is None:
        raise ValueError("the reply holds no JSON object")
    new = [b.strip() for b in got.get("blocks") or [] if isinstance(b, str) and b.strip()]
    if not new:
        raise ValueError("the reply has no blocks")
    return {
        "derived_from": memory_id, "source_blocks": list(range(len(blocks))), "blocks": new, "reason": str(got.get("reason") or reason), "kind": kind,
        "created_at": now or datetime.now(timezone.utc), "status": "pending", "validation": None,
    }


def rewrite(queue: DataFrame, mem: DataFrame, stats: DataFrame, call: LlmCall) -> tuple[DataFrame | None, list[str]]:
    """Derived rows of the queue (its few items one by one, errors noted and skipped); a dry run shows them and doesn't save them."""
    rows = queue.join(mem.select(F.col("id").cast("string").alias("memory_id"), "blocks"), "memory_id").join(stats.select(F.col("id").cast("string").alias("memory_id"), "queries"), "memory_id", "left").orderBy(F.desc("score"), "memory_id").collect()
    made, errors = [], []
    for r in rows:
        try:
            made.append(generate(call, r["kind"], r["memory_id"], list(r["blocks"]), list(r["queries"] or []), r["action"]))
        except Exception as e:  # noqa: BLE001  one bad reply must not stop the others
            errors.append(f"{r['memory_id']}: {e}")
    return (mem.sparkSession.createDataFrame(made, DERIVED) if made else None), errors


def set_status(derived: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pending rows take the verdict (derived_from, kind, verdict: accepted or rejected); others stay."""
    v = verdicts.where(F.col("verdict").isin("accepted", "rejected"))
    a = derived.join(v, ["derived_from", "kind"], "left")
    return a.withColumn("status", F.when((F.col("status") == "pending") & F.col("verdict").isNotNull(), F.col("verdict")).otherwise(F.col("status"))).select(*derived.columns)
