"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree, then seeded epochs.

The token budget flows from the root to domains, languages and sources in proportion to their weights. A node never
gets more than its subtree can give (its tokens times `max_epochs`, without subtrees of weight 0); what it can't take goes to
its siblings, in proportion to their weights, and only what all siblings can't take stays with the parent's own siblings, since
the parent's share was already limited to what its subtree can give. The share of a sibling is closed form: sorted by
capacity per weight, node i is full if capacity / weight <= (budget - capacities before it) / (weights from it on). Shares are
whole tokens; what rounding down leaves over goes to the siblings with the largest fractions, a token each.

A leaf with budget b and t tokens takes floor(b / t) whole epochs, and of one more epoch the prefix of the documents in
seeded order whose tokens fit. Positions in that order come from a hash. Where the prefix ends is found by sums over 64 ranges
of positions, then over 64 parts of the range in which it ends, and so on (`levels` times); only the last part is ordered row by
row. So no task holds a leaf, and what is sent to the rows is one line per leaf and epoch.

Nulls and edge cases: null domain, lang or source are nodes of their own (''); names may hold any character, also `/` (give
weights of such nodes by tuples); a null or blank text has no tokens and is never chosen; null doc_id rows take part, hashed as
''; repeated rows are ordered together and may both be chosen; weights not listed are 1; weights that are null, not a number
or not positive count as 0 and get nothing, nor does what lies below them; if all weights are 0 nothing is chosen; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrama.llm.shared import n_words, small, stage, table

LEVELS = ("domain", "lang", "source")
#: Production weights; a key is a path from the root. Sources src0 to src9 form the domain `core`, others `extra`.
WEIGHTS = {"core": 3, "extra": 2, "core/en": 4, "extra/en": 4, "core/de": 2, "extra/de": 2, "core/fr": 2, "extra/fr": 2}


def default_domain() -> Column:
    return F.when(F.col("source").rlike("^src[0-9]$"), "core").otherwise("extra")


def _weighted(nodes: DataFrame, names: list[str], weights: dict) -> DataFrame:
    """Adds w to nodes named by the columns names; keys of weights are paths, as tuples or joined by /."""
    paths = {k if isinstance(k, tuple) else tuple(k.split("/")): float(v) if v is not None and v > 0 else 0.0 for k, v in weights.items()}
    own = [(*k, v) for k, v in paths.items() if len(k) == len(names)]
    if not own:
        return nodes.withColumn("w", F.lit(1.0))
    listed = nodes.sparkSession.createDataFrame(own, ", ".join([*[f"`{n}` string" for n in names], "_w double"]))
    return nodes.join(F.broadcast(listed), names, "left").withColumn("w", F.coalesce("_w", F.lit(1.0))).drop("_w")  # a parameter


def _share(nodes: DataFrame, parent: list[str], node: str) -> DataFrame:
    """nodes: parent columns, node, w, cap, given (the parent's budget), all w and cap positive. Adds budget: at most cap, in whole
    tokens, siblings' budgets summing to given if they can."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = group.orderBy("fill", node)
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    a = nodes.withColumn("fill", F.col("cap") / F.col("w"))
    a = a.withColumn("rate", (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward))
    a = a.withColumn("full", F.col("fill") <= F.col("rate"))
    # the first node that isn't full fixes the rate of all after it
    a = a.withColumn("want", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.max(F.when(~F.col("full"), F.col("rate"))).over(group)))
    a = a.withColumn("base", F.floor("want").cast("long"))
    left = F.least(F.col("given"), F.sum("cap").over(group)) - F.sum("base").over(group)
    turn = F.row_number().over(group.orderBy("full", F.desc(F.col("want") - F.col("base")), node))
    a = a.withColumn("budget", F.col("base") + F.when(~F.col("full") & (turn <= left), 1).otherwise(0))
    return a.drop("fill", "rate", "full", "want", "base")


def leaf_budgets(leaves: DataFrame, budget: float, weights: dict, max_epochs: int = 1) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds budget. `budget`: tokens, or, if 1 or less, a share of all tokens."""
    names = list(LEVELS)
    caps = _weighted(leaves.withColumn("cap", F.col("tokens") * max_epochs), names, weights).where("w > 0 AND cap > 0")
    levels = [caps.select(*names, "w", "cap")]
    for depth in (2, 1):
        upper = levels[0].groupBy(*names[:depth]).agg(F.sum("cap").alias("cap"))
        levels.insert(0, _weighted(upper, names[:depth], weights).where("w > 0"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    given = total.select((F.floor(F.col("total") * F.lit(budget)) if budget <= 1 else F.lit(int(budget)).cast("long")).alias("given"))
    for depth, level in enumerate(levels):
        above = names[:depth]
        level = level.join(given, above) if above else level.crossJoin(F.broadcast(given))  # one row
        given = _share(level, above, names[depth]).select(*names[: depth + 1], F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), names, "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def seeded(epoch: Column, doc_id: Column, seed: int) -> Column:
    """48-bit position of a document in an epoch's order."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


POSITION_BITS = 48


def _ends(part: DataFrame, keys: list[str], levels: int, bits: int) -> DataFrame:
    """part: keys, position, tokens, rest. Where each group's prefix of `rest` tokens ends: keys, end (leading bits of the
    position) and left (tokens that fit of the documents with those bits)."""
    at = part.groupBy(*keys).agg(F.first("rest").alias("left")).withColumn("end", F.lit(0).cast("long"))
    for level in range(1, levels + 1):
        shift = POSITION_BITS - bits * level
        inner = part.join(small(at, 200_000), keys).where(F.shiftright("position", shift + bits) == F.col("end"))
        sums = inner.groupBy(*keys, "left", F.shiftright("position", shift).alias("_b")).agg(F.sum("tokens").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("_upto", upto).where(F.col("_upto") > F.col("left"))
        # of the ranges that go beyond, the first
        first = over.groupBy(*keys).agg(F.min(F.struct("_b", (F.col("left") - F.col("_upto") + F.col("_n")).alias("left"))).alias("x"))
        at = stage(first.select(*keys, F.col("x.left").alias("left"), F.col("x._b").alias("end")), "mix_ends")
    return at


def mix(
    docs: DataFrame,
    weights: dict,
    budget: float = 0.5,
    max_epochs: int = 1,
    seed: int = 17,
    domain: Column | None = None,
    levels: int = 3,
    bits: int = 6,
    carry: list[str] | None = None,
    bare: bool = False,
) -> DataFrame:
    """One row per chosen document and epoch: doc_id, domain, lang, source, tokens, epoch, position (48-bit order key) and the
    `carry` columns; with `bare` only these."""
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    base = docs.withColumn("_domain", key(domain if domain is not None else default_domain()))
    rows = base.select(
        F.col("doc_id"), F.col("_domain").alias("domain"), key(F.col("lang")).alias("lang"), key(F.col("source")).alias("source"),
        n_words(F.col("text")).alias("tokens"), *[F.col(c).alias(f"_c_{c}") for c in carry or []],
    ).where("tokens > 0")
    rows = stage(rows, "mix_rows")
    leaf, keys = list(LEVELS), [*LEVELS, "epoch"]
    plan = leaf_budgets(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), budget, weights, max_epochs)
    plan = stage(plan.where("budget > 0").withColumnRenamed("tokens", "supply"), "mix_plan")
    a = rows.join(small(plan), leaf)
    whole = F.floor(F.col("budget") / F.col("supply")).cast("int")
    a = a.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(whole, F.lit(max_epochs - 1))))).withColumn("whole", F.col("epoch") < whole)
    a = a.withColumn("position", seeded(F.col("epoch"), F.col("doc_id"), seed))
    part = a.where("NOT whole").withColumn("rest", F.col("budget") - whole * F.col("supply"))
    ends = _ends(part.select(*keys, "position", "tokens", "rest"), keys, levels, bits)
    marked = part.join(small(ends, 200_000), keys).withColumn("_at", F.shiftright("position", POSITION_BITS - bits * levels))
    inner = Window.partitionBy(*keys).orderBy("position", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.where("_at = end").withColumn("_sum", F.sum("tokens").over(inner)).where(F.col("_sum") <= F.col("left"))
    out = ["doc_id", *leaf, "tokens", "epoch", "position", *[f"_c_{c}" for c in carry or []]]
    chosen = a.where("whole").select(*out).unionByName(marked.where("_at < end").select(*out)).unionByName(edge.select(*out))
    return chosen.select(*([] if bare else out[:7]), *[F.col(f"_c_{c}").alias(c) for c in carry or []])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, budget=0.5, max_epochs=3)


def _level_sql(node: str, parent: str, given: str) -> str:
    return f"""
  caps_{node} AS (SELECT {node} AS node, {parent} AS parent, sum(tokens) * 3 AS cap FROM tree GROUP BY ALL),
  w_{node} AS (SELECT c.*, CAST(coalesce(k.w, 1) AS DOUBLE) AS w, g.given FROM caps_{node} c JOIN {given} g ON g.node = c.parent LEFT JOIN known k ON k.path = c.node),
  r_{node} AS (SELECT *, cap / w AS fill,
      (given - coalesce(sum(cap) OVER (PARTITION BY parent ORDER BY cap / w, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (PARTITION BY parent ORDER BY cap / w, node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w_{node}),
  f_{node} AS (SELECT *, fill <= rate AS is_full, CASE WHEN fill <= rate THEN cap ELSE w * max(CASE WHEN fill > rate THEN rate END) OVER (PARTITION BY parent) END AS want FROM r_{node}),
  t_{node} AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_full, want - floor(want) DESC, node) AS turn,
      least(given, sum(cap) OVER (PARTITION BY parent)) - sum(floor(want)) OVER (PARTITION BY parent) AS over FROM f_{node}),
  g_{node} AS (SELECT node, CAST(floor(want) + CASE WHEN NOT is_full AND turn <= over THEN 1 ELSE 0 END AS BIGINT) AS given FROM t_{node})"""


OP4_SQL = f"""WITH known(path, w) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())}),
  docs AS (SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'core' ELSE 'extra' END AS domain, coalesce(lang, '') AS lang,
      coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
  rows AS (SELECT * FROM docs WHERE tokens > 0),
  tree AS (SELECT domain AS l1, domain || '/' || lang AS l2, domain || '/' || lang || '/' || source AS l3, sum(tokens) AS tokens FROM rows GROUP BY ALL),
  root AS (SELECT '' AS node, CAST(floor(sum(tokens) * 0.5) AS BIGINT) AS given FROM tree),{_level_sql("l1", "''", "root")},{_level_sql("l2", "l1", "g_l1")},{_level_sql("l3", "l2", "g_l2")},
  plan AS (SELECT t.l3, t.tokens AS supply, g.given AS budget, CAST(g.given // t.tokens AS BIGINT) AS whole FROM tree t JOIN g_l3 g ON g.node = t.l3 WHERE g.given > 0),
  a AS (SELECT r.*, p.*, e.epoch, CAST('0x' || substr(md5('17:' || e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS position
      FROM rows r JOIN plan p ON p.l3 = r.domain || '/' || r.lang || '/' || r.source JOIN (SELECT unnest(range(3)) AS epoch) e ON e.epoch <= least(p.whole, 2)),
  b AS (SELECT *, sum(tokens) OVER (PARTITION BY l3, epoch ORDER BY position, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM a)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS INTEGER) AS epoch, position FROM b
WHERE epoch < whole OR upto <= budget - whole * supply"""
