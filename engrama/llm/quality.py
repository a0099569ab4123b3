"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule rejects a document whose statistic is at or above a cutoff. Cutoffs come from labelled documents, for every
stratum (language) by itself. One half proposes: at each step from mild to strict, a rule takes the strictest cutoff so far of
which the documents hit are mostly of labelled low quality. That gives a path of vectors with a cutoff per rule, each rejecting
all that the one before rejects. The other half certifies: the vectors are tested in this order (fixed sequence), and a vector
is certified while the exact binomial test rejects "more than alpha of the good documents would be lost to these rules", which
is the Clopper-Pearson upper bound staying below alpha. The level delta is divided by the number of strata (Bonferroni); the
fixed order needs no further correction. So with probability 1 - delta no stratum loses more than alpha of its good documents.
With alpha 0.05, delta 0.1 and four strata 72 good documents without a loss are enough.

The bound needs independent trials: halves go by a hash of the text's words, and documents with the same words are one
trial. Near copies still count each; where they are many, deduplicate before labelling.

Nulls and edge cases: a null text has no words and fails the base; a null lang is a stratum of its own; null doc_id rows
are kept as rows and never match a label; a document labelled several times, or a text of several documents, counts as good if
any label says so; null labels are ignored; without enough labels no cutoff is certified and only the base decides; repeated
rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrama.llm.shared import SPACES, small, stage, table, words

SYMBOLS = "#*$%&|<>"

#: rule -> (statistic of the feature columns, cutoffs from mild to strict, as many for each)
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1]),
    "dup_lines": ("100 * n_dup_lines / greatest(n_words, 1)", [40.0, 20.0, 10.0, 7.0, 5.0, 3.0, 2.0, 1.0, 0.5, 0.2]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.49, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "long_words": ("word_chars / greatest(n_words, 1)", [60.0, 40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0]),
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text, and text_key, a hash of its words."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = lambda c, chars: F.length(F.translate(c, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: bare(x, SPACES) > 0)
    a = docs.select(
        *keep,
        words(F.col(text)).alias("_w"),
        bare(t, SPACES).cast("long").alias("word_chars"),
        (F.length(t) - bare(t, SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    counted = [*keep, "word_chars", "n_symbols"]
    a = a.select(
        *counted,
        F.md5(F.array_join("_w", " ")).alias("text_key"),
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "CASE WHEN size(_w) < 3 THEN CAST(array() AS array<bigint>) ELSE"
            " transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"
        ).alias("_h"),
    )
    counted += ["text_key", "n_words", "n_dup_lines"]
    a = a.select(
        *counted,
        F.expr(
            "CASE WHEN size(array_distinct(_h)) = size(_h) THEN CAST(array() AS array<struct<h: bigint, i: int>>)"
            " ELSE array_sort(transform(_h, (h, i) -> struct(h AS h, i AS i))) END"
        ).alias("_s"),
    )
    a = a.select(
        *counted,
        F.expr(
            "array_sort(transform(filter(_s, (x, j) -> (j > 0 AND _s[j - 1].h = x.h)"
            " OR (j < size(_s) - 1 AND _s[j + 1].h = x.h)), x -> x.i))"
        ).alias("_p"),
    )
    covered = "CASE WHEN size(_p) = 0 THEN 0 ELSE 3 + aggregate(sequence(1, size(_p)), 0, (n, j) -> n + CASE WHEN j < size(_p) THEN least(3, _p[j] - _p[j - 1]) ELSE 0 END) END"
    return a.select(*counted, F.expr(covered).cast("long").alias("n_repeat_words"))


def base_failed():
    """Fewer than 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k, n, p: float):
    """P(Bin(n, p) <= k) as a column: the terms' logarithms follow by recurrence and are summed in log space."""
    ratio = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))

    def add(acc, j):
        term = acc["term"] + F.log((n - j + 1).cast("double")) - F.log(j.cast("double")) + ratio
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(acc["total"], term) - top))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, add, lambda acc: acc["total"]))


def certified_cutoffs(
    labelled: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.1, purity: float = 0.5, rules=None
) -> DataFrame:
    """labelled: stratum, text_key, quality (0/1), base (boolean) and the feature columns. Gives stratum and one cutoff per rule (null: none certified)."""
    rules = rules or RULES
    if len({len(cuts) for _, cuts in rules.values()}) != 1:
        raise ValueError("all rules need the same number of cutoffs")
    pairs = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.expr(stat).alias("value"))
            for r, (stat, cuts) in rules.items()
            for i, c in enumerate(cuts)
        ]
    )
    trials = labelled.where(~F.col("base")).groupBy(stratum, "text_key").agg(F.max("quality").alias("quality"), *[F.max(c).alias(c) for c in FEATURES])
    fold = F.conv(F.substring("text_key", 1, 1), 16, 10).cast("int") % 2
    trials = stage(trials.withColumn("fold", fold).withColumn("good", F.col("quality") == 1), "trials")
    hit = F.col("x.value") >= F.col("x.cutoff")
    tried = (
        trials.select(stratum, "fold", "good", F.explode(pairs).alias("x"))
        .groupBy(stratum, F.col("x.rule").alias("rule"), F.col("x.step").alias("step"), F.col("x.cutoff").alias("cutoff"))
        .agg(F.count(F.when((F.col("fold") == 0) & ~F.col("good") & hit, 1)).alias("bad"), F.count(F.when((F.col("fold") == 0) & hit, 1)).alias("hits"))
    )
    useful = F.col("bad") >= F.greatest(F.lit(1), F.col("hits") * F.lit(purity))
    so_far = Window.partitionBy(stratum, "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    path = tried.withColumn("best", F.min(F.when(useful, F.col("cutoff"))).over(so_far))
    path = path.groupBy(F.col(stratum).alias("_s"), "step").agg(*[F.max(F.when(F.col("rule") == r, F.col("best"))).alias(f"cut_{r}") for r in rules])
    path = stage(path, "path")  # strata times steps
    lost = reduce(lambda a, b: a | b, [F.coalesce(F.expr(stat) >= F.col(f"cut_{r}"), F.lit(False)) for r, (stat, _) in rules.items()])
    certify = trials.where("good AND fold = 1").join(small(path), trials[stratum].eqNullSafe(path["_s"]))
    counts = certify.groupBy(stratum, "step").agg(F.count("*").alias("n"), F.count(F.when(lost, 1)).alias("k"))
    tests = counts.crossJoin(F.broadcast(path.agg(F.countDistinct(F.coalesce("_s", F.lit("\0"))).alias("strata"))))  # one row
    # beyond the mean the test can't pass; the guard keeps the recurrence short
    hopeless = F.col("k") > F.col("n") * F.lit(alpha)
    p = F.when(hopeless, 1.0).otherwise(binomial_cdf(F.col("k"), F.col("n"), alpha))
    passed = p <= delta / F.col("strata")
    w = Window.partitionBy(stratum).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    held = tests.withColumn("held", F.min(passed.cast("int")).over(w) == 1).where("held")
    last = held.groupBy(F.col(stratum).alias("_l")).agg(F.max("step").alias("_step"))
    chosen = path.join(last, path["_s"].eqNullSafe(last["_l"]) & (path["step"] == last["_step"]))
    return chosen.select(F.col("_s").alias(stratum), *[f"cut_{r}" for r in rules])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.1) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept, failed_rules (array of rule names)."""
    stats = stage(text_stats(docs, ["doc_id", "lang"]).withColumn("base_failed", base_failed()), "quality")
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = stats.withColumnRenamed("base_failed", "base").join(truth, "doc_id").select("lang", "text_key", "quality", "base", *FEATURES)
    cuts = certified_cutoffs(labelled, "lang", alpha, delta).withColumnRenamed("lang", "_lang")
    cuts = stage(cuts, "cutoffs")
    out = stats.join(small(cuts), stats["lang"].eqNullSafe(cuts["_lang"]), "left")
    failed = F.filter(F.array(*[F.when(F.expr(stat) >= F.col(f"cut_{r}"), F.lit(r)) for r, (stat, _) in RULES.items()]), lambda x: x.isNotNull())
    out = out.withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


def stratum_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per language: good labelled documents and how many of them the certified rules reject."""
    verdict = quality_rules(docs, labels)
    truth = labels.where("quality = 1").select("doc_id").distinct()
    lost = reduce(lambda a, b: a | b, [F.array_contains("failed_rules", r) for r in RULES])
    langs = docs.select("doc_id", "lang")
    return verdict.join(truth, "doc_id").join(langs, "doc_id").groupBy("lang").agg(F.count("*").alias("good"), F.count(F.when(lost, 1)).alias("lost"))


_CUTS = ", ".join(f"('{r}', {i}, CAST({c} AS DOUBLE))" for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts))
_VALUE = "CASE rule " + " ".join(f"WHEN '{r}' THEN {stat}" for r, (stat, _) in RULES.items()) + " END"
_LOST = " OR ".join(f"coalesce({stat} >= cut_{r}, false)" for r, (stat, _) in RULES.items())
OP1_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
  w AS MATERIALIZED (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
  g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  r AS (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
  rep AS (SELECT rid, count(DISTINCT pos) AS n FROM r GROUP BY rid),
  s AS (SELECT doc_id, lang, md5(array_to_string(w, ' ')) AS text_key, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
        - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
  st AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
  truth AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
  cuts(rule, step, cutoff) AS (VALUES {_CUTS}),
  tr AS MATERIALIZED (SELECT lang, text_key, strpos('0123456789abcdef', substr(text_key, 1, 1)) % 2 = 0 AS certify, max(quality) = 1 AS good, {", ".join(f"max({c}) AS {c}" for c in FEATURES)}
      FROM st JOIN truth USING (doc_id) WHERE NOT base_failed GROUP BY lang, text_key),
  x AS (SELECT lang, rule, step, cutoff, certify, good, {_VALUE} >= cutoff AS hit FROM tr CROSS JOIN cuts),
  u AS (SELECT lang, rule, step, cutoff, count(*) FILTER (NOT certify AND hit AND NOT good) AS bad, count(*) FILTER (NOT certify AND hit) AS hits FROM x GROUP BY ALL),
  b AS (SELECT lang, rule, step, min(CASE WHEN bad >= greatest(1, hits * 0.5::DOUBLE) THEN cutoff END) OVER (PARTITION BY lang, rule ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM u),
  path AS MATERIALIZED (SELECT lang, step, {", ".join(f"max(best) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)} FROM b GROUP BY lang, step),
  n AS (SELECT tr.lang, step, count(*) AS n, count(*) FILTER ({_LOST}) AS k FROM tr JOIN path ON tr.lang IS NOT DISTINCT FROM path.lang WHERE good AND certify GROUP BY ALL),
  p AS (SELECT *, CASE WHEN k > n * 0.05::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
      + j * ln(0.05::DOUBLE) + (n - j) * ln(1 - 0.05::DOUBLE)))) END AS p FROM n),
  h AS (SELECT *, min(CASE WHEN p <= 0.1::DOUBLE / (SELECT count(DISTINCT coalesce(lang, chr(1))) FROM path) THEN 1 ELSE 0 END)
      OVER (PARTITION BY lang ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM p),
  c AS (SELECT path.* FROM path JOIN (SELECT lang, max(step) AS step FROM h WHERE held = 1 GROUP BY lang) l ON l.lang IS NOT DISTINCT FROM path.lang AND l.step = path.step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_LOST}) AS kept
FROM st LEFT JOIN c ON st.lang IS NOT DISTINCT FROM c.lang"""
