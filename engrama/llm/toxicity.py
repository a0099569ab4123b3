"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Suspicious spans (letters mixed with leetspeak signs, letters set apart by spaces or dots, letters three or more times
in a row) are character lattices: each observed character offers the letters it may stand for, its removal, or itself,
at a channel cost. A Viterbi search picks the string with the best sum of channel and character-trigram log
probabilities. All other tokens have one path only, themselves. The language model counts the character trigrams of the words of
all documents; trigrams with at least a millionth of all are kept, so the table has a
million entries at most, whatever the corpus.

Evidence is per word of the restored text: the word, its first 4 to 6 and its last 4 letters, each with the log odds of
documents labelled toxic. Features are counted over the fit rows on the executors; those that differ by `CLEAR` standard errors
are kept. A document's score is a logistic function of its strongest words' evidence, fitted on the same rows
with each document's own counts taken out (leave one out). `CLEAR` and the treatment of copies were chosen by the log loss of
cross-validation inside the fit rows (README).

`fit_rows` (40,000) labelled documents at most are used for fitting, those with the smallest hash of doc_id; labels only
decide in fitting, and only rows whose crc32(doc_id) mod 3 is not 1. Fit rows with the same label and the same three min-hashes
of 3-word shingles are copies and count once. All documents are scored, over whole texts.

Nulls and edge cases: null and blank texts have no evidence and get the score of none; a null doc_id is scored, its fold
is that of the empty text and it never matches a label; a document with several labels is toxic if one says so; null labels are ignored;
without both labels in the fit rows every score is the share of toxic ones (0 without any); repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.shared import stage, table

FIT_ROWS = 40_000
#: A feature counts from this many standard errors between toxic and other documents.
CLEAR = 5.0
#: Trigrams of the language model have at least this share of all.
RARE = 1e-6
#: Python workers hold so much at most, since they live on and keep what they once took: characters whose trigrams are counted at once,
#: features counted before they are handed on, and words, readings or weights of tokens kept so as not to work them out again.
CHARS, FEATURES, KEEP = 1 << 18, 50_000, 30_000
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h"}
EDGE = ".,;:?\"'()[]{}<>«»„“”!"
LETTERS = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
DOTTED = re.compile(r"\w(?:[.\-_*~/]+\w){3,}")


def readings(c: str, last: str) -> list[tuple[str, float]]:
    """What a character after `last` may stand for, with the channel's log weight."""
    if c in LEET:
        return [(x, -0.5) for x in LEET[c]] + [("", -4.0)]
    if LETTERS.match(c):
        return [(c, -0.1)] + ([("", -0.7)] if c == last else [])
    if c.isspace() or c in ".-_*~/'":
        return [("", -0.3), (" ", -1.5)]
    return [("", -0.5)]


@lru_cache(1)
def _letters():
    """For each code point whether it is a letter, as in LETTERS, and whether it is a sign that stands for one."""
    import numpy as np

    letter = np.array([LETTERS.match(chr(c)) is not None for c in range(0x110000)])
    sign = np.zeros(0x110000, dtype=bool)
    sign[[ord(c) for c in LEET]] = True
    return letter, sign


def text_trigrams(text: str) -> Counter:
    """Character trigrams of the words (runs of letters) of a lower-case text; a space is the word's edge, two stand before it.
    Tokens with a sign in front of a letter or with a letter three times in a row are left out: they may be disguised."""
    import numpy as np

    if not text:
        return Counter()
    letter, sign = _letters()
    raw = np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = letter[raw]
    odd = np.zeros(len(raw), dtype=bool)
    odd[:-1] = sign[raw[:-1]] & is_letter[1:]
    odd[:-2] |= is_letter[:-2] & (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:])
    if odd.any():
        token = np.cumsum(raw <= 32)
        left_out = np.zeros(token[-1] + 1, dtype=bool)
        left_out[token[odd]] = True
        is_letter &= ~left_out[token]
    here = np.flatnonzero(np.bincount(raw[is_letter], minlength=1))
    k = len(here) + 1
    x = np.zeros(len(raw), dtype=np.int64)
    x[is_letter] = np.searchsorted(here, raw[is_letter]) + 1
    before = np.where(x[1:-1] > 0, x[:-2], 0)
    code = ((before * k + x[1:-1]) * k + x[2:])[(x[2:] > 0) | (x[1:-1] > 0)]
    if k**3 <= 1 << 20:
        sums = np.bincount(code)
        found = np.flatnonzero(sums)
        sums = sums[found]
    else:
        found, sums = np.unique(code, return_counts=True)
    names = [" ", *map(chr, here.tolist())]
    return Counter({names[c // (k * k)] + names[c // k % k] + names[c % k]: n for c, n in zip(found.tolist(), sums.tolist())})


class CharModel:
    """Interpolated character trigrams over words; a space is the word's edge."""

    def __init__(self, trigrams: dict[str, int]):
        self.tri = dict(trigrams)
        # every trigram ends where a bigram and a letter end, so their counts follow
        self.bi, self.uni, self.ctx2, self.ctx1 = Counter(), Counter(), Counter(), Counter()
        for k, n in self.tri.items():
            self.bi[k[1:]] += n
            self.uni[k[2]] += n
            self.ctx2[k[:2]] += n
            self.ctx1[k[1]] += n
        self.total = sum(self.uni.values()) + 1
        self.kept: dict[str, float] = {}

    def logp(self, a: str, b: str, c: str) -> float:
        k = a + b + c
        if k not in self.kept:
            if len(self.kept) >= KEEP:
                self.kept.clear()
            p3 = self.tri.get(k, 0) / (self.ctx2.get(a + b, 0) or 1)
            p2 = self.bi.get(b + c, 0) / (self.ctx1.get(b, 0) or 1)
            p1 = (self.uni.get(c, 0) + 0.01) / self.total
            self.kept[k] = math.log(0.7 * p3 + 0.2 * p2 + 0.1 * p1 + 1e-9)
        return self.kept[k]

    def decode(self, span: str) -> str:
        """Best reading of an observed span (lower case), by Viterbi over states of the last two letters."""
        beam = {(" ", " "): (0.0, None, "")}
        last = ""
        for c in span:
            ways = readings(c, last)
            new: dict[tuple, tuple] = {}
            for (a, b), node in beam.items():
                for x, cost in ways:
                    if x:
                        if x == " " and b == " ":
                            continue
                        state = (" ", " ") if x == " " else (b, x)
                        score = node[0] + cost + self.logp(a, b, x)
                    else:
                        state, score = (a, b), node[0] + cost
                    if state not in new or score > new[state][0]:
                        new[state] = (score, node, x)
            beam, last = new, c
        node = max(beam.items(), key=lambda kv: kv[1][0] + self.logp(*kv[0], " "))[1]
        out = []
        while node:
            out.append(node[2])
            node = node[1]
        return "".join(reversed(out)).strip()


def suspicious(token: str) -> bool:
    if token.isalpha():
        return bool(TRIPLE.search(token))
    core = token.strip(EDGE)
    if not core or core.isalpha():
        return bool(TRIPLE.search(core))
    letters = sum(c.isalpha() for c in core)
    if letters and core.strip("#*$%&|+@").isalpha():
        return bool(TRIPLE.search(core)) or core[0] in "@$|" and len(core) > 1 and core[1].isalpha()
    return letters >= 2 and any(c in LEET for c in core) or bool(DOTTED.search(core))


class Restorer:
    """Restores texts; readings of suspicious tokens are kept, up to `keep` of them."""

    def __init__(self, model: CharModel, keep: int = KEEP):
        self.model, self.keep, self.known = model, keep, {}

    def token(self, token: str) -> str:
        if not suspicious(token):
            return token
        if token not in self.known:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[token] = self.model.decode(token.strip(EDGE.replace("!", "")))
        return self.known[token]

    def tokens(self, text: str | None) -> set[str]:
        """Distinct tokens of the restored text (lower case)."""
        low = (text or "").lower()
        seen = set(low.split())
        plain = {t for t in seen if t.isalpha()}
        rest = set()
        for t in seen - plain:
            core = t.strip(EDGE)
            if core.isalpha():
                plain.add(core)
            else:
                rest.add(t)
        if TRIPLE.search(low):
            odd = {t for t in plain if TRIPLE.search(t)}
            plain -= odd
            rest |= odd
        plain.update([self.token(t) for t in rest])
        for m in SPACED.finditer(low):
            plain.update(self.model.decode(m[0]).split())
        return plain

    def text(self, text: str | None) -> str:
        low = SPACED.sub(lambda m: self.model.decode(m[0]), (text or "").lower())
        return re.sub(r"\S+", lambda m: self.token(m[0]), low)


def features(word: str) -> list[str]:
    found = ["w:" + word]
    if len(word) > 4:
        found += ["p4:" + word[:4], "s4:" + word[-4:]]
    if len(word) > 5:
        found.append("p5:" + word[:5])
    if len(word) > 6:
        found.append("p6:" + word[:6])
    return found


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic of at most fit_rows labelled documents outside the held-out fold."""
    truth = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    truth = truth.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(truth), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # at most fit_rows pairs of numbers


def one_of_copies(sample: DataFrame) -> DataFrame:
    """One row of those with the same label and the same three min-hashes of 3-word shingles, so that copies don't pass for evidence."""
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "")
    hashes = F.expr("CASE WHEN size(_w) < 3 THEN array(xxhash64(array_join(_w, ' '))) ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END")
    least = [F.expr(f"array_min(transform(_h, x -> xxhash64(x, {i})))").alias(f"_m{i}") for i in range(3)]
    keyed = sample.withColumn("_w", w).withColumn("_h", hashes).select("text", "toxic", *least)
    return keyed.groupBy("toxic", "_m0", "_m1", "_m2").agg(F.min("text").alias("text")).select("text", "toxic")


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Scorer:
    """Evidence of tokens and the logistic function over it. counts: feature -> (toxic, other) documents."""

    def __init__(self, restorer: Restorer, counts: dict, toxic: int, other: int):
        self.restorer, self.counts, self.toxic, self.other = restorer, counts, toxic, other
        self.known: dict[str, tuple] = {}
        self.seen: dict[str, float] = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        self.coef: list[float] | None = None
        self.tables: dict[str, dict[str, float]] = {}

    def seal(self) -> None:
        """Fix the evidence of every feature, for scoring."""
        self.known = {}
        parts = [f.split(":", 1) for f in self.counts]
        # a word without one of these beginnings and endings has no evidence
        self.heads = {x[:4] for k, x in parts if k != "s4"}
        self.tails = {x for k, x in parts if k == "s4"}
        self.tables = {kind: {} for kind in ("w", "p4", "s4", "p5", "p6")}
        for f in self.counts:
            kind, part = f.split(":", 1)
            self.tables[kind][part] = self.log_odds(f, 0, 0)

    def log_odds(self, feature: str, dt: int, dn: int) -> float:
        t, n = self.counts[feature]
        a, b = max(t - dt, 0) + 0.5, max(n - dn, 0) + 0.5
        return min(math.log(a / (self.toxic - dt + 1)) - math.log(b / (self.other - dn + 1)), 8.0)

    def weight(self, token: str) -> float:
        """Strongest evidence of a token, by the fixed tables; kept for the tokens seen last."""
        if token in self.seen:
            return self.seen[token]
        best = 0.0
        w, p4, s4, p5, p6 = self.tables.values()
        for word in (token,) if token.isalpha() else LETTERS.findall(token):
            best = max(best, w.get(word, 0.0))
            if (n := len(word)) > 4:
                best = max(best, p4.get(word[:4], 0.0), s4.get(word[-4:], 0.0))
                if n > 5:
                    best = max(best, p5.get(word[:5], 0.0))
                    if n > 6:
                        best = max(best, p6.get(word[:6], 0.0))
        if len(self.seen) >= KEEP:
            self.seen.clear()
        self.seen[token] = best
        return best

    def weights(self, token: str) -> tuple[float, float, float]:
        """Strongest evidence of a token; the same without one toxic document; without one other document."""
        if token not in self.known:
            if len(self.known) >= KEEP:
                self.known.clear()
            best = [0.0, 0.0, 0.0]
            for word in LETTERS.findall(token):
                for f in features(word):
                    if f in self.counts:
                        for k, (dt, dn) in enumerate(((0, 0), (1, 0), (0, 1))):
                            best[k] = max(best[k], self.log_odds(f, dt, dn))
            self.known[token] = tuple(best)
        return self.known[token]

    def evidence(self, text: str | None, own: int | None = None) -> list[float]:
        """own: the document's label while fitting, to leave it out."""
        if own is None:
            heads, tails = self.heads, self.tails
            near = [t for t in self.restorer.tokens(text) if t[:4] in heads or t[-4:] in tails or not t.isalpha()]
            found = [w for t in near if (w := self.weight(t)) > 0.7]
        else:
            found = [w for t in self.restorer.tokens(text) if (w := self.weights(t)[1 if own else 2]) > 0.7]
        found.sort(reverse=True)
        return [found[0] if found else 0.0, sum(found[:3]), math.log1p(sum(w > 1.5 for w in found)), math.log1p(len(found))]

    def score(self, text: str | None) -> float:
        if self.coef is None:
            return self.toxic / max(self.toxic + self.other, 1)
        z = self.coef[0] + sum(c * x for c, x in zip(self.coef[1:], self.evidence(text)))
        return 1 / (1 + math.exp(-max(min(z, 40), -40)))


def _logistic(x, y, ridge: float = 0.05):
    """Newton's method; the first coefficient is the constant."""
    import numpy as np

    x = np.hstack([np.ones((len(x), 1)), x])
    c, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ c)
        c += step
        if np.abs(step).max() < 1e-7:
            break
    return c.tolist()


def _pieces(columns: list[str], rows, size: int = 20_000):
    """Frames of at most `size` rows, the first column as plain objects."""
    rows = list(rows)
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pd.DataFrame({c: pd.Series([r[k] for r in part], dtype="int64" if k else object) for k, c in enumerate(columns)})


def language_model(docs: DataFrame, rare: float = RARE) -> CharModel:
    """Character trigrams of the words of all documents."""

    def count(batches):
        found, texts, size = Counter(), [], 0
        for b in batches:
            for t in b["text"]:
                for i in range(0, len(t or ""), 1 << 22):
                    texts.append(t[i : i + (1 << 22)].lower())
                    size += len(texts[-1])
                    if size > CHARS:
                        found.update(text_trigrams("\n".join(texts)))
                        texts, size = [], 0
                        if len(found) > FEATURES:
                            yield from _pieces(["tri", "n"], found.items())
                            found.clear()
        found.update(text_trigrams("\n".join(texts)))
        yield from _pieces(["tri", "n"], found.items())

    counts = stage(docs.select("text").mapInPandas(count, "tri string, n long").groupBy("tri").agg(F.sum("n").alias("n")), "trigrams")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return CharModel({r["tri"]: r["n"] for r in counts.where(F.col("n") >= F.lit(total * rare)).collect()})  # 1 / rare rows at most


def count_features(restorer_bc):
    """A function over batches of text, toxic: rows (feature, toxic documents, others); a feature may come more than once."""

    def count(batches):
        seen: dict[str, list[int]] = {}
        known: dict[str, list[str]] = {}
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                found: set[str] = set()
                for x in restorer_bc.value.tokens(t):
                    if x not in known:
                        if len(known) >= KEEP:
                            known.clear()
                        known[x] = [f for w in LETTERS.findall(x) for f in features(w)]
                    found.update(known[x])
                for f in found:
                    seen.setdefault(f, [0, 0])[0 if y else 1] += 1
                if len(seen) > FEATURES:
                    yield from _pieces(["f", "t", "n"], ((f, *n) for f, n in seen.items()))
                    seen.clear()
        yield from _pieces(["f", "t", "n"], ((f, *n) for f, n in seen.items()))

    return count


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, clear: float = CLEAR) -> Scorer:
    import numpy as np

    sc = docs.sparkSession.sparkContext
    sample = stage(one_of_copies(fit_sample(docs, labels, fit_rows)), "toxic_fit")
    restorer = Restorer(language_model(docs))
    bc = sc.broadcast(restorer)

    counted = count_features(bc)

    size = {r["y"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).alias("y")).agg(F.count("*").alias("n")).collect()}
    toxic, other = size.get(True, 0), size.get(False, 0)
    scorer = Scorer(restorer, {}, toxic, other)
    if not toxic or not other:
        return scorer
    counts = sample.mapInPandas(counted, "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    p = (F.col("t") + F.col("n")) / (toxic + other)
    z = (F.col("t") / toxic - F.col("n") / other) / F.sqrt(p * (1 - p) * (1 / toxic + 1 / other) + 1e-12)
    best = counts.where("t + n >= 3").withColumn("z", z).where(F.col("z") >= clear)
    scorer.counts = {r["f"]: (r["t"], r["n"]) for r in best.collect()}  # features of the fit rows at most
    bc2 = sc.broadcast(scorer)

    def evidence(batches):
        for b in batches:
            rows = [bc2.value.evidence(t, int(y == 1)) for t, y in zip(b["text"], b["toxic"])]
            yield pd.DataFrame({"y": (b["toxic"] == 1).astype("int32"), "x": rows})

    got = sample.mapInPandas(evidence, "y int, x array<double>").collect()  # fit_rows short rows at most
    scorer.coef = _logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float))
    scorer.seal()
    return scorer


def score_column(text, scorer_bc):
    @F.pandas_udf("double")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([scorer_bc.value.score(x) for x in t], dtype="float64")

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, with score and predicted in front; `restored_text` gives the restored texts themselves."""
    bc = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))
    scored = docs.select(score_column(F.col("text"), bc).alias("_score"), F.struct("*").alias("_row"))
    return scored.select(F.col("_score").alias("tox_score"), (F.col("_score") >= threshold).cast("int").alias("tox_predicted"), "_row.*")


def restored_text(docs: DataFrame, scorer: Scorer) -> DataFrame:
    bc = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([bc.value.restorer.text(x) for x in t], dtype=object)

    return docs.select("doc_id", run("text").alias("restored"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))
