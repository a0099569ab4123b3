"""Training-data operators against brute force on small fixtures, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("engrama.llm")
from engrama.llm import components, decontamination, htmltext, lmjoins, lmscore, mixing, quality, sharding, shared, simhash, toxicity, urlfilter, warc  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, shard int, node long, rank int, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0, 1, "x", 9, 9, 9, 0.5) for i, t, lang, src in rows], SCHEMA)


def text(n, seed=1):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{x % 997}")
    return " ".join(out)


ODD = [
    (0, None, "en", "src0"), (1, "", None, None), (2, " \t\n", "en", "src1"), (3, "one", "de", "src11"), (4, text(80), "en", "src0"), (4, text(80), "en", "src0"),
    (5, text(80) + " tail", "en", "src0"), (None, text(60, 7), "fr", "src2"), (6, "ab\x00c é\U0001f600 " * 40, "en", "src0"), (7, text(30_000, 3), "en", "src0"), (8, "a\nb\na\n\n \n \nb", "en", "src0"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 1), (7, 1, 0), (99, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def stats_of(t):
    t = t or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, odd, labels):
    extra = [(20 + i, t, "en", "s") for i, t in enumerate(["a b c a b c d", "a a a a", "x y", "a b c d a b c x a b c", "## a|b", " lead and trail "])]
    d = odd.unionByName(docs(spark, extra))
    got = quality.quality_rules(d, labels).collect()
    want = sorted(((i, *stats_of(t)) for i, t, _, _ in ODD + extra), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=str) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(d.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.1), (20, 1000, 0.03), (150, 20000, 0.01)])
def test_binomial(spark, k, n, p):
    got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first()["x"]
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
    assert got == pytest.approx(want, rel=1e-8)


TRIALS = "text_key string, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base boolean, quality int"


def key_of(x):
    return hashlib.md5(str(x).encode()).hexdigest()


def test_cutoffs_are_certified(spark):
    """Clean and junk documents: the symbol rule is certified and loses no more than allowed, also with few documents."""
    rows = [(key_of(i), "en", 100, 500, 80 if i % 11 == 0 else i % 2, 0, 0, False, 0 if i % 11 == 0 else 1) for i in range(400)]
    cut = quality.certified_cutoffs(spark.createDataFrame(rows, TRIALS), "lang").first()
    assert 0.02 < cut["cut_symbols"] <= 0.8 and cut["cut_repeats"] is None
    few = quality.certified_cutoffs(spark.createDataFrame(rows[:60], TRIALS), "lang").collect()
    assert not few
    with pytest.raises(ValueError):
        quality.certified_cutoffs(spark.createDataFrame(rows, TRIALS), "lang", rules={"a": ("n_words", [1.0]), "b": ("n_words", [1.0, 2.0])})


def test_copies_are_one_trial(spark):
    """70 texts, however often repeated, aren't enough for a cutoff."""
    rows = [(key_of(i % 70), "en", 100, 500, 80 if i % 70 % 7 == 0 else 0, 0, 0, False, int(i % 70 % 7 > 0)) for i in range(7000)]
    assert not quality.certified_cutoffs(spark.createDataFrame(rows, TRIALS), "lang").collect()


def test_false_rejections_are_rare(spark):
    """200 languages with the same odds, of which some will look better than they are by chance: of all, at most a tenth may lose
    more than alpha of their good documents to certified rules, with documents repeated up to nine times."""
    import random

    rng, rows = random.Random(11), []
    for s in range(200):
        for i in range(300):
            good = rng.random() < 0.8
            # any symbol cutoff at or below 0.5 loses 8 % of the good ones
            n = 60 if not good or rng.random() < 0.08 else 0
            rows += [(key_of((s, i)), f"l{s:03d}", 100, 500, n, 0, 0, False, int(good))] * rng.choice([1, 1, 1, 9])
    wrong = quality.certified_cutoffs(spark.createDataFrame(rows, TRIALS), "lang", delta=0.1 * 200).where("cut_symbols <= 0.5").count()
    # delta times strata is the level of each stratum here: 0.1
    assert wrong <= 0.1 * 200


def brute_components(fps):
    names = sorted(fps)
    up = {i: i for i in names}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in names:
        for b in names:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in names}


def test_simhash_of_odd_texts(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["fp"] % (1 << 64))
    for i, t, _, _ in ODD:
        assert simhash.simhash64(t) in by[i]
    want = brute_components({i: simhash.simhash64(t) for i, t, _, _ in ODD if i is not None})
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(i) for i in {want[i] for i in want}] + ["None"])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1024, 3])
def test_hamming_links_lose_no_component(spark, crowd):
    """Clusters of fingerprints around centres, also with the path for crowded keys."""
    x, fps = 88172645463325252, []
    for c in range(12):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        fps.append(x)
        for j in range(14):
            y = (x * (j + 3)) >> 13
            fps.append(x ^ (1 << (y % 64)) ^ (1 << ((y >> 7) % 64)) ^ ((1 << ((y >> 13) % 64)) if j % 3 else 0) ^ ((1 << ((y >> 19) % 64)) if j % 4 == 0 else 0))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd=crowd)
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute_components({s: f for s, f in zip(signed, fps)})
    assert all(got.get(s, s) == want[s] for s in signed)


def test_components_of_a_long_path(spark):
    e = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components.components(e).collect()} == {1}


def brute_lm(texts):
    ws = [(t or "").encode().lower().split() for t in texts]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w in ws:
        c1.update(w), c2.update(zip(w, w[1:])), c3.update(zip(w, w[1:], w[2:]))
    n, out = sum(c1.values()), []
    for w in ws:
        s = 0.0
        for i, c in enumerate(w):
            a, b = (w[i - 2] if i > 1 else None), (w[i - 1] if i else None)
            if a is not None and c3[a, b, c] >= 2:
                s += math.log(c3[a, b, c] / c2[a, b])
            elif b is not None and c2[b, c] >= 2:
                s += (math.log(0.4) if a is not None else 0) + math.log(c2[b, c] / c1[b])
            else:
                s += math.log(0.4) * (0 if b is None else 1 if a is None else 2) + math.log(c1[c] / n)
        out.append((len(w), round(s, 4)))
    return out


@pytest.mark.parametrize(
    "form,how",
    [(lmscore, {}), (lmscore, {"buckets": 4, "hot": 0.01, "chunk": 50}), (lmscore, {"per_bucket": 300, "passes": 3}), (lmjoins, {}), (lmjoins, {"hot": 40, "passes": 3})],
)
def test_lm_scores(spark, odd, form, how):
    extra = [(30, "the cat sat on the mat the cat sat", "en", "s"), (31, "The the THE the", "en", "s"), (32, "the cat", "en", "s")]
    got = form.score(odd.unionByName(docs(spark, extra)), **how).collect()
    rows = ODD + extra
    want = sorted(((i, *s) for (i, _, _, _), s in zip(rows, brute_lm([t for _, t, _, _ in rows]))), key=str)
    have = sorted(((r["doc_id"], r["n_words"], r["total"]) for r in got), key=str)
    assert [x[:2] for x in have] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 0.001 for a, b in zip(have, want))
    assert all(r["score"] == pytest.approx(r["total"] / max(r["n_words"], 1), abs=1e-4) for r in got)
    assert form.score(odd.limit(0), **how).count() == 0


def fill(total, caps, weights):
    """Water-filling by repeated passes."""
    got, open_ = {k: 0.0 for k in caps}, {k for k in caps if weights[k] > 0}
    left = float(total)
    while open_ and left > 1e-9:
        share = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if got[k] + share * weights[k] >= caps[k]}
        for k in full or open_:
            step = caps[k] - got[k] if full else share * weights[k]
            got[k] += step
            left -= step
        open_ -= full
        if not full:
            break
    return got


LEAF = "domain string, lang string, source string, tokens long"


def budgets(spark, leaves, budget, weights, epochs=1):
    found = mixing.leaf_budgets(spark.createDataFrame(leaves, LEAF), budget, weights, epochs).collect()
    assert len(found) == len(leaves)
    return {(r["domain"], r["lang"], r["source"]): r["budget"] for r in found}


def filled(leaves, budget, weights):
    """Budgets as fractions, level by level, by water-filling; subtrees of weight 0 can give nothing."""
    w = lambda path: max(weights.get(path, 1) or 0, 0)
    room = {}
    for d, g, x, n in leaves:
        if w((d, g, x)) and w((d, g)) and w((d,)):
            for path in ((), (d,), (d, g), (d, g, x)):
                room[path] = room.get(path, 0) + n
    given = {(): min(budget, room.get((), 0))}
    for depth in range(3):
        for up in [p for p in given if len(p) == depth]:
            kids = [p for p in room if len(p) == depth + 1 and p[:depth] == up]
            given |= fill(given[up], {p: room[p] for p in kids}, {p: w(p) for p in kids})
    return {(d, g, x): given.get((d, g, x), 0.0) for d, g, x, _ in leaves}


def test_budgets_go_to_siblings_first(spark):
    leaves = [("core", "en", "a", 100), ("core", "en", "b", 1000), ("core", "de", "a", 50), ("extra", "en", "c", 5000)]
    got = budgets(spark, leaves, 1200, {"core": 1, "extra": 1})
    want = filled(leaves, 1200, {("core",): 1, ("extra",): 1})
    assert got == {k: int(v) for k, v in want.items()} and got["core", "de", "a"] == 50 and got["extra", "en", "c"] == 600


@pytest.mark.parametrize(
    "weights",
    [{("core", "en", "z"): 0}, {("zz",): 0}, {("core",): None, ("core", "en"): 5}, {("core", "de"): -1, ("extra",): 0.3}, {("extra", "en", "c"): 0, ("extra", "en"): 0}, {("core", "en/x"): 7, ("extra",): float("nan")}],
)
def test_odd_weights(spark, weights):
    """Weights of 0, null, below 0 and not a number, subtrees without any weight, and names with /."""
    leaves = [("core", "en", "a", 101), ("core", "en", "z", 999), ("core", "en/x", "y", 77), ("core", "en", "x/y", 88), ("extra", "en", "c", 500), ("zz", "", "", 300), ("core", "de", "a", 13)]
    nan = {k: 0 if v is not None and v != v else v for k, v in weights.items()}
    for budget in (7, 333, 1200, 10**6):
        got, want = budgets(spark, leaves, budget, weights), filled(leaves, budget, nan)
        assert sum(got.values()) == round(sum(want.values()))
        # each of the three levels rounds by less than a token
        assert all(abs(got[k] - want[k]) < 3 and (want[k] > 0 or got[k] == 0) for k in got)


def test_no_weight_at_all(spark):
    assert set(budgets(spark, [("core", "en", "a", 10), ("extra", "en", "a", 10)], 10, {"core": 0, "extra": 0}).values()) == {0}


def test_names_with_slashes_come_out_once(spark):
    d = docs(spark, [(i, text(9, i), *(("en/x", "y") if i % 2 else ("en", "x/y"))) for i in range(40)])
    got = [(r["doc_id"], r["lang"]) for r in mixing.mix(d, {("extra", "en/x"): 3}, budget=0.5).collect()]
    assert len(got) == len(set(got)) and sum(1 for _, g in got if g == "en/x") in (15, 14)


def test_mix_takes_prefixes_of_seeded_epochs(spark, odd):
    rows = [(100 + i, text(5 + i % 7, i + 1), "en" if i % 3 else "de", f"src{i % 4 + (8 if i % 5 else 0)}") for i in range(300)]
    d = odd.unionByName(docs(spark, rows))
    got = mixing.mix(d, mixing.WEIGHTS, budget=0.6, max_epochs=3, levels=2, bits=2).collect()
    supply = defaultdict(list)
    for i, t, lang, src in ODD + rows:
        if n := len(WORDS.findall(t or "")):
            dom = "core" if re.search("^src[0-9]$", src or "") else "extra"
            supply[dom, lang or "", src or ""].append((i, n))
    leaves = spark.createDataFrame([(*k, sum(n for _, n in v)) for k, v in supply.items()], "domain string, lang string, source string, tokens long")
    budgets = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(leaves, 0.6, mixing.WEIGHTS, 3).collect()}
    want = Counter()
    for leaf, ds in supply.items():
        left, total = budgets[leaf], sum(n for _, n in ds)
        for epoch in range(3):
            place = lambda i, e=epoch: int(hashlib.md5(f"17:{e}:{'' if i is None else i}".encode()).hexdigest()[:12], 16)
            if left >= total:
                want.update((i, epoch) for i, _ in ds)
                left -= total
                continue
            for i, n in sorted(ds, key=lambda x: (place(x[0]), x[0] or -1)):
                if n > left:
                    break
                left -= n
                want[i, epoch] += 1
            break
    assert Counter((r["doc_id"], r["epoch"]) for r in got) == want
    kept = mixing.mix(d, mixing.WEIGHTS, budget=0.9, carry=d.columns, bare=True)
    assert kept.columns == d.columns and 0 < kept.count() <= d.count()
    assert mixing.mix(d.limit(0), mixing.WEIGHTS).count() == 0


def test_sharding(spark, odd):
    rows = [(100 + i, "same" if i % 3 == 0 else f"pair {i // 2}", "en", "s") for i in range(400)]
    d = odd.unionByName(docs(spark, rows))
    got = sharding.shard_documents(d, 8).collect()
    assert len(got) == d.count()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r["size"] for r in got if r["doc_id"] == 0} == {8}
    split = defaultdict(set)
    for r in got:
        if r["doc_id"] and r["doc_id"] >= 100 and (r["doc_id"] - 100) % 3:
            split[(r["doc_id"] - 100) // 2].add(r["shard"])
    pairs = [s for k, s in split.items() if all((2 * k + j) % 3 for j in (0, 1))]
    assert sum(len(s) == 1 for s in pairs) > 0.6 * len(pairs)
    assert sharding.shard_documents(d.limit(0), 8).count() == 0
    assert len({r["shard"] for r in sharding.shard_documents(odd.limit(3), 8).collect()}) == 3


def test_shards_go_by_content(spark):
    """The same rows in another order and other partitions get the same shards and slots; groups that fit stay whole."""
    rows = [(i, f"group {i % 37}" if i % 2 else f"alone {i}", "en", "s") for i in range(600)] + [(7, "twice", "en", "s")] * 2
    d = docs(spark, rows)
    a, b = (sorted(map(tuple, sharding.shard_documents(x, 8).collect()), key=str) for x in (d, d.orderBy(F.desc("text")).repartition(7)))
    assert a == b
    where = defaultdict(Counter)
    crc = {i: r for i, r in ((r[0], r) for r in a)}
    for i, t, _, _ in rows:
        where[t][crc[i][4]] += 1
    apart = sum(n - max(c.values()) for t, c in where.items() if t.startswith("group") for n in [sum(c.values())])
    # by a hash of doc_id alone 7/8 of the members would be apart from the rest of their group
    assert apart < 0.1 * 300


def test_ranked_is_gapless(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("o"), "id")
    rows = shared.ranked(d, "g", ["o", "id"], "t").collect()
    for g in range(3):
        own = sorted((r["rank"], r["o"], r["id"]) for r in rows if r["g"] == g)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)


PROSE = "people talk about garden tools and quiet evenings near the river while the old train passes slowly".split()


@pytest.fixture(scope="module")
def scorer(spark):
    rows, lab = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [PROSE[(i * 7 + j * (3 + i % 5)) % len(PROSE)] for j in range(40)]
        if bad:
            w[5], w[20] = ("idiot", "moron")[i % 4 // 2], ("stupid", "trash")[i % 3 % 2]
        rows.append((i, " ".join(w), "en", "s"))
        lab.append((i, 1, int(bad)))
    return toxicity.fit(docs(spark, rows), spark.createDataFrame(lab, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("seen,plain", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("id1ooot", "idiot"), ("$tup1d", "stupid"), ("m.o.r.o.n", "moron"), ("garden", "garden"), ("tr@@@sh", "trash")])
def test_deobfuscation(scorer, seen, plain):
    assert scorer.restorer.text(f"quiet {seen} river") == f"quiet {plain} river"


def every_reading(model, span):
    """All strings a span may stand for, with their scores."""
    found = {(" ", " ", ""): 0.0}
    last = ""
    for c in span:
        new = {}
        for (a, b, out), score in found.items():
            for x, cost in toxicity.readings(c, last):
                if x == " " and b == " ":
                    continue
                key = (a, b, out) if not x else (" ", " ", out + x) if x == " " else (b, x, out + x)
                value = score + cost + (model.logp(a, b, x) if x else 0.0)
                new[key] = max(new.get(key, -math.inf), value)
        found, last = new, c
    best = {}
    for (a, b, out), score in found.items():
        best[out.strip()] = max(best.get(out.strip(), -math.inf), score + model.logp(a, b, " "))
    return best


def test_decoding_against_all_readings():
    """Viterbi's string has the best score of all strings that the lattice holds."""
    import random

    rng = random.Random(7)
    words = {"idiot": 9, "stupid": 7, "garden": 30, "ill": 3, "the": 90, "toll": 5, "bad": 4}
    model = toxicity.CharModel(plain_trigrams(Counter(words)))
    for _ in range(300):
        span = "".join(rng.choice("ab1d0t5iil!$3. *e-7@") for _ in range(rng.randint(1, 7)))
        scores = every_reading(model, span)
        assert scores[model.decode(span)] == pytest.approx(max(scores.values()), abs=1e-9), span


def plain_trigrams(words):
    out = Counter()
    for w, n in words.items():
        s = f"  {w} "
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += n
    return out


def kept_words(text):
    """Words of the tokens without a sign before a letter or a tripled letter."""
    out = Counter()
    for token in re.split(r"[\x00-\x20]", text):
        if not re.search(r"[0-9@$!|+(€*#][^\W\d_]", token) and not toxicity.TRIPLE.search(token):
            out.update(toxicity.LETTERS.findall(token))
    return out


def test_language_model_counts_all_documents(spark, odd):
    import random

    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("abé1$.! \n-ü日&") for _ in range(rng.randrange(60)))
        assert toxicity.text_trigrams(t) == plain_trigrams(kept_words(t)), t
    model = toxicity.language_model(odd, rare=0.0)
    want = Counter()
    for _, t, _, _ in ODD:
        want.update(plain_trigrams(kept_words((t or "").lower())))
    assert model.tri == dict(want)
    assert not toxicity.language_model(odd.limit(0)).tri


def test_marks_miss_none(spark):
    """The map before the joins of near copies marks every wanted hash, and few others."""
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    wanted, others = (rng.integers(-(1 << 63), 1 << 63, 9_000, dtype=np.int64) for _ in range(2))
    found = shared.marks(spark.createDataFrame([(int(x),) for x in wanted], "h long")).value
    assert shared.marked(found, wanted).all() and shared.marked(found, others).mean() < 0.1
    assert not shared.marked(shared.marks(spark.range(0).select("id")).value, others).any()


def test_toxicity_worker_memory():
    """A worker counts features and trigrams in bounded memory, and its pieces sum to the whole."""
    import tracemalloc

    pd = pytest.importorskip("pandas")
    restorer = toxicity.Restorer(toxicity.CharModel({}))
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(6)) for i in range(0, 26**6, 4001)]
    batches = [pd.DataFrame({"text": [" ".join(names[i : i + 200] + ["same"])], "toxic": [i // 200 % 2]}) for i in range(0, len(names), 200)]
    held = type("Held", (), {"value": restorer})
    seen = Counter()
    tracemalloc.start()
    for piece in toxicity.count_features(held)(batches):
        for f, t, n in zip(piece["f"], piece["t"], piece["n"]):
            if f in ("w:same", "w:" + names[40_000], "w:" + names[40_200]):
                seen[f, "toxic"] += t
                seen[f, "other"] += n
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen["w:same", "toxic"] + seen["w:same", "other"] == len(batches)
    assert (seen["w:" + names[40_000], "other"], seen["w:" + names[40_200], "toxic"]) == (1, 1)
    assert most < 45e6, most
    scorer = toxicity.Scorer(restorer, {"w:same": (5, 5)}, 5, 5)
    for b in batches:
        scorer.evidence(b["text"][0], 1)
    assert len(scorer.known) <= toxicity.KEEP and len(restorer.known) <= toxicity.KEEP


def test_toxicity_scores(spark, scorer, odd, labels):
    clean, bad = " ".join(PROSE * 3), " ".join([*PROSE, "1d10t", *PROSE, "s t u p i d", *PROSE])
    assert scorer.score(bad) >= 0.7 > 0.3 > scorer.score(clean)
    assert scorer.score(None) == scorer.score("") == scorer.score("  ")
    out = toxicity.toxicity(odd, labels)
    assert out.columns[2:] == odd.columns and out.count() == len(ODD)
    assert all(0 <= r["tox_score"] <= 1 for r in out.collect())
    assert toxicity.toxicity(odd.limit(0), labels.limit(0)).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).where("tox_predicted = 1").count() == 0


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><header><p>Site</p></header>'
    '<div class="ad">Buy</div><aside>Side</aside><article><h1>Head &amp; tail</h1><p>One  two\n<b>three</b><br>four<p>five<script>var a="</p>";</script>'
    '<div class="comments"><p>Reader</p></div><form><p>Field</p></form>six</article><div id="cookie-notice">OK</div><footer>&copy; F</footer></body></html>'
)


def test_html_text(spark):
    rows = [(1, "http://a.example/1", PAGE), (1, "http://a.example/1", PAGE), (2, "http://a.example/2", None), (3, None, "<p>plain <i>te</i>xt"), (None, "x", ""), (4, "http://b.example/", "<nav>m</nav><div><p>Body text</p></div><footer>f</footer>"), (5, "http://a.example/9", "<article>cut <p>of")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.main_text(d).collect()), key=str)
    one = "Head & tail One two three four five six"
    want = [(1, one, len(one))] * 2 + [(2, "", 0), (3, "plain text", 10), (4, "Body text", 9), (5, "cut of", 6), (None, "", 0)]
    assert got == sorted(want, key=str)
    assert htmltext.main_text(d.limit(0)).count() == 0


def test_html_of_mixed_templates(spark):
    """Pages without article on a host that has articles keep their text; so do pages without host."""
    rows = [(1, "http://a.example/1", "<div><p>Around</p></div><article><p>Story</p></article>"), (2, "http://a.example/2", "<nav>m</nav><div><p>Plain page</p></div>"), (3, None, "<main><p>Inner</p></main>"), (4, None, "<p>No host</p>")]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Story", 2: "Plain page", 3: "Inner", 4: "No host"}


def test_wrapper_alignment():
    a, b = ["nav/a", "nav/a", "h1", "p", "p", "foot"], ["nav/a", "h1", "note", "p", "foot"]
    merged = htmltext.merge([htmltext.json.dumps(htmltext.fold(x)[0]) for x in (a, b)])
    assert htmltext.shown(merged) == "(<nav/a>#text)+ (<h1>#text) (<note>#text)? (<p>#text)+ (<foot>#text)"
    assert htmltext.fold(["a", "b", "a", "b", "c"]) == ([[["a", "b"], True, False, None], [["c"], False, False, None]], [4, 1])
    # a group that one page repeats is the same group where it stands once
    merged = htmltext.merge([htmltext.json.dumps(htmltext.fold(x)[0]) for x in (["h2", "p", "h2", "p", "x"], ["h2", "p", "x"])])
    assert htmltext.shown(merged) == "(<h2>#text <p>#text)+ (<x>#text)"


def test_irregular_pages_have_short_expressions():
    import random

    rng = random.Random(1)
    names = ["nav/a", *[f"article/{rng.choice(['p', 'h2', 'ul/li', 'pre', 'table/tr/td'])}" for _ in range(30_000)], "footer"]
    nodes, counts = htmltext.fold(names)
    assert len(nodes) <= htmltext.LONG and sum(counts) == len(names)
    assert [n[0] for n in nodes][0] == ["nav/a"] and nodes[-1][0] == ["footer"]
    whole = htmltext.merge([htmltext.json.dumps(nodes), htmltext.json.dumps(htmltext.fold(["nav/a", "article/p", "article/h2", "footer"])[0])])
    places = htmltext.matched(whole, htmltext.json.dumps(htmltext.fold(["nav/a", "article/p", "article/h2", "footer"])[0]))
    assert places[0] == 0 and places[1] == places[2] > 0 and places[3] > places[2]


def story(i, n):
    return [f"Paragraph {j} of story {i} tells of {text(12, 100 * i + j)}." for j in range(n)]


def template_pages(hosts=3, pages=12):
    """(url, html, main text): each host has its own words around its stories, without telling class names."""
    for h in range(hosts):
        for i in range(pages):
            paras, title = story(50 * h + i, 1 + (i * 7 + h) % 5), f"Title {h} {i}"
            body = "".join(f"<p>{x}</p>" for x in paras)
            if h == 0:  # no article element; the site's words stand before and after
                page = f"<div class=x1><p>Welcome to our place on the web</p></div><div class=x2><h1>{title}</h1>{body}</div><div class=x3><p>Call us today for more</p></div>"
                if i % 3 == 0:
                    page = page.replace("<div class=x2>", "<div class=x4><p>Our shop is closed on Sunday, please come back later</p></div><div class=x2>")
            elif h == 1:  # words of the site inside the article, an optional box, classes that only sound like boxes
                extra = f"<p class=share-price>The share price of firm {i} fell by {i} percent in the course of the day.</p>" if i % 2 else ""
                page = f"<article><h1>{title}</h1><h4>You are reading the daily paper</h4>{body}{extra}<h5>Tell your friends about us</h5><div class='related'><p><a href=/a>Other {i}</a></p></div></article>"
                paras = paras + ([f"The share price of firm {i} fell by {i} percent in the course of the day."] if extra else [])
            else:  # the same block twice: only its place in the page tells menu words from the story
                page = f"<div><p>Browse the archive here</p></div><hr><h1>{title}</h1><div>{body}</div><div><p>Browse the archive here</p></div>"
                page = page.replace("<hr>", "<h6>Sections</h6>").replace("</h1><div>", "</h1><div class=q>")
            yield f"http://h{h}.example/{i}", f"<html><body><nav><p>Menu {i}</p></nav>{page}<footer>Foot {i}</footer></body></html>", " ".join([title, *paras])


def test_wrappers_decide(spark):
    cases = list(template_pages())
    rows = [(i, u, p) for i, (u, p, _) in enumerate(cases)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(d).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(cases)}
    # without the host's other pages nothing tells the site's words from the story
    alone = {r["page_id"]: r["text"] for r in htmltext.main_text(d.withColumn("url", F.concat(F.lit("http://p"), "page_id", F.lit(".example/")))).collect()}
    assert sum(alone[i] != got[i] for i in got) > 0.9 * len(got)
    # many expressions of one host are merged in rounds
    assert {r["page_id"]: r["text"] for r in htmltext.main_text(d.where("url LIKE 'http://h0.%'")).collect()} == {i: got[i] for i in range(12)}
    small_groups = {r["host"]: r["pattern"] for r in htmltext.infer(d, group=4).collect()}
    assert set(small_groups) == {f"h{h}.example" for h in range(3)} and all(htmltext.json.loads(p) for p in small_groups.values())


def test_copies_on_a_host_keep_their_text(spark):
    page = "<div><h1>Same title</h1><p>The same long text on every page of the host, with little else.</p><h3>{}</h3></div>"
    d = spark.createDataFrame([(i, "http://c.example/", page.format(i)) for i in range(9)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(d).collect()}
    assert got == {i: f"Same title The same long text on every page of the host, with little else. {i}" for i in range(9)}


@pytest.mark.parametrize(
    "attrs,mark",
    [("class='comment-list'", "!"), ("id=sidebar", "!"), ("class='share-price'", "?"), ("class='post-header related'", "?"), ("role=navigation", "!"), ("class=adSlot", "!"), ("class='ad-hoc'", "?"), ("class=story", ""), ("hidden", "!")],
)
def test_class_words(attrs, mark):
    assert htmltext.label(" " + attrs)[1] == mark


def plain_article(page):
    """The text below <article> of a page of the test tables, by the standard library's parser."""
    from html.parser import HTMLParser

    out, part, on = [], [], []

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "article":
                on.append(1)
            elif tag not in ("b", "br"):
                out.append("".join(part))
                part.clear()
            elif tag == "br":
                part.append(" ")

        def handle_endtag(self, tag):
            if tag != "b":
                out.append("".join(part))
                part.clear()
            if tag == "article":
                on.clear()

        def handle_data(self, data):
            if on:
                part.append(data)

    P().feed(page or "")
    return " ".join(x for x in (" ".join(o.split()) for o in [*out, "".join(part)]) if x)


def test_html_against_the_standard_parser(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in htmltext.op6_html_extraction(spark, sf).collect()}
    assert got == {i: plain_article(p) for i, p in pages.items()}


def test_warc_round_trip(spark, tmp_path):
    big, urls = "x" * 1200 + "é", ["http://B.example/a?q=1", "http://a.example/", None, "no scheme", "http://a.b.example/\r\n x"]
    rows = [(i, urls[i % 5], [big, "small", None, "", big + str(i // 9)][i % 5]) for i in range(40)] + [(7, urls[0], big), (None, urls[1], big), (39, urls[1], big), (39, urls[1], big)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, n int")
    folder = f"file://{tmp_path}/w"
    directory = warc.build_index(warc.write(warc.plan_records(d), folder, rotate=2000), folder, per_block=5)
    got = sorted((tuple(r) for r in warc.read_all(directory, folder).collect()), key=str)
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, -1), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = top.get(h)
        kind = "response" if first is None or first == i else "revisit"
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), kind, first if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    found = warc.lookup(directory, folder, spark.createDataFrame([(urls[0],), ("http://none.example/",), (urls[4],)], "url string")).collect()
    assert Counter((r["page_id"], r["url"]) for r in found) == Counter((i, u) for i, u, _ in rows if u in (urls[0], urls[4]))
    every = d.select(warc.key_of("url").alias("key"))
    for blocks in (1_000_000, 3):  # the directory whole, and in parts
        assert sorted((tuple(r)[:5] for r in warc.find(directory, folder, every, blocks).collect()), key=str) == sorted(want, key=str)
    assert warc.find(directory, folder, every.limit(0)).count() == 0
    large = spark.createDataFrame([(1, "http://l.example/", "z" * 20_000_000), (2, "http://l.example/", "z" * 20_000_000)], "page_id long, url string, html string")
    found = warc.find(warc.archive(large, f"{folder}3"), f"{folder}3", large.select(warc.key_of("url").alias("key"))).collect()
    assert {(r["page_id"], r["payload_bytes"], r["record_type"]) for r in found} == {(1, 20_000_000, "revisit"), (2, 20_000_000, "response")}
    empty = warc.archive(d.limit(0), f"{folder}2")
    assert warc.read_all(empty, f"{folder}2").count() == 0


def brute_url(url):
    host, path = urlfilter.split_url(url)
    fits = [(len(h + p), v, h + p) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_url_rules(spark):
    hosts = ["Example.ORG", "a.example.org", "notexample.org", "x.com", "x.net", "spam-farm.example.net", "org", "m.spam-farm.x"]
    paths = ["", "/", "/es/", "/es/1", "/en/12?x=/de/", "/fr/#a", "/de/1", "/docs/a", "?q=/fr/", "/casino/1", "/mycasino/"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no/scheme", "://", "http://"]
    d = spark.createDataFrame([(i % 50, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    got = {r["url"]: r for r in urlfilter.judge_urls(d, keep=("page_id", "url")).collect()}
    assert len(got) == len(set(urls))
    for u in urls:
        want = brute_url(u)
        r = got[u]
        assert (r["host"], r["path"]) == urlfilter.split_url(u)
        assert (r["rule"], r["verdict"]) == ((want[1], want[0]) if want else (None, r["verdict"]))
    assert got["https://spam-farm.example.net/docs/a"]["verdict"] == "allow" and got["https://m.spam-farm.x/"]["verdict"] == "block"
    assert got["https://x.net/casino/1"]["verdict"] == "block" and got["https://x.net/mycasino/"]["verdict"] == "allow"
    assert urlfilter.split_url("HTTP://A.b:80/P?q") == ("a.b:80", "/P")
    assert urlfilter.judge_urls(d.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "http://example.net/ES/x"), (2, "http://Example.NET/es/x"), (3, "http://example.net/b/" + "y" * 300_000), (4, "http://x.net/ADSERVER/1"), (4, None)], "page_id long, url string")
    rules = [("block", "Example.net", "/ES/"), ("block", "example.net", "/a/"), ("block", "example.net", "/b/")]
    assert [r["verdict"] for r in urlfilter.judge_urls(odd, rules).collect()] == ["block", "allow", "block", "block", "allow"]
    index = urlfilter.RuleIndex()
    assert all(len(index.candidates(u or "")) < len(index.rules) for u in urls)


def brute_leaks(t, items):
    words = decontamination.tokens(t)
    out = set()
    for item_id, it in items:
        w = decontamination.tokens(it)
        bag = decontamination.shingles(w)
        if w and any(decontamination.similarity(decontamination.shingles(words[s : s + len(w)]), bag) >= 0.8 for s in range(len(words) - len(w) + 1)):
            out.add(item_id)
    return out


def test_decontamination(spark, odd):
    a, b = text(60, 11), text(40, 12)
    items = [(1, a), (2, b), (3, "two words"), (4, None), (5, ""), (6, a)]
    wa = a.split()
    cases = [
        "before " + a + " after", text(200, 13) + " " + b.upper() + ", " + text(50, 14), " ".join(wa[:30] + ["new"] + wa[30:]), " ".join(wa[2:]), " ".join(wa[3:] + ["x"] * 3),
        " ".join(wa[:40]), "x two words y", "nothing here", " ".join(wa[:58] + ["p", "q"]), " ".join(["z", *wa[1:]]),
    ]
    d = odd.unionByName(docs(spark, [(200 + i, t, "en", "s") for i, t in enumerate(cases)]))
    it = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    for rows in (20_000, 2):
        got = defaultdict(set)
        for r in decontamination.leaks(d, it, rows).collect():
            got[r["doc_id"]].add(r["item_id"])
        for i, t in [(200 + i, t) for i, t in enumerate(cases)] + [(i, t) for i, t, _, _ in ODD if i is not None]:
            assert got.get(i, set()) == brute_leaks(t, items), i
    clean = decontamination.decontaminate(d, it)
    assert clean.columns == d.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in d.collect()} - set(got)
    assert decontamination.leaks(d, it.limit(0)).count() == 0 and decontamination.leaks(d.limit(0), it).count() == 0


def test_leaks_with_moved_parts():
    """Items with parts of them in another order, inside long texts: the best of all windows, by brute force."""
    w = text(59, 21).split()
    items = [(1, " ".join(w)), (2, text(40, 22))]
    index = decontamination.Index(items)
    for moved in (w[29:] + w[:29], w[40:] + w[20:40] + w[:20], w[10:] + w[:10]):
        words = text(100, 23).split() + moved + text(80, 24).split()
        bag = decontamination.shingles(w)
        sims = [decontamination.similarity(decontamination.shingles(words[s : s + 59]), bag) for s in range(len(words) - 58)]
        best = max(sims)
        want = [(1, sims.index(best), 59, best)] if best >= 0.8 else []
        assert index.leaks(" ".join(words)) == want
        assert {x[0] for x in want} == brute_leaks(" ".join(words), items)
    assert index.leaks(" ".join(text(100, 23).split() + w[29:] + w[:29] + text(80, 24).split()))[0][1] == 100


def test_leaks_in_texts_shorter_than_the_item(spark, tmp_path):
    import corpus_pipeline

    w = text(59, 21).split()
    items = [(1, " ".join(w)), (2, text(16, 22)), (3, "two words")]
    texts = [" ".join(w[:57]), " ".join(w[1:58]), " ".join(w[:40]), " ".join(w[:4]), " ".join(w[29:58] + w[:29]), text(15, 22), "two", "", None]
    docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for i, t in enumerate(texts):
        own = decontamination.tokens(t)
        for item_id, it in items:
            other = decontamination.tokens(it)
            size = min(len(own), len(other))
            bag = decontamination.shingles(other)
            sim = max(decontamination.similarity(decontamination.shingles(own[s : s + size]), bag) for s in range(len(own) - size + 1))
            if sim >= 0.8:
                want.add((i, item_id, size, round(sim, 6)))
    got = {(r["doc_id"], r["item_id"], r["n_words"], r["similarity"]) for r in decontamination.op10_decontamination(spark, str(tmp_path)).collect()}
    assert got == want and {x[:2] for x in want} >= {(0, 1), (1, 1), (5, 2)}
    left = corpus_pipeline.drop_leaks(spark, shared.table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {x[0] for x in want}


def test_hamming_blocks_find_all_within_the_radius():
    import random

    import numpy as np

    rng = random.Random(5)
    for radius in (3, 6, 13, 15):
        prints = [rng.getrandbits(64) for _ in range(20)]
        probes = [p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 4))) for p in prints for _ in range(20)] + [rng.getrandbits(64) for _ in range(200)]
        at, to = decontamination.HammingBlocks(prints, radius).within(np.array(probes, dtype=np.uint64))
        want = {(i, j) for i, a in enumerate(probes) for j, b in enumerate(prints) if (a ^ b).bit_count() <= radius}
        assert set(zip(at.tolist(), to.tolist())) == want
    # the blocks select: few of the random pairs are looked at
    blocks = decontamination.HammingBlocks([rng.getrandbits(64) for _ in range(50)], decontamination.RADIUS)
    probes = np.array([rng.getrandbits(64) for _ in range(5000)], dtype=np.uint64)
    looked = sum(int(n[(probes >> np.uint64(16 * b)).astype(np.uint16)].sum()) for b, (_, n, _) in enumerate(blocks.tables))
    assert looked < 0.06 * 50 * 5000


def test_recall_of_altered_items():
    """Items with random edits inside longer texts, against all windows: over 0.95 of the leaks are found, nothing else is."""
    import random

    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(15 + i % 45))) for i in range(60)]
    index, want, got = decontamination.Index(items), set(), set()
    for case in range(600):
        w = items[case % 60][1].split()
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            kind = rng.randrange(4)
            w = w[1:] + ["new"] if kind == 0 else ["new", *w[:-1]] if kind == 1 else w[:i] + ["odd"] + w[i + 1 :] if kind == 2 else w[i:] + w[:i]
        t = " ".join([f"v{rng.randrange(900)}" for _ in range(20)] + w + [f"v{rng.randrange(900)}" for _ in range(20)])
        want |= {(case, x) for x in brute_leaks(t, items)}
        got |= {(case, x[0]) for x in index.leaks(t)}
    assert got <= want and len(got) > 0.95 * len(want) and len(want) > 200


def test_leaks_at_slice_edges(monkeypatch):
    """A long text is taken in slices; leaks across their edges, in one text of many and in a batch of short ones, are found."""
    monkeypatch.setattr(decontamination, "SLICE", 64)
    item = text(30, 21)
    index = decontamination.Index([(1, item), (2, text(300, 22))])
    for before in range(0, 2600, 37):
        t = text(before, 23) + " " + item + " " + text(700, 24)
        assert [x[:3] for x in index.leaks(t)] == [(1, before, 30)]
    many = [text(20, i) + " " + (item if i % 7 == 0 else text(30, i + 500)) for i in range(40)]
    assert [bool(x) for x in index.leaks_of(many)] == [i % 7 == 0 for i in range(40)]


def test_near_copies_of_the_pipeline(spark, odd):
    """Edits at similarities around 0.8, chains and a text that only links others, against all pairs."""
    import corpus_pipeline
    from engrama.llm import nearcopies

    base, rows = text(300, 31).split(), []
    for i in range(24):
        w = list(base)
        for j in range(i // 2):
            w[(j * 41 + i) % 300] = f"new{i}"
        rows.append((400 + i, " ".join(w), "en", "s"))
    for i in range(12):
        rows.append((500 + i, " ".join(text(500, 77).split()[i * 9 : i * 9 + 200]), "en", "s"))
    d = odd.unionByName(docs(spark, rows))
    sets = {i: set(nearcopies.shingle_set(nearcopies.words(t)).tolist()) for i, t, _, _ in ODD + rows if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(d).collect() if r["doc_id"] is not None}
    assert got == {i: find(i) for i in sets}
    kept = corpus_pipeline.drop_near_duplicates(spark, d, "")
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*{str(find(i)) for i in sets}, "None"])
    assert nearcopies.near_copies(odd.limit(0)).count() == 0


def test_prefix_pairs_hold_all_similar_pairs_and_no_far_copies(spark):
    """Copies of one text with 0 to 7 own edits, six shingles apart: up to 5 may meet, 6 and more lead with own shingles."""
    from engrama.llm import nearcopies

    base = [f"w{i}" for i in range(150)]
    sets, edits = {}, {}
    for i in range(64):
        w = list(base)
        for j in range(i % 8):
            w[4 + (j * 18 + i) % 140] = f"e{i}_{j}"
        s = nearcopies.shingle_set(nearcopies.words(" ".join(w))).view("int64")
        sets[i], edits[i] = s.tolist(), i % 8
    bags = spark.createDataFrame(list(sets.items()), "node long, s array<long>")
    roots = spark.createDataFrame([(i, i) for i in sets], "node long, root long")
    got = {(r["a"], r["b"]) for r in nearcopies.prefix_pairs(bags, roots).collect()}
    full = {i: set(x) for i, x in sets.items()}
    alike = {(a, b) for a in sets for b in sets if a < b and len(full[a] & full[b]) >= 0.8 * len(full[a] | full[b])}
    assert alike and alike <= got
    assert not [p for p in got - alike if max(edits[p[0]], edits[p[1]]) >= 6]
    same = spark.createDataFrame([(i, 0) for i in sets], "node long, root long")
    assert nearcopies.prefix_pairs(bags, same).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, text(60 + i % 40, i + 1), "en", f"src{i % 12}") for i in range(200)] + [(300, text(60, 1), "en", "src0")]
    item = text(30, 999)
    rows += [(301, text(50, 500) + " " + item, "en", "src1")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        d = shared.stage(step(spark, d, str(tmp_path)), "t")
        assert d.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").replace(" double", "").split(", ")
        ids = {r["doc_id"] for r in d.select("doc_id").collect()}
        if name == "near duplicates":
            assert 300 not in ids and 0 in ids and 301 in ids
        if name == "decontamination":
            assert ids == set(range(200))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == ids and 100 < len(out) < 200
