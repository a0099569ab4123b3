"""The queries' counterparts in DuckDB's SQL, from shared common table expressions."""

from __future__ import annotations

from engrama.functions.text import EN_STOP, PLAIN_WORD, STOP

NOW = "TIMESTAMP '2024-03-15 00:00:00'"


def _list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


RX = PLAIN_WORD.replace("'", "''")
PATH_RX = r"(?:[A-Za-z0-9_\x{4e00}-\x{9fff}.-]+/)+[A-Za-z0-9_\x{4e00}-\x{9fff}.-]+"


def _words(c):
    return f"list_filter(regexp_extract_all(lower({c}), '{RX}', 0), lambda w: NOT list_contains({_list(STOP)}, w))"


CTE = {
    "m0": ([], "SELECT doc_id AS id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS blocks, source, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7919 % 100000 AS INTEGER)) AS time FROM documents"),
    "mem": (["m0"], "SELECT *, array_to_string(blocks, ' ') AS text FROM m0"),
    "live": (["mem"], "SELECT * FROM mem WHERE len(blocks) > 0"),
    "bv": ([], "SELECT vec_id // 4 AS id, CAST(vec_id % 4 AS INTEGER) AS block_no, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"),
    "ev": ([], "SELECT concat_ws('_', user_id, CAST(ts AS DATE)) AS record_id, ts, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, CASE event_type WHEN 'purchase' THEN 'true' WHEN 'click' THEN 'revelant' WHEN 'error' THEN 'false' ELSE '' END AS accuracy FROM events"),
    "pos": (["ev"], "SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts, event_id) AS p, min(ts) OVER (PARTITION BY record_id) AS time FROM ev"),
    "h0": (["pos"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, id ORDER BY p) AS k FROM pos WHERE id IS NOT NULL) WHERE k = 1"),
    "h": (["h0"], f"SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY p) AS rank, CASE accuracy WHEN 'true' THEN 1.0 WHEN 'revelant' THEN 0.5 ELSE 0.0 END::DOUBLE AS aw, pow(0.5::DOUBLE, greatest(0, (epoch({NOW}) - epoch(time)) / 86400.0::DOUBLE) / 180) AS decay FROM h0"),
    "uc": (["ev"], "SELECT id, count(*) AS n FROM ev WHERE accuracy <> 'false' GROUP BY id"),
    "st": (["h"], "SELECT id, count(*) FILTER (accuracy = 'true') AS true_hits, count(*) FILTER (accuracy = 'revelant') AS relevant_hits, count(*) FILTER (accuracy = 'false') AS false_hits, count(*) FILTER (accuracy = '') AS unlabeled_hits, sum(aw * decay) AS weighted, max(time) AS last_time FROM h GROUP BY id"),
    "used": (["st"], "SELECT * FROM st WHERE true_hits + relevant_hits >= 2"),
    "ue": (["h"], "SELECT p.id AS source, q.id AS target, round(sum(p.aw * q.aw * p.decay), 4) AS weight, count(*) AS hits, '共召回 ' || count(*) || ' 次: ' || min('q ' || p.record_id) AS evidence FROM h p JOIN h q ON p.record_id = q.record_id AND p.id < q.id WHERE p.rank <= 5 AND q.rank <= 5 AND p.aw > 0 AND q.aw > 0 GROUP BY p.id, q.id"),
    "post": (["mem"], f"SELECT DISTINCT id, unnest(list_concat(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]{{3,}}', 0), lambda x: NOT list_contains({_list(EN_STOP)}, lower(x))), regexp_extract_all(text, '{PATH_RX}', 0))) AS entity FROM mem"),
    "est": (["post", "mem"], "SELECT entity, count(*) AS df, ln(1 + ((SELECT count(*) FROM mem)::DOUBLE - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post GROUP BY entity"),
    "lpost": (["post", "live"], "SELECT * FROM post WHERE id IN (SELECT id FROM live)"),
    "lest": (["lpost", "live"], "SELECT entity, count(*) AS df, ln(1 + ((SELECT count(*) FROM live)::DOUBLE - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM lpost GROUP BY entity"),
    "sh": (["lpost", "lest"], "SELECT a.id AS source, b.id AS target, entity, idf, row_number() OVER (PARTITION BY a.id, b.id ORDER BY idf DESC, entity) AS r FROM lpost a JOIN lpost b USING (entity) JOIN lest USING (entity) WHERE a.id < b.id AND idf >= 0.7 AND df BETWEEN 2 AND 200"),
    "pr": (["sh"], "SELECT source, target, round(sum(idf), 4) AS weight, '共享实体: ' || string_agg(entity, '、' ORDER BY r) AS evidence FROM sh WHERE r <= 4 GROUP BY ALL HAVING round(sum(idf), 4) >= 3.0"),
    "pk": (["pr"], "SELECT DISTINCT source, target FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY weight DESC, source, target) AS r FROM (SELECT *, source AS n FROM pr UNION ALL SELECT *, target AS n FROM pr)) WHERE r <= 10"),
    "ee": (["pr", "pk"], "SELECT source, target, 'entity' AS type, weight, evidence FROM pr JOIN pk USING (source, target)"),
    "dims": (["bv"], "SELECT id, i, sum(vec[i]) AS x FROM bv, range(1, 65) t(i) GROUP BY id, i"),
    "rep": (["dims"], "SELECT id, list(x / n ORDER BY i) AS rep FROM dims JOIN (SELECT id, CASE WHEN sum(x * x) > 0 THEN sqrt(sum(x * x)) ELSE 1 END AS n FROM dims GROUP BY id) USING (id) GROUP BY id"),
    "nr": (["rep"], "SELECT * FROM (SELECT a.id, b.id AS other, list_dot_product(a.rep, b.rep) AS cos, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.rep, b.rep), 6) DESC, b.id) AS r FROM rep a JOIN rep b ON a.id <> b.id WHERE list_dot_product(a.rep, b.rep) >= 0.30) WHERE r <= 3"),
    "se": (["nr"], "SELECT least(id, other) AS source, greatest(id, other) AS target, 'semantic' AS type, max(round(cos, 4)) AS weight, '语义相似 cos=' || printf('%.3f', max(round(cos, 4))) AS evidence FROM nr GROUP BY 1, 2"),
    "tl": (["live"], "SELECT *, lag(id) OVER (ORDER BY time, id) AS p, (epoch(time) - epoch(lag(time) OVER (ORDER BY time, id))) / 60 AS gap FROM live"),
    "te": (["tl"], "SELECT least(id, p) AS source, greatest(id, p) AS target, 'temporal' AS type, 0.25::DOUBLE AS weight, '时间相邻 ' || CAST(round(gap) AS BIGINT) || ' 分钟' AS evidence FROM tl WHERE p IS NOT NULL AND gap <= 360"),
    "ug": (["ue", "live"], "SELECT source, target, 'usage' AS type, weight, evidence FROM ue WHERE source IN (SELECT id FROM live) AND target IN (SELECT id FROM live)"),
    "rd": (["live"], "SELECT a.id AS source, b.id AS target, 'reference' AS type, 3.0::DOUBLE AS weight, '显式引用' AS evidence FROM live a JOIN live b ON b.id = a.id + 10 WHERE b.id % 10 = 0"),
    "lg": (["ee", "se", "rd", "te", "ug"], "SELECT * FROM ee UNION ALL SELECT * FROM se UNION ALL SELECT * FROM rd UNION ALL SELECT * FROM te UNION ALL SELECT * FROM ug"),
    "ends": (["lg"], "SELECT source AS id, weight FROM lg UNION ALL SELECT target, weight FROM lg"),
    "deg": (["ends"], "SELECT id, count(*) AS degree FROM ends GROUP BY id"),
    "cp": (["lg"], "SELECT source, target, round(sum(weight), 6) AS weight FROM lg WHERE source <> target GROUP BY ALL"),
    "g0": (["live"], "SELECT id % 8 AS community, count(*) AS size, min(id) AS first FROM live GROUP BY ALL HAVING count(*) >= 2"),
    "mb": (["live", "g0"], "SELECT 'C' || lpad(CAST(rn AS VARCHAR), 2, '0') AS cid, id AS node, size FROM live JOIN (SELECT *, row_number() OVER (ORDER BY size DESC, first) AS rn FROM g0) g ON g.community = id % 8"),
    "kw0": (["mb", "post", "est"], "SELECT cid, entity, round(sum(idf), 6) AS score FROM mb JOIN post ON post.id = node JOIN est USING (entity) WHERE NOT contains(entity, '/') AND length(entity) <= 24 GROUP BY ALL"),
    "kwx": (["kw0"], "SELECT cid, sub AS entity, max(score) AS o FROM (SELECT cid, entity, score, unnest(flatten(list_transform(range(1, length(entity) + 1), lambda k: list_transform(range(1, length(entity) - k + 2), lambda i: substr(entity, i, k))))) AS sub FROM kw0) WHERE sub <> entity GROUP BY ALL"),
    "kw": (["kw0", "kwx"], "SELECT * FROM (SELECT a.cid, a.entity AS keyword, a.score, row_number() OVER (PARTITION BY a.cid ORDER BY a.score DESC, a.entity) AS rank FROM kw0 a LEFT JOIN kwx b ON a.cid = b.cid AND a.entity = b.entity WHERE b.o IS NULL OR b.o < a.score) WHERE rank <= 5"),
    "cx": (["lg", "mb"], "SELECT least(a.cid, b.cid) AS source, greatest(a.cid, b.cid) AS target, lg.type, lg.weight, lg.evidence, (lg.source, lg.target, lg.type) AS o FROM lg JOIN mb a ON a.node = lg.source JOIN mb b ON b.node = lg.target WHERE a.cid <> b.cid"),
    "cn": (["cx"], "SELECT source, target, word, count(*) AS n FROM (SELECT source, target, unnest(string_split(replace(evidence, '共享实体: ', ''), '、')) AS word FROM cx WHERE type = 'entity') GROUP BY ALL"),
    "cb": (["cn"], "SELECT source, target, string_agg(word, '、' ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY n DESC, word) AS r FROM cn) WHERE r <= 3 GROUP BY ALL"),
    "c0": (["cx"], "SELECT source, target, CAST((CAST(sum(CAST(round(weight * 10000) AS BIGINT)) AS BIGINT) + 5) // 10 AS DOUBLE) / 1000.0::DOUBLE AS weight, arg_min(evidence, o) AS first FROM cx GROUP BY ALL"),
    "ce": (["c0", "cb"], "SELECT source, target, weight, coalesce(names, first) AS bridge FROM c0 LEFT JOIN cb USING (source, target)"),
    "cdims": (["bv", "mb"], "SELECT cid, i, sum(vec[i]) AS x FROM bv JOIN mb ON node = id, range(1, 65) t(i) GROUP BY cid, i"),
    "cvec": (["cdims"], "SELECT cid, list(x / n ORDER BY i) AS vec FROM cdims JOIN (SELECT cid, sqrt(sum(x * x)) AS n FROM cdims GROUP BY cid) USING (cid) GROUP BY cid"),
    "q": ([], "SELECT item_id AS qid, text AS query, CAST(embedding AS DOUBLE[]) AS qvec FROM benchmark LEFT JOIN embeddings ON vec_id = item_id"),
    "cs": (["q", "cvec"], "SELECT qid, cid, round(list_dot_product(qvec, vec), 6) AS cos FROM q, cvec WHERE qvec IS NOT NULL"),
    "tok": (["live"], f"SELECT id, unnest({_words('text')}) AS term FROM live"),
    "tf": (["tok"], "SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL"),
    "dl": (["live"], f"SELECT id, CAST(len({_words('text')}) AS BIGINT) AS dl FROM live"),
    "tdf": (["tf"], "SELECT term, count(*) AS df FROM tf GROUP BY term"),
    "qt": (["q"], f"SELECT DISTINCT qid, unnest({_words('query')}) AS term FROM q"),
    "bm": (["tf", "qt", "tdf", "dl"], "SELECT qid, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25 FROM tf JOIN qt USING (term) JOIN tdf USING (term) JOIN dl USING (id), (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl) GROUP BY ALL"),
    "qw": (["qt"], "SELECT qid, list(term) AS w FROM qt GROUP BY qid"),
    "ks": (["low", "qw"], "SELECT * FROM (SELECT qid, id, len(list_filter(w, lambda t: contains(lt, t))) / len(w) AS kw FROM qw, low) WHERE kw > 0"),
    "low": (["live"], "SELECT id, lower(text) AS lt FROM live"),
    "ds": (["q", "bv"], "SELECT qid, id, max(list_dot_product(qvec, vec)) AS cos FROM q, bv WHERE qvec IS NOT NULL GROUP BY ALL HAVING max(list_dot_product(qvec, vec)) > 0"),
    "sc": (["live", "q", "ds", "ks", "bm", "uc"], f"SELECT q.qid, live.id, round(coalesce(cos, 0), 9) AS cos, round(coalesce(kw, 0), 9) AS kw, round(coalesce(bm25, 0), 9) AS bm25, coalesce(n, 0) AS usage, round(exp(-greatest(0, (epoch({NOW}) - epoch(time)) / 86400.0::DOUBLE) / 90), 9) AS recency FROM live CROSS JOIN q LEFT JOIN ds ON ds.qid = q.qid AND ds.id = live.id LEFT JOIN ks ON ks.qid = q.qid AND ks.id = live.id LEFT JOIN bm ON bm.qid = q.qid AND bm.id = live.id LEFT JOIN uc ON uc.id = live.id"),
    "nm": (["sc"], "SELECT *, coalesce(cos / nullif(max(cos) OVER w, 0), 0) AS c, coalesce(bm25 / nullif(max(bm25) OVER w, 0), 0) AS m, coalesce(kw / nullif(max(kw) OVER w, 0), 0) AS k, 1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id)) + 1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id)) AS rr, ln(1 + usage) AS lu FROM sc WINDOW w AS (PARTITION BY qid)"),
    "n2": (["nm"], "SELECT *, rr / max(rr) OVER w AS rrf, coalesce(lu / nullif(max(lu) OVER w, 0), 0) AS u FROM nm WINDOW w AS (PARTITION BY qid)"),
    "n3": (["n2"], "SELECT *, 0.75::DOUBLE * rrf + 0.15::DOUBLE * u + 0.10::DOUBLE * recency AS hy FROM n2"),
    "vs": (["n3"], "SELECT qid, id, unnest(['baseline', 'dense', 'bm25', 'mix', 'rrf', 'hybrid']) AS variant, round(unnest([0.3::DOUBLE * cos + 0.7::DOUBLE * kw, cos, m, 0.6::DOUBLE * c + 0.1::DOUBLE * m + 0.3::DOUBLE * k, rrf, hy / max(hy) OVER (PARTITION BY qid)]), 6) AS score FROM n3"),
    "rk": (["vs"], "SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY score DESC, id) AS rank FROM vs"),
    "ex": (["q", "mem"], r"SELECT qid, id FROM q, mem WHERE contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(query, '\s+', ' ', 'g'))) AND trim(regexp_replace(query, '\s+', ' ', 'g')) <> ''"),
    "scope": (["cs", "mb"], "SELECT DISTINCT qid, node AS id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, cid) AS r FROM cs WHERE cos >= 0.05) JOIN mb USING (cid) WHERE r <= 3"),
    # BM25 statistics are those of each query's own scope
    "cstat": (["scope", "dl"], "SELECT qid, count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM scope JOIN dl USING (id) GROUP BY qid"),
    "ctf": (["scope", "tf", "qt"], "SELECT qid, id, term, tf FROM scope JOIN tf USING (id) JOIN qt USING (qid, term)"),
    "cbm": (["ctf", "cstat", "dl"], "SELECT qid, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25 FROM ctf JOIN (SELECT qid, term, count(*) AS df FROM ctf GROUP BY ALL) USING (qid, term) JOIN cstat USING (qid) JOIN dl USING (id) GROUP BY ALL"),
    "csc": (["scope", "ds", "ks", "cbm"], "SELECT s.qid, s.id, round(coalesce(cos, 0), 9) AS cos, round(coalesce(kw, 0), 9) AS kw, round(coalesce(bm25, 0), 9) AS bm25 FROM scope s LEFT JOIN ds ON ds.qid = s.qid AND ds.id = s.id LEFT JOIN ks ON ks.qid = s.qid AND ks.id = s.id LEFT JOIN cbm ON cbm.qid = s.qid AND cbm.id = s.id"),
    "cmix": (["csc"], "SELECT qid, id, round(0.6::DOUBLE * coalesce(cos / nullif(max(cos) OVER w, 0), 0) + 0.1::DOUBLE * coalesce(bm25 / nullif(max(bm25) OVER w, 0), 0) + 0.3::DOUBLE * coalesce(kw / nullif(max(kw) OVER w, 0), 0), 6) AS score FROM csc WINDOW w AS (PARTITION BY qid)"),
    "orph": (["used", "se"], "SELECT id, coalesce(degree, 0) AS degree, round(weighted, 4) AS score FROM used LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM se UNION ALL SELECT target FROM se) GROUP BY id) USING (id) WHERE coalesce(degree, 0) <= 0"),
    "noisy": (["used"], "SELECT id, false_hits, round(false_hits / (true_hits + relevant_hits + false_hits), 6) AS ratio, round(weighted * (false_hits / (true_hits + relevant_hits + false_hits)), 4) AS score FROM used WHERE false_hits >= 2 AND false_hits / (true_hits + relevant_hits + false_hits) >= 0.30"),
    "mpc": (["bv"], "SELECT a.id, min(list_dot_product(a.vec, b.vec)) AS min_cos, max(list_dot_product(a.vec, b.vec)) AS max_cos FROM bv a JOIN bv b ON a.id = b.id AND a.block_no < b.block_no GROUP BY a.id"),
    # every pair of blocks of one memory lies under the threshold here (max_cos < 0.55), so each block is a group of its own
    "multi": (["used", "mpc", "bv"], "SELECT id, round(min_cos, 6) AS min_cos, groups, round(weighted * (1 - min_cos) * (1 + 0.1::DOUBLE * (groups - 1)), 4) AS score FROM used JOIN mpc USING (id) JOIN (SELECT id, count(*) AS groups FROM bv GROUP BY id) USING (id) WHERE min_cos < 0.55 AND max_cos < 0.55"),
    "dup": (["used", "bv"], "SELECT a.id, a.block_no, b.id AS other, b.block_no AS other_no, round(list_dot_product(a.vec, b.vec), 6) AS cos, round(list_dot_product(a.vec, b.vec) * least(u.weighted, v.weighted), 4) AS score FROM bv a JOIN used u ON u.id = a.id JOIN bv b ON a.id < b.id JOIN used v ON v.id = b.id WHERE list_dot_product(a.vec, b.vec) >= 0.40"),
    "brg": (["ue", "mb"], "SELECT source, target, a.cid AS ca, b.cid AS cb, round(weight, 4) AS score FROM ue JOIN mb a ON a.node = source JOIN mb b ON b.node = target WHERE a.cid <> b.cid"),
    "cand": (["multi", "noisy", "orph", "dup", "brg"], "SELECT 'multi_topic' AS kind, CAST(id AS VARCHAR) AS memory_id, score, 'derived_split' AS action, concat_ws('|', min_cos, groups) AS o FROM multi UNION ALL SELECT 'noisy_anchor', CAST(id AS VARCHAR), score, 'anchor_rewrite', '' FROM noisy UNION ALL SELECT 'orphan_used', CAST(id AS VARCHAR), score, 'edge_attach', '' FROM orph UNION ALL SELECT 'duplicate_block', CAST(id AS VARCHAR), score, 'merge_duplicate', concat_ws('|', block_no, other, other_no) FROM dup UNION ALL SELECT 'bridge', CAST(source AS VARCHAR), score, 'keep_bridge', concat_ws('|', target, ca, cb) FROM brg"),
    "tr0": (["lg"], "SELECT a, b, sum(weight) AS w FROM (SELECT source AS a, target AS b, weight FROM lg WHERE source <> target UNION ALL SELECT target, source, weight FROM lg WHERE source <> target) GROUP BY a, b"),
    "tr": (["tr0"], "SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS t FROM tr0"),
    "rs": (["uc"], "SELECT id % 8 AS qid, id, n / sum(n) OVER (PARTITION BY id % 8) AS r FROM uc WHERE n > 0"),
    "p0": (["rs", "tr"], "SELECT qid, id, r AS p FROM rs"),
}
for _i in range(20):
    CTE[f"p{_i + 1}"] = ([f"p{_i}"], f"SELECT qid, id, sum(x) AS p FROM (SELECT qid, b AS id, 0.6::DOUBLE * p * t AS x FROM p{_i} JOIN tr ON a = id UNION ALL SELECT qid, id, 0.4::DOUBLE * r FROM rs) GROUP BY ALL")
CTE["qwords"] = (["ex", "q"], f"SELECT ex.id, list_distinct(flatten(list({_words('query')}))) AS w FROM ex JOIN q USING (qid) GROUP BY ex.id")
CTE["blk"] = (["mem"], "SELECT id, CAST(generate_subscripts(blocks, 1) - 1 AS INTEGER) AS block_no, unnest(blocks) AS block FROM mem")
CTE["htok"] = (["blk"], "SELECT id, block_no, unnest(regexp_extract_all(lower(block), '[a-z0-9]+', 0)) AS tok FROM blk")
CTE["hnum"] = (["htok"], "SELECT tok, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(tok, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS h FROM (SELECT DISTINCT tok FROM htok)")
CTE["hsum"] = (["htok", "hnum"], "SELECT id, block_no, CAST(h % 512 AS INTEGER) AS bucket, CAST(sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS DOUBLE) AS v FROM htok JOIN hnum USING (tok) GROUP BY ALL HAVING sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) <> 0")
CTE["ptop"] = (["p20"], "SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(p, 6) DESC, id) AS rank FROM p20) WHERE rank <= 10")

CTE["psub"] = (["ptop", "lg"], "SELECT * FROM (SELECT a.qid, source, target, weight, row_number() OVER (PARTITION BY a.qid ORDER BY weight DESC, source, target, type) AS rank FROM lg JOIN ptop a ON a.id = source JOIN ptop b ON b.id = target AND a.qid = b.qid) WHERE rank <= 20")
CTE["w0"] = (["ptop", "psub"], "SELECT qid, [id] AS path FROM ptop WHERE rank = 1")
for _i in range(5):
    CTE[f"w{_i + 1}"] = ([f"w{_i}", "psub"], f"SELECT w.qid, CASE WHEN nxt IS NULL THEN path ELSE list_append(path, nxt) END AS path FROM w{_i} w LEFT JOIN (SELECT qid, nxt FROM (SELECT v.qid, CASE WHEN source = path[-1] THEN target ELSE source END AS nxt, row_number() OVER (PARTITION BY v.qid ORDER BY weight DESC, least(source, target), greatest(source, target)) AS r FROM w{_i} v JOIN psub s ON s.qid = v.qid AND (source = path[-1] OR target = path[-1]) AND NOT list_contains(path, CASE WHEN source = path[-1] THEN target ELSE source END)) WHERE r = 1) n ON n.qid = w.qid")

CTE["pool"] = (["rk"], "SELECT qid, id, score, rank AS i FROM rk WHERE variant = 'hybrid' AND rank <= 60")
CTE["near"] = (["pool", "bv"], "SELECT p.qid, p.i, o.i AS j, max(list_dot_product(a.vec, b.vec)) AS s FROM pool p JOIN pool o ON o.qid = p.qid AND o.i <> p.i JOIN bv a ON a.id = p.id JOIN bv b ON b.id = o.id GROUP BY ALL")
CTE["g1"] = (["pool"], "SELECT qid, i, 1 AS step FROM pool WHERE i = 1")
for _i in range(1, 10):
    CTE[f"g{_i + 1}"] = ([f"g{_i}", "near"], f"SELECT * FROM g{_i} UNION ALL SELECT qid, i, {_i + 1} FROM (SELECT p.qid, p.i, row_number() OVER (PARTITION BY p.qid ORDER BY 0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * coalesce(m, 0) DESC, p.i) AS r FROM pool p LEFT JOIN (SELECT n.qid, n.i, greatest(0, max(s)) AS m FROM near n JOIN g{_i} g ON g.qid = n.qid AND g.i = n.j GROUP BY ALL) x ON x.qid = p.qid AND x.i = p.i LEFT JOIN g{_i} k ON k.qid = p.qid AND k.i = p.i WHERE k.i IS NULL) WHERE r = 1")


def sql(needs: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n):
        if n not in order:
            for x in CTE[n][0]:
                visit(x)
            order.append(n)

    for n in needs:
        visit(n)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order) + "\n" if order else "") + body


def _top(variant):
    return sql(["rk"], f"SELECT qid, id, score, rank FROM rk WHERE variant = '{variant}' AND rank <= 10")


_GRID = "(SELECT d, b, 10 - d - b AS k FROM range(11) x(d), range(11) y(b) WHERE d + b <= 10)"
ALL = {
    **{f"{v}_topk": _top(v) for v in ("baseline", "dense", "bm25", "mix", "rrf", "hybrid")},
    "usage_counts": sql(["uc"], "SELECT * FROM uc"),
    "usage_stats": sql(["st", "h"], "SELECT id, true_hits, relevant_hits, false_hits, unlabeled_hits, round(weighted, 6) AS weighted, CAST(floor(epoch(last_time)) AS BIGINT) AS last_time, queries FROM st JOIN (SELECT id, string_agg('q ' || record_id, '|' ORDER BY time, record_id) AS queries FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time, record_id) AS rn FROM h) WHERE rn <= 8 GROUP BY id) USING (id)"),
    "usage_edges": sql(["ue"], "SELECT * FROM ue"),
    "usage_summary": sql(["st", "ue", "ev"], "SELECT CAST(sum(true_hits) AS BIGINT) AS true_hits, CAST(sum(relevant_hits) AS BIGINT) AS relevant_hits, CAST(sum(false_hits) AS BIGINT) AS false_hits, CAST(sum(unlabeled_hits) AS BIGINT) AS unlabeled_hits, count(*) AS used_memories, count(*) FILTER (true_hits + relevant_hits > 0) AS positive_memories, (SELECT count(*) FROM ue) AS co_hit_edges, (SELECT count(DISTINCT record_id) FROM ev) AS records FROM st"),
    "memories": sql(["mem"], "SELECT id, CAST(len(blocks) AS INTEGER) AS n_blocks, CAST(length(text) AS INTEGER) AS n_chars, substr(coalesce(blocks[1], ''), 1, 60) AS title, CAST(epoch(time) AS BIGINT) AS time FROM mem"),
    "merge_duplicates": "SELECT id, role, blocks FROM (SELECT conv_id AS id, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id) JOIN (SELECT conv_id AS id, string_agg(text, '|' ORDER BY t) AS blocks FROM (SELECT conv_id, text, min(turn) AS t FROM conversations GROUP BY conv_id, text) GROUP BY conv_id) USING (id)",
    "hash_embed": sql(["hsum"], "SELECT id, block_no, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY id, block_no)), 6) AS value FROM hsum"),
    "bm25_index": sql(["tf"], "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term"),
    "doc_lengths": sql(["dl"], "SELECT * FROM dl"),
    "kw_overlap": sql(["ks"], "SELECT qid, id, round(kw, 6) AS kw FROM ks"),
    "score_all": sql(["sc"], "SELECT qid, id, round(cos, 6) AS cos, round(kw, 6) AS kw, round(bm25, 6) AS bm25, round(recency, 6) AS recency, usage FROM sc"),
    "entity_latin": sql(["post"], "SELECT * FROM post"),
    "entity_idf": sql(["est"], "SELECT entity, df, round(idf, 6) AS idf FROM est"),
    "entity_edges": sql(["ee"], "SELECT * FROM ee"),
    "mean_vectors": sql(["rep"], "SELECT id, CAST(generate_subscripts(rep, 1) - 1 AS INTEGER) AS dim, round(unnest(rep), 6) AS x FROM rep"),
    "semantic_edges": sql(["se"], "SELECT * FROM se"),
    "reference_edges": "SELECT least(a, b) AS source, greatest(a, b) AS target, 'reference' AS type, sum(3.0::DOUBLE) AS weight, '显式引用' AS evidence FROM (SELECT DISTINCT c.conv_id || '-' || c.turn AS a, p.conv_id || '-' || p.turn AS b FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1) GROUP BY ALL",
    "temporal_edges": sql(["te"], "SELECT * FROM te"),
    "edge_union": sql(["lg"], "SELECT source, target, type, weight FROM lg"),
    "edge_type_counts": sql(["lg"], "SELECT coalesce(type, 'all') AS type, count(*) AS n FROM lg GROUP BY ROLLUP (type)"),
    "degree": sql(["deg"], "SELECT * FROM deg"),
    "pair_collapse": sql(["cp"], "SELECT * FROM cp"),
    "ppr_20": sql(["p20"], "SELECT qid, id, round(p, 6) AS p FROM p20"),
    "ppr_subgraph": sql(["ptop", "lg"], "SELECT * FROM (SELECT a.qid, source, target, type, weight, row_number() OVER (PARTITION BY a.qid ORDER BY weight DESC, source, target, type) AS rank FROM lg JOIN ptop a ON a.id = source JOIN ptop b ON b.id = target AND a.qid = b.qid) WHERE rank <= 20"),
    "mmr_topk": sql(["g10"], "SELECT qid, id, score, CAST(step AS INTEGER) AS rank FROM g10 JOIN pool USING (qid, i)"),
    "main_path": sql(["w5"], "SELECT qid, array_to_string(path, '>') AS path FROM w5"),
    "block_attribution": sql(["blk", "qwords"], f"SELECT id, block_no, overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, block_no) AS r FROM (SELECT id, block_no, round(len(list_intersect(w, {_words('block')})) / len(w), 6) AS overlap FROM blk JOIN qwords USING (id) WHERE len(w) > 0)) WHERE r = 1"),
    "modularity": sql(["cp"], "SELECT round(sum(2 * coalesce(l, 0) / w - pow(d / w, 2)), 6) AS modularity FROM (SELECT n % 8 AS c, sum(weight) AS d FROM (SELECT source AS n, weight FROM cp UNION ALL SELECT target, weight FROM cp) GROUP BY 1) LEFT JOIN (SELECT source % 8 AS c, sum(weight) AS l FROM cp WHERE source % 8 = target % 8 GROUP BY 1) USING (c), (SELECT 2 * sum(weight) AS w FROM cp)"),
    "communities": sql(["mb"], "SELECT * FROM mb"),
    "community_spans": sql(["mb", "live"], 'SELECT cid, CAST(epoch(min(time)) AS BIGINT) AS start, CAST(epoch(max(time)) AS BIGINT) AS "end" FROM mb JOIN live ON id = node GROUP BY cid'),
    "community_core": sql(["mb", "deg"], "SELECT * FROM (SELECT cid, node, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY cid ORDER BY coalesce(degree, 0) DESC, node) AS rank FROM mb LEFT JOIN deg ON id = node) WHERE rank <= 8"),
    "community_relations": sql(["mb", "lg"], "SELECT * FROM (SELECT a.cid, source, target, type, weight, row_number() OVER (PARTITION BY a.cid ORDER BY weight DESC, source, target, type) AS rank FROM lg JOIN mb a ON a.node = source JOIN mb b ON b.node = target AND a.cid = b.cid WHERE type <> 'temporal') WHERE rank <= 6"),
    "community_keywords": sql(["kw"], "SELECT * FROM kw"),
    "community_edges": sql(["ce"], "SELECT * FROM ce"),
    "community_scores": sql(["cs"], "SELECT * FROM cs"),
    "cog_scope": sql(["cs", "mb"], "SELECT DISTINCT qid, node AS id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, cid) AS r FROM cs WHERE cos >= 0.05) JOIN mb USING (cid) WHERE r <= 3"),
    "recall_mem": sql(["rk", "mem"], "SELECT qid, rk.id AS memory_id, rank, score, substr(coalesce(blocks[1], ''), 1, 60) AS title FROM rk JOIN mem ON mem.id = rk.id WHERE variant = 'mix' AND rank <= 5"),
    "recall_community": sql(["cs"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, cid) AS rank FROM cs) WHERE rank <= 5"),
    "recall_cog": sql(["cmix"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cmix) WHERE rank <= 5"),
    "log_rows": sql(["rk", "mem", "q"], f"SELECT query, 'pre' AS status, array_to_string({_words('query')}, ' ') AS keywords, 5 AS top_k, string_agg(rk.id || ':' || substr(text, 1, 60), '|' ORDER BY rank) AS results FROM rk JOIN mem ON mem.id = rk.id JOIN q USING (qid) WHERE variant = 'mix' AND rank <= 5 GROUP BY qid, query"),
    "orphan_used": sql(["orph"], "SELECT * FROM orph"),
    "noisy_anchor": sql(["noisy"], "SELECT * FROM noisy"),
    "multi_topic": sql(["multi"], "SELECT * FROM multi"),
    "duplicate_block": sql(["dup"], "SELECT * FROM dup"),
    "bridge": sql(["brg"], "SELECT * FROM brg"),
    "feedback_top": sql(["cand"], "SELECT kind, memory_id, score, action, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, memory_id, o) AS rank FROM cand) WHERE rank <= 20"),
    "feedback_plan": sql(["cand"], "SELECT a AS action, count(action) AS count FROM (SELECT unnest(['derived_split', 'anchor_rewrite', 'edge_attach', 'merge_duplicate', 'keep_bridge']) AS a) LEFT JOIN cand ON action = a GROUP BY a"),
    "expected_hits": sql(["ex"], "SELECT * FROM ex"),
    "eval_metrics": sql(["rk", "ex"], "SELECT variant, count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit3, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM (SELECT v.variant, e.qid, min(CASE WHEN rank <= 5 THEN rank END) AS r FROM (SELECT DISTINCT variant FROM rk) v CROSS JOIN ex e LEFT JOIN rk ON rk.variant = v.variant AND rk.qid = e.qid AND rk.id = e.id GROUP BY ALL) GROUP BY variant"),
    "grid_search": sql(["nm", "ex"], f"SELECT CAST(d AS INTEGER) AS d, CAST(b AS INTEGER) AS b, CAST(k AS INTEGER) AS k, round(avg(1.0::DOUBLE / r), 6) AS mrr FROM (SELECT qid, d, b, k, min(CASE WHEN e THEN r END) AS r FROM (SELECT s.qid, g.d, g.b, g.k, ex.id IS NOT NULL AS e, row_number() OVER (PARTITION BY s.qid, g.d, g.b ORDER BY round((g.d * s.c + g.b * s.m + g.k * s.k) / 10, 6) DESC, s.id) AS r FROM nm s LEFT JOIN ex ON ex.qid = s.qid AND ex.id = s.id, {_GRID} g WHERE s.qid IN (SELECT qid FROM ex)) GROUP BY ALL) GROUP BY d, b, k"),
}
