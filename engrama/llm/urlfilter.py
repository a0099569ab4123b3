"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a domain suffix with a path prefix, or a pattern with wildcards over the whole url (`*` any characters, `^` a
separator or the end, `||` the start of a domain label). Each rule is filed under one of its whole literal tokens, the
one that fewest rules have; a url fetches the rules filed under its tokens, and only their regular expressions run.
Rules without a whole literal token are candidates of every url.

Domain rules first: of those that fit, the longest host + path wins, allow or block. Otherwise the patterns decide:
an exception pattern (`@@`) allows, else a blocking pattern blocks, else the url is allowed.

Tokens are runs of ASCII letters and digits, without regard to case; hosts and patterns don't regard the case of A-Z, path
prefixes do.

Nulls and edge cases: a null url or one without `://` has an empty host and path, no rule fits and it is allowed unless a
pattern fits it; of rules that are equally long the first listed wins; very long urls are read whole; rows are
judged one by one, so repeated rows, null page_ids and other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.shared import table

#: (verdict, host, path prefix)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
PATTERNS = ["||spam-farm.", "||cheap-pills.", "/casino/*", "*-casino.*", "/adserver^", "||tracker.", "/viagra", "@@||spam-farm.example.net/docs/"]
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TOKEN = re.compile(r"[0-9A-Za-z]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(ASCII_LOWER), rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host, tail[:stop]


class RuleIndex:
    def __init__(self, rules=RULES, patterns=PATTERNS):
        self.rules = []  # (kind, name, regex, verdict, length)
        tokens = []
        for verdict, host, path in rules:
            host = host.translate(ASCII_LOWER)
            # host label boundary, then the path from its start; matched against host + "\n" + path
            self.rules.append(("domain", host + path, re.compile(rf"(?:^|\.){re.escape(host)}\n{re.escape(path)}"), verdict, len(host + path)))
            # the last token of the path may go on in the url, so it is no whole token
            whole = path[: path.rfind("/") + 1]
            tokens.append({t.lower() for t in TOKEN.findall(f"{host} {whole}")})
        for p in patterns:
            body = p.removeprefix("@@")
            at_label = body.startswith("||")
            core = body[2:] if at_label else body
            rx = re.escape(core).replace(r"\*", ".*").replace(r"\^", r"(?:[^\w.%-]|$)")
            rx = rf"^[^:]*://(?:[^/?#]*\.)?{rx}" if at_label else rx
            self.rules.append(("pattern", p, re.compile(rx, re.I | re.A), "allow" if p.startswith("@@") else "block", len(core)))
            # tokens at the pattern's ends, or beside a wildcard, may go on in the url
            guarded = ("." if at_label else "a") + core + "a"
            tokens.append({m[0].lower() for m in TOKEN.finditer(guarded) if 0 < m.start() and m.end() < len(guarded) and "*" not in (guarded[m.start() - 1], guarded[m.end()])})
        seen = Counter(t for x in tokens for t in x)
        self.by_token, self.always = defaultdict(list), []
        for i, x in enumerate(tokens):
            if x:
                self.by_token[min(x, key=lambda t: (seen[t], -len(t), t))].append(i)
            else:
                self.always.append(i)

    def candidates(self, url: str) -> list[int]:
        found = set(self.always)
        for t in {t.lower() for t in TOKEN.findall(url)}:
            found.update(self.by_token.get(t, ()))
        return sorted(found)

    def judge(self, url: str | None) -> tuple:
        """host, path, rule (host + path of the winning domain rule, or None), verdict, pattern (the deciding one, or None)."""
        host, path = split_url(url)
        best, blocks, allows = None, [], []
        for i in self.candidates(url or ""):
            kind, name, rx, verdict, length = self.rules[i]
            if kind == "domain":
                if (best is None or length > self.rules[best][4]) and rx.search(f"{host}\n{path}"):
                    best = i
            elif rx.search(url or ""):
                (allows if verdict == "allow" else blocks).append(name)
        if best is not None:
            return host, path, self.rules[best][1], self.rules[best][3], None
        hit = (allows or blocks or [None])[0]
        return host, path, None, "block" if blocks and not allows else "allow", hit


def judge_urls(pages: DataFrame, rules=RULES, patterns=PATTERNS, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep columns, host, path, rule, verdict, pattern of every row."""
    index = RuleIndex(rules, patterns)
    bc = pages.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("host string, path string, rule string, verdict string, pattern string")
    def run(url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bc.value.judge(u) for u in url], columns=["host", "path", "rule", "verdict", "pattern"], dtype=object)

    return pages.select(*keep, run("url").alias("x")).select(*keep, "x.*")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("pattern")


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_ORDER = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
OP8_SQL = f"""WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
  c AS (SELECT *, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for _, h, p in _ORDER)} END AS rule FROM b)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for v, h, p in _ORDER)}
  WHEN regexp_matches(url, '(?i)^[^:]*://([^/?#]*\\.)?spam-farm\\.example\\.net/docs/') THEN 'allow'
  WHEN regexp_matches(url, '(?i)^[^:]*://([^/?#]*\\.)?(spam-farm|cheap-pills|tracker)\\.|/casino/|-casino\\.|/adserver([^0-9A-Za-z_.%-]|$)|/viagra') THEN 'block' ELSE 'allow' END AS verdict FROM c"""
