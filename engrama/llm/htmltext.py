"""Main text of web pages by wrapper inference: union-free regular expressions learned per host.

A page becomes a stream of blocks, each named by its element path (`article/p`, `div.ad!`). Runs of equal blocks or of
equal groups of blocks are folded into repeated groups, which gives the page's own expression. The expressions of a host
are aligned with each other until one is left, the host's wrapper: blocks that only one side has become optional, groups
that one side repeats become repeated, text stays a slot. A stretch that is irregular, so that an expression would have
more than `LONG` groups, becomes one repeated group of optional blocks (`((<h2>)?(<p>)?)+`), so wrappers stay short however
long pages are. Expressions are merged in bounded groups, round by round, so no task holds a host.

Every page is then matched with its host's wrapper, which gives each block its slot: the place in the wrapper and the name.
The slots are judged by what they hold over all pages of the host:

* below an element that stands apart by its tag, its role or a class that means nothing else (menu, header, footer, sidebar,
  notice, advert, form, comments): no content;
* the same text on all of 4 or more different pages: the site's own words, no content (unless half of the host's text is
  like that, as then its pages are copies of each other);
* below an element whose class only hints at something apart (`share-price`, `post-header`, `related`): content if the slot's
  text varies, is longer than a label and has few links, else none;
* below `article` or `main`: content; elsewhere: content if less than half of the text lies in links.

A page's main text is that of its content slots below `article` or `main`; if it has none there, that of its other ones.

Nulls and edge cases: null or empty html gives an empty text; pages without host (null url) share one wrapper; text
outside any element is a block of the root; broken markup is closed as browsers do for paragraphs and list items,
unknown end tags are skipped; repeated rows and null page_ids are extracted row by row and count as one page when slots are
judged; ties between expressions go by length, then by their text; very long pages have short expressions, see above; other
columns are ignored.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.shared import stage, table
from engrama.llm.urlfilter import split_url

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"article", "main", "section", "div", "body", "table", "ul", "ol", "td", "blockquote", "aside", "nav", "footer", "header", "form"}
APART = {"nav", "footer", "aside", "form", "header", "menu", "button", "select", "dialog", "head"}
#: Words of a class, id or role that mean a part apart; with only such and plain words beside them, a class says so by itself.
SURE = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "popup", "promo", "promotion", "replies", "respond", "sidebar", "sponsor", "sponsored", "subscribe", "toolbar"}
#: Words that only hint at it.
HINTS = {"header", "recommended", "related", "search", "share", "sharing", "social", "widget"}
PLAIN = {"area", "article", "bar", "block", "body", "bottom", "box", "container", "content", "entry", "global", "group", "inline", "inner", "item", "items", "left", "link", "links", "list", "main", "page", "panel", "post", "primary", "reader", "right", "row", "secondary", "section", "site", "slot", "top", "unit", "user", "wrap", "wrapper"}
#: An expression has this many groups at most; a slot's text counts as the site's own from this many pages on.
LONG, SAME_ON = 128, 4
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def label(attrs: str) -> tuple[list[str], str]:
    """Words of an element's class, id and role, and its mark: ! stands apart, ? may stand apart."""
    words, mark = set(), ""
    for k, a, b, c in ATTRIBUTE.findall(attrs):
        for value in ["hidden"] if k.lower() == "hidden" else (a or b or c or "").split():
            plain = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            own = re.findall(r"[a-z]+", plain)
            # short numbers tell elements apart (col2, h3); long ones number pages
            words.update(re.findall(r"[a-z]+\d{0,2}(?!\d)", plain))
            if SURE.intersection(own) and (SURE | HINTS | PLAIN).issuperset(own):
                mark = "!"
            elif not mark and (SURE | HINTS).intersection(own):
                mark = "?"
    return sorted(words), mark


def blocks(page: str | None):
    """(path, text, letters in links) of each text block in page order. A path is element names joined by /; a name ends with
    ! if the element stands apart from the main text, with ? if its class hints at that. The outermost element around the
    block's own one that wasn't open at the block before has a + in front."""
    page = page or ""
    last: list[int] = []
    opened = 0
    stack: list[tuple[str, str, int]] = []  # (tag, name in the path, number of the element)
    parts: list[str] = []
    linked, at, out = 0, 0, []

    def flush():
        nonlocal linked, last
        text = " ".join("".join(parts).split())
        if text:
            around = [x for x in stack if x[0] not in INLINE or x[1].endswith("!")]
            here = [x[2] for x in around]
            new = next((i for i, x in enumerate(here) if i >= len(last) or last[i] != x), len(here))
            out.append(("/".join("+" * (i == new < len(here) - 1) + x[1] for i, x in enumerate(around)), text, linked))
            last = here
        parts.clear()
        linked = 0

    def add(text):
        nonlocal linked
        if text:
            text = entities.unescape(text)
            parts.append(text)
            if any(x[0] == "a" for x in stack):
                linked += len(text.strip())

    while m := MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if any(x[0] == tag for x in stack):
                if tag not in INLINE or any(x[1].endswith("!") and x[0] == tag for x in stack):
                    flush()
                while stack.pop()[0] != tag:
                    pass
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        name, opened = tag, opened + 1
        attrs = m[3] or m[6] or ""
        if attrs:
            words, mark = label(attrs)
            if words:
                name = ".".join([tag, *words])
            if tag not in ("html", "body", "main") and not (tag == "article" and mark == "?"):
                name += mark
        if tag in APART and not name.endswith("!"):
            name = name.rstrip("?") + "!"
        if tag in INLINE and not name.endswith("!"):
            name = name.rstrip("?")
            stack.append((tag, name, opened))
            continue
        flush()
        ends = CLOSES.get(tag, set()) | ({"p"} if tag not in INLINE else set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                del stack[i:]
                break
            if stack[i][0] in SCOPE and not (tag in CLOSES and stack[i][0] == "p"):
                break
        stack.append((tag, name, opened))
    add(page[at:] if not page[at:].startswith("<") or page[at:][1:2].isspace() else "")
    flush()
    return out


#: A node of an expression: [names of its blocks, repeated, optional, prefix of the paths if in any order (else None)]


def fold(names: list[str], longest: int = 8) -> tuple[list, list[int]]:
    """The expression of a page, and for each node how many blocks it takes: equal neighbours folded, short groups first."""
    nodes, counts = [[[n], False, False, None] for n in names], [1] * len(names)
    for size in range(1, longest + 1):
        i, out, sums = 0, [], []
        while i < len(nodes):
            group = [n[0] for n in nodes[i : i + size]]
            j = i + size
            while len(group) == size and [n[0] for n in nodes[j : j + size]] == group:
                j += size
            if j > i + size:
                out.append([[x for g in group for x in g], True, False, None])
                sums.append(sum(counts[i:j]))
                i = j
            else:
                out.append(nodes[i])
                sums.append(counts[i])
                i += 1
        nodes, counts = out, sums
    return shortened(nodes, counts)


def _joined(nodes: list, counts: list[int], prefixes: list) -> tuple[list, list[int]]:
    """Neighbours with the same prefix (not None) become one group in any order."""
    out, sums, last = [], [], None
    for n, k, p in zip(nodes, counts, prefixes):
        if p is not None and p == last:
            out[-1] = [sorted({*out[-1][0], *n[0]}), True, out[-1][2] and n[2], p]
            sums[-1] += k
        else:
            out.append(n if p is None else [sorted(set(n[0])), True, n[2], p])
            sums.append(k)
        last = p
    return out, sums


def _above(node: list) -> list[str]:
    """The elements that all blocks of a node lie in."""
    if node[3] is not None:
        return node[3].split("/") if node[3] else []
    paths = [n.replace("+", "").split("/")[:-1] for n in node[0]]
    k = 0
    while all(len(p) > k and p[k] == paths[0][k] for p in paths):
        k += 1
    return paths[0][:k]


def shortened(nodes: list, counts: list[int]) -> tuple[list, list[int]]:
    """At most LONG nodes: neighbours below one element are joined, first below the innermost ones."""
    depth = max((len(_above(n)) for n in nodes), default=0)
    while len(nodes) > LONG:
        own = ["/".join(_above(n)[:depth]) for n in nodes]
        near = [p if p in own[max(i - 1, 0) : i] + own[i + 1 : i + 2] else None for i, p in enumerate(own)]
        nodes, counts = _joined(nodes, counts, near)
        depth -= 1
    return nodes, counts


def _below(names: list[str], prefix: str) -> bool:
    return not prefix or all((n.replace("+", "") + "/").startswith(prefix + "/") for n in names)


def _like(nodes: list, counts: list[int], other: list) -> tuple[list, list[int]]:
    """nodes with the groups that the other expression has: any order below a prefix, and groups of several blocks."""
    for p in sorted({n[3] for n in [*nodes, *other] if n[3] is not None}, key=lambda x: (len(x), x)):
        nodes, counts = _joined(nodes, counts, [p if _below(n[0], p) else None for n in nodes]) if any(n[3] != p and _below(n[0], p) for n in nodes) else (nodes, counts)
    for group in sorted({tuple(n[0]) for n in other if len(n[0]) > 1 and n[3] is None}, key=lambda g: (-len(g), g)):
        i, out, sums = 0, [], []
        while i < len(nodes):
            j, names = i, []
            while j < len(nodes) and nodes[j][3] is None and len(names) < len(group):
                names += nodes[j][0]
                j += 1
            if j > i + 1 and tuple(names) == group:
                out.append([list(group), any(n[1] for n in nodes[i:j]), all(n[2] for n in nodes[i:j]), None])
                sums.append(sum(counts[i:j]))
                i = j
            else:
                out.append(nodes[i])
                sums.append(counts[i])
                i += 1
        nodes, counts = out, sums
    return nodes, counts


def _key(node: list) -> tuple:
    return ("any", node[3]) if node[3] is not None else tuple(node[0])


def align(a: list, b: list) -> list:
    """One expression that both fit: what only one side has becomes optional, a group that one side repeats is repeated."""
    (a, _), (b, _) = _like(a, [1] * len(a), b), _like(b, [1] * len(b), a)
    out: list = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, [_key(n) for n in a], [_key(n) for n in b], autojunk=False).get_opcodes():
        if op == "equal":
            both = [[x[0] if x[3] is None else sorted({*x[0], *y[0]}), x[1] or y[1], x[2] or y[2], x[3]] for x, y in zip(a[i:j], b[k:m])]
        else:
            both = [[x[0], x[1], True, x[3]] for x in [*a[i:j], *b[k:m]]]
        for n in both:
            if out and _key(out[-1]) == _key(n):
                out[-1] = [sorted({*out[-1][0], *n[0]}) if n[3] is not None else n[0], True, out[-1][2] and n[2], n[3]]
            else:
                out.append(n)
    return shortened(out, [1] * len(out))[0]


def merge(patterns: list[str]) -> str:
    """Aligns the expressions (JSON) in a fixed order, long ones first."""
    order = sorted({p for p in patterns if p}, key=lambda p: (-len(p), p))
    out = json.loads(order[0]) if order else []
    for p in order[1:]:
        out = align(out, json.loads(p))
    return json.dumps(out)


def shown(pattern: str) -> str:
    """The expression in the usual notation, with #text for slots."""
    said = []
    for names, again, maybe, loose in json.loads(pattern):
        inner = " ".join(f"<{x}>#text" if loose is None else f"(<{x}>#text)?" for x in names)
        said.append(f"({inner}){'+' * again}{'?' * maybe}")
    return " ".join(said)


@lru_cache(4096)
def matched(pattern: str, own: str) -> tuple[int, ...]:
    """For each node of a page's expression the place in the wrapper, -1 if it has none."""
    whole, page = json.loads(pattern), json.loads(own)
    # _like joins neighbours only, so the counts tell which nodes of the page stand behind one of the joined ones
    like, counts = _like(page, [1] * len(page), whole)
    place = [-1] * len(like)
    for op, i, j, k, _ in difflib.SequenceMatcher(None, [_key(n) for n in whole], [_key(n) for n in like], autojunk=False).get_opcodes():
        if op == "equal":
            place[k : k + j - i] = range(i, j)
    return tuple(p for p, n in zip(place, counts) for _ in range(n))


def slots(found: list[tuple], pattern: str) -> list[str]:
    """The slot of each block: place in the wrapper and name."""
    nodes, counts = fold([x[0] for x in found])
    places = matched(pattern, json.dumps(nodes))
    at = [p for p, n in zip(places, counts) for _ in range(n)]
    return [f"{p} {x[0]}" for p, x in zip(at, found)]


def apart(path: str) -> bool:
    """Whether a path leads through an element that stands apart; a heading in an article's own header doesn't."""
    names = path.replace("+", "").split("/")
    tags = [n.rstrip("!?").split(".")[0] for n in names]
    for i, n in enumerate(names):
        if n.endswith("!") and not (n == "header!" and {"article", "main"} & set(tags[:i]) and HEADINGS & set(tags[i:])):
            return True
    return False


def inside(path: str) -> bool:
    """Whether a path leads through `article` or `main`."""
    return bool({"article", "main"} & {x.rstrip("!?").split(".")[0] for x in path.replace("+", "").split("/")})


def hinted(path: str) -> bool:
    return any(n.endswith("?") for n in path.split("/"))


def content_slots(stats: list[tuple]) -> list[str]:
    """Slots with main text. stats: (slot, blocks, letters, letters in links, on SAME_ON pages or more, always the same text)."""
    free = [x for x in stats if not apart(x[0].partition(" ")[2])]
    same = {x[0] for x in free if x[4] and x[5]}
    if 2 * sum(x[2] for x in free if x[0] in same) > sum(x[2] for x in free):
        same = set()
    out = []
    for slot, n, chars, linked, _, _ in free:
        path, share = slot.partition(" ")[2], linked / max(chars, 1)
        label_like = hinted(path) and (share >= 0.3 or chars < 30 * n)
        if slot not in same and not label_like and (inside(path) or share < 0.5):
            out.append(slot)
    return sorted(out)


def page_text(page: str | None, pattern: str, content: frozenset) -> str:
    """The page's text in content slots inside `article` or `main`; if the page has none there, in its other content slots."""
    found = blocks(page)
    kept = []
    for (path, text, linked), slot in zip(found, slots(found, pattern)):
        # a block without a place in the wrapper is judged alone
        if slot in content or slot.startswith("-1 ") and content_slots([(slot, 1, len(text), linked, False, False)]):
            kept.append((path, text))
    return " ".join([t for p, t in kept if inside(p)] or [t for _, t in kept])


def _frame(names: list[str], rows: list[tuple], numbers: int) -> pd.DataFrame:
    """The first `numbers` columns as objects, the others as whole numbers."""
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object if i < numbers else "int64") for i, c in enumerate(names)})


def host_of(column: str):
    @F.pandas_udf("string")
    def run(url: pd.Series) -> pd.Series:
        return pd.Series([split_url(u)[0] for u in url], dtype=object)

    return run(column)


def _with(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """pages (with _host) joined to what was learned of their hosts; sent out only if it is small in bytes, too."""
    size = learned.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    there = F.broadcast(learned) if size["n"] <= 100_000 and size["bytes"] <= 32 << 20 else learned
    return pages.join(there.withColumnRenamed("host", "_h"), F.col("_host") == F.col("_h")).drop("_h")


def infer(pages: DataFrame, group: int = 64) -> DataFrame:
    """host, pattern: the wrapper of each host as JSON."""

    def read(batches):
        for b in batches:
            seen = {(split_url(url)[0], json.dumps(fold([x[0] for x in blocks(page)])[0])) for url, page in zip(b["url"], b["html"])}
            yield _frame(["host", "pattern"], sorted(seen), 2)

    def merged(pdf):
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "pattern": pd.Series([merge(list(pdf["pattern"]))], dtype=object)})

    own = stage(pages.select("url", "html").mapInPandas(read, "host string, pattern string").distinct(), "expressions")
    while True:
        sizes = own.groupBy(F.col("host").alias("_h")).agg(F.count("*").alias("_n"))
        most = sizes.agg(F.max("_n").alias("n")).first()["n"] or 0
        if most <= 1:
            return own
        # each host's expressions in groups of about half of `group`
        keyed = own.join(sizes, F.col("host") == F.col("_h")) if most > group else own.withColumn("_n", F.lit(1).cast("long"))
        part = F.pmod(F.xxhash64("pattern"), F.ceil(F.col("_n") * 2 / F.lit(group)))
        grouped = keyed.select("host", "pattern", part.alias("part"))
        own = stage(grouped.groupBy("host", "part").applyInPandas(merged, "host string, pattern string").distinct(), "expressions")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pattern (the wrapper as JSON), content (the slots with main text)."""
    wrapper = infer(pages)

    def judge(batches):
        import numpy as np
        from xxhash import xxh64_intdigest

        for b in batches:
            seen: dict[tuple, list] = {}
            for host, pattern, page in zip(b["_host"], b["pattern"], b["html"]):
                found = blocks(page)
                which = 1 << (xxh64_intdigest((page or "").encode("utf-8", "surrogatepass")) % 63)
                for (_, text, linked), slot in zip(found, slots(found, pattern)):
                    h = xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                    row = seen.setdefault((host, slot), [0, 0, 0, 0, h, h])
                    row[:] = [row[0] + 1, row[1] + len(text), row[2] + linked, row[3] | which, min(row[4], h), max(row[5], h)]
            out = _frame(["host", "slot", "n", "chars", "linked", "bits", "lo", "hi"], [(*k, *v) for k, v in seen.items()], 2)
            yield out.astype({c: np.int64 for c in ("n", "chars", "linked", "bits", "lo", "hi")})

    rows = pages.select("html", host_of("url").alias("_host"))
    seen = _with(rows, wrapper).mapInPandas(judge, "host string, slot string, n long, chars long, linked long, bits long, lo long, hi long")
    sums = [F.sum(c).alias(c) for c in ("n", "chars", "linked")]
    # different pages set different bits (of 63), so the bits tell whether there are a few or only copies of one
    stats = seen.groupBy("host", "slot").agg(*sums, (F.bit_count(F.bit_or("bits")) >= SAME_ON).alias("many"), (F.min("lo") == F.max("hi")).alias("same"))

    def decide(pdf):
        found = content_slots([tuple(r) for r in pdf[["slot", "n", "chars", "linked", "many", "same"]].itertuples(index=False)])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "content": pd.Series([found], dtype=object)})

    content = stage(stats.groupBy("host").applyInPandas(decide, "host string, content array<string>"), "slots")
    return wrapper.join(content.withColumnRenamed("host", "_c"), F.col("host") == F.col("_c"), "left").select("host", "pattern", "content")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    @F.pandas_udf("string")
    def extract(page: pd.Series, pattern: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([page_text(p, w, frozenset(c) if c is not None else frozenset()) for p, w, c in zip(page, pattern, content)], dtype=object)

    learned = stage(wrappers(pages), "wrappers")
    rows = pages.select("page_id", "url", "html", host_of("url").alias("_host"))
    out = _with(rows, learned).select("page_id", "url", extract("html", "pattern", "content").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
