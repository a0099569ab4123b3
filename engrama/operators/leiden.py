"""Leiden communities: local moving, refinement within communities, aggregation, for several resolutions.

Edges are collapsed and validated in Spark; each connected component is its own group (total weight passed in), so
components run in parallel and only one component must fit into a worker. Quality is modularity with a resolution."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESOLUTIONS = (0.5, 0.8, 1.0, 1.5, 2.0)
#: Components of more nodes move in rounds of arrays until few nodes are left.
LARGE = 20_000


def clean_edges(edges: DataFrame) -> DataFrame:
    """Positive weights between different nodes, summed per unordered pair."""
    a = edges.where((F.col("weight") > 0) & (F.col("source") != F.col("target")))
    return a.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum("weight").alias("weight"))


def edge_report(edges: DataFrame) -> DataFrame:
    """How many edges were kept, dropped for their weight or as loops, and merged."""
    bad, loop = F.col("weight") <= 0, F.col("source") == F.col("target")
    a = edges.agg(F.count("*").alias("edges"), F.count_if(bad).alias("dropped_weight"), F.count_if(~bad & loop).alias("dropped_loops"))
    return a.crossJoin(clean_edges(edges).agg(F.count("*").alias("kept")))  # one row each


class _Level:
    """One level's graph: adjacency lists, node strengths, and the community state."""

    def __init__(self, links: list[dict[int, float]], strength: list[float], total: float, gamma: float):
        self.links, self.k, self.total, self.gamma = links, strength, total, gamma
        self.of = list(range(len(links)))
        self.d = list(strength)

    def gain(self, v: int, to: int, w_to: float, w_own: float) -> float:
        own = self.of[v]
        return 2 * (w_to - w_own) / self.total - 2 * self.gamma * self.k[v] * (self.d[to] - self.d[own] + self.k[v]) / self.total**2

    def best(self, v: int, allowed=None) -> tuple[int, float]:
        weights: dict[int, float] = {}
        for u, w in self.links[v].items():
            if u != v and (allowed is None or allowed[u] == allowed[v]):
                weights[self.of[u]] = weights.get(self.of[u], 0.0) + w
        own = self.of[v]
        found, top = own, 1e-12
        for c in sorted(weights):
            if c != own and (g := self.gain(v, c, weights[c], weights.get(own, 0.0))) > top:
                found, top = c, g
        return found, top

    def move(self, v: int, to: int) -> None:
        self.d[self.of[v]] -= self.k[v]
        self.d[to] += self.k[v]
        self.of[v] = to

    def local(self, rng: random.Random) -> int:
        queue = list(range(len(self.links)))
        rng.shuffle(queue)
        waiting, moves, at = set(queue), 0, 0
        while at < len(queue):
            v = queue[at]
            at += 1
            waiting.discard(v)
            to, _ = self.best(v)
            if to != self.of[v]:
                self.move(v, to)
                moves += 1
                for u in self.links[v]:
                    if self.of[u] != to and u not in waiting:
                        waiting.add(u)
                        queue.append(u)
        return moves

    def refined(self, rng: random.Random) -> "_Level":
        """Singletons merged within their communities only; a node that has joined others stays."""
        fine = _Level(self.links, self.k, self.total, self.gamma)
        size = [1] * len(self.links)
        order = list(range(len(self.links)))
        rng.shuffle(order)
        for v in order:
            if size[fine.of[v]] == 1:
                to, _ = fine.best(v, self.of)
                if to != fine.of[v]:
                    size[fine.of[v]] -= 1
                    size[to] += 1
                    fine.move(v, to)
        return fine


def leiden(edges: list[tuple[int, int, float]], n: int, total: float, gamma: float = 1.0, seed: int = 0, levels: int = 32) -> list[int]:
    """Community of each of n nodes. total: sum of all strengths (twice the weight of all edges of the whole graph)."""
    if gamma <= 0:
        raise ValueError("the resolution must be positive")
    rng = random.Random(seed)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    k = [0.0] * n
    for a, b, w in edges:
        links[a][b] = links[a].get(b, 0.0) + w
        links[b][a] = links[b].get(a, 0.0) + w
        k[a] += w
        k[b] += w
    return _levels(_Level(links, k, total, gamma), list(range(n)), rng, levels)


def _levels(level: _Level, member: list[int], rng: random.Random, levels: int) -> list[int]:
    """Levels until nothing changes; member: each node's node in the level given."""
    total, gamma = level.total, level.gamma
    for _ in range(levels):
        moves = level.local(rng)
        if not moves and len(set(level.of)) == len(level.links):
            break
        fine = level.refined(rng)
        number = {c: i for i, c in enumerate(sorted(set(fine.of)))}
        if len(number) == len(level.links) and not moves:
            break
        new: list[dict[int, float]] = [{} for _ in number]
        strength, start = [0.0] * len(number), [0] * len(number)
        for v, near in enumerate(level.links):
            c = number[fine.of[v]]
            strength[c] += level.k[v]
            start[c] = level.of[v]
            for u, w in near.items():
                e = number[fine.of[u]]
                new[c][e] = new[c].get(e, 0.0) + w
        member = [number[fine.of[m]] for m in member]
        done = len(number) == len(level.links)
        level = _Level(new, strength, total, gamma)
        # the next level starts from the communities found, not from single nodes
        first: dict[int, int] = {}
        for c, parent in enumerate(start):
            to = first.setdefault(parent, c)
            if to != c:
                level.move(c, to)
        if done:
            break
    return [level.of[m] for m in member]


def _rounds(src, dst, w, k, of, total: float, gamma: float, rng, single: bool = False, patience: int = 4):
    """of after rounds of moves for many nodes at once; src, dst, w: every link in both directions, without loops.

    In a round each community only gives or only takes nodes, by lot. Moves are taken by gain, each only if it still gains with
    all those before it that leave its community or reach its new one: quality rises as if one node moved after another.
    A node rests after `patience` rounds in vain, until a neighbour moves. single: only communities of one node give."""
    import numpy as np

    n, of = len(k), of.copy()
    order = np.argsort(src, kind="stable")
    src, dst, w = src[order], dst[order], w[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    d, size, tries = np.bincount(of, k, minlength=n), np.bincount(of, minlength=n), np.zeros(n, dtype=np.int64)

    def before(group, x):
        """Sum of x over the earlier entries of the same group."""
        order = np.argsort(group, kind="stable")
        sums, g = np.cumsum(x[order]) - x[order], group[order]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        out = np.empty(len(x))
        out[order] = sums - np.repeat(sums[head], np.diff(np.append(head, len(g))))
        return out

    def links_of(nodes):
        """Places of the links of some nodes, so that a round costs what its nodes have."""
        many = start[nodes + 1] - start[nodes]
        return np.repeat(start[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())

    while True:
        gives = rng.random(n) < 0.5
        free = (tries < patience) & gives[of]
        if single:
            free &= size[of] == 1
            if not ((tries < patience) & (size[of] == 1)).any():
                return of
        elif not (tries < patience).any():
            return of
        tries[free] += 1
        e = links_of(np.flatnonzero(free))
        s, t, x = src[e], of[dst[e]], w[e]
        own = t == of[s]
        inside = np.bincount(s[own], x[own], minlength=n)
        out = ~own & ~gives[t]
        key, x = s[out] * n + t[out], x[out]
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        key, x = key[order], x[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        link, v, c = np.add.reduceat(x, head), key[head] // n, key[head] % n
        gain = link - inside[v] - gamma * k[v] * (d[c] - d[of[v]] + k[v]) / total
        order = np.lexsort((c, -gain, v))
        first = order[np.concatenate([[True], v[order][1:] != v[order][:-1]])]
        first = first[2 * gain[first] / total > 1e-12]
        first = first[np.lexsort((v[first], -gain[first]))]
        v, c, link = v[first], c[first], link[first]
        if not len(v):
            continue
        safe = link - inside[v] - gamma * k[v] * (d[c] + before(c, k[v]) - d[of[v]] + before(of[v], k[v]) + k[v]) / total
        took = 2 * safe / total > 1e-12
        v, c = v[took], c[took]
        of[v] = c
        d, size = np.bincount(of, k, minlength=n), np.bincount(of, minlength=n)
        tries[dst[links_of(v)]] = 0
        tries[v] = 0


def leiden_large(a, b, w, n: int, total: float, gamma: float = 1.0, seed: int = 0, small: int = 2_000, levels: int = 32) -> list[int]:
    """leiden() over arrays of ends (a, b) and weights: levels of over `small` nodes move in rounds of arrays, the others node by node."""
    import numpy as np

    if gamma <= 0:
        raise ValueError("the resolution must be positive")
    rng = np.random.default_rng(seed)
    src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    loops, of, member = np.zeros(n), np.arange(n), np.arange(n)
    k = np.bincount(src, w, minlength=n)
    while len(k) > small and levels > 1:
        of = _rounds(src, dst, w, k, of, total, gamma, rng)
        same = of[src] == of[dst]
        fine = _rounds(src[same], dst[same], w[same], k, np.arange(len(k)), total, gamma, rng, single=True)
        names, number = np.unique(fine, return_inverse=True)
        if len(names) == len(k):
            break
        size, levels = len(names), levels - 1
        parent = np.zeros(size, dtype=np.int64)
        parent[number] = of
        # a community's number is its first part, as nodes start from the communities found
        _, first, kind = np.unique(parent, return_index=True, return_inverse=True)
        of, member = first[kind], number[member]
        key, inner = number[src] * size + number[dst], number[src] == number[dst]
        loops = np.bincount(number, loops, minlength=size) + np.bincount(number[src[inner]], w[inner], minlength=size)
        k = np.bincount(number, k, minlength=size)
        pairs, at = np.unique(key[~inner], return_inverse=True)
        src, dst, w = pairs // size, pairs % size, np.bincount(at, w[~inner], minlength=len(pairs))
    links: list[dict[int, float]] = [{} for _ in range(len(k))]
    for i, j, x in zip(src.tolist(), dst.tolist(), w.tolist()):
        links[i][j] = x
    for i in np.flatnonzero(loops).tolist():
        links[i][i] = float(loops[i])
    level = _Level(links, k.tolist(), total, gamma)
    for v, c in enumerate(of.tolist()):
        if c != v:
            level.move(v, c)
    return _levels(level, member.tolist(), random.Random(seed), levels)


def communities(edges: DataFrame, components: DataFrame, resolutions=RESOLUTIONS, seed: int = 0) -> DataFrame:
    """resolution, node, community (its smallest node). edges: source, target, weight; components: node, root."""
    for g in resolutions:
        if g <= 0:
            raise ValueError("resolutions must be positive")
    clean = clean_edges(edges)
    kind = clean.schema["source"].dataType.simpleString()
    total = clean.agg((2 * F.sum("weight")).alias("total"))
    rows = clean.join(components.withColumnRenamed("node", "source"), "source").crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("resolution", F.explode(F.array(*[F.lit(float(g)) for g in resolutions])))

    def run(key, pdf):
        pdf = pdf.sort_values(["source", "target"])
        ends, names = pd.factorize(pd.concat([pdf["source"], pdf["target"]], ignore_index=True), sort=True)
        a, b, w, total = ends[: len(pdf)], ends[len(pdf) :], pdf["weight"].to_numpy(), float(pdf["total"].iloc[0])
        del pdf, ends
        if len(names) > LARGE:
            of = leiden_large(a, b, w, len(names), total, key[0], seed)
        else:
            of = leiden(list(zip(a.tolist(), b.tolist(), w.tolist())), len(names), total, key[0], seed)
        least: dict[int, object] = {}
        for x, c in zip(names, of):
            least.setdefault(c, x)
        return pd.DataFrame({"resolution": key[0], "node": names, "community": [least[c] for c in of]})

    return rows.groupBy("resolution", "root").applyInPandas(run, f"resolution double, node {kind}, community {kind}")


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: modularity of membership (node, community) over the cleaned edges; 0 without edges."""
    e = clean_edges(edges)
    m = membership.select("node", "community")
    ends = e.select(F.col("source").alias("node"), "weight").union(e.select("target", "weight"))
    d = ends.join(m, "node").groupBy("community").agg(F.sum("weight").alias("d"))
    inner = e.join(m.toDF("source", "ca"), "source").join(m.toDF("target", "cb"), "target").where("ca = cb")
    inside = inner.groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("l"))
    w = e.agg((2 * F.sum("weight")).alias("w"))
    q = d.join(inside, "community", "left").crossJoin(F.broadcast(w))  # one row
    return q.agg(F.round(F.coalesce(F.sum(2 * F.coalesce("l", F.lit(0.0)) / F.col("w") - gamma * F.pow(F.col("d") / F.col("w"), 2)), F.lit(0.0)), 6).alias("modularity"))
