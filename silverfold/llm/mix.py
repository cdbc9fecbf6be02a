"""Mixing sources to target weights (problem 8), by a small min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. The
flow from patterns to sources, a few hundred numbers at most, is solved on the driver: a
pattern's tokens flow once at no cost, a second time at cost 1 a token, and so on, so
repetition is spread as thinly as the targets allow. Documents are then selected along a
seeded order by the flow's amounts, without any of them passing through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silverfold.operators.skew import prefix_sums
from silverfold.session import Stages

#: Most distinct patterns and targets; more are refused, never cut off.
MAX_PATTERNS, MAX_TARGETS = 50_000, 10_000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


class Flow:
    """Min-cost flow, primal-dual: all paths of one cost are filled together by blocking flows.

    Costs are the small whole numbers of copies, so there are no more rounds than different path costs.
    """

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        at = len(self.to)
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return at

    def _distances(self, s: int, price: list[int]) -> list[int | None]:
        """Least reduced costs from s; with these prices none is negative."""
        dist: list[int | None] = [None] * len(self.out)
        dist[s], todo = 0, [(0, s)]
        while todo:
            d, x = heappop(todo)
            if d > dist[x]:
                continue
            for e in self.out[x]:
                if self.cap[e] > 0:
                    y = self.to[e]
                    far = d + self.cost[e] + price[x] - price[y]
                    if dist[y] is None or far < dist[y]:
                        dist[y] = far
                        heappush(todo, (far, y))
        return dist

    def _levels(self, s: int, price: list[int]) -> list[int]:
        """Steps from s over free edges of reduced cost 0; -1 where none lead."""
        level, todo = [-1] * len(self.out), [s]
        level[s] = 0
        for x in todo:
            for e in self.out[x]:
                y = self.to[e]
                if self.cap[e] > 0 and level[y] < 0 and self.cost[e] + price[x] == price[y]:
                    level[y] = level[x] + 1
                    todo.append(y)
        return level

    def _blocking(self, s: int, t: int, price: list[int], level: list[int]) -> int:
        """Fills paths along the levels until each has a full edge."""
        at, total, path, x = [0] * len(self.out), 0, [], s
        while True:
            if x == t:
                f = min(self.cap[e] for e in path)
                total += f
                back = None
                for i, e in enumerate(path):
                    self.cap[e] -= f
                    self.cap[e ^ 1] += f
                    if back is None and not self.cap[e]:
                        back = i
                x = self.to[path[back] ^ 1]
                del path[back:]
                continue
            for k in range(at[x], len(self.out[x])):
                e = self.out[x][k]
                y = self.to[e]
                if self.cap[e] > 0 and level[y] == level[x] + 1 and self.cost[e] + price[x] == price[y]:
                    at[x] = k
                    path.append(e)
                    x = y
                    break
            else:
                at[x] = len(self.out[x])
                if x == s:
                    return total
                level[x] = -1
                x = self.to[path.pop() ^ 1]

    def run(self, s: int, t: int) -> int:
        """The largest flow from s to t at the least cost; its amount."""
        total, price = 0, [0] * len(self.out)
        while True:
            dist = self._distances(s, price)
            if dist[t] is None:
                return total
            for x, d in enumerate(dist):
                price[x] += min(d, dist[t]) if d is not None else dist[t]
            while (level := self._levels(s, price))[t] >= 0:
                total += self._blocking(s, t, price, level)

    def side(self, s: int) -> list[bool]:
        """Vertices still reached from s: the source's side of a smallest cut."""
        seen, todo = [False] * len(self.out), [s]
        seen[s] = True
        for x in todo:
            for e in self.out[x]:
                if self.cap[e] > 0 and not seen[self.to[e]]:
                    seen[self.to[e]] = True
                    todo.append(self.to[e])
        return seen


def _network(patterns: dict[tuple[int, ...], int], targets: list[Target], quotas: list[int], costs: bool):
    """The flow network: source, layers (pattern, copy), targets, sink; and its edges from layers to targets."""
    names = [(p, k) for p in patterns for k in range(1, max(targets[s].repeats for s in p) + 1)]
    n = len(names) + len(targets)
    flow = Flow(n + 2)
    edges = {}
    for i, (p, k) in enumerate(names):
        flow.edge(n, i, patterns[p], k - 1 if costs else 0)
        for s in p:
            if targets[s].repeats >= k:
                edges[i, s] = flow.edge(i, len(names) + s, patterns[p])
    for s, q in enumerate(quotas):
        flow.edge(len(names) + s, n + 1, q)
    return flow, names, edges


def route(patterns: dict[tuple[int, ...], int], targets: list[Target], quotas: list[int]):
    """Tokens each layer of a pattern gives to a source: ``{(pattern, layer): [(source, tokens)]}``.

    Layer k is the k-th copy of the pattern's documents; a source takes from layers up to
    its repeats only. Also returns the tokens routed in all.
    """
    flow, names, edges = _network(patterns, targets, quotas, costs=True)
    total = flow.run(len(flow.out) - 2, len(flow.out) - 1)
    routed: dict = {}
    for (i, s), e in edges.items():
        if f := flow.cap[e ^ 1]:
            routed.setdefault(names[i], []).append((s, f))
    return routed, total


def quotas_of(total: int, shares: list[float]) -> list[int]:
    whole = sum(shares)
    return [int(total * x / whole) for x in shares]


def largest_total(patterns: dict[tuple[int, ...], int], targets: list[Target], shares: list[float]) -> int:
    """The most tokens of which every source can have its share within its repeats.

    From above: where a total is too much, a smallest cut names sources whose documents can't give
    their quotas; the total falls to the most those can, and so on until it is met. Each step is
    a bound any answer keeps, so the first total that is met is the largest; few cuts come up.
    """
    total = sum(c * max(targets[s].repeats for s in p) for p, c in patterns.items())
    while total:
        quotas = quotas_of(total, shares)
        flow, names, _ = _network(patterns, targets, quotas, costs=False)
        if flow.run(len(flow.out) - 2, len(flow.out) - 1) == sum(quotas):
            break
        reached = flow.side(len(flow.out) - 2)
        short = [s for s in range(len(targets)) if not reached[len(names) + s]]
        # what the layers not reached give, and those reached give to no source of these: all that is to be had for `short`
        most = sum(patterns[p] for i, (p, k) in enumerate(names) if not reached[i]) + sum(patterns[p] for i, (p, k) in enumerate(names) if reached[i] for s in p if s in set(short) and targets[s].repeats >= k)
        low, high = 0, total - 1
        while low < high:
            mid = (low + high + 1) // 2
            q = quotas_of(mid, shares)
            low, high = (mid, high) if sum(q[s] for s in short) <= most else (low, mid - 1)
        total = low
    return total


def mix(members: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 13) -> DataFrame:
    """The mix: ``doc_id, source, copies, n_tokens``, one row a document and source taken.

    ``members`` has ``doc_id, source, n_tokens``, a row for each source a document belongs
    to; ``targets`` has ``source, target_share, max_repeats``. The shares of sources that
    have documents are brought to a sum of 1; a source without any can't have its share
    (``shares`` reports it with 0), and documents of no target source aren't taken.

    Without ``total_tokens`` the mix is the largest in which every source gets its share; with
    it, a source that can't fill its quota gives what its documents and repeats allow. The k-th
    copy of a document is only taken for a source whose max_repeats is k or more. Shares are met to
    within about half a document; a last document a source is added or taken back where that comes closer.

    Null ids, sources or sizes, and documents of no tokens, take no part. Repeated rows
    count once; of different sizes of one id the largest holds. Targets with a null, a share or
    repeats of 0 or less are left out; of several for one source the smallest holds. Either
    table empty: no rows. Other columns are ignored.
    """
    spark = members.sparkSession
    stages = Stages(spark, "mix")
    listed = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).orderBy("source").limit(MAX_TARGETS + 1).collect()
    if len(listed) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    goals = [Target(r.source, float(r.t.target_share), int(r.t.max_repeats)) for r in listed]
    schema = "doc_id long, source string, copies int, n_tokens long"
    if not goals:
        return spark.createDataFrame([], schema)
    index = F.broadcast(spark.createDataFrame([(g.source, i) for i, g in enumerate(goals)], "source string, s int"))
    docs = (
        members.where("doc_id is not null and n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("long").alias("n")).join(index, "source")
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("p"), F.max("n").alias("n"))
    )
    docs = stages.save(docs)
    counted = docs.groupBy("p").agg(F.sum("n").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(counted) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r.p): int(r.n) for r in sorted(counted, key=lambda r: tuple(r.p))}
    if not patterns:
        return spark.createDataFrame([], schema)
    there = {s for p in patterns for s in p}
    share = [g.share if i in there else 0.0 for i, g in enumerate(goals)]
    total = largest_total(patterns, goals, share) if total_tokens is None else total_tokens
    quotas = quotas_of(total, share)
    routed, _ = route(patterns, goals, quotas)

    cuts = []
    for (p, k), parts in routed.items():
        lo = 0
        for s, f in sorted(parts):
            cuts.append((list(p), k, s, lo, lo + f))
            lo += f
    segments = F.broadcast(spark.createDataFrame(cuts, "p array<int>, k int, s int, lo long, hi long"))
    ranked = prefix_sums(docs.withColumn("r", F.xxhash64("doc_id", F.lit(seed))), ["p"], ["r", "doc_id"], "n", "c")
    mid = F.col("c") + F.col("n") / 2
    taken = ranked.join(segments, "p").where((mid >= F.col("lo")) & (mid < F.col("hi")))
    taken = stages.save(taken.groupBy("doc_id", "n", "s").agg(F.count(F.lit(1)).cast("int").alias("copies")))

    change = _last_documents(docs, taken, goals, quotas)
    if change:
        delta = spark.createDataFrame(change, "doc_id long, n long, s int, copies int")
        taken = taken.unionByName(delta).groupBy("doc_id", "n", "s").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    names = F.array(*(F.lit(g.source) for g in goals))
    return taken.select("doc_id", names[F.col("s")].alias("source"), "copies", F.col("n").alias("n_tokens"))


def _last_documents(docs: DataFrame, taken: DataFrame, goals: list[Target], quotas: list[int]) -> list[tuple]:
    """One document to add to or take back from each source, where that comes closer to its quota."""
    have = {r.s: int(r.t) for r in taken.groupBy("s").agg(F.sum(F.col("n") * F.col("copies")).alias("t")).collect()}
    miss = [(s, q - have.get(s, 0)) for s, q in enumerate(quotas) if q - have.get(s, 0)]
    if not miss:
        return []
    spark = docs.sparkSession
    lack = F.broadcast(spark.createDataFrame([(s, r, goals[s].repeats) for s, r in miss], "s int, miss long, repeats int"))
    copies = taken.groupBy("doc_id").agg(F.sum("copies").alias("copies"))
    free = docs.select("doc_id", "n", F.explode("p").alias("s")).join(lack.where("miss > 0"), "s").join(copies, "doc_id", "left").where("coalesce(copies, 0) < repeats")
    back = taken.join(lack.where("miss < 0"), "s")
    off = F.abs(F.abs("miss") - F.col("n"))
    best = [
        r for df, sign in ((free, 1), (back, -1))
        for r in ((x.s, x.b.doc_id, x.b.n, sign, x.b.off) for x in df.groupBy("s").agg(F.min(F.struct(off.alias("off"), "doc_id", "n")).alias("b")).collect())
    ]
    left, used, change = dict(miss), set(), []
    for s, doc, n, sign, o in sorted(best):
        if o < abs(left[s]) and doc not in used:
            used.add(doc)
            change.append((doc, n, s, sign))
    return change


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source reached: ``source, target_share, max_repeats, n_docs, n_copies, most_copies, tokens, actual_share``."""
    per = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # a row a target
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = targets.where("source is not null").select("source", "target_share", "max_repeats").join(per, "source", "left")
    return out.select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), zero("tokens"), F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"))
