"""Samples that match target shares of categories, by min-cost flow on cell counts.

Rows are counted per cell of the crossed categories, for all target sets at once; only these counts are looked at. A
flow runs from the first dimension's categories through the cells to the second's: arcs
are as wide as a category's target or a cell's rows, a category's minimum is a cheaper
arc beside its target, and what a target lacks runs over a slack arc, which is the shortfall
to report. The integer flow of a cell is its quota, drawn at random from its rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import order_bucket
from lectern.runtime import materialize, small

_FLOOR, _MISS, _MISS_FLOOR = 1_000, 4_000, 50_000


class Flow:
    """Min-cost flow by shortest augmenting paths with potentials; costs must not be negative."""

    def __init__(self) -> None:
        self.arcs: list[list[int]] = []  # to, capacity, cost
        self.out: dict[object, list[int]] = defaultdict(list)
        self.ids: dict[object, int] = {}

    def arc(self, a: object, b: object, cap: int, cost: int) -> int:
        for x in (a, b):
            self.ids.setdefault(x, len(self.ids))
        self.arcs += [[self.ids[b], cap, cost], [self.ids[a], 0, -cost]]
        self.out[self.ids[a]].append(len(self.arcs) - 2)
        self.out[self.ids[b]].append(len(self.arcs) - 1)
        return len(self.arcs) - 2

    def run(self, a: object, b: object) -> None:
        if a not in self.ids or b not in self.ids:
            return
        source, sink, n = self.ids[a], self.ids[b], len(self.ids)
        potential = [0] * n
        while True:
            dist, by, heap = [1 << 60] * n, [-1] * n, [(0, source)]
            dist[source] = 0
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for k in self.out[x]:
                    to, cap, cost = self.arcs[k]
                    if cap > 0 and (new := d + cost + potential[x] - potential[to]) < dist[to]:
                        dist[to], by[to] = new, k
                        heapq.heappush(heap, (new, to))
            if by[sink] < 0:
                return
            far = dist[sink]
            potential = [p + min(d, far) for p, d in zip(potential, dist, strict=True)]
            width, x = 1 << 60, sink
            while x != source:
                width = min(width, self.arcs[by[x]][1])
                x = self.arcs[by[x] ^ 1][0]
            x = sink
            while x != source:
                self.arcs[by[x]][1] -= width
                self.arcs[by[x] ^ 1][1] += width
                x = self.arcs[by[x] ^ 1][0]

    def flow(self, k: int) -> int:
        return self.arcs[k ^ 1][1]


def split_total(total: int, shares: list[float]) -> list[int]:
    """Integers nearest to ``total`` times the shares that keep the rounded sum, largest remainders first."""
    exact = [total * s for s in shares]
    out = [int(x) for x in exact]
    want = min(total, round(sum(exact)))
    for i in sorted(range(len(exact)), key=lambda i: (out[i] - exact[i], i))[: max(0, want - sum(out))]:
        out[i] += 1
    return out


Goal = dict[str, tuple[int, int]]


def _margins(cells: dict[tuple[str, ...], int], first: Goal, second: Goal, price: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], int]:
    """Rows of each cell such that the first two categories of the cells meet their goals; dearer cells are used last."""
    net, arcs = Flow(), {}
    room: dict[str, int] = defaultdict(int)
    for cell, n in cells.items():
        room[cell[0]] += n
    for a, (target, least) in first.items():
        floor = min(least, target)
        net.arc("s", (0, a), floor, 0)
        net.arc("s", (0, a), target - floor, _FLOOR)
        net.arc((0, a), "t", target - floor, _MISS)  # slack: the shortfall
        net.arc((0, a), "t", floor, _MISS_FLOOR)
    for b, (target, least) in second.items():
        floor = min(least, target)
        net.arc((1, b), "t", floor, 0)
        net.arc((1, b), "t", target - floor, _FLOOR)
    for cell, n in sorted(cells.items()):
        a, b = cell[0], cell[1]
        if a in first and b in second:
            even = min(n, -(-n * first[a][0] // max(1, room[a])))  # as the category's rows lie, before anything dearer
            cost = price.get(cell, 0)
            arcs[cell] = net.arc((0, a), (1, b), even, cost), net.arc((0, a), (1, b), n - even, cost + 1)
    net.run("s", "t")
    return {cell: net.flow(i) + net.flow(j) for cell, (i, j) in arcs.items()}


def _within(drawn: dict[tuple[str, ...], int], cells: dict[tuple[str, ...], int], at: int, goal: Goal) -> dict[tuple[str, ...], int]:
    """``drawn`` with the rows of each group of equal other categories dealt anew over dimension ``at``, so that it exceeds no target there and its minimums go first."""
    net, arcs = Flow(), {}
    group = lambda cell: cell[:at] + cell[at + 1 :]
    sums: dict[tuple[str, ...], int] = defaultdict(int)
    for cell, n in drawn.items():
        sums[group(cell)] += n
    for g, n in sums.items():
        net.arc("s", ("g", g), n, 0)
    for c, (target, least) in goal.items():
        floor = min(least, target)
        net.arc(("c", c), "t", floor, 0)
        net.arc(("c", c), "t", target - floor, _FLOOR)
    for cell, n in sorted(cells.items()):
        if sums.get(group(cell)) and cell[at] in goal:
            arcs[cell] = net.arc(("g", group(cell)), ("c", cell[at]), n, 0)
    net.run("s", "t")
    return {cell: net.flow(i) for cell, i in arcs.items()}


def _filled(drawn: dict[tuple[str, ...], int], cells: dict[tuple[str, ...], int], goals: list[Goal]) -> dict[tuple[str, ...], int]:
    """``drawn`` and what cells with rows left can add without exceeding any target."""
    need = [{c: t for c, (t, _) in g.items()} for g in goals]
    out = dict(drawn)
    for cell, n in out.items():
        for d, c in enumerate(cell):
            need[d][c] -= n
    for cell, n in sorted(cells.items()):
        more = min([n - out.get(cell, 0), *(need[d].get(c, 0) for d, c in enumerate(cell))])
        if more > 0:
            out[cell] = out.get(cell, 0) + more
            for d, c in enumerate(cell):
                need[d][c] -= more
    return out


def _lacking(drawn: dict[tuple[str, ...], int], goals: list[Goal]) -> int:
    """Rows short of the targets over all dimensions; rows short of a minimum count as many times as their arcs cost."""
    out = 0
    for d, goal in enumerate(goals):
        got: dict[str, int] = defaultdict(int)
        for cell, n in drawn.items():
            got[cell[d]] += n
        out += sum(max(0, t - got[c]) + max(0, min(least, t) - got[c]) * (_MISS_FLOOR // _MISS) for c, (t, least) in goal.items())
    return out


def quotas(cells: dict[tuple[str, ...], int], *goals: Goal, rounds: int = 30) -> dict[tuple[str, ...], int]:
    """Rows to draw from each cell; ``goals`` has for each dimension of the cells category -> (target, minimum).

    For two dimensions one flow is the optimum. A further dimension is none that a flow between two sides can hold: its categories
    are priced instead, a category beyond its target dearer and one below it cheaper from round to round (subgradient steps on
    the multipliers of its margins); after each flow the further dimensions are settled within it, minimums first, and
    the round that lacks least is kept.
    """
    if len(goals) <= 2:
        return _margins(cells, *goals, {})
    wanted = {c: n for c, n in cells.items() if all(c[d] in g for d, g in enumerate(goals))}
    price: dict[tuple[int, str], float] = defaultdict(float)
    best: tuple[int, dict[tuple[str, ...], int]] | None = None
    for step in range(1, rounds + 1):
        drawn = _margins(wanted, goals[0], goals[1], {cell: int(sum(price[d, cell[d]] for d in range(2, len(goals)))) for cell in wanted})
        got: dict[tuple[int, str], int] = defaultdict(int)
        for cell, n in drawn.items():
            for d in range(2, len(goals)):
                got[d, cell[d]] += n
        for d in range(2, len(goals)):
            drawn = _within(drawn, wanted, d, goals[d])
        drawn = _filled(drawn, wanted, goals)
        lacks = _lacking(drawn, goals)
        if best is None or lacks < best[0]:
            best = lacks, drawn
        if lacks == 0:
            break
        for d in range(2, len(goals)):
            for c, (target, least) in goals[d].items():
                weight = 4 if got[d, c] < min(least, target) else 1
                price[d, c] += weight * 500 / step**0.5 * (got[d, c] - target) / max(1, target, got[d, c])
            low = min(price[d, c] for c in goals[d])
            for c in goals[d]:  # below what leaving a target unmet costs, so that prices choose between cells only
                price[d, c] = min(price[d, c] - low, 1_800 / (len(goals) - 2))
    return best[1] if best else {}


OTHER = "\x00other"


class TargetSample:
    """``targets``: target_set, sample_fraction, dimension, category, target_share, min_rows; dimensions are columns of ``rows``.

    ``rows``: ``id`` and a string column for each dimension; a null category is none that a target can name.
    Rows with a null id are dropped, repeated ids must have been settled before. Shares that sum to less
    than one leave the rest to categories without a target; a minimum above the target raises it. One and two
    dimensions are exact, further ones are approached by prices (see ``quotas``). Shortfalls aren't filled up with other
    categories: the sample is smaller then and the report says where.
    Targets with a null set, dimension, category, share or fraction, or an unknown dimension, are dropped.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, id_col: str, dimensions: list[str], seed: int = 29):
        self.spark, self.seed = rows.sparkSession, seed
        self.rows = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), *(F.coalesce(F.col(d).cast("string"), F.lit(OTHER)).alias(d) for d in dimensions))
        kept = targets.where(F.col("dimension").isin(dimensions)).dropna(subset=["target_set", "sample_fraction", "category", "target_share"])
        self.targets = kept.select("target_set", "sample_fraction", "dimension", "category", "target_share", F.coalesce("min_rows", F.lit(0)).alias("min_rows")).distinct().collect()  # the request itself
        self.dimensions = dimensions
        self.sets: dict[int, list] = defaultdict(list)
        for t in self.targets:
            self.sets[t["target_set"]].append(t)
        self.plans: list[tuple[int, str, int]] = []
        self.report_rows: list[tuple] = []
        self._plan()

    def _dims(self, s: int) -> list[str]:
        return [d for d in self.dimensions if any(t["dimension"] == d for t in self.sets[s])]

    def _named(self, s: int, d: str) -> list[str]:
        return sorted({t["category"] for t in self.sets[s] if t["dimension"] == d})

    def _cells(self) -> DataFrame:
        """(id, s, cell): each row once for every set, with its cell there; all sets are read in one pass."""
        kinds = []
        for s in sorted(self.sets):
            own = [F.when(F.col(d).isin(self._named(s, d)), F.col(d)).otherwise(F.lit(OTHER)) for d in self._dims(s)]
            kinds.append(F.struct(F.lit(s).cast("long").alias("s"), F.concat_ws("\x01", *own).alias("cell")))
        return self.rows.select("id", F.explode(F.array(*kinds)).alias("x")).select("id", "x.s", "x.cell")

    def _plan(self) -> None:
        """Quota of every cell of every set; a set has at most the product of its named categories' numbers of cells."""
        if not self.sets:
            return
        there: dict[int, dict[tuple[str, ...], int]] = defaultdict(dict)
        for r in self._cells().groupBy("s", "cell").agg(F.count(F.lit(1)).alias("n")).collect():
            there[r["s"]][tuple(r["cell"].split("\x01"))] = r["n"]
        for s, ts in sorted(self.sets.items()):
            dims, counts = self._dims(s), there[s]
            total = sum(counts.values())
            size = round(total * max(t["sample_fraction"] for t in ts))
            goals: list[Goal] = []
            for d in dims:
                own, named = {t["category"]: t for t in ts if t["dimension"] == d}, self._named(s, d)
                rows = split_total(size, [own[c]["target_share"] for c in named])
                goals.append({c: (max(n, own[c]["min_rows"]), own[c]["min_rows"]) for c, n in zip(named, rows, strict=True)} | {OTHER: (max(0, size - sum(rows)), 0)})
            if len(dims) == 1:
                every = {"": (size + sum(m for _, m in goals[0].values()), 0)}
                quota = {cell[:1]: n for cell, n in quotas({(*c, ""): n for c, n in counts.items()}, goals[0], every).items()}
            else:
                quota = quotas(counts, *goals)
            self.plans += [(s, "\x01".join(cell), n) for cell, n in sorted(quota.items()) if n]
            for at, d in enumerate(dims):
                for t in sorted((t for t in ts if t["dimension"] == d), key=lambda t: t["category"]):
                    c = t["category"]
                    drawn = sum(n for cell, n in quota.items() if cell[at] == c)
                    found = sum(n for cell, n in counts.items() if cell[at] == c)
                    self.report_rows.append((s, d, c, float(t["target_share"]), int(goals[at][c][0]), int(t["min_rows"]), int(found), int(drawn), sum(quota.values()), size))

    def sample(self) -> DataFrame:
        """(target_set, id): the rows drawn. A cell's rows are ordered by a hash: the buckets of it before the one in which the quota ends are taken whole, and only that one is ranked."""
        if not self.plans:
            return self.spark.createDataFrame([], "target_set long, id string")
        quota = self.spark.createDataFrame(self.plans, "s long, cell string, quota long")
        h = F.xxhash64(F.lit(self.seed), "s", "id")
        rows = self._cells().withColumn("h", h).withColumn("k", order_bucket(F.col("h"))).join(small(quota), ["s", "cell"])
        counts = rows.groupBy("s", "cell", "quota", "k").agg(F.count(F.lit(1)).alias("n"))
        before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("s", "cell").orderBy("k")) - F.col("n"))
        edge = before.where("before < quota and before + n >= quota").select("s", "cell", F.col("k").alias("edge"), (F.col("quota") - F.col("before")).alias("rest"))  # one row per cell
        picked = rows.drop("quota").join(small(materialize(edge)), ["s", "cell"])
        last = picked.where("k = edge").withColumn("r", F.row_number().over(Window.partitionBy("s", "cell").orderBy("h", "id"))).where("r <= rest")
        return picked.where("k < edge").select("s", "id").union(last.select("s", "id")).select(F.col("s").alias("target_set"), "id")

    def report(self) -> DataFrame:
        """One row per target: rows wanted, there and drawn, the share reached, the shortfall, and whether target and minimum were met."""
        schema = "target_set long, dimension string, category string, target_share double, target_rows long, min_rows long, available long, drawn long, sample_rows long, wanted_rows long"
        df = self.spark.createDataFrame(self.report_rows, schema)
        return df.select("target_set", "dimension", "category", "target_share", "target_rows", "min_rows", "available", "drawn", "sample_rows", F.round(F.coalesce(F.try_divide("drawn", "sample_rows"), F.lit(0.0)), 6).alias("reached_share"), (F.col("target_rows") - F.col("drawn")).alias("shortfall"), (F.col("drawn") >= F.col("target_rows")).alias("target_met"), (F.col("drawn") >= F.col("min_rows")).alias("minimum_met"))
