"""Similarity clusters by mergeable cluster-feature trees and Ward agglomeration.

Each partition builds a cluster-feature tree and hands on only its leaf summaries
(count, linear sum, square sum).  Summaries are tree-reduced in rounds until one
bounded set is left, which Ward's method merges; the number of groups is where
the merging cost jumps most.  One pass then assigns every row to its nearest
group, and the rows nearest to each centre describe it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRANCHING = 32
#: Most leaf summaries that one tree hands on, and so what the driver receives.
MAX_LEAVES = 1500


class Features:
    """Summaries (n, ls, ss) of sets of points, one per row."""

    def __init__(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        self.n, self.ls, self.ss = n, ls, ss

    def __len__(self) -> int:
        return len(self.n)

    @property
    def centres(self) -> np.ndarray:
        return self.ls / self.n[:, None]


class _Node:
    __slots__ = ("children", "ls", "n", "ss")

    def __init__(self, d: int, leaf: bool) -> None:
        self.n, self.ls, self.ss = np.zeros(0), np.zeros((0, d)), np.zeros(0)
        self.children: list[_Node] | None = None if leaf else []

    def append(self, n: float, ls: np.ndarray, ss: float, child: _Node | None = None) -> None:
        self.n, self.ls, self.ss = np.append(self.n, n), np.vstack([self.ls, ls]), np.append(self.ss, ss)
        if self.children is not None and child is not None:
            self.children.append(child)

    def total(self) -> tuple[float, np.ndarray, float]:
        return float(self.n.sum()), self.ls.sum(axis=0), float(self.ss.sum())

    def take(self, rows: np.ndarray) -> _Node:
        out = _Node(self.ls.shape[1], self.children is None)
        out.n, out.ls, out.ss = self.n[rows], self.ls[rows], self.ss[rows]
        if self.children is not None:
            out.children = [self.children[i] for i in rows]
        return out


class CFTree:
    """A cluster-feature tree of bounded size over points of ``d`` dimensions."""

    def __init__(self, d: int, threshold: float, max_leaves: int = MAX_LEAVES) -> None:
        self.d, self.threshold, self.max_leaves, self.leaves = d, threshold, max_leaves, 0
        self.root = _Node(d, True)

    def add(self, f: Features) -> None:
        """Insert summaries; when the tree grows too large it is rebuilt coarser."""
        for n, ls, ss in zip(f.n, f.ls, f.ss):
            split = self._insert(self.root, float(n), ls, float(ss))
            if split is not None:
                root = _Node(self.d, False)
                for part in split:
                    root.append(*part.total(), part)
                self.root = root
            if self.leaves > self.max_leaves:
                held = self.summaries()
                self.threshold *= 1.6
                self.root, self.leaves = _Node(self.d, True), 0
                self.add(held)

    def add_points(self, x: np.ndarray) -> None:
        """Points are first put together by cells well below the threshold's size."""
        if len(x):
            cell = np.floor(x / (self.threshold / np.sqrt(self.d))).astype(np.int64)
            _, at = np.unique(cell, axis=0, return_inverse=True)
            at = at.reshape(-1)
            k = int(at.max()) + 1
            ls = np.stack([np.bincount(at, x[:, j], k) for j in range(self.d)], axis=1)
            self.add(Features(np.bincount(at, minlength=k).astype(float), ls, np.bincount(at, (x**2).sum(axis=1), k)))

    def _insert(self, node: _Node, n: float, ls: np.ndarray, ss: float) -> tuple[_Node, _Node] | None:
        if len(node.n):
            gap = ((node.ls / node.n[:, None] - ls / n) ** 2).sum(axis=1)
            i = int(gap.argmin())
            if node.children is None:
                m, s, q = node.n[i] + n, node.ls[i] + ls, node.ss[i] + ss
                if q / m - ((s / m) ** 2).sum() <= self.threshold**2:
                    node.n[i], node.ls[i], node.ss[i] = m, s, q
                    return None
            else:
                split = self._insert(node.children[i], n, ls, ss)
                if split is None:
                    node.n[i] += n
                    node.ls[i] += ls
                    node.ss[i] += ss
                    return None
                keep = np.delete(np.arange(len(node.n)), i)
                rest = node.take(keep)
                node.n, node.ls, node.ss, node.children = rest.n, rest.ls, rest.ss, rest.children
                for part in split:
                    node.append(*part.total(), part)
                return self._split(node) if len(node.n) > BRANCHING else None
        node.append(n, ls, ss)
        self.leaves += 1
        return self._split(node) if len(node.n) > BRANCHING else None

    @staticmethod
    def _split(node: _Node) -> tuple[_Node, _Node]:
        c = node.ls / node.n[:, None]
        apart = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        a, b = np.unravel_index(apart.argmax(), apart.shape)
        near_a = apart[:, a] <= apart[:, b]
        near_a[a], near_a[b] = True, False
        return node.take(np.flatnonzero(near_a)), node.take(np.flatnonzero(~near_a))

    def summaries(self) -> Features:
        n, ls, ss, todo = [], [], [], [self.root]
        while todo:
            node = todo.pop()
            if node.children is None:
                n.append(node.n), ls.append(node.ls), ss.append(node.ss)
            else:
                todo += node.children
        return Features(np.concatenate(n), np.vstack(ls), np.concatenate(ss))


def ward(f: Features) -> tuple[np.ndarray, np.ndarray]:
    """Ward's agglomeration: merges (a, b) by row, the merged set taking a's place,
    and the cost of each merge."""
    n, c = f.n.astype(float).copy(), f.centres.copy()
    k = len(n)
    cost = (n[:, None] * n[None] / (n[:, None] + n[None])) * ((c[:, None] - c[None]) ** 2).sum(axis=2)
    np.fill_diagonal(cost, np.inf)
    merges, heights = [], []
    for _ in range(k - 1):
        a, b = np.unravel_index(cost.argmin(), cost.shape)
        a, b = (int(a), int(b)) if a < b else (int(b), int(a))
        merges.append((a, b))
        heights.append(float(cost[a, b]))
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        n[b] = 0.0
        cost[b, :] = cost[:, b] = np.inf
        row = np.where(n > 0, n * n[a] / np.maximum(n + n[a], 1e-300) * ((c - c[a]) ** 2).sum(axis=1), np.inf)
        row[a] = np.inf
        cost[a, :] = cost[:, a] = row
    return np.array(merges, int).reshape(-1, 2), np.array(heights)


def choose_groups(f: Features, k: int | None = None, k_max: int = 12) -> np.ndarray:
    """Centres of the groups; without ``k`` it is where the merging cost jumps most."""
    if len(f) == 0:
        return np.zeros((0, f.ls.shape[1]))
    merges, heights = ward(f)
    if k is None:
        # heights[-j] is the cost of going from j + 1 groups to j
        top = min(k_max, len(heights) - 1)
        ratio = {j: heights[-j + 1] / max(heights[-j], 1e-12) for j in range(2, top + 1)}
        k = max(ratio, key=lambda j: (ratio[j], -j)) if ratio else min(2, len(f))
    at = np.arange(len(f))
    for a, b in merges[: max(0, len(f) - k)]:
        at[at == b] = a
    groups = np.unique(at)
    return np.stack([f.ls[at == g].sum(axis=0) / f.n[at == g].sum() for g in groups])


def leaf_summaries(points: DataFrame, columns: list[str], threshold: float = 0.05, max_leaves: int = MAX_LEAVES, fan_in: int = 16) -> Features:
    """Leaf summaries of all rows, reduced over rounds of ``fan_in`` partitions."""
    d = len(columns)
    schema = "n double, " + ", ".join(f"s{i} double" for i in range(d)) + ", q double"
    names = ["n", *[f"s{i}" for i in range(d)], "q"]

    def emit(tree: CFTree) -> pd.DataFrame:
        f = tree.summaries()
        return pd.DataFrame(np.column_stack([f.n, f.ls, f.ss]), columns=names)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = CFTree(d, threshold, max_leaves)
        for pdf in batches:
            tree.add_points(pdf[columns].to_numpy(float))
        yield emit(tree)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = CFTree(d, threshold, max_leaves)
        for pdf in batches:
            x = pdf.to_numpy(float)
            tree.add(Features(x[:, 0], x[:, 1 : 1 + d], x[:, -1]))
        yield emit(tree)

    level = points.select(*columns).mapInPandas(first, schema)
    parts = points.rdd.getNumPartitions()
    while parts > 1:
        parts = max(1, parts // fan_in)
        level = level.repartition(parts).mapInPandas(merge, schema)
    rows = level.toPandas().to_numpy(float)  # one tree: at most max_leaves rows
    order = np.lexsort(rows.T) if len(rows) else []
    rows = rows[order]
    return Features(rows[:, 0], rows[:, 1 : 1 + d], rows[:, -1])


def nearest(columns: list[str], centres: np.ndarray) -> Column:
    """Struct (distance, cluster) of the nearest centre; a NULL feature is left out
    of the distance, and a row without any feature gets NULL."""
    options = []
    for g, c in enumerate(centres):
        parts = [F.coalesce((F.col(x) - float(v)) * (F.col(x) - float(v)), F.lit(0.0)) for x, v in zip(columns, c)]
        options.append(F.struct(sum(parts[1:], parts[0]).alias("distance"), F.lit(g).alias("cluster")))
    if not options:
        return F.lit(None).cast("struct<distance:double,cluster:int>")
    some = F.coalesce(*[F.col(x) for x in columns]).isNotNull()
    return F.when(some, F.array_min(F.array(*options)))


def cluster_rows(df: DataFrame, features: dict[str, Column], k: int | None = None, **settings) -> tuple[DataFrame, np.ndarray]:
    """``df`` with ``_cluster`` and ``_distance``, and the centres (standardised).

    ``features`` maps names to numeric expressions; they are standardised over all
    rows (a feature without spread counts nothing).  Rows with a NULL or NaN
    feature do not form groups but are assigned by their other features; rows
    with none get NULL.  Ties go to the lower cluster number.  An empty table, or
    one without a complete row, leaves every cluster NULL.  Extra columns are kept.

    Scale: two passes over the features plus the assignment pass.  What the driver
    receives is one tree of at most MAX_LEAVES summaries; the centres travel as
    literals.
    """
    raw = df.withColumns({f"_f_{n}": F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, c in features.items()})
    cols = [f"_f_{n}" for n in features]
    stats = raw.agg(*[F.avg(c).alias(f"m{c}") for c in cols], *[F.stddev_pop(c).alias(f"s{c}") for c in cols]).first()
    scaled = raw.withColumns({c: (F.col(c) - F.lit(stats[f"m{c}"] or 0.0)) / F.lit(stats[f"s{c}"] or 1.0) for c in cols})
    complete = scaled.select(*cols).dropna()
    centres = choose_groups(leaf_summaries(complete, cols, **settings), k)
    hit = scaled.withColumn("_hit", nearest(cols, centres))
    return hit.withColumns({"_cluster": F.col("_hit.cluster"), "_distance": F.sqrt("_hit.distance")}).drop("_hit", *cols), centres


def describe(clustered: DataFrame, id_column: str, members: int = 5) -> DataFrame:
    """Per cluster its size and the ``members`` rows nearest to its centre."""
    rank = F.row_number().over(Window.partitionBy("_cluster").orderBy("_distance", id_column))
    typical = clustered.where("_cluster is not null").select("_cluster", id_column, "_distance", rank.alias("_r")).where(F.col("_r") <= members)
    sizes = clustered.where("_cluster is not null").groupBy("_cluster").agg(F.count(F.lit(1)).alias("n_rows"))
    most = typical.groupBy("_cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", id_column))), lambda x: x[id_column]).alias("typical"))
    return sizes.join(most, "_cluster")


def monthly_features(daily: DataFrame) -> DataFrame:
    """(commodity, region, period_month) with the volatility and the cumulative
    change of the real prices, the latest revision of a day standing."""
    real = (
        daily.where("not is_imputed and price_median > 0 and obs_date is not null")
        .groupBy("commodity", "region", "obs_date")
        .agg(F.max_by(F.col("price_median").cast("double"), F.struct("updated_at", "point_id")).alias("p"))
        .withColumn("period_month", F.trunc("obs_date", "MM"))
    )
    within = Window.partitionBy("commodity", "region", "period_month").orderBy("obs_date")
    step = (F.log("p") - F.log(F.lag("p").over(within))) / F.sqrt(F.datediff("obs_date", F.lag("obs_date").over(within)))
    return (
        real.withColumn("_step", step).groupBy("commodity", "region", "period_month")
        .agg(F.stddev_samp("_step").alias("volatility"), (F.max_by("p", "obs_date") / F.min_by("p", "obs_date") - 1).alias("cum_change"))
    )


def cluster_cells(cells: DataFrame, daily: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The monthly cells without a quality reason, clustered by log volatility and
    cumulative change; missing figures are had from the daily prices."""
    own = cells.where("quality_reason is null").select("cell_id", "commodity", "region", "period_month", "zone", F.col("feat_volatility").cast("double").alias("v"), F.col("feat_cum_change").cast("double").alias("c"))
    lacking = own.where("v is null or c is null").select("commodity", "region", "period_month").distinct()
    on = ["commodity", "region", "period_month"]
    month = F.trunc("obs_date", "MM")
    needed = daily.withColumn("period_month", month).join(lacking, on, "left_semi").drop("period_month")
    full = own.join(monthly_features(needed), on, "left").select("cell_id", "zone", F.coalesce("v", "volatility").alias("v"), F.coalesce("c", "cum_change").alias("c"))
    return cluster_rows(full, {"v": F.log(F.greatest("v", F.lit(1e-5))), "c": F.col("c")})


def fill_zones(clustered: DataFrame) -> DataFrame:
    """cell_id, zone of the cells without one: the zone that most cells of the
    group carry, or that most cells carry where the group has none."""
    known = clustered.where("zone is not null").groupBy("_cluster", "zone").agg(F.count(F.lit(1)).alias("n"))
    most = known.groupBy("_cluster").agg(F.max_by("zone", F.struct("n", "zone")).alias("_zone"))
    overall = known.groupBy("zone").agg(F.sum("n").alias("n")).agg(F.max_by("zone", F.struct("n", "zone")).alias("_any"))
    missing = clustered.where("zone is null").select("cell_id", "_cluster")
    return missing.join(F.broadcast(most), "_cluster", "left").select("cell_id", F.coalesce(F.col("_zone"), overall.scalar()).alias("zone"))
