"""k-means over a grid of k and restarts, and the exact Euclidean silhouette.

All (k, restart) configurations advance together: one pass over the rows moves
every centroid of every configuration, so the number of passes is the number of
Lloyd iterations, not iterations times configurations.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kisaran.session import cut_lineage


def _assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None]
    at = d.argmin(axis=1)
    return at, np.maximum(d[np.arange(len(x)), at], 0.0)


def _mix(h: np.ndarray) -> np.ndarray:
    """splitmix64: evenly spread 64-bit numbers from any."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _gumbel(h: np.ndarray, salt: int) -> np.ndarray:
    """A Gumbel number per row hash; another for each salt."""
    u = (_mix(h ^ _mix(np.array([salt], dtype=np.uint64))) >> np.uint64(11)).astype(float)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.min([((x - y) ** 2).sum(axis=1) for y in centres], axis=0)


def _starts(points: DataFrame, columns: list[str], grid: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """Greedy k-means++ centres of every (k, restart) from all points: of 2 + ln k
    candidates for a centre the one that leaves the least inertia.

    One pass draws the candidates and one weighs them.  The point with the largest
    log(weight x squared distance) + Gumbel number is a draw in proportion to weight x
    squared distance.
    """
    chosen: dict[tuple[int, int], list[list[float]]] = {key: [] for key in grid}
    trials = {k: 2 + int(np.log(k)) for k, _ in grid}
    for step in range(max(trials)):
        now = {key: np.array(c) for key, c in chosen.items() if key[0] > step}

        def draw(batches: Iterator[pd.DataFrame], now: dict = now, step: int = step) -> Iterator[pd.DataFrame]:
            best: dict[tuple[int, int, int], tuple[float, list[float]]] = {}
            for pdf in batches:
                x, w, h = pdf[columns].to_numpy(float), np.log(pdf["_w"].to_numpy(float)), pdf["_h"].to_numpy(np.int64).view(np.uint64)
                if not len(x):
                    continue
                for (k, r), c in now.items():
                    near = _nearest(x, c) if step else np.ones(len(x))
                    odds = np.where(near > 0, w + np.log(np.where(near > 0, near, 1.0)), -np.inf)
                    for t in range(trials[k] if step else 1):
                        score = odds + _gumbel(h, (k << 40) + (r << 16) + (step << 8) + t)
                        i = int(score.argmax())
                        if np.isfinite(score[i]) and (float(score[i]), x[i].tolist()) > best.get((k, r, t), (-np.inf, [])):
                            best[(k, r, t)] = (float(score[i]), x[i].tolist())
            if best:
                yield pd.DataFrame([(*key, s, x) for key, (s, x) in best.items()], columns=["k", "r", "t", "s", "x"])

        part = points.mapInPandas(draw, "k int, r int, t int, s double, x array<double>")
        drawn: dict[tuple[int, int], dict[int, list[float]]] = {}
        for row in part.groupBy("k", "r", "t").agg(F.max_by("x", F.struct("s", "x")).alias("x")).collect():
            drawn.setdefault((row.k, row.r), {})[row.t] = list(row.x)

        def weigh(batches: Iterator[pd.DataFrame], now: dict = now, drawn: dict = drawn) -> Iterator[pd.DataFrame]:
            left = {(*key, t): 0.0 for key, c in drawn.items() for t in c}
            for pdf in batches:
                x, w = pdf[columns].to_numpy(float), pdf["_w"].to_numpy(float)
                for key, c in drawn.items():
                    near = _nearest(x, now[key])
                    for t, y in c.items():
                        left[(*key, t)] += float((w * np.minimum(near, ((x - np.array(y)) ** 2).sum(axis=1))).sum())
            yield pd.DataFrame([(*key, v) for key, v in left.items()], columns=["k", "r", "t", "i"])

        taken = dict.fromkeys(drawn, 0)
        if step:
            left = points.mapInPandas(weigh, "k int, r int, t int, i double").groupBy("k", "r", "t").agg(F.sum("i").alias("i"))
            taken = {(row.k, row.r): row.t for row in left.groupBy("k", "r").agg(F.min_by("t", F.struct("i", "t")).alias("t")).collect()}
        for key, t in taken.items():
            chosen[key].append(drawn[key][t])
    return {key: np.array(c) for key, c in chosen.items()}


def fit_grid(df: DataFrame, columns: list[str], ks: list[int], restarts: int = 50, seed: int = 20260729, passes: int = 300, tolerance: float = 1e-6) -> dict[int, tuple[float, np.ndarray]]:
    """k -> (inertia, centres) of the best restart.  Rows with a NULL are left out.

    A k above the number of distinct points is left out.  Equal rows are one point
    with a weight.  A configuration rests once no centre moves by ``tolerance``; a
    warning names the number that still moved after the last pass.  What comes back
    to the driver per pass are (configurations x k) sums.
    """
    rows = df.select(*columns).dropna().select(*[F.col(c).cast("double").alias(c) for c in columns])
    weighed = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_w"))
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as the work per row is far beyond its size
    points = cut_lineage(weighed.withColumn("_h", F.xxhash64(F.lit(seed), *columns)).repartition(parts, *columns))
    distinct = points.count()
    ks = [k for k in ks if 2 <= k <= distinct]
    if not ks:
        return {}
    grid = _starts(points, columns, [(k, r) for k in ks for r in range(restarts)])
    d = len(columns)

    def sums(now: dict[tuple[int, int], np.ndarray]) -> pd.DataFrame:
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {key: [np.zeros((key[0], d)), np.zeros(key[0]), 0.0] for key in now}
            for pdf in batches:
                x, w = pdf[columns].to_numpy(float), pdf["_w"].to_numpy(float)
                for key, c in now.items():
                    at, near = _assign(x, c)
                    s = total[key]
                    for j in range(d):
                        s[0][:, j] += np.bincount(at, w * x[:, j], key[0])
                    s[1] += np.bincount(at, w, key[0])
                    s[2] += float((w * near).sum())
            yield pd.DataFrame([(k, r, c, float(s[1][c]), s[0][c].tolist(), float(s[2]) if c == 0 else 0.0) for (k, r), s in total.items() for c in range(k)], columns=["k", "r", "c", "n", "s", "i"])

        part = points.mapInPandas(step, "k int, r int, c int, n double, s array<double>, i double")
        return part.groupBy("k", "r", "c").agg(F.sum("n").alias("n"), F.sum("i").alias("i"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(d)]).toPandas()

    moving = dict(grid)
    for _ in range(passes):
        now, moving = moving, {}
        for (k, r), t in sums(now).sort_values(["k", "r", "c"]).groupby(["k", "r"]):
            key = (int(k), int(r))
            n = t["n"].to_numpy()
            grid[key] = np.where(n[:, None] > 0, t[[f"s{j}" for j in range(d)]].to_numpy() / np.maximum(n, 1)[:, None], now[key])
            if float(np.abs(grid[key] - now[key]).max()) >= tolerance:
                moving[key] = grid[key]
        if not moving:
            break
    if moving:
        warnings.warn(f"{len(moving)} of {len(grid)} k-means configurations still moved after {passes} passes", RuntimeWarning, stacklevel=2)
    inertia = {(int(k), int(r)): float(i) for (k, r), i in sums(grid).groupby(["k", "r"])["i"].sum().items()}
    best = {k: min((key for key in grid if key[0] == k), key=lambda key: (round(inertia[key], 9), key)) for k in ks}
    return {k: (inertia[key], grid[key]) for k, key in best.items()}


def assign(df: DataFrame, columns: list[str], centres: np.ndarray, name: str = "cluster_id") -> DataFrame:
    """Nearest centre of each row, by JVM expressions; NULL with a NULL feature."""
    options = []
    for g, c in enumerate(centres):
        parts = [(F.col(x) - float(v)) * (F.col(x) - float(v)) for x, v in zip(columns, c)]
        options.append(F.struct(sum(parts[1:], parts[0]).alias("d"), F.lit(g).alias("c")))
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    return df.withColumn(name, F.when(full, F.array_min(F.array(*options))["c"]))


def silhouette(df: DataFrame, columns: list[str], cluster: str, block: int = 20_000) -> DataFrame:
    """``df``'s rows with a cluster, and their exact Euclidean ``silhouette``.

    Every row is held against all rows, a block of at most ``block`` reference rows
    at a time, so no pairs are shuffled; a cluster of one row scores 0.  The work
    is quadratic by definition: meant for cells, not for raw readings.
    """
    rows = df.where(F.col(cluster).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(cluster).agg(F.count(F.lit(1))).collect()}
    labels = sorted(sizes)
    n = sum(sizes.values())
    kinds = rows.schema
    names = [f"_t{i}" for i in range(len(labels))]
    out = rows.withColumns({c: F.lit(0.0) for c in names})
    blocks = max(1, -(-n // block))
    spark_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    keyed = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(cluster).alias("_c")).withColumn("_b", F.pmod(F.xxhash64(*columns, "_c", F.monotonically_increasing_id()), F.lit(blocks)))
    for b in range(blocks):
        part = keyed.where(F.col("_b") == b).toPandas()
        ref, at = part[columns].to_numpy(float), np.searchsorted(labels, part["_c"].to_numpy())

        def add(batches: Iterator[pd.DataFrame], ref: np.ndarray = ref, at: np.ndarray = at) -> Iterator[pd.DataFrame]:
            member = np.eye(len(labels))[at]
            for pdf in batches:
                x = pdf[columns].to_numpy(float)
                for i in range(0, len(x), 500):
                    y = x[i : i + 500]
                    d = np.sqrt(((y[:, None] - ref[None]) ** 2).sum(axis=2))
                    pdf.iloc[i : i + 500, [pdf.columns.get_loc(c) for c in names]] += d @ member
                yield pdf

        out = out.mapInPandas(add, spark_schema)
    score = F.lit(None).cast("double")
    for i, label in enumerate(labels):
        own = F.col(names[i]) / float(max(1, sizes[label] - 1))
        others = [F.col(names[j]) / float(sizes[other]) for j, other in enumerate(labels) if j != i]
        near = F.least(*others) if len(others) > 1 else (others[0] if others else F.lit(None).cast("double"))
        value = F.lit(0.0) if sizes[label] == 1 else F.coalesce(F.try_divide(near - own, F.greatest(near, own)), F.lit(0.0))
        score = F.when(F.col(cluster) == label, value).otherwise(score)
    return out.select(*[f.name for f in kinds], score.alias("silhouette"))


def search(df: DataFrame, columns: list[str], ks: list[int], **settings) -> dict[int, tuple[float, float, np.ndarray]]:
    """k -> (inertia, mean exact silhouette, centres) of the best restart of each k."""
    points = cut_lineage(df.select(*columns).dropna())
    found = {}
    for k, (inertia, centres) in fit_grid(points, columns, ks, **settings).items():
        scored = silhouette(assign(points, columns, centres), columns, "cluster_id")
        found[k] = (inertia, float(scored.agg(F.avg("silhouette")).first()[0]), centres)
    return found


def best_k(found: dict[int, tuple[float, float, np.ndarray]], digits: int = 9) -> int | None:
    """The k of the largest silhouette, the least on ties; None if nothing was fitted."""
    return min(found, key=lambda k: (-round(found[k][1], digits), k), default=None)
