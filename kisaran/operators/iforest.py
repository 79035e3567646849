"""Isolation forest (Liu, Ting and Zhou 2008) per series, in NumPy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["log_price", "pct_change_1d", "pct_change_7d", "rolling_std_14d", "demand_z52", "dow"]
SCHEMA = "commodity string, region string, obs_date date, raw_score double, is_flagged boolean, threshold_used double"


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    c = 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def path_sums(x: np.ndarray, trees: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """Sum over the trees of each row's path length; all trees grow level by level.

    A level splits every node at a uniform cut of a uniformly chosen feature that
    still varies in it.  Nodes are numbered through over all trees and their rows lie
    side by side, so a level is a handful of array operations; the children of the
    n-th node are the nodes 2n and 2n + 1 of the next level.  Where the sample is the
    whole series its rows are the rows to be scored.
    """
    n, d = x.shape
    limit = math.ceil(math.log2(max(2, size)))
    flat = np.ascontiguousarray(x.T, dtype=np.float32).reshape(-1)
    whole = size >= n
    everyone = np.tile(np.arange(n), trees)
    row = everyone if whole else np.argpartition(rng.random((trees, n), dtype=np.float32), size - 1, axis=1)[:, :size].reshape(-1)
    seen, at = everyone, np.repeat(np.arange(trees), n)
    count = np.full(trees, size)
    paths = average_path(np.arange(size + 1))
    out = np.zeros(n)

    def close(stay: np.ndarray, depth: int) -> None:
        """End the paths in the nodes that do not ``stay``; number the others anew."""
        nonlocal row, seen, at, count, out
        if stay.all():
            return
        go, lengths = np.repeat(stay, count), depth + paths[count]
        if whole:
            out += np.bincount(row[~go], np.repeat(lengths, np.where(stay, 0, count)), n)
        else:
            on = stay[at]
            out += np.bincount(seen[~on], lengths[at[~on]], n)
            seen, at = seen[on], (np.cumsum(stay) - 1)[at[on]]
        row, count = row[go], count[stay]

    for depth in range(limit + 1):
        close((count > 1) & (depth < limit), depth)
        if not len(count):
            break
        start = np.cumsum(count) - count
        f = rng.integers(0, d, len(count)) * n
        value = flat.take(np.repeat(f, count) + row, mode="clip")
        low, high = np.minimum.reduceat(value, start), np.maximum.reduceat(value, start)
        flat_nodes = np.flatnonzero(high <= low)  # the drawn feature does not vary here: the others in random order
        for turn in rng.random((len(flat_nodes), d)).argsort(axis=1).T * n:
            still = high[flat_nodes] <= low[flat_nodes]
            these = flat_nodes[still]
            if not len(these):
                break
            f[these], c = turn[still], count[these]
            first = np.cumsum(c) - c
            places = np.repeat(start[these] - first, c) + np.arange(c.sum())
            again = flat[np.repeat(f[these], c) + row[places]]
            value[places] = again
            low[these], high[these] = np.minimum.reduceat(again, first), np.maximum.reduceat(again, first)
        stay = high > low
        if not stay.all():
            value, f, low, high = value[np.repeat(stay, count)], f[stay], low[stay], high[stay]
            close(stay, depth)
        if not len(count):
            break
        cut = np.minimum(low + rng.random(len(count), dtype=np.float32) * (high - low), np.nextafter(high, np.float32(-np.inf)))
        if not whole:
            at = 2 * at + (flat[f[at] + seen] > cut[at])
        child = np.repeat(np.arange(0, 2 * len(count), 2, dtype=np.int32), count) + (value > np.repeat(cut, count))
        count = np.bincount(child, minlength=2 * len(count))
        if depth + 1 == limit:  # nothing is split any more
            out += np.bincount(row if whole else seen, (limit + paths[count])[child if whole else at], n)
            break
        row = row[np.argsort(child, kind="stable")]
    return out


def scores(x: np.ndarray, trees: int, sample: int, seed: int) -> np.ndarray:
    """Minus the anomaly score of each row: -1 most, near 0 least anomalous."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    total = np.zeros(len(x))
    step = min(200, max(40, 25_000 // len(x)))  # the arrays of so many trees stay in the processor's cache
    for t in range(0, trees, step):
        total += path_sums(x, min(step, trees - t), size, rng)
    return -np.exp2(-total / trees / max(float(average_path(size)), 1e-12))


def spread_series(df: DataFrame) -> DataFrame:
    """Hash partitions by series that adaptive execution does not put together by
    bytes: the work per row is far beyond its size.  Twice the usual number, as an
    exchange equal to the one before would be left out."""
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "commodity", "region")


def _series_scores(rows: pa.Table, trees: int, min_history: int, sample: int, seed: int) -> tuple[pa.Table, np.ndarray]:
    """The series in order of days, and its scores (NaN where there is none)."""
    rows = rows.sort_by("obs_date")
    x = np.column_stack([pc.cast(rows[c], pa.float64()).to_numpy() for c in FEATURES])
    full = np.isfinite(x).all(axis=1)
    raw = np.full(len(x), np.nan)
    if len(x) >= min_history and full.sum() >= min_history:
        key = f"{rows['commodity'][0].as_py()}|{rows['region'][0].as_py()}|{seed}"
        raw[full] = scores(x[full], trees, sample, xxhash.xxh32_intdigest(key))
    return rows.select(["commodity", "region", "obs_date"]), raw


def isolate(features: DataFrame, trees: int = 200, contamination: float = 0.03, min_history: int = 60, sample: int = 256, seed: int = 20260729) -> DataFrame:
    """raw_score, is_flagged and threshold_used of each reading.

    Rows with a missing feature have a NULL score; a series with fewer than
    ``min_history`` rows or complete rows has none at all.  Scores depend only on
    the series' own rows and the seed.  One reading a day bounds a series' group
    by the calendar, whatever share of the raw rows it had.
    """

    def one(rows: pa.Table) -> pa.Table:
        out, raw = _series_scores(rows, trees, min_history, sample, seed)
        judged = np.isfinite(raw)
        cut = float(np.quantile(raw[judged], contamination)) if judged.any() else np.nan
        flags = judged & (np.nan_to_num(raw) < (cut if judged.any() else -np.inf))
        return out.append_column("raw_score", pa.array(raw, from_pandas=True)).append_column("is_flagged", pa.array(flags)).append_column("threshold_used", pa.array(np.full(len(raw), cut), from_pandas=True))

    return spread_series(features).groupBy("commodity", "region").applyInArrow(one, SCHEMA)


def flag_sets(features: DataFrame, contaminations: list[float], trees: int = 200, min_history: int = 60, sample: int = 256, seed: int = 20260729) -> DataFrame:
    """The flagged readings under each contamination (column ``contamination``, as
    text): every series is scored once and cut at each of its quantiles."""

    def one(rows: pa.Table) -> pa.Table:
        out, raw = _series_scores(rows, trees, min_history, sample, seed)
        judged = np.isfinite(raw)
        met = [np.flatnonzero(judged & (np.nan_to_num(raw) < np.quantile(raw[judged], c))) for c in contaminations if judged.any()]
        names = np.repeat([str(c) for c in contaminations][: len(met)], [len(m) for m in met]).tolist()
        return out.take(np.concatenate([*met, np.zeros(0, int)]).astype(np.int64)).append_column("contamination", pa.array(names, pa.string()))

    return spread_series(features).groupBy("commodity", "region").applyInArrow(one, "commodity string, region string, obs_date date, contamination string")


__all__ = ["FEATURES", "flag_sets", "isolate", "scores"]
