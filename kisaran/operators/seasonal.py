"""Weekly series and their seasonal decomposition by Loess (Cleveland et al. 1990)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kisaran.operators.iforest import spread_series

SERIES = ["commodity", "region"]
SCHEMA = "commodity string, region string, period_start date, observed double, trend double, seasonal double, resid double"


def weekly(daily: DataFrame) -> DataFrame:
    """Dense weekly means; a week is labelled by its Sunday, weeks without a price
    are NULL rows."""
    sunday = F.date_add(F.date_trunc("week", "obs_date").cast("date"), 6)
    means = daily.groupBy(*SERIES, sunday.alias("period_start")).agg(F.avg("price").alias("observed"))
    span = means.groupBy(*SERIES).agg(F.min("period_start").alias("a"), F.max("period_start").alias("b"))
    weeks = span.select(*SERIES, F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("period_start"))
    return weeks.join(means, [*SERIES, "period_start"], "left")


def fill_inner(weeks: DataFrame) -> DataFrame:
    """Inner gaps of any length filled linearly by position."""
    order = Window.partitionBy(*SERIES).orderBy("period_start")
    at = weeks.withColumn("_i", F.row_number().over(order))
    known = F.when(F.col("observed").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("observed").alias("v")))
    ends = at.withColumns({"_a": F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(known, True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    return ends.select(*SERIES, "period_start", F.coalesce("observed", line).alias("observed"))


def history(weeks: DataFrame, min_weeks: int = 104) -> DataFrame:
    """n_weeks with a value and ``skip_reason`` of each series."""
    n = weeks.groupBy(*SERIES).agg(F.count("observed").alias("n_weeks"))
    return n.withColumn("skip_reason", F.when(F.col("n_weeks") < min_weeks, F.concat(F.lit("only "), F.col("n_weeks").cast("string"), F.lit(f" of {min_weeks} weeks"))))


def loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray, degree: int = 1) -> np.ndarray:
    """Local regression of y on 0..n-1 with tricube weights, evaluated at ``at``."""
    n = len(y)
    x = np.arange(n, dtype=float)
    k = min(span, n)
    dist = np.abs(at[:, None] - x[None])
    reach = np.partition(dist, k - 1, axis=1)[:, k - 1]
    if span > n:
        reach = reach + (span - n) / 2
    reach = np.maximum(reach, 1e-12) * 1.0
    w = np.clip(1 - (dist / (reach[:, None] * 1.000001)) ** 3, 0, None) ** 3 * weights[None]
    total = np.maximum(w.sum(axis=1), 1e-300)
    mean = (w * y).sum(axis=1) / total
    if degree == 0:
        return mean
    centre = (w * x).sum(axis=1) / total
    spread = (w * (x[None] - centre[:, None]) ** 2).sum(axis=1) / total
    cov = (w * (x[None] - centre[:, None]) * y).sum(axis=1) / total
    slope = np.where(spread > 1e-6 * n, cov / np.maximum(spread, 1e-300), 0.0)
    return mean + slope * (at - centre)


def _average(y: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(y, np.ones(k) / k, "valid")


def stl(y: np.ndarray, period: int = 52, seasonal: int = 13, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, remainder) with robustness weights; they sum to ``y``."""
    n = len(y)
    odd = lambda v: int(np.ceil(v)) // 2 * 2 + 1
    trend_span, low = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period)
    robust, trend, season = np.ones(n), np.zeros(n), np.zeros(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            flat = y - trend
            cycle = np.zeros(n + 2 * period)
            for p in range(period):
                part = flat[p::period]
                at = np.arange(-1, len(part) + 1, dtype=float)
                cycle[p::period][: len(at)] = loess(part, seasonal, at, robust[p::period])
            smooth = _average(_average(_average(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(smooth, low, np.arange(n, dtype=float), np.ones(len(smooth)))
            trend = loess(y - season, trend_span, np.arange(n, dtype=float), robust)
        if turn < outer:
            r = np.abs(y - trend - season)
            h = 6 * np.median(r)
            robust = np.clip(1 - (r / max(h, 1e-12)) ** 2, 0, None) ** 2
            robust = np.where(r <= 0.001 * h, 1.0, np.where(r >= 0.999 * h, 0.0, robust)) if h > 0 else np.ones(n)
    return trend, season, y - trend - season


def decompose(weeks: DataFrame, period: int = 52, seasonal: int = 13, min_weeks: int = 104, outer: int = 15) -> DataFrame:
    """Trend, seasonal and remainder of each series with enough weeks.

    A series' group is bounded by its weeks.  Series that are too short have no
    rows; see :func:`history` for why.
    """
    long = weeks.join(history(weeks, min_weeks).where("skip_reason is null").select(*SERIES), SERIES, "left_semi")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["observed"]).sort_values("period_start").reset_index(drop=True)
        t, s, r = stl(pdf["observed"].to_numpy(float), period, seasonal, outer=outer)
        return pdf[["commodity", "region", "period_start", "observed"]].assign(trend=t, seasonal=s, resid=r)

    return spread_series(fill_inner(long)).groupBy(*SERIES).applyInPandas(one, SCHEMA)


def week_profile(components: DataFrame, value: str = "seasonal", share: float = 0.9) -> DataFrame:
    """Mean of ``value`` by ISO week, and whether it reaches the ``share`` quantile."""
    means = components.groupBy(*SERIES, F.weekofyear("period_start").cast("bigint").alias("iso_week")).agg(F.avg(value).alias("mean_value"))
    cut = means.groupBy(*SERIES).agg(F.percentile("mean_value", share).alias("cutoff"))
    return means.join(cut, SERIES).withColumn("is_risky", F.col("mean_value") >= F.col("cutoff"))


def top_weeks(components: DataFrame, value: str = "seasonal", share: float = 0.1) -> DataFrame:
    """The other definition of risky weeks: the first tenth by mean, and above 0."""
    means = components.groupBy(*SERIES, F.weekofyear("period_start").cast("bigint").alias("iso_week")).agg(F.avg(value).alias("mean_value"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*SERIES))
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("mean_value"), "iso_week"))
    return means.withColumns({"_r": rank, "_n": n}).where((F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))) & (F.col("mean_value") > 0)).drop("_r", "_n")
