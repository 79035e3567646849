"""Scores of daily prices that need no model: trailing z-score, features, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["commodity", "region"]


def by_day(*, before: int, after: int, keys: list[str] | None = None, at: str = "obs_date"):
    """Window over calendar days relative to the current one."""
    return Window.partitionBy(*(keys or SERIES)).orderBy(F.unix_date(F.col(at))).rangeBetween(before, after)


def zscore(prices: DataFrame, days: int = 45, min_obs: int = 20, min_std: float = 0.0005, flag: float = 2.5, full: float = 4.0) -> DataFrame:
    """Trailing calendar-window z-score of the log price; today is not in its window.

    Fewer than ``min_obs`` readings or a standard deviation below ``min_std`` give
    NULL scores and no flag.  ``prices`` holds one positive price a day.
    """
    w = by_day(before=-days, after=-1)
    x = F.log("price")
    stats = prices.withColumn("_x", x).withColumns({"_n": F.count("_x").over(w), "_m": F.avg("_x").over(w), "_s": F.stddev_samp("_x").over(w)})
    z = F.when((F.col("_n") >= min_obs) & (F.col("_s") >= min_std), (F.col("_x") - F.col("_m")) / F.col("_s"))
    scored = stats.withColumn("raw_score", z)
    return scored.select(
        *SERIES, "obs_date", "price", "raw_score", F.least(F.abs("raw_score") / full, F.lit(1.0)).alias("norm_score"),
        F.coalesce(F.abs("raw_score") >= flag, F.lit(False)).alias("is_flagged"), F.lit(flag).alias("threshold_used"),
    ).withColumn("norm_score", F.when(F.col("raw_score").isNotNull(), F.col("norm_score")))


def feature_matrix(prices: DataFrame, demand: DataFrame | None = None, std_rows: int = 14) -> DataFrame:
    """Features of each reading in row order: log price, change to the last and the
    seventh last reading, rolling deviation of log steps, demand as of the day (0
    where there is none), weekday from Monday = 0."""
    order = Window.partitionBy(*SERIES).orderBy("obs_date")
    step = F.log("price") - F.log(F.lag("price").over(order))
    rows = prices.withColumn("_step", step)
    roll = order.rowsBetween(1 - std_rows, 0)
    out = rows.select(
        *SERIES, "obs_date", "price", F.log("price").alias("log_price"),
        (F.col("price") / F.lag("price", 1).over(order) - 1).alias("pct_change_1d"), (F.col("price") / F.lag("price", 7).over(order) - 1).alias("pct_change_7d"),
        F.when(F.count("_step").over(roll) >= 3, F.stddev_samp("_step").over(roll)).alias("rolling_std_14d"), F.weekday("obs_date").cast("bigint").alias("dow"),
    )
    if demand is None:
        return out.withColumn("demand_z52", F.lit(0.0))
    return as_of(out, demand, "week_start", "demand_z52").withColumn("demand_z52", F.coalesce("demand_z52", F.lit(0.0)))


def as_of(left: DataFrame, right: DataFrame, at: str, value: str, keys: list[str] | None = None, on: str = "obs_date") -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row at or before each day.

    Both sides are stacked and the value carried forward in one window, so there
    is no inequality join.  A NULL value does not replace an earlier one.
    """
    keys = keys or SERIES
    marks = right.where(F.col(value).isNotNull()).groupBy(*keys, F.col(at).alias("_t")).agg(F.max(value).alias("_v"))
    left_rows = left.select(F.struct(*left.columns).alias("_row"), *keys, F.col(on).alias("_t"), F.lit(None).cast(dict(marks.dtypes)["_v"]).alias("_v"), F.lit(1).alias("_side"))
    right_rows = marks.select(F.lit(None).cast(left_rows.schema["_row"].dataType).alias("_row"), *keys, "_t", "_v", F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left_rows.unionByName(right_rows).withColumn("_held", F.last("_v", True).over(w)).where("_side = 1")
    return both.select("_row.*", F.col("_held").alias(value))


def percentile_rank(scores: DataFrame, value: Column, keys: list[str] | None = None) -> DataFrame:
    """``norm_score``: rank of ``value`` among its series' non-NULL values, ties
    averaged, divided by their count; NULL stays NULL and is not counted."""
    keys = keys or SERIES
    v = scores.withColumn("_v", value)
    order = Window.partitionBy(*keys).orderBy("_v")
    ties = Window.partitionBy(*keys, "_v")
    rank = F.rank().over(order) - F.sum(F.when(F.col("_v").isNull(), 1).otherwise(0)).over(Window.partitionBy(*keys))
    n = F.count("_v").over(Window.partitionBy(*keys))
    return v.withColumn("norm_score", F.when(F.col("_v").isNotNull(), (rank + (F.count(F.lit(1)).over(ties) - 1) / 2) / n)).drop("_v")


def weekly_z(weekly: DataFrame, value: str, at: str = "week_start", points: int = 52, keys: list[str] | None = None) -> DataFrame:
    """z-score against the ``points`` weeks before, all of which must be there;
    population deviation, NULL where it is 0."""
    w = Window.partitionBy(*(keys or SERIES)).orderBy(at).rowsBetween(-points, -1)
    s = F.stddev_pop(value).over(w)
    z = F.when((F.count(value).over(w) == points) & (s > 0), (F.col(value) - F.avg(value).over(w)) / s)
    return weekly.withColumn("z52", z)


def sustained_deviations(prices: DataFrame, days: int = 30, min_obs: int = 20, deviation: float = 0.10, at_least: int = 2) -> DataFrame:
    """Islands of consecutive readings whose deviation from the trailing mean stays
    beyond ``deviation`` on one side: start_date, end_date, n_days, peak."""
    w = by_day(before=-days, after=-1)
    mean = F.when(F.count("price").over(w) >= min_obs, F.avg("price").over(w))
    side = prices.withColumn("_dev", F.col("price") / mean - 1).withColumn("_side", F.when(F.col("_dev") > deviation, 1).when(F.col("_dev") < -deviation, -1).otherwise(0))
    order = Window.partitionBy(*SERIES).orderBy("obs_date")
    new = (F.col("_side") != F.lag("_side", 1, 0).over(order)).cast("int")
    runs = side.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).where("_side <> 0")
    return (
        runs.groupBy(*SERIES, "_run").agg(F.min("obs_date").alias("start_date"), F.max("obs_date").alias("end_date"), F.count(F.lit(1)).alias("n_days"), F.max(F.abs("_dev")).alias("peak"))
        .where(F.col("n_days") >= at_least).drop("_run")
    )
