"""Several sources of one series onto one level, and one price a day.

A series is one (commodity, region).  Its reference source is the one with most
reporting days; every other source is multiplied by the median ratio of the
reference's price to its own over the days both report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kisaran.functions.expressions import half_up

SERIES = ["commodity", "region"]
MIN_OVERLAP = 30
MAX_GAP = 3


def latest(df: DataFrame, keys: list[str], values: list[str], version: list[str]) -> DataFrame:
    """Upsert view: per key the values of the row with the highest ``version``.

    One partial aggregation; ties beyond the version columns go to the greater
    values.  NULL keys form groups of their own.
    """
    best = F.max_by(F.struct(*values), F.struct(*version, *values)).alias("_x")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_x.{v}").alias(v) for v in values])


def reference_sources(obs: DataFrame) -> DataFrame:
    """commodity, region, reference, n_days: most days, ties to the smaller name."""
    days = obs.groupBy(*SERIES, "source").agg(F.countDistinct("obs_date").alias("n"))
    first = F.min_by(F.struct("source", "n"), F.struct(-F.col("n"), F.col("source"))).alias("_x")
    return days.groupBy(*SERIES).agg(first).select(*SERIES, F.col("_x.source").alias("reference"), F.col("_x.n").alias("n_days"))


def overlap_ratios(obs: DataFrame, refs: DataFrame) -> DataFrame:
    """commodity, region, source, obs_date, ratio on days the reference reports too.

    Rows with a price of zero or less give no ratio.  No self join: both prices
    meet in one window over (series, day), which holds a handful of sources.
    """
    named = obs.join(refs.select(*SERIES, "reference"), SERIES)
    day = Window.partitionBy(*SERIES, "obs_date")
    at_ref = F.max(F.when(F.col("source") == F.col("reference"), F.col("price"))).over(day)
    return (
        named.withColumn("_ref", at_ref)
        .where("source <> reference and price > 0 and _ref is not null")
        .select(*SERIES, "source", "reference", "obs_date", (F.col("_ref") / F.col("price")).alias("ratio"))
    )


def source_offsets(obs: DataFrame, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """One row per source of a series: factor, n_overlap, ratio_cv_pct,
    ratio_drift_pct, excluded_reason.

    The factor is the median ratio; the drift compares the medians of the last
    and the first third of the overlap.  A source with less than ``min_overlap``
    common days gets factor 1 and a reason; the reference has factor 1.
    """
    refs = reference_sources(obs)
    ratios = overlap_ratios(obs, refs)
    order = Window.partitionBy(*SERIES, "source").orderBy("obs_date")
    whole = Window.partitionBy(*SERIES, "source")
    ranked = ratios.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(whole))
    third = F.floor(F.col("_n") / 3)
    stats = ranked.groupBy(*SERIES, "source").agg(
        F.count(F.lit(1)).alias("n_overlap"),
        F.median("ratio").alias("m"),
        F.stddev_samp("ratio").alias("sd"),
        F.median(F.when(F.col("_r") <= third, F.col("ratio"))).alias("head"),
        F.median(F.when(F.col("_r") > F.col("_n") - third, F.col("ratio"))).alias("tail"),
    )
    enough = F.col("n_overlap") >= min_overlap
    every = obs.select(*SERIES, "source").distinct().join(refs, SERIES).join(stats, [*SERIES, "source"], "left")
    is_ref = F.col("source") == F.col("reference")
    return every.select(
        *SERIES, "source", "reference",
        F.when(is_ref, 1.0).when(enough, F.col("m")).otherwise(1.0).alias("factor"),
        F.when(is_ref, F.col("n_days")).otherwise(F.coalesce("n_overlap", F.lit(0))).cast("bigint").alias("n_overlap"),
        F.when(enough & (F.col("n_overlap") > 1), F.try_divide(F.col("sd"), F.col("m")) * 100).alias("ratio_cv_pct"),
        F.when(enough & (F.col("n_overlap") >= 6), (F.try_divide(F.col("tail"), F.col("head")) - 1) * 100).alias("ratio_drift_pct"),
        F.when(~is_ref & ~F.coalesce(enough, F.lit(False)), F.concat(F.lit("overlap of "), F.coalesce("n_overlap", F.lit(0)).cast("string"), F.lit(f" days is below {min_overlap}"))).alias("excluded_reason"),
    )


def rebase(obs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Prices of usable sources on the reference's level."""
    usable = offsets.where("excluded_reason is null").select(*SERIES, "source", "factor")
    return obs.join(usable, [*SERIES, "source"]).withColumn("price", F.col("price") * F.col("factor")).drop("factor")


def reconcile(rebased: DataFrame) -> DataFrame:
    """Median, least, most, number of sources and spread of each series and day."""
    day = rebased.groupBy(*SERIES, "obs_date").agg(
        F.median("price").alias("m"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.count(F.lit(1)).alias("n_sources")
    )
    spread = F.when(F.col("m") != 0, (F.col("hi") - F.col("lo")) / F.col("m") * 100)
    return day.select(*SERIES, "obs_date", half_up(F.col("m")).alias("price_median"), half_up(F.col("lo")).alias("price_min"), half_up(F.col("hi")).alias("price_max"), "n_sources", spread.alias("spread_pct"))


def dense_calendar(obs: DataFrame) -> DataFrame:
    """Every day from a series' first to its last observation, of any source."""
    span = obs.groupBy(*SERIES).agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b"))
    return span.select(*SERIES, F.explode(F.sequence("a", "b")).alias("obs_date"))


def interpolate(daily: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Fill runs of at most ``max_gap`` missing days linearly between both anchors.

    ``daily`` is dense.  Filled days get is_imputed and ``linear_Nd``; longer runs
    and open ends stay NULL.
    """
    past = Window.partitionBy(*SERIES).orderBy("obs_date").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*SERIES).orderBy("obs_date").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("price_median").isNotNull(), F.struct(F.col("obs_date").alias("d"), F.col("price_median").alias("p")))
    both = daily.withColumns({"_a": F.last(known, True).over(past), "_b": F.first(known, True).over(ahead)})
    length = F.datediff("_b.d", "_a.d") - 1
    filled = F.col("price_median").isNull() & length.between(1, max_gap)
    step = (F.col("_b.p") - F.col("_a.p")) / (length + 1)
    value = half_up(F.col("_a.p") + step * F.datediff("obs_date", "_a.d"))
    keep = [c for c in daily.columns if c not in ("price_median",)]
    return both.select(
        *keep, F.when(filled, value).otherwise(F.col("price_median")).alias("price_median"),
        F.coalesce(filled, F.lit(False)).alias("is_imputed"), F.when(filled, F.concat(F.lit("linear_"), length.cast("string"), F.lit("d"))).alias("imputation_method"),
    )


def daily_series(obs: DataFrame, min_overlap: int = MIN_OVERLAP, max_gap: int = MAX_GAP) -> DataFrame:
    """Observations to the dense reconciled series with short gaps filled.

    An empty table gives an empty result; NULL prices must be left out before.
    """
    observed = reconcile(rebase(obs, source_offsets(obs, min_overlap)))
    dense = dense_calendar(obs).join(observed, [*SERIES, "obs_date"], "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)).cast("bigint"))
    return interpolate(dense, max_gap)
