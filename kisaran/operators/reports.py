"""Coverage, completeness and provenance reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kisaran.functions.expressions import percent

SERIES = ["commodity", "region"]


def coverage_by_source(obs: DataFrame) -> DataFrame:
    """Rows, span and exact distinct counts per source."""
    return obs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"),
        F.countDistinct("commodity").alias("n_commodities"), F.countDistinct("region").alias("n_regions"), F.countDistinct("obs_date").alias("n_days"),
    )


def coverage_detail(obs: DataFrame) -> DataFrame:
    """Days against the inclusive span of each series and source, and what is missing."""
    span = F.datediff(F.max("obs_date"), F.min("obs_date")) + 1
    n = F.countDistinct("obs_date")
    return obs.groupBy(*SERIES, "source").agg(
        n.alias("n_days"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), span.cast("bigint").alias("span_days"),
        F.greatest(F.lit(0.0), (1 - n / span) * 100).alias("missing_pct"),
    )


def series_sources(obs: DataFrame) -> DataFrame:
    """Count and span per series and source."""
    return obs.groupBy(*SERIES, "source").agg(F.count(F.lit(1)).alias("n_rows"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"))


def weeks_covered(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*SERIES).agg(F.countDistinct(F.date_trunc("week", "obs_date")).alias("n_weeks"))


def month_source_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy(F.trunc("obs_date", "MM").alias("month"), "source").agg(F.count(F.lit(1)).alias("n_rows"))


def completeness(daily: DataFrame) -> DataFrame:
    """Days, observed, imputed and missing days of each series, and their shares."""
    seen = F.col("price_median").isNotNull()
    sums = daily.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(seen & ~F.col("is_imputed")).alias("n_real"), F.count_if(seen & F.col("is_imputed")).alias("n_imputed"),
        F.count_if(~seen).alias("n_missing"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.avg("n_sources").alias("mean_sources"),
    )
    return sums.withColumns({"completeness_pct": percent(F.col("n_real"), F.col("n_days")), "imputation_pct": percent(F.col("n_imputed"), F.col("n_days"))})


def largest_disagreements(daily: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` days on which sources differ most (a top-k report)."""
    return daily.where("n_sources > 1 and spread_pct is not null").orderBy(F.desc("spread_pct"), *SERIES, "obs_date").limit(k).select(*SERIES, "obs_date", "price_median", "n_sources", "spread_pct")


def link_summary(offsets: DataFrame) -> DataFrame:
    """One row: sources linked, excluded, weak, and the size of the residuals."""
    linked = F.col("excluded_reason").isNull() & (F.col("source") != F.col("reference"))
    return offsets.agg(
        F.count_if(linked).alias("n_linked"), F.count_if(F.col("excluded_reason").isNotNull()).alias("n_excluded"), F.count_if(linked & (F.col("ratio_cv_pct") >= 5)).alias("n_weak"),
        F.median("ratio_cv_pct").alias("median_cv_pct"), F.max("ratio_cv_pct").alias("max_cv_pct"), F.median(F.abs("ratio_drift_pct")).alias("median_drift_pct"),
        F.max(F.abs("ratio_drift_pct")).alias("max_drift_pct"),
    )


def composition_changes(daily: DataFrame, move: float = 0.05) -> DataFrame:
    """Day-to-day moves by whether the number of sources changed: counts and the share
    beyond ``move``."""
    order = Window.partitionBy(*SERIES).orderBy("obs_date")
    steps = daily.where("not is_imputed and price_median > 0").withColumns({"_p": F.lag("price_median").over(order), "_n": F.lag("n_sources").over(order)}).where("_p is not null")
    big = F.abs(F.col("price_median") / F.col("_p") - 1) > move
    return steps.groupBy((F.col("n_sources") != F.col("_n")).alias("composition_changed")).agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(big).alias("n_large"), percent(F.count_if(big), F.count(F.lit(1))).alias("large_pct"))


def recent_failures(reports: DataFrame, k: int = 50, width: int = 120) -> DataFrame:
    """The ``k`` latest batches with rejects, their ignored names cut for display."""
    names = F.left(F.coalesce(F.array_join("ignored_names", "; "), F.lit("")), F.lit(width))
    return reports.where("n_rejected > 0").orderBy(F.desc("obs_date"), F.desc("report_id")).limit(k).select("report_id", "source", "region", "obs_date", "n_rejected", names.alias("detail"))


def provenance(obs: DataFrame, daily: DataFrame) -> DataFrame:
    """Per series and day the snapshots behind it: sources and distinct snapshot ids."""
    behind = obs.groupBy(*SERIES, "obs_date").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.countDistinct("snapshot_id").alias("n_snapshots"))
    return daily.select(*SERIES, "obs_date", "price_median").join(behind, [*SERIES, "obs_date"])


def segments(daily: DataFrame) -> DataFrame:
    """Strokes of a drawn series: runs of days with a price, split where it turns from
    observed to imputed; a run of one day is a dot."""
    order = Window.partitionBy(*SERIES).orderBy("obs_date")
    shown = daily.where("price_median is not null")
    new = F.coalesce((F.datediff("obs_date", F.lag("obs_date").over(order)) != 1) | (F.col("is_imputed") != F.lag("is_imputed").over(order)), F.lit(True)).cast("int")
    runs = shown.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*SERIES, "_run", "is_imputed").agg(F.min("obs_date").alias("from_day"), F.max("obs_date").alias("to_day"), F.count(F.lit(1)).alias("n_points")).withColumn("kind", F.when(F.col("n_points") == 1, "dot").otherwise("stroke")).drop("_run")
