"""Irregular readings onto a regular daily grid per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regular_grid(
    df: DataFrame,
    keys: list[str],
    at: str,
    value: str,
    real: Column | None = None,
    version: list[str] | None = None,
    max_gap: int = 7,
) -> DataFrame:
    """One row per source and day from its first to its last real reading.

    Columns: ``keys``, ``at``, ``value`` (double), ``is_imputed``,
    ``imputation_method`` (NULL for a real day, ``locf_Nd`` for a day filled from
    the reading N days before, ``missing`` beyond ``max_gap``) and ``readings``,
    the real readings of that day.

    ``real`` says which rows count (default: value not NULL).  Of several real
    readings on a day the last by ``version`` (columns in order of weight) stands;
    without ``version`` the largest.  NULL keys form a source of their own; rows
    without a date are dropped; an empty table gives an empty result.  Extra
    columns are ignored, whatever their names.

    Scale: readings are combined to one row per source and day before anything is
    shuffled, so a source holding a third of all rows shrinks to its days.  The
    day sequence is generated from one (first, last) row per source, and its left
    join and the carry-forward window share the partitioning by source.
    """
    counts = real if real is not None else F.col(value).isNotNull()
    order = F.struct(*[F.col(c) for c in (version or [])], F.col(value))
    picked = (
        df.where(counts & F.col(at).isNotNull())
        .groupBy(*[F.col(k).alias(k) for k in keys], F.col(at).alias("_day"))
        .agg(F.max_by(F.col(value).cast("double"), order).alias("_value"), F.count(F.lit(1)).alias("readings"))
    )
    span = picked.groupBy(*keys).agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    days = span.select(*keys, F.explode(F.sequence("_first", "_last")).alias("_day"))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys] + [F.col("d._day") == F.col("p._day")]
    joined = days.alias("d").join(picked.alias("p"), on, "left").select(
        *[F.col(f"d.{k}").alias(k) for k in keys], F.col("d._day").alias("_day"), "_value", F.coalesce("readings", F.lit(0)).alias("readings")
    )
    past = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    carried = joined.withColumn("_held", F.last("_value", True).over(past)).withColumn(
        "_since", F.datediff("_day", F.last(F.when(F.col("_value").isNotNull(), F.col("_day")), True).over(past))
    )
    filled = F.col("_since") <= max_gap
    return carried.select(
        *keys,
        F.col("_day").alias(at),
        F.when(F.col("_since") == 0, F.col("_value")).when(filled, F.col("_held")).alias(value),
        (F.col("_since") > 0).alias("is_imputed"),
        F.when(F.col("_since") == 0, F.lit(None).cast("string"))
        .when(filled, F.concat(F.lit("locf_"), F.col("_since"), F.lit("d")))
        .otherwise("missing")
        .alias("imputation_method"),
        "readings",
    )
