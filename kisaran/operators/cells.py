"""Monthly cells of a series: provenance, behaviour, gates, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kisaran.functions.scalars import scalar_struct
from kisaran.operators import kmeans
from kisaran.session import cut_lineage

SERIES = ["commodity", "region"]
CELL = [*SERIES, "period_month"]


def stale_runs(daily: DataFrame, min_run: int = 7) -> DataFrame:
    """Real readings with the length of their run of equal successive prices and
    ``is_stale``; runs go on over the ends of months."""
    order = Window.partitionBy(*SERIES).orderBy("obs_date")
    new = F.when(F.col("price") == F.lag("price").over(order), 0).otherwise(1)
    runs = daily.where("not is_imputed and price is not null").withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    size = F.count(F.lit(1)).over(Window.partitionBy(*SERIES, "_run"))
    return runs.select(*SERIES, "obs_date", "price", size.alias("run_length"), (size >= min_run).alias("is_stale"))


def monthly_cells(daily: DataFrame, min_run: int = 7) -> DataFrame:
    """One row per series and month: real_obs, distinct_real, n_days, stale_fraction,
    imputed_fraction, volatility, cum_change.

    ``daily``: commodity, region, obs_date, price, is_imputed (price not NULL).
    Volatility is the sample deviation of log steps over the root of their days,
    within the month; it and the change need three real readings.
    """
    month = F.trunc("obs_date", "MM").alias("period_month")
    real = stale_runs(daily, min_run).select("*", month)
    order = Window.partitionBy(*CELL).orderBy("obs_date")
    gap = F.greatest(F.datediff("obs_date", F.lag("obs_date").over(order)), F.lit(1))
    step = (F.log("price") - F.log(F.lag("price").over(order))) / F.sqrt(gap)
    behaviour = (
        real.withColumn("_step", step).groupBy(*CELL).agg(
            F.count(F.lit(1)).alias("real_obs"), F.countDistinct("price").alias("distinct_real"), F.avg(F.col("is_stale").cast("double")).alias("stale"),
            F.stddev_samp("_step").alias("vol"), F.min_by("price", "obs_date").alias("first"), F.max_by("price", "obs_date").alias("last"),
        )
    )
    whole = daily.select("*", month).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_days"), F.avg(F.col("is_imputed").cast("double")).alias("imputed_fraction"))
    enough = F.col("real_obs") >= 3
    return whole.join(behaviour, CELL, "left").select(
        *CELL, F.coalesce("real_obs", F.lit(0)).cast("bigint").alias("real_obs"), F.coalesce("distinct_real", F.lit(0)).cast("bigint").alias("distinct_real"), "n_days",
        F.coalesce("stale", F.lit(1.0)).alias("stale_fraction"), "imputed_fraction",
        F.when(enough, F.col("vol")).alias("volatility"), F.when(enough, F.col("last") / F.col("first") - 1).alias("cum_change"),
    )


def gate(cells: DataFrame, min_real: int = 15, min_distinct: int = 3, max_stale: float = 0.5, max_imputed: float | None = None) -> DataFrame:
    """``quality_reason``: the first gate a cell fails, else NULL."""
    reason = (
        F.when(F.col("real_obs") < min_real, "insufficient_real_observations")
        .when(F.col("distinct_real") < min_distinct, "insufficient_distinct_values")
        .when(F.col("stale_fraction") >= max_stale, "stale_dominated")
    )
    if max_imputed is not None:
        reason = reason.when(F.col("imputed_fraction") > max_imputed, "imputation_dominated")
    return cells.withColumn("quality_reason", reason.when(F.col("volatility").isNull() | F.col("cum_change").isNull(), "features_uncomputable"))


def standardise(df: DataFrame, columns: list[str], by: list[str] | None = None, sample: bool = False) -> DataFrame:
    """``<c>_std``: (c - mean) / deviation, 0 where there is no spread.

    Over the whole table the moments come back as a scalar; ``by`` standardises
    within groups.
    """
    sd = F.stddev_samp if sample else F.stddev_pop
    moments = [f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), sd(c).alias(f"_s_{c}"))]
    stats = df.groupBy(*by).agg(*moments) if by else df.agg(*moments)
    if by:
        joined = df.join(stats, by)
    else:
        joined = df.withColumn("_w", scalar_struct(stats)).select("*", "_w.*").drop("_w")
    scaled = {f"{c}_std": F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0))) for c in columns}
    return joined.withColumns(scaled).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def zone_map(centroids: DataFrame) -> DataFrame:
    """Zones of the clusters by severity: half the z-score of volatility, half that of
    the rise (falls count 0); least hijau, most merah, the others kuning.

    ``centroids``: cluster_id, volatility, cum_change; there are k of them.
    """
    rise = centroids.withColumn("_rise", F.greatest(F.col("cum_change"), F.lit(0.0)))
    whole = Window.partitionBy()
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(whole), F.stddev_pop(c).over(whole)), F.lit(0.0))
    rated = rise.withColumn("severity", 0.5 * z("volatility") + 0.5 * z("_rise")).drop("_rise")
    rank = F.row_number().over(Window.partitionBy().orderBy("severity", "cluster_id"))
    return rated.withColumns({"_r": rank, "_k": F.count(F.lit(1)).over(whole)}).withColumn(
        "zone", F.when(F.col("_r") == F.col("_k"), F.when(F.col("_k") == 1, "hijau").otherwise("merah")).when(F.col("_r") == 1, "hijau").otherwise("kuning")
    ).drop("_r", "_k")


def zone_stability(cells: DataFrame) -> DataFrame:
    """One row: consecutive zoned cells of a series, and the share whose zone differs."""
    before = F.lag("zone").over(Window.partitionBy(*SERIES).orderBy("period_month"))
    pairs = cells.where("zone is not null").withColumn("_b", before).where("_b is not null")
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col("zone") != F.col("_b")).cast("double")).alias("flip_rate"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


FEATURES = ["volatility", "cum_change"]


def fit_zones(gated: DataFrame, ks: tuple[int, ...] = tuple(range(2, 9)), min_cells: int = 30, **settings) -> tuple[DataFrame, DataFrame]:
    """(cells, clusters): a whole clustering run over gated monthly cells.

    Both features are standardised, the k of the largest silhouette is taken and its
    clusters are given zones by their centres on the first scale.  Cells that failed a
    gate come back without cluster, zone and silhouette.  Below ``min_cells`` cells, or
    with a single distinct cell, nothing is fitted: the cells get the reason
    ``too_few_cells`` and there are no clusters.
    """
    cells = cut_lineage(standardise_good(gated))
    good, std = cells.where("quality_reason is null"), [f"{c}_std" for c in FEATURES]
    found = kmeans.search(good, std, list(ks), **settings) if good.limit(min_cells).count() >= min_cells else {}
    k = kmeans.best_k(found)
    keep = [c for c in gated.columns if c != "quality_reason"]
    nothing = {"cluster_id": F.lit(None).cast("int"), "zone": F.lit(None).cast("string"), "silhouette": F.lit(None).cast("double")}
    if k is None:
        none = cells.withColumns(nothing).withColumn("quality_reason", F.coalesce("quality_reason", F.lit("too_few_cells")))
        shape = none.where("false").groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in FEATURES], F.count(F.lit(1)).alias("n_cells"))
        return none.select(*keep, "quality_reason", *nothing), shape.select("cluster_id", "n_cells", *FEATURES, F.lit(None).cast("double").alias("severity"), F.lit(None).cast("string").alias("zone"))
    scored = cut_lineage(kmeans.silhouette(kmeans.assign(good, std, found[k][2]), std, "cluster_id"))
    clusters = zone_map(scored.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_cells"), *[F.avg(c).alias(c) for c in FEATURES]))
    zoned = scored.join(F.broadcast(clusters.select("cluster_id", "zone")), "cluster_id")  # k rows
    rest = cells.where("quality_reason is not null").withColumns(nothing)
    out = [*keep, "quality_reason", *nothing]
    return zoned.select(*out).unionByName(rest.select(*out)), clusters.select("cluster_id", "n_cells", *FEATURES, "severity", "zone")


def standardise_good(gated: DataFrame) -> DataFrame:
    """``gated`` with the features standardised over the cells that passed the gates
    (NULL in the others)."""
    passed = F.col("quality_reason").isNull()
    marked = gated.withColumns({f"_{c}": F.when(passed, F.col(c)) for c in FEATURES})
    scaled = standardise(marked, [f"_{c}" for c in FEATURES])
    return scaled.withColumnsRenamed({f"_{c}_std": f"{c}_std" for c in FEATURES}).drop(*[f"_{c}" for c in FEATURES])
