"""Reads behind boards, tables and drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["commodity", "region"]
DAY = [*SERIES, "obs_date"]

# The alert levels in the order of a board, and what each asks for.
LEVELS = ("siaga", "waspada", "tenang", "belum_dapat_dinilai")
ADVICE = {
    "siaga": "check the market and act", "waspada": "watch daily", "tenang": "no action", "belum_dapat_dinilai": "collect more readings first",
}


def newest(df: DataFrame, column: str) -> DataFrame:
    """Rows that hold the greatest value of ``column``."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def demand_scope(region: Column, scopes: Column, fallback: str) -> Column:
    """The scope whose demand a region takes: its own if it has one, else the fallback."""
    return F.when(F.array_contains(scopes, region), region).otherwise(F.lit(fallback))


def sus_score(items: list[Column]) -> Column:
    """System usability score of ten answers from 1 to 5; NULL if one is missing."""
    parts = [(q - 1) if i % 2 == 0 else (5 - q) for i, q in enumerate(items)]
    return sum(parts[1:], parts[0]) * 2.5


def long_scores(fused: DataFrame) -> DataFrame:
    """One row per series, day and method from the wide table: norm_score, is_flagged;
    a method without a score and a flag has no row."""
    pair = [F.struct(F.lit(m).alias("method"), F.col(f"norm_{m}").alias("norm_score"), F.col(f"{m}_flagged").alias("is_flagged")) for m in ("zscore", "iforest")]
    return fused.select(*DAY, F.explode(F.array(*pair)).alias("_m")).select(*DAY, "_m.*").where("norm_score is not null or is_flagged is not null")


def flag_counts(scores: DataFrame) -> DataFrame:
    """Per commodity and method: rows, flags, and flags that another method raised too.

    The other method is seen in one window over (series, day), not by a self join.
    """
    others = F.count_if(F.coalesce("is_flagged", F.lit(False))).over(Window.partitionBy(*DAY)) > 1
    mine = F.coalesce("is_flagged", F.lit(False))
    seen = scores.withColumns({"_f": mine, "_o": mine & others})
    return seen.groupBy("commodity", "method").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_f").alias("n_flagged"), F.count_if("_o").alias("n_both"))


def explain(components: str = "components") -> Column:
    """The terms of a score in words."""
    c = lambda n: F.format_string(f"{n} %.2f", F.coalesce(F.col(f"{components}.{n.lower()}"), F.lit(0.0)))
    held = F.when(F.col(f"{components}.reason").isNotNull(), F.concat(F.lit("; held back: "), F.col(f"{components}.reason"))).otherwise(F.lit(""))
    return F.concat(F.concat_ws(", ", c("A"), c("M"), c("D"), c("C")), held)


def advice(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])[level]


def bucket(level: Column) -> Column:
    """attention, calm or unjudged."""
    return F.when(level.isin("siaga", "waspada"), "attention").when(level == "tenang", "calm").otherwise("unjudged")


def detail(daily: DataFrame, days: int = 120, rows: int = 30) -> DataFrame:
    """The last ``days`` days of every series, each row with the mean of the series'
    last ``rows`` observed prices, and how far the day lies from it.

    ``daily``: commodity, region, obs_date, price_median, is_imputed.  Two windows on
    one partitioning by series; a series has one row a day.
    """
    whole = Window.partitionBy(*SERIES)
    seen = F.col("price_median").isNotNull() & ~F.col("is_imputed")
    order = Window.partitionBy(*SERIES).orderBy(F.desc("obs_date")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = daily.withColumns({"_last": F.max("obs_date").over(whole), "_r": F.when(seen, F.count_if(seen).over(order))})
    mean = F.avg(F.when(F.col("_r") <= rows, F.col("price_median"))).over(whole)
    shown = ranked.withColumn("mean_recent", mean).where(F.datediff("_last", "obs_date") < days)
    off = F.try_divide(F.col("price_median"), F.col("mean_recent")) - 1
    return shown.select(*DAY, "price_median", "is_imputed", "mean_recent", off.alias("deviation"), (F.abs(off) > 0.10).alias("is_outside"))


def flag_changes(levels: DataFrame) -> DataFrame:
    """Per weight vector: rows whose level differs from the one of the vector ``base``.

    ``levels`` has all vectors of a row side by side in an array ``levels`` of
    (variant, level), the base among them, so nothing is joined.
    """
    base = F.filter("levels", lambda x: x["variant"] == "base")[0]["level"]
    each = levels.select(base.alias("_b"), F.explode("levels").alias("v")).select("_b", "v.*")
    return each.groupBy("variant").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("level") != F.col("_b")).alias("n_changed"))


def inert_terms(terms: DataFrame, columns: list[str]) -> DataFrame:
    """term, distinct values (NULL as 0) and whether the term never varies."""
    counted = terms.agg(*[F.countDistinct(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("n_values")) for c in columns])).alias("_t")
    return counted.select(each).select("_t.*", (F.col("_t.n_values") <= 1).alias("is_inert"))
