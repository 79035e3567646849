"""The queries of the general data-processing problems (1, 4, 6 and 7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kisaran.operators.grid import regular_grid
from kisaran.operators.spikes import DRIFT, PRICE, SPREAD, flag_readings
from kisaran.operators.trailing import trailing_totals
from kisaran.operators.units import to_common_units
from kisaran.session import table

SERIES = ["commodity", "region"]
REAL = "not is_imputed and price_median > 0"


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Rows with a spike, stuck or impossible reading, over the three tables."""
    prices = table(spark, base, "price_observations").where("commodity_slug is not null and unit_factor is not null")
    parts = [
        flag_readings(df, m).select(F.lit(m.name).alias("field"), "row_id")
        for df, m in ((prices, PRICE), (table(spark, base, "source_offsets"), DRIFT), (table(spark, base, "price_daily_unified"), SPREAD))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_reasons(spark: SparkSession, base: str) -> DataFrame:
    """How many price readings each source has of each kind of fault."""
    prices = table(spark, base, "price_observations").where("commodity_slug is not null and unit_factor is not null")
    hit = flag_readings(prices, PRICE).groupBy(F.col("row_id").alias("obs_id")).agg(F.min("reason").alias("reason"))
    return prices.select("obs_id", "source").join(hit, "obs_id").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def _grid(spark: SparkSession, base: str) -> DataFrame:
    return regular_grid(
        table(spark, base, "price_daily_unified"), SERIES, "obs_date", "price_median", real=F.expr(REAL), version=["updated_at", "point_id"]
    )


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Days between a series' first and last real day that have no real row."""
    return _grid(spark, base).where("readings = 0").select(*SERIES, F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"))


def p4_grid(spark: SparkSession, base: str) -> DataFrame:
    """The whole regular series: one row per series and day."""
    return _grid(spark, base).select(*SERIES, "obs_date", "price_median", "is_imputed", "imputation_method")


def _real_prices(spark: SparkSession, base: str) -> DataFrame:
    version = F.struct("updated_at", "point_id")
    return (
        table(spark, base, "price_daily_unified").where(REAL).where("obs_date is not null")
        .groupBy(*SERIES, "obs_date").agg(F.max_by("price_median", version).alias("price_median"))
    )


def _fused(spark: SparkSession, base: str) -> DataFrame:
    version = F.struct("computed_at", "input_id")
    both = F.max_by(F.struct("demand_z52", "pct_change_7d"), version)
    rows = table(spark, base, "fusion_inputs").where("obs_date is not null").groupBy(*SERIES, "obs_date").agg(both.alias("_x"))
    return rows.select(*SERIES, "obs_date", "_x.demand_z52", "_x.pct_change_7d")


def _price_totals(spark: SparkSession, base: str) -> DataFrame:
    return trailing_totals(_real_prices(spark, base), SERIES, "obs_date", {"price_median": [7, 30]})


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Days whose trailing totals pass the thresholds of the three measures."""
    price = _price_totals(spark, base).where(
        "price_median_total_7 * price_median_days_30 * 100 > price_median_total_30 * price_median_days_7 * 110"
    )
    fused = trailing_totals(_fused(spark, base), SERIES, "obs_date", {"demand_z52": [7], "pct_change_7d": [30]}).select(
        *SERIES, "obs_date",
        F.explode(F.array_compact(F.array(F.expr("if(demand_z52_total_7 > 12, 'demand_z52', null)"), F.expr("if(pct_change_7d_total_30 > 1.8, 'pct_change_7d', null)")))).alias("measure"),
    )
    found = price.select(F.lit("price_median").alias("measure"), *SERIES, "obs_date").unionByName(fused)
    return found.select("measure", *SERIES, F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"))


def p6_totals(spark: SparkSession, base: str) -> DataFrame:
    """Trailing totals, days and averages over 7 and 30 days of all three measures,
    for every series and day of both tables."""
    fused = trailing_totals(_fused(spark, base), SERIES, "obs_date", {"demand_z52": [7, 30], "pct_change_7d": [7, 30]})

    def of(name: str) -> Column:
        total = lambda w: F.col(f"{name}_total_{w}").cast("double")
        days = lambda w: F.col(f"{name}_days_{w}").cast("bigint")
        mean = lambda w: F.round(F.try_divide(total(w), days(w)), 9)  # noqa: E731 (no tie at 9 digits)
        return F.struct(F.lit(name).alias("measure"), *[c for w in (7, 30) for c in (F.round(total(w), 6).alias(f"total_{w}d"), days(w).alias(f"days_{w}d"), mean(w).alias(f"mean_{w}d"))])

    price = _price_totals(spark, base).select(*SERIES, "obs_date", of("price_median").alias("_m"))
    both = fused.select(*SERIES, "obs_date", F.explode(F.array(of("demand_z52"), of("pct_change_7d"))).alias("_m"))
    return price.unionByName(both).select(*SERIES, "obs_date", "_m.*")


def _units(spark: SparkSession, base: str) -> DataFrame:
    return to_common_units(*(table(spark, base, t) for t in ("price_observations", "commodities", "unit_conversions")))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Prices without a unit factor, brought to rupiah per canonical unit."""
    return _units(spark, base).where("price_canonical is not null").select("obs_id", "canonical_unit", "price_canonical")


def p7_units(spark: SparkSession, base: str) -> DataFrame:
    """The unit each such price was read in, how well it fits and whether another reading fits as well."""
    return _units(spark, base).groupBy("canonical_unit", "written_unit", "non_unique").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("price_canonical").alias("n_converted"), F.round(F.max("log_residual"), 4).alias("worst_residual")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_reasons, p4_found, p4_grid, p6_found, p6_totals, p7_found, p7_units)
}

_SPINE = """
real_rows AS (
  SELECT commodity, region, obs_date, arg_max(price_median, row(updated_at, point_id)) AS v
  FROM price_daily_unified WHERE NOT is_imputed AND price_median > 0 GROUP BY ALL),
spans AS (SELECT commodity, region, min(obs_date) AS a, max(obs_date) AS b FROM real_rows GROUP BY ALL),
spine AS (SELECT commodity, region, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS obs_date FROM spans),
days AS (SELECT s.commodity, s.region, s.obs_date, r.v FROM spine s LEFT JOIN real_rows r USING (commodity, region, obs_date))"""

_TRAIL = """sum({v}) OVER (PARTITION BY commodity, region ORDER BY obs_date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND CURRENT ROW)"""
_COUNT = _TRAIL.replace("sum(", "count(")

SQL: dict[str, str] = {
    "p4_found": f"WITH {_SPINE} SELECT commodity, region, strftime(obs_date, '%Y-%m-%d') AS obs_date FROM days WHERE v IS NULL",
    "p4_grid": f"""WITH {_SPINE},
held AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS h, last_value(CASE WHEN v IS NOT NULL THEN obs_date END IGNORE NULLS) OVER w AS d
  FROM days WINDOW w AS (PARTITION BY commodity, region ORDER BY obs_date ROWS UNBOUNDED PRECEDING))
SELECT commodity, region, obs_date, CAST(CASE WHEN obs_date - d <= 7 THEN h END AS DOUBLE) AS price_median, v IS NULL AS is_imputed,
  CASE WHEN v IS NOT NULL THEN NULL WHEN obs_date - d <= 7 THEN 'locf_' || (obs_date - d) || 'd' ELSE 'missing' END AS imputation_method FROM held""",
    "p6_found": f"""WITH {_SPINE},
fused AS (SELECT commodity, region, obs_date, arg_max(row(demand_z52, pct_change_7d), row(computed_at, input_id)) AS p FROM fusion_inputs GROUP BY ALL),
fspans AS (SELECT commodity, region, min(obs_date) AS a, max(obs_date) AS b FROM fused GROUP BY ALL),
fspine AS (SELECT commodity, region, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS obs_date FROM fspans),
fdays AS (SELECT s.*, f.p[1] AS dz, f.p[2] AS pc FROM fspine s LEFT JOIN fused f USING (commodity, region, obs_date)),
t AS (SELECT *, {_TRAIL.format(v="v", n=6)} AS s7, {_COUNT.format(v="v", n=6)} AS n7, {_TRAIL.format(v="v", n=29)} AS s30, {_COUNT.format(v="v", n=29)} AS n30 FROM days),
u AS (SELECT *, {_TRAIL.format(v="dz", n=6)} AS z7, {_TRAIL.format(v="pc", n=29)} AS p30 FROM fdays)
SELECT 'price_median' AS measure, commodity, region, strftime(obs_date, '%Y-%m-%d') AS obs_date FROM t WHERE s7 * n30 * 100 > s30 * n7 * 110
UNION ALL SELECT 'demand_z52', commodity, region, strftime(obs_date, '%Y-%m-%d') FROM u WHERE z7 > 12
UNION ALL SELECT 'pct_change_7d', commodity, region, strftime(obs_date, '%Y-%m-%d') FROM u WHERE p30 > 1.8""",
    "p6_totals": f"""WITH {_SPINE},
fused AS (SELECT commodity, region, obs_date, arg_max(row(demand_z52, pct_change_7d), row(computed_at, input_id)) AS p FROM fusion_inputs WHERE obs_date IS NOT NULL GROUP BY ALL),
fspans AS (SELECT commodity, region, min(obs_date) AS a, max(obs_date) AS b FROM fused GROUP BY ALL),
fspine AS (SELECT commodity, region, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS obs_date FROM fspans),
fdays AS (SELECT s.*, f.p[1] AS dz, f.p[2] AS pc FROM fspine s LEFT JOIN fused f USING (commodity, region, obs_date)),
m AS (SELECT 'price_median' AS measure, commodity, region, obs_date, CAST(v AS DECIMAL(38, 6)) AS x FROM days
  UNION ALL SELECT 'demand_z52', commodity, region, obs_date, CAST(dz AS DECIMAL(38, 6)) FROM fdays UNION ALL SELECT 'pct_change_7d', commodity, region, obs_date, CAST(pc AS DECIMAL(38, 6)) FROM fdays),
t AS (SELECT *, sum(x) OVER w7 AS s7, count(x) OVER w7 AS n7, sum(x) OVER w30 AS s30, count(x) OVER w30 AS n30 FROM m
  WINDOW w7 AS (PARTITION BY measure, commodity, region ORDER BY obs_date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY measure, commodity, region ORDER BY obs_date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
SELECT measure, commodity, region, obs_date, round(CAST(s7 AS DOUBLE), 6) AS total_7d, n7 AS days_7d, round(CAST(s7 AS DOUBLE) / nullif(n7, 0), 9) AS mean_7d,
  round(CAST(s30 AS DOUBLE), 6) AS total_30d, n30 AS days_30d, round(CAST(s30 AS DOUBLE) / nullif(n30, 0), 9) AS mean_30d FROM t""",
}
