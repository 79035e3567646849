"""Queries over price series: linking, daily reconciliation, detectors, cells, seasons,
fusion, evaluation and reports, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kisaran.functions.expressions import fold, kappa_band, parse_price, unit_of_name
from kisaran.operators import cells, detectors, evaluate, fusion, iforest, kmeans, labels, linking, normalize, reports, seasonal
from kisaran.plans.problems import SERIES
from kisaran.session import table
from kisaran.sources import payloads, sinks
from kisaran.streaming.ingest import settled_before, settled_days

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a query; ``sql`` is put behind the CTEs it names."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


# ---- shared inputs -------------------------------------------------------

OBS = """obs AS (SELECT commodity_slug AS commodity, region, source, obs_date, x[1] AS price, x[2] AS snapshot_id FROM (
  SELECT commodity_slug, region, source, obs_date, arg_max(row(CAST(price_idr AS DOUBLE), snapshot_id), row(ingested_at, obs_id)) AS x
  FROM price_observations WHERE commodity_slug IS NOT NULL AND unit_factor IS NOT NULL AND price_idr > 0 GROUP BY ALL))"""


def obs_of(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "price_observations").where("commodity_slug is not null and unit_factor is not null and price_idr > 0")
    named = rows.select(F.col("commodity_slug").alias("commodity"), "region", "source", "obs_date", F.col("price_idr").cast("double").alias("price"), "snapshot_id", "ingested_at", "obs_id")
    return linking.latest(named, ["commodity", "region", "source", "obs_date"], ["price", "snapshot_id"], ["ingested_at", "obs_id"])


DAY = """day AS (SELECT commodity, region, obs_date, x[1] AS price_median, x[2] AS n_sources, x[3] AS spread_pct, x[4] AS is_imputed FROM (
  SELECT commodity, region, obs_date, arg_max(row(CAST(price_median AS DOUBLE), CAST(n_sources AS BIGINT), CAST(spread_pct AS DOUBLE), is_imputed), row(updated_at, point_id)) AS x
  FROM price_daily_unified GROUP BY ALL)),
price AS (SELECT commodity, region, obs_date, price_median AS price FROM day WHERE NOT is_imputed AND price_median > 0)"""


def day_of(spark: SparkSession, base: str) -> DataFrame:
    """The latest revision of each series and day."""
    rows = table(spark, base, "price_daily_unified").withColumns({"price_median": F.col("price_median").cast("double"), "n_sources": F.col("n_sources").cast("bigint"), "spread_pct": F.col("spread_pct").cast("double")})
    return linking.latest(rows, [*SERIES, "obs_date"], ["price_median", "n_sources", "spread_pct", "is_imputed"], ["updated_at", "point_id"])


def price_of(spark: SparkSession, base: str) -> DataFrame:
    return day_of(spark, base).where("not is_imputed and price_median > 0").select(*SERIES, "obs_date", F.col("price_median").alias("price"))


FUSED = """fused AS (SELECT commodity, region, obs_date, x[1] AS norm_zscore, x[2] AS norm_iforest, x[3] AS zscore_flagged, x[4] AS iforest_flagged, x[5] AS pct_change_7d,
  x[6] AS demand_z52, x[7] AS n_sources_reporting, x[8] AS n_sources_flagging, x[9] AS single_source_coverage FROM (
  SELECT commodity, region, obs_date, arg_max(row(CAST(norm_zscore AS DOUBLE), CAST(norm_iforest AS DOUBLE), zscore_flagged, iforest_flagged, CAST(pct_change_7d AS DOUBLE),
    CAST(demand_z52 AS DOUBLE), n_sources_reporting, n_sources_flagging, single_source_coverage), row(computed_at, input_id)) AS x FROM fusion_inputs GROUP BY ALL))"""
FUSION_COLUMNS = ["norm_zscore", "norm_iforest", "zscore_flagged", "iforest_flagged", "pct_change_7d", "demand_z52", "n_sources_reporting", "n_sources_flagging", "single_source_coverage"]


def fused_of(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "fusion_inputs").withColumns({c: F.col(c).cast("double") for c in ("norm_zscore", "norm_iforest", "pct_change_7d", "demand_z52")})
    return linking.latest(rows, [*SERIES, "obs_date"], FUSION_COLUMNS, ["computed_at", "input_id"])


# ---- sources and normalisation -------------------------------------------


@query("SELECT commodity, region, source, obs_date, price, snapshot_id FROM obs", OBS)
def latest_observations(spark, base):
    return obs_of(spark, base)


@query(
    """SELECT source, alias, count(DISTINCT slug) AS n_commodities, min(slug) AS first_commodity FROM (
  SELECT slug, m.key AS source, lower(trim(regexp_replace(unnest(m.value), '\\s+', ' ', 'g'))) AS alias FROM (SELECT slug, unnest(map_entries(source_aliases)) AS m FROM commodities)) GROUP BY ALL"""
)
def alias_index(spark, base):
    return normalize.alias_index(table(spark, base, "commodities")).groupBy("source", "alias").agg(F.countDistinct("commodity").alias("n_commodities"), F.min("commodity").alias("first_commodity"))


ALIAS = """alias AS (SELECT source, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS alias, slug, rank FROM (
  SELECT slug, m.key AS source, unnest(m.value) AS name, generate_subscripts(m.value, 1) - 1 AS rank FROM (SELECT slug, unnest(map_entries(source_aliases)) AS m FROM commodities)))"""


@query(
    """SELECT p.source, a.slug AS resolved, a.rank AS alias_rank, count(*) AS n_rows FROM price_observations p
LEFT JOIN alias a ON a.source = p.source AND a.alias = lower(trim(regexp_replace(p.matched_alias, '\\s+', ' ', 'g'))) GROUP BY ALL""",
    ALIAS,
)
def alias_resolution(spark, base):
    rows = table(spark, base, "price_observations").select("obs_id", "source", "matched_alias")
    return normalize.resolve(rows, normalize.alias_index(table(spark, base, "commodities")), "matched_alias").groupBy("source", "resolved", "alias_rank").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT source, alias, count(DISTINCT slug) AS n_commodities FROM alias GROUP BY ALL HAVING count(DISTINCT slug) > 1", ALIAS)
def alias_collisions(spark, base):
    return normalize.alias_collisions(normalize.alias_index(table(spark, base, "commodities")))


@query(
    """SELECT commodity, region, source, obs_date, arg_min(obs_id, row(coalesce(rank, 1073741824), obs_id)) AS obs_id FROM (
  SELECT a.slug AS commodity, p.region, p.source, p.obs_date, p.obs_id, a.rank FROM price_observations p
  JOIN alias a ON a.source = p.source AND a.alias = lower(trim(regexp_replace(p.matched_alias, '\\s+', ' ', 'g')))) GROUP BY ALL""",
    ALIAS,
)
def alias_rank_dedup(spark, base):
    rows = table(spark, base, "price_observations").select("obs_id", "source", "region", "obs_date", "matched_alias")
    known = normalize.resolve(rows, normalize.alias_index(table(spark, base, "commodities")), "matched_alias").where("resolved is not null").withColumnRenamed("resolved", "commodity")
    return normalize.best_per_day(known.select("commodity", "region", "source", "obs_date", "obs_id", "alias_rank"), ["commodity", "region", "source", "obs_date"], "obs_id").drop("alias_rank")


@query("SELECT p_partkey, round(p_retailprice, 2) AS price FROM part")
def parse_price_en(spark, base):
    return table(spark, base, "part").select("p_partkey", parse_price(F.concat(F.lit("IDR "), F.format_number(F.round("p_retailprice", 2), 2)), "en").alias("price"))


@query("SELECT p_partkey, round(p_retailprice, 2) AS price FROM part")
def parse_price_id(spark, base):
    text = F.translate(F.format_number(F.round("p_retailprice", 2), 2), ",.", ".,")
    return table(spark, base, "part").select("p_partkey", parse_price(F.concat(F.lit("Rp. "), text), "id").alias("price"))


@query(
    """SELECT unit, count(*) AS n_rows FROM (SELECT nullif(regexp_extract(matched_alias, ',\\s*([0-9]*\\s*[A-Za-z]+)\\s*$', 1), '') AS unit FROM price_observations) GROUP BY ALL"""
)
def unit_from_name(spark, base):
    return table(spark, base, "price_observations").select(unit_of_name(F.col("matched_alias")).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT lower(trim(regexp_replace(raw_unit, '\\s+', ' ', 'g'))) AS unit, canonical_unit, unit_factor::DOUBLE AS unit_factor, count(*) AS n_rows FROM price_observations GROUP BY ALL")
def unit_spellings(spark, base):
    return table(spark, base, "price_observations").groupBy(fold(F.col("raw_unit")).alias("unit"), "canonical_unit", F.col("unit_factor").cast("double").alias("unit_factor")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    """, level AS (SELECT commodity, median(price) AS m FROM obs GROUP BY 1)
SELECT o.source, CASE WHEN o.price / l.m BETWEEN 0.25 AND 4 THEN NULL ELSE 'implausible_price' END AS reason, count(*) AS n_rows FROM obs o JOIN level l USING (commodity) GROUP BY ALL""".replace(", level", ", level", 1),
    OBS,
)
def plausibility_rejects(spark, base):
    judged = normalize.reject_reasons(obs_of(spark, base), table(spark, base, "commodities"), table(spark, base, "regions"), 0.25, 4.0)
    return judged.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


SQL["plausibility_rejects"] = SQL["plausibility_rejects"].replace("\n, level", ",\nlevel")


@query("SELECT r.region, c.slug AS commodity FROM (SELECT DISTINCT region FROM obs) r, commodities c WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.region = r.region AND o.commodity = c.slug)", OBS)
def expected_missing(spark, base):
    return normalize.expected_missing(obs_of(spark, base), table(spark, base, "commodities"))


@query(
    """SELECT source, CAST(unnest(generate_series(d + INTERVAL 1 DAY, n - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS obs_date FROM (
  SELECT source, obs_date AS d, lead(obs_date) OVER (PARTITION BY source ORDER BY obs_date) AS n FROM (SELECT DISTINCT source, obs_date FROM obs)) WHERE n - d > 1""",
    OBS,
)
def missing_days(spark, base):
    return normalize.missing_days(obs_of(spark, base), ["source"], "obs_date")


@query("SELECT source, region, CAST(coalesce(sum(n_accepted), 0) AS BIGINT) AS n_accepted, CAST(coalesce(sum(n_rejected), 0) AS BIGINT) AS n_rejected, CASE WHEN coalesce(sum(n_accepted), 0) = 0 THEN 'failed' WHEN coalesce(sum(n_rejected), 0) > 0 THEN 'partial' ELSE 'success' END AS status FROM normalize_reports GROUP BY ALL")
def batch_status(spark, base):
    return normalize.batch_status(table(spark, base, "normalize_reports"), ["source", "region"], "n_accepted", "n_rejected")


@query("SELECT commodity, region, obs_date, floor(price + 0.5) AS price FROM price", DAY)
def json_unpivot(spark, base):
    """Series written as pivoted JSON grids and read back."""
    whole = F.translate(F.format_number(F.floor(F.col("price") + 0.5), 0), ",", ".")
    cell = F.struct(F.date_format("obs_date", "dd/MM/yyyy").alias("k"), whole.alias("v"))
    grid = price_of(spark, base).groupBy(*SERIES).agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    head = F.create_map(F.lit("name"), F.col("commodity"), F.lit("level"), F.lit("2"))
    bodies = grid.select("region", F.to_json(F.struct(F.array(F.map_concat(head, "m"), F.create_map(F.lit("name"), F.lit("heading"), F.lit("level"), F.lit("1"), F.lit("01/01/2024"), F.lit("-"))).alias("data"))).alias("body"))
    return payloads.json_grid(bodies, "body", ["region"]).withColumnRenamed("name", "commodity")


@query("SELECT commodity, region, max(obs_date) AS obs_date, floor(arg_max(price, obs_date) + 0.5) AS price FROM price GROUP BY ALL", DAY)
def html_prices(spark, base):
    """The last price of each series written as an HTML table and read back."""
    last = price_of(spark, base).groupBy(*SERIES).agg(F.max("obs_date").alias("obs_date"), F.max_by("price", "obs_date").alias("price"))
    shown = F.translate(F.format_number(F.floor(F.col("price") + 0.5), 0), ",", ".")
    row = F.concat(F.lit("<tr><td>1</td><td>- "), F.col("commodity"), F.lit("</td><td>kg</td><td>0</td><td class='sekarang'>Rp "), shown, F.lit("</td></tr>"))
    pages = last.withColumn("html", F.concat(F.lit("<table><tr><th>no</th></tr>"), row, F.lit("<tr><td>x</td></tr></table>")))
    return payloads.html_table(pages, "html", ["region", "obs_date"]).withColumnRenamed("name", "commodity")


@query(
    """SELECT user_id, ts, event_id, sha256(event_type) AS content_hash, coalesce(lag(event_type) OVER w = event_type, FALSE) AS is_unchanged, CASE WHEN coalesce(lag(event_type) OVER w = event_type, FALSE) THEN NULL ELSE event_type END AS body
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def snapshot_dedup(spark, base):
    rows = table(spark, base, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("body"), F.struct("ts", "event_id").alias("_at"))
    return payloads.deduplicate_snapshots(rows, ["user_id"], "_at", "body").drop("_at")


@query(
    """SELECT commodity, region, CAST(s AS DATE) AS chunk_start, least(CAST(s + INTERVAL 29 DAY AS DATE), b) AS chunk_end FROM (
  SELECT commodity, region, b, unnest(generate_series(a, b, INTERVAL 30 DAY)) AS s FROM (SELECT commodity, region, min(obs_date) AS a, max(obs_date) AS b FROM obs GROUP BY ALL))""",
    OBS,
)
def date_chunks(spark, base):
    spans = obs_of(spark, base).groupBy(*SERIES).agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b"))
    return payloads.date_chunks(spans, "a", "b", 30).select(*SERIES, "chunk_start", "chunk_end")


@query("SELECT CAST(ts AS DATE) AS obs_date, event_type, count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def settled_event_days(spark, base):
    return settled_days(table(spark, base, "events"), "ts", ["event_type"], "value").select("obs_date", "event_type", "n_rows", r6("mean_value"))


@query(
    """, firsts AS (SELECT commodity_slug AS commodity, region, source, obs_date, arg_min(CAST(price_idr AS DOUBLE), row(ingested_at, obs_id)) AS price
  FROM price_observations WHERE commodity_slug IS NOT NULL AND unit_factor IS NOT NULL AND price_idr > 0 GROUP BY ALL)
SELECT CASE WHEN f.price = o.price THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n_rows FROM obs o JOIN firsts f USING (commodity, region, source, obs_date) GROUP BY ALL""".replace(", firsts", ",\nfirsts", 1),
    OBS,
)
def upsert_changes(spark, base):
    """Observations at their first and at their latest ingestion, classified."""
    rows = table(spark, base, "price_observations").where("commodity_slug is not null and unit_factor is not null and price_idr > 0")
    keys = ["commodity", "region", "source", "obs_date"]
    old = rows.groupBy(F.col("commodity_slug").alias("commodity"), "region", "source", "obs_date").agg(F.min_by(F.col("price_idr").cast("double"), F.struct("ingested_at", "obs_id")).alias("price"))
    return sinks.classify_changes(old, obs_of(spark, base).select(*keys, "price"), keys).groupBy("change").agg(F.count(F.lit(1)).alias("n_rows"))


SQL["upsert_changes"] = SQL["upsert_changes"].replace("\n,\nfirsts", ",\nfirsts")

# ---- linking and daily series ----------------------------------------------

REFS = """refs AS (SELECT commodity, region, arg_min(source, row(-n, source)) AS reference, max(n) AS n_days FROM (
  SELECT commodity, region, source, count(DISTINCT obs_date) AS n FROM obs GROUP BY ALL) GROUP BY ALL)"""
RATIOS = """ratios AS (SELECT o.commodity, o.region, o.source, r.reference, o.obs_date, f.price / o.price AS ratio FROM obs o
  JOIN refs r USING (commodity, region) JOIN obs f ON f.commodity = o.commodity AND f.region = o.region AND f.obs_date = o.obs_date AND f.source = r.reference WHERE o.source <> r.reference)"""
OFFSETS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY commodity, region, source ORDER BY obs_date) AS rn, count(*) OVER (PARTITION BY commodity, region, source) AS n FROM ratios),
stats AS (SELECT commodity, region, source, count(*) AS n_overlap, median(ratio) AS m, stddev_samp(ratio) AS sd, median(ratio) FILTER (rn <= n // 3) AS head, median(ratio) FILTER (rn > n - n // 3) AS tail FROM ranked GROUP BY ALL),
offsets AS (SELECT e.commodity, e.region, e.source, r.reference,
  CASE WHEN e.source = r.reference THEN 1.0::DOUBLE WHEN n_overlap >= 30 THEN m ELSE 1.0::DOUBLE END AS factor,
  CASE WHEN e.source = r.reference THEN r.n_days ELSE coalesce(n_overlap, 0) END AS n_overlap,
  CASE WHEN n_overlap >= 30 THEN sd / m * 100 END AS ratio_cv_pct, CASE WHEN n_overlap >= 30 THEN (tail / head - 1) * 100 END AS ratio_drift_pct,
  CASE WHEN e.source <> r.reference AND coalesce(n_overlap, 0) < 30 THEN 'overlap of ' || coalesce(n_overlap, 0) || ' days is below 30' END AS excluded_reason
  FROM (SELECT DISTINCT commodity, region, source FROM obs) e JOIN refs r USING (commodity, region) LEFT JOIN stats s USING (commodity, region, source))"""
REBASED = """rebased AS (SELECT o.commodity, o.region, o.source, o.obs_date, o.price * f.factor AS price FROM obs o JOIN offsets f USING (commodity, region, source) WHERE f.excluded_reason IS NULL)"""
RECON = """recon AS (SELECT commodity, region, obs_date, floor(m * 100 + 0.5) / 100 AS price_median, floor(lo * 100 + 0.5) / 100 AS price_min, floor(hi * 100 + 0.5) / 100 AS price_max, n_sources, (hi - lo) / m * 100 AS spread_pct
  FROM (SELECT commodity, region, obs_date, median(price) AS m, min(price) AS lo, max(price) AS hi, count(*) AS n_sources FROM rebased GROUP BY ALL))"""
DENSE = """dense AS (SELECT commodity, region, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS obs_date FROM (SELECT commodity, region, min(obs_date) AS a, max(obs_date) AS b FROM obs GROUP BY ALL))"""
GAPS = """held AS (SELECT d.*, r.price_median, r.price_min, r.price_max, coalesce(r.n_sources, 0) AS n_sources, r.spread_pct,
    last_value(r.price_median IGNORE NULLS) OVER p AS pa, last_value(CASE WHEN r.price_median IS NOT NULL THEN d.obs_date END IGNORE NULLS) OVER p AS da,
    first_value(r.price_median IGNORE NULLS) OVER n AS pb, first_value(CASE WHEN r.price_median IS NOT NULL THEN d.obs_date END IGNORE NULLS) OVER n AS db
  FROM dense d LEFT JOIN recon r USING (commodity, region, obs_date)
  WINDOW p AS (PARTITION BY d.commodity, d.region ORDER BY d.obs_date ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY d.commodity, d.region ORDER BY d.obs_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT commodity, region, obs_date, price_min, price_max, n_sources, spread_pct,
  CASE WHEN price_median IS NULL AND db - da - 1 <= 3 THEN floor((pa + (pb - pa) / (db - da) * (obs_date - da)) * 100 + 0.5) / 100 ELSE price_median END AS price_median,
  coalesce(price_median IS NULL AND db - da - 1 <= 3, FALSE) AS is_imputed, CASE WHEN price_median IS NULL AND db - da - 1 <= 3 THEN 'linear_' || (db - da - 1) || 'd' END AS imputation_method FROM held)"""
CHAIN = [OBS, REFS, RATIOS, OFFSETS, REBASED, RECON, DENSE, GAPS]


def offsets_of(spark, base):
    return linking.source_offsets(obs_of(spark, base))


def filled_of(spark, base):
    return linking.daily_series(obs_of(spark, base))


@query("SELECT commodity, region, reference, n_days FROM refs", OBS, REFS)
def link_reference(spark, base):
    return linking.reference_sources(obs_of(spark, base))


@query("SELECT commodity, region, source, reference, obs_date, ratio FROM ratios", OBS, REFS, RATIOS)
def overlap_ratios(spark, base):
    obs = obs_of(spark, base)
    return linking.overlap_ratios(obs, linking.reference_sources(obs)).select(*SERIES, "source", "reference", "obs_date", "ratio")


@query(
    "SELECT commodity, region, source, reference, round(factor, 6) AS factor, n_overlap, round(ratio_cv_pct, 6) AS ratio_cv_pct, round(ratio_drift_pct, 6) AS ratio_drift_pct, excluded_reason FROM offsets",
    *CHAIN[:4],
)
def source_offsets(spark, base):
    return offsets_of(spark, base).select(*SERIES, "source", "reference", r6("factor"), "n_overlap", r6("ratio_cv_pct"), r6("ratio_drift_pct"), "excluded_reason")


@query("SELECT commodity, region, source, obs_date, round(price, 6) AS price FROM rebased", *CHAIN[:5])
def rebase(spark, base):
    obs = obs_of(spark, base)
    return linking.rebase(obs, linking.source_offsets(obs)).select(*SERIES, "source", "obs_date", r6("price"))


@query("SELECT commodity, region, obs_date, price_median, price_min, price_max, n_sources, round(spread_pct, 6) AS spread_pct FROM recon", *CHAIN[:6])
def reconcile_daily(spark, base):
    obs = obs_of(spark, base)
    return linking.reconcile(linking.rebase(obs, linking.source_offsets(obs))).select(*SERIES, "obs_date", "price_median", "price_min", "price_max", "n_sources", r6("spread_pct"))


@query("SELECT commodity, region, obs_date FROM dense", OBS, DENSE)
def dense_calendar(spark, base):
    return linking.dense_calendar(obs_of(spark, base))


@query("SELECT commodity, region, obs_date, price_median, n_sources, is_imputed, imputation_method FROM filled", *CHAIN)
def gap_fill(spark, base):
    return filled_of(spark, base).select(*SERIES, "obs_date", "price_median", "n_sources", "is_imputed", "imputation_method")


@query("SELECT commodity, region, obs_date, price_median, round(spread_pct, 6) AS spread_pct FROM recon WHERE spread_pct >= 100", *CHAIN[:6])
def suspicious_spread(spark, base):
    obs = obs_of(spark, base)
    return linking.reconcile(linking.rebase(obs, linking.source_offsets(obs))).where("spread_pct >= 100").select(*SERIES, "obs_date", "price_median", r6("spread_pct"))


@query(
    """SELECT commodity, region, count(*) AS n_days, count(*) FILTER (price_median IS NOT NULL AND NOT is_imputed) AS n_real, count(*) FILTER (price_median IS NOT NULL AND is_imputed) AS n_imputed,
  count(*) FILTER (price_median IS NULL) AS n_missing, min(obs_date) AS first_day, max(obs_date) AS last_day, round(avg(n_sources), 6) AS mean_sources,
  round(count(*) FILTER (price_median IS NOT NULL AND NOT is_imputed) * 100.0 / count(*), 6)::DOUBLE AS completeness_pct, round(count(*) FILTER (price_median IS NOT NULL AND is_imputed) * 100.0 / count(*), 6)::DOUBLE AS imputation_pct FROM filled GROUP BY ALL""",
    *CHAIN,
)
def completeness(spark, base):
    return reports.completeness(filled_of(spark, base)).withColumns({c: F.round(c, 6) for c in ("mean_sources", "completeness_pct", "imputation_pct")})


@query("SELECT commodity, region, obs_date, price_median, n_sources, spread_pct FROM day WHERE n_sources > 1 AND spread_pct IS NOT NULL ORDER BY spread_pct DESC, commodity, region, obs_date LIMIT 20", DAY)
def largest_disagreements(spark, base):
    return reports.largest_disagreements(day_of(spark, base))


@query(
    """SELECT count(*) FILTER (excluded_reason IS NULL AND source <> reference) AS n_linked, count(*) FILTER (excluded_reason IS NOT NULL) AS n_excluded,
  count(*) FILTER (excluded_reason IS NULL AND source <> reference AND ratio_cv_pct >= 5) AS n_weak, round(median(ratio_cv_pct), 6) AS median_cv_pct, round(max(ratio_cv_pct), 6) AS max_cv_pct,
  round(median(abs(ratio_drift_pct)), 6) AS median_drift_pct, round(max(abs(ratio_drift_pct)), 6) AS max_drift_pct FROM offsets""",
    *CHAIN[:4],
)
def link_summary(spark, base):
    return reports.link_summary(offsets_of(spark, base)).select("n_linked", "n_excluded", "n_weak", *[r6(c) for c in ("median_cv_pct", "max_cv_pct", "median_drift_pct", "max_drift_pct")])


@query(
    """SELECT n_sources <> n AS composition_changed, count(*) AS n_steps, count(*) FILTER (abs(price_median / p - 1) > 0.05) AS n_large, round(count(*) FILTER (abs(price_median / p - 1) > 0.05) * 100.0 / count(*), 6)::DOUBLE AS large_pct FROM (
  SELECT *, lag(price_median) OVER w AS p, lag(n_sources) OVER w AS n FROM day WHERE NOT is_imputed AND price_median > 0 WINDOW w AS (PARTITION BY commodity, region ORDER BY obs_date)) WHERE p IS NOT NULL GROUP BY ALL""",
    DAY,
)
def composition_changes(spark, base):
    return reports.composition_changes(day_of(spark, base)).withColumn("large_pct", F.round("large_pct", 6))


# ---- coverage and provenance ------------------------------------------------


@query("SELECT source, count(*) AS n_rows, min(obs_date) AS first_day, max(obs_date) AS last_day, count(DISTINCT commodity) AS n_commodities, count(DISTINCT region) AS n_regions, count(DISTINCT obs_date) AS n_days FROM obs GROUP BY ALL", OBS)
def coverage_by_source(spark, base):
    return reports.coverage_by_source(obs_of(spark, base))


@query(
    """SELECT commodity, region, source, count(DISTINCT obs_date) AS n_days, min(obs_date) AS first_day, max(obs_date) AS last_day, max(obs_date) - min(obs_date) + 1 AS span_days,
  round(greatest(0, (1 - count(DISTINCT obs_date) / (max(obs_date) - min(obs_date) + 1)) * 100), 6) AS missing_pct FROM obs GROUP BY ALL""",
    OBS,
)
def coverage_detail(spark, base):
    return reports.coverage_detail(obs_of(spark, base)).withColumn("missing_pct", F.round("missing_pct", 6))


@query("SELECT commodity, region, source, count(*) AS n_rows, min(obs_date) AS first_day, max(obs_date) AS last_day FROM obs GROUP BY ALL", OBS)
def series_sources(spark, base):
    return reports.series_sources(obs_of(spark, base))


@query("SELECT commodity, region, count(DISTINCT date_trunc('week', obs_date)) AS n_weeks FROM obs GROUP BY ALL", OBS)
def weeks_covered(spark, base):
    return reports.weeks_covered(obs_of(spark, base))


@query("SELECT CAST(date_trunc('month', obs_date) AS DATE) AS month, source, count(*) AS n_rows FROM obs GROUP BY ALL", OBS)
def month_source_counts(spark, base):
    return reports.month_source_counts(obs_of(spark, base))


@query(
    """SELECT commodity, region, source, obs_date, price FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '7', commodity, region, source, obs_date)), commodity, region, source, obs_date) AS rn FROM obs) WHERE rn <= 25""",
    OBS,
)
def stratified_sample(spark, base):
    return evaluate.sample_groups(obs_of(spark, base), ["source"], 25, 7, ["commodity", "region", "source", "obs_date"]).drop("snapshot_id")


@query("SELECT report_id, source, region, obs_date, n_rejected, left(coalesce(array_to_string(ignored_names, '; '), ''), 120) AS detail FROM normalize_reports WHERE n_rejected > 0 ORDER BY obs_date DESC, report_id DESC LIMIT 50")
def recent_failures(spark, base):
    return reports.recent_failures(table(spark, base, "normalize_reports"))


@query("SELECT d.commodity, d.region, d.obs_date, d.price_median, b.sources, b.n_snapshots FROM day d JOIN (SELECT commodity, region, obs_date, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT snapshot_id) AS n_snapshots FROM obs GROUP BY ALL) b USING (commodity, region, obs_date)", DAY, OBS)
def provenance(spark, base):
    return reports.provenance(obs_of(spark, base), day_of(spark, base)).withColumn("sources", F.array_join("sources", ","))


@query(
    """SELECT commodity, region, is_imputed, min(obs_date) AS from_day, max(obs_date) AS to_day, count(*) AS n_points, CASE WHEN count(*) = 1 THEN 'dot' ELSE 'stroke' END AS kind FROM (
  SELECT *, sum(new) OVER (PARTITION BY commodity, region ORDER BY obs_date) AS run FROM (
    SELECT *, CASE WHEN obs_date - lag(obs_date) OVER w = 1 AND is_imputed = lag(is_imputed) OVER w THEN 0 ELSE 1 END AS new FROM filled WHERE price_median IS NOT NULL WINDOW w AS (PARTITION BY commodity, region ORDER BY obs_date)))
GROUP BY commodity, region, is_imputed, run""",
    *CHAIN,
)
def series_segments(spark, base):
    return reports.segments(filled_of(spark, base))


@query("SELECT region, max(obs_date) AS last_day, count(*) AS n_rows FROM day WHERE obs_date < (SELECT max(obs_date) FROM day) GROUP BY ALL", DAY)
def settled_board(spark, base):
    """The settled days of each region; the newest day of all is still open."""
    return settled_before(day_of(spark, base), "obs_date").groupBy("region").agg(F.max("obs_date").alias("last_day"), F.count(F.lit(1)).alias("n_rows"))


# ---- detectors ---------------------------------------------------------------

ZSCORE = """z AS (SELECT commodity, region, obs_date, price, CASE WHEN n >= 20 AND s >= 0.0005 THEN (x - m) / s END AS raw_score FROM (
  SELECT *, ln(price) AS x, count(*) OVER w AS n, avg(ln(price)) OVER w AS m, stddev_samp(ln(price)) OVER w AS s FROM price
  WINDOW w AS (PARTITION BY commodity, region ORDER BY obs_date RANGE BETWEEN INTERVAL 45 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)))"""


def z_of(spark, base):
    return detectors.zscore(price_of(spark, base))


@query("SELECT commodity, region, obs_date, price, round(raw_score, 6) AS raw_score, round(least(abs(raw_score) / 4, CASE WHEN raw_score IS NOT NULL THEN 1 END), 6) AS norm_score, coalesce(abs(raw_score) >= 2.5, FALSE) AS is_flagged, 2.5::DOUBLE AS threshold_used FROM z", DAY, ZSCORE)
def zscore(spark, base):
    return z_of(spark, base).withColumns({"raw_score": F.round("raw_score", 6), "norm_score": F.round("norm_score", 6)})


@query("SELECT commodity, count(*) AS n_rows, count(raw_score) AS n_scored, count(*) FILTER (abs(raw_score) >= 2.5) AS n_flagged FROM z GROUP BY ALL", DAY, ZSCORE)
def zscore_flag_counts(spark, base):
    return z_of(spark, base).groupBy("commodity").agg(F.count(F.lit(1)).alias("n_rows"), F.count("raw_score").alias("n_scored"), F.count_if("is_flagged").alias("n_flagged"))


@query(
    """SELECT commodity, region, obs_date, price, prev_price, round(raw_score, 6) AS raw_score FROM (SELECT *, lag(price) OVER (PARTITION BY commodity, region ORDER BY obs_date) AS prev_price FROM z)
WHERE abs(raw_score) >= 2.5 ORDER BY abs(raw_score) DESC NULLS LAST, commodity, region, obs_date LIMIT 50""",
    DAY, ZSCORE,
)
def top_flagged(spark, base):
    from pyspark.sql import Window

    prev = F.lag("price").over(Window.partitionBy(*SERIES).orderBy("obs_date"))
    flagged = z_of(spark, base).withColumn("prev_price", prev).where("is_flagged")
    return flagged.orderBy(F.desc_nulls_last(F.abs("raw_score")), *SERIES, "obs_date").limit(50).select(*SERIES, "obs_date", "price", "prev_price", r6("raw_score"))


WEEKLY_DEMAND = """demand AS (SELECT commodity, region, CAST(date_trunc('week', obs_date) AS DATE) AS week_start, avg(demand_z52) AS demand_z52 FROM fused WHERE demand_z52 IS NOT NULL GROUP BY ALL)"""


def demand_of(spark, base):
    rows = fused_of(spark, base).where("demand_z52 is not null")
    return rows.groupBy(*SERIES, F.date_trunc("week", "obs_date").cast("date").alias("week_start")).agg(F.avg("demand_z52").alias("demand_z52"))


FEATURES = """steps AS (SELECT *, ln(price) - ln(lag(price) OVER (PARTITION BY commodity, region ORDER BY obs_date)) AS step FROM price),
feats AS (SELECT commodity, region, obs_date, price, ln(price) AS log_price, price / lag(price, 1) OVER w - 1 AS pct_change_1d, price / lag(price, 7) OVER w - 1 AS pct_change_7d,
  CASE WHEN count(step) OVER r >= 3 THEN stddev_samp(step) OVER r END AS rolling_std_14d, CAST(isodow(obs_date) - 1 AS BIGINT) AS dow FROM steps
  WINDOW w AS (PARTITION BY commodity, region ORDER BY obs_date), r AS (PARTITION BY commodity, region ORDER BY obs_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""


@query(
    """SELECT f.commodity, f.region, f.obs_date, round(log_price, 6) AS log_price, round(pct_change_1d, 6) AS pct_change_1d, round(pct_change_7d, 6) AS pct_change_7d, round(rolling_std_14d, 6) AS rolling_std_14d, dow, round(coalesce(d.demand_z52, 0), 6) AS demand_z52
FROM feats f ASOF LEFT JOIN demand d ON f.commodity = d.commodity AND f.region = d.region AND f.obs_date >= d.week_start""",
    DAY, FUSED, WEEKLY_DEMAND, FEATURES,
)
def iforest_features(spark, base):
    out = detectors.feature_matrix(price_of(spark, base), demand_of(spark, base))
    return out.select(*SERIES, "obs_date", *[r6(c) for c in ("log_price", "pct_change_1d", "pct_change_7d", "rolling_std_14d")], "dow", r6("demand_z52"))


@query("SELECT p.commodity, p.region, p.obs_date, round(d.demand_z52, 6) AS demand_z52 FROM price p ASOF LEFT JOIN demand d ON p.commodity = d.commodity AND p.region = d.region AND p.obs_date >= d.week_start", DAY, FUSED, WEEKLY_DEMAND)
def demand_asof(spark, base):
    return detectors.as_of(price_of(spark, base), demand_of(spark, base), "week_start", "demand_z52").select(*SERIES, "obs_date", r6("demand_z52"))


@query(
    """SELECT commodity, region, week_start, round(CASE WHEN n = 12 AND s > 0 THEN (demand_z52 - m) / s END, 5) AS z52 FROM (SELECT *, count(demand_z52) OVER w AS n, avg(demand_z52) OVER w AS m, stddev_pop(demand_z52) OVER w AS s FROM demand
WINDOW w AS (PARTITION BY commodity, region ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))""",
    FUSED, WEEKLY_DEMAND,
)
def weekly_demand_z(spark, base):
    """The weekly z-score with a window of 12 points (the tables hold less than 52 weeks before most days)."""
    return detectors.weekly_z(demand_of(spark, base), "demand_z52", points=12).select(*SERIES, "week_start", F.round("z52", 5).alias("z52"))


@query(
    """SELECT commodity, region, obs_date, round((rank() OVER (PARTITION BY commodity, region ORDER BY v) + (count(*) OVER (PARTITION BY commodity, region, v) - 1) / 2) / count(*) OVER (PARTITION BY commodity, region), 6) AS norm_score
FROM (SELECT *, -abs(round(raw_score, 6)) AS v FROM z) WHERE v IS NOT NULL UNION ALL SELECT commodity, region, obs_date, NULL FROM z WHERE raw_score IS NULL""",
    DAY, ZSCORE,
)
def pct_rank_norm(spark, base):
    return detectors.percentile_rank(z_of(spark, base), -F.abs(F.round("raw_score", 6))).select(*SERIES, "obs_date", r6("norm_score"))


EVENTS = """dev AS (SELECT commodity, region, obs_date, price, CASE WHEN n >= 20 THEN price / m - 1 END AS dev FROM (SELECT *, count(*) OVER w AS n, avg(price) OVER w AS m FROM price
  WINDOW w AS (PARTITION BY commodity, region ORDER BY obs_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))),
sided AS (SELECT *, CASE WHEN dev > 0.10 THEN 1 WHEN dev < -0.10 THEN -1 ELSE 0 END AS side FROM dev),
grp AS (SELECT *, sum(new) OVER (PARTITION BY commodity, region ORDER BY obs_date) AS run FROM (SELECT *, CASE WHEN side <> lag(side, 1, 0) OVER (PARTITION BY commodity, region ORDER BY obs_date) THEN 1 ELSE 0 END AS new FROM sided)),
ev AS (SELECT commodity, region, min(obs_date) AS start_date, max(obs_date) AS end_date, count(*) AS n_days, max(abs(dev)) AS peak FROM grp WHERE side <> 0 GROUP BY commodity, region, run HAVING count(*) >= 2)"""


def events_of(spark, base):
    found = detectors.sustained_deviations(price_of(spark, base))
    return found.withColumn("event_id", F.xxhash64(*SERIES, "start_date"))


@query("SELECT commodity, region, start_date, end_date, n_days, round(peak, 6) AS peak FROM ev", DAY, EVENTS)
def operational_events(spark, base):
    return events_of(spark, base).select(*SERIES, "start_date", "end_date", "n_days", r6("peak"))


@query()
def iforest_scores(spark, base):
    scored = iforest.isolate(detectors.feature_matrix(price_of(spark, base), demand_of(spark, base)))
    return detectors.percentile_rank(scored, F.col("raw_score"))


@query()
def contamination_overlap(spark, base):
    """Flag sets of three contaminations from one scoring, against the middle one."""
    flags = iforest.flag_sets(detectors.feature_matrix(price_of(spark, base), demand_of(spark, base)), [0.01, 0.03, 0.05])
    return evaluate.set_overlap(flags, "contamination", "0.03")


# ---- cells and zones ------------------------------------------------------------

CELLS = """seen AS (SELECT commodity, region, obs_date, price_median AS price, is_imputed, CAST(date_trunc('month', obs_date) AS DATE) AS period_month FROM day WHERE price_median > 0),
marked AS (SELECT *, sum(new) OVER (PARTITION BY commodity, region ORDER BY obs_date) AS run FROM (SELECT *, CASE WHEN price = lag(price) OVER (PARTITION BY commodity, region ORDER BY obs_date) THEN 0 ELSE 1 END AS new FROM seen WHERE NOT is_imputed)),
runs AS (SELECT *, count(*) OVER (PARTITION BY commodity, region, run) AS run_length FROM marked),
steps2 AS (SELECT *, (ln(price) - ln(lag(price) OVER w)) / sqrt(greatest(obs_date - lag(obs_date) OVER w, 1)) AS step FROM runs WINDOW w AS (PARTITION BY commodity, region, period_month ORDER BY obs_date)),
beh AS (SELECT commodity, region, period_month, count(*) AS real_obs, count(DISTINCT price) AS distinct_real, avg(CASE WHEN run_length >= 7 THEN 1.0 ELSE 0.0 END) AS stale, stddev_samp(step) AS vol, arg_max(price, obs_date) / arg_min(price, obs_date) - 1 AS cc FROM steps2 GROUP BY ALL),
whole AS (SELECT commodity, region, period_month, count(*) AS n_days, avg(CASE WHEN is_imputed THEN 1.0 ELSE 0.0 END) AS imputed_fraction FROM seen GROUP BY ALL),
cells AS (SELECT w.commodity, w.region, w.period_month, coalesce(real_obs, 0) AS real_obs, coalesce(distinct_real, 0) AS distinct_real, n_days, coalesce(stale, 1) AS stale_fraction, imputed_fraction,
  CASE WHEN real_obs >= 3 THEN vol END AS volatility, CASE WHEN real_obs >= 3 THEN cc END AS cum_change FROM whole w LEFT JOIN beh b USING (commodity, region, period_month)),
gated AS (SELECT *, CASE WHEN real_obs < 15 THEN 'insufficient_real_observations' WHEN distinct_real < 3 THEN 'insufficient_distinct_values' WHEN stale_fraction >= 0.5 THEN 'stale_dominated' WHEN volatility IS NULL OR cum_change IS NULL THEN 'features_uncomputable' END AS quality_reason FROM cells)"""


def seen_of(spark, base):
    return day_of(spark, base).where("price_median > 0").select(*SERIES, "obs_date", F.col("price_median").alias("price"), "is_imputed")


def gated_of(spark, base):
    return cells.gate(cells.monthly_cells(seen_of(spark, base)))


@query("SELECT commodity, region, obs_date, price, run_length, run_length >= 7 AS is_stale FROM runs", DAY, CELLS)
def stale_runs(spark, base):
    return cells.stale_runs(seen_of(spark, base))


@query(
    "SELECT commodity, region, period_month, real_obs, distinct_real, n_days, round(stale_fraction, 6) AS stale_fraction, round(imputed_fraction, 6) AS imputed_fraction, round(volatility, 6) AS volatility, round(cum_change, 6) AS cum_change, quality_reason FROM gated",
    DAY, CELLS,
)
def monthly_cells(spark, base):
    return gated_of(spark, base).select(*SERIES, "period_month", "real_obs", "distinct_real", "n_days", *[r6(c) for c in ("stale_fraction", "imputed_fraction", "volatility", "cum_change")], "quality_reason")


@query("SELECT quality_reason, count(*) AS n_cells FROM gated GROUP BY ALL", DAY, CELLS)
def gate_reasons(spark, base):
    return gated_of(spark, base).groupBy("quality_reason").agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    """SELECT commodity, region, period_month, round(CASE WHEN s > 0 THEN (volatility - m) / s ELSE 0 END, 6) AS volatility_std FROM (SELECT *, avg(volatility) OVER w AS m, stddev_samp(volatility) OVER w AS s FROM gated WHERE quality_reason IS NULL WINDOW w AS (PARTITION BY commodity))""",
    DAY, CELLS,
)
def within_commodity_scale(spark, base):
    good = gated_of(spark, base).where("quality_reason is null")
    return cells.standardise(good, ["volatility"], by=["commodity"], sample=True).select(*SERIES, "period_month", r6("volatility_std"))


CENTROIDS = """centroids AS (SELECT cluster_id, avg(CAST(feat_volatility AS DOUBLE)) AS volatility, avg(CAST(feat_cum_change AS DOUBLE)) AS cum_change FROM cluster_assignments
  WHERE run_id = (SELECT max(run_id) FROM cluster_assignments) AND cluster_id IS NOT NULL GROUP BY ALL)"""


@query(
    """SELECT cluster_id, round(volatility, 6) AS volatility, round(cum_change, 6) AS cum_change, round(severity, 6) AS severity, CASE WHEN rn = k THEN 'merah' WHEN rn = 1 THEN 'hijau' ELSE 'kuning' END AS zone FROM (
  SELECT *, row_number() OVER (ORDER BY severity, cluster_id) AS rn, count(*) OVER () AS k FROM (
    SELECT *, 0.5 * coalesce((volatility - avg(volatility) OVER ()) / nullif(stddev_pop(volatility) OVER (), 0), 0) + 0.5 * coalesce((rise - avg(rise) OVER ()) / nullif(stddev_pop(rise) OVER (), 0), 0) AS severity
    FROM (SELECT *, greatest(cum_change, 0) AS rise FROM centroids)))""",
    CENTROIDS,
)
def zone_assign(spark, base):
    rows = table(spark, base, "cluster_assignments")
    newest = rows.where(F.col("run_id") == rows.agg(F.max("run_id")).scalar()).where("cluster_id is not null")
    centres = newest.groupBy("cluster_id").agg(F.avg(F.col("feat_volatility").cast("double")).alias("volatility"), F.avg(F.col("feat_cum_change").cast("double")).alias("cum_change"))
    return cells.zone_map(centres).select("cluster_id", r6("volatility"), r6("cum_change"), r6("severity"), "zone")


@query("SELECT count(*) AS n_pairs, round(avg(CASE WHEN zone <> b THEN 1.0 ELSE 0.0 END), 6) AS flip_rate FROM (SELECT zone, lag(zone) OVER (PARTITION BY commodity, region ORDER BY period_month) AS b FROM cluster_assignments WHERE zone IS NOT NULL) WHERE b IS NOT NULL")
def zone_stability(spark, base):
    return cells.zone_stability(table(spark, base, "cluster_assignments")).select("n_pairs", r6("flip_rate"))


@query("SELECT commodity, count(*) FILTER (zone = 'hijau') AS hijau, count(*) FILTER (zone = 'kuning') AS kuning, count(*) FILTER (zone = 'merah') AS merah, round(avg(CAST(feat_volatility AS DOUBLE)) FILTER (zone IS NOT NULL), 6) AS mean_volatility FROM cluster_assignments GROUP BY ALL")
def zone_counts(spark, base):
    zone = lambda z: F.count_if(F.col("zone") == z).alias(z)
    return table(spark, base, "cluster_assignments").groupBy("commodity").agg(zone("hijau"), zone("kuning"), zone("merah"), F.round(F.avg(F.when(F.col("zone").isNotNull(), F.col("feat_volatility").cast("double"))), 6).alias("mean_volatility"))


@query("SELECT zone, commodity, n_cells FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n_cells DESC, commodity) AS rn FROM (SELECT zone, commodity, count(*) AS n_cells FROM cluster_assignments WHERE zone IS NOT NULL GROUP BY ALL)) WHERE rn <= 4")
def zone_composition(spark, base):
    counts = table(spark, base, "cluster_assignments").where("zone is not null").groupBy("zone", "commodity").agg(F.count(F.lit(1)).alias("n_cells"))
    return cells.top_k(counts, ["zone"], [F.desc("n_cells"), F.col("commodity")], 4)


@query(
    """SELECT i.cell_id, i.zone, round(CASE WHEN max(i.n) = 1 THEN 0 ELSE coalesce((min(m) FILTER (o <> i.zone) - min(m) FILTER (o = i.zone)) / nullif(greatest(min(m) FILTER (o <> i.zone), min(m) FILTER (o = i.zone)), 0), 0) END, 6) AS silhouette FROM (
  SELECT a.cell_id, a.zone, a.n, b.zone AS o, sum(sqrt((a.v - b.v) * (a.v - b.v) + (a.c - b.c) * (a.c - b.c))) / greatest(count(*) - CASE WHEN a.zone = b.zone THEN 1 ELSE 0 END, 1) AS m FROM pts a, pts b GROUP BY a.cell_id, a.zone, a.n, b.zone) i GROUP BY i.cell_id, i.zone""",
    """pts AS (SELECT cell_id, zone, CAST(feat_volatility AS DOUBLE) * 10 AS v, CAST(feat_cum_change AS DOUBLE) AS c, count(*) OVER (PARTITION BY zone) AS n FROM cluster_assignments WHERE zone IS NOT NULL AND feat_volatility IS NOT NULL AND feat_cum_change IS NOT NULL)""",
)
def exact_silhouette(spark, base):
    rows = table(spark, base, "cluster_assignments").where("zone is not null and feat_volatility is not null and feat_cum_change is not null")
    points = rows.select("cell_id", "zone", (F.col("feat_volatility").cast("double") * 10).alias("v"), F.col("feat_cum_change").cast("double").alias("c"))
    return kmeans.silhouette(points, ["v", "c"], "zone").select("cell_id", "zone", r6("silhouette"))


@query()
def kmeans_search(spark, base):
    """k, inertia and mean silhouette of the best restart for k = 2 to 8, which k is
    taken, and by how much it leads the runner-up."""
    good = cells.standardise(gated_of(spark, base).where("quality_reason is null"), cells.FEATURES)
    found = kmeans.search(good, ["volatility_std", "cum_change_std"], list(range(2, 9)), restarts=50, passes=300)
    best = kmeans.best_k(found)
    second = max((s for k, (_, s, _) in found.items() if k != best), default=None)
    rows = [(k, round(i, 6), round(s, 6), k == best, round(s - second, 6) if k == best and second is not None else None) for k, (i, s, _) in sorted(found.items())]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, is_best boolean, margin double")


@query()
def cluster_cells(spark, base):
    """Monthly cells with cluster, zone and silhouette of a whole run; gated cells without."""
    return cells.fit_zones(gated_of(spark, base))[0]


@query()
def cluster_zones(spark, base):
    """The clusters of that run: size, centre on the first scale, severity, zone."""
    return cells.fit_zones(gated_of(spark, base))[1]


# ---- seasons ---------------------------------------------------------------------

WEEKS = """wk AS (SELECT commodity, region, CAST(date_trunc('week', obs_date) AS DATE) + 6 AS period_start, avg(price) AS observed FROM price GROUP BY ALL),
weeks AS (SELECT d.*, w.observed FROM (SELECT commodity, region, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS period_start FROM (SELECT commodity, region, min(period_start) AS a, max(period_start) AS b FROM wk GROUP BY ALL)) d LEFT JOIN wk w USING (commodity, region, period_start)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY commodity, region ORDER BY period_start) AS i FROM weeks),
inner_ AS (SELECT commodity, region, period_start, coalesce(observed, va + (vb - va) * (i - ia) / (ib - ia)) AS observed FROM (
  SELECT *, last_value(observed IGNORE NULLS) OVER p AS va, last_value(CASE WHEN observed IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ia, first_value(observed IGNORE NULLS) OVER n AS vb, first_value(CASE WHEN observed IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ib
  FROM numbered WINDOW p AS (PARTITION BY commodity, region ORDER BY i ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY commodity, region ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
prof AS (SELECT commodity, region, CAST(weekofyear(period_start) AS BIGINT) AS iso_week, avg(observed) AS mean_value FROM inner_ GROUP BY ALL)"""


def weeks_of(spark, base):
    return seasonal.weekly(price_of(spark, base))


@query("SELECT commodity, region, period_start, round(observed, 6) AS observed FROM weeks", DAY, WEEKS)
def weekly_resample(spark, base):
    return weeks_of(spark, base).select(*SERIES, "period_start", r6("observed"))


@query("SELECT commodity, region, period_start, round(observed, 6) AS observed FROM inner_", DAY, WEEKS)
def weekly_interpolated(spark, base):
    return seasonal.fill_inner(weeks_of(spark, base)).select(*SERIES, "period_start", r6("observed"))


@query("SELECT commodity, region, count(observed) AS n_weeks, CASE WHEN count(observed) < 104 THEN 'only ' || count(observed) || ' of 104 weeks' END AS skip_reason FROM weeks GROUP BY ALL", DAY, WEEKS)
def season_history(spark, base):
    return seasonal.history(weeks_of(spark, base))


@query("SELECT p.commodity, p.region, iso_week, round(mean_value, 6) AS mean_value, mean_value >= cutoff AS is_risky FROM prof p JOIN (SELECT commodity, region, quantile_cont(mean_value, 0.9) AS cutoff FROM prof GROUP BY ALL) c USING (commodity, region)", DAY, WEEKS)
def iso_week_profile(spark, base):
    return seasonal.week_profile(seasonal.fill_inner(weeks_of(spark, base)), "observed").select(*SERIES, "iso_week", r6("mean_value"), "is_risky")


@query("SELECT commodity, region, iso_week, round(mean_value, 6) AS mean_value FROM (SELECT *, row_number() OVER (PARTITION BY commodity, region ORDER BY mean_value DESC, iso_week) AS rn, count(*) OVER (PARTITION BY commodity, region) AS n FROM prof) WHERE rn <= greatest(1, ceil(n * 0.1)) AND mean_value > 0", DAY, WEEKS)
def top_weeks(spark, base):
    return seasonal.top_weeks(seasonal.fill_inner(weeks_of(spark, base)), "observed").select(*SERIES, "iso_week", r6("mean_value"))


@query()
def stl_components(spark, base):
    """Decomposition with a season of 13 weeks: the tables hold less than two years."""
    return seasonal.decompose(weeks_of(spark, base), period=13, min_weeks=27)


@query()
def risky_weeks(spark, base):
    """ISO weeks whose mean seasonal component reaches the 90 % quantile of the series."""
    return seasonal.week_profile(seasonal.decompose(weeks_of(spark, base), period=13, min_weeks=27))


# ---- fusion ------------------------------------------------------------------------

FUSE = """terms AS (SELECT *, CASE WHEN coalesce(norm_zscore, norm_iforest) IS NOT NULL THEN least(greatest(norm_zscore, norm_iforest) * CASE WHEN coalesce(zscore_flagged AND iforest_flagged, FALSE) THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE) END AS a,
  CASE WHEN pct_change_7d IS NULL THEN 0.0::DOUBLE ELSE least(abs(pct_change_7d) / 0.15::DOUBLE, 1.0::DOUBLE) END AS m, CASE WHEN demand_z52 IS NULL THEN 0.0::DOUBLE ELSE greatest(least(demand_z52 / 3.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) END AS d,
  CAST(n_sources_flagging AS DOUBLE) / nullif(CAST(n_sources_reporting AS DOUBLE), 0) AS c FROM fused),
scored AS (SELECT *, CASE WHEN a IS NOT NULL THEN greatest(least(0.45::DOUBLE * a + 0.25::DOUBLE * m + 0.2::DOUBLE * d + 0.1::DOUBLE * coalesce(c, 0), 1.0::DOUBLE), 0.0::DOUBLE) END AS f FROM terms),
held AS (SELECT *, CASE WHEN coalesce(single_source_coverage, FALSE) THEN 'single_source_coverage' WHEN coalesce(n_sources_reporting, 0) = 0 THEN 'no_sources_reporting' WHEN n_sources_reporting < 2 THEN 'single_source_reporting' WHEN coalesce(c, 0) < 0.5 THEN 'insufficient_corroboration' END AS why FROM scored),
alerts AS (SELECT commodity, region, obs_date, f, floor(f * 1000000 + 0.5) / 1000000 AS fusion_score, CASE WHEN f IS NULL THEN 'belum_dapat_dinilai' WHEN f < 0.4 THEN 'tenang' WHEN f < 0.7 THEN 'waspada' WHEN why IS NOT NULL THEN 'waspada' ELSE 'siaga' END AS level, CASE WHEN f >= 0.7 THEN why END AS reason, floor(a * 1000000 + 0.5) / 1000000 AS a, floor(m * 1000000 + 0.5) / 1000000 AS m, floor(d * 1000000 + 0.5) / 1000000 AS d, floor(c * 1000000 + 0.5) / 1000000 AS c FROM held)"""


def alerts_of(spark, base):
    return fusion.fuse(fused_of(spark, base)).select(*SERIES, "obs_date", "fusion_score", "level", "components.reason", "components.a", "components.m", "components.d", "components.c")


@query("SELECT commodity, region, obs_date, fusion_score, level, reason, a, m, d, c FROM alerts", FUSED, FUSE)
def fusion_alerts(spark, base):
    return alerts_of(spark, base)


@query("SELECT level, reason, count(*) AS n_rows FROM alerts GROUP BY ALL", FUSED, FUSE)
def level_counts(spark, base):
    return alerts_of(spark, base).groupBy("level", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT commodity, region, obs_date, fusion_score, level FROM alerts WHERE obs_date = (SELECT max(obs_date) FROM alerts)", FUSED, FUSE)
def alert_board(spark, base):
    rows = alerts_of(spark, base)
    return rows.where(F.col("obs_date") == rows.agg(F.max("obs_date")).scalar()).select(*SERIES, "obs_date", "fusion_score", "level").orderBy(F.desc_nulls_last("fusion_score"), "region", "commodity")


@query("SELECT a.commodity, a.region, a.obs_date, a.fusion_score, p.price AS price_now, q.price AS price_before FROM (SELECT * FROM alerts WHERE fusion_score IS NOT NULL ORDER BY fusion_score DESC, commodity, region, obs_date LIMIT 20) a LEFT JOIN price p USING (commodity, region, obs_date) LEFT JOIN price q ON q.commodity = a.commodity AND q.region = a.region AND q.obs_date = a.obs_date - 7", DAY, FUSED, FUSE)
def strongest_alerts(spark, base):
    top = alerts_of(spark, base).where("fusion_score is not null").orderBy(F.desc("fusion_score"), *SERIES, "obs_date").limit(20).select(*SERIES, "obs_date", "fusion_score")
    prices = price_of(spark, base)
    now = top.join(prices.withColumnRenamed("price", "price_now"), [*SERIES, "obs_date"], "left")
    return now.join(prices.select(*SERIES, F.date_add("obs_date", 7).alias("obs_date"), F.col("price").alias("price_before")), [*SERIES, "obs_date"], "left")


@query("SELECT commodity, region, obs_date, round(price_median / nullif(b, 0) - 1, 6) AS pct_change_7d FROM (SELECT *, max(price_median) OVER (PARTITION BY commodity, region ORDER BY obs_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS b FROM day)", DAY)
def momentum(spark, base):
    return fusion.change_over(day_of(spark, base), "price_median", 7, SERIES, "pct_change_7d").select(*SERIES, "obs_date", r6("pct_change_7d"))


@query(
    """SELECT commodity, region, obs_date, count(*) AS n_sources_reporting, count(*) FILTER (abs(price / b - 1) >= 0.05) AS n_sources_flagging FROM (
  SELECT *, max(price) OVER (PARTITION BY commodity, region, source ORDER BY obs_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS b FROM obs) WHERE b IS NOT NULL GROUP BY ALL""",
    OBS,
)
def source_movements(spark, base):
    return fusion.source_movements(obs_of(spark, base))


@query("SELECT commodity, region, count(DISTINCT source) AS n_sources_lifetime, count(DISTINCT source) < 2 AS single_source_coverage FROM obs GROUP BY ALL", OBS)
def source_coverage(spark, base):
    return fusion.source_coverage(obs_of(spark, base))


@query(
    "SELECT 'base' AS variant, level, count(*) AS n_rows FROM alerts GROUP BY ALL", FUSED, FUSE,
)
def weight_base_levels(spark, base):
    return fusion.sensitivity(fused_of(spark, base)).where("variant = 'base'").groupBy("variant", "level").agg(F.count(F.lit(1)).alias("n_rows"))


def _variants_sql() -> str:
    rows = ", ".join("(" + ", ".join([f"'{n}'", *[f"{w[k]!r}::DOUBLE" for k in ("anomaly", "momentum", "demand", "corroboration")]]) + ")" for n, w in fusion.perturbed_weights())
    return f"""v AS (SELECT * FROM (VALUES {rows}) t(variant, wa, wm, wd, wc)),
moved AS (SELECT variant, commodity, region, obs_date, CASE WHEN f IS NULL THEN 'belum_dapat_dinilai' WHEN f < 0.4 THEN 'tenang' WHEN f < 0.7 THEN 'waspada' WHEN why IS NOT NULL THEN 'waspada' ELSE 'siaga' END AS level FROM (
  SELECT v.variant, h.commodity, h.region, h.obs_date, h.why, CASE WHEN a IS NOT NULL THEN greatest(least(wa * a + wm * m + wd * d + wc * coalesce(c, 0), 1.0::DOUBLE), 0.0::DOUBLE) END AS f FROM held h, v))"""


@query("SELECT variant, level, count(*) AS n_rows FROM moved GROUP BY ALL", FUSED, FUSE, _variants_sql())
def weight_sensitivity(spark, base):
    return fusion.sensitivity(fused_of(spark, base)).groupBy("variant", "level").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    """SELECT commodity, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM (SELECT commodity, rank() OVER (PARTITION BY commodity ORDER BY norm_zscore) + (count(*) OVER (PARTITION BY commodity, norm_zscore) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY commodity ORDER BY norm_iforest) + (count(*) OVER (PARTITION BY commodity, norm_iforest) - 1) / 2 AS ry FROM fused WHERE norm_zscore IS NOT NULL AND norm_iforest IS NOT NULL) GROUP BY ALL""",
    FUSED,
)
def spearman(spark, base):
    return evaluate.spearman(fused_of(spark, base), "norm_zscore", "norm_iforest", ["commodity"]).select("commodity", "n", r6("spearman"))


# ---- evaluation ----------------------------------------------------------------------

TAGGED = """tagged AS (SELECT z.commodity, z.region, z.obs_date, CASE WHEN abs(coalesce(raw_score, 0)) > 1.5 OR coalesce(abs(z.price / b.price - 1) > 0.07, FALSE) THEN 'rule_flagged' ELSE 'random_control' END AS sampling_stratum,
  md5(concat_ws('|', '20260729', z.commodity, z.region, z.obs_date)) AS o FROM z LEFT JOIN price b ON b.commodity = z.commodity AND b.region = z.region AND b.obs_date = z.obs_date - 7),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sampling_stratum ORDER BY o, commodity, region, obs_date) AS rn FROM tagged) t
  WHERE rn <= 307 AND (sampling_stratum = 'rule_flagged' OR rn <= floor((SELECT least(count(*), 307) FROM tagged WHERE sampling_stratum = 'rule_flagged') * 0.3)))"""


def tagged_of(spark, base):
    moved = fusion.change_over(z_of(spark, base), "price", 7, SERIES, "pct_change_7d")
    return evaluate.tag_candidates(moved)


@query("SELECT sampling_stratum, count(*) AS n_days FROM tagged GROUP BY ALL", DAY, ZSCORE, TAGGED)
def candidate_strata(spark, base):
    return tagged_of(spark, base).groupBy("sampling_stratum").agg(F.count(F.lit(1)).alias("n_days"))


@query("SELECT commodity, region, obs_date, sampling_stratum FROM pool", DAY, ZSCORE, TAGGED)
def candidate_pool(spark, base):
    return evaluate.candidate_pool(tagged_of(spark, base)).select(*SERIES, "obs_date", "sampling_stratum")


@query("SELECT c.candidate_id, count(*) AS n_days, min(p.obs_date) AS first_day, max(p.obs_date) AS last_day, round(sum(p.price), 2) AS total_price FROM gt_candidates c JOIN price p ON p.commodity = c.commodity AND p.region = c.region AND p.obs_date BETWEEN c.obs_date - 30 AND c.obs_date + 14 GROUP BY ALL", DAY)
def context_window(spark, base):
    seen = evaluate.context_windows(table(spark, base, "gt_candidates"), price_of(spark, base))
    total = F.aggregate("context", F.lit(0.0), lambda s, x: s + x["price"])
    return seen.select("candidate_id", F.size("context").cast("bigint").alias("n_days"), F.element_at("context", 1)["obs_date"].alias("first_day"), F.element_at("context", -1)["obs_date"].alias("last_day"), F.round(total, 2).alias("total_price"))


LABELS = """told AS (SELECT candidate_id, upper(regexp_replace(annotator_code, '[^A-Za-z0-9]', '', 'g')) AS annotator, regexp_replace(lower(label), '[^a-z]', '', 'g') AS w, labeled_at, label_id FROM gt_labels),
spelt AS (SELECT candidate_id, annotator, CASE WHEN regexp_matches(w, '^ano?ma?l') THEN 'anomali' WHEN regexp_matches(w, '^no?rm') THEN 'normal' WHEN regexp_matches(w, '^rag') THEN 'ragu' END AS l, labeled_at, label_id FROM told),
lab AS (SELECT candidate_id, annotator, arg_max(l, row(labeled_at, label_id)) AS label FROM spelt WHERE l IS NOT NULL AND candidate_id IS NOT NULL AND annotator <> '' GROUP BY ALL),
pairs AS (SELECT x.candidate_id, x.annotator AS annotator_a, y.annotator AS annotator_b, x.label AS label_a, y.label AS label_b FROM lab x JOIN lab y ON x.candidate_id = y.candidate_id AND x.annotator < y.annotator)"""


def labels_of(spark, base):
    """Standing labels through all spellings, as p5 reads them."""
    return labels.usable_labels(table(spark, base, "gt_labels"))


@query(
    """SELECT annotator_a, annotator_b, n_paired, round(po, 6) AS observed_agreement, round(pe, 6) AS expected_agreement, round(k, 6) AS kappa, CASE WHEN k < 0 THEN 'worse than chance' WHEN k < 0.2 THEN 'slight' WHEN k < 0.4 THEN 'fair' WHEN k < 0.6 THEN 'moderate' WHEN k < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM (
  SELECT *, CASE WHEN pe >= 1 THEN 0 ELSE (po - pe) / (1 - pe) END AS k FROM (SELECT annotator_a, annotator_b, n_paired, s / n_paired AS po, e / (CAST(n_paired AS DOUBLE) * n_paired) AS pe FROM (
    SELECT annotator_a, annotator_b, count(*) AS n_paired, count(*) FILTER (label_a = label_b) AS s, count(*) FILTER (label_a = 'anomali') * count(*) FILTER (label_b = 'anomali') + count(*) FILTER (label_a = 'normal') * count(*) FILTER (label_b = 'normal') + count(*) FILTER (label_a = 'ragu') * count(*) FILTER (label_b = 'ragu') AS e FROM pairs GROUP BY ALL)))""",
    LABELS,
)
def kappa(spark, base):
    """Agreement of every pair of annotators with a candidate in common."""
    k = labels.pair_kappas(labels.label_pairs(labels_of(spark, base)))
    return k.select("annotator_a", "annotator_b", "n_paired", r6("observed_agreement"), r6("expected_agreement"), r6("kappa"), kappa_band(F.col("kappa")).alias("band"))


@query("SELECT candidate_id, annotator_a, annotator_b, label_a, label_b FROM pairs WHERE label_a <> label_b", LABELS)
def disagreements(spark, base):
    return labels.label_pairs(labels_of(spark, base)).where("label_a <> label_b").select("candidate_id", "annotator_a", "annotator_b", "label_a", "label_b")


@query("SELECT a.annotator, c.candidate_id FROM gt_candidates c, (SELECT DISTINCT annotator FROM told WHERE annotator <> '') a WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.candidate_id = c.candidate_id AND l.annotator = a.annotator)", LABELS)
def labelling_queue(spark, base):
    """The open candidates of every annotator with a row in the labels."""
    codes = table(spark, base, "gt_labels").select(labels.annotator_code(F.col("annotator_code")).alias("annotator")).where("annotator != ''").distinct()
    return labels.queues(table(spark, base, "gt_candidates"), labels_of(spark, base), codes)


@query("SELECT c.sampling_stratum, count(DISTINCT c.candidate_id) AS n_candidates, count(l.label) AS n_labels, count(DISTINCT l.candidate_id) AS n_labelled FROM gt_candidates c LEFT JOIN lab l USING (candidate_id) GROUP BY ALL", LABELS)
def labelling_progress(spark, base):
    joined = table(spark, base, "gt_candidates").select("candidate_id", "sampling_stratum").join(labels_of(spark, base).withColumnRenamed("candidate_id", "_c"), F.col("candidate_id") == F.col("_c"), "left")
    return joined.groupBy("sampling_stratum").agg(F.countDistinct("candidate_id").alias("n_candidates"), F.count("label").alias("n_labels"), F.countDistinct("_c").alias("n_labelled"))


ARMS = """arms AS (SELECT DISTINCT * FROM (
  SELECT 'zscore_only' AS method, commodity, region, obs_date FROM fused WHERE zscore_flagged UNION ALL SELECT 'iforest_only', commodity, region, obs_date FROM fused WHERE iforest_flagged
  UNION ALL SELECT 'union', commodity, region, obs_date FROM fused WHERE zscore_flagged OR iforest_flagged UNION ALL SELECT 'fusion', commodity, region, obs_date FROM alerts WHERE level IN ('siaga', 'waspada'))),
hits AS (SELECT a.*, EXISTS (SELECT 1 FROM ev e WHERE e.commodity = a.commodity AND e.region = a.region AND a.obs_date BETWEEN e.start_date - 3 AND e.end_date + 3) AS hit FROM arms a)"""


def arms_of(spark, base):
    """Detections of the four arms, one row per arm, series and day."""
    rows = fused_of(spark, base).join(alerts_of(spark, base).select(*SERIES, "obs_date", "level"), [*SERIES, "obs_date"])
    either = F.coalesce("zscore_flagged", F.lit(False)) | F.coalesce("iforest_flagged", F.lit(False))
    named = [("zscore_only", F.col("zscore_flagged")), ("iforest_only", F.col("iforest_flagged")), ("union", either), ("fusion", F.col("level").isin("siaga", "waspada"))]
    arms = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))
    return rows.select(*SERIES, "obs_date", F.explode(arms).alias("method"))


@query("SELECT method, count(*) AS n_rows, count(DISTINCT obs_date) AS n_days FROM arms GROUP BY ALL", DAY, FUSED, FUSE, EVENTS, ARMS)
def arm_detections(spark, base):
    return arms_of(spark, base).groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("obs_date").alias("n_days"))


@query(
    """SELECT method, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (
  SELECT method, tp, fp, alln - coalesce(found, 0) AS fn, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + alln - coalesce(found, 0), 0), 0) AS r FROM (
    SELECT method, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp, (SELECT count(*) FROM ev) AS alln FROM hits GROUP BY ALL)
  LEFT JOIN (SELECT a.method, count(DISTINCT row(e.commodity, e.region, e.start_date)) AS found FROM arms a JOIN ev e ON e.commodity = a.commodity AND e.region = a.region AND a.obs_date BETWEEN e.start_date - 3 AND e.end_date + 3 GROUP BY ALL) USING (method))""",
    DAY, FUSED, FUSE, EVENTS, ARMS,
)
def event_match_metrics(spark, base):
    events = events_of(spark, base)
    matched, _ = evaluate.match_events(arms_of(spark, base), events)
    out = evaluate.precision_recall(matched, evaluate.event_days(events))
    return out.select("method", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query(
    """SELECT s.name, count(*) AS n_flags, count(*) FILTER (b.obs_date IS NOT NULL) AS n_common, round(count(*) FILTER (b.obs_date IS NOT NULL) / (count(*) + (SELECT count(*) FROM fused WHERE zscore_flagged) - count(*) FILTER (b.obs_date IS NOT NULL)), 6) AS jaccard,
  count(*) FILTER (b.obs_date IS NOT NULL) = least(count(*), (SELECT count(*) FROM fused WHERE zscore_flagged)) AS nested FROM (
  SELECT 'zscore' AS name, commodity, region, obs_date FROM fused WHERE zscore_flagged UNION ALL SELECT 'iforest', commodity, region, obs_date FROM fused WHERE iforest_flagged) s
LEFT JOIN (SELECT commodity, region, obs_date FROM fused WHERE zscore_flagged) b ON b.commodity = s.commodity AND b.region = s.region AND b.obs_date = s.obs_date GROUP BY s.name""",
    FUSED,
)
def flag_overlap(spark, base):
    arms = F.array_compact(F.array(F.when(F.col("zscore_flagged"), F.lit("zscore")), F.when(F.col("iforest_flagged"), F.lit("iforest"))))
    sets = fused_of(spark, base).select(*SERIES, "obs_date", F.explode(arms).alias("name"))
    return evaluate.set_overlap(sets, "name", "zscore").select("name", "n_flags", "n_common", r6("jaccard"), "nested")


@query(
    """SELECT count(*) FILTER (s.obs_date IS NOT NULL AND f.obs_date IS NOT NULL AND round(s.v, 6) IS NOT DISTINCT FROM round(f.v, 6)) AS n_equal, count(*) FILTER (s.obs_date IS NOT NULL AND f.obs_date IS NOT NULL AND round(s.v, 6) IS DISTINCT FROM round(f.v, 6)) AS n_different,
  count(*) FILTER (f.obs_date IS NULL) AS n_left_only, count(*) FILTER (s.obs_date IS NULL) AS n_right_only FROM (SELECT commodity, region, obs_date, fusion_score AS v FROM alerts) s
FULL JOIN (SELECT commodity, region, obs_date, norm_zscore AS v FROM fused WHERE norm_zscore IS NOT NULL) f ON f.commodity = s.commodity AND f.region = s.region AND f.obs_date = s.obs_date""",
    FUSED, FUSE,
)
def reproduce_diff(spark, base):
    """The comparison of two runs, here of two score columns that differ."""
    left = alerts_of(spark, base).withColumnRenamed("fusion_score", "v")
    right = fused_of(spark, base).where("norm_zscore is not null").withColumnRenamed("norm_zscore", "v")
    return evaluate.compare_runs(left, right, [*SERIES, "obs_date"], "v")


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """Raw observations to alerts: link, reconcile, fill, score, weigh and level."""
    obs = obs_of(spark, base)
    daily = linking.daily_series(obs)
    scored = detectors.zscore(daily.where("not is_imputed and price_median > 0").select(*SERIES, "obs_date", F.col("price_median").alias("price")))
    moved = fusion.change_over(daily.select(*SERIES, "obs_date", "price_median"), "price_median", 7, SERIES, "pct_change_7d")
    keys = [*SERIES, "obs_date"]
    inputs = (
        scored.select(*keys, F.col("norm_score").alias("norm_zscore"), F.col("is_flagged").alias("zscore_flagged"))
        .join(moved.select(*keys, "pct_change_7d"), keys, "left").join(fusion.source_movements(obs), keys, "left")
        .withColumns({"norm_iforest": F.lit(None).cast("double"), "iforest_flagged": F.lit(None).cast("boolean"), "demand_z52": F.lit(None).cast("double")})
        .join(fusion.source_coverage(obs).select(*SERIES, "single_source_coverage"), SERIES, "left")
    )
    return fusion.fuse(inputs)
