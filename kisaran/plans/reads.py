"""Queries behind boards, tables, drill-downs and the steps around a run, each with the
SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from kisaran.operators import boards, detectors, evaluate, fusion, labels, normalize, reports
from kisaran.plans.problems import SERIES
from kisaran.plans.series import (
    ALIAS, ARMS, CHAIN, DAY, EVENTS, FUSE, FUSED, LABELS, OBS, TAGGED, ZSCORE, _variants_sql, alerts_of, arms_of, day_of, events_of, filled_of, fused_of, labels_of, obs_of, offsets_of, price_of, query, r6, tagged_of, z_of,
)
from kisaran.session import table
from kisaran.sources import payloads, reference

# ---- sources and normalisation ----------------------------------------------


@query(
    """SELECT source, slug AS commodity, arg_min(alias, row(rank, alias)) AS alias, min(rank) AS alias_rank, count(DISTINCT alias) AS n_present FROM alias
WHERE (source, alias) IN (SELECT DISTINCT source, lower(trim(regexp_replace(matched_alias, '\\s+', ' ', 'g'))) FROM price_observations WHERE matched_alias IS NOT NULL) GROUP BY ALL""",
    ALIAS,
)
def variant_resolution(spark, base):
    seen = table(spark, base, "price_observations").select("source", F.col("matched_alias").alias("name"))
    return normalize.present_variants(seen, normalize.alias_index(table(spark, base, "commodities")))


@query("SELECT commodity, region AS province, obs_date, price FROM price", DAY)
def json_variants(spark, base):
    """Prices written as one JSON body a commodity, some without a price, and read back."""
    offer = F.struct(F.col("region").alias("kode_provinsi"), F.col("price").alias("harga"), F.concat(F.date_format("obs_date", "yyyy-MM-dd"), F.lit("T00:00:00")).alias("tanggal"))
    blank = F.array(F.named_struct(F.lit("kode_provinsi"), F.lit("x"), F.lit("harga"), F.lit(None).cast("double"), F.lit("tanggal"), F.lit("2024-01-01T00:00:00")))
    bodies = price_of(spark, base).groupBy("commodity", "region").agg(F.collect_list(offer).alias("l")).select("commodity", F.to_json(F.struct(F.concat("l", blank).alias("data"))).alias("body"))
    return payloads.json_variants(bodies, "body", ["commodity"])


@query("SELECT commodity, source, obs_date, median(price) AS price, string_agg(DISTINCT region, ',' ORDER BY region) AS markets FROM obs GROUP BY ALL", OBS)
def market_medians(spark, base):
    rows = payloads.market_medians(obs_of(spark, base), ["commodity", "source", "obs_date"], "price", "region")
    return rows.withColumn("markets", F.array_join("markets", ","))


@query(
    """SELECT unit, target, factor, count(*) AS n_rows FROM (
  SELECT p.unit, p.target, CASE WHEN p.unit = p.target THEN 1.0::DOUBLE ELSE CAST(u.amount AS DOUBLE) END AS factor FROM (
    SELECT o.commodity_slug, c.canonical_unit AS target, coalesce(lower(trim(regexp_replace(o.raw_unit, '\\s+', ' ', 'g'))), c.canonical_unit) AS unit FROM price_observations o LEFT JOIN commodities c ON c.slug = o.commodity_slug) p
  LEFT JOIN unit_conversions u ON u.from_unit = p.unit AND u.to_unit = p.target AND (u.applies_to IS NULL OR list_contains(list_transform(string_split(u.applies_to, ','), lambda x: trim(x)), p.commodity_slug))) GROUP BY ALL"""
)
def unit_convert(spark, base):
    rows = table(spark, base, "price_observations").select("commodity_slug", "raw_unit")
    found = normalize.conversion_factors(rows, table(spark, base, "commodities"), table(spark, base, "unit_conversions"))
    return found.groupBy("unit", "target", "factor").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    """SELECT CAST(d AS DATE) AS obs_date FROM (SELECT unnest(generate_series(min(obs_date), max(obs_date), INTERVAL 1 DAY)) AS d FROM obs)
WHERE CAST(d AS DATE) NOT IN (SELECT obs_date FROM obs WHERE region NOT IN (SELECT slug FROM regions WHERE level = 'national'))""",
    OBS,
)
def resume_days(spark, base):
    nationwide = table(spark, base, "regions").where("level = 'national'").select(F.col("slug").alias("region"))
    return normalize.resume_days(obs_of(spark, base), nationwide)


@query(
    """SELECT coalesce(d.source, f.source) AS source, coalesce(d.region, f.region) AS region, CASE WHEN f.source IS NULL THEN 'delete' WHEN d.source IS NULL THEN 'insert' ELSE 'keep' END AS action
FROM (SELECT DISTINCT source, region FROM normalize_reports) d FULL JOIN (SELECT DISTINCT source, region FROM obs) f ON d.source = f.source AND d.region = f.region""",
    OBS,
)
def bridge_changes(spark, base):
    return normalize.bridge_changes(table(spark, base, "normalize_reports"), obs_of(spark, base), ["source", "region"])


@query("SELECT DISTINCT commodity, region FROM fusion_inputs f WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.commodity = f.commodity AND o.region = f.region)", OBS)
def orphan_series(spark, base):
    """Series of the fused table without any observation."""
    return table(spark, base, "fusion_inputs").select(*SERIES).distinct().join(obs_of(spark, base).select(*SERIES).distinct(), SERIES, "left_anti")


@query("SELECT DISTINCT commodity, region, CAST(date_trunc('week', obs_date) AS DATE) AS week_start, sha256(concat_ws('|', commodity, region, CAST(date_trunc('week', obs_date) AS DATE))) AS cache_key FROM fusion_inputs WHERE obs_date IS NOT NULL")
def cache_keys(spark, base):
    weeks = table(spark, base, "fusion_inputs").where("obs_date is not null").select(*SERIES, F.date_trunc("week", "obs_date").cast("date").alias("week_start")).distinct()
    return weeks.withColumn("cache_key", payloads.cache_key(F.col("commodity"), F.col("region"), F.col("week_start")))


@query("SELECT slug AS region, CASE WHEN level IN ('national', 'province') THEN slug ELSE 'nasional' END AS scope FROM regions")
def demand_scope(spark, base):
    """Regions with a demand series of their own (nation and provinces here) keep it."""
    regions = table(spark, base, "regions")
    own = regions.where("level in ('national', 'province')").agg(F.collect_set("slug")).scalar()  # as many as there are provinces
    return regions.select(F.col("slug").alias("region"), boards.demand_scope(F.col("slug"), own, "nasional").alias("scope"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (" + " + ".join(f"((c_custkey * {i + 3}) % 5)" if i % 2 == 0 else f"(5 - ((c_custkey * {i + 3}) % 5 + 1))" for i in range(10)) + ") * 2.5::DOUBLE END AS sus_score FROM customer"
)
def sus_scores(spark, base):
    """Ten answers made of the key, one of them missing for every seventh respondent."""
    items = [F.when((F.col("c_custkey") % 7 != 0) | F.lit(i != 4), (F.col("c_custkey") * (i + 3)) % 5 + 1) for i in range(10)]
    return table(spark, base, "customer").select("c_custkey", boards.sus_score(items).cast("double").alias("sus_score"))


# ---- coverage and tables ------------------------------------------------------

TABLES = ("price_observations", "price_daily_unified", "source_offsets", "cluster_assignments", "fusion_inputs", "gt_candidates", "gt_labels", "normalize_reports", "regions", "commodities")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES))
def table_counts(spark, base):
    counted = [table(spark, base, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n_rows")).select("name", "n_rows") for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), counted)


@query("SELECT 'cluster' AS run_type, max(run_id) AS run_id FROM cluster_assignments UNION ALL SELECT 'preprocess', max(run_id) FROM source_offsets")
def latest_runs(spark, base):
    newest = lambda t, n: table(spark, base, t).agg(F.lit(n).alias("run_type"), F.max("run_id").alias("run_id")).select("run_type", "run_id")
    return newest("cluster_assignments", "cluster").unionByName(newest("source_offsets", "preprocess"))


@query("SELECT slug, display_name, canonical_unit, sort_order, len(map_keys(source_aliases)) AS n_sources, len(flatten(map_values(source_aliases))) AS n_aliases FROM commodities")
def commodities_table(spark, base):
    rows = table(spark, base, "commodities")
    return rows.select("slug", "display_name", "canonical_unit", "sort_order", F.size("source_aliases").cast("bigint").alias("n_sources"), F.size(F.flatten(F.map_values("source_aliases"))).cast("bigint").alias("n_aliases"))


@query(
    """SELECT s.source, count(o.source) AS n_rows, min(o.obs_date) AS first_day, max(o.obs_date) AS last_day FROM (
  SELECT DISTINCT unnest(map_keys(source_aliases)) AS source FROM commodities) s LEFT JOIN obs o USING (source) GROUP BY ALL""",
    OBS,
)
def sources_table(spark, base):
    listed = table(spark, base, "commodities").select(F.explode(F.map_keys("source_aliases")).alias("source")).distinct()
    return listed.join(reports.series_sources(obs_of(spark, base)).groupBy("source").agg(F.sum("n_rows").alias("n_rows"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")), "source", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("bigint"))


@query(
    """SELECT r.slug AS region, CASE r.level WHEN 'national' THEN 0 WHEN 'province' THEN 1 ELSE 2 END AS level_order, count(o.region) AS n_rows, count(DISTINCT o.commodity) AS n_commodities, count(DISTINCT o.obs_date) AS n_days FROM regions r LEFT JOIN obs o ON o.region = r.slug GROUP BY ALL""",
    OBS,
)
def region_coverage(spark, base):
    order = F.when(F.col("level") == "national", 0).when(F.col("level") == "province", 1).otherwise(2)
    seen = obs_of(spark, base).groupBy("region").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("commodity").alias("n_commodities"), F.countDistinct("obs_date").alias("n_days"))
    joined = table(spark, base, "regions").select(F.col("slug").alias("region"), order.alias("level_order")).join(seen, "region", "left")
    return joined.fillna(0, ["n_rows", "n_commodities", "n_days"]).orderBy("level_order", "region")


@query("SELECT d.commodity, d.region, d.obs_date, d.price_median, o.source, o.price, o.snapshot_id FROM day d JOIN obs o USING (commodity, region, obs_date)", DAY, OBS)
def day_sources(spark, base):
    """The prices of the sources behind every day."""
    return day_of(spark, base).select(*SERIES, "obs_date", "price_median").join(obs_of(spark, base), [*SERIES, "obs_date"])


@query(
    """SELECT count(*) AS n_days, count(*) FILTER (price_median IS NOT NULL AND NOT is_imputed) AS n_real, count(*) FILTER (price_median IS NOT NULL AND is_imputed) AS n_imputed, count(*) FILTER (price_median IS NULL) AS n_missing, min(obs_date) AS first_day, max(obs_date) AS last_day, count(DISTINCT row(commodity, region)) AS n_series FROM filled""",
    *CHAIN,
)
def report_totals(spark, base):
    each = reports.completeness(filled_of(spark, base))
    return each.agg(*[F.sum(c).alias(c) for c in ("n_days", "n_real", "n_imputed", "n_missing")], F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.count(F.lit(1)).alias("n_series"))


@query("SELECT commodity, region, source, round(factor, 6) AS factor, n_overlap FROM offsets WHERE excluded_reason IS NULL ORDER BY round(abs(factor - 1), 9) DESC, commodity, region, source LIMIT 5", *CHAIN[:4])
def largest_offsets(spark, base):
    used = offsets_of(spark, base).where("excluded_reason is null")
    return used.orderBy(F.desc(F.round(F.abs(F.col("factor") - 1), 9)), *SERIES, "source").limit(5).select(*SERIES, "source", r6("factor"), "n_overlap")


@query("SELECT commodity, region, source, round(ratio_cv_pct, 6) AS ratio_cv_pct, n_overlap FROM offsets WHERE ratio_cv_pct >= 5", *CHAIN[:4])
def weak_links(spark, base):
    return offsets_of(spark, base).where("ratio_cv_pct >= 5").select(*SERIES, "source", r6("ratio_cv_pct"), "n_overlap")


# ---- detectors ------------------------------------------------------------------

LONG = """long AS (SELECT commodity, region, obs_date, 'zscore' AS method, norm_zscore AS norm_score, zscore_flagged AS is_flagged FROM fused WHERE norm_zscore IS NOT NULL OR zscore_flagged IS NOT NULL
  UNION ALL SELECT commodity, region, obs_date, 'iforest', norm_iforest, iforest_flagged FROM fused WHERE norm_iforest IS NOT NULL OR iforest_flagged IS NOT NULL)"""


def long_of(spark, base):
    return boards.long_scores(fused_of(spark, base))


@query("SELECT commodity, region, obs_date, max(norm_score) FILTER (method = 'zscore') AS norm_zscore, max(norm_score) FILTER (method = 'iforest') AS norm_iforest, bool_or(is_flagged) FILTER (method = 'zscore') AS zscore_flagged, bool_or(is_flagged) FILTER (method = 'iforest') AS iforest_flagged FROM long GROUP BY ALL", FUSED, LONG)
def pivot_scores(spark, base):
    return fusion.pivot_scores(long_of(spark, base))


@query(
    """SELECT commodity, method, count(*) AS n_rows, count(*) FILTER (is_flagged) AS n_flagged, count(*) FILTER (is_flagged AND EXISTS (SELECT 1 FROM long o WHERE o.commodity = l.commodity AND o.region = l.region AND o.obs_date = l.obs_date AND o.method <> l.method AND o.is_flagged)) AS n_both FROM long l GROUP BY ALL""",
    FUSED, LONG,
)
def method_flag_counts(spark, base):
    return boards.flag_counts(long_of(spark, base))


@query(
    """SELECT l.commodity, l.region, l.obs_date, l.method, l.norm_score, lag(p.price) OVER (PARTITION BY l.commodity, l.region ORDER BY l.obs_date, l.method) AS previous_flagged FROM long l JOIN price p USING (commodity, region, obs_date) WHERE l.is_flagged""",
    DAY, FUSED, LONG,
)
def flagged_rows(spark, base):
    """Flagged rows of both methods with the price of the flagged row before (not of the
    day before; for that see top_flagged)."""
    flagged = long_of(spark, base).where("is_flagged").join(price_of(spark, base), [*SERIES, "obs_date"])
    before = F.lag("price").over(Window.partitionBy(*SERIES).orderBy("obs_date", "method"))
    return flagged.select(*SERIES, "obs_date", "method", "norm_score", before.alias("previous_flagged"))


STRONGEST = """top AS (SELECT commodity, region, obs_date AS peak_day FROM z WHERE abs(raw_score) >= 2.5 ORDER BY round(abs(raw_score), 9) DESC, commodity, region, obs_date LIMIT 1)"""


@query("SELECT z.commodity, z.region, z.obs_date, z.price, round(z.raw_score, 6) AS raw_score, coalesce(abs(z.raw_score) >= 2.5, FALSE) AS is_flagged FROM z JOIN top t ON z.commodity = t.commodity AND z.region = t.region AND z.obs_date BETWEEN t.peak_day - 60 AND t.peak_day + 60", DAY, ZSCORE, STRONGEST)
def example_series(spark, base):
    """The days around the strongest flag of all."""
    rows = z_of(spark, base)
    top = rows.where("is_flagged").orderBy(F.desc(F.round(F.abs("raw_score"), 9)), *SERIES, "obs_date").limit(1).select(*SERIES, F.col("obs_date").alias("peak_day"))
    near = rows.join(F.broadcast(top), SERIES).where(F.abs(F.datediff("obs_date", "peak_day")) <= 60)  # one row
    return near.select(*SERIES, "obs_date", "price", r6("raw_score"), "is_flagged")


@query("SELECT DISTINCT commodity, region, obs_date, 'zscore' AS method FROM z WHERE raw_score IS NOT NULL UNION ALL SELECT commodity, region, obs_date, 'iforest' FROM feats WHERE pct_change_1d IS NOT NULL AND pct_change_7d IS NOT NULL AND rolling_std_14d IS NOT NULL AND n >= 60 AND n_full >= 60",
       DAY, ZSCORE, """steps AS (SELECT *, ln(price) - ln(lag(price) OVER (PARTITION BY commodity, region ORDER BY obs_date)) AS step FROM price),
plain AS (SELECT commodity, region, obs_date, price / lag(price, 1) OVER w - 1 AS pct_change_1d, price / lag(price, 7) OVER w - 1 AS pct_change_7d, CASE WHEN count(step) OVER r >= 3 THEN stddev_samp(step) OVER r END AS rolling_std_14d FROM steps
  WINDOW w AS (PARTITION BY commodity, region ORDER BY obs_date), r AS (PARTITION BY commodity, region ORDER BY obs_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
feats AS (SELECT *, count(*) OVER (PARTITION BY commodity, region) AS n, count(pct_change_1d + pct_change_7d + rolling_std_14d) OVER (PARTITION BY commodity, region) AS n_full FROM plain)""")  # fmt: skip
def scored_days(spark, base):
    """The days each detector can judge."""
    whole = Window.partitionBy(*SERIES)
    feats = detectors.feature_matrix(price_of(spark, base))
    full = F.col("pct_change_1d").isNotNull() & F.col("pct_change_7d").isNotNull() & F.col("rolling_std_14d").isNotNull()
    judged = feats.withColumns({"_n": F.count(F.lit(1)).over(whole), "_f": F.count_if(full).over(whole)}).where(full & (F.col("_n") >= 60) & (F.col("_f") >= 60))
    ours = z_of(spark, base).where("raw_score is not null").select(*SERIES, "obs_date", F.lit("zscore").alias("method"))
    return ours.unionByName(judged.select(*SERIES, "obs_date", F.lit("iforest").alias("method")))


# ---- zones -----------------------------------------------------------------------


@query("SELECT commodity, region, period_month, zone, CAST(feat_volatility AS DOUBLE) AS volatility, quality_reason FROM cluster_assignments WHERE period_month = (SELECT max(period_month) FROM cluster_assignments)")
def zone_board(spark, base):
    """The cells of the newest month, those without a zone last."""
    rows = boards.newest(table(spark, base, "cluster_assignments"), "period_month")
    return rows.select(*SERIES, "period_month", "zone", F.col("feat_volatility").cast("double").alias("volatility"), "quality_reason").orderBy(F.asc_nulls_last("zone"), F.desc_nulls_last("volatility"), *SERIES)


@query("SELECT commodity, region, max(period_month) AS period_month, coalesce(arg_max(zone, row(period_month, cell_id)) FILTER (zone IS NOT NULL), 'belum_dapat_dinilai') AS zone FROM cluster_assignments GROUP BY ALL")
def latest_zone(spark, base):
    """The last zone of every series; one without any is not judged yet."""
    last = F.max_by(F.col("zone"), F.when(F.col("zone").isNotNull(), F.struct("period_month", "cell_id")))
    return table(spark, base, "cluster_assignments").groupBy(*SERIES).agg(F.max("period_month").alias("period_month"), F.coalesce(last, F.lit("belum_dapat_dinilai")).alias("zone"))


# ---- fusion ----------------------------------------------------------------------


@query(
    """SELECT commodity, region, obs_date, level, printf('a %.2f, m %.2f, d %.2f, c %.2f', coalesce(a, 0), coalesce(m, 0), coalesce(d, 0), coalesce(c, 0)) || coalesce('; held back: ' || reason, '') AS explanation,
  CASE level WHEN 'siaga' THEN 'check the market and act' WHEN 'waspada' THEN 'watch daily' WHEN 'tenang' THEN 'no action' ELSE 'collect more readings first' END AS advice FROM alerts""".replace("'a %.2f, m %.2f, d %.2f, c %.2f'", "'A %.2f, M %.2f, D %.2f, C %.2f'"),
    FUSED, FUSE,
)
def alert_explanations(spark, base):
    rows = fusion.fuse(fused_of(spark, base))
    return rows.select(*SERIES, "obs_date", "level", boards.explain().alias("explanation"), boards.advice(F.col("level")).alias("advice"))


@query(
    """SELECT commodity, region, obs_date, fusion_score, level, price, CASE WHEN level IN ('siaga', 'waspada') THEN 'attention' WHEN level = 'tenang' THEN 'calm' ELSE 'unjudged' END AS bucket, EXISTS (SELECT 1 FROM alerts WHERE obs_date = (SELECT max(obs_date) FROM alerts)) AS newest_withheld
FROM (SELECT a.*, p.price FROM alerts a LEFT JOIN price p USING (commodity, region, obs_date)) WHERE obs_date = (SELECT max(obs_date) FROM alerts WHERE obs_date < (SELECT max(obs_date) FROM alerts))""",
    DAY, FUSED, FUSE,
)
def board(spark, base):
    """The newest settled day: alerts with their prices and buckets."""
    rows = alerts_of(spark, base)
    days = rows.select("obs_date").distinct()
    newest = days.agg(F.max("obs_date")).scalar()
    settled = days.where(F.col("obs_date") < newest).agg(F.max("obs_date")).scalar()
    shown = rows.where(F.col("obs_date") == settled).join(price_of(spark, base), [*SERIES, "obs_date"], "left")
    return shown.select(*SERIES, "obs_date", "fusion_score", "level", "price", boards.bucket(F.col("level")).alias("bucket"), F.lit(True).alias("newest_withheld")).orderBy(F.desc_nulls_last("fusion_score"), "region", "commodity")


@query(
    """SELECT commodity, region, obs_date, price_median, is_imputed, round(mean_recent, 6) AS mean_recent, round(price_median / mean_recent - 1, 6) AS deviation, abs(price_median / mean_recent - 1) > 0.10 AS is_outside FROM (
  SELECT *, avg(CASE WHEN seen AND r <= 30 THEN price_median END) OVER (PARTITION BY commodity, region) AS mean_recent, max(obs_date) OVER (PARTITION BY commodity, region) AS last FROM (
    SELECT *, price_median IS NOT NULL AND NOT is_imputed AS seen, count(*) FILTER (price_median IS NOT NULL AND NOT is_imputed) OVER (PARTITION BY commodity, region ORDER BY obs_date DESC ROWS UNBOUNDED PRECEDING) AS r FROM filled)) WHERE last - obs_date < 120""",
    *CHAIN,
)
def series_detail(spark, base):
    """The last 120 days of every series against the mean of its last 30 observed rows."""
    return boards.detail(filled_of(spark, base)).select(*SERIES, "obs_date", "price_median", "is_imputed", r6("mean_recent"), r6("deviation"), "is_outside")


@query("SELECT *, row_number() OVER (PARTITION BY commodity, region ORDER BY n_rows DESC, source) AS place FROM (SELECT commodity, region, source, count(*) AS n_rows FROM obs GROUP BY ALL)", OBS)
def source_credits(spark, base):
    """The sources of every series, the one with most rows first."""
    place = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("n_rows"), "source")).cast("bigint")
    return reports.series_sources(obs_of(spark, base)).select(*SERIES, "source", "n_rows").withColumn("place", place)


@query("SELECT source, max(obs_date) AS last_day, max(obs_date) >= (SELECT max(obs_date) FROM obs) - 7 AS is_active, count(DISTINCT region) AS n_regions FROM obs GROUP BY ALL", OBS)
def portals(spark, base):
    """Sources with their last day; active ones (a row within 7 days of the newest) first."""
    each = reports.coverage_by_source(obs_of(spark, base)).select("source", "last_day", "n_regions")
    newest = each.agg(F.max("last_day")).scalar()
    return each.withColumn("is_active", F.col("last_day") >= F.date_sub(newest, 7)).orderBy(F.desc("is_active"), F.desc("last_day"), "source")


@query("SELECT m.variant, count(*) AS n_rows, count(*) FILTER (m.level <> a.level) AS n_changed FROM moved m JOIN alerts a ON a.commodity = m.commodity AND a.region = m.region AND a.obs_date = m.obs_date GROUP BY ALL", FUSED, FUSE, _variants_sql())
def weight_level_changes(spark, base):
    """Rows that change their level under each weight vector."""
    return boards.flag_changes(fusion.all_levels(fused_of(spark, base)))


@query(" UNION ALL ".join(f"SELECT '{c}' AS term, count(DISTINCT coalesce({c}, 0)) AS n_values, count(DISTINCT coalesce({c}, 0)) <= 1 AS is_inert FROM terms" for c in "amdc"), FUSED, FUSE)
def inert_terms(spark, base):
    return boards.inert_terms(fusion.terms(fused_of(spark, base)), ["a", "m", "d", "c"])


# ---- evaluation --------------------------------------------------------------------


@query("SELECT candidate_id, commodity, region, obs_date, shuffle_key FROM gt_candidates")
def labelling_blind(spark, base):
    """Candidates without their stratum, in blind order."""
    return table(spark, base, "gt_candidates").select("candidate_id", *SERIES, "obs_date", "shuffle_key").orderBy("shuffle_key", "candidate_id")


@query("SELECT p.commodity, p.region, p.obs_date, p.sampling_stratum FROM pool p WHERE NOT EXISTS (SELECT 1 FROM gt_candidates g WHERE g.commodity = p.commodity AND g.region = p.region AND g.obs_date = p.obs_date)", DAY, ZSCORE, TAGGED)
def new_candidates(spark, base):
    pool = evaluate.candidate_pool(tagged_of(spark, base)).select(*SERIES, "obs_date", "sampling_stratum")
    return evaluate.new_candidates(pool, table(spark, base, "gt_candidates"))


@query("SELECT c.candidate_id, count(p.price) AS n_obs, CASE WHEN count(p.price) >= 20 THEN round(avg(p.price), 6) END AS baseline FROM gt_candidates c LEFT JOIN price p ON p.commodity = c.commodity AND p.region = c.region AND p.obs_date BETWEEN c.obs_date - 30 AND c.obs_date - 1 GROUP BY ALL", DAY)
def candidate_baselines(spark, base):
    return evaluate.baselines(table(spark, base, "gt_candidates"), price_of(spark, base)).select("candidate_id", "n_obs", r6("baseline"))


@query("SELECT annotator, count(*) AS n_labels, (SELECT count(*) FROM gt_candidates) - count(*) FILTER (candidate_id IN (SELECT candidate_id FROM gt_candidates)) AS n_open FROM lab GROUP BY ALL", LABELS)
def annotator_progress(spark, base):
    """Labels and open candidates of every annotator."""
    candidates = table(spark, base, "gt_candidates").select("candidate_id").distinct()
    done = labels_of(spark, base).join(candidates.withColumn("_c", F.lit(1)), "candidate_id", "left").groupBy("annotator").agg(F.count(F.lit(1)).alias("n_labels"), F.count("_c").alias("_d"))
    total = candidates.agg(F.count(F.lit(1))).scalar()
    return done.select("annotator", "n_labels", (total - F.col("_d")).alias("n_open"))


CANDIDATE_ARMS = """chosen AS (SELECT a.* FROM hits a WHERE EXISTS (SELECT 1 FROM gt_candidates g WHERE g.commodity = a.commodity AND g.region = a.region AND g.obs_date = a.obs_date))"""


@query("SELECT method, count(*) AS n_rows, count(*) FILTER (hit) AS n_hits, round(count(*) FILTER (hit) / count(*), 6) AS precision FROM chosen GROUP BY ALL", DAY, FUSED, FUSE, EVENTS, ARMS, CANDIDATE_ARMS)
def candidate_arms(spark, base):
    """The four arms on the labelling candidates only, against the events."""
    chosen = arms_of(spark, base).join(table(spark, base, "gt_candidates").select(*SERIES, "obs_date").distinct(), [*SERIES, "obs_date"], "left_semi")
    matched, _ = evaluate.match_events(chosen, events_of(spark, base))
    n, hits = F.count(F.lit(1)), F.count_if("hit")
    return matched.groupBy("method").agg(n.alias("n_rows"), hits.alias("n_hits"), F.round(hits / n, 6).alias("precision"))


@query("SELECT source, n_names, round(n_rejected / nullif(n_accepted + n_rejected, 0), 6) AS reject_share FROM (SELECT source, CAST(coalesce(sum(len(ignored_names)), 0) AS BIGINT) AS n_names, sum(n_accepted) AS n_accepted, sum(n_rejected) AS n_rejected FROM normalize_reports GROUP BY ALL)")
def reject_shares(spark, base):
    sums = table(spark, base, "normalize_reports").groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("ignored_names").isNotNull(), F.size("ignored_names"))), F.lit(0)).alias("n_names"), F.sum("n_accepted").alias("a"), F.sum("n_rejected").alias("r"))
    return sums.select("source", "n_names", F.round(F.try_divide(F.col("r").cast("double"), (F.col("a") + F.col("r")).cast("double")), 6).alias("reject_share"))


@query("SELECT annotator_a, annotator_b, e.n_paired AS n_pilot, round(e.kappa, 6) AS kappa_pilot FROM kappa_results e WHERE upper(trim(annotator_a)) IN (SELECT annotator FROM lab) AND upper(trim(annotator_b)) IN (SELECT annotator FROM lab)", LABELS)
def pilot_agreement(spark, base):
    """The pilot's agreement of pairs whose annotators are still at work."""
    active = labels_of(spark, base).select("annotator").distinct()
    code = lambda c: labels.annotator_code(F.col(c))
    rows = table(spark, base, "kappa_results")
    for c in ("annotator_a", "annotator_b"):
        rows = rows.join(active, code(c) == F.col("annotator"), "left_semi")
    return rows.select("annotator_a", "annotator_b", F.col("n_paired").alias("n_pilot"), F.round("kappa", 6).alias("kappa_pilot"))



@query(
    """SELECT 'unknown_parent' AS kind, slug AS owner, parent_slug AS value FROM regions WHERE parent_slug IS NOT NULL AND parent_slug NOT IN (SELECT slug FROM regions)
UNION ALL SELECT 'unknown_source', slug, s FROM (SELECT slug, unnest(map_keys(source_aliases)) AS s FROM commodities) WHERE s NOT IN (SELECT source FROM normalize_reports)
UNION ALL SELECT 'undeclared_source', c.slug, s.source FROM commodities c, (SELECT DISTINCT source FROM normalize_reports) s WHERE NOT list_contains(map_keys(c.source_aliases), s.source)
UNION ALL SELECT 'name_of_two', source, alias FROM alias GROUP BY ALL HAVING count(DISTINCT slug) > 1""",
    ALIAS,
)
def reference_problems(spark, base):
    """What does not fit together in the lists; the sources are those that report."""
    sources = table(spark, base, "normalize_reports").select(F.col("source").alias("slug")).where("slug is not null").distinct()
    return reference.reference_problems(table(spark, base, "commodities"), table(spark, base, "regions"), sources)
