from __future__ import annotations

import inspect
from datetime import timedelta

import numpy as np
import pytest
from conftest import days
from pyspark.sql import functions as F

from kisaran.functions.expressions import parse_price, unit_of_name
from kisaran.operators import cells, detectors, evaluate, fusion, iforest, kmeans, labels, linking, runs, seasonal
from kisaran.plans import registry
from kisaran.sources import payloads, sinks
from kisaran.streaming import ingest

D = days(1200)
OBS = "commodity string, region string, source string, obs_date date, price double"


def obs(spark, rows):
    return spark.createDataFrame([("g", "k", s, d, float(p)) for s, d, p in rows], OBS)


# ---- linking


def overlap(n, ratio, solo=5):
    return [("aaa", d, 100.0) for d in D[: n + solo]] + [("bbb", d, 100.0 / ratio) for d in D[:n]]


def test_factor_and_reference(spark):
    got = {r.source: r for r in linking.source_offsets(obs(spark, overlap(40, 1.25))).collect()}
    assert got["bbb"].reference == "aaa" and got["bbb"].factor == pytest.approx(1.25) and got["bbb"].n_overlap == 40
    assert got["aaa"].factor == 1.0 and got["aaa"].n_overlap == 45 and got["aaa"].ratio_drift_pct is None


def test_tie_goes_to_the_smaller_name(spark):
    assert {r.reference for r in linking.reference_sources(obs(spark, overlap(30, 1.0, solo=0))).collect()} == {"aaa"}


def test_short_overlap_is_excluded(spark):
    got = {r.source: r for r in linking.source_offsets(obs(spark, overlap(29, 2.0))).collect()}
    assert got["bbb"].factor == 1.0 and "29" in got["bbb"].excluded_reason


def test_drift_and_one_bad_ratio(spark):
    rows = [("aaa", d, 100.0 if i < 30 else 120.0) for i, d in enumerate(D[:60])] + [("bbb", d, 100.0) for d in D[:60]] + [("aaa", D[60], 100.0)]
    assert {r.source: r for r in linking.source_offsets(obs(spark, rows)).collect()}["bbb"].ratio_drift_pct == pytest.approx(20.0)
    bad = overlap(40, 1.25)
    bad[50] = ("bbb", bad[50][1], 80_000.0)
    assert {r.source: r for r in linking.source_offsets(obs(spark, bad)).collect()}["bbb"].factor == pytest.approx(1.25)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([100, None, None, 400], [100, 200, 300, 400]), ([100, None, None, None, 500], [100, 200, 300, 400, 500]), ([100, None, None, None, None, 500], [100, None, None, None, None, 500]),
        ([None, 100, None], [None, 100, None]),
    ],
)
def test_gaps(spark, given, want):
    daily = spark.createDataFrame([("g", "k", d, p if p is None else float(p)) for d, p in zip(D, given)], "commodity string, region string, obs_date date, price_median double")
    got = linking.interpolate(daily).orderBy("obs_date").collect()
    assert [r.price_median for r in got] == [w if w is None else float(w) for w in want]
    assert [r.imputation_method for r in got] == [None if g is not None or w is None else f"linear_{given.count(None)}d" for g, w in zip(given, want)]


def test_reconcile(spark):
    r = linking.reconcile(obs(spark, [("a", D[0], 10_000), ("b", D[0], 10_100), ("c", D[0], 14_000)])).collect()[0]
    assert r.price_median == 10_100 and r.spread_pct == pytest.approx(4000 / 10_100 * 100)


def test_daily_series_of_nothing(spark):
    assert linking.daily_series(spark.createDataFrame([], OBS)).count() == 0


# ---- detectors


def prices(spark, values, start=0):
    return spark.createDataFrame([("g", "k", d, float(p)) for d, p in zip(D[start:], values)], "commodity string, region string, obs_date date, price double")


def wave(n=400, seed=20260729):
    return 15_000 * (1 + np.random.default_rng(seed).normal(0, 0.004, n))


def test_zscore_flags_a_spike_and_little_else(spark):
    x = wave()
    x[200] *= 1.6
    rows = detectors.zscore(prices(spark, x)).collect()
    assert len(rows) == 400
    flags = [r.obs_date for r in rows if r.is_flagged]
    assert D[200] in flags and len(flags) < 20


def test_zscore_constant_baseline_is_not_judged(spark):
    rows = detectors.zscore(prices(spark, [10_000] * 59 + [20_000])).collect()
    assert all(r.raw_score is None and r.norm_score is None and not r.is_flagged for r in rows)


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([("g", "k", d, v) for d, v in zip(D, [3.0, 1.0, 3.0, None, 2.0])], "commodity string, region string, obs_date date, v double")
    got = {r.obs_date: r.norm_score for r in detectors.percentile_rank(df, F.col("v")).collect()}
    assert [got[d] for d in D[:5]] == [0.875, 0.25, 0.875, None, 0.5]


def test_weekly_z_needs_all_points(spark):
    weeks = [("g", "k", D[7 * i], float(50 + i % 2)) for i in range(52)] + [("g", "k", D[7 * 52], 100.0)]
    df = spark.createDataFrame(weeks, "commodity string, region string, week_start date, v double")
    got = detectors.weekly_z(df, "v").orderBy("week_start").collect()
    assert [r.z52 for r in got[:52]] == [None] * 52 and got[52].z52 == pytest.approx((100 - 50.5) / 0.5)


def test_iforest(spark):
    x = wave()
    for i, f in ((120, 1.7), (220, 0.55), (320, 1.7)):
        x[i] *= f
    feats = detectors.feature_matrix(prices(spark, x))
    rows = iforest.isolate(feats, trees=60).collect()
    raw = {r.obs_date: r.raw_score for r in rows}
    assert len(rows) == 400 and sum(v is None for v in raw.values()) == 7
    flags = {r.obs_date for r in rows if r.is_flagged}
    assert {D[120], D[220], D[320]} <= flags and len(flags) <= 0.04 * 400
    assert raw == {r.obs_date: r.raw_score for r in iforest.isolate(feats, trees=60).collect()}
    assert all(-1 <= v <= 0 for v in raw.values() if v is not None)
    short = iforest.isolate(detectors.feature_matrix(prices(spark, x[:50])), trees=10).collect()
    assert all(r.raw_score is None and not r.is_flagged and r.threshold_used is None for r in short)


def test_as_of(spark):
    right = spark.createDataFrame([("g", "k", D[3], 1.0), ("g", "k", D[8], None), ("g", "k", D[10], 2.0)], "commodity string, region string, week_start date, v double")
    got = {r.obs_date: r.v for r in detectors.as_of(prices(spark, [1.0] * 12), right, "week_start", "v").collect()}
    assert [got[d] for d in D[:12]] == [None] * 3 + [1.0] * 7 + [2.0] * 2


# ---- cells, clusters, seasons


def test_stale_runs_cross_months(spark):
    x = [100.0 + i for i in range(25)] + [200.0] * 12 + [300.0 + i for i in range(20)]
    daily = prices(spark, x).withColumn("is_imputed", F.lit(False))
    assert sum(r.is_stale for r in cells.stale_runs(daily).collect()) == 12


def test_gate_order(spark):
    rows = [(10, 1, 0.9, 0.1, 0.1), (20, 2, 0.9, 0.1, 0.1), (20, 9, 0.5, 0.1, 0.1), (20, 9, 0.1, None, 0.1), (20, 9, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "real_obs int, distinct_real int, stale_fraction double, volatility double, cum_change double")
    assert [r.quality_reason for r in cells.gate(df).collect()] == ["insufficient_real_observations", "insufficient_distinct_values", "stale_dominated", "features_uncomputable", None]


def test_zone_map(spark):
    def zones(rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cluster_id int, volatility double, cum_change double")
        return {r.cluster_id: r.zone for r in cells.zone_map(df).collect()}

    assert zones([(0.08, 0.60), (0.005, -0.01), (0.03, 0.10)]) == {0: "merah", 1: "hijau", 2: "kuning"}
    assert zones([(0.005, -0.60), (0.03, 0.10)])[0] == "hijau"  # a fall is no severity
    assert sorted(zones([(0.01 * i, 0.1 * i) for i in range(5)]).values()) == ["hijau", "kuning", "kuning", "kuning", "merah"]


def test_kmeans_and_silhouette(spark):
    rng = np.random.default_rng(11)
    pts = np.vstack([rng.normal((0, 0), 0.1, (60, 2)), rng.normal((5, 5), 0.1, (40, 2)), rng.normal((0, 5), 0.1, (30, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, a double, b double")
    grid = kmeans.fit_grid(df, ["a", "b"], [2, 3, 4], restarts=6)
    assert grid[4][0] <= grid[3][0] <= grid[2][0]
    labelled = kmeans.assign(df, ["a", "b"], grid[3][1])
    assert sorted(r["count"] for r in labelled.groupBy("cluster_id").count().collect()) == [30, 40, 60]
    got = {r.id: (r.cluster_id, r.silhouette) for r in kmeans.silhouette(labelled, ["a", "b"], "cluster_id", block=37).collect()}
    lab = np.array([got[i][0] for i in range(len(pts))])
    dist = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    for i in range(0, len(pts), 17):
        own = dist[i][lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        near = min(dist[i][lab == c].mean() for c in set(lab) - {lab[i]})
        assert got[i][1] == pytest.approx((near - own) / max(near, own))


def test_kmeans_runs_until_it_stands_still(spark):
    """Evenly spread points move the centres for far more than 30 passes."""
    df = spark.range(3000).select((F.col("id") / 100.0).alias("a"))
    (inertia, centres), = kmeans.fit_grid(df, ["a"], [8], restarts=2).values()
    x, c = np.arange(3000) / 100.0, np.sort(centres[:, 0])
    at = np.abs(x[:, None] - c[None]).argmin(axis=1)
    assert np.allclose([x[at == i].mean() for i in range(8)], c, atol=1e-5)
    assert inertia == pytest.approx(((x - c[at]) ** 2).sum())
    with pytest.warns(RuntimeWarning, match="still moved"):
        kmeans.fit_grid(df, ["a"], [8], restarts=2, passes=2)


def test_kmeans_starts_and_ks_come_from_all_rows(spark):
    """30,000 equal rows and three far ones, which a sample of 20,000 rows can miss."""
    rows = spark.range(30003).select(F.when(F.col("id") < 30000, 0.0).otherwise(F.col("id") * 10.0).alias("a"))
    got = kmeans.fit_grid(rows, ["a"], [2, 3, 4, 5], restarts=3)
    assert sorted(got) == [2, 3, 4] and got[4][0] == pytest.approx(0.0, abs=1e-3)


@pytest.mark.parametrize(("name", "settings"), [("kmeans_search", {"restarts": 50, "passes": 300})])
def test_registered_searches_are_whole(spark, monkeypatch, name, settings):
    seen = {}
    monkeypatch.setattr(kmeans, "fit_grid", lambda *a, **k: seen.update(k) or {2: (0.0, np.zeros((2, 2)))})
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == settings


def test_stl_sums_up_and_finds_the_peak():
    n = 160
    t = np.arange(n)
    y = 100 + 0.2 * t + 10 * np.exp(-((t % 52 - 10) ** 2) / 8) + np.random.default_rng(0).normal(0, 0.5, n)
    trend, season, rest = seasonal.stl(y)
    assert np.allclose(trend + season + rest, y)
    assert int(np.argmax(season[:52])) in (9, 10, 11)


def test_short_series_has_no_season(spark):
    weeks = seasonal.weekly(prices(spark, wave(300)))
    assert seasonal.decompose(weeks).count() == 0
    assert "104" in seasonal.history(weeks).collect()[0].skip_reason


# ---- fusion


def fused(spark, **over):
    row = {"commodity": "g", "region": "k", "obs_date": D[0], "norm_zscore": None, "norm_iforest": None, "zscore_flagged": None, "iforest_flagged": None, "pct_change_7d": None, "demand_z52": None, "n_sources_reporting": 0, "n_sources_flagging": 0, "single_source_coverage": False} | over
    schema = "commodity string, region string, obs_date date, norm_zscore double, norm_iforest double, zscore_flagged boolean, iforest_flagged boolean, pct_change_7d double, demand_z52 double, n_sources_reporting int, n_sources_flagging int, single_source_coverage boolean"
    return fusion.fuse(spark.createDataFrame([tuple(row.values())], schema)).collect()[0]


def test_worked_example(spark):
    full = {"norm_zscore": 0.739792, "norm_iforest": 0.981668, "zscore_flagged": True, "iforest_flagged": True, "pct_change_7d": -0.2524, "n_sources_reporting": 2, "n_sources_flagging": 2}
    r = fused(spark, **full)
    assert r.fusion_score == pytest.approx(0.80) and r.level == "siaga" and r.components.reason is None
    assert fused(spark, **full | {"single_source_coverage": True}).components.reason == "single_source_coverage"
    assert fused(spark, **full | {"n_sources_reporting": 1, "n_sources_flagging": 1}).components.reason == "single_source_reporting"
    held = fused(spark, **full | {"n_sources_reporting": 5})
    assert held.level == "waspada" and held.components.reason == "insufficient_corroboration"


def test_unjudged_is_not_calm(spark):
    r = fused(spark)
    assert r.fusion_score is None and r.level == "belum_dapat_dinilai"


def test_perturbed_weights_sum_to_one():
    vectors = fusion.perturbed_weights()
    assert len(vectors) == 9 and all(sum(w.values()) == pytest.approx(1) for _, w in vectors)


# ---- evaluation


def kappa(spark, pairs):
    return evaluate.cohen_kappa(spark.createDataFrame(pairs, "label_a string, label_b string")).collect()[0]


def test_kappa(spark):
    chance = [("a", "a")] * 81 + [("a", "b")] * 9 + [("b", "a")] * 9 + [("b", "b")]
    assert kappa(spark, chance).kappa == pytest.approx(0)
    assert kappa(spark, [("a", "a")] * 50).kappa == 0
    assert kappa(spark, [("a", "b"), ("b", "a")]).kappa == pytest.approx(-1)
    empty = kappa(spark, [])
    assert empty.n_paired == 0 and empty.kappa is None


def test_event_matching(spark):
    events = spark.createDataFrame([(1, "g", "k", D[10], D[12]), (2, "g", "k", D[40], D[40])], "event_id long, commodity string, region string, start_date date, end_date date")
    hits = spark.createDataFrame([("m", "g", "k", D[i]) for i in (7, 11, 15, 16, 6)] + [("m", "other", "k", D[11])], "method string, commodity string, region string, obs_date date")
    matched, found = evaluate.match_events(hits, events)
    assert sorted((r.obs_date, r.hit) for r in matched.where("commodity = 'g'").collect()) == [(D[6], False), (D[7], True), (D[11], True), (D[15], True), (D[16], False)]
    assert {r.event_id: r.found for r in found.collect()} == {1: True, 2: False}
    m = evaluate.precision_recall(matched, evaluate.event_days(events)).collect()[0]
    assert (m.tp, m.fp, m.fn) == (3, 3, 1) and m.precision == 0.5 and m.recall == 0.75


def test_compare_runs(spark):
    s = "k int, v double"
    left = spark.createDataFrame([(1, 0.1234561), (2, None), (3, 0.5), (4, 1.0)], s)
    right = spark.createDataFrame([(1, 0.1234562), (2, float("nan")), (3, 0.500001), (5, 1.0)], s)
    assert tuple(evaluate.compare_runs(left, right, ["k"], "v").collect()[0]) == (2, 1, 1, 1)


# ---- text, payloads, sinks, streaming, runs


@pytest.mark.parametrize(
    ("text", "style", "want"),
    [
        ("12.508", "id", 12508.0), ("Rp. 141.940", "id", 141940.0), ("12.508,50", "id", 12508.5), ("0,91", "id", 0.91), ("16,200", "id", 16.2), ("16,200", "en", 16200.0), ("16,200.50", "en", 16200.5),
        ("16.2", "id", 16.2), ("tidak ada data", "id", None), ("", "id", None), (None, "id", None),
    ],
)
def test_parse_price(spark, text, style, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_price(F.col("t"), style)).collect()[0][0] == want


def test_unit_of_name(spark):
    df = spark.createDataFrame([("Cabai Merah,1 kg",), ("Minyak, 1 lt",), ("Telur",), (None,)], "t string")
    assert [r[0] for r in df.select(unit_of_name(F.col("t"))).collect()] == ["1 kg", "1 lt", None, None]


def test_json_grid(spark):
    body = '{"data": [{"name": "Beras", "level": 1, "01/02/2024": "9"}, {"name": "Gula", "level": 2, "01/02/2024": "12.500", "02/02/2024": "-", "03/02/2024": "0", "no": "7"}]}'
    df = spark.createDataFrame([("x", body), ("y", "no json"), ("z", None)], "id string, body string")
    assert [(r.id, r.name, str(r.obs_date), r.price) for r in payloads.json_grid(df, "body", ["id"]).collect()] == [("x", "Gula", "2024-02-01", 12500.0)]


def test_html_table(spark):
    row = "<tr><td>1</td><td> - Gula Pasir</td><td>kg</td><td>1</td><td class='kolom sekarang'>{}</td></tr>"
    html = "<table>" + row.format("15.000") + row.format("0") + "<tr><td>- x</td></tr></table>"
    got = payloads.html_table(spark.createDataFrame([("p", html), ("q", None)], "id string, html string"), "html", ["id"]).collect()
    assert [(r.id, r.name, r.price) for r in got] == [("p", "Gula Pasir", 15000.0)]


def test_date_chunks_cover_exactly(spark):
    df = spark.createDataFrame([(D[0], D[99]), (D[5], D[5]), (D[9], D[3])], "a date, b date")
    got = payloads.date_chunks(df, "a", "b", 30).orderBy("a", "chunk_start").collect()
    seen = [c.chunk_start + timedelta(days=i) for c in got if c.a == D[0] for i in range((c.chunk_end - c.chunk_start).days + 1)]
    assert seen == D[:100] and len(got) == 5


def test_upsert_is_idempotent(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, p string, v double, at int"
    first = spark.createDataFrame([(1, "a", 1.0, 1), (2, "b", 2.0, 1), (2, "b", 2.5, 2)], schema)
    second = spark.createDataFrame([(2, "b", 9.0, 3), (3, "c", 3.0, 1)], schema)
    for batch in (first, second, second):
        sinks.upsert(batch, path, ["k", "p"], "at", partition="p")
    rows = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    assert rows == [(1, 1.0), (2, 9.0), (3, 3.0)]
    assert sinks.append_missing(spark.createDataFrame([(3, "c", 0.0, 0), (4, "d", 0.0, 0)], schema), path, ["k"]) == 1


def test_latex_and_markdown(spark):
    df = spark.createDataFrame([("a_b & 5%", None, 1.5)], "t string, n int, v double")
    text = sinks.to_latex(df)
    assert r"a\_b \& 5\% & -- & 1.5000" in text and "{lrr}" in text
    assert "| a_b & 5% |  | 1.5 |" in sinks.to_markdown([("x", df)])


def test_streamed_upsert(spark, tmp_path):
    schema = "k int, v double, at int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(1, 1.0, 1), (2, 2.0, 1)], [(2, 5.0, 2)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.upsert_stream(stream, out, ["k"], "at", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, 1.0), (2, 5.0)]


def test_runs(spark):
    with runs.run(1, "analyse", 7, window=45) as good:
        pass
    with pytest.raises(ValueError), runs.run(2, "analyse", 7) as bad:
        raise ValueError("x")
    assert good.status == "success" and bad.status == "failed"
    table = good.frame(spark).unionByName(bad.frame(spark))
    assert runs.latest_run(table, "analyse").collect()[0].run_id == 1
    assert runs.latest_run(table, "other").count() == 0


@pytest.mark.parametrize("name", ["iforest_scores", "contamination_overlap"])
def test_registered_forests_have_all_trees(spark, monkeypatch, name):
    used = []

    def spy(whole):
        def seen(*a, **k):
            bound = inspect.signature(whole).bind(*a, **k)
            bound.apply_defaults()
            used.append(bound.arguments["trees"])
            return whole(*a, **k)

        return seen

    for f in ("isolate", "flag_sets"):
        monkeypatch.setattr(iforest, f, spy(getattr(iforest, f)))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert used == [200]


def test_flag_sets_are_the_flags_of_each_contamination(spark):
    feats = detectors.feature_matrix(prices(spark, wave()))
    sets = iforest.flag_sets(feats, [0.01, 0.05], trees=20).collect()
    for c in (0.01, 0.05):
        one = {r.obs_date for r in iforest.isolate(feats, trees=20, contamination=c).collect() if r.is_flagged}
        assert one and one == {r.obs_date for r in sets if r.contamination == str(c)}
    assert iforest.flag_sets(feats.limit(10), [0.05], trees=5).count() == 0


@pytest.mark.parametrize("n", [80, 400])
def test_paths_are_those_of_trees_grown_one_by_one(n):
    """Mean path lengths against trees grown by plain recursion."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n), np.arange(n) % 3, np.zeros(n)])
    x[7] *= 6
    size = min(256, n)
    limit = int(np.ceil(np.log2(size)))

    def walk(train, rows, depth, out):
        varies = np.flatnonzero(train.max(axis=0) > train.min(axis=0)) if len(train) > 1 else []
        if depth == limit or len(varies) == 0:
            out[rows] += depth + float(iforest.average_path(len(train)))
            return
        f = rng.choice(varies)
        cut = rng.uniform(train[:, f].min(), train[:, f].max())
        low = x[rows, f] <= cut
        walk(train[train[:, f] <= cut], rows[low], depth + 1, out)
        walk(train[train[:, f] > cut], rows[~low], depth + 1, out)

    plain = np.zeros(n)
    for _ in range(400):
        walk(x[rng.permutation(n)[:size]], np.arange(n), 0, plain)
    fast = iforest.path_sums(x, 400, size, np.random.default_rng(5))
    assert abs(fast.mean() - plain.mean()) / 400 < 0.15 and np.abs(fast - plain).max() / 400 < 0.8
    assert fast.argmin() == plain.argmin() == 7


def test_every_pair_and_every_queue(spark):
    t = "candidate_id bigint, annotator_code string, label string, labeled_at int, label_id bigint"
    rows = [(1, "a1", "normal", 1, 1), (1, "a1", "anomaly", 2, 2), (1, "B2", "nrml", 1, 3), (1, "c3", "ragu-ragu", 1, 4), (2, "b2", "Normal.", 1, 5), (2, "c3", "normal", 1, 6), (2, "d4", "?", 1, 7)]
    raw = spark.createDataFrame(rows, t)
    told = labels.usable_labels(raw)
    pairs = labels.label_pairs(told)
    assert sorted(map(tuple, pairs.collect())) == [(1, "A1", "anomali", "B2", "normal"), (1, "A1", "anomali", "C3", "ragu"), (1, "B2", "normal", "C3", "ragu"), (2, "B2", "normal", "C3", "normal")]
    got = {(r.annotator_a, r.annotator_b): (r.n_paired, r.observed_agreement, r.kappa) for r in labels.pair_kappas(pairs).collect()}
    assert got == {("A1", "B2"): (1, 0.0, 0.0), ("A1", "C3"): (1, 0.0, 0.0), ("B2", "C3"): (2, 0.5, 0.0)}
    codes = raw.select(labels.annotator_code(F.col("annotator_code")).alias("annotator")).distinct()
    left = labels.queues(spark.range(1, 4).toDF("candidate_id"), told, codes)
    assert sorted(map(tuple, left.collect())) == [("A1", 2), ("A1", 3), ("B2", 3), ("C3", 3), ("D4", 1), ("D4", 2), ("D4", 3)]


def test_registered_decomposition_is_whole(spark, monkeypatch):
    used = []
    whole = inspect.signature(seasonal.decompose)

    def seen(*a, **k):
        bound = whole.bind(*a, **k)
        bound.apply_defaults()
        used.append((bound.arguments["seasonal"], bound.arguments["outer"]))

    monkeypatch.setattr(seasonal, "decompose", seen)
    registry.QUERIES["stl_components"](spark, "/root/testdata/sf0.001")
    assert used == [(13, 15)]
