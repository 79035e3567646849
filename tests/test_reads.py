from __future__ import annotations

import json
from datetime import date

import pytest
from conftest import days
from pyspark.sql import functions as F

from kisaran.operators import boards, cells, evaluate, fusion, kmeans, normalize
from kisaran.sources import reference
from kisaran.streaming import ingest

D = days(200)


def documents(tmp_path, **changes):
    docs = {
        "commodities": {"commodities": [{"slug": "gula", "display_name": "Gula", "canonical_unit": "kg", "sort_order": 1, "plausible_price": {"min": 5, "max": 9}, "source_aliases": {"a": ["Gula  Pasir"]}, "unavailable_at": ["b"]}]},
        "regions": {"regions": [{"slug": "n", "level": "national"}, {"slug": "p", "level": "province", "parent_slug": "n"}]},
        "sources": {"sources": [{"slug": "a", "regions": ["p"]}, {"slug": "b", "regions": ["n"]}, {"slug": "c", "regions": [], "is_active": False}]},
        "units": {"aliases": {"kg": ["kg", "kilo"]}, "conversions": [{"from": "kg", "to": "liter", "factor": 0.91, "applies_to": ["minyak"]}]},
    }
    docs |= changes
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    return str(tmp_path)


def test_reference_is_read(spark, tmp_path):
    frames = reference.load_reference(spark, documents(tmp_path))
    assert frames["commodities"].collect()[0].max_price == 9.0 and frames["units"].count() == 2
    reference.require_sound(*(frames[n] for n in ("commodities", "regions", "sources")))


def test_reference_problems_are_told(spark, tmp_path):
    bad = {
        "commodities": {"commodities": [{"slug": "x", "source_aliases": {"a": ["Same"], "zz": ["y"]}, "unavailable_at": ["a"]}, {"slug": "y", "source_aliases": {"a": ["same"]}}]},
        "regions": {"regions": [{"slug": "p", "level": "city", "parent_slug": "gone"}]},
        "sources": {"sources": [{"slug": "a", "regions": ["q"]}, {"slug": "b", "regions": []}]},
    }
    f = reference.load_reference(spark, documents(tmp_path, **bad))
    got = {tuple(r) for r in reference.reference_problems(f["commodities"], f["regions"], f["sources"]).collect()}
    assert got == {
        ("unknown_parent", "p", "gone"), ("unknown_region", "a", "q"), ("unknown_source", "x", "zz"), ("named_and_unavailable", "x", "a"),
        ("undeclared_source", "x", "b"), ("undeclared_source", "y", "b"), ("name_of_two", "a", "same"),
    }
    with pytest.raises(ValueError, match="unknown_parent"):
        reference.require_sound(f["commodities"], f["regions"], f["sources"])


def gated(spark, n, seed=0):
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = [("g", f"k{i}", date(2024, 1, 1), float(abs(rng.normal((0.005, 0.05, 0.1)[i % 3], 0.001))), float(rng.normal((0.0, 0.2, 0.6)[i % 3], 0.01)), None) for i in range(n)]
    rows += [("g", "bad", date(2024, 1, 1), None, 0.5, "stale_dominated")]
    return spark.createDataFrame(rows, "commodity string, region string, period_month date, volatility double, cum_change double, quality_reason string")


def test_a_whole_clustering_run(spark):
    rows, clusters = cells.fit_zones(gated(spark, 60), ks=(2, 3, 4), restarts=4)
    zone = {r.region: r.zone for r in rows.collect()}
    assert len(zone) == 61 and zone["bad"] is None
    assert {zone[f"k{i}"] for i in range(0, 60, 3)} == {"hijau"} and {zone[f"k{i}"] for i in range(2, 60, 3)} == {"merah"} and {zone[f"k{i}"] for i in range(1, 60, 3)} == {"kuning"}
    assert sorted((r.n_cells, r.zone) for r in clusters.collect()) == [(20, "hijau"), (20, "kuning"), (20, "merah")]


def test_too_few_cells_are_not_clustered(spark):
    rows, clusters = cells.fit_zones(gated(spark, 10))
    assert {r.quality_reason for r in rows.collect()} == {"too_few_cells", "stale_dominated"} and clusters.count() == 0


def test_best_k_takes_the_least_on_ties():
    assert kmeans.best_k({2: (9.0, 0.5, None), 3: (5.0, 0.7, None), 4: (4.0, 0.7, None)}) == 3
    assert kmeans.best_k({}) is None


def test_single_source_series_are_covered_by_one(spark):
    rows = [("g", "k", "a", D[0], 1.0), ("g", "k", "a", D[1], 1.0), ("g", "m", "a", D[0], 1.0), ("g", "m", "b", D[5], 1.0)]
    obs = spark.createDataFrame(rows, "commodity string, region string, source string, obs_date date, price double")
    assert {r.region: r.single_source_coverage for r in fusion.source_coverage(obs).collect()} == {"k": True, "m": False}


def test_the_newest_day_is_open(spark):
    df = spark.createDataFrame([(d,) for d in D[:5]], "obs_date date")
    assert ingest.settled_before(df, "obs_date").count() == 4
    assert ingest.settled_before(df, "obs_date", str(D[2])).count() == 2
    assert ingest.settled_before(df.limit(0), "obs_date").count() == 0


def test_conversion_factors(spark):
    goods = spark.createDataFrame([("gula", "kg"), ("minyak", "liter")], "slug string, canonical_unit string")
    rules = spark.createDataFrame([("gram", "kg", 0.001, None), ("kg", "liter", 1.1, "minyak, lain")], "from_unit string, to_unit string, amount double, applies_to string")
    rows = [("gula", " Gram "), ("gula", None), ("gula", "liter"), ("minyak", "KG"), (None, "kg")]
    got = normalize.conversion_factors(spark.createDataFrame(rows, "commodity_slug string, raw_unit string"), goods, rules)
    assert {(r.commodity_slug, r.unit): r.factor for r in got.collect()} == {("gula", "gram"): 0.001, ("gula", "kg"): 1.0, ("gula", "liter"): None, ("minyak", "kg"): 1.1, (None, "kg"): None}


def test_sus_score(spark):
    df = spark.createDataFrame([(5, 1) * 5, (3,) * 10, (1, 5) * 5, (None,) + (3,) * 9], ", ".join(f"q{i} int" for i in range(10)))
    assert [r[0] for r in df.select(boards.sus_score([F.col(f"q{i}") for i in range(10)])).collect()] == [100.0, 50.0, 0.0, None]


def test_detail_takes_the_last_observed_rows(spark):
    daily = spark.createDataFrame([("g", "k", d, 10.0 + i if i % 2 else None, False) for i, d in enumerate(D)], "commodity string, region string, obs_date date, price_median double, is_imputed boolean")
    rows = boards.detail(daily, days=10, rows=3).collect()
    assert len(rows) == 10 and {r.mean_recent for r in rows} == {(209 + 207 + 205) / 3}


def test_pool_is_cleared_only_without_labels(spark):
    pool = spark.createDataFrame([(1,), (2,)], "candidate_id int")
    with pytest.raises(ValueError):
        evaluate.clear_pool(pool, spark.createDataFrame([(2,)], "candidate_id int"))
    assert evaluate.clear_pool(pool, spark.createDataFrame([(7,)], "candidate_id int")).count() == 0
