from __future__ import annotations

import random
from datetime import timedelta
from decimal import Decimal

import pytest
from conftest import days
from pyspark.sql import functions as F

from kisaran.operators.grid import regular_grid
from kisaran.operators.trailing import trailing_totals
from kisaran.operators.units import alias_unit, read_unit, to_common_units

D = days(400)


def test_grid_fills_and_marks(spark):
    data = [("g", "k", D[0], 1.0, 1, "x"), ("g", "k", D[0], 2.0, 2, "x"), ("g", "k", D[3], 5.0, 1, "x"), ("g", "k", D[14], 7.0, 1, "x"), ("g", "k", None, 9.0, 1, "x"), (None, None, D[1], 4.0, 1, "x")]
    df = spark.createDataFrame(data, "commodity string, region string, obs_date date, price double, v int, is_imputed string")
    got = {(r.commodity, r.obs_date): (r.price, r.is_imputed, r.imputation_method) for r in regular_grid(df, ["commodity", "region"], "obs_date", "price", version=["v"]).collect()}
    assert len(got) == 16
    assert got["g", D[0]] == (2.0, False, None)
    assert got["g", D[2]] == (2.0, True, "locf_2d")
    assert got["g", D[10]] == (5.0, True, "locf_7d")
    assert got["g", D[11]] == (None, True, "missing")
    assert got[None, D[1]] == (4.0, False, None)


def test_grid_of_nothing(spark):
    df = spark.createDataFrame([], "commodity string, region string, obs_date date, price double")
    assert regular_grid(df, ["commodity", "region"], "obs_date", "price").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_trailing_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data, by = [], {}
    for key in ("a", "b", None):
        start = rng.randrange(60)
        for i in range(start, start + rng.choice([1, 5, 40, 120])):
            if rng.random() < 0.6:
                v = None if rng.random() < 0.1 else Decimal(rng.randrange(-500, 500)) / 100
                data.append((key, D[i], v, "x"))
                by[key, D[i]] = v
    df = spark.createDataFrame(data, "k string, obs_date date, v decimal(10,2), _d string")
    windows = [3, 7, 30]
    got = {(r.k, r.obs_date): r for r in trailing_totals(df.drop("_d"), ["k"], "obs_date", {"v": windows}).collect()}
    for key in {k for k, _ in by}:
        own = sorted(d for k, d in by if k == key)
        span = [own[0] + timedelta(days=i) for i in range((own[-1] - own[0]).days + 1)]
        assert {d for k, d in got if k == key} == set(span)
        for d in span:
            for w in windows:
                vals = [by[key, e] for i in range(w) if (key, e := d - timedelta(days=i)) in by and by[key, e] is not None]
                row = got[key, d]
                assert row[f"v_days_{w}"] == len(vals)
                assert row[f"v_total_{w}"] == (sum(vals) if vals else None)


def test_trailing_of_nothing(spark):
    df = spark.createDataFrame([], "k string, obs_date date, v double")
    assert trailing_totals(df, ["k"], "obs_date", {"v": [7]}).count() == 0


@pytest.mark.parametrize(
    ("text", "first"),
    [
        ("dus isi 20 x 500 gr", (10_000.0, "gram", 1.0)), ("RIBU RP/KG", (1.0, "kg", 1000.0)), ("Rp000 per kg", (1.0, "kg", 1000.0)), ("rb/butir", (1.0, "butir", 1000.0)),
        ("sak@50kg", (50.0, "kg", 1.0)), ("½ kg", (0.5, "kg", 1.0)), ("1/2 lusin", (0.5, "lusin", 1.0)), ("rak isi 30", (30.0, "count", 1.0)), ("2,5 kg", (2.5, "kg", 1.0)),
        ("seperempat kilo", (0.25, "kg", 1.0)), ("per tumpuk", (1.0, "?", 1.0)), ("1.5 L", (1.5, "liter", 1.0)), ("sepuluh ikat", (10.0, "ikat", 1.0)), (" lt. ", (1.0, "liter", 1.0)),
    ],
)
def test_read_unit(text, first):
    assert read_unit(text)[0] == first


@pytest.mark.parametrize("text", [None, "", "  ", "."])
def test_no_unit(text):
    assert read_unit(text) == []


@pytest.mark.parametrize(("name", "unit"), [("Gula Aren (2,5 kg)", "2,5 kg"), ("Ubi,sak@50kg", "sak@50kg"), ("Tomat @½ kg", "½ kg"), ("Jagung per per gram", "per gram"), ("Telur Bebek", None), ("Kacang Tanah Biji", None), (None, None)])
def test_alias_unit(name, unit):
    assert alias_unit(name) == unit


def test_common_units(spark):
    goods = spark.createDataFrame([("gula", "kg"), ("telur", "butir"), ("minyak", "liter"), ("ikan", "kg")], "slug string, canonical_unit string")
    conv = spark.createDataFrame(
        [("gram", "kg", 0.001, 1000.0, None), ("lusin", "butir", 12.0, 0.083333, None), ("kg", "liter", 1.098901, 0.91, "minyak, lain"), ("ml", "liter", 0.001, 1000.0, None)],
        "from_unit string, to_unit string, amount double, price_factor double, applies_to string",
    )
    data = [
        (1, "gula", "k", 15_000.0, "kg", "Gula", 1.0), (2, "gula", "k", 7_500.0, "500 gr", "Gula", None), (3, "gula", "k", 150_000.0, "kg", "Gula, dus isi 20 x 500 gr", None),
        (4, "telur", "k", 30_000.0, "lusin", "Telur", None), (5, "minyak", "k", 20_000.0, "kg", "Minyak", None), (6, "gula", "k", 20_000.0, "ekor", "Gula", None),
        (7, "gula", "k", 15.0, None, "Gula, rb/kg", None), (8, "gula", "k", None, "kg", "Gula", None), (9, None, "k", 1.0, "kg", None, None), (10, "gula", "k", 15_000.0, None, None, None),
        (11, "gula", "k", 15_000.0, "liter", "Gula", None), (12, "ikan", None, 9_000.0, "4 x 250 gram", "Ikan", None), (13, "gula", "k", 15_000.0, "pak 4 x 250 gram", "Gula", None),
    ]
    obs = spark.createDataFrame(data, "obs_id long, commodity_slug string, region string, price_idr double, raw_unit string, matched_alias string, unit_factor double").withColumn("_row", F.lit(1))
    got = {r.obs_id: (r.canonical_unit, r.price_canonical) for r in to_common_units(obs, goods, conv).collect()}
    assert got == {
        2: ("kg", 15_000), 3: ("kg", 15_000), 4: ("butir", 2_500), 5: ("liter", 18_200), 6: ("kg", None), 7: ("kg", 15_000), 11: ("kg", None), 12: ("kg", 9_000), 13: ("kg", 15_000),
    }
    assert to_common_units(obs.limit(0), goods, conv).count() == 0


def test_all_measures_have_both_windows(spark):
    """Days below every threshold too, for the price, the demand and the change."""
    from kisaran.plans import problems, registry

    base = "/root/testdata/sf0.001"
    got = {(r.measure, r.commodity, r.region, r.obs_date): r for r in registry.QUERIES["p6_totals"](spark, base).collect()}
    rows = problems._fused(spark, base).collect()
    for name in ("demand_z52", "pct_change_7d"):
        value = {(r.commodity, r.region, r.obs_date): r[name] for r in rows}
        for c, k, d in list(value)[::50]:
            for w in (7, 30):
                seen = [v for i in range(w) if (v := value.get((c, k, d - timedelta(days=i)))) is not None]
                r = got[(name, c, k, d)]
                assert r[f"days_{w}d"] == len(seen) and (r[f"total_{w}d"] is None) == (not seen)
                if seen:
                    assert r[f"total_{w}d"] == pytest.approx(float(sum(seen))) and r[f"mean_{w}d"] == pytest.approx(float(sum(seen)) / len(seen), abs=1e-8)
    assert {m for m, *_ in got} == {"price_median", "demand_z52", "pct_change_7d"}
