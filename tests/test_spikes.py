from __future__ import annotations

import numpy as np
import pytest
from conftest import days

from kisaran.operators.control_chart import ChartParams, run_positions, spikes, stuck
from kisaran.operators.spikes import DRIFT, PRICE, SPREAD, flag_readings

P = ChartParams()
SCHEMA = "obs_id long, commodity_slug string, region string, source string, obs_date date, price_idr double, extra string"


def level(n=120, base=10_000.0, noise=0.01, seed=1):
    return base * np.exp(np.random.default_rng(seed).normal(0, noise, n))


def flagged(values):
    return np.flatnonzero(spikes(np.log(values), np.arange(len(values)), P))


def test_plain_noise_is_quiet():
    assert sum(len(flagged(level(seed=s))) for s in range(20)) <= 2


@pytest.mark.parametrize("factor", [1.3, 0.7, 5, 0.1])
@pytest.mark.parametrize("length", [1, 2, 3])
def test_spike_is_found(factor, length):
    x = level()
    x[60 : 60 + length] *= factor
    assert set(flagged(x)) == set(range(60, 60 + length))


def test_lasting_change_is_no_spike():
    x = level()
    x[60:] *= 1.4
    assert len(flagged(x)) == 0


def test_unrest_is_no_spike():
    rng = np.random.default_rng(3)
    x = 10_000 * np.exp(np.cumsum(rng.normal(0, 0.05, 200)))
    assert len(flagged(x)) <= 2


def test_short_series_is_not_judged():
    assert len(flagged(np.array([1.0, 100.0, 1.0, 1.0]))) == 0


def test_run_positions():
    pos, length = run_positions(np.array([5, 5, 3, 3, 3, 5]))
    assert pos.tolist() == [0, 1, 0, 1, 2, 0] and length.tolist() == [2, 2, 3, 3, 3, 1]


def test_stuck_against_habit():
    x = level(80)
    x[30:40] = x[30]
    assert np.flatnonzero(stuck(x, P)).tolist() == list(range(31, 40))
    habitual = np.repeat(level(30), 6)  # every value held six times
    assert not stuck(habitual, P).any()


def rows(prices, source="a", first=0):
    return [(first + i, "gula", "kota", source, d, float(p), "x") for i, (d, p) in enumerate(zip(days(len(prices)), prices))]


def found(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    return {(r.row_id, r.reason) for r in flag_readings(df, PRICE, **kw).collect()}


def test_flag_readings(spark):
    x = level()
    x[50] *= 3
    x[70] = -999.0
    x[90:100] = x[90]
    got = found(spark, rows(x))
    assert got == {(50, "spike"), (70, "impossible")} | {(i, "stuck") for i in range(91, 100)}


def test_repeated_rows_share_the_verdict_and_nulls_are_left_alone(spark):
    x = level()
    x[50] *= 3
    data = rows(x)
    data += [(1000, *data[50][1:]), (1001, "gula", "kota", "a", None, 5.0, None), (1002, "gula", "kota", "a", days(1)[0], None, None), (1003, None, None, None, days(1)[0], 9000.0, None)]
    assert found(spark, data) == {(50, "spike"), (1000, "spike")}


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_blocks_do_not_change_the_verdict(spark):
    x = level(600)
    for i in (100, 250, 301, 450):
        x[i] *= 1.8
    x[500:512] = x[500]
    whole = found(spark, rows(x))
    assert found(spark, rows(x), block=150, halo=120) == whole
    assert {i for i, r in whole if r == "spike"} == {100, 250, 301, 450}


def test_hot_source_is_judged_like_any_other(spark):
    hot, cold = level(300, seed=5), level(30, seed=6)
    hot[200] *= 2
    data = rows(hot) + [(5000 + i, *r[1:]) for i, r in enumerate(rows(hot))] + rows(cold, "b", 900)
    assert found(spark, data) == {(200, "spike"), (5200, "spike")}


def test_habit_is_taken_over_all_series_of_a_source(spark):
    """A source that holds prices for weeks: its long runs are no fault, in whatever
    series; the same run of a source that does not hold them is stuck."""
    rng = np.random.default_rng(9)
    data, stuck_ids = [], set()
    for k in range(12):
        held = 10_000 * np.exp(np.cumsum(rng.normal(0, 0.03, 40)))
        lengths = rng.choice([4, 5, 10, 15, 20], 40, p=[0.3, 0.4, 0.15, 0.1, 0.05])
        x = np.repeat(held, lengths)[:150]
        data += [(len(data) + i, f"g{k}", "kota", "holds", d, float(v), "x") for i, (d, v) in enumerate(zip(days(150), x))]
        y = level(150, seed=50 + k)
        if k == 3:
            y[60:75] = y[60]
            stuck_ids = {len(data) + i for i in range(61, 75)}
        data += [(len(data) + i, f"g{k}", "kota", "moves", d, float(v), "x") for i, (d, v) in enumerate(zip(days(150), y))]
    assert {i for i, r in found(spark, data) if r == "stuck"} == stuck_ids


def test_drift_and_spread(spark):
    drift = [(i, "gula", "kota", "a", r, v) for i, (r, v) in enumerate(zip(range(1, 10), [0.4, -0.2, 0.1, 22.0, 0.3, None, -250.0, 0.2, 0.1]))]
    df = spark.createDataFrame(drift, "offset_id long, commodity string, region string, source string, run_id long, ratio_drift_pct double")
    assert {(r.row_id, r.reason) for r in flag_readings(df, DRIFT).collect()} == {(3, "spike"), (6, "impossible")}
    s = np.random.default_rng(1).uniform(2, 4, 100)
    s[40], s[60] = 14.0, -0.0001
    spread = [(i, "gula", "kota", d, float(v)) for i, (d, v) in enumerate(zip(days(100), s))]
    df = spark.createDataFrame(spread, "point_id long, commodity string, region string, obs_date date, spread_pct double")
    assert {(r.row_id, r.reason) for r in flag_readings(df, SPREAD).collect()} == {(40, "spike"), (60, "impossible")}
