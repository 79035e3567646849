"""The days around labelling candidates: whole, right, and never unfolded into a broadcast."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from kisaran.operators import evaluate

CANDIDATES = "candidate_id bigint, commodity string, region string, obs_date date"
DAILY = "commodity string, region string, obs_date date, price double"


def tables(seed: int):
    """Series with gaps around the epoch and around today; candidates of all kinds."""
    rnd = random.Random(seed)
    daily, candidates = [], []
    for k, start in enumerate([date(1969, 11, 1), date(2024, 1, 1), date(2024, 1, 20)]):
        daily += [("c", f"r{k}", start + timedelta(days=i), rnd.randrange(100, 99999) / 100) for i in range(140) if rnd.random() < (0.95, 0.7, 0.3)[k]]
        candidates += [(1000 * k + i, "c", f"r{k}", start + timedelta(days=i)) for i in range(-40, 180)]
    candidates += [candidates[60], (5, "c", "r1", date(2024, 3, 1)), (5, "c", "r0", date(1970, 1, 1))]  # an id more than once
    candidates += [(9001, None, "r1", date(2024, 3, 1)), (9002, "c", "none", date(2024, 3, 1)), (9003, "c", "r1", None), (None, "c", "r1", date(2024, 3, 1))]
    return candidates, daily


def brute(candidates, daily, before: int, after: int):
    near = defaultdict(list)
    for i, c, r, d in candidates:
        near[i] += [(x, p) for dc, dr, x, p in daily if (dc, dr) == (c, r) and d is not None and -before <= (x - d).days <= after]
    return {i: sorted(x) for i, x in near.items()}


def broadcast_sides(df) -> list[str]:
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [side for line in plan.splitlines() if "BroadcastHashJoin" in line for side in ("BuildLeft", "BuildRight") if side in line]


@pytest.fixture
def long_daily(spark):
    """(few candidates, a daily table too large to broadcast)."""
    name = lambda c: F.col("id").cast("string").alias(c)
    candidates = spark.range(1000).select(F.col("id").alias("candidate_id"), name("commodity"), name("region"), F.lit(date(2024, 3, 1)).alias("obs_date"))
    return candidates, spark.range(5_000_000).select(name("commodity"), name("region"), F.lit(date(2024, 3, 1)).alias("obs_date"), F.lit(1.0).alias("price"))


@pytest.mark.parametrize("seed", range(2))
def test_baselines_against_brute_force(spark, seed):
    candidates, daily = tables(seed)
    got = evaluate.baselines(spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(daily, DAILY)).collect()
    want = brute(candidates, daily, 30, -1)
    assert len(got) == len(want)
    for r in got:
        prices = [p for _, p in want[r.candidate_id]]
        assert r.n_obs == len(prices)
        assert r.baseline == (pytest.approx(sum(prices) / len(prices)) if len(prices) >= 20 else None)


def test_baselines_do_not_broadcast_unfolded_candidates(long_daily):
    assert broadcast_sides(evaluate.baselines(*long_daily)) == []


@pytest.mark.parametrize("seed", range(2))
def test_context_windows_against_brute_force(spark, seed):
    candidates, daily = tables(seed)
    got = evaluate.context_windows(spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(daily, DAILY)).collect()
    assert len({r.candidate_id for r in got}) == len(got)
    assert {r.candidate_id: [tuple(x) for x in r.context] for r in got} == {i: x for i, x in brute(candidates, daily, 30, 14).items() if x}


def test_context_windows_do_not_broadcast_unfolded_candidates(long_daily):
    assert broadcast_sides(evaluate.context_windows(*long_daily)) == []
