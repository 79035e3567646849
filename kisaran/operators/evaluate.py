"""Candidates, agreement, event matching, detector arms and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["commodity", "region"]
KEY = [*SERIES, "obs_date"]


def seeded_order(seed: int, *columns: str) -> Column:
    """A pseudo-random order that any engine reproduces."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sample_groups(df: DataFrame, group: list[str], per_group: int, seed: int, identity: list[str]) -> DataFrame:
    """``per_group`` rows of each group in seeded order."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(seeded_order(seed, *identity), *identity))
    return df.withColumn("_r", rank).where(F.col("_r") <= per_group).drop("_r")


def tag_candidates(scored: DataFrame, z_limit: float = 1.5, move_limit: float = 0.07) -> DataFrame:
    """Stratum of each scored day: rule_flagged if its z-score or its change over 7
    days exceeds the limit, else random_control."""
    hit = (F.abs(F.coalesce("raw_score", F.lit(0.0))) > z_limit) | F.coalesce(F.abs("pct_change_7d") > move_limit, F.lit(False))
    return scored.withColumn("sampling_stratum", F.when(hit, "rule_flagged").otherwise("random_control"))


def candidate_pool(tagged: DataFrame, size: int = 400, control_share: float = 0.3, seed: int = 20260729) -> DataFrame:
    """The labelling pool: flagged days up to size / (1 + share), and a share of
    controls to the flagged days that were taken; ``shuffle_key`` orders it blindly."""
    most = int(size / (1 + control_share))
    order = seeded_order(seed, *KEY)
    rank = F.row_number().over(Window.partitionBy("sampling_stratum").orderBy("_o", *KEY))
    ranked = tagged.withColumn("_o", order).withColumn("_r", rank).where(F.col("_r") <= most)
    taken = ranked.agg(F.count_if(F.col("sampling_stratum") == "rule_flagged").alias("_n"))
    pool = ranked.withColumn("_n", taken.scalar()).where((F.col("sampling_stratum") == "rule_flagged") | (F.col("_r") <= F.floor(F.col("_n") * control_share)))
    key = F.conv(F.substring("_o", 1, 8), 16, 10).cast("double") / float(16**8)
    return pool.withColumn("shuffle_key", key).drop("_o", "_r", "_n")


def days_around(candidates: DataFrame, daily: DataFrame, before: int, after: int) -> DataFrame:
    """candidate_id and ``near``, an array of (obs_date, price): one or two rows a
    candidate that hold the days around it between them, NULL or empty without any.

    Days are folded to blocks as long as the window, so a window lies in two blocks at
    most and candidates are not unfolded to days: the planner takes an unfolded table
    for as small as the folded one and would broadcast it.  The left join keeps them
    from being the broadcast side at all.
    """
    length = before + after + 1
    block = lambda day: F.floor(F.unix_date(day) / length)
    first, last = F.date_sub("obs_date", before), F.date_add("obs_date", after)
    blocks = daily.groupBy(*SERIES, block(F.col("obs_date")).alias("_b")).agg(F.collect_list(F.struct("obs_date", "price")).alias("_days"))
    spans = candidates.select("candidate_id", *SERIES, first.alias("_first"), last.alias("_last"), F.explode(F.array_distinct(F.array(block(first), block(last)))).alias("_b"))
    return spans.join(blocks, [*SERIES, "_b"], "left").select("candidate_id", F.filter("_days", lambda x: x["obs_date"].between(F.col("_first"), F.col("_last"))).alias("near"))


def context_windows(candidates: DataFrame, daily: DataFrame, before: int = 30, after: int = 14) -> DataFrame:
    """The days around each candidate as an array of (obs_date, price); an array holds
    at most before + after + 1 days.  Candidates without any day are left out."""
    near = days_around(candidates, daily, before, after)
    return near.groupBy("candidate_id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("context")).where(F.size("context") > 0)


def paired_labels(labels: DataFrame, a: str, b: str) -> DataFrame:
    """candidate_id, label_a, label_b of two annotators."""
    both = labels.where(F.col("annotator").isin(a, b)).groupBy("candidate_id").agg(
        F.max(F.when(F.col("annotator") == a, F.col("label"))).alias("label_a"), F.max(F.when(F.col("annotator") == b, F.col("label"))).alias("label_b")
    )
    return both.where("label_a is not null and label_b is not null")


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """One row: n_paired, observed_agreement, expected_agreement, kappa (0 where the
    expected agreement is 1; NULL without pairs)."""
    cells = pairs.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))
    a = cells.groupBy(F.col("label_a").alias("l")).agg(F.sum("n").alias("na"))
    b = cells.groupBy(F.col("label_b").alias("l")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, "l").agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    whole = cells.agg(F.sum("n").alias("n_paired"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("s"))
    both = whole.withColumn("e", chance.scalar())
    po, pe = F.try_divide(F.col("s").cast("double"), F.col("n_paired").cast("double")), F.coalesce(F.try_divide(F.col("e").cast("double"), F.col("n_paired").cast("double") * F.col("n_paired")), F.lit(0.0))
    return both.select(F.coalesce("n_paired", F.lit(0)).alias("n_paired"), po.alias("observed_agreement"), F.when(po.isNotNull(), pe).alias("expected_agreement"), F.when(pe >= 1, 0.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def match_events(detections: DataFrame, events: DataFrame, tolerance: int = 3) -> tuple[DataFrame, DataFrame]:
    """(detections with ``hit``, events with ``found``).

    An event covers the days from its start to its end, ``tolerance`` more on each
    side.  Events are unfolded to their days, so the range join becomes an equality
    on series and day; a detection counts once however many events it lies in.
    """
    days = event_days(events, tolerance)
    hit = days.select(*KEY).distinct().withColumn("hit", F.lit(True))
    found = days.join(detections.select(*KEY).distinct(), KEY, "left_semi").select("event_id").distinct().withColumn("found", F.lit(True))
    return (
        detections.join(hit, KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False))),
        events.join(found, "event_id", "left").withColumn("found", F.coalesce("found", F.lit(False))),
    )


def precision_recall(detections: DataFrame, days: DataFrame, by: str = "method") -> DataFrame:
    """Per arm: tp, fp, fn, precision, recall, f1 (0 where undefined).  ``detections``
    has the arm in ``by`` and ``hit``; ``days`` the events' days (:func:`event_days`)."""
    counts = detections.groupBy(by).agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    reached = detections.where("hit").select(by, *KEY).join(days, KEY).select(by, "event_id").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("_found"))
    total = days.select("event_id").distinct().agg(F.count(F.lit(1)).alias("_all"))
    joined = counts.join(reached, by, "left").withColumn("fn", total.scalar() - F.coalesce("_found", F.lit(0)))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    return joined.select(by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def event_days(events: DataFrame, tolerance: int = 3) -> DataFrame:
    """event_id and every day it covers, with the tolerance."""
    return events.select("event_id", *SERIES, F.explode(F.sequence(F.date_sub("start_date", tolerance), F.date_add("end_date", tolerance))).alias("obs_date"))


def set_overlap(sets: DataFrame, name: str, base: str) -> DataFrame:
    """Each flagged set against the set ``base``: n_flags, n_common, jaccard, nested
    (one of both holds the other).  ``sets``: ``name`` and the key columns."""
    flags = sets.groupBy(*KEY).agg(F.collect_set(name).alias("_in"))  # as many as there are sets
    each = flags.select(F.explode("_in").alias(name), F.array_contains("_in", base).alias("_b"))
    counts = each.groupBy(name).agg(F.count(F.lit(1)).alias("n_flags"), F.count_if("_b").alias("n_common"))
    size = F.coalesce(F.max(F.when(F.col(name) == base, F.col("n_flags"))).over(Window.partitionBy()), F.lit(0))  # over one row a set
    return counts.withColumn("_nb", size).select(
        name, "n_flags", "n_common", F.try_divide(F.col("n_common").cast("double"), (F.col("n_flags") + F.col("_nb") - F.col("n_common")).cast("double")).alias("jaccard"),
        (F.col("n_common") == F.least("n_flags", "_nb")).alias("nested"),
    )


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks with ties averaged, within ``by``, made from counts per distinct value."""
    ties = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(value)) - F.col("_n")
    ranks = ties.select(*by, value, (before + (F.col("_n") + 1) / 2).alias(name))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, value]]
    return df.alias("l").join(ranks.alias("r"), on).select("l.*", f"r.{name}")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman's correlation within ``by``: Pearson's on average ranks, NULL without
    spread."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, by, "_rx"), y, by, "_ry")
    c = F.corr("_rx", "_ry")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when((F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0), c).alias("spearman"))


def compare_runs(left: DataFrame, right: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """One row: rows on both sides, equal to ``digits`` places (NULL equals NULL and
    NaN), different, and on one side only."""
    side = lambda df, n: df.select(*keys, F.round(F.when(~F.isnan(F.col(value)), F.col(value)), digits).alias(n), F.lit(True).alias(f"_{n}"))
    full = side(left, "l").join(side(right, "r"), keys, "full")
    both = F.col("_l") & F.col("_r")
    return full.agg(
        F.count_if(both & F.col("l").eqNullSafe(F.col("r"))).alias("n_equal"), F.count_if(both & ~F.col("l").eqNullSafe(F.col("r"))).alias("n_different"),
        F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"),
    )


def baselines(candidates: DataFrame, daily: DataFrame, days: int = 30, min_obs: int = 20) -> DataFrame:
    """``baseline``: mean of the real prices of the ``days`` days before each candidate,
    NULL for fewer than ``min_obs``; one row a candidate_id."""
    near = days_around(candidates, daily.where("price is not null"), days, -1)
    n, total = F.when(F.col("near").isNotNull(), F.size("near")), F.aggregate("near", F.lit(0.0), lambda s, x: s + x["price"])
    met = near.groupBy("candidate_id").agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_obs"), F.sum(total).alias("_s"))
    return met.select("candidate_id", "n_obs", F.when(F.col("n_obs") >= min_obs, F.try_divide("_s", F.col("n_obs").cast("double"))).alias("baseline"))


def new_candidates(pool: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates of a pool that are not there yet."""
    return pool.join(existing.select(*KEY).distinct(), KEY, "left_anti")


def clear_pool(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """The empty pool; refused while any label refers to it."""
    if labels.join(candidates.select("candidate_id"), "candidate_id", "left_semi").limit(1).count():
        raise ValueError("the pool has labels")
    return candidates.limit(0)
