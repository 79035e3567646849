"""Signals of one series and day fused into a score and a level."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kisaran.functions.expressions import half_up

SERIES = ["commodity", "region"]


@dataclass(frozen=True)
class FusionParams:
    """Weights of anomaly, momentum, demand and corroboration; scales; thresholds."""

    w_anomaly: float = 0.45
    w_momentum: float = 0.25
    w_demand: float = 0.20
    w_corroboration: float = 0.10
    both_bonus: float = 0.15
    momentum_scale: float = 0.15
    demand_scale: float = 3.0
    high: float = 0.70
    low: float = 0.40
    min_sources: int = 2
    min_corroboration: float = 0.5

    def weights(self) -> dict[str, float]:
        return {k[2:]: v for k, v in asdict(self).items() if k.startswith("w_")}


def pivot_scores(scores: DataFrame) -> DataFrame:
    """One row per series and day from one row per method."""
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    flag = lambda m: F.bool_or(F.when(F.col("method") == m, F.col("is_flagged")))
    return scores.groupBy(*SERIES, "obs_date").agg(
        pick("zscore", "norm_score").alias("norm_zscore"), pick("iforest", "norm_score").alias("norm_iforest"), flag("zscore").alias("zscore_flagged"), flag("iforest").alias("iforest_flagged")
    )


def change_over(df: DataFrame, value: str, days: int, keys: list[str], name: str, at: str = "obs_date") -> DataFrame:
    """``name``: change of ``value`` against exactly ``days`` days before; NULL where
    that day is missing or 0.

    One row per key and day: the row ``days`` back is read in a window over days, so
    nothing is joined.
    """
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(at))).rangeBetween(-days, -days)
    return df.withColumn(name, F.try_divide(F.col(value), F.max(value).over(w)) - 1)


def source_movements(obs: DataFrame, days: int = 7, threshold: float = 0.05) -> DataFrame:
    """Per series and day: sources with a price ``days`` earlier, and those that moved."""
    moved = change_over(obs, "price", days, [*SERIES, "source"], "_c").where("_c is not null")
    return moved.groupBy(*SERIES, "obs_date").agg(F.count(F.lit(1)).alias("n_sources_reporting"), F.count_if(F.abs("_c") >= threshold).alias("n_sources_flagging"))


def source_coverage(obs: DataFrame) -> DataFrame:
    """Distinct sources of each series over its whole life, and whether it is one."""
    n = F.countDistinct("source")
    return obs.groupBy(*SERIES).agg(n.alias("n_sources_lifetime"), (n < 2).alias("single_source_coverage"))


def terms(inputs: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """The terms a, m, d (0 to 1) and c of each row.

    A is NULL if neither detector could judge, C if no source reported; a missing
    change or demand counts 0.
    """
    both = F.coalesce(F.col("zscore_flagged") & F.col("iforest_flagged"), F.lit(False))
    a = F.greatest("norm_zscore", "norm_iforest")
    # greatest() and least() skip NULLs, so NULL is put back where it must stay
    term_a = F.when(a.isNotNull(), F.least(a * F.when(both, 1 + p.both_bonus).otherwise(1.0), F.lit(1.0)))
    z = F.col("demand_z52") / p.demand_scale
    return inputs.withColumns(
        {
            "a": term_a,
            "m": F.when(F.col("pct_change_7d").isNotNull(), F.least(F.abs("pct_change_7d") / p.momentum_scale, F.lit(1.0))).otherwise(0.0),
            "d": F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(1.0)), F.lit(0.0))).otherwise(0.0),
            "c": F.try_divide(F.col("n_sources_flagging").cast("double"), F.col("n_sources_reporting").cast("double")),
            "both_flagged": both,
        }
    )


def weighted(p: FusionParams | dict[str, Column]) -> Column:
    w = {k: F.lit(v) for k, v in p.weights().items()} if isinstance(p, FusionParams) else p
    total = w["anomaly"] * F.col("a") + w["momentum"] * F.col("m") + w["demand"] * F.col("d") + w["corroboration"] * F.coalesce("c", F.lit(0.0))
    return F.when(F.col("a").isNotNull(), F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))


def level_of(score: Column, p: FusionParams = FusionParams()) -> tuple[Column, Column]:
    """(level, reason a top score was held back)."""
    held = (
        F.when(F.coalesce("single_source_coverage", F.lit(False)), "single_source_coverage")
        .when(F.coalesce("n_sources_reporting", F.lit(0)) == 0, "no_sources_reporting")
        .when(F.col("n_sources_reporting") < p.min_sources, "single_source_reporting")
        .when(F.coalesce("c", F.lit(0.0)) < p.min_corroboration, "insufficient_corroboration")
    )
    top = score >= p.high
    level = F.when(score.isNull(), "belum_dapat_dinilai").when(score < p.low, "tenang").when(~top, "waspada").when(held.isNotNull(), "waspada").otherwise("siaga")
    return level, F.when(top, held)


def fuse(inputs: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Fusion score (6 digits), level and components of each row; the level is made
    from the score before rounding."""
    scored = terms(inputs, p).withColumn("_f", weighted(p))
    level, reason = level_of(F.col("_f"), p)
    r6 = lambda c: half_up(F.col(c), 6).alias(c)
    components = F.struct(r6("a"), r6("m"), r6("d"), r6("c"), "both_flagged", "n_sources_reporting", "n_sources_flagging", reason.alias("reason"))
    return scored.select(*SERIES, "obs_date", half_up(F.col("_f"), 6).alias("fusion_score"), level.alias("level"), components.alias("components"))


def perturbed_weights(p: FusionParams = FusionParams(), delta: float = 0.10) -> list[tuple[str, dict[str, float]]]:
    """Weight vectors with one weight moved by +-delta and the others rescaled to sum
    1; moves outside 0..1 are left out.  The first is the vector as it is."""
    base = p.weights()
    out = [("base", base)]
    for name in base:
        rest = 1.0 - base[name]
        for sign in (1, -1):
            moved = base[name] + sign * delta
            if 0.0 <= moved <= 1.0 and rest > 0:
                out.append((f"{name}{'+' if sign > 0 else '-'}", {k: moved if k == name else v * (1.0 - moved) / rest for k, v in base.items()}))
    return out


def _levels(p: FusionParams, delta: float) -> Column:
    """Array of (variant, score, level) under every weight vector, from the terms."""
    options = []
    for name, w in perturbed_weights(p, delta):
        score = weighted({k: F.lit(v) for k, v in w.items()})
        options.append(F.struct(F.lit(name).alias("variant"), score.alias("score"), level_of(score, p)[0].alias("level")))
    return F.array(*options)


def all_levels(inputs: DataFrame, p: FusionParams = FusionParams(), delta: float = 0.10) -> DataFrame:
    """Every row with ``levels``, an array of (variant, score, level) under every weight
    vector.  The vectors are literals, so nothing is joined."""
    return terms(inputs, p).select(*SERIES, "obs_date", "a", "m", "d", "c", _levels(p, delta).alias("levels"))


def sensitivity(inputs: DataFrame, p: FusionParams = FusionParams(), delta: float = 0.10) -> DataFrame:
    """Every row under every weight vector: variant, score and level.  The vectors are
    literals, so the rows are unfolded in place instead of joined."""
    return terms(inputs, p).select(*SERIES, "obs_date", "a", "m", "d", "c", F.explode(_levels(p, delta)).alias("v")).select(*SERIES, "obs_date", "v.*")
