"""Raw observations to accepted ones: aliases, units, rejects, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kisaran.functions.expressions import fold


def alias_index(commodities: DataFrame) -> DataFrame:
    """source, alias (folded), commodity, alias_rank (position in its list)."""
    per_source = commodities.select("slug", F.explode("source_aliases").alias("source", "names"))
    return per_source.select("source", F.posexplode("names").alias("alias_rank", "_n"), F.col("slug").alias("commodity")).select("source", fold(F.col("_n")).alias("alias"), "commodity", "alias_rank")


def alias_collisions(index: DataFrame) -> DataFrame:
    """Aliases of one source that stand for more than one commodity."""
    return index.groupBy("source", "alias").agg(F.countDistinct("commodity").alias("n_commodities")).where("n_commodities > 1")


def resolve(obs: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """``obs`` with commodity and alias_rank by source and folded name; NULL where the
    name is not tracked.  The index follows the commodity list; Spark broadcasts it
    if it is small and shuffles otherwise."""
    typed = obs.withColumn("_alias", fold(F.col(name)))
    joined = typed.alias("o").join(index.alias("i"), (F.col("o.source") == F.col("i.source")) & (F.col("o._alias") == F.col("i.alias")), "left")
    return joined.select(*[F.col(f"o.{c}") for c in obs.columns], F.col("i.commodity").alias("resolved"), F.col("i.alias_rank").cast("bigint").alias("alias_rank"))


def best_per_day(resolved: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of several names for one commodity, place and day the one of lowest rank, the
    first seen on ties."""
    values = [c for c in resolved.columns if c not in keys]
    first = F.min_by(F.struct(*values), F.struct(F.coalesce("alias_rank", F.lit(1 << 30)), F.col(sequence)))
    return resolved.groupBy(*keys).agg(first.alias("_x")).select(*keys, *[F.col(f"_x.{v}").alias(v) for v in values])


def reject_reasons(obs: DataFrame, commodities: DataFrame, regions: DataFrame, low: float, high: float) -> DataFrame:
    """``reason`` of each row that cannot be accepted (first failure), else NULL.

    ``low`` and ``high`` bound the price as parts and multiples of the commodity's
    median.
    """
    level = obs.where("price > 0").groupBy("commodity").agg(F.median("price").alias("_level"))
    known = commodities.select(F.col("slug").alias("commodity"), F.lit(True).alias("_listed"))
    places = regions.select(F.col("slug").alias("region"), F.lit(True).alias("_placed"))
    wide = obs.join(known, "commodity", "left").join(places, "region", "left").join(level, "commodity", "left")
    ratio = F.col("price") / F.col("_level")
    return wide.withColumn(
        "reason",
        F.when(F.col("price").isNull(), "no_price").when(F.col("_listed").isNull(), "unknown_commodity").when(F.col("_placed").isNull(), "unknown_region")
        .when(~ratio.between(low, high), "implausible_price"),
    ).drop("_listed", "_placed", "_level")


def expected_missing(seen: DataFrame, commodities: DataFrame) -> DataFrame:
    """Listed commodities a region lacks, for regions that have any row.

    Regions times list is unfolded from one array of the list, of checked size.
    """
    listed = [r[0] for r in commodities.select("slug").distinct().limit(100_001).collect()]
    if len(listed) > 100_000:
        raise ValueError("commodity list beyond 100 000 entries")
    have = seen.groupBy("region").agg(F.collect_set("commodity").alias("_have"))
    return have.select("region", F.explode(F.array_except(F.array(*[F.lit(x) for x in sorted(listed)]).cast("array<string>"), "_have")).alias("commodity"))


def missing_days(seen: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Days inside each source's span on which it has nothing (what to fetch again)."""
    days = seen.select(*keys, at).distinct()
    after = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    holes = days.withColumn("_n", after).where(F.datediff("_n", at) > 1)
    return holes.select(*keys, F.explode(F.sequence(F.date_add(at, 1), F.date_sub("_n", 1))).alias(at))


def batch_status(parts: DataFrame, keys: list[str], accepted: str, rejected: str) -> DataFrame:
    """``status``: failed if nothing was accepted, partial if anything was rejected."""
    sums = parts.groupBy(*keys).agg(F.coalesce(F.sum(accepted), F.lit(0)).alias("n_accepted"), F.coalesce(F.sum(rejected), F.lit(0)).alias("n_rejected"))
    return sums.withColumn("status", F.when(F.col("n_accepted") == 0, "failed").when(F.col("n_rejected") > 0, "partial").otherwise("success"))


def present_variants(seen: DataFrame, index: DataFrame) -> DataFrame:
    """Per source and commodity the first configured name that occurs, its rank, and
    how many configured names occur.  ``seen``: source, name."""
    names = seen.select(F.col("source"), fold(F.col("name")).alias("alias")).distinct()
    met = index.join(names, ["source", "alias"])
    return met.groupBy("source", "commodity").agg(F.min_by("alias", F.struct("alias_rank", "alias")).alias("alias"), F.min("alias_rank").cast("bigint").alias("alias_rank"), F.countDistinct("alias").alias("n_present"))


def conversion_factors(obs: DataFrame, commodities: DataFrame, conversions: DataFrame) -> DataFrame:
    """``unit`` (folded), ``target`` (the commodity's unit) and ``factor`` (targets in
    one unit; 1 if equal, NULL if there is no conversion) of each row.

    ``obs``: commodity_slug, raw_unit; a row without a unit is taken to be in the
    commodity's own.  A conversion with ``applies_to`` holds for these slugs only.
    """
    goods = commodities.select(F.col("slug").alias("commodity_slug"), F.col("canonical_unit").alias("target"))
    some = F.transform(F.split("applies_to", ","), lambda x: F.trim(x))
    rules = conversions.select("from_unit", "to_unit", F.col("amount").cast("double").alias("_amount"), some.alias("_only"))
    read = obs.join(goods, "commodity_slug", "left").withColumn("unit", F.coalesce(fold(F.col("raw_unit")), F.col("target")))
    fits = (F.col("o.unit") == F.col("r.from_unit")) & (F.col("o.target") == F.col("r.to_unit")) & (F.col("r._only").isNull() | F.array_contains("r._only", F.col("o.commodity_slug")))
    joined = read.alias("o").join(rules.alias("r"), fits, "left")
    return joined.select(*[F.col(f"o.{c}") for c in read.columns], F.when(F.col("o.unit") == F.col("o.target"), 1.0).otherwise(F.col("r._amount")).alias("factor"))


def resume_days(seen: DataFrame, nationwide: DataFrame) -> DataFrame:
    """Days of the whole span on which no region but the nationwide ones has a row: what
    a resumed backfill still has to fetch.  ``nationwide``: region."""
    own = seen.join(nationwide, "region", "left_anti").select("obs_date").distinct()
    span = seen.agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("obs_date")).join(own, "obs_date", "left_anti")


def bridge_changes(declared: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """What to do to make the declared pairs those that were found: keep, delete, insert."""
    side = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(True))
    full = side(declared, "_d").join(side(found, "_f"), keys, "full")
    return full.select(*keys, F.when(F.col("_f").isNull(), "delete").when(F.col("_d").isNull(), "insert").otherwise("keep").alias("action"))
