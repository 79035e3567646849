"""Totals over trailing periods by block decomposition.

The days of a series are cut into blocks as long as the window.  Inside a block
prefix and suffix sums are kept; the window that ends on day d is the suffix of
the block before, from d - w + 1 on, plus the prefix of d's own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_spine(df: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """``df`` (one row per source and day) with a row for every day of each
    source's span; days without a row carry NULL.

    Each reading is unfolded up to the day before the next one, so no join is
    needed and the result stays partitioned by source.
    """
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    until = F.coalesce(F.date_sub(following, 1), F.col(at))
    unfolded = df.select(*keys, F.col(at).alias("_from"), *values, F.sequence(F.col(at), until).alias("_days"))
    days = unfolded.select(*keys, "_from", *values, F.explode("_days").alias(at))
    return days.select(*keys, at, *[F.when(F.col(at) == F.col("_from"), F.col(v)).alias(v) for v in values])


def trailing_totals(df: DataFrame, keys: list[str], at: str, windows: dict[str, list[int]]) -> DataFrame:
    """For each value column its ``<value>_total_W`` and ``<value>_days_W`` (days
    with a value), for every calendar day of a source's span.

    ``df`` has one row per source and day.  Windows are cut at the first day; NULL
    adds nothing, and a window without any value has total NULL and 0 days.  Sums
    keep the value's type, so decimals stay exact.  NULL keys form a source of
    their own; rows without a date must be dropped before.  An empty table gives
    an empty result.

    Scale: one exchange by source.  A source has one row a day by then, so its
    group is bounded by the calendar (ten thousand rows in 27 years) however many
    rows it had at first; prefix sums, suffix sums and the meeting of both run on
    that one partitioning in time linear in the days, whatever the window length.
    """
    out = daily_spine(df, keys, at, list(windows)).withColumn("_d", F.unix_date(at))
    series = Window.partitionBy(*keys).orderBy("_d")
    out = out.withColumn("_first", F.min("_d").over(Window.partitionBy(*keys)))
    lengths = sorted({w for ws in windows.values() for w in ws})
    for w in lengths:
        out = out.withColumn(f"_b{w}", F.floor(F.col("_d") / w))
        block = Window.partitionBy(*keys, f"_b{w}").orderBy("_d")
        ahead, behind = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
        sums = {}
        for v in (v for v, ws in windows.items() if w in ws):
            sums |= {f"_p_{v}_{w}": F.sum(v).over(ahead), f"_pn_{v}_{w}": F.count(v).over(ahead), f"_s_{v}_{w}": F.sum(v).over(behind), f"_sn_{v}_{w}": F.count(v).over(behind)}
        out = out.withColumns(sums)
    columns: list[Column] = []
    for v, ws in windows.items():
        for w in ws:
            opens = F.pmod(F.col("_d") - F.lit(w - 1), F.lit(w)) == 0  # the window is d's own block
            early = F.col("_d") - F.lit(w - 1) < F.col("_first")
            in_first = F.col(f"_b{w}") == F.floor(F.col("_first") / w)
            for p, s, name in ((f"_p_{v}_{w}", f"_s_{v}_{w}", "total"), (f"_pn_{v}_{w}", f"_sn_{v}_{w}", "days")):
                before = F.when(opens | in_first, None).when(early, F.first(s).over(series)).otherwise(F.lag(s, w - 1).over(series))
                both = F.when(before.isNull(), F.col(p)).when(F.col(p).isNull(), before).otherwise(F.col(p) + before)
                columns.append(both.alias(f"{v}_{name}_{w}"))
    return out.select(*keys, at, *columns)
