"""Implausible readings per source: spikes, stuck values, impossible values.

Every source is judged by a pair of robust exponentially weighted control charts
(one run forwards, one backwards, see :mod:`control_chart`), by counters of equal
successive values against that source's own habit, and by physical limits.

Scale: readings are first reduced to distinct (source, position, value) points
with a map-side combine, so repeated rows cost nothing further.  A source's
points are cut into calendar blocks of ``block`` positions and each block gets a
halo of ``halo`` positions from its neighbours as warm-up, so the work unit is a
block, never a whole source, and one source that holds a third of all rows is
spread over as many tasks as it has blocks.  The chart forgets with weight 0.6 a
reading, so a halo of 200 readings leaves no trace of what lies before it.  Each
block also counts its readings by the length of the run they lie in; these counts,
one row per source and length, give the habit of every source as a whole.  The
blocks' findings (a few percent of the points) are checkpointed, as they are read
for the habits and for the flags, and only they are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kisaran.operators.control_chart import ChartParams, run_positions, spikes, stuck
from kisaran.session import cut_lineage

BLOCK = 1461
HALO = 200


@dataclass(frozen=True)
class Measure:
    """One measured column: who is a source, what orders it, which limits hold.

    ``low`` and ``high`` are the open bounds of what the quantity can be.  With
    ``log`` the chart runs on logarithms (needs ``low >= 0``).  ``habit_of``: the
    keys within which the usual length of a run is taken.
    """

    name: str
    value: str
    row_id: str
    keys: tuple[str, ...]
    position: str
    low: float
    high: float
    log: bool
    chart: ChartParams
    habit_of: tuple[str, ...]


#: Fixed limits: a price lies above 50 rupiah and below 100 million per unit; a
#: ratio cannot fall by 100 percent or more, nor a link hold at six times its
#: level; a spread is never negative and never ten times the median.
PRICE = Measure(
    "price_idr", "price_idr", "obs_id", ("commodity_slug", "region", "source"), "obs_date", 50.0, 1e8, True, ChartParams(), ("source",)
)
DRIFT = Measure(
    "ratio_drift_pct", "ratio_drift_pct", "offset_id", ("commodity", "region", "source"), "run_id", -100.0, 500.0, False,
    ChartParams(weight=0.3, limit=5.5, weak_limit=5.5, min_shift=4.0, floor=0.5, step_ratio=2.0, stuck_min=5), ("source",),
)
SPREAD = Measure(
    "spread_pct", "spread_pct", "point_id", ("commodity", "region"), "obs_date", -1e-9, 1000.0, False,
    ChartParams(weight=0.2, scale_weight=0.05, limit=4.5, weak_limit=4.5, min_shift=0.2, floor=0.1, step_ratio=2.5), ("commodity", "region"),
)


def _standing(position: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One reading for each position: where there are several values, the one that
    goes on from the position before, else the one the next position goes on from."""
    if len(np.unique(position)) == len(position):
        return np.arange(len(position))
    chosen: list[int] = []
    starts = np.flatnonzero(np.concatenate([[True], position[1:] != position[:-1]]))
    for a, b in zip(starts, np.append(starts[1:], len(position))):
        after = set(value[b : b + 1])
        same = [i for i in range(a, b) if chosen and value[i] == value[chosen[-1]]]
        ahead = [i for i in range(a, b) if value[i] in after]
        chosen.append((same or ahead or [a])[0])
    return np.array(chosen)


def _judge(position: np.ndarray, value: np.ndarray, log: bool, p: ChartParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each reading (0 plain, 1 spike, 2 in a run of ``stuck_min`` or more
    after its first), the length of its run, and whether it begins a run."""
    kind, length, begins = np.zeros(len(value), int), np.ones(len(value), int), np.zeros(len(value), bool)
    at = _standing(position, value)
    place, run = run_positions(value[at])
    length[at], begins[at] = run, place == 0
    kind[at[(place > 0) & (run >= p.stuck_min)]] = 2
    # A stuck run counts once in the chart; else it would narrow the band to nothing.
    flat = np.zeros(len(value), bool)
    flat[at] = stuck(value[at], p)
    keep = np.flatnonzero(~flat)
    x = np.log(value[keep]) if log else value[keep]
    wild = keep[spikes(x, position[keep], p)]
    kind[wild[length[wild] < p.stuck_min]] = 1  # what lasts is no spike
    return kind, length, begins


def _judge_groups(m: Measure, width: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judge blocks that arrive sorted; a block may run over several batches."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            held = None
            continue
        ids = pdf[[*m.keys, "_block"]]
        change = (ids.ne(ids.shift()) & ~(ids.isna() & ids.shift().isna())).any(axis=1).to_numpy()
        change[0] = True
        starts = np.flatnonzero(change)
        last = int(starts[-1])
        held = pdf.iloc[last:]
        if last:
            yield from _judged(m, width, pdf.iloc[:last], starts[:-1])
    if held is not None and len(held):
        yield from _judged(m, width, held.reset_index(drop=True), np.array([0]))


def _judged(m: Measure, width: int, pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
    """The block's own spikes and long runs, and (kind 0) how many readings lie in
    runs of each length; a run belongs to the block it begins in."""
    position, value = pdf["_pos"].to_numpy(), pdf["_value"].to_numpy(float)
    own = np.floor_divide(position, width) == pdf["_block"].to_numpy()
    kind, length, begins = np.zeros(len(pdf), int), np.zeros(len(pdf), int), np.zeros(len(pdf), bool)
    for a, b in zip(starts, np.append(starts[1:], len(pdf))):
        kind[a:b], length[a:b], begins[a:b] = _judge(position[a:b], value[a:b], m.log, m.chart)
    met = own & (kind > 0)
    if met.any():
        yield pdf.loc[met, [*m.keys, "_pos", "_value"]].assign(_kind=kind[met], _run=length[met])
    runs = pdf.loc[own & begins, list(m.habit_of)].assign(_run=length[own & begins])
    counts = runs.groupby([*m.habit_of, "_run"], dropna=False).size().reset_index(name="_pos")
    if len(counts):
        counts["_pos"] *= counts["_run"]
        keys = {k: pd.Series([None] * len(counts), dtype=object) if k not in m.habit_of else counts[k].astype(object).where(counts[k].notna(), None) for k in m.keys}
        yield counts.assign(_value=0.0, _kind=0, **keys)[[*m.keys, "_pos", "_value", "_kind", "_run"]]


def _position(m: Measure, df: DataFrame) -> Column:
    kind = dict(df.dtypes)[m.position]
    return (F.unix_date(m.position) if kind == "date" else F.col(m.position)).cast("long")


def _run_limits(counts: DataFrame, m: Measure) -> DataFrame:
    """Per ``habit_of`` the run length ``_limit`` from which on a run is stuck (NULL: none).

    It is the least length that occurs and is ``stuck_ratio`` times the habit of the
    shorter runs.  A source has as many rows here as run lengths, at most a block's.
    """
    p = m.chart
    runs = counts.groupBy(*m.habit_of, "_run").agg(F.sum("_pos").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*m.habit_of).orderBy("_run"))
    each = runs.withColumn("_c", upto).groupBy(*m.habit_of).agg(F.sort_array(F.collect_list(F.struct("_run", "_n", "_c"))).alias("_l"))
    habit = f"coalesce(filter(_l, y -> y._run < x._run and y._c >= {p.habit} * (x._c - x._n))[0]._run, 1)"
    return each.select(*m.habit_of, F.expr(f"array_min(filter(_l, x -> x._run >= {p.stuck_min} and x._run >= {p.stuck_ratio} * {habit})._run)").alias("_limit"))


def flag_readings(df: DataFrame, m: Measure, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Flagged rows of ``df``: ``row_id``, ``reason`` (spike, stuck, impossible).

    * NULL values, and rows without a position, are never flagged.
    * NULL key columns form a source of their own.
    * A run of equal successive values is stuck from ``stuck_min`` readings and
      ``stuck_ratio`` times the habit of its source (``habit_of``) on; every
      reading after its first is flagged.  A source that holds its prices for
      weeks as a rule has a long habit, in whatever series.
    * Equal values of one source and position share one verdict (repeated rows
      are flagged together); several values on a position are judged one by one.
    * Sources with fewer than ``chart.min_points`` points are only held against
      the limits and the run counter.  An empty table gives an empty result.
    * Other columns are ignored, whatever their names.
    """
    rows = df.select(
        F.col(m.row_id).alias("_row"),
        *[F.col(k).alias(k) for k in m.keys],
        _position(m, df).alias("_pos"),
        F.col(m.value).cast("double").alias("_value"),
    ).where("_value is not null and _pos is not null and not isnan(_value)")
    possible = (F.col("_value") > m.low) & (F.col("_value") < m.high)
    impossible = rows.where(~possible).select(F.col("_row").alias("row_id"), F.lit("impossible").alias("reason"))

    fair = rows.where(possible)
    here = F.floor(F.col("_pos") / block)
    points = fair.select(*m.keys, "_pos", "_value").distinct()
    spread = points.withColumn(
        "_block",
        F.explode(F.array_distinct(F.array(here, F.floor((F.col("_pos") - halo) / block), F.floor((F.col("_pos") + halo) / block)))),
    )
    sorted_blocks = spread.repartition(*m.keys, "_block").sortWithinPartitions(*m.keys, "_block", "_pos", "_value")
    schema = ", ".join(f"`{k}` {dict(points.dtypes)[k]}" for k in m.keys) + ", _pos long, _value double, _kind int, _run int"
    judged = cut_lineage(sorted_blocks.mapInPandas(lambda it: _judge_groups(m, block, it), schema))

    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    limits = _run_limits(judged.where("_kind = 0"), m)
    long_ = judged.where("_kind = 2").alias("j").join(limits.alias("u"), same("j", "u", m.habit_of)).where("_run >= _limit").select("j.*")
    flagged = judged.where("_kind = 1").unionByName(long_)

    on = same("f", "r", m.keys) + [F.col("f._pos") == F.col("r._pos"), F.col("f._value") == F.col("r._value")]
    hit = (
        fair.alias("r")
        .join(flagged.alias("f"), on, "inner")
        .select(F.col("r._row").alias("row_id"), F.when(F.col("f._kind") == 1, "spike").otherwise("stuck").alias("reason"))
    )
    return hit.unionByName(impossible)


def with_chart(m: Measure, **changes) -> Measure:
    """``m`` with some chart settings changed."""
    return replace(m, chart=replace(m.chart, **changes))


__all__ = ["DRIFT", "PRICE", "SPREAD", "Measure", "flag_readings", "with_chart"]
