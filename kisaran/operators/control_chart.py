"""Sequential kernels of the spike operator (numpy only, no Spark).

A chart carries an exponentially weighted mean and an exponentially weighted
absolute deviation.  Every reading is clipped to the control band before it
updates either of them, so one wild reading cannot move the chart.  A counter
of successive out-of-control readings on one side re-centres the chart once the
run is too long to be a spike (a lasting change of level).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ChartParams:
    """Settings of the two-sided chart and of the run counter.

    ``weight``/``scale_weight``: weights of the newest reading.  ``clip``: half
    width, in scales, of the band a reading is clipped to.  ``limit``: scales
    beyond which both charts must see a reading for it to be a spike.
    ``weak_limit``/``weak_steepness``: see
    :func:`spikes`.  ``relevel``: successive one-sided readings that make a new level.
    ``around``/``step_ratio``: readings on either side whose median step a spike's
    steps in and out must exceed so many times.  ``held_step``:
    part of the median move that counts as usual step where values are held.
    ``min_shift``: smallest deviation (log or absolute units) worth flagging.
    ``floor``/``step_floor``: lower
    bound of the scale, absolute and as a part of the median non-zero step.  ``stuck_min``/``stuck_ratio``: shortest
    stuck run, and how many times the source's habitual run it must last.
    ``habit``: quantile of a source's run lengths, weighted by reports, that is its habit.
    ``min_points``: shorter series are not judged for spikes.
    """

    weight: float = 0.6
    scale_weight: float = 0.1
    clip: float = 2.5
    limit: float = 3.6
    weak_limit: float = 2.6
    weak_steepness: float = 3.0
    relevel: int = 4
    min_shift: float = 0.08
    floor: float = 0.004
    step_floor: float = 0.5
    around: int = 8
    step_ratio: float = 4.5
    held_step: float = 0.35
    stuck_min: int = 7
    stuck_ratio: float = 3.0
    habit: float = 0.95
    min_points: int = 5


def _seed(values: np.ndarray) -> tuple[float, float]:
    """Start mean and scale: median of the first readings, median absolute step."""
    head = values[: min(len(values), 3)]
    steps = np.abs(np.diff(values))
    steps = steps[steps > 0]
    scale = float(np.median(steps)) if len(steps) else 0.0
    return float(np.median(head)), scale


def chart(values: np.ndarray, gaps: np.ndarray, p: ChartParams) -> tuple[np.ndarray, np.ndarray]:
    """Deviation of each reading from the chart before it, and the chart's scale.

    ``gaps`` are the days since the previous reading; the band widens with the
    root of the gap, as a random walk does, up to a factor of three.
    """
    n = len(values)
    dev, scl = np.zeros(n), np.zeros(n)
    mean, scale = _seed(values)
    floor = max(p.floor, p.step_floor * scale)
    scale = max(scale, floor)
    run, side = [], 0
    points, apart = values.tolist(), gaps.tolist()
    for i, x in enumerate(points):
        wide = scale * min(3.0, max(1.0, apart[i]) ** 0.5)
        d = x - mean
        dev[i], scl[i] = d, wide
        out = abs(d) > p.limit * wide
        s = 1 if d > 0 else -1
        if out and s == side:
            run.append(x)
        elif out:
            run, side = [x], s
        else:
            run, side = [], 0
        if len(run) >= p.relevel:
            mean = float(np.median(run))
            run, side = [], 0
            continue
        c = min(max(d, -p.clip * wide), p.clip * wide)
        mean += p.weight * (0.15 * c if out else c)
        if not out:
            scale = max(floor, (1 - p.scale_weight) * scale + p.scale_weight * 1.2533 * min(abs(d), p.clip * scale))
    return dev, scl


def two_sided(values: np.ndarray, days: np.ndarray, p: ChartParams) -> np.ndarray:
    """Signed score of each reading: the smaller of the forward and backward one.

    Zero where the charts disagree on the side: what is far from the past but
    near the future is a change of level, not a spike.
    """
    n = len(values)
    if n < p.min_points:
        return np.zeros(n)
    step = np.diff(days.astype(float))
    f, fs = chart(values, np.concatenate([[1.0], step]), p)
    b, bs = chart(values[::-1], np.concatenate([[1.0], step[::-1]]), p)
    b, bs = b[::-1], bs[::-1]
    zf, zb = f / fs, b / bs
    score = np.where(np.sign(f) == np.sign(b), np.sign(f) * np.minimum(np.abs(zf), np.abs(zb)), 0.0)
    near = np.minimum(np.abs(f), np.abs(b))
    return np.where(near >= p.min_shift, score, 0.0)


def spikes(values: np.ndarray, days: np.ndarray, p: ChartParams) -> np.ndarray:
    """True for readings out of both charts' bands in a short and steep run.

    Runs beyond ``limit`` must be entered and left in steps of ``step_ratio`` times
    the usual step around them.  Runs that only exceed ``weak_limit`` (an earlier
    unrest still widens the band) must be ``weak_steepness`` times steeper.
    """
    score = two_sided(values, days, p)
    found = _abrupt(score, values, p, p.limit, p.step_ratio)
    if p.weak_limit < p.limit:
        found |= _abrupt(np.where(found, 0.0, score), values, p, p.weak_limit, p.step_ratio * p.weak_steepness)
    return found


def _abrupt(score: np.ndarray, values: np.ndarray, p: ChartParams, limit: float, step_ratio: float) -> np.ndarray:
    """Runs of readings beyond ``limit`` that are short, and that are entered and left
    in steps unlike those around them.

    The step into and the step out of a run must each be ``step_ratio`` times the
    median absolute step among the ``around`` readings on either side of it; at an
    end of the series the one step there is must be half as large again.
    """
    n, out = len(values), np.zeros(len(values), bool)
    side = np.where(np.abs(score) > limit, np.sign(score), 0.0)
    pos, length = run_positions(side)
    for i in np.flatnonzero((side != 0) & (pos == 0)):
        j = i + length[i]  # one past the run
        before, after = values[max(0, i - p.around) : i], values[j : j + p.around]
        steps = np.abs(np.concatenate([np.diff(before), np.diff(after)]))
        moves = steps[steps > 0]
        usual = max(float(np.median(steps)) if len(steps) else 0.0, p.held_step * float(np.median(moves)) if len(moves) else 0.0, p.floor)
        sides = [abs(values[k] - values[k - 1]) for k in (i, j) if 0 < k < n]
        ratio = min(sides, default=0.0) / usual
        out[i:j] = length[i] < p.relevel and ratio >= step_ratio * (1.5 if len(sides) < 2 else 1.0)
    return out


def run_positions(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position within, and length of, the run of equal values of each reading."""
    n = len(values)
    if n == 0:
        return np.zeros(0, int), np.zeros(0, int)
    new = np.concatenate([[True], values[1:] != values[:-1]])
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate([start, [n]]))
    return np.arange(n) - start[run], length[run]


def stuck(values: np.ndarray, p: ChartParams) -> np.ndarray:
    """True for each reading after the first of a run far beyond the series' own runs.

    The habit is the 75 % quantile of the lengths of the series' other runs,
    weighted by reports; a run is stuck from ``max(stuck_min, stuck_ratio x
    habit)`` reports on.  The chart leaves such readings out.
    """
    pos, length = run_positions(values)
    if len(values) == 0:
        return np.zeros(0, bool)
    lengths = length[pos == 0]
    flags = np.zeros(len(values), bool)
    for cut in sorted({int(x) for x in lengths if x >= p.stuck_min}):
        rest = lengths[lengths < cut]
        habit = float(np.quantile(np.repeat(rest, rest), 0.75)) if len(rest) else 1.0
        if cut >= max(p.stuck_min, p.stuck_ratio * habit):
            flags |= (length >= cut) & (pos > 0)
            break
    return flags
