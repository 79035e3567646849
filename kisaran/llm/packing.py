"""Filling fixed-capacity containers by pattern packing.

The histogram of lengths is all the planner sees.  Patterns of a few lengths that
fill a container exactly (on a grid of lengths) are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded down,
and what is left is packed best-fit, largest first, into the room that remains and
into new containers.  The plan says how many containers have which composition;
each piece finds its container from its length and its rank within that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kisaran.llm.tokens import VOCABULARY, token_count
from kisaran.session import cut_lineage

CAPACITY = 2048


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 1 to ``depth`` grid lengths that sum to ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(left, head[-1] if head else bins), 0, -1):
                if x * (depth - len(head)) >= left:
                    grow((*head, x), left - x)

    grow((), bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0.0)))
    for _ in range(rounds or 3 * m):
        gradient = np.where(passive, -np.inf, atb - ata @ x)
        j = int(gradient.argmax())
        if gradient[j] <= tol:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.zeros(n)
            s[at] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s[at] > 1e-12).all():
                x = s
                break
            low = at[s[at] <= 1e-12]
            alpha = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + alpha * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0.0
            if not passive.any():
                break
    return x


@dataclass
class Group:
    """``count`` containers with the same ``content`` (length -> copies)."""

    count: int
    content: dict[int, int]
    room: int


def _fill_patterns(left: Counter, capacity: int, grid: int, depth: int) -> list[Group]:
    """Containers of the fitted patterns; takes their lengths out of ``left``."""
    bins = capacity // grid
    sizes = np.zeros(bins)
    for length, n in left.items():
        sizes[-(-length // grid) - 1] += n
    shapes = patterns(bins, depth)
    a = np.zeros((bins, len(shapes)))
    for j, shape in enumerate(shapes):
        for x in shape:
            a[x - 1, j] += 1
    # long lengths must find their pattern; short ones fill any room later
    weight = np.sqrt(np.arange(1, bins + 1) / bins)
    scale = max(1.0, sizes.max(initial=0.0))
    repeats = np.floor(nnls(a * weight[:, None], sizes * weight / scale) * scale + 1e-6).astype(int)
    by_bin: dict[int, list[int]] = {}
    for length in sorted(left):
        by_bin.setdefault(-(-length // grid), []).append(length)  # largest last
    out: list[Group] = []
    for j in sorted(np.flatnonzero(repeats), key=lambda j: tuple(-x for x in shapes[j])):
        todo = int(repeats[j])
        while todo > 0:
            # one composition: the largest lengths at hand in each place
            need: Counter = Counter()
            for x in shapes[j]:
                at = next((y for y in reversed(by_bin.get(x, [])) if left[y] > need[y]), None)
                if at is None:
                    need = Counter()
                    break
                need[at] += 1
            if not need:
                break  # rounding asked for more than there is
            times = min(todo, *(left[y] // k for y, k in need.items()))
            out.append(Group(times, dict(need), capacity - sum(y * k for y, k in need.items())))
            for y, k in need.items():
                left[y] -= k * times
                while by_bin[-(-y // grid)] and left[by_bin[-(-y // grid)][-1]] == 0:
                    by_bin[-(-y // grid)].pop()
            todo -= times
    return out


def _fill_rest(left: Counter, groups: list[Group], capacity: int) -> list[Group]:
    """Best fit, largest first, by counts: into the least room that takes the length."""
    rooms: list[int] = []
    at: dict[int, list[Group]] = {}

    def put(g: Group) -> None:
        if g.room not in at:
            at[g.room] = []
            insort(rooms, g.room)
        at[g.room].append(g)

    def take(room: int) -> Group:
        g = at[room].pop()
        if not at[room]:
            del at[room]
            rooms.remove(room)
        return g

    for g in groups:
        put(g)
    for length in sorted((x for x, n in left.items() if n > 0), reverse=True):
        n = left[length]
        while n > 0:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                copies = capacity // length
                whole, part = divmod(n, copies)
                for count, k in ((whole, copies), (1, part)):
                    if count and k:
                        put(Group(count, {length: k}, capacity - length * k))
                n = 0
                continue
            g = take(rooms[i])
            copies = g.room // length
            full = min(g.count, n // copies)
            n -= full * copies
            part = n if full < g.count and n < copies else 0
            n -= part
            for count, k in ((full, copies), (1 if part else 0, part), (g.count - full - (1 if part else 0), 0)):
                if count:
                    content = dict(g.content)
                    if k:
                        content[length] = content.get(length, 0) + k
                    put(Group(count, content, g.room - length * k))
    return [g for gs in at.values() for g in gs]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = 32, depth: int = 4) -> list[Group]:
    """Container groups that hold the whole histogram (lengths 1 to capacity).

    The number of groups follows the number of distinct lengths, not of items.
    """
    left = Counter({int(k): int(v) for k, v in histogram.items() if v > 0})
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    return sorted(_fill_rest(left, _fill_patterns(left, capacity, grid, depth), capacity), key=lambda g: (g.room, sorted(g.content.items(), reverse=True)))


def _slots(groups: list[Group]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first container and copies of each run of slots."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for g in groups:
        for length, copies in sorted(g.content.items()):
            runs.setdefault(length, []).append((used[length], base, copies))
            used[length] += copies * g.count
        base += g.count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def pieces(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, first_token, n_tokens: a text longer than the capacity is cut
    into full pieces and a rest; a text without tokens has no piece."""
    counted = cut_lineage(documents.select("doc_id", token_count(F.col("text"), path).alias("t"))).where("t > 0")
    each = counted.select("doc_id", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t") - 1) / capacity))).alias("piece"))
    return each.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("t") - F.col("piece") * capacity).alias("n_tokens"))


def pack(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY, salts: int = 64, grid: int = 32, depth: int = 4) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, container for every piece.

    NULL, empty and token-less texts take no room and have no row.  Whole texts
    are counted, however long.  Rows with the same doc_id are packed one by one.
    An empty table gives an empty result.  Extra columns are ignored.

    Scale: tokens are counted in one pass.  The driver sees the histogram, at
    most ``capacity`` numbers.  Ranks within a length are counted within
    (length, salt) and shifted by the salts' totals, so a length that a third of
    all texts share is ranked by ``salts`` tasks; that table of offsets has at
    most capacity x salts rows and is broadcast.
    """
    cut = pieces(documents, capacity, path).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sums = cut.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = cut_lineage(
        sums.withColumn("before", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    )
    histogram = {r["n_tokens"]: r["n"] for r in offsets.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity, grid, depth))

    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for x in np.unique(lengths):
            at = lengths == x
            start, base, copies = slots[int(x)]
            i = np.searchsorted(start, ranks[at], side="right") - 1
            out[at] = base[i] + (ranks[at] - start[i]) // copies[i]
        return pd.Series(out)

    within = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("r", within).join(F.broadcast(offsets.select("n_tokens", "salt", "before")), ["n_tokens", "salt"])
    rank = (F.col("r") + F.coalesce("before", F.lit(0))).cast("long")
    return ranked.select("doc_id", "piece", "first_token", "n_tokens", F.pandas_udf(container, T.LongType())(F.col("n_tokens"), rank).alias("container"))


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, least possible containers, fill."""
    return packed.agg(
        F.count(F.lit(1)).alias("n_pieces"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.countDistinct("container").alias("n_containers")
    ).select("*", F.ceil(F.col("n_tokens") / capacity).alias("n_least"), F.round(F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity), 6).alias("fill"))
