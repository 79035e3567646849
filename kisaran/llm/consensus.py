"""Consensus of several annotators' labels by bipartite message passing.

Every label is an edge between an item and an annotator.  For each class, taken
against the rest, edge messages run from items to annotators (how strongly the
item's other labels back the class) and back (how reliable the annotator is on
its other items), normalised by degree and scale, until they stand still.  The
mean message over the classes ranks the annotators; from that start the chance
of each annotator to agree with the others' weighted vote is measured, its own
label left out, and its log-odds weigh the final vote.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kisaran.operators.labels import LABELS, canonical_label, usable_labels
from kisaran.session import cut_lineage

#: Beyond so many annotators their table is joined by shuffle instead of broadcast.
BROADCAST_ANNOTATORS = 50_000


def _by_annotator(edges: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    return edges.join(F.broadcast(table) if few else table, "annotator")


def _sign(c: str) -> Column:
    return F.when(F.col("label") == c, 1.0).otherwise(-1.0)


def annotator_weights(edges: DataFrame, classes: tuple[str, ...] = LABELS, max_rounds: int = 200, tolerance: float = 0.001, refine: int = 2) -> tuple[DataFrame, DataFrame]:
    """(edges, annotators): ``annotators`` holds n_labels, reliability (the chance
    to agree with the rest, smoothed) and weight (its log-odds).

    Scale: both sides are partial aggregations over flat edges, so an annotator
    with a third of all labels is combined before the shuffle; nothing is grouped
    into one task.  The annotator table is broadcast only below a checked count.
    Each round is cut by a checkpoint.  The messages stand still when no edge moves
    by ``tolerance`` (of the messages' root mean square); the move shrinks by a
    constant factor a round (five to eight rounds on the test tables).  Where it
    does not shrink (annotators who contradict each other flip all signs each
    round), messages are mixed half and half with the ones before.  Should they
    still move after ``max_rounds``, a warning says by how much.
    """
    k = len(classes)
    ys = [f"y{n}" for n in range(k)]
    state = cut_lineage(edges.select("candidate_id", "annotator", "label", *[F.lit(1.0).alias(y) for y in ys]))
    few = state.select("annotator").distinct().limit(BROADCAST_ANNOTATORS + 1).count() <= BROADCAST_ANNOTATORS
    now, last = [F.col(y) for y in ys], None
    for _ in range(max_rounds):
        signed = [_sign(c) * n for c, n in zip(classes, now)]
        items = state.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("di"), *[F.sum(a).alias(f"t{n}") for n, a in enumerate(signed)])
        up = state.join(items, "candidate_id").select(
            "candidate_id", "annotator", "label", *[n.alias(f"old{j}") for j, n in enumerate(now)],
            *[((F.col(f"t{n}") - a) / F.greatest(F.col("di") - 1, F.lit(1)) * _sign(classes[n])).alias(f"m{n}") for n, a in enumerate(signed)],
        )
        totals = up.groupBy("annotator").agg(F.count(F.lit(1)).alias("dj"), *[F.sum(f"m{n}").alias(f"r{n}") for n in range(k)])
        state = cut_lineage(
            _by_annotator(up, totals, few).select(
                "candidate_id", "annotator", "label", *[f"old{n}" for n in range(k)],
                *[((F.col(f"r{n}") - F.col(f"m{n}")) / F.greatest(F.col("dj") - 1, F.lit(1))).alias(ys[n]) for n in range(k)],
            )
        )
        rms = state.agg(*[F.sqrt(F.avg(F.col(y) * F.col(y))).alias(y) for y in ys]).first()
        now = [F.col(y) / (float(x) if x else 1.0) for y, x in zip(ys, rms)]
        moved = state.agg(F.max(F.greatest(*[F.abs(n - F.col(f"old{j}")) for j, n in enumerate(now)]))).first()[0]
        if moved is None or moved < tolerance:
            break
        if last is not None and moved > 0.9 * last:
            now = [(n + F.col(f"old{j}")) / 2 for j, n in enumerate(now)]
        last = moved
    else:
        warnings.warn(f"the messages still move by {moved:.3g} after {max_rounds} rounds; the tolerance is {tolerance:.3g}", RuntimeWarning, stacklevel=2)
    start = sum(now, F.lit(0.0)) / k
    weights = state.groupBy("annotator").agg(F.avg(start).alias("weight"), F.count(F.lit(1)).alias("n_labels"))
    plain = state.select("candidate_id", "annotator", "label")
    for _ in range(refine):
        weights = cut_lineage(_log_odds(plain, weights, classes, few))
    return plain, weights


def _log_odds(edges: DataFrame, weights: DataFrame, classes: tuple[str, ...], few: bool) -> DataFrame:
    """Weights anew: log-odds of agreeing with the weighted vote of the others."""
    weighed = _by_annotator(edges, weights.select("annotator", "weight"), few)
    votes = weighed.groupBy("candidate_id").agg(*[F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)).alias(f"v{n}") for n, c in enumerate(classes)], F.count(F.lit(1)).alias("n"))
    rest = [F.col(f"v{n}") - F.when(F.col("label") == c, F.col("weight")).otherwise(0.0) for n, c in enumerate(classes)]
    best = F.greatest(*rest)
    own = F.coalesce(*[F.when(F.col("label") == c, r) for c, r in zip(classes, rest)])
    judged = weighed.join(votes.where("n > 1"), "candidate_id").select("annotator", F.when(own >= best, 1.0).otherwise(0.0).alias("hit"))
    chance = judged.groupBy("annotator").agg(((F.sum("hit") + 1) / (F.count(F.lit(1)) + 2)).alias("reliability"))
    counts = edges.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_labels"))
    return counts.join(chance, "annotator", "left").select(
        "annotator", "n_labels", F.coalesce("reliability", F.lit(0.5)).alias("reliability"),
        F.log(F.coalesce("reliability", F.lit(0.5)) * (len(classes) - 1) / (1 - F.coalesce("reliability", F.lit(0.5)))).alias("weight"),
    )


def consensus(labels: DataFrame, classes: tuple[str, ...] = LABELS, min_annotators: int = 3, **settings) -> DataFrame:
    """candidate_id, label, n_annotators, support (share of the weight) per candidate
    with usable labels of at least ``min_annotators`` annotators.

    Of equal support the first class in alphabetical order is taken.  Repeated
    rows, NULL labels and spellings: see :func:`usable_labels`.  An empty table
    gives an empty result.
    """
    edges, weights = annotator_weights(usable_labels(labels), classes, **settings)
    return decide(edges, weights, classes, min_annotators)


def decide(edges: DataFrame, weights: DataFrame, classes: tuple[str, ...] = LABELS, min_annotators: int = 1) -> DataFrame:
    """The weighted vote per candidate."""
    weighed = edges.join(weights.select("annotator", "weight"), "annotator")
    sums = weighed.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n_annotators"), F.sum(F.abs("weight")).alias("_all"),
        *[F.sum(F.when(F.col("label") == c, F.col("weight"))).alias(f"v{n}") for n, c in enumerate(classes)],
    ).where(F.col("n_annotators") >= min_annotators)
    ballots = F.array_sort(
        F.array(*[F.struct((-F.coalesce(F.round(f"v{n}", 9), F.lit(-1e9))).alias("s"), F.lit(c).alias("c")) for n, c in enumerate(classes)])
    )
    first = F.element_at(ballots, 1)
    return sums.select("candidate_id", first["c"].alias("label"), "n_annotators", F.round(F.try_divide(-first["s"], F.col("_all")), 6).alias("support"))


def reliabilities(edges: DataFrame, weights: DataFrame, classes: tuple[str, ...] = LABELS) -> DataFrame:
    """Per annotator: labels, reliability, and Cohen's kappa against the consensus."""
    truth = decide(edges, weights, classes).select("candidate_id", F.col("label").alias("truth"))
    cells = edges.join(truth, "candidate_id").groupBy("annotator", "label", "truth").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("annotator")
    marg = cells.select(
        "annotator", "n", "label", "truth", F.sum("n").over(whole).alias("t"),
        F.sum("n").over(Window.partitionBy("annotator", "label")).alias("a"), F.sum("n").over(Window.partitionBy("annotator", "truth")).alias("b"),
    )
    same = marg.groupBy("annotator").agg((F.sum(F.when(F.col("label") == F.col("truth"), F.col("n")).otherwise(0)) / F.max("t")).alias("po"))
    rows = marg.groupBy("annotator", "label").agg((F.max("a") / F.max("t")).alias("pa"))
    cols = marg.groupBy("annotator", F.col("truth").alias("label")).agg((F.max("b") / F.max("t")).alias("pb"))
    by_chance = rows.join(cols, ["annotator", "label"]).groupBy("annotator").agg(F.sum(F.col("pa") * F.col("pb")).alias("pe"))
    return (
        weights.join(same, "annotator").join(by_chance, "annotator", "left")
        .select(
            "annotator", "n_labels", F.round("reliability", 6).alias("reliability"), F.round("po", 6).alias("agreement"),
            F.round(F.when(F.coalesce("pe", F.lit(0.0)) >= 1, 0.0).otherwise((F.col("po") - F.coalesce("pe", F.lit(0.0))) / (1 - F.coalesce("pe", F.lit(0.0)))), 6).alias("kappa"),
        )
    )


def fleiss(edges: DataFrame, classes: tuple[str, ...] = LABELS) -> DataFrame:
    """Fleiss' kappa over candidates with two labels or more (one row)."""
    item = edges.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("label") == c).cast("int")).alias(f"c{i}") for i, c in enumerate(classes)]).where("n > 1")
    pairs = sum((F.col(f"c{i}") * (F.col(f"c{i}") - 1) for i in range(len(classes))), F.lit(0)) / (F.col("n") * (F.col("n") - 1))
    sums = item.agg(F.count(F.lit(1)).alias("n_items"), F.avg(pairs).alias("po"), F.sum("n").alias("t"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(len(classes))])
    pe = sum(((F.col(f"s{i}") / F.col("t")) * (F.col(f"s{i}") / F.col("t")) for i in range(len(classes))), F.lit(0.0))
    return sums.select(
        "n_items", F.round("po", 6).alias("observed_agreement"), F.round(pe, 6).alias("expected_agreement"),
        F.round(F.when(pe < 1, (F.col("po") - pe) / (1 - pe)), 6).alias("kappa"),
    )


__all__ = ["LABELS", "annotator_weights", "canonical_label", "consensus", "decide", "fleiss", "reliabilities", "usable_labels"]
