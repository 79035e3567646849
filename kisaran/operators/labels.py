"""Annotators' labels: spellings, the standing label, agreement of every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("anomali", "normal", "ragu")


def canonical_label(label: Column) -> Column:
    """The label behind its spellings ("Nrml", "ragu2", "anomaly"), else NULL."""
    s = F.regexp_replace(F.lower(label), "[^a-z]", "")
    return F.when(s.rlike("^an[o]?m[a]?l"), "anomali").when(s.rlike("^n[o]?rm"), "normal").when(s.rlike("^rag"), "ragu")


def annotator_code(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, r"[^A-Za-z0-9]", ""))


def usable_labels(labels: DataFrame) -> DataFrame:
    """The standing label per (candidate, annotator): the latest usable one.

    Codes are trimmed and upper-cased.  NULL and unreadable labels, and rows
    without a candidate or a code, are no labels; of equal times the highest
    label_id stands.
    """
    code = annotator_code(F.col("annotator_code"))
    return (
        labels.select("candidate_id", code.alias("annotator"), canonical_label(F.col("label")).alias("label"), "labeled_at", "label_id")
        .where("candidate_id is not null and annotator != '' and label is not null")
        .groupBy("candidate_id", "annotator")
        .agg(F.max_by("label", F.struct("labeled_at", "label_id")).alias("label"))
    )


def label_pairs(labels: DataFrame) -> DataFrame:
    """candidate_id, annotator_a, label_a, annotator_b, label_b of every two annotators
    of a candidate, a before b.  Pairs are unfolded within the candidate; a row holds
    one candidate's labels at most."""
    own = F.sort_array(F.collect_list(F.struct("annotator", "label")))
    each = labels.groupBy("candidate_id").agg(own.alias("_all")).where(F.size("_all") > 1).select("candidate_id", "_all", F.posexplode("_all").alias("_i", "x"))
    return each.select("candidate_id", "x", F.explode(F.expr("slice(_all, _i + 2, size(_all))")).alias("y")).select(
        "candidate_id", F.col("x.annotator").alias("annotator_a"), F.col("x.label").alias("label_a"), F.col("y.annotator").alias("annotator_b"), F.col("y.label").alias("label_b")
    )


def pair_kappas(pairs: DataFrame, classes: tuple[str, ...] = LABELS) -> DataFrame:
    """Cohen's kappa of each pair of annotators with a candidate in common (0 where the
    expected agreement is 1)."""
    cells = pairs.groupBy("annotator_a", "annotator_b", "label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))
    held = lambda side, c: F.sum(F.when(F.col(side) == c, F.col("n")).otherwise(0))
    chance = sum((held("label_a", c) * held("label_b", c) for c in classes), F.lit(0))
    sums = cells.groupBy("annotator_a", "annotator_b").agg(F.sum("n").alias("n_paired"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("s"), chance.alias("e"))
    n = F.col("n_paired").cast("double")
    po, pe = F.col("s") / n, F.col("e") / (n * n)
    return sums.select("annotator_a", "annotator_b", "n_paired", po.alias("observed_agreement"), pe.alias("expected_agreement"), F.when(pe >= 1, 0.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def queues(candidates: DataFrame, labels: DataFrame, annotators: DataFrame) -> DataFrame:
    """annotator and candidate_id of every candidate without the annotator's label.
    The annotators are one array, so nothing is crossed."""
    done = labels.groupBy("candidate_id").agg(F.collect_set("annotator").alias("_done"))
    everyone = annotators.agg(F.collect_set("annotator").alias("_e"))
    open_ = candidates.select("candidate_id").join(done, "candidate_id", "left").withColumn("_e", everyone.scalar())
    return open_.select(F.explode(F.array_except("_e", F.coalesce("_done", F.array().cast("array<string>")))).alias("annotator"), "candidate_id")
