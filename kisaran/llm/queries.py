"""The queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kisaran.llm import aliases
from kisaran.llm import clusters
from kisaran.llm import consensus as cons
from kisaran.llm import mixing, packing, subjects
from kisaran.session import table


def _names(spark: SparkSession, base: str) -> DataFrame:
    typed = table(spark, base, "price_observations").where("commodity_slug is null and matched_alias is not null")
    ignored = table(spark, base, "normalize_reports").select("report_id", F.explode("ignored_names").alias("entered")).where("entered is not null")
    return typed.select(F.lit("price_observations").alias("origin"), F.col("obs_id").alias("row_id"), F.col("matched_alias").alias("entered")).unionByName(
        ignored.select(F.lit("normalize_reports").alias("origin"), F.col("report_id").alias("row_id"), "entered")
    )


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """The commodity behind every name that was not recognised, or ``unmatched``."""
    reference = aliases.reference_names(table(spark, base, "commodities"))
    mapped = aliases.map_names(_names(spark, base), "entered", reference)
    return mapped.select("origin", "row_id", "entered", F.col("_slug").alias("commodity_slug"))


def p2_report(spark: SparkSession, base: str) -> DataFrame:
    """Names and distinct spellings by origin, commodity and way of matching."""
    reference = aliases.reference_names(table(spark, base, "commodities"))
    mapped = aliases.map_names(_names(spark, base), "entered", reference)
    return mapped.groupBy("origin", F.col("_slug").alias("commodity_slug"), F.col("_how").alias("how")).agg(
        F.count(F.lit(1)).alias("n_names"), F.countDistinct("entered").alias("n_spellings")
    )


def _cells(spark: SparkSession, base: str) -> DataFrame:
    return clusters.cluster_cells(table(spark, base, "cluster_assignments"), table(spark, base, "price_daily_unified"))[0]


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The zone of every cell that has none, from its group."""
    return clusters.fill_zones(_cells(spark, base))


def p3_groups(spark: SparkSession, base: str) -> DataFrame:
    """Size and most typical cells of each group."""
    return clusters.describe(_cells(spark, base), "cell_id")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """The consensus label of every candidate with at least three annotators."""
    return cons.consensus(table(spark, base, "gt_labels")).select("candidate_id", "label")


def p5_reliability(spark: SparkSession, base: str) -> DataFrame:
    """Reliability, agreement and kappa against the consensus of each annotator."""
    return cons.reliabilities(*cons.annotator_weights(cons.usable_labels(table(spark, base, "gt_labels"))))


def p5_agreement(spark: SparkSession, base: str) -> DataFrame:
    """Fleiss' kappa over all candidates."""
    return cons.fleiss(cons.usable_labels(table(spark, base, "gt_labels")))


def p8_packing(spark: SparkSession, base: str) -> DataFrame:
    """The container of every document or piece of one."""
    return packing.pack(table(spark, base, "documents"))


def p8_report(spark: SparkSession, base: str) -> DataFrame:
    """Containers used, least possible, and how full they are."""
    return packing.packing_report(p8_packing(spark, base))


def p9_mixture(spark: SparkSession, base: str) -> DataFrame:
    """How often each document is in the mixture."""
    return mixing.mix(table(spark, base, "documents"), table(spark, base, "mixture_targets"))[0]


def p9_report(spark: SparkSession, base: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix(table(spark, base, "documents"), table(spark, base, "mixture_targets"))[1]


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """The subject areas of every document."""
    return subjects.subject_areas(table(spark, base, "documents"))


def p10_composition(spark: SparkSession, base: str) -> DataFrame:
    """Documents and weight (in whole documents' sentences) of each subject."""
    shares = subjects.subject_shares(table(spark, base, "documents"))
    return shares.groupBy("subject").agg(
        F.count_if(F.col("share") >= subjects.SubjectParams().share).alias("n_documents"), F.round(F.sum("share"), 3).alias("weight")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_groups, p5_found, p5_reliability, p5_agreement, p8_packing, p8_report, p9_mixture, p9_report, p10_found, p10_composition)}

SQL: dict[str, str] = {
    "p5_agreement": """WITH l AS (
  SELECT candidate_id, upper(regexp_replace(annotator_code, '[^A-Za-z0-9]', '', 'g')) AS a, labeled_at, label_id,
    regexp_replace(lower(label), '[^a-z]', '', 'g') AS s FROM gt_labels),
m AS (SELECT *, CASE WHEN s LIKE 'anomal%' THEN 'anomali' WHEN s LIKE 'norm%' OR s LIKE 'nrm%' THEN 'normal' WHEN s LIKE 'rag%' THEN 'ragu' END AS label FROM l),
e AS (SELECT candidate_id, a, arg_max(label, row(labeled_at, label_id)) AS label FROM m WHERE label IS NOT NULL AND a <> '' AND candidate_id IS NOT NULL GROUP BY ALL),
i AS (SELECT candidate_id, count(*) AS n, count(*) FILTER (label = 'anomali') AS c0, count(*) FILTER (label = 'normal') AS c1, count(*) FILTER (label = 'ragu') AS c2 FROM e GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT count(*) AS n_items, avg((c0 * (c0 - 1) + c1 * (c1 - 1) + c2 * (c2 - 1)) / (n * (n - 1))) AS po,
  (sum(c0) / sum(n)) * (sum(c0) / sum(n)) + (sum(c1) / sum(n)) * (sum(c1) / sum(n)) + (sum(c2) / sum(n)) * (sum(c2) / sum(n)) AS pe FROM i)
SELECT n_items, round(po, 6) AS observed_agreement, round(pe, 6) AS expected_agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM s""",
}
