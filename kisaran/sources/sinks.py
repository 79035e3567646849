"""Writers: idempotent upserts, appends, and exports of small tables."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def merge(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, per key the one of the highest ``version`` (new over old on ties)."""
    cols = old.columns
    stacked = old.withColumn("_n", F.lit(0)).unionByName(new.select(*cols).withColumn("_n", F.lit(1)))
    values = [c for c in cols if c not in keys]
    best = F.max_by(F.struct(*values), F.struct(version, "_n")).alias("_x")
    return stacked.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"_x.{c}").alias(c) for c in cols])


def upsert(new: DataFrame, path: str, keys: list[str], version: str, partition: str | None = None) -> None:
    """Merge ``new`` into the table at ``path``; only partitions it touches are
    rewritten.  Loading the same rows again changes nothing.

    The merged rows are written aside first, since a table cannot be overwritten
    while it is read; the swap is the last step.
    """
    spark = new.sparkSession
    old = read_or_none(spark, path)
    if old is None:
        writer = merge(new.limit(0), new, keys, version).write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        return
    if partition:
        touched = new.select(partition).distinct()
        old = old.join(touched, partition, "left_semi")
    aside = f"{path}.{uuid.uuid4().hex}"
    merge(old, new, keys, version).write.parquet(aside)
    try:
        fresh = spark.read.parquet(aside).write.mode("overwrite")
        if partition:
            fresh.option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        else:
            fresh.parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(aside)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append_missing(new: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key the table lacks (``do nothing`` on conflict); how many."""
    spark = new.sparkSession
    old = read_or_none(spark, path)
    fresh = new.dropDuplicates(keys)
    if old is not None:
        fresh = fresh.join(old.select(*keys).distinct(), keys, "left_anti")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def classify_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``change``: inserted, updated, unchanged or orphaned (only in the old)."""
    values = [c for c in new.columns if c not in keys]
    side = lambda df, n: df.select(*keys, F.xxhash64(*[F.col(c) for c in values]).alias(f"_{n}"), F.lit(True).alias(f"_in_{n}"))
    full = side(old, "o").join(side(new, "n"), keys, "full")
    change = F.when(F.col("_in_o").isNull(), "inserted").when(F.col("_in_n").isNull(), "orphaned").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("updated")
    return full.select(*keys, change.alias("change"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for tables of report size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# Characters that LaTeX reads as commands.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_text(value: object) -> str:
    if value is None:
        return "--"
    if isinstance(value, float):
        return f"{value:.4f}"
    return "".join(LATEX.get(c, c) for c in str(value))


def _report_rows(df: DataFrame, max_rows: int) -> list:
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report holds at most {max_rows} rows")
    return rows


def to_latex(df: DataFrame, max_rows: int = 2000) -> str:
    """A LaTeX table of a small result; numbers to the right, NULL as ``--``."""
    numeric = {"int", "bigint", "double", "float", "smallint"}
    align = "".join("r" if t in numeric or t.startswith("decimal") else "l" for _, t in df.dtypes)
    lines = [rf"\begin{{tabular}}{{{align}}}", r"\hline", " & ".join(latex_text(c) for c in df.columns) + r" \\", r"\hline"]
    lines += [" & ".join(latex_text(v) for v in row) + r" \\" for row in _report_rows(df, max_rows)]
    return "\n".join([*lines, r"\hline", r"\end{tabular}"]) + "\n"


def to_markdown(sections: list[tuple[str, DataFrame]], max_rows: int = 2000) -> str:
    """A Markdown report of small results, one table a section."""
    out = []
    for title, df in sections:
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in _report_rows(df, max_rows)] + [""]
    return "\n".join(out)


def write_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
