"""Run records: what ran, with which parameters, and how it ended."""

from __future__ import annotations

import json
import subprocess
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id long, run_type string, status string, seed long, params string, lib_versions string, revision string, notes string, started_at timestamp, finished_at timestamp"


def revision(folder: str = ".") -> str:
    """Commit of the working tree, ``-dirty`` if it has changes, ``unknown`` without one."""
    try:
        run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, timeout=20, check=True).stdout.strip()
        return run("rev-parse", "HEAD") + ("-dirty" if run("status", "--porcelain") else "")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def library_versions(names: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict[str, str]:
    return {n: metadata.version(n) for n in names}


@dataclass
class Run:
    run_id: int
    run_type: str
    seed: int
    params: dict
    status: str = "running"
    notes: list[str] = field(default_factory=list)
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))
    finished_at: datetime | None = None

    def row(self) -> tuple:
        return (self.run_id, self.run_type, self.status, self.seed, json.dumps(self.params, sort_keys=True), json.dumps(library_versions(), sort_keys=True), revision(), "; ".join(self.notes), self.started_at, self.finished_at)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.row()], SCHEMA)


@contextmanager
def run(run_id: int, run_type: str, seed: int, **params):
    """A run that ends as success, partial (if it was set so) or failed."""
    record = Run(run_id, run_type, seed, params)
    try:
        yield record
        if record.status == "running":
            record.status = "success"
    except Exception as error:
        record.status = "failed"
        record.notes.append(f"{type(error).__name__}: {error}")
        raise
    finally:
        record.finished_at = datetime.now(timezone.utc).replace(tzinfo=None)


def latest_run(runs: DataFrame, run_type: str, statuses: tuple[str, ...] = ("success",)) -> DataFrame:
    """The highest run id of a type in one of the statuses (one row or none)."""
    return runs.where(F.col("run_type") == run_type).where(F.col("status").isin(*statuses)).agg(F.max("run_id").alias("run_id")).where("run_id is not null")


def close_stale(runs: DataFrame, now: datetime, hours: int = 6) -> DataFrame:
    """Runs still open after ``hours`` become failed."""
    stale = (F.col("status") == "running") & (F.col("started_at") < F.lit(now) - F.expr(f"interval {int(hours)} hours"))
    return runs.withColumns({"notes": F.when(stale, "closed: never finished").otherwise(F.col("notes")), "finished_at": F.when(stale, F.lit(now)).otherwise(F.col("finished_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def check_schema(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """What is missing from ``df`` or has another type; an empty list if nothing."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in expected.items() if have.get(c) != t]
