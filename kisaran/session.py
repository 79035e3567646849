"""Session helpers: building a local session, reading tables, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kisaran")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers.

    Where the workers see it anyway (its folder is the working directory or on
    PYTHONPATH of a local master) nothing is done; else it is sent once as a zip.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    seen = [Path(p or ".").resolve() for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if root in seen and sc.master.startswith("local") or getattr(sc, "_kisaran_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="kisaran-zip-"))  # served to the executors by the driver
    with zipfile.ZipFile(folder / "kisaran.zip", "w") as z:
        for f in sorted((root / "kisaran").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(folder / "kisaran.zip"))
    sc._kisaran_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the folder that the session names.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is taken as
    it is.  Only where it is unset, as in a local test, a folder is made here.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = Path(tempfile.mkdtemp(prefix="kisaran-checkpoint-")).as_uri()
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
