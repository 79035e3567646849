"""Micro-batches of observations: idempotent upsert, and days held until settled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kisaran.sources.sinks import upsert


def upsert_stream(stream: DataFrame, path: str, keys: list[str], version: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Merge every micro-batch into the table at ``path``; a batch that is delivered
    twice leaves the table as it is.  Ends when the input at hand is used up."""

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch, path, keys, version, partition)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled_days(stream: DataFrame, at: str, keys: list[str], value: str, delay: str = "1 day") -> DataFrame:
    """Daily counts and means per key, put out once the day can no longer change.

    ``at`` is a timestamp; rows later than ``delay`` are dropped by the watermark.
    """
    return (
        stream.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean_value"))
        .select(F.col("_w.start").cast("date").alias("obs_date"), *keys, "n_rows", "mean_value")
    )


def settled_before(df: DataFrame, at: str, as_of: str | None = None) -> DataFrame:
    """Rows of days before ``as_of`` (yyyy-MM-dd), the day still open; without it the
    newest day in ``df`` is the open one."""
    day = F.lit(as_of).cast("date") if as_of else df.agg(F.max(at)).scalar()
    return df.where(F.col(at) < day)
