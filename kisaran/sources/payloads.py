"""Stored payloads of price portals read into observations (no network)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kisaran.functions.expressions import parse_price


def json_grid(bodies: DataFrame, body: str, keep: list[str], level: int = 2, style: str = "id") -> DataFrame:
    """Rows of a pivoted grid ``{"data": [{"name", "level", "dd/mm/yyyy": price, ...}]}``.

    One row per name and date column; only rows of ``level``; ``-``, blank and 0 are
    no prices.  A body that is no such JSON gives no rows.
    """
    entries = F.from_json(F.get_json_object(body, "$.data"), "array<map<string,string>>")
    rows = bodies.select(*keep, F.explode(entries).alias("_m")).where(F.col("_m")["level"].try_cast("int") == level)
    cells = rows.select(*keep, F.col("_m")["name"].alias("name"), F.explode(F.map_entries("_m")).alias("_e"))
    dated = cells.where(F.col("_e.key").rlike(r"^\d{2}/\d{2}/\d{4}$"))
    out = dated.select(*keep, "name", F.try_to_date(F.col("_e.key"), "dd/MM/yyyy").alias("obs_date"), parse_price(F.trim("_e.value"), style).alias("price"))
    return out.where("obs_date is not null and price > 0")


def json_variants(bodies: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Rows of ``{"data": [{"kode_provinsi", "harga", "tanggal"}]}``: one per province
    with a price; the date is its first ten characters."""
    entries = F.from_json(F.get_json_object(body, "$.data"), "array<struct<kode_provinsi: string, harga: double, tanggal: string>>")
    rows = bodies.select(*keep, F.inline(entries)).where("harga is not null")
    return rows.select(*keep, F.col("kode_provinsi").alias("province"), F.try_to_date(F.substring("tanggal", 1, 10)).alias("obs_date"), F.col("harga").alias("price"))


def html_table(pages: DataFrame, html: str, keep: list[str], price_class: str = "sekarang", style: str = "id") -> DataFrame:
    """Rows of an HTML table with five cells or more whose name begins with ``-``; the
    price is the cell of class ``price_class``; blank and 0 are dropped."""
    rows = pages.select(*keep, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("_tr"))
    cells = F.transform(F.regexp_extract_all("_tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", " ")))
    price = F.regexp_replace(F.regexp_extract("_tr", rf"(?is)<td[^>]*class=[\"'][^\"']*\b{price_class}\b[^\"']*[\"'][^>]*>(.*?)</td>", 1), "<[^>]+>", " ")
    named = rows.withColumns({"_c": cells, "_p": parse_price(price, style)}).where(F.size("_c") >= 5)
    name = F.filter("_c", lambda c: c.startswith("-"))[0]
    return named.withColumn("_n", name).where("_n is not null and _p > 0").select(*keep, F.trim(F.regexp_replace("_n", r"^-\s*", "")).alias("name"), F.col("_p").alias("price"))


def market_medians(rows: DataFrame, keys: list[str], price: str, market: str) -> DataFrame:
    """Median over the markets of one name and day, and the markets behind it."""
    return rows.where(F.col(price) > 0).groupBy(*keys).agg(F.median(price).alias("price"), F.sort_array(F.collect_set(market)).alias("markets"))


def date_chunks(spans: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """Inclusive windows of at most ``days`` days that cover each span without overlap."""
    starts = spans.where(F.col(first) <= F.col(last)).select("*", F.explode(F.expr(f"sequence(`{first}`, `{last}`, interval {int(days)} days)")).alias("chunk_start"))
    return starts.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(last)))


def deduplicate_snapshots(snapshots: DataFrame, keys: list[str], at: str, body: str) -> DataFrame:
    """Snapshots with their hash; the body is kept only where it differs from the one
    before of the same keys."""
    hashed = snapshots.withColumn("content_hash", F.sha2(F.col(body), 256))
    before = F.lag("content_hash").over(Window.partitionBy(*keys).orderBy(at))
    same = F.coalesce(before == F.col("content_hash"), F.lit(False))
    return hashed.withColumn("_same", same).withColumn(body, F.when(~F.col("_same"), F.col(body))).withColumnRenamed("_same", "is_unchanged")


def cache_key(*parts: Column) -> Column:
    """Stable key of a request."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
