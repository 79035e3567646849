"""Reference lists (commodities, regions, sources, units) as tables, and what in them
does not fit together."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kisaran.operators.normalize import alias_collisions, alias_index

SCHEMAS = {
    "commodities": "slug string, display_name string, canonical_unit string, sort_order int, source_aliases map<string, array<string>>, unavailable_at array<string>, min_price double, max_price double",
    "regions": "slug string, display_name string, level string, parent_slug string, bps_code string",
    "sources": "slug string, display_name string, cadence string, regions array<string>, is_active boolean, is_price_source boolean",
    "units": "unit string, spelling string",
    "conversions": "from_unit string, to_unit string, factor double, applies_to array<string>",
}


def read_document(path: Path) -> dict:
    """A JSON or YAML document; YAML needs the yaml package."""
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def _rows(name: str, doc: dict) -> list[dict]:
    if name == "commodities":
        return [{**x, "min_price": (x.get("plausible_price") or {}).get("min"), "max_price": (x.get("plausible_price") or {}).get("max")} for x in doc["commodities"]]
    if name == "units":
        return [{"unit": unit, "spelling": s} for unit, spellings in doc["aliases"].items() for s in spellings]
    if name == "conversions":
        return [{"from_unit": x["from"], "to_unit": x["to"], "factor": x["factor"], "applies_to": x.get("applies_to")} for x in doc["conversions"]]
    if name == "sources":
        return [{"is_active": True, "is_price_source": x.get("slug") != "trends", **x} for x in doc["sources"]]
    return list(doc[name])


def load_reference(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The lists of a folder with commodities, regions, sources and units documents."""
    frames = {}
    for name, schema in SCHEMAS.items():
        file = "units" if name == "conversions" else name
        path = next((p for s in (".json", ".yaml", ".yml") if (p := Path(folder) / f"{file}{s}").exists()), None)
        if path is None:
            raise FileNotFoundError(f"no {file} document in {folder}")
        types = spark.createDataFrame([], schema).schema
        number = {f.name for f in types.fields if f.dataType.typeName() == "double"}
        rows = [tuple(float(v) if f in number and v is not None else v for f in types.names for v in [x.get(f)]) for x in _rows(name, read_document(path))]
        frames[name] = spark.createDataFrame(rows, types)
    return frames


def reference_problems(commodities: DataFrame, regions: DataFrame, sources: DataFrame) -> DataFrame:
    """``kind``, ``owner`` and ``value`` of everything that does not fit together.

    Unknown parents, regions and sources; sources listed both with names and as
    unavailable; active price sources a commodity says nothing about; names of a
    source that stand for two commodities.  The lists may lack unavailable_at,
    regions, is_active and is_price_source.
    """
    have = lambda df, c, other: F.col(c) if c in df.columns else other
    none = F.array().cast("array<string>")
    places, known = regions.select(F.col("slug").alias("value")), sources.select(F.col("slug").alias("value"))
    goods = commodities.select(F.col("slug").alias("owner"), F.map_keys("source_aliases").alias("named"), F.coalesce(have(commodities, "unavailable_at", none), none).alias("barred"))
    pair = lambda c: goods.select("owner", F.explode(c).alias("value"))
    active = sources.where(have(sources, "is_active", F.lit(True)) & have(sources, "is_price_source", F.lit(True))).agg(F.collect_set("slug")).scalar()
    found = [
        ("unknown_parent", regions.where("parent_slug is not null").select(F.col("slug").alias("owner"), F.col("parent_slug").alias("value")).join(places, "value", "left_anti")),
        ("unknown_region", sources.select(F.col("slug").alias("owner"), F.explode(have(sources, "regions", none)).alias("value")).join(places, "value", "left_anti")),
        ("unknown_source", pair(F.array_union("named", "barred")).join(known, "value", "left_anti")),
        ("named_and_unavailable", pair(F.array_intersect("named", "barred"))),
        ("undeclared_source", pair(F.array_except(F.coalesce(active, none), F.array_union("named", "barred")))),
        ("name_of_two", alias_collisions(alias_index(commodities)).select(F.col("source").alias("owner"), F.col("alias").alias("value"))),
    ]
    out = None
    for kind, rows in found:
        part = rows.select(F.lit(kind).alias("kind"), "owner", "value")
        out = part if out is None else out.unionByName(part)
    return out


def require_sound(commodities: DataFrame, regions: DataFrame, sources: DataFrame) -> None:
    """Raises with the first twenty problems, if there are any."""
    bad = reference_problems(commodities, regions, sources).orderBy("kind", "owner", "value").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r.kind}: {r.owner} -> {r.value}" for r in bad))
