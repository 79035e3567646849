"""Quantities written in different units, packs and money scales.

A written unit is read into one or more hypotheses (amount of a base unit, scale
of the money).  Each hypothesis gives the quantity per canonical unit through the
identity  price x money scale = canonical price x amount; the hypothesis with the
least log residual against the usual canonical price of that commodity is taken,
and a row whose two best hypotheses fit about equally well, yet say different
things, is flagged as not unique.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of units, packs, number words and money scales.
UNIT_WORDS = {
    "kg": "kg", "kgs": "kg", "kilo": "kg", "kilogram": "kg", "kilograms": "kg",
    "g": "gram", "gr": "gram", "grm": "gram", "gram": "gram", "grams": "gram",
    "ons": "ons", "ounce": "ons",
    "kuintal": "kuintal", "kwintal": "kuintal", "kwt": "kuintal", "kw": "kuintal", "ku": "kuintal",
    "ton": "ton", "tonne": "ton",
    "l": "liter", "lt": "liter", "ltr": "liter", "liter": "liter", "litre": "liter",
    "ml": "ml", "mililiter": "ml", "cc": "ml",
    "butir": "butir", "btr": "butir", "biji": "butir", "bj": "butir",
    "lusin": "lusin", "dozen": "lusin", "losin": "lusin",
    "ikat": "ikat", "iket": "ikat", "ikt": "ikat",
}
PIECE_WORDS = ["ekor", "buah", "bh", "bungkus", "bks", "kaleng", "klg", "tumpuk", "keranjang", "gelas", "sachet", "saset", "lembar", "batang", "potong", "porsi", "sisir", "papan", "rantang", "genggam"]
PACK_WORDS = ["dus", "kardus", "karton", "pak", "pack", "bal", "peti", "rak", "tray", "krat", "karung", "sak", "zak", "jerigen", "jeriken", "drum", "botol", "btl", "kotak", "box", "plastik", "kantong", "bag"]
NUMBER_WORDS = {
    "seperempat": 0.25, "setengah": 0.5, "separuh": 0.5, "tigaperempat": 0.75, "satu": 1.0, "se": 1.0, "dua": 2.0, "tiga": 3.0, "empat": 4.0,
    "lima": 5.0, "enam": 6.0, "tujuh": 7.0, "delapan": 8.0, "sembilan": 9.0, "sepuluh": 10.0, "selusin": 12.0, "seratus": 100.0,
}
MONEY = {"rb": 1e3, "ribu": 1e3, "ribuan": 1e3, "k": 1e3, "jt": 1e6, "juta": 1e6}

_NUM = r"\d+(?:[.,]\d+)?(?:/\d+)?|[½¼¾]"
_TOKEN = re.compile(rf"{_NUM}|[^\W\d_]+|[x×/@()]")
_INVISIBLE = re.compile("[\u200b-\u200f\ufeff\u00a0]")
_HALVES = {"½": 0.5, "¼": 0.25, "¾": 0.75}


def _number(tok: str) -> float | None:
    if tok in _HALVES:
        return _HALVES[tok]
    if tok in NUMBER_WORDS:
        return NUMBER_WORDS[tok]
    if re.fullmatch(_NUM, tok):
        a, _, b = tok.partition("/")
        top = float(a.replace(",", "."))
        return top / float(b) if b and float(b) else (top if not b else None)
    return None


def read_unit(text: str | None) -> list[tuple[float, str | None, float]]:
    """Readings of a written unit: (amount, base unit, money scale), likeliest first.

    An empty list means that no unit is written.  The base unit ``?`` stands for a
    unit of a kind that cannot be converted (a heap, a tin), ``*`` for pieces of
    whatever the commodity is counted in.
    """
    if text is None:
        return []
    low = re.sub(r"([½¼¾])", r" \1 ", text)
    low = _INVISIBLE.sub(" ", low).casefold().strip(" .,;:()[]")
    if not low:
        return []
    money = 1.0
    scaled = re.match(r"^(?:(rb|ribu|ribuan|jt|juta)\b\.?\s*(?:rp\.?|rupiah)?|rp\.?\s*(000(?:\.000)?))\s*(?:/|per\b|@)?\s*(.*)$", low)
    if scaled and (scaled[1] or scaled[2]):
        money = MONEY[scaled[1]] if scaled[1] else (1e3 if scaled[2] == "000" else 1e6)
        low = scaled[3]
    else:
        low = re.sub(r"^(?:rp\.?|rupiah)\s*(?:/|per\b|@)\s*", "", low)
    toks = _TOKEN.findall(low)
    known, numbers, unit, packs, piece, times = [], [], None, 0, False, False
    for t in toks:
        n = _number(t)
        if n is not None:
            numbers.append(n)
        elif t in UNIT_WORDS:
            if unit is not None and UNIT_WORDS[t] != unit:
                return [(1.0, "?", money)]
            unit = UNIT_WORDS[t]
        elif t in PACK_WORDS:
            packs += 1
        elif t in PIECE_WORDS:
            piece = True
        elif t in ("x", "×"):
            times = True
        elif t not in ("per", "@", "/", "isi", "tiap", "setiap", "(", ")", "ukuran", "kemasan"):
            known.append(t)
    if unit is None and known:
        return [(1.0, "?", money)]
    if unit is None:
        if piece or (packs and not numbers):
            return [(1.0, "?", money)]
        return [(math.prod(numbers), "count", money)] if numbers else ([(1.0, "*", money)] if money != 1.0 else [])
    return _amounts(numbers, unit, times, money)


def _amounts(numbers: list[float], unit: str, times: bool, money: float) -> list[tuple[float, str | None, float]]:
    numbers = [n for n in numbers if n > 0]
    whole = math.prod(numbers) if numbers else 1.0
    out = [(whole, unit, money)]
    if times and len(numbers) == 2:  # "20 x 500 gr" may price the box or the piece in it
        out.append((numbers[1], unit, money))
    return out


def alias_unit(name: str | None) -> str | None:
    """The unit text that closes a typed name ("Gula Aren (2,5 kg)"), or None."""
    if not name:
        return None
    clean = _INVISIBLE.sub(" ", name)
    for start in [m.start() for m in re.finditer(r"@|\(|,|\s(?:per|tiap)\s", clean, re.I)]:
        tail = re.sub(r"^\s*(?:@|\(|,|(?:per|tiap)\s)\s*", "", clean[start:], flags=re.I).strip().rstrip(")").strip()
        if tail and read_unit(tail) and _only_unit(tail):
            return tail
    return None


def _only_unit(tail: str) -> bool:
    words = [t for t in _TOKEN.findall(tail.casefold()) if t[0].isalpha()]
    fine = {*UNIT_WORDS, *PIECE_WORDS, *PACK_WORDS, *NUMBER_WORDS, *MONEY, "rp", "rupiah", "per", "isi", "x", "tiap", "setiap", "ukuran", "kemasan"}
    return all(w in fine for w in words)


READING = T.ArrayType(
    T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("money", T.DoubleType())])
)


@F.pandas_udf(READING)
def _readings_of_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"amount": a, "unit": u, "money": m} for a, u, m in read_unit(t)])


@F.pandas_udf(READING)
def _readings_of_name(names: pd.Series) -> pd.Series:
    return names.map(lambda t: [{"amount": a, "unit": u, "money": m} for a, u, m in read_unit(alias_unit(t))])


def factors(conversions: DataFrame, max_units: int = 1000) -> list[tuple[str, str, float, tuple[str, ...] | None]]:
    """(from, to, amount of ``to`` in one ``from``, commodities) with chains of two.

    The table's rounded column is not used where the other is exact: the amount
    stands, unless it is itself the rounded reciprocal of the price factor.
    Raises ValueError beyond ``max_units`` rows, the bound under which the table
    is read by the driver.
    """
    rows = conversions.select("from_unit", "to_unit", "amount", "price_factor", "applies_to").limit(max_units + 1).collect()
    if len(rows) > max_units:
        raise ValueError(f"more than {max_units} unit conversions")
    direct = []
    for r in rows:
        if r.from_unit is None or r.to_unit is None or not r.amount:
            continue
        amount, factor = float(r.amount), float(r.price_factor or 0)
        if factor and round(1 / factor, 6) == amount:
            amount = 1 / factor
        only = tuple(x.strip() for x in r.applies_to.split(",") if x.strip()) if r.applies_to else None
        direct.append((r.from_unit, r.to_unit, amount, only))
    chained = [
        (a, d, x * y, p if q is None else q if p is None else tuple(sorted(set(p) & set(q))))
        for a, b, x, p in direct
        for c, d, y, q in direct
        if b == c and a != d
    ]
    return [*direct, *chained]


def _amount_in(unit: Column, canonical: Column, commodity: Column, table: list) -> Column:
    """Canonical units in one ``unit``; NULL where it cannot be converted."""
    out = F.when((unit == canonical) | (unit == "*") | ((unit == "count") & canonical.isin("butir", "ikat")), F.lit(1.0))
    for a, b, x, only in table:
        cond = (unit == a) & (canonical == b)
        out = out.when(cond & commodity.isin(*only) if only is not None else cond, F.lit(x))
    return out


def usual_levels(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Median price per canonical unit of each (commodity, region) and of each
    commodity, from rows whose unit is known."""
    sure = obs.where("unit_factor is not null and price_idr > 0 and commodity_slug is not null").select(
        F.col("commodity_slug").alias("_slug"), F.col("region").alias("_region"), F.col("price_idr").cast("double").alias("_p")
    )
    here = sure.groupBy("_slug", "_region").agg(F.percentile_approx("_p", 0.5, 1000).alias("_here"))
    return here, sure.groupBy("_slug").agg(F.percentile_approx("_p", 0.5, 1000).alias("_overall"))


def to_common_units(obs: DataFrame, commodities: DataFrame, conversions: DataFrame, tie: float = math.log(1.6)) -> DataFrame:
    """Rows of ``obs`` whose ``unit_factor`` is NULL, in canonical units.

    Columns: obs_id, commodity_slug, canonical_unit, written_unit (the unit taken),
    price_canonical (bigint, NULL if the unit cannot be converted), log_residual
    and non_unique (another reading fits within ``tie`` and gives another price).

    A unit in ``matched_alias`` outranks ``raw_unit``.  No result row comes from a
    NULL price, commodity or unit; zero and negative prices are converted without
    a residual.  A series without known prices is held
    against its commodity; a commodity without any takes the first reading and
    leaves the residual NULL.  Repeated rows each give their row; ties between
    readings go to the first.  An empty table gives an empty result.

    Scale: the levels are one number per series and per commodity, made by
    partial aggregation; texts are read by Arrow batches on the rows without a
    factor only; hypotheses are weighed inside each row, without a shuffle.
    """
    table = factors(conversions)
    goods = commodities.select(F.col("slug").alias("_slug"), F.col("canonical_unit").alias("_canon")).dropDuplicates(["_slug"])
    here, overall = usual_levels(obs)
    levels = goods.join(overall, "_slug", "left")
    open_rows = obs.where("unit_factor is null and price_idr is not null and commodity_slug is not null").select(
        "obs_id", "commodity_slug", "region", F.col("price_idr").cast("double").alias("_price"), "raw_unit", "matched_alias"
    )
    read = open_rows.select(
        "*", _readings_of_name("matched_alias").alias("_alias_read"), _readings_of_text("raw_unit").alias("_raw_read")
    ).select("obs_id", "commodity_slug", "region", "_price", F.when(F.size("_alias_read") > 0, F.col("_alias_read")).otherwise(F.col("_raw_read")).alias("_read"))
    placed = read.join(here.withColumnRenamed("_slug", "_hslug"), (F.col("commodity_slug") == F.col("_hslug")) & F.col("region").eqNullSafe(F.col("_region")), "left")
    known = placed.join(levels, F.col("commodity_slug") == F.col("_slug"), "inner").withColumn("_level", F.coalesce("_here", "_overall"))
    def hypothesis(r: Column, rank: Column) -> Column:
        amount = r["amount"] * _amount_in(r["unit"], F.col("_canon"), F.col("commodity_slug"), table)
        price = F.col("_price") * r["money"] / amount
        residual = F.when((price > 0) & (F.col("_level") > 0), F.abs(F.log(price / F.col("_level"))))
        return F.struct(F.coalesce(residual, F.lit(1e9)).alias("order"), rank.alias("rank"), r["unit"].alias("unit"), price.alias("price"), residual.alias("residual"))

    best = known.where(F.size("_read") > 0).withColumn("_all", F.array_sort(F.transform("_read", hypothesis))).withColumn("_best", F.element_at("_all", 1))
    rival = F.get("_all", F.lit(1))["residual"] - F.col("_best.residual")
    return best.select(
        "obs_id",
        "commodity_slug",
        F.col("_canon").alias("canonical_unit"),
        F.col("_best.unit").alias("written_unit"),
        F.round("_best.price").cast("bigint").alias("price_canonical"),
        F.round("_best.residual", 6).alias("log_residual"),
        F.when(F.size("_all") > 1, F.coalesce(rival < tie, F.lit(False))).otherwise(False).alias("non_unique"),
    )
