"""Column expressions shared by the operators (all run inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 2) -> Column:
    """Round half up by floor, the same for doubles in any engine."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def fold(text: Column) -> Column:
    """Alias folding: runs of white space to one blank, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def same(a: Column, b: Column, *rest: tuple[Column, Column]) -> Column:
    """Null-safe equality of one or more pairs of columns."""
    out = a.eqNullSafe(b)
    for x, y in rest:
        out = out & x.eqNullSafe(y)
    return out


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, NULL where the whole is 0 or NULL."""
    return F.try_divide(part * 100.0, whole.cast("double"))


def parse_price(text: Column, style: str) -> Column:
    """Price text to double; ``style`` "id" writes 12.508,50 and "en" 12,508.50.

    Currency words and other signs go; with both separators the thousands one is
    dropped; a lone thousands separator is dropped only if it parts groups of
    three digits, else it is read as a decimal point.  No digits give NULL.
    """
    thousands, decimal = (r"\.", ",") if style == "id" else (",", r"\.")
    plain_t, plain_d = (".", ",") if style == "id" else (",", ".")
    kept = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), "rp|idr", ""), r"[^\d.,-]", ""), F.lit(".,"))
    has_t, has_d = kept.contains(plain_t), kept.contains(plain_d)
    grouped = kept.rlike(rf"^-?\d{{1,3}}({thousands}\d{{3}})+$")
    number = (
        F.when(has_t & has_d, F.regexp_replace(F.regexp_replace(kept, thousands, ""), decimal, "."))
        .when(has_t, F.when(grouped, F.regexp_replace(kept, thousands, "")).otherwise(F.regexp_replace(kept, thousands, ".")))
        .when(has_d, F.regexp_replace(kept, decimal, "."))
        .otherwise(kept)
    )
    return F.when(kept.rlike(r"\d"), number.try_cast("double"))


def unit_of_name(name: Column) -> Column:
    """The unit that closes a name after its last comma ("Bawang,1 kg" -> "1 kg")."""
    unit = F.regexp_extract(name, r",\s*([0-9]*\s*[A-Za-z]+)\s*$", 1)
    return F.when(unit != "", unit)


def kappa_band(kappa: Column) -> Column:
    """Landis-Koch band of a kappa value."""
    return (
        F.when(kappa < 0, "worse than chance").when(kappa < 0.2, "slight").when(kappa < 0.4, "fair")
        .when(kappa < 0.6, "moderate").when(kappa < 0.8, "substantial").when(kappa.isNotNull(), "almost perfect")
    )
