"""One-row results as scalar subqueries, so that they need no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_struct(one_row: DataFrame) -> Column:
    """The only row of ``one_row`` as a struct column, evaluated once as a subquery."""
    return one_row.select(F.struct(*one_row.columns)).scalar()
