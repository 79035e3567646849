"""All registered queries of the core and their SQL."""

from __future__ import annotations

from kisaran.plans import problems, reads, series
from kisaran.plans.series import flagship

QUERIES = {**series.QUERIES, **problems.QUERIES}
SQL = {**series.SQL, **problems.SQL}

__all__ = ["QUERIES", "SQL", "flagship", "reads"]
