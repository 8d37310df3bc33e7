"""Join sides that are broadcast only once their size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension that a join may broadcast.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A broadcast hint where the table has at most ``rows`` rows, the table as it is where it has more (the join
    then shuffles, and AQE decides). Counting stops after ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
