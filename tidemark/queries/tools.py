"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column but those in ``keep``, as the SQL twins do."""
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double" and f.name not in keep]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df
