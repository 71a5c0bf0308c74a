"""Column names that a caller's table doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if the table has such a column (letter case ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id, null included, is in the first column of ``ids``."""
    name = unused(docs, "kept_id")
    return docs.join(ids.select(F.col(ids.columns[0]).alias(name)).distinct(), docs.doc_id.cast("long").eqNullSafe(F.col(name)), "left_semi")
