"""A bounded, reproducible sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: str | None, per_class: int, *inputs: str) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, inputs) of at most ``per_class`` documents of each class, and how many labels each class has.

    Rows whose label is null or whose doc_id occurs with two labels don't count. The
    sample is the least hashes of doc_id, so it is the same on every run.
    """
    rule = F.coalesce(F.expr(train), F.lit(False)) if train else F.lit(True)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(rule)
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    picked = [marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *inputs)
    return known.join(F.broadcast(ids), "doc_id"), sizes  # at most 2 * per_class ids
