"""Numbers by content of tables that are larger than the samples that ranges come from."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.inventory import runs_listed


@pytest.fixture
def many_ranges(spark):
    """Ranges as many as on large tables; small ones are joined into one otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_of_equal_times(many_ranges):
    runs = many_ranges.range(0, 100_000, 1, 8).select(F.col("id").alias("run_id"), F.lit("s").alias("subject"), F.timestamp_seconds(F.col("id") % 3).alias("created"))
    got = {r["run_id"]: r["place"] for r in runs_listed(runs, 7).collect()}
    want = sorted(range(100_000), key=lambda k: (k != 7, -(k % 3), -k))
    assert [got.get(k) for k in want] == list(range(1, 100_001))
