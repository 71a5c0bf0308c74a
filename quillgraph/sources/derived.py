"""Evidence-graph tables derived from the driver's relational tables.

Each function reads what it needs with its columns pruned, so filters of a query reach
the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a part, in the shape of the component table."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    eco = F.lower("p_type")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (k % 10).cast("string"), F.lit("0"))
    return p.select(
        k.alias("id"),
        F.col("p_name").alias("name"),
        version.alias("version"),
        eco.alias("ecosystem"),
        F.concat(F.lit("pkg:"), eco, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@"), version).alias("purl"),
        F.when(k % 7 == 0, "os-package").otherwise("library").alias("ctype"),
        (k % 5 + 1).cast("int").alias("tier_cap"),
        F.round(F.lit(0.5) + (k % 50) / 100.0, 4).alias("confidence"),
        F.when(k % 20 == 0, "fixture-only").alias("excluded"),
        F.create_map(
            F.lit("ecosystem"), eco,
            F.lit("scope"), F.element_at(F.array(F.lit("runtime"), F.lit("dev"), F.lit("test")), (k % 3 + 1).cast("int")),
            F.lit("observed"), F.when(k % 4 == 0, "true").when(k % 4 == 1, "false"),
            F.lit("introduced_by.layer"), F.concat(F.lit("layer-"), (k % 2).cast("string")),
            F.lit("size"), F.col("p_size").cast("string"),
        ).alias("attrs"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: which detector saw which component, how surely, where; one part of 25 is only in tests."""
    i = table(spark, sf_dir, "lineitem")
    folder = F.when(F.col("l_partkey") % 25 == 0, "tests").otherwise(F.element_at(F.array(*map(F.lit, ("tests", "vendor", "docs", "src", "examples"))), (F.col("l_suppkey") % 5 + 1).cast("int")))
    return i.select(
        F.col("l_orderkey").alias("finding_id"),
        F.col("l_linenumber").alias("ordinal"),
        F.col("l_partkey").alias("component_id"),
        F.col("l_suppkey").alias("detector"),
        (F.col("l_linenumber") % 5 + 1).cast("int").alias("tier"),
        F.round(F.col("l_discount") * 9 + 0.0, 4).alias("confidence"),
        F.concat(folder, F.lit("/"), F.col("l_orderkey").cast("string")).alias("path"),
        F.when(folder == "tests", F.array(F.lit("path-role-fixture"))).alias("modifiers"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An acyclic dependency graph over parts with part 0 above all: src depends on dst."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey").where(k > 0)
    near = p.select(F.floor(k / 3).alias("src"), k.alias("dst"), F.lit(None).cast("string").alias("marker"))
    far = p.where(k % 4 == 0).select(F.floor(k / 7).alias("src"), k.alias("dst"), F.when(k % 8 == 0, 'extra == "all"').alias("marker"))
    return near.unionByName(far)


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, component_id): which host holds which component."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("host"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("host"), F.col("l_partkey").alias("component_id")).distinct()


def snapshot(spark: SparkSession, sf_dir: str, before: bool, cut: str = "1995-06-17") -> DataFrame:
    """(family, version, scope, confidence) of the parts shipped before or after a day."""
    day = F.col("l_shipdate") < F.lit(cut).cast("timestamp")
    i = table(spark, sf_dir, "lineitem").where(day if before else ~day).groupBy("l_partkey").agg(F.max("l_linenumber").alias("n"), F.max("l_quantity").alias("q"))
    return i.select(
        F.concat(F.lit("lib-"), (F.col("l_partkey") % 1500).cast("string")).alias("family"),
        F.col("l_partkey").alias("id"),
        F.concat_ws(".", F.col("n").cast("string"), F.floor(F.col("q")).cast("string")).alias("version"),
        F.when(F.col("n") > 4, "dev").otherwise("runtime").alias("scope"),
        F.round(F.col("q") / 100 + 0.3, 4).alias("confidence"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, family, version): the last event type of each user and day; day 0 is the first."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(day.alias("ordinal"), F.col("user_id").alias("family")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("version"))
