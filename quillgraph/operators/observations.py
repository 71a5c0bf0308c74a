"""What was seen at run time, applied to a graph: raised trust, phantoms, and what nothing ever loaded."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.setops import normal_name
from quillgraph.scratch import materialize

#: The least confidence of what was seen, and scopes that no run needs.
OBSERVED, NOT_RUN = 0.98, ("build", "dev", "test")


class Observed(NamedTuple):
    components: DataFrame
    annotations: DataFrame


def applied(components: DataFrame, observations: DataFrame) -> Observed:
    """``components`` with observations (ecosystem, name, version) applied, and (id, code) annotations.

    ``components`` has id, ecosystem, name, version, tier_cap, confidence, scope,
    excluded, state; excluded and historical ones are left as they are and never match. A
    match is by ecosystem (none: pypi) and normal name: it gets the highest tier,
    confidence of OBSERVED at least and scope runtime-observed. What no component accounts
    for becomes one, once for each name and version, its ids after the others'. Components
    of traced ecosystems that nothing loaded are noted, unless their scope is for building
    or testing.
    """
    from quillgraph.sources.store import numbered

    seen = observations.select(F.coalesce("ecosystem", F.lit("pypi")).alias("ecosystem"), normal_name(F.col("name")).alias("key"), F.col("name").alias("as"), F.col("version").alias("detail"))
    seen = materialize(seen, "seen")
    keys = seen.select(F.col("ecosystem").alias("e"), F.col("key").alias("k")).distinct().withColumn("hit", F.lit(True))
    traced = observations.where("ecosystem is not null").select(F.col("ecosystem").alias("t")).distinct().withColumn("traced", F.lit(True))
    shown = F.col("excluded").isNull() & F.col("state").isNull()
    rows = components.withColumn("key", normal_name(F.col("name"))).withColumn("shown", shown)
    rows = rows.join(keys, F.col("shown") & (F.col("ecosystem") == F.col("e")) & (F.col("key") == F.col("k")), "left").join(traced, F.col("ecosystem") == F.col("t"), "left")
    rows = materialize(rows.drop("e", "k", "t"), "observed")
    hit = F.coalesce("hit", F.lit(False))
    known = rows.select("id", "ecosystem", "name", "version", F.when(hit, 5).otherwise(F.col("tier_cap")).alias("tier_cap"), F.when(hit, F.least(F.lit(1.0), F.greatest("confidence", F.lit(OBSERVED)))).otherwise(F.col("confidence")).alias("confidence"), F.when(hit, "runtime-observed").otherwise(F.col("scope")).alias("scope"), "excluded", "state")
    lost = seen.join(rows.where("shown").select("ecosystem", "key"), ["ecosystem", "key"], "left_anti").groupBy("ecosystem", "key", F.col("detail").alias("version")).agg(F.min("as").alias("name"))
    top = components.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]  # one number
    null = F.lit(None).cast("string")
    phantoms = numbered(lost, "ecosystem", "key", "version").select((F.col("id") + top).cast("long").alias("id"), "ecosystem", "name", "version", F.lit(5).alias("tier_cap"), F.lit(OBSERVED).alias("confidence"), F.lit("runtime-observed").alias("scope"), null.alias("excluded"), null.alias("state"))
    phantoms = materialize(phantoms, "phantoms")
    unused = F.col("shown") & ~hit & F.coalesce("traced", F.lit(False)) & ~F.coalesce(F.col("scope").isin(*NOT_RUN), F.lit(False))
    notes = rows.where(hit).select("id", F.lit("runtime-observed").alias("code")).unionByName(phantoms.select("id", F.lit("drift:observed-not-declared").alias("code"))).unionByName(rows.where(unused).select("id", F.lit("declared-never-observed").alias("code")))
    return Observed(known.unionByName(phantoms), notes)
