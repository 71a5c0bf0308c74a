"""Entity resolution: claims that share an identity key are one component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import connected_components
from quillgraph.scratch import materialize


def identity_keys() -> Column:
    """digest keys, then the purl, else name and version; needs ecosystem, name, version, purl, hashes."""
    digests = F.transform(F.map_entries(F.coalesce("hashes", F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit("digest:"), F.lower(e.key), F.lit(":"), F.lower(e.value)))
    named = F.when(F.col("version").isNotNull(), F.concat_ws("\x1f", F.lit("name"), "ecosystem", "name", "version"))
    return F.array_distinct(F.array_compact(F.concat(digests, F.array(F.coalesce(F.concat(F.lit("purl:"), "purl"), named)))))


def family_key() -> Column:
    return F.lower(F.concat_ws(":", F.coalesce("ecosystem", F.lit("")), "name"))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Edges from each row to the least row of each key: a hot key gives a star, not all pairs."""
    least = keyed.groupBy("key").agg(F.min("id").alias("dst"))
    return keyed.join(least, "key").where("id <> dst").select(F.col("id").alias("src"), "dst").distinct()


def resolved(claims: DataFrame, keys: Column | None = None) -> DataFrame:
    """(id, root): the smallest id of the claims joined through shared keys; a claim without a partner is its own root."""
    keyed = claims.select("id", F.explode(keys if keys is not None else identity_keys()).alias("key"))
    parts = connected_components(shared_keys(keyed))
    return claims.select("id").join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("root"))


def attached_versionless(claims: DataFrame) -> DataFrame:
    """(id, root) after versionless claims join their family's only concrete root; several: status ambiguous-declared.

    ``claims`` has id, root, family, version.
    """
    roots = claims.where("version is not null").groupBy("family").agg(F.countDistinct("root").alias("n"), F.min("root").alias("only"))
    bare = claims.where("version is null").groupBy("family").agg(F.min("root").alias("bare"))
    joined = claims.join(roots, "family", "left").join(bare, "family", "left")
    lone = F.col("version").isNull()
    return joined.select("id", F.when(lone & (F.col("n") == 1), F.col("only")).when(lone, F.col("bare")).otherwise(F.col("root")).alias("root"), F.when(lone & (F.col("n") > 1), "ambiguous-declared").alias("status"))


def folded(claims: DataFrame) -> DataFrame:
    """One row a root: name and purl of the best claim (one with a version before one without), hashes of all (later ids win), last known licence."""
    best = F.max_by(F.struct("name", "version", "purl"), F.struct(F.col("version").isNotNull().alias("whole"), "tier", "version", "purl", "name"))
    per_key = claims.select("root", "id", F.explode("hashes").alias("k", "v")).groupBy("root", "k").agg(F.max_by("v", "id").alias("v"))
    hashes = per_key.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("hashes"))
    licences = F.max_by("license", F.when(F.col("license").isNotNull(), F.col("id")))
    found = claims.groupBy("root").agg(best.alias("b"), licences.alias("license"))
    return found.join(hashes, "root", "left").select("root", "b.name", "b.version", "b.purl", "hashes", "license")


def reconciled(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Components from claims: joined by identity, versionless ones attached, folded, scored by all their evidence.

    ``claims`` has id, ecosystem, name, version, purl, hashes, tier, license;
    ``evidence`` claim_id, tier, confidence. One row a component: root (its least claim),
    name, version, purl, hashes, license, n_claims, n_evidence, tier_cap, confidence and
    status (ambiguous-declared: versionless, and its family has several).
    """
    from quillgraph.operators.analytics import noisy_or

    roots = materialize(resolved(claims), "reconcile")
    keyed = claims.join(roots, "id").withColumn("family", family_key())
    attached = attached_versionless(keyed.select("id", "root", "family", "version"))
    placed = materialize(claims.join(attached, "id"), "reconcile-placed")
    whole = folded(placed).join(placed.groupBy("root").agg(F.count("*").alias("n_claims"), F.max("status").alias("status")), "root")
    scores = noisy_or(evidence.join(placed.select(F.col("id").alias("claim_id"), F.col("root").alias("component_id")), "claim_id"))
    return whole.join(scores.withColumnRenamed("component_id", "root"), "root", "left")
