"""Lookups, counters, clusters, scores, drift rules and fleet views over component tables."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The highest confidence that each evidence tier allows.
CAPS = {1: 0.85, 2: 0.90, 3: 0.95, 4: 0.98, 5: 1.00}


def display_ref() -> Column:
    return F.coalesce("purl", F.concat("name", F.coalesce(F.concat(F.lit("@"), "version"), F.lit(""))))


def kept(components: DataFrame) -> DataFrame:
    return components.where(F.col("excluded").isNull())


def find_component(components: DataFrame, ref: str) -> DataFrame:
    """The first that finds anything: equal purl, purl prefix (another version), digest, name[@version]."""
    at = ref.rfind("@")
    name, version = (ref[:at], ref[at + 1 :]) if at > 0 else (ref, None)
    by_name = F.lower("name") == name.lower()
    ways = [F.col("purl") == ref, F.col("purl").startswith(ref + "@"), by_name & (F.col("version") == version) if version else by_name]
    if "hashes" in components.columns and len(ref) in range(32, 129) and all(c in "0123456789abcdefABCDEF" for c in ref):
        ways.insert(2, F.exists(F.map_values("hashes"), lambda h: F.lower(h).contains(ref.lower())))
    rank = F.lit(None).cast("int")
    for k, way in reversed(list(enumerate(ways))):
        rank = F.when(way, k).otherwise(rank)
    hits = components.withColumn("rank", rank).where("rank is not null")
    best = hits.agg(F.min("rank").alias("best"))
    return hits.join(F.broadcast(best), F.col("rank") == F.col("best")).drop("rank", "best")  # one row


def near_matches(components: DataFrame, ref: str, limit: int = 5) -> DataFrame:
    """At most ``limit`` references whose name holds ``ref``, letter case ignored."""
    return components.where(F.lower("name").contains(ref.lower())).select(display_ref().alias("ref")).distinct().orderBy("ref").limit(limit)


def counters(components: DataFrame, by: Column) -> DataFrame:
    """Emitted, sure (0.9 or more) and excluded components by a key."""
    out = F.col("excluded").isNotNull()
    return components.groupBy(by.alias("key")).agg(F.count_if(~out).alias("emitted"), F.count_if(~out & (F.col("confidence") >= 0.9)).alias("sure"), F.count_if(out).alias("excluded"))


def cluster_key(by: str) -> Column:
    keys = {
        "ecosystem": F.coalesce(F.nullif(F.col("attrs")["ecosystem"], F.lit("")), F.regexp_extract("purl", "^pkg:([^/]+)/", 1), F.lit("other")),
        "layer": F.coalesce(F.col("attrs")["introduced_by.layer"], F.lit("unlayered")),
        "tier": F.col("tier_cap").cast("string"),
    }
    return keys[by]


def lod_overview(components: DataFrame, by: str = "ecosystem") -> DataFrame:
    return kept(components).groupBy(cluster_key(by).alias("cluster")).agg(F.count("*").alias("members"), F.round(F.max("confidence"), 4).alias("best")).orderBy(F.desc("members"), "cluster")


def lod_edges(components: DataFrame, edges: DataFrame, by: str = "ecosystem") -> DataFrame:
    """Distinct links between different clusters."""
    keyed = kept(components).select("id", cluster_key(by).alias("cluster"))
    a, b = keyed.select(F.col("id").alias("src"), F.col("cluster").alias("from_cluster")), keyed.select(F.col("id").alias("dst"), F.col("cluster").alias("to_cluster"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("from_cluster <> to_cluster").select("from_cluster", "to_cluster").distinct()


def lod_expand(components: DataFrame, cluster: str, by: str = "ecosystem", budget: int = 2000) -> DataFrame:
    """A cluster's members by falling confidence; one more than the budget tells that some are left out."""
    return kept(components).where(cluster_key(by) == cluster).select("id", "name", "version", "confidence").orderBy(F.desc("confidence"), "name", "id").limit(budget + 1)


def induced_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    ids = members.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def child_counts(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("kids"))


def deps_roots(components: DataFrame, edges: DataFrame, budget: int = 500) -> DataFrame:
    """Components that nothing depends on, with their number of dependencies."""
    top = kept(components).join(edges, F.col("id") == F.col("dst"), "left_anti")
    return _with_kids(top, edges).limit(budget + 1)


def deps_level(components: DataFrame, edges: DataFrame, node: int, down: bool = True, budget: int = 500) -> DataFrame:
    here, there = ("src", "dst") if down else ("dst", "src")
    ids = edges.where(F.col(here) == node).select(F.col(there).alias("id")).distinct()
    return _with_kids(kept(components).join(ids, "id"), edges).limit(budget + 1)


def _with_kids(found: DataFrame, edges: DataFrame) -> DataFrame:
    return found.join(child_counts(edges), F.col("id") == F.col("src"), "left").select("id", "name", "version", F.coalesce("kids", F.lit(0)).alias("kids")).orderBy("name", "version", "id")


def cap_of(tier: Column) -> Column:
    out = F.lit(1.0)
    for k, cap in CAPS.items():
        out = F.when(tier == k, cap).otherwise(out)
    return out


def noisy_or(evidence: DataFrame) -> DataFrame:
    """(component_id, n_evidence, tier_cap, confidence): 1 - prod(1 - c), at most the highest tier's cap."""
    doubt = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    found = evidence.groupBy("component_id").agg(F.count("*").alias("n_evidence"), F.max("tier").alias("tier_cap"), F.product(doubt).alias("doubt"))
    return found.select("component_id", "n_evidence", "tier_cap", F.round(F.least(1 - F.col("doubt"), cap_of(F.col("tier_cap"))), 4).alias("confidence"))


def evidence_detail(components: DataFrame, evidence: DataFrame, ref: int) -> DataFrame:
    """A component's evidence, highest tier first."""
    own = evidence.where(F.col("component_id") == ref)
    return own.join(components.where(F.col("id") == ref).select("id", "name"), F.col("component_id") == F.col("id")).select("name", "finding_id", "ordinal", "detector", "tier", "confidence", "path")


def fixture_only(evidence: DataFrame) -> DataFrame:
    """(component_id, n): components whose every piece of evidence has the modifier path-role-fixture; ``evidence`` has component_id, modifiers (an array)."""
    marked = F.coalesce(F.array_contains("modifiers", "path-role-fixture"), F.lit(False))
    return evidence.groupBy("component_id").agg(F.bool_and(marked).alias("whole"), F.count("*").alias("n")).where("whole").select("component_id", "n")


def pinned(claims: DataFrame) -> DataFrame:
    """Each family's claims as pinned, conflicting (same tier) or superseded (lower tier), by tier, version, id.

    ``claims`` has family, id, tier, version (null: none).
    """
    order = Window.partitionBy("family").orderBy(F.desc("tier"), F.desc_nulls_last("version"), F.desc("id"))
    first = F.first_value("version", ignoreNulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = F.first_value(F.when(F.col("version").isNotNull(), F.col("tier")), ignoreNulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    state = F.when(F.col("version").isNull(), "versionless").when(F.col("version") == F.col("pin"), "pinned").when(F.col("tier") == F.col("pin_tier"), "version-conflict").otherwise("superseded-version")
    return claims.withColumn("pin", first).withColumn("pin_tier", top).select("family", "id", "tier", "version", "pin", state.alias("state"))


#: Ecosystems whose installed packages no manifest declares, and what is left of an orphan's confidence.
UNDECLARED = ("deb", "apk", "alpm")
ORPHAN = 0.8


def drift(components: DataFrame, evidence: DataFrame) -> DataFrame:
    """(component_id, family, code, confidence) of families that are declared but not installed, or the reverse.

    ``components`` has id, family, ecosystem, ctype, scope, conditional, optional and
    confidence; ``evidence`` component_id, tier. A family counts as a whole. Declared or
    locked but nowhere installed or observed is drift only where its ecosystem has
    installed evidence at all, and not if all of it is for building, optional or
    conditional. Installed or observed but never declared is drift where the ecosystem has
    declared evidence; its confidence falls.
    """
    tier = lambda *k: F.bool_or(F.col("tier").isin(*k))
    yes = lambda c: F.coalesce(c, F.lit(False))
    per = evidence.groupBy("component_id").agg(tier(2, 3).alias("declared"), tier(4, 5).alias("installed"), tier(4).alias("there"))
    aside = yes(F.col("ctype") == "build-tool") | yes(F.col("scope").isin("build", "optional")) | yes(F.col("conditional")) | yes(F.col("optional"))
    rows = components.join(per, F.col("id") == F.col("component_id"), "left").select("id", "family", "ecosystem", "confidence", aside.alias("aside"), *(yes(F.col(c)).alias(c) for c in ("declared", "installed", "there")))
    families = rows.groupBy("family", "ecosystem").agg(*(F.bool_or(c).alias(c) for c in ("declared", "installed", "there")), F.bool_and("aside").alias("aside"))
    seen = families.groupBy(F.col("ecosystem").alias("of")).agg(F.bool_or("there").alias("has_installed"), F.bool_or("declared").alias("has_declared"))
    missing = F.col("declared") & ~F.col("installed") & ~F.col("aside") & F.col("has_installed")
    orphan = F.col("installed") & ~F.col("declared") & F.col("has_declared") & ~F.col("ecosystem").isin(*UNDECLARED)
    code = F.when(missing, "drift:declared-not-installed").when(orphan, "drift:installed-not-declared")
    coded = families.join(seen, F.col("ecosystem").eqNullSafe(F.col("of"))).select(F.col("family").alias("f"), F.col("ecosystem").alias("e"), code.alias("code")).where("code is not null")
    found = rows.join(coded, (F.col("family") == F.col("f")) & F.col("ecosystem").eqNullSafe(F.col("e")))
    return found.select(F.col("id").alias("component_id"), "family", "code", F.when(F.col("code").endswith("installed-not-declared"), F.round(F.col("confidence") * ORPHAN, 4)).otherwise(F.col("confidence")).alias("confidence"))


def drift_board(annotations: DataFrame, components: DataFrame) -> DataFrame:
    """Codes by size with the least reference of each."""
    named = annotations.join(components.select(F.col("id").alias("component_id"), display_ref().alias("ref")), "component_id", "left")
    return named.groupBy("code").agg(F.count("*").alias("size"), F.min("ref").alias("first_ref")).orderBy(F.desc("size"), "code")


def emit_set(components: DataFrame, fixtures: DataFrame, min_confidence: float = 0.8, paranoid: bool = False, scopes: tuple[str, ...] = ("runtime",)) -> DataFrame:
    """(id, reason): why a component is left out, in order of the rules; null: emitted.

    ``paranoid`` leaves out all below the locked tier first. A component without a scope
    passes the filter of scopes; no scopes: all pass.
    """
    flagged = components.join(fixtures.select(F.col("component_id").alias("id"), F.lit(True).alias("fixture")), "id", "left")
    rules = [
        ("below-locked", F.lit(paranoid) & (F.col("tier_cap") < 3)),
        ("fixture-only", F.coalesce("fixture", F.lit(False))),
        ("low-confidence", (F.col("tier_cap") == 1) & (F.col("confidence") < min_confidence)),
        ("scope", ~F.col("attrs")["scope"].isin(*scopes) if scopes else F.lit(False)),
    ]
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(holds, name).otherwise(reason)
    return flagged.select("id", reason.alias("reason"))


def policy_failed(annotations: DataFrame, emitted: DataFrame, fail_on: tuple[str, ...]) -> DataFrame:
    """(rule, failed) for each rule: a code prefix, or low-confidence for any component left out for it."""
    spark = annotations.sparkSession
    rules = spark.createDataFrame([(r,) for r in fail_on], "rule string")
    codes = annotations.select("code").distinct().unionByName(emitted.where("reason = 'low-confidence'").select(F.lit("low-confidence").alias("code")).distinct())
    return rules.join(codes, F.col("code").startswith(F.col("rule")), "left").groupBy("rule").agg(F.bool_or(F.col("code").isNotNull()).alias("failed"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge a (kind, src, dst), none from a node to itself: by ordinal the first scope and range asked for, any direct, the last marker, attributes together (later ones win).

    ``edges`` has kind, src, dst, ordinal, scope, requested, direct, marker, attrs (a map).
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal")))
    real = edges.where("src <> dst")
    found = real.groupBy("kind", "src", "dst").agg(first("scope").alias("scope"), first("requested").alias("requested"), F.bool_or("direct").alias("direct"), last("marker").alias("marker"))
    each = real.select("kind", "src", "dst", "ordinal", F.explode("attrs").alias("key", "value")).groupBy("kind", "src", "dst", "key").agg(F.max_by("value", "ordinal").alias("value"))
    attrs = each.groupBy("kind", "src", "dst").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    return found.join(attrs, ["kind", "src", "dst"], "left")


def instance_paths(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("component_id").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("instance_paths"))


def fleet_merge(rows: DataFrame) -> DataFrame:
    """One row an identity over all hosts: the best claim (tier, confidence; ties: the least host), where it was seen, and on how many hosts.

    ``rows`` has host, identity, name, version, tier, confidence, observed, ports and
    excluded; rows with excluded don't count. seen_in has an entry a host and claim, in
    order. One aggregate: an identity's entries are as many as its hosts.
    """
    entry = F.struct("host", "version", "observed", "ports")
    found = rows.where("excluded is null").groupBy("identity").agg(F.min_by(F.struct("name", "version", "tier", "confidence"), F.struct(-F.col("tier"), -F.col("confidence"), "host", "version")).alias("best"), F.sort_array(F.collect_list(entry)).alias("seen_in"), F.bool_or("observed").alias("observed"))
    return found.select("identity", "best.name", "best.version", "best.tier", "best.confidence", F.size(F.array_distinct(F.transform("seen_in", lambda x: x.host))).alias("hosts"), "observed", "seen_in")


def fleet_rollup(merged: DataFrame) -> DataFrame:
    """(host, components, observed) from ``fleet_merge``'s provenance."""
    return merged.select(F.explode("seen_in").alias("x")).groupBy("x.host").agg(F.count("*").alias("components"), F.count_if("x.observed").alias("observed"))


def version_skew(merged: DataFrame, limit: int = 100) -> DataFrame:
    """(name, host, versions) of the first ``limit`` names with more than one version; ``merged`` may have ecosystem, whose crypto rows don't count."""
    packages = merged.where("ecosystem is null or ecosystem <> 'crypto'") if "ecosystem" in merged.columns else merged
    held = packages.select("name", F.explode("seen_in").alias("x")).where("x.version is not null").select("name", "x.host", "x.version").distinct()
    spread = held.groupBy("name").agg(F.min("version").alias("low"), F.max("version").alias("high")).where("low <> high").orderBy("name").limit(limit)
    return held.join(spread.select("name"), "name").groupBy("name", "host").agg(F.array_join(F.sort_array(F.collect_list("version")), ",").alias("versions"))


def emission_order(components: DataFrame) -> DataFrame:
    """Emitted components, ranked by purl, lower-cased name and version; ranked by ranges, not in one task."""
    from quillgraph.sources.store import numbered

    key = kept(components).select("id", F.coalesce("purl", F.lit("")).alias("p"), F.lower("name").alias("n"), F.coalesce("version", F.lit("")).alias("v")).withColumnRenamed("id", "component_id")
    return numbered(key, "p", "n", "v", "component_id").select(F.col("component_id").alias("id"), F.col("id").alias("place"))


def cursor_of(last: tuple[str, str, int] | None) -> str | None:
    """A page's end as opaque text; None: there is no further page."""
    return None if last is None else base64.urlsafe_b64encode(json.dumps(list(last)).encode()).decode()


def after_cursor(cursor: str | None) -> tuple[str, str, int] | None:
    """What ``cursor_of`` told; None where the text tells nothing, as for the first page."""
    try:
        name, version, key = json.loads(base64.urlsafe_b64decode((cursor or "").encode()).decode())
    except (ValueError, TypeError):
        return None
    return name, version, key


def page(rows: DataFrame, cursor: str | None = None, limit: int = 200) -> DataFrame:
    """The rows after a cursor by name, version (null first), id; the limit is held to 1..1000. A filter and a bounded sort, however far the page is."""
    after = after_cursor(cursor)
    version = F.coalesce("version", F.lit(""))
    if after is not None:
        rows = rows.where(F.struct(F.col("name").alias("a"), version.alias("b"), F.col("id").cast("long").alias("c")) > F.struct(F.lit(after[0]).alias("a"), F.lit(after[1]).alias("b"), F.lit(after[2]).cast("long").alias("c")))
    return rows.orderBy("name", version, "id").limit(min(max(limit, 1), 1000))


def capabilities(components: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(fact, count): which kinds of facts a graph holds."""
    c = components.agg(F.count("*").alias("components"), F.count("version").alias("versions"), F.count("purl").alias("purls"), F.count(F.col("attrs")["scope"]).alias("scopes"))
    e = edges.agg(F.count("*").alias("edges"), F.count("marker").alias("markers"))
    v = evidence.agg(F.count("*").alias("evidence"))
    long = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(x).alias("fact"), F.col(x).alias("count")) for x in df.columns))))
    return long(c).unionByName(long(e)).unionByName(long(v))


def losses(facts: DataFrame, keeps: tuple[str, ...]) -> DataFrame:
    """Facts present that a format keeping only ``keeps`` loses."""
    return facts.where(F.col("count") > 0).where(~F.col("fact").isin(*keeps)).select("fact", "count")
