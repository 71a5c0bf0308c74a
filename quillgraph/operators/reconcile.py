"""The whole way from claims and evidence to a graph: identity, pins, annotations, edges, scopes, drift and what is emitted."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import purl as made_purl
from quillgraph.operators import analytics as A
from quillgraph.operators import resolution as R
from quillgraph.operators.attribution import resolved_refs
from quillgraph.operators.scopes import propagated_scopes
from quillgraph.scratch import materialize

#: Ecosystems that hold one version of a package in an environment.
ONE_VERSION = ("pypi", "deb", "apk", "alpm", "conda", "composer", "pub", "conan", "vcpkg")
#: Ecosystems that are package URL types.
PURL_TYPES = ("alpm", "android", "apk", "bicep", "cargo", "cocoapods", "composer", "conan", "conda", "cran", "deb", "gem", "generic", "github", "golang", "hackage", "helm", "hex", "ios", "maven", "npm", "nuget", "oci", "pub", "pypi", "rpm", "swift", "terraform", "vcpkg")
#: Labels of the evidence tiers.
TIERS = ("inferred", "declared", "locked", "installed", "observed")


def ecosystem_of() -> Column:
    """The ecosystem given, else the package URL's type, else the kind of component."""
    return F.coalesce("ecosystem", F.nullif(F.regexp_extract("purl", "^pkg:([^/]+)/", 1), F.lit("")), "ctype")


def package_of() -> tuple[Column, Column]:
    """Namespace and name as a package URL splits them: a Maven group before the colon, else what stands before the last slash."""
    group = (F.lower("ecosystem") == "maven") & F.col("name").contains(":")
    path = ~group & F.col("name").contains("/") & (F.coalesce("namespace", F.lit("")) == "")
    cut = lambda mark: F.regexp_extract("name", f"^(.*){mark}([^{mark}]*)$", 1)
    rest = lambda mark: F.regexp_extract("name", f"^(.*){mark}([^{mark}]*)$", 2)
    given = F.nullif(F.col("namespace"), F.lit(""))
    return F.when(group, F.coalesce(given, cut(":"))).when(path, cut("/")).otherwise(given), F.when(group, rest(":")).when(path, rest("/")).otherwise(F.col("name"))


def versionless_purl() -> Column:
    """A package URL without version for a claim of a known type; else null."""
    namespace, name = package_of()
    kind = F.lower("ecosystem")
    plain = F.when(namespace.isNull(), made_purl(kind, name, F.lit(None).cast("string"))).otherwise(made_purl(kind, name, F.lit(None).cast("string"), namespace))
    return F.when(kind.isin(*PURL_TYPES), plain)


def family_of() -> Column:
    """The same package in any version, from the package URL or the name."""
    part = F.regexp_extract(F.col("purl"), r"^pkg:([^/@?#]+)/(?:(.+)/)?([^/@?#]+)", 0)
    at = lambda k: F.regexp_extract("purl", r"^pkg:([^/@?#]+)/(?:([^@?#]+)/)?([^/@?#]+)", k)
    namespace, name = package_of()
    named = F.concat_ws(":", ecosystem_of(), F.coalesce(namespace, F.lit("")), name)
    return F.lower(F.when(part != "", F.concat_ws(":", at(1), at(2), F.url_decode(at(3)))).otherwise(named))


def variant_of() -> Column:
    """What else tells builds of one package apart: a triplet."""
    return F.coalesce(F.try_element_at("qualifiers", F.lit("triplet")), F.lit(""))


def claim_keys() -> Column:
    """Identity keys of a claim, and one for its family where an environment holds one version of it."""
    one = F.when(ecosystem_of().isin(*ONE_VERSION) & F.col("version").isNotNull(), F.concat_ws("\x1f", F.lit("one"), ecosystem_of(), family_of(), variant_of()))
    digests = F.transform(F.map_entries(F.coalesce("hashes", F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit("digest:"), e.key, F.lit(":"), F.lower(e.value)))
    named = F.when(F.col("version").isNotNull(), F.concat_ws("\x1f", F.lit("name"), "ctype", F.coalesce("ecosystem", "ctype"), F.coalesce("namespace", F.lit("")), F.lower("name"), "version"))
    return F.array_distinct(F.array_compact(F.concat(digests, F.array(F.coalesce(F.concat(F.lit("purl:"), "purl"), named), one))))


class Graph(NamedTuple):
    """What reconciliation makes: the component of each claim, components, their annotations, edges, and reasons to leave out."""

    links: DataFrame
    components: DataFrame
    annotations: DataFrame
    edges: DataFrame


def pins(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, version, pin_tier), and the annotations of versions that lost: (root, code, detail).

    ``members`` has root, id, tier, version, purl, name, ecosystem. The version of the
    claim that is first by tier, version, purl and name is pinned. Another of the same tier
    is a conflict where one version may be there, a lower one is superseded; locked against
    installed is drift.
    """
    order = Window.partitionBy("root").orderBy(F.desc("tier"), F.desc(F.coalesce("version", F.lit(""))), F.desc(F.coalesce("purl", F.lit(""))), F.desc("name"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = members.withColumn("pin", F.first_value("version", ignoreNulls=True).over(whole)).withColumn("pin_tier", F.first_value(F.when(F.col("version").isNotNull(), F.col("tier")), ignoreNulls=True).over(whole))
    found = marked.groupBy("root").agg(F.first("pin").alias("version"), F.first("pin_tier").alias("pin_tier"))
    lost = marked.where(F.col("version") != F.col("pin"))
    label = lambda c: F.element_at(F.array(*map(F.lit, TIERS)), F.col(c))
    both = F.least("tier", "pin_tier") == 3
    superseded = lost.where(F.col("tier") != F.col("pin_tier")).select("root", F.when(both & (F.greatest("tier", "pin_tier") == 4), "drift:locked-vs-installed").otherwise("superseded-version").alias("code"), F.format_string("%s said %s; pinned %s (%s wins)", label("tier"), F.col("version"), F.col("pin"), label("pin_tier")).alias("detail"))
    same = lost.where((F.col("tier") == F.col("pin_tier")) & F.col("ecosystem").isin(*ONE_VERSION)).groupBy("root", "pin").agg(F.array_join(F.sort_array(F.collect_set("version")), ", ").alias("others"))
    conflicts = same.select("root", F.lit("version-conflict").alias("code"), F.format_string("same-tier sources disagree: %s vs %s", F.col("pin"), F.col("others")).alias("detail"))
    return found, superseded.distinct().unionByName(conflicts)


def reconciled_graph(claims: DataFrame, evidence: DataFrame, claimed_edges: DataFrame, projects: DataFrame, *, min_confidence: float = 0.8, paranoid: bool = False, scopes: tuple[str, ...] = ()) -> Graph:
    """Components, annotations and edges of a scan.

    ``claims`` has id, ctype, ecosystem, namespace, name, version, purl, hashes,
    qualifiers, attrs (maps), license, requested; ``evidence`` claim_id, tier, confidence,
    modifiers; ``claimed_edges`` ordinal, kind, src, dst (references), scope, requested,
    direct, marker, attrs; ``projects`` id, path, its ids apart from the claims'. A claim without evidence makes
    no component. Of a map's keys those of claims with a licence win, then of later ids.
    """
    tiers = evidence.groupBy("claim_id").agg(F.max("tier").alias("tier"))
    rows = materialize(claims.join(tiers, F.col("id") == F.col("claim_id")).drop("claim_id").withColumn("ecosystem_of", ecosystem_of()).withColumn("family", family_of()).withColumn("plain_purl", versionless_purl()), "claims")
    roots = R.resolved(rows, claim_keys())
    attached = R.attached_versionless(rows.join(roots, "id").select("id", "root", F.concat_ws("::", "ecosystem_of", "family").alias("family"), "version"))
    members = materialize(rows.join(attached, "id"), "members")
    pinned, lost = pins(members.select("root", "id", "tier", "version", "purl", "name", F.col("ecosystem_of").alias("ecosystem")))

    rank = F.struct(-F.col("tier"), "id")
    base = F.min_by(F.struct("ctype", "name", F.col("ecosystem_of").alias("ecosystem"), "family"), F.struct(F.col("purl").isNull(), F.col("version").isNull(), rank))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank))
    merged = members.join(pinned.withColumnRenamed("version", "pin"), "root").groupBy("root", "pin").agg(
        base.alias("base"), F.min_by("purl", F.when(F.col("purl").isNotNull(), F.struct(F.col("version").isNull() | (F.col("version") != F.col("pin")), rank))).alias("purl"), first("plain_purl").alias("plain"), first("license").alias("license"), first("requested").alias("requested"), F.count("*").alias("n_claims"), F.max("status").alias("status"))
    maps = []
    for name in ("hashes", "qualifiers", "attrs"):
        each = members.select("root", "id", F.col("license").isNotNull().alias("licensed"), F.explode(name).alias("k", "v")).groupBy("root", "k").agg(F.max_by("v", F.struct("licensed", "id")).alias("v"))
        maps.append(each.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name)))
    for m in maps:
        merged = merged.join(m, "root", "left")
    own = evidence.join(members.select(F.col("id").alias("claim_id"), "root"), "claim_id").select(F.col("root").alias("component_id"), "tier", "confidence", "modifiers")
    own = materialize(own, "evidence")
    scores = A.noisy_or(own).withColumnRenamed("component_id", "root")
    nodes = materialize(merged.join(scores, "root").select(F.col("root").alias("id"), "base.*", F.col("pin").alias("version"), F.coalesce("purl", "plain").alias("purl"), "hashes", "qualifiers", "attrs", "license", F.when(F.col("pin").isNull(), F.col("requested")).alias("requested"), "n_claims", "n_evidence", "tier_cap", "confidence", "status"), "nodes")

    refs = claimed_edges.select(F.col("src").alias("ref")).union(claimed_edges.select("dst")).distinct()
    names = resolved_refs(refs, nodes.select("id", "purl", "ecosystem", "name", "version", F.col("tier_cap").alias("tier"), "ctype"), projects).where("target is not null")
    end = lambda c: names.select(F.col("ref").alias(c), F.col("target").alias(f"{c}_id"))
    placed = claimed_edges.join(end("src"), "src").join(end("dst"), "dst").drop("src", "dst").withColumnsRenamed({"src_id": "src", "dst_id": "dst"})
    edges = materialize(A.merged_edges(placed), "edges")

    scoped = propagated_scopes(nodes.select("id", "ctype", (F.coalesce(F.try_element_at("attrs", F.lit("dev")), F.lit("")) == "true").alias("dev")), edges.where("kind = 'DEPENDS_ON'"), projects)
    known = materialize(nodes.join(scoped, "id"), "scoped")
    optional = F.coalesce(F.try_element_at("attrs", F.lit("optional")), F.lit("")) == "true"
    drifted = materialize(A.drift(known.select("id", F.concat_ws("::", "ecosystem", "family").alias("family"), "ecosystem", "ctype", "scope", "conditional", optional.alias("optional"), "confidence"), own), "drift")
    weaker = drifted.where("code = 'drift:installed-not-declared'").select(F.col("component_id").alias("id"), F.col("confidence").alias("lower"))
    known = known.join(weaker, "id", "left").withColumn("confidence", F.coalesce("lower", "confidence")).drop("lower")
    told = known.withColumn("attrs", F.create_map(F.lit("scope"), F.col("scope")))
    out = A.emit_set(told, A.fixture_only(own), min_confidence, paranoid, scopes).withColumnRenamed("reason", "excluded")
    named = nodes.where("status is not null").select(F.col("id").alias("component_id"), F.col("status").alias("code"), F.format_string("declared %s matches multiple concrete versions", "name").alias("detail"))
    annotations = lost.withColumnRenamed("root", "component_id").unionByName(named).unionByName(drifted.select("component_id", "code", F.col("family").alias("detail")))
    return Graph(members.select("id", "root"), materialize(known.join(out, "id"), "graph"), annotations, edges)
