"""From files to a graph: findings, relations, roles of paths, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import path_role
from quillgraph.operators.reconcile import Graph, reconciled_graph
from quillgraph.scratch import materialize
from quillgraph.sources import lockfiles, manifests
from quillgraph.sources.plugins import rated
from quillgraph.sources.relations import claimed_edges, projects_of, relations

#: The technique that a finding of each tier rests on.
TECHNIQUES = {2: "manifest-parse", 3: "lockfile-parse", 4: "installed-state"}
#: Ecosystems of an operating system's packages.
OS = ("deb", "apk", "alpm", "rpm")


def claims_of(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and their evidence, one of each a finding; a declared version that isn't plain is a range asked for."""
    found = findings.where("name is not null")
    exact = F.col("version").rlike(r"^v?\d+(\.\d+)*([-+.~][0-9A-Za-z.\-+~:]*)?$") | (F.col("tier") > 2)
    none = F.create_map().cast("map<string,string>")
    os_package = F.col("ptype").isin(*OS)
    whole = F.when(exact, F.col("version"))
    key = F.abs(F.xxhash64("path", "detector", "name", "version"))
    technique = F.coalesce(*(F.when((F.col("tier") == k) & ~(os_package & F.lit(k == 4)), name) for k, name in TECHNIQUES.items()), F.when(os_package, "os-package-db"), F.lit("other"))
    rows = found.select(key.alias("id"), F.when(os_package, "os-package").otherwise("library").alias("ctype"), F.col("ptype").alias("ecosystem"), "name", whole.alias("version"), F.when(whole.isNull(), F.col("version")).alias("requested"), "tier", technique.alias("technique"), "path").dropDuplicates(["id"])
    null = F.lit(None).cast("string")
    claims = rows.select("id", "ctype", "ecosystem", null.alias("namespace"), "name", "version", null.alias("purl"), none.alias("hashes"), none.alias("qualifiers"), none.alias("attrs"), null.alias("license"), "requested")
    confidence, reasons = rated(F.col("technique"), path_role(F.col("path")), F.array().cast("array<string>"))
    return claims, rows.select(F.col("id").alias("claim_id"), "tier", confidence.alias("confidence"), reasons.alias("modifiers"))


def scanned(files: DataFrame, **rules) -> Graph:
    """The graph of files (path, content); ``rules`` as ``reconciled_graph`` takes them. A file that can't be read is left out; ``detect`` and ``relations`` tell why."""
    findings = materialize(manifests.detect(files).unionByName(lockfiles.detect(files)), "findings")
    found = materialize(relations(files), "relations")
    claims, evidence = claims_of(findings)
    return reconciled_graph(claims, evidence, claimed_edges(found), projects_of(found), **rules)
