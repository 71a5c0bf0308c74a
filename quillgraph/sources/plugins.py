"""Findings from outside code: bounded and re-checked before they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a plugin may return, and the highest confidence of each technique.
MAX_FINDINGS, MAX_NAME, MAX_SNIPPET = 10_000, 512, 4096
RATES = {"manifest": 0.90, "lockfile": 0.95, "installed-db": 0.98, "binary": 0.70, "heuristic": 0.50}
#: How sure each technique is by itself (others: 0.5), and what context takes away.
BASE_RATES = {
    "manifest-parse": 0.85, "lockfile-parse": 0.92, "installed-state": 0.95, "os-package-db": 0.97, "binary-buildinfo": 0.99, "imported-sbom": 0.80, "file-fingerprint": 0.60, "jar-manifest": 0.65, "assembly-identity": 0.70, "license-file": 0.90,
    "native-resolution": 0.95, "binary-versioninfo": 0.90, "embedded-sbom": 0.80, "frozen-app": 0.70, "binary-unidentified": 0.50, "fn-fingerprint-constants": 0.60, "fn-fingerprint-symbols": 0.60, "fn-fingerprint-functions": 0.60, "fn-fingerprint-sourcetree": 0.60, "plugin-analysis": 0.75,
}
MODIFIERS = {"path-role-fixture": 0.3, "path-role-example": 0.3, "path-role-docs": 0.3, "stale-lockfile": 0.7, "orphan-installed-state": 0.8}


def rated(technique: Column, role: Column, extra: Column) -> tuple[Column, Column]:
    """Confidence of a piece of evidence and the reasons: the technique's rate times what the path's role and further modifiers take away.

    ``extra`` is an array; modifiers without a factor are reasons only. Vendored paths are
    flagged without a penalty.
    """
    look = lambda table: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    rate = F.coalesce(F.try_element_at(look(BASE_RATES), technique), F.lit(0.5))
    named = F.when(role.isin("fixture", "example", "docs"), F.array(F.concat(F.lit("path-role-"), role))).otherwise(F.array().cast("array<string>"))
    flag = F.when(role == "vendored", F.array(F.lit("vendored"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(named, flag, F.coalesce(extra, F.array().cast("array<string>")))
    factor = F.aggregate(F.transform(reasons, lambda m: F.coalesce(F.try_element_at(look(MODIFIERS), m), F.lit(1.0))), F.lit(1.0), lambda a, b: a * b)
    return F.round(F.least(rate * factor, F.lit(1.0)), 4), reasons


def ceiling(technique: Column) -> Column:
    out = F.lit(0.5)
    for name, rate in RATES.items():
        out = F.when(technique == name, rate).otherwise(out)
    return out


def checked(findings: DataFrame, namespace: str) -> DataFrame:
    """Findings with forced namespace and lowered confidence; those over a bound carry the reason in error.

    ``findings`` has path, detector, technique, name, version, confidence, snippet.
    """
    nth = F.row_number().over(Window.partitionBy("path").orderBy("name", "version", "detector"))
    error = F.when(F.col("name").isNull() | (F.col("name") == ""), "no name").when(F.length("name") > MAX_NAME, "name too long").when(F.col("nth") > MAX_FINDINGS, "too many findings").when(~F.col("confidence").between(0, 1), "confidence out of range")
    marked = findings.withColumn("nth", nth).withColumn("error", error).drop("nth")
    return marked.withColumn("detector", F.concat(F.lit(f"plugin:{namespace}/"), "detector")).withColumn("confidence", F.least("confidence", ceiling(F.col("technique")))).withColumn("snippet", F.substring("snippet", 1, MAX_SNIPPET))
