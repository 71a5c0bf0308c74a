"""Reading and writing of software inventories as JSON documents."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CDX = "bomFormat string, serialNumber string, components array<struct<`bom-ref`:string,type:string,name:string,version:string,purl:string,scope:string>>, dependencies array<struct<ref:string,dependsOn:array<string>>>"
_SPDX = "spdxVersion string, name string, packages array<struct<SPDXID:string,name:string,versionInfo:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>, relationships array<struct<spdxElementId:string,relationshipType:string,relatedSpdxElement:string>>"
COMPONENTS = ("document", "ref", "ctype", "name", "version", "purl", "scope")


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("document", F.input_file_name())


def read_cyclonedx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Components and edges (document, src, dst) of CycloneDX JSON files."""
    docs = _documents(spark, path, _CDX).where("bomFormat = 'CycloneDX'")
    c = docs.select("document", F.explode("components").alias("c")).select("document", F.coalesce("c.bom-ref", "c.purl").alias("ref"), F.col("c.type").alias("ctype"), "c.name", "c.version", "c.purl", "c.scope")
    e = docs.select("document", F.explode("dependencies").alias("d")).select("document", F.col("d.ref").alias("src"), F.explode("d.dependsOn").alias("dst"))
    return c, e


def read_spdx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Components and edges of SPDX 2 JSON files; reversed relations are turned round."""
    docs = _documents(spark, path, _SPDX).where("spdxVersion like 'SPDX-2%'")
    locator = F.filter("p.externalRefs", lambda r: r.referenceType == "purl")
    c = docs.select("document", F.explode("packages").alias("p")).select("document", F.col("p.SPDXID").alias("ref"), F.lit("library").alias("ctype"), "p.name", F.col("p.versionInfo").alias("version"), F.try_element_at(locator, F.lit(1)).referenceLocator.alias("purl"), F.lit(None).cast("string").alias("scope"))
    r = docs.select("document", F.explode("relationships").alias("r")).select("document", "r.*")
    turned = F.col("relationshipType").isin("DEPENDENCY_OF", "CONTAINED_BY")
    e = r.where(F.col("relationshipType").isin("DEPENDS_ON", "CONTAINS", "DEPENDENCY_OF", "CONTAINED_BY"))
    return c, e.select("document", F.when(turned, F.col("relatedSpdxElement")).otherwise(F.col("spdxElementId")).alias("src"), F.when(turned, F.col("spdxElementId")).otherwise(F.col("relatedSpdxElement")).alias("dst"))


def format_of(text: str) -> str | None:
    """cyclonedx, spdx or spdx3 by a document's own marks."""
    try:
        doc = json.loads(text)
    except ValueError:
        return "spdx-tag" if "SPDXVersion:" in text else "cyclonedx-xml" if "cyclonedx.org/schema/bom" in text else None
    if not isinstance(doc, dict):
        return None
    return "cyclonedx" if doc.get("bomFormat") == "CycloneDX" else "spdx" if str(doc.get("spdxVersion", "")).startswith("SPDX-2") else "spdx3" if "@graph" in doc else None


def write_cyclonedx(components: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON line a component with its dependencies, written by the executors; a document of any size."""
    deps = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dependsOn"))
    rows = components.join(deps, F.col("ref") == F.col("src"), "left").select(F.col("ref").alias("bom-ref"), F.col("ctype").alias("type"), "name", "version", "purl", F.coalesce("dependsOn", F.array().cast("array<string>")).alias("dependsOn"))
    rows.repartitionByRange("purl", "name").sortWithinPartitions("purl", "name", "version").write.mode("overwrite").json(path)


def content_serial(components: DataFrame) -> str:
    """A serial that depends on the components' content alone, whatever their order.

    Row digests are added up in Spark, so nothing of the table's size reaches the driver.
    """
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct("name", "version", "purl")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total, n = components.agg(F.sum(digest), F.count("*")).first()
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(f'{total}:{n}'.encode()).hexdigest())}"


def canonical_json(value: object) -> bytes:
    return (json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()


def violations(components: DataFrame) -> DataFrame:
    """(ref, rule): components without the elements that an inventory must have, and refs used twice."""
    rules = {"name": F.col("name").isNull() | (F.col("name") == ""), "version": F.col("version").isNull(), "identifier": F.col("purl").isNull()}
    named = F.array_compact(F.array(*(F.when(test, F.lit(f"missing-{rule}")) for rule, test in rules.items())))
    missing = components.select("ref", F.explode(named).alias("rule"))
    twice = components.groupBy("document", "ref").count().where("count > 1").select("ref", F.lit("duplicate-ref").alias("rule"))
    return missing.unionByName(twice)
