"""Further inventory formats: CycloneDX XML, SPDX tag-value, SPDX 3, attestations; and whole documents of any size.

A document is written as text lines in global order: the concatenated part files are one
valid JSON document, though no task ever holds more than its range of lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.grammars_locks import parsed_xml
from quillgraph.sources.store import numbered

_ROWS = "document string, kind string, ref string, ctype string, name string, version string, purl string, scope string, src string, dst string"
_FIELDS = [c.split()[0] for c in _ROWS.split(", ")]
Parsed = Iterator[dict]


def _parsed(spark: SparkSession, path: str, parse: Callable[[str], Parsed]) -> tuple[DataFrame, DataFrame]:
    """Components and edges of files that ``parse`` reads one at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for document, content in zip(frame["path"], frame["content"], strict=True):
                rows = [{"document": document, **r} for r in parse(bytes(content).decode("utf-8", "replace"))]
                yield pd.DataFrame(rows, columns=_FIELDS).astype(object).where(lambda x: x.notna(), None)

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _ROWS)
    components = rows.where("kind = 'component'").select("document", "ref", "ctype", "name", "version", "purl", "scope")
    return components, rows.where("kind = 'edge'").select("document", "src", "dst")


def _xml(text: str) -> Parsed:
    root = parsed_xml(text)
    for c in root.iter("component"):
        if (c.findtext("name") or "").strip():
            values = {k: (c.findtext(k) or "").strip() or None for k in ("name", "version", "purl", "scope")}
            yield {"kind": "component", "ref": c.get("bom-ref") or values["purl"], "ctype": c.get("type", "library"), **values}
    for d in root.iter("dependency"):
        yield from ({"kind": "edge", "src": d.get("ref"), "dst": x.get("ref")} for x in d if d.get("ref") and x.get("ref"))


#: Relations that are edges, and those whose ends are turned round.
FORWARD, TURNED = ("DEPENDS_ON", "CONTAINS"), ("DEPENDENCY_OF", "CONTAINED_BY")


def _tags(text: str) -> Parsed:
    package: dict | None = None
    for line in text.splitlines():
        tag, _, value = (x.strip() for x in line.partition(":"))
        words = value.split()
        if tag == "PackageName":
            if package:
                yield package
            package = {"kind": "component", "ctype": "library", "name": value}
        elif package and tag == "SPDXID":
            package.setdefault("ref", value)
        elif package and tag == "PackageVersion":
            package["version"] = value
        elif package and tag == "ExternalRef" and words[1:2] == ["purl"] and len(words) == 3:
            package["purl"] = words[2]
        elif tag == "Relationship" and len(words) == 3 and words[1] in FORWARD + TURNED:
            a, b = (words[0], words[2]) if words[1] in FORWARD else (words[2], words[0])
            yield {"kind": "edge", "src": a, "dst": b}
    if package:
        yield package


def read_cyclonedx_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Components, nested ones too, and edges (document, src, dst) of CycloneDX XML files."""
    return _parsed(spark, path, _xml)


def read_spdx_tags(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Components and edges of SPDX 2 tag-value files."""
    return _parsed(spark, path, _tags)


_SPDX3 = "`@graph` array<struct<type:string,spdxId:string,name:string,software_packageVersion:string,software_packageUrl:string,`from`:string,relationshipType:string,`to`:array<string>>>"


def read_spdx3(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Components and edges of SPDX 3 JSON-LD files."""
    nodes = spark.read.schema(_SPDX3).option("multiLine", True).json(path).select(F.input_file_name().alias("document"), F.explode("@graph").alias("n"))
    c = nodes.where("n.type = 'software_Package' and n.name is not null").select("document", F.col("n.spdxId").alias("ref"), F.lit("library").alias("ctype"), "n.name", F.col("n.software_packageVersion").alias("version"), F.col("n.software_packageUrl").alias("purl"), F.lit(None).cast("string").alias("scope"))
    links = nodes.where("n.type = 'Relationship' and n.relationshipType in ('dependsOn', 'contains')")
    return c, links.select("document", F.col("n.from").alias("src"), F.explode("n.to").alias("dst"))


#: Payload types of signed envelopes that hold statements.
PAYLOADS = ("application/vnd.in-toto+json", "application/vnd.dsse.envelope.v1+json")
_CLAIM = "struct<name:string,version:string,purl:string>"
_PACKAGE = "struct<name:string,versionInfo:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>"
_BODY = f"bomFormat:string,spdxVersion:string,components:array<{_CLAIM}>,packages:array<{_PACKAGE}>"
_ENVELOPE = f"struct<payloadType:string,payload:string,predicateType:string,predicate:struct<{_BODY}>,{_BODY}>"


def attested(envelopes: DataFrame) -> DataFrame:
    """(source, kind, name, version, purl): what attestations claim.

    ``envelopes`` has source, content: signed envelopes, bare statements or bare
    inventories. Those that are none of these, or can't be read, have no row.
    """
    outer = envelopes.select("source", F.from_json(F.col("content").cast("string"), _ENVELOPE).alias("o")).where("o is not null")
    inner = F.from_json(F.try_to_binary("o.payload", F.lit("base64")).cast("string"), _ENVELOPE)
    known = F.col("o.payloadType").isNull() | F.col("o.payloadType").isin(*PAYLOADS)
    statement = outer.where(known).select("source", F.when(F.col("o.payload").isNotNull(), inner).otherwise(F.col("o")).alias("s"))
    fields = ("bomFormat", "spdxVersion", "components", "packages")
    body = statement.select("source", *(F.coalesce(f"s.predicate.{f}", f"s.{f}").alias(f) for f in fields))
    purl = lambda p: F.try_element_at(F.filter(p.externalRefs, lambda r: r.referenceType == "purl"), F.lit(1)).referenceLocator
    packages = F.transform("packages", lambda p: F.struct(p["name"].alias("name"), p.versionInfo.alias("version"), purl(p).alias("purl")))
    kind = F.when(F.col("bomFormat") == "CycloneDX", "cyclonedx").when(F.col("spdxVersion").startswith("SPDX-"), "spdx")
    claims = F.when(kind == "cyclonedx", F.col("components")).otherwise(packages)
    return body.where(kind.isNotNull()).select("source", kind.alias("kind"), F.inline(claims))


def _joined(rows: DataFrame, line: Column, section: int, *order: str) -> DataFrame:
    """JSON elements in order; all but the first begin with a comma."""
    placed = numbered(rows.withColumn("_line", line), *order)
    return placed.select(F.lit(section).alias("section"), F.col("id").alias("place"), F.concat(F.when(F.col("id") > 1, ",").otherwise(""), "_line").alias("value"))


def _frame(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(2 * k, 0, t) for k, t in enumerate(texts)], "section int, place long, value string")


#: How a technique is called in an inventory; others: "other".
METHODS = {"manifest-parse": "manifest-analysis", "lockfile-parse": "manifest-analysis", "installed-state": "filename", "os-package-db": "filename", "file-fingerprint": "hash-comparison", "binary-buildinfo": "binary-analysis", "binary-versioninfo": "binary-analysis"}


def with_evidence(components: DataFrame, evidence: DataFrame) -> DataFrame:
    """``components`` (ref, …) with a column evidence as inventories write it: identity by each technique, and the places, each once.

    ``evidence`` has ref, technique, confidence, path. Of a technique its surest piece counts.
    """
    method = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in METHODS.items() for x in kv)), F.col("technique")), F.lit("other"))
    per = evidence.groupBy("ref", "technique").agg(F.max("confidence").alias("confidence"))
    methods = per.groupBy("ref").agg(F.max("confidence").alias("best"), F.sort_array(F.collect_list(F.struct(method.alias("technique"), "confidence", F.col("technique").alias("value")))).alias("methods"))
    places = evidence.where("path is not null").groupBy("ref").agg(F.transform(F.sort_array(F.collect_set("path")), lambda p: F.struct(p.alias("location"))).alias("occurrences"))
    identity = F.array(F.struct(F.lit("purl").alias("field"), F.col("best").alias("confidence"), "methods"))
    told = methods.join(places, "ref", "left").select(F.col("ref").alias("of"), F.struct(identity.alias("identity"), "occurrences").alias("evidence"))
    return components.join(told, F.col("ref") == F.col("of"), "left").drop("of")


def _cyclonedx(components: DataFrame, edges: DataFrame, serial: str) -> DataFrame:
    more = ["evidence"] if "evidence" in components.columns else []
    element = F.to_json(F.struct(F.col("ref").alias("bom-ref"), F.col("ctype").alias("type"), "name", "version", "purl", "scope", *more))
    depends = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dependsOn"))
    frame = _frame(components.sparkSession, f'{{"bomFormat":"CycloneDX","specVersion":"1.6","serialNumber":"{serial}","version":1,"components":[', '],"dependencies":[', "]}")
    return frame.unionByName(_joined(components, element, 1, "purl", "name", "version", "ref")).unionByName(_joined(depends, F.to_json(F.struct(F.col("src").alias("ref"), "dependsOn")), 3, "src"))


def _spdx(components: DataFrame, edges: DataFrame, serial: str) -> DataFrame:
    locator = F.when(F.col("purl").isNotNull(), F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))))
    element = F.to_json(F.struct(F.col("ref").alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"), locator.alias("externalRefs")))
    relation = F.to_json(F.struct(F.col("src").alias("spdxElementId"), F.lit("DEPENDS_ON").alias("relationshipType"), F.col("dst").alias("relatedSpdxElement")))
    head = f'{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"inventory","documentNamespace":"{serial}","creationInfo":{{"created":"1970-01-01T00:00:00Z","creators":["Tool: quillgraph"]}},"packages":['
    frame = _frame(components.sparkSession, head, '],"relationships":[', "]}")
    return frame.unionByName(_joined(components, element, 1, "purl", "name", "version", "ref")).unionByName(_joined(edges, relation, 3, "src", "dst"))


def _spdx3(components: DataFrame, edges: DataFrame, serial: str) -> DataFrame:
    element = F.to_json(F.struct(F.lit("software_Package").alias("type"), F.col("ref").alias("spdxId"), F.lit("_:info").alias("creationInfo"), "name", F.col("version").alias("software_packageVersion"), F.col("purl").alias("software_packageUrl")))
    relation = F.to_json(F.struct(F.lit("Relationship").alias("type"), F.concat(F.lit(f"{serial}/"), F.md5(F.concat_ws("\x1f", "src", "dst"))).alias("spdxId"), F.lit("_:info").alias("creationInfo"), F.col("src").alias("from"), F.lit("dependsOn").alias("relationshipType"), F.array("dst").alias("to")))
    head = '{"@context":"https://spdx.org/rdf/3.0.1/spdx-context.jsonld","@graph":[{"type":"CreationInfo","@id":"_:info","specVersion":"3.0.1","created":"1970-01-01T00:00:00Z"}'
    frame = _frame(components.sparkSession, head, "", "]}")
    comma = lambda rows: rows.withColumn("value", F.when(F.col("place") == 1, F.concat(F.lit(","), "value")).otherwise(F.col("value")))
    return frame.unionByName(comma(_joined(components, element, 1, "purl", "name", "version", "ref"))).unionByName(comma(_joined(edges, relation, 3, "src", "dst")))


WRITERS = {"cyclonedx": _cyclonedx, "spdx": _spdx, "spdx3": _spdx3}


def write_document(components: DataFrame, edges: DataFrame, path: str, kind: str, serial: str) -> None:
    """One document as ordered part files; ``components`` has ref, ctype, name, version, purl, scope, ``edges`` src, dst (refs)."""
    lines = WRITERS[kind](components, edges.select("src", "dst").distinct(), serial)
    lines.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("value").write.mode("overwrite").text(path)
