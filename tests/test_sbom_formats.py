"""Inventory formats on small documents, and documents written and read back."""

import base64
import json
import pathlib

import pytest

from quillgraph.functions.licenses import license_expression, normal_expression
from quillgraph.sources import sbom
from quillgraph.sources import sbom_formats as B


def of(frames):
    return tuple(sorted(tuple(r[1:]) for r in f.collect()) for f in frames)


def test_xml(spark, tmp_path):
    (tmp_path / "b.xml").write_text('<bom xmlns="http://cyclonedx.org/schema/bom/1.5"><components><component type="library" bom-ref="r"><name>a</name><version>1</version><purl>pkg:x/a@1</purl><components><component bom-ref="q"><name>b</name></component></components></component></components><dependencies><dependency ref="r"><dependency ref="q"/></dependency></dependencies></bom>')
    c, e = B.read_cyclonedx_xml(spark, str(tmp_path))
    assert sorted((r.ref, r.ctype, r.name, r.version, r.purl) for r in c.collect()) == [("q", "library", "b", None, None), ("r", "library", "a", "1", "pkg:x/a@1")]
    assert [tuple(r[1:]) for r in e.collect()] == [("r", "q")]


def test_tags(spark, tmp_path):
    (tmp_path / "b.spdx").write_text("SPDXVersion: SPDX-2.3\nSPDXID: SPDXRef-DOCUMENT\n\nPackageName: a\nSPDXID: A\nPackageVersion: 1\nExternalRef: PACKAGE-MANAGER purl pkg:x/a@1\n\nPackageName: b\nSPDXID: B\nRelationship: B DEPENDENCY_OF A\nRelationship: A OTHER B\n")
    c, e = B.read_spdx_tags(spark, str(tmp_path))
    assert sorted((r.ref, r.name, r.version, r.purl) for r in c.collect()) == [("A", "a", "1", "pkg:x/a@1"), ("B", "b", None, None)]
    assert [tuple(r[1:]) for r in e.collect()] == [("A", "B")]


@pytest.mark.parametrize("kind, read", [("cyclonedx", sbom.read_cyclonedx), ("spdx", sbom.read_spdx), ("spdx3", B.read_spdx3)])
@pytest.mark.parametrize("n", [0, 1, 40])
def test_documents(spark, tmp_path, kind, read, n):
    rows = [(f"r{k}", "library", f'n"{k}', f"{k}.0", f"pkg:x/n{k}", None) for k in range(n)]
    c = spark.createDataFrame(rows, "ref string, ctype string, name string, version string, purl string, scope string").repartition(5)
    e = spark.createDataFrame([(f"r{k}", f"r{k + 1}") for k in range(n - 1)], "src string, dst string")
    B.write_document(c, e, str(tmp_path / "out"), kind, "urn:uuid:0")
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(pathlib.Path(p).read_text() for p in parts)
    json.loads(text)
    (tmp_path / "one.json").write_text(text)
    got_c, got_e = read(spark, str(tmp_path / "one.json"))
    assert sorted((r.ref, r.name, r.version, r.purl) for r in got_c.collect()) == sorted((r[0], r[2], r[3], r[4]) for r in rows)
    assert got_e.count() == max(n - 1, 0)


def test_attestations(spark):
    cdx = {"bomFormat": "CycloneDX", "components": [{"name": "a", "version": "1", "purl": "pkg:x/a@1"}]}
    spdx = {"spdxVersion": "SPDX-2.3", "packages": [{"name": "b", "versionInfo": "2", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:x/b@2"}]}]}
    sign = lambda kind, body: json.dumps({"payloadType": kind, "payload": base64.b64encode(json.dumps({"predicateType": "t", "predicate": body}).encode()).decode()})
    rows = [("s1", sign(B.PAYLOADS[0], cdx)), ("s2", sign("other", cdx)), ("s3", json.dumps(spdx)), ("s4", json.dumps({"_type": "x", "predicate": spdx})), ("s5", "\xff not json"), ("s6", json.dumps({"payloadType": B.PAYLOADS[0], "payload": "!!"}))]
    got = B.attested(spark.createDataFrame(rows, "source string, content string"))
    assert sorted(tuple(r) for r in got.collect()) == [("s1", "cyclonedx", "a", "1", "pkg:x/a@1"), ("s3", "spdx", "b", "2", "pkg:x/b@2"), ("s4", "spdx", "b", "2", "pkg:x/b@2")]


CASES = [("mit", "mit"), (" MIT  or (Apache-2.0 and  BSD-3-Clause) ", "MIT OR (Apache-2.0 AND BSD-3-Clause)"), ("GPL-2.0+ with Classpath-exception-2.0", "GPL-2.0+ WITH Classpath-exception-2.0"), ("((MIT))", "((MIT))"), ("", None), ("MIT OR", None), ("(MIT", None), ("MIT Apache-2.0", None), ("MIT & X", None), ("A WITH B WITH C", None), ("()", None), ("A WITH (B)", None)]


def test_expressions(spark):
    assert [normal_expression(a) for a, _ in CASES] == [b for _, b in CASES]
    got = spark.createDataFrame([*CASES, (None, None)], "a string, b string").withColumn("c", license_expression("a")).collect()
    assert all(r.b == r.c for r in got)


def test_evidence(spark):
    import json

    from quillgraph.sources import sbom_formats

    c = spark.createDataFrame([("a", "library", "a", "1", "pkg:x/a@1", "required"), ("b", "library", "b", None, None, None)], "ref string, ctype string, name string, version string, purl string, scope string")
    e = spark.createDataFrame([("a", "lockfile-parse", 0.9, "x/lock"), ("a", "lockfile-parse", 0.92, "y/lock"), ("a", "guess", 0.5, "x/lock"), ("a", "guess", 0.4, None)], "ref string, technique string, confidence double, path string")
    told = sbom_formats.with_evidence(c, e)
    lines = sbom_formats.WRITERS["cyclonedx"](told, spark.createDataFrame([("a", "b")], "src string, dst string"), "urn:uuid:1").orderBy("section", "place").collect()
    doc = json.loads("".join(r.value for r in lines))
    by = {x["bom-ref"]: x for x in doc["components"]}
    assert by["a"]["evidence"] == {"identity": [{"field": "purl", "confidence": 0.92, "methods": [{"technique": "manifest-analysis", "confidence": 0.92, "value": "lockfile-parse"}, {"technique": "other", "confidence": 0.5, "value": "guess"}]}], "occurrences": [{"location": "x/lock"}, {"location": "y/lock"}]}
    assert "evidence" not in by["b"] and doc["dependencies"] == [{"ref": "a", "dependsOn": ["b"]}]
