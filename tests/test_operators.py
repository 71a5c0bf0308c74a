"""The query language, versions, layers, resolution, readers and streams on hand-made rows."""

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import versions as V
from quillgraph.operators import components as C
from quillgraph.operators import resolution as R
from quillgraph.operators import timeline as L
from quillgraph.plans import dsl
from quillgraph.sources import lockfiles, sbom
from quillgraph.streaming import updates


@pytest.mark.parametrize("text, place", [("select x", 0), ("components where", 16), ("components where a = 1 x", 23), ("components where nope = 1", 17), ("components where tier = gold", 17), ("components where name = $", 24)])
def test_errors(spark, text, place):
    frame = spark.createDataFrame([], "id long, name string, version string, purl string, ctype string, tier_cap int, confidence double, excluded string, attrs map<string,string>")
    with pytest.raises(dsl.QueryError) as e:
        dsl.run(frame, text)
    assert e.value.place == place


def test_tree():
    tree = dsl.parse('components where name = "a\\"b" and (tier >= locked or observed = true) | count by tier')
    assert tree.count_by == "tier" and tree.condition.op == "and" and tree.condition.parts[0].value == 'a"b' and tree.condition.parts[1].op == "or"
    assert dsl.parse("paths from root to pkg:x/y@1") == dsl.PathsQuery("root", "pkg:x/y@1")
    assert dsl.glob_pattern("a_b*?%") == "a\\_b%_\\%"


def bounds_of(wanted):
    """(low, high, low included) of a caret, tilde or plain partial range, by the published rules in words."""
    sign, body = (wanted[0], wanted[1:]) if wanted[0] in "^~" else ("", wanted)
    given = [int(x) for x in body.split(".")]
    low = given + [0] * (3 - len(given))
    if sign == "^":
        place = next((k for k, x in enumerate(given) if x), len(given) - 1)
    elif sign == "~":
        place = min(1, len(given) - 1)
    else:
        place = len(given) - 1
    high = low[:place] + [low[place] + 1] + [0] * (2 - place)
    return low, high


NUMBER = st.integers(0, 4)
PLAIN = st.tuples(NUMBER, NUMBER, NUMBER)


@given(PLAIN, st.sampled_from(["^", "~", ""]), st.lists(NUMBER, min_size=1, max_size=3))
def test_ranges(version, sign, parts):
    wanted = sign + ".".join(map(str, parts))
    low, high = bounds_of(wanted)
    assert V.satisfies(".".join(map(str, version)), wanted) == (low <= list(version) < high)


@given(PLAIN, PLAIN, PLAIN, st.sampled_from(["<", "<=", ">", ">="]))
def test_comparators(version, a, b, op):
    text = lambda v: ".".join(map(str, v))
    holds = {"<": version < a, "<=": version <= a, ">": version > a, ">=": version >= a}[op]
    assert V.satisfies(text(version), op + text(a)) == holds
    assert V.satisfies(text(version), f"{text(a)} - {text(b)}") == (a <= version <= b)
    assert V.satisfies(text(version), f"{op} {text(a)} || {text(b)}") == (holds or version == b)
    assert V.satisfies(text(version) + "-pre.1", op + text(a)) is False  # the bound names no prerelease
    assert V.satisfies(text(version) + "-pre.2", f">={text(version)}-pre.1") is True
    assert V.satisfies("no version", op + text(a)) is False and V.satisfies(text(version), "no range") is False


def test_native_ranges(spark):
    """The compiled expression against the function, for every pair of a version and a range."""
    rng = random.Random(11)
    number = lambda: rng.randrange(4)
    full = lambda: f"{number()}.{number()}.{number()}" + rng.choice(["", "", "-beta", "-rc.1", "-rc.12", "-1"])
    versions = [full() for _ in range(120)] + ["v1.2.3", "1.2", "x", "", "1.2.3+build", None]
    ranges = [rng.choice(["^", "~", ">=", "<", "<=", ">", "", "="]) + rng.choice([full(), f"{number()}.{number()}", f"{number()}.x", "*"]) for _ in range(40)] + ["1.x || >=2.5.0 <3", "1.0.0 - 2.1", "", "bad range"]
    frame = spark.createDataFrame([(v,) for v in versions], "version string")
    got = frame.select("version", *(V.semver_in(F.col("version"), r).alias(str(k)) for k, r in enumerate(ranges))).collect()
    for row in got:
        assert [row[str(k)] for k in range(len(ranges))] == [V.satisfies(row.version or "", r) for r in ranges], row.version


@pytest.mark.parametrize("ecosystem, order", [("npm", ["0.9", "1.0.0-alpha", "1.0.0-beta.2", "1.0.0-beta.11", "v1", "1.0.1", "1.2", "1.10"]), ("gem", ["1.0-pre", "1", "1.0.1"]), ("other", ["1.0", "1.0.1", "1.0.2", "1.0.a", "1.0.b", "1.2"]), ("conda", ["1.0a1", "1.0", "1.0.post1"]), ("apk", ["1.0~rc", "1.0", "1.0-r1", "1:0.1"])])
def test_orders(ecosystem, order):
    signs = [[V.compare(ecosystem, a, b) for b in order] for a in order]
    assert signs == [[(i > j) - (i < j) for j in range(len(order))] for i in range(len(order))]


def test_equal_spellings():
    assert V.compare("npm", "1.2", "v1.2.0") == 0 == V.compare("pypi", "1.0", "1.0.0") and V.compare("nothing", "1.2", "1.2.0") == -1


def test_max_satisfying():
    assert V.max_satisfying(["1.9.0", "1.10.0", "2.0.0", "1.11.0-rc"], "^1.0.0") == "1.10.0"


@given(st.sampled_from(["npm", "deb", "pypi", "other"]), st.from_regex(r"\A[0-9]{1,2}(\.[0-9]{1,2}){0,2}(~rc[0-9]|-[0-9]|a)?\Z"), st.from_regex(r"\A[0-9]{1,2}(\.[0-9]{1,2}){0,2}(~rc[0-9]|-[0-9]|a)?\Z"))
def test_order(ecosystem, a, b):
    assert V.compare(ecosystem, a, a) == 0
    assert V.compare(ecosystem, a, b) == -V.compare(ecosystem, b, a)


@pytest.mark.parametrize("a, b, sign", [("1.0~rc1", "1.0", -1), ("1:0.9", "2.0", 1), ("1.0-1", "1.0-2", -1), ("1.0a", "1.0", 1), ("1.0+b", "1.0a", 1), ("1.0~", "1.0~rc", -1)])
def test_debian(a, b, sign):
    assert V.deb_compare(a, b) == sign


def test_layers(spark):
    rows = [(0, "etc/a"), (0, "opt/x/b"), (0, "opt/x/c"), (1, "etc/a"), (1, "opt/.wh.x"), (2, "opt/x/b"), (3, "opt/x/.wh..wh..opq"), (3, "opt/x/d")]
    got = L.layer_transitions(spark.createDataFrame(rows, "ordinal int, path string"))
    assert sorted(map(tuple, got.collect())) == [("etc/a", 0, "added"), ("etc/a", 1, "modified"), ("opt/x/b", 0, "added"), ("opt/x/b", 1, "removed"), ("opt/x/b", 2, "added"), ("opt/x/b", 3, "opaque-cleared"), ("opt/x/c", 0, "added"), ("opt/x/c", 1, "removed"), ("opt/x/d", 3, "added")]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)]
    label = {n: n for p in pairs for n in p}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    loops = {a for a, b in pairs if a == b} - {n for a, b in pairs if a != b for n in (a, b)}
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {k: v for k, v in label.items() if k not in loops}
    assert C.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_resolution(spark):
    rows = [(1, "npm", "a", "1", None, {"sha256": "AA"}, 3, None), (2, "npm", "b", "2", None, {"SHA256": "aa"}, 4, "MIT"), (3, "npm", "c", None, "pkg:npm/c@1", None, 2, None), (4, "npm", "c", "1", "pkg:npm/c@1", {"md5": "x"}, 4, None), (5, "npm", "d", None, None, None, 1, None)]
    claims = spark.createDataFrame(rows, "id long, ecosystem string, name string, version string, purl string, hashes map<string,string>, tier int, license string")
    for seed in (1, 2):
        roots = R.resolved(claims.orderBy(C.F.rand(seed)))
        assert {r.id: r.root for r in roots.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    one = {r.root: r for r in R.folded(claims.join(roots, "id")).collect()}
    assert (one[1].name, one[1].license, one[3].hashes) == ("b", "MIT", {"md5": "x"})


def test_lockfiles(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/Cargo.lock").write_text('[[package]]\nname = "x"\nversion = "1.0"\n[[package]]\nname = "y"\n')
    (tmp_path / "flake.lock").write_text(json.dumps({"nodes": {"n": {"locked": {"rev": "abc"}}}}))
    (tmp_path / "pubspec.lock").write_text("packages: [")
    (tmp_path / "other.txt").write_text("x")
    got = lockfiles.detect(lockfiles.tree(spark, str(tmp_path))).collect()
    assert sorted((r.detector, r.name, r.version) for r in got if not r.error) == [("nix/flake-lock", "n", "abc"), ("rust/cargo-lock", "x", "1.0"), ("rust/cargo-lock", "y", None)]
    assert [r.detector for r in got if r.error] == ["dart/pubspec-lock"]
    assert list(lockfiles.walk({"deps": {"k": [{"v": 1}]}}, "$.deps.*[*]")) == [("k", {"v": 1})]


def test_inventories(spark, tmp_path):
    cdx = {"bomFormat": "CycloneDX", "components": [{"bom-ref": "1", "type": "library", "name": "a", "version": "1", "purl": "pkg:x/a@1"}, {"bom-ref": "2", "type": "library", "name": "b"}], "dependencies": [{"ref": "1", "dependsOn": ["2"]}]}
    spdx = {"spdxVersion": "SPDX-2.3", "packages": [{"SPDXID": "P1", "name": "a", "versionInfo": "1", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:x/a@1"}]}, {"SPDXID": "P2", "name": "b"}], "relationships": [{"spdxElementId": "P2", "relationshipType": "DEPENDENCY_OF", "relatedSpdxElement": "P1"}]}
    for name, doc in (("c.json", cdx), ("s.json", spdx)):
        (tmp_path / name).write_text(json.dumps(doc))
        assert sbom.format_of(json.dumps(doc)) == {"c": "cyclonedx", "s": "spdx"}[name[0]]
    c, e = sbom.read_cyclonedx(spark, str(tmp_path / "c.json"))
    s, f = sbom.read_spdx(spark, str(tmp_path / "s.json"))
    pick = lambda x: sorted(((r.name, r.version, r.purl) for r in x.collect()), key=repr)
    assert [x[:1] for x in pick(c)] == [x[:1] for x in pick(s)] == [("a",), ("b",)]
    assert [(r.src, r.dst) for r in e.collect()] == [("1", "2")] and [(r.src, r.dst) for r in f.collect()] == [("P1", "P2")]
    assert sbom.content_serial(c) == sbom.content_serial(c.repartition(3)) == sbom.content_serial(s)
    assert sorted(r.rule for r in sbom.violations(c).collect()) == ["missing-identifier", "missing-version"]
    sbom.write_cyclonedx(c, e, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_streams(spark, tmp_path):
    schema = "host string, identity string, name string, version string, tier int, confidence double, observed boolean, ports string, excluded string"
    for k, rows in enumerate([[("h1", "a", "a", "1", 2, 0.5, False, "", None), ("h1", "c", "c", "1", 2, 0.5, False, "", "user")], [("h2", "a", "a", "2", 4, 0.9, True, "443", None), ("h2", "b", "b", "1", 1, 0.1, False, "", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        updates.keep_fleet(updates.arrivals(spark, str(tmp_path / "in"), schema), str(tmp_path / "fleet"), str(tmp_path / "check")).awaitTermination()
    got = {r.identity: (r.version, r.observed) for r in updates.fleet_so_far(spark, str(tmp_path / "fleet")).collect()}
    assert got == {"a": ("2", True), "b": ("1", False)}
    assert [tuple(x) for r in updates.fleet_so_far(spark, str(tmp_path / "fleet")).where("identity = 'a'").collect() for x in r.seen_in] == [("h1", "1", False, ""), ("h2", "2", True, "443")]
    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    whole.write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(str(tmp_path / "events"))
    q = updates.activity(events).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("activity").agg({"n": "sum"}).first()[0] == whole.count()
