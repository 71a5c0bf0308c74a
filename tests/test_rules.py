"""Graph walks without silent ends, and the rules of drift, emission, merging and differences, on hand-made rows."""

import random

import pytest

from quillgraph.operators import analytics as A
from quillgraph.operators import graph as G
from quillgraph.operators import matching as M
from quillgraph.operators import setops as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_deep_chain(spark):
    edges = frame(spark, [(k, k + 1, None) for k in range(40)] + [(7, 3, None)], "src long, dst long, marker string")
    got = {r.node: r.depth for r in G.reachable(edges, spark.range(1)).collect()}
    assert got == {k: k for k in range(41)}
    ways = G.paths_to_roots(edges.where("src <> 7 or dst <> 3"), frame(spark, [(9,), (40,)], "id long"), max_depth=12).collect()
    assert sorted((r.target, r.path, r.complete) for r in ways) == [(9, list(range(10)), True), (40, list(range(29, 41)), False)]
    assert [r.path for r in G.paths_to_roots(edges, frame(spark, [(5,)], "id long")).collect()] == [[0, 1, 2, 3, 4, 5]]


def test_nearest(spark):
    rng = random.Random(6)
    names, versions = [f"m{k}" for k in range(12)], ["1", "2", "3"]
    tree = {(m, v): [(rng.choice(names), rng.choice(versions)) for _ in range(rng.randrange(3))] for m in names for v in versions}
    for k in range(60):  # deeper than any limit
        tree[f"deep{k}", "1"] = [(f"deep{k + 1}", "1")]
    tree["m3", "1"] = [*tree["m3", "1"], ("deep0", "1")]
    roots, managed = [("m3", "1"), ("m7", "2"), ("m3", "2")], {"m5": "9"}
    seen, best, queue = set(), {}, [(m, v, 1) for m, v in roots]
    while queue:
        m, v, depth = queue.pop(0)
        best.setdefault(m, (managed.get(m, v), depth))
        if (m, v) not in seen:
            seen.add((m, v))
            queue += [(a, b, depth + 1) for a, b in tree.get((m, v), [])]
    requires = frame(spark, [(m, v, a, b, k) for (m, v), deps in tree.items() for k, (a, b) in enumerate(deps)], "module string, version string, dep_module string, dep_version string, seq int")
    top = frame(spark, [(m, v, k) for k, (m, v) in enumerate(roots)], "module string, version string, seq int")
    got = G.nearest_versions(requires, top, frame(spark, list(managed.items()), "module string, version string")).collect()
    assert {r.module: (r.version, r.depth) for r in got} == best and max(d for _, d in best.values()) > 50
    assert G.nearest_versions(requires, top.limit(0)).count() == 0


def test_drift(spark):
    schema = "id long, family string, ecosystem string, ctype string, scope string, conditional boolean, optional boolean, confidence double"
    rows = [(1, "a", "npm", "library", None, None, None, 0.9), (2, "a", "npm", "library", None, None, None, 0.9), (3, "b", "npm", "library", "build", None, None, 0.9), (4, "c", "npm", "library", None, True, False, 0.9), (5, "d", "npm", "library", None, None, None, 0.8), (6, "e", "deb", "os-package", None, None, None, 0.8), (7, "f", "pypi", "library", None, None, None, 0.9), (8, "g", "gem", "library", None, None, None, 0.7), (9, "h", "npm", "library", None, None, None, 0.7), (10, "i", "npm", "build-tool", None, None, None, 0.7), (11, "d2", "npm", "library", None, None, None, 0.5)]
    seen = [(1, 2), (2, 3), (3, 2), (4, 2), (5, 4), (6, 4), (6, 4), (7, 2), (8, 5), (9, 2), (9, 4), (10, 3), (11, 5)]
    got = A.drift(frame(spark, rows, schema), frame(spark, seen, "component_id long, tier int")).collect()
    assert sorted((r.component_id, r.code.removeprefix("drift:"), r.confidence) for r in got) == [(1, "declared-not-installed", 0.9), (2, "declared-not-installed", 0.9), (5, "installed-not-declared", 0.64), (11, "installed-not-declared", 0.4)]


def test_emission(spark):
    c = frame(spark, [(1, 1, 0.1, {"scope": "dev"}), (2, 1, 0.9, {"scope": None}), (3, 3, 0.2, {"scope": "dev"}), (4, 2, 0.9, {"scope": "runtime"}), (5, 4, 0.9, {"scope": "runtime"})], "id long, tier_cap int, confidence double, attrs map<string,string>")
    fixtures = frame(spark, [(5,)], "component_id long")
    told = lambda **k: [r.reason for r in A.emit_set(c, fixtures, **k).orderBy("id").collect()]
    assert told() == ["low-confidence", None, "scope", None, "fixture-only"]
    assert told(paranoid=True) == ["below-locked", "below-locked", "scope", "below-locked", "fixture-only"]
    assert told(scopes=(), min_confidence=0.0) == [None, None, None, None, "fixture-only"]
    evidence = frame(spark, [(1, ["path-role-fixture", "x"]), (1, ["path-role-fixture"]), (2, None), (2, ["path-role-fixture"]), (3, [])], "component_id long, modifiers array<string>")
    assert [tuple(r) for r in A.fixture_only(evidence).collect()] == [(1, 2)]


def test_diff(spark):
    schema = "family string, id long, ecosystem string, version string, scope string, confidence double, state string"
    a = [("lodash", 1, "npm", "4.9.0", "runtime", 0.9, None), ("gone", 2, "npm", "1", None, 0.9, None), ("same", 3, "npm", "1.0", None, 0.9, None), ("old", 4, "npm", "1", None, 0.9, "removed"), ("lib", 5, "other", "1.0.2", "", 0.5, None), ("bare", 6, "npm", None, "x", 0.5, None)]
    b = [("lodash", 1, "npm", "4.10.0", "dev", 0.5, None), ("fresh", 2, "npm", "0.1", None, 0.9, None), ("same", 3, "npm", "1.0.0", "", 0.94, None), ("lib", 5, "other", "1.0.a", None, 0.55, None), ("bare", 6, "npm", "2", "x", 0.5, None)]
    got = S.diff(frame(spark, a, schema), frame(spark, b, schema)).collect()
    want = [("lodash", "upgraded", "4.9.0", "4.10.0"), ("lodash", "scope", "runtime", "dev"), ("lodash", "confidence", "0.90", "0.50"), ("gone", "removed", "1", None), ("fresh", "added", None, "0.1"), ("same", "changed", "1.0", "1.0.0"), ("lib", "upgraded", "1.0.2", "1.0.a"), ("lib", "confidence", "0.50", "0.55")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_merge(spark):
    schema = "entry long, label string, id long, name string, family string, version string, tier int, confidence double, hashes map<string,string>, license string, excluded string, keys array<string>"
    rows = [
        (1, "a", 1, "lodash", "npm:lodash", "4.17.21", 3, 0.9, None, None, None, ["purl:l21"]),
        (2, "a", 2, "shared", "npm:shared", "1.0.0", 2, 0.99, {"sha": "1"}, None, None, ["digest:sha:1", "purl:s1"]),
        (3, "b", 1, "lodash", "npm:lodash", "4.17.20", 3, 0.9, None, "MIT", None, ["purl:l20"]),
        (4, "b", 2, "Shared", "npm:shared", "1.0.0", 4, 0.5, {"sha": "2", "md5": "x"}, "ISC", None, ["digest:md5:x", "purl:s2"]),
        (5, "b", 3, "bridge", "npm:shared", "1.0.0", 1, 0.5, {"sha": "3"}, "BSD", None, ["digest:sha:1", "digest:md5:x"]),
        (6, "b", 4, "hidden", "npm:hidden", "1", 5, 1.0, None, None, "user", ["purl:s1"]),
    ]
    inputs = frame(spark, rows, schema)
    ids = S.merged_ids(inputs.where("excluded is null"))
    assert {r.entry: r.merged for r in ids.collect()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 2}
    whole = {r.merged: r for r in S.merge(inputs, ids).collect()}
    assert (whole[2].name, whole[2].tier, whole[2].license, whole[2].hashes, whole[2].labels) == ("Shared", 4, "ISC", {"sha": "3", "md5": "x"}, "a,b") and len(whole) == 3
    assert [r.merged for r in S.merge(inputs, ids, "intersect").collect()] == [2]
    assert [(r.family, r.versions, r.detail) for r in S.merge_conflicts(S.merge(inputs, ids)).collect()] == [("npm:lodash", 2, "4.17.20 vs 4.17.21")]
    assert {tuple(r) for r in S.described_by(inputs, S.merge(inputs, ids, "hierarchical"), ids).collect()} == {("a", 1), ("a", 2), ("b", 3), ("b", 2)}
    edges = frame(spark, [("a", "depends", 1, 2), ("b", "depends", 3, 2), ("b", "depends", 1, 3), ("b", "depends", 1, 4), ("a", "depends", 1, 2)], "label string, kind string, src long, dst long")
    assert {tuple(r) for r in S.remapped_edges(edges, inputs, ids, S.merge(inputs, ids)).collect()} == {("depends", 1, 2, "a"), ("depends", 3, 2, "b")}
    with pytest.raises(ValueError):
        S.merge(inputs, ids, "other")


def test_cross_check(spark):
    a = frame(spark, [("x", 1, "1"), ("x", 2, "2"), ("y", 3, None), ("z", 4, "1")], "family string, id long, version string")
    b = frame(spark, [("x", 1, "1"), ("x", 2, "9"), ("y", 3, "5"), ("w", 4, "1")], "family string, id long, version string")
    assert sorted(map(tuple, S.cross_check(a, b).collect()), key=repr) == sorted([("x", "matched", "1", "1"), ("x", "version-mismatch", "2", "1"), ("y", "matched", None, "5"), ("z", "claimed-only", "1", None), ("w", "scanned-only", None, "1")], key=repr)


def test_fleet(spark):
    """A hundred hosts: three versions, some of them seen running."""
    rows = []
    for i in range(100):
        version = "3.0.11" if i % 10 < 4 else "3.0.14" if i % 10 < 7 else "3.0.15"
        running = i % 10 in (0, 1, 2, 4, 5, 6)
        rows += [(f"host:{i:03}", f"openssl {version}", "openssl", version, 4, 0.98, running, "443" if running else "", None), (f"host:{i:03}", "nginx 1.24.0", "nginx", "1.24.0", 4, 0.9 + i / 2000, False, "", None), (f"host:{i:03}", "zlib", "zlib", "1.2.13", 4, 0.98, False, "", "user" if i % 2 else None)]
    merged = A.fleet_merge(frame(spark, rows, "host string, identity string, name string, version string, tier int, confidence double, observed boolean, ports string, excluded string"))
    got = {r.identity: r for r in merged.collect()}
    assert len(got) == 5 and got["zlib"].hosts == 50 and got["nginx 1.24.0"].confidence == 0.9495
    old = [x.host for r in got.values() if r.name == "openssl" and r.version < "3.0.14" for x in r.seen_in if x.observed]
    assert len(old) == 30 and {x.ports for x in got["openssl 3.0.11"].seen_in} == {"443", ""}
    assert {(r.components, r.observed) for r in A.fleet_rollup(merged).collect()} == {(3, 1), (2, 1), (3, 0), (2, 0)}
    skew = A.version_skew(merged).collect()
    assert len(skew) == 100 and {r.name for r in skew} == {"openssl"} and {r.versions for r in skew} == {"3.0.11", "3.0.14", "3.0.15"}


def test_pages(spark):
    rng = random.Random(3)
    rows = frame(spark, [(rng.choice("abc"), rng.choice(["1", "2", None]), k) for k in range(57)], "name string, version string, id long").repartition(3)
    seen, cursor = [], None
    while True:
        part = A.page(rows, cursor, 10).collect()
        seen += part
        if len(part) < 10:
            break
        cursor = A.cursor_of((part[-1].name, part[-1].version or "", part[-1].id))
    assert [tuple(r) for r in seen] == sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1] or "", r[2]))
    assert A.after_cursor("rubbish") is None is A.after_cursor(None) and A.cursor_of(None) is None
    order = A.emission_order(frame(spark, [(k, f"N{k % 7}", None, None if k % 3 else f"pkg:x/{k % 5}", "user" if k == 4 else None) for k in range(40)], "id long, name string, version string, purl string, excluded string").repartition(5)).collect()
    want = sorted((f"pkg:x/{k % 5}" if k % 3 == 0 else "", f"n{k % 7}", "", k) for k in range(40) if k != 4)
    assert [r.id for r in sorted(order, key=lambda r: r.place)] == [k for *_, k in want] and [r.place for r in sorted(order, key=lambda r: r.place)] == list(range(1, 40))


def test_constants_and_licenses(spark):
    blobs = frame(spark, [(1, "xxOpenSSL 1.0yy"), (2, "openss"), (3, None), (4, "")], "subject long, text string")
    known = frame(spark, [("o", "OpenSSL", 0.5), ("o", "SSL 1.0", 0.4), ("o", "none here", 0.9), ("z", "xxOpen", 0.9), ("o", "OpenSSL", 0.5), ("t", "yy", 0.9)], "library string, value string, precision double")
    assert sorted(map(tuple, M.constant_hits(blobs, known).collect())) == [(1, "o", 2, 0.7), (1, "z", 1, 0.85)]
    text = " ".join(f"word{k}" for k in range(60))
    corpus = frame(spark, [("A", text), ("B", text.replace("word3 ", "other ")), ("C", "short text")], "entry string, text string")
    texts = frame(spark, [(1, "Copyright 2020 Someone\n" + text.upper()), (2, text[:200]), (3, "short text"), (4, None), (5, text.replace("word40 ", "x "))], "subject long, text string")
    assert sorted((r.subject, r.entry, round(r.score, 2)) for r in M.detected_licenses(texts, corpus).collect()) == [(1, "A", 1.0), (5, "A", 0.97)]


def test_merged_edges(spark):
    rows = [("d", 1, 2, 5, None, "^2", False, "m5", {"a": "5", "b": "x"}), ("d", 1, 2, 3, "dev", None, True, None, {"a": "3", "c": "y"}), ("d", 1, 2, 4, "test", "^1", False, "m4", None), ("d", 3, 3, 1, None, None, True, None, None)]
    got = A.merged_edges(frame(spark, rows, "kind string, src long, dst long, ordinal long, scope string, requested string, direct boolean, marker string, attrs map<string,string>")).collect()
    assert [(r.scope, r.requested, r.direct, r.marker, r.attrs) for r in got] == [("dev", "^1", True, "m5", {"a": "5", "b": "x", "c": "y"})]
