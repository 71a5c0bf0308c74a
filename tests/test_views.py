"""Trees, selections, caches and whole reconciliation on hand-made rows."""

from pyspark.sql import functions as F

from quillgraph.operators import inventory as I
from quillgraph.operators import reconcile as R

COMPONENTS = "id long, name string, version string, purl string, tier_cap int, confidence double, excluded string, attrs map<string,string>"


def test_tree(spark):
    c = spark.createDataFrame([(1, "b", "1", None, 3, 0.9, None, {}), (2, "a", None, None, 2, 0.5, None, {}), (3, "c", "3", None, 4, 1.0, None, {}), (4, "gone", "1", None, 4, 1.0, "x", {})], COMPONENTS)
    e = spark.createDataFrame([(-1, 1), (-1, 2), (1, 3), (3, 1), (2, 4), (2, 3), (2, 3)], "src long, dst long")
    lines = [r.line for r in I.tree_lines(c, e, spark.createDataFrame([(-1, ".")], "id long, path string")).orderBy("way").collect()]
    b, leaf = "b@1 [locked 0.90]", "c@3 [installed 1.00]"
    assert lines == [".", "  a@? [declared 0.50]", f"    {leaf}", f"      {b}", f"        {leaf} (cycle)", f"  {b}", f"    {leaf}", f"      {b} (cycle)"]
    cut = [r.line for r in I.tree_lines(c, e, spark.createDataFrame([(-1, ".")], "id long, path string"), max_depth=1).orderBy("way").collect()]
    assert cut == [".", "  a@? [declared 0.50] (deeper)", f"  {b} (deeper)"]


def test_selection(spark):
    c = spark.createDataFrame([(1, "a", "1", None, 3, 0.9, None, {}), (2, "b", "1", None, 3, 0.9, "low", {}), (3, "c", "1", None, 3, 0.9, None, {})], COMPONENTS)
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    told = lambda df: {r.id: r.excluded for r in df.collect()}
    assert told(I.subgraph(c, ids)) == {1: None, 2: "low", 3: "unselected"}
    assert told(I.subgraph(c, ids, include_excluded=True)) == {1: None, 2: None, 3: "unselected"}
    assert told(I.subgraph(c, include_excluded=True)) == {1: None, 2: None, 3: None} and told(I.subgraph(c)) == {1: None, 2: "low", 3: None}


def test_cache(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2")], "path string, digest string")
    key = lambda *x: I.cache_key(F.lit(x[0]), F.lit(x[1]), *x[2:])
    one = I.config_fingerprint({"x": 1, "y": [2]})
    assert one == I.config_fingerprint({"y": [2], "x": 1}) != I.config_fingerprint({"x": 2, "y": [2]}) and len(one) == 16
    cache = spark.range(1).select(key("a", "1", ["p", "q"], one).alias("key"), F.lit("[1]").alias("result"))
    assert sorted((r.path, r.digest) for r in I.uncached(files, cache, ["q", "p"], one).collect()) == [("a", "2"), ("b", "1")]
    assert [(r.path, r.result) for r in I.cached_results(files, cache, ["q", "p"], one).collect()] == [("a", "[1]")]
    assert I.uncached(files, cache, ["p"], one).count() == 3 == I.uncached(files, cache, ["p", "q"], "other").count()


def test_graph(spark):
    """A lockfile and what is installed: pins, drift, scopes, edges and what is emitted, whatever the order of rows."""
    none = {}
    claims = [
        (1, "library", "pypi", None, "requests", "2.31.0", "pkg:pypi/requests@2.31.0", {"sha256": "A"}, none, {"x": "1"}, None, None),
        (2, "library", "pypi", None, "requests", "2.32.0", "pkg:pypi/requests@2.32.0", none, none, none, "Apache-2.0", None),
        (3, "library", "pypi", None, "urllib3", "2.2.1", None, none, none, none, None, None),
        (4, "library", "npm", None, "lodash", "4.17.21", None, none, none, none, None, None),
        (5, "library", "npm", None, "lodash", None, None, none, none, none, None, "^4"),
        (6, "library", "npm", "@types", "node", None, None, none, none, none, None, "^20"),
        (7, "library", "vcpkg", None, "zlib", "1", None, none, {"triplet": "x64"}, none, None, None),
        (8, "library", "vcpkg", None, "zlib", "2", None, none, {"triplet": "x64-static"}, none, None, None),
        (9, "library", "vcpkg", None, "zlib", "3", None, none, {"triplet": "x64"}, none, None, None),
        (10, "library", "pypi", None, "orphan", "1", None, none, none, none, None, None),
        (11, "library", "pypi", None, "silent", "1", None, none, none, none, None, None),
        (12, "library", "npm", None, "tests-only", "1", None, none, none, none, None, None),
    ]
    evidence = [(1, 3, 0.9, None), (2, 4, 0.95, None), (3, 3, 0.9, None), (4, 3, 0.9, None), (5, 2, 0.85, None), (6, 2, 0.85, None), (7, 4, 0.9, None), (8, 4, 0.9, None), (9, 4, 0.9, None), (10, 4, 0.95, None), (12, 3, 0.9, ["path-role-fixture"])]
    edges = [(1, "DEPENDS_ON", "project:.", "family:pypi/requests", "runtime", "^2", True, None, none), (2, "DEPENDS_ON", "family:pypi/requests", "family:pypi/urllib3", None, None, False, None, {"k": "v"}), (3, "DEPENDS_ON", "project:.", "family:npm/lodash", "dev", None, True, 'python_version < "3"', none), (4, "DEPENDS_ON", "family:pypi/urllib3", "family:pypi/orphan", None, None, False, 'extra == "all"', none), (5, "DEPENDS_ON", "project:.", "family:npm/none", None, None, True, None, none)]
    frames = [
        (claims, "id long, ctype string, ecosystem string, namespace string, name string, version string, purl string, hashes map<string,string>, qualifiers map<string,string>, attrs map<string,string>, license string, requested string"),
        (evidence, "claim_id long, tier int, confidence double, modifiers array<string>"),
        (edges, "ordinal long, kind string, src string, dst string, scope string, requested string, direct boolean, marker string, attrs map<string,string>"),
        ([(-1, ".")], "id long, path string"),
    ]
    seen = []
    for seed in (1, 2):
        made = R.reconciled_graph(*(spark.createDataFrame(rows, schema).orderBy(F.rand(seed)) for rows, schema in frames))
        nodes = {r.id: r for r in made.components.collect()}
        assert set(nodes) == {1, 3, 4, 6, 7, 8, 10, 12}
        one = nodes[1]
        assert (one.version, one.purl, one.license, one.hashes, one.attrs, one.tier_cap, one.confidence, one.scope) == ("2.32.0", "pkg:pypi/requests@2.32.0", "Apache-2.0", {"sha256": "A"}, {"x": "1"}, 4, 0.98, "runtime")
        assert (nodes[6].purl, nodes[6].requested, nodes[4].requested, nodes[4].purl) == ("pkg:npm/%40types/node", "^20", None, "pkg:npm/lodash")
        assert (nodes[3].scope, nodes[4].scope, nodes[4].conditional, nodes[10].scope, nodes[10].conditional, nodes[12].scope) == ("runtime", "dev", True, "optional", True, None)
        assert {k: v.excluded for k, v in nodes.items() if v.excluded} == {12: "fixture-only"}
        assert nodes[10].confidence == 0.76 and nodes[8].version == "2" and nodes[7].version == "3"
        notes = {(r.component_id, r.code) for r in made.annotations.collect()}
        assert notes == {(1, "drift:locked-vs-installed"), (3, "drift:declared-not-installed"), (7, "version-conflict"), (10, "drift:installed-not-declared")}
        got = {(r.src, r.dst): (r.scope, r.requested, r.direct, r.marker, r.attrs) for r in made.edges.collect()}
        assert set(got) == {(-1, 1), (1, 3), (-1, 4), (3, 10)} and got[1, 3] == (None, None, False, None, {"k": "v"}) and got[-1, 1][:2] == ("runtime", "^2")
        seen.append(sorted(map(repr, nodes.values())))
    assert seen[0] == seen[1]
