"""Relations of manifests, and the way from files to paths between components."""

from pyspark.sql import functions as F

from quillgraph.operators.graph import paths_to_roots
from quillgraph.plans import dsl
from quillgraph.sources import relations as R
from quillgraph.sources.scan import scanned

CASES = [
    ("/p/package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}, "optionalDependencies": {"c": "3"}}', [(None, "a", "runtime", "^1"), (None, "b", "dev", "2"), (None, "c", "optional", "3")]),
    ("/p/package-lock.json", '{"packages": {"": {"dependencies": {"a": "^1"}}, "node_modules/a": {"version": "1", "dependencies": {"@s/b": "2"}}, "node_modules/a/node_modules/@s/b": {"optionalDependencies": {"c": "*"}}}}', [(None, "a", "runtime", "^1"), ("a", "@s/b", None, "2"), ("@s/b", "c", "optional", "*")]),
    ("/q/package-lock.json", '{"dependencies": {"a": {"version": "1", "requires": {"b": "^2"}, "dependencies": {"b": {"version": "2", "requires": {"c": "3"}}}}}}', [("a", "b", None, "^2"), ("b", "c", None, "3")]),
    ("/p/yarn.lock", '"@a/b@^1.0":\n  version "1.2"\n  dependencies:\n    "@c/d" "^3"\n    e "2"\n\nc@2:\n  version "2.1"\n', [("@a/b", "@c/d", None, "^3"), ("@a/b", "e", None, "2")]),
    ("/p/pnpm-lock.yaml", "importers:\n  .:\n    dependencies:\n      a:\n        specifier: ^1\n        version: 1.0.0\n    devDependencies:\n      b: {specifier: '2', version: 2.0.0}\nsnapshots:\n  a@1.0.0:\n    dependencies:\n      c: 3.0.0\n", [(None, "a", "runtime", "^1"), (None, "b", "dev", "2"), ("a", "c", None, None)]),
    ("/p/requirements-dev.txt", "# c\nA[x]>=1.0 ; python_version > '3'\nb # why\n-r other\n", [(None, "A", "dev", ">=1.0"), (None, "b", "dev", None)]),
    ("/p/pyproject.toml", '[project]\ndependencies = ["a>=1", "b; os == \'x\'"]\n[project.optional-dependencies]\nall = ["c"]\n[dependency-groups]\ntest = ["d"]\n[build-system]\nrequires = ["e"]\n[tool.poetry.dependencies]\npython = "3"\nf = {version = "1"}\n', [(None, "a", "runtime", ">=1"), (None, "b", "runtime", None), (None, "c", "optional", None), (None, "d", "dev", None), (None, "e", "build", None), (None, "f", "runtime", "1")]),
    ("/p/poetry.lock", '[[package]]\nname = "a"\nversion = "1"\n[package.dependencies]\nb = ">=2"\nc = {version = "3", markers = "extra == \\"x\\""}\n', [("a", "b", None, ">=2"), ("a", "c", None, "3")]),
    ("/p/uv.lock", '[[package]]\nname = "me"\nsource = {virtual = "."}\ndependencies = [{name = "a"}]\n[package.dev-dependencies]\ndev = [{name = "t"}]\n[[package]]\nname = "a"\nsource = {registry = "x"}\ndependencies = [{name = "b", marker = "m"}]\n', [(None, "a", "runtime", None), (None, "t", "dev", None), ("a", "b", None, None)]),
    ("/p/Pipfile.lock", '{"default": {"a": {"version": "==1"}}, "develop": {"b": {}}}', [(None, "a", "runtime", "==1"), (None, "b", "dev", None)]),
    ("/p/Cargo.toml", '[dependencies]\na = "1"\nb = {version = "2", optional = true}\n[dev-dependencies]\nc = {path = "."}\n[build-dependencies]\nd = {package = "e", version = "3"}\n', [(None, "a", "runtime", "1"), (None, "b", "optional", "2"), (None, "c", "dev", None), (None, "e", "build", "3")]),
    ("/p/Cargo.lock", '[[package]]\nname = "a"\nversion = "1"\ndependencies = ["b", "c 2.0"]\n', [("a", "b", None, None), ("a", "c", None, None)]),
    ("/p/go.mod", "module m\nrequire x/y v1.0.0\nrequire (\n\ta/b v2.0.0 // indirect\n)\n", [(None, "x/y", "runtime", "v1.0.0")]),
    ("/p/Gemfile.lock", "GEM\n  specs:\n    rack (2.0)\n      dep (>= 1)\n\nDEPENDENCIES\n  rack (~> 2)\n", [("rack", "dep", None, ">= 1"), (None, "rack", "runtime", "~> 2")]),
    ("/p/composer.json", '{"require": {"php": "8", "v/a": "^1"}, "require-dev": {"v/b": "2"}}', [(None, "v/a", "runtime", "^1"), (None, "v/b", "dev", "2")]),
    ("/p/composer.lock", '{"packages": [{"name": "v/a", "require": {"v/c": "1", "ext-x": "*"}}]}', [("v/a", "v/c", None, "1")]),
    ("/p/pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency><dependency><groupId>g</groupId><artifactId>o</artifactId><optional>true</optional></dependency></dependencies></project>", [(None, "g:a", "runtime", "1"), (None, "g:t", "test", None), (None, "g:o", "optional", None)]),
    ("/p/build.gradle", "implementation 'g:a:1'\ntestImplementation(\"g:b:2\")\n", [(None, "g:a", "runtime", "1"), (None, "g:b", "test", "2")]),
    ("/p/pubspec.lock", "packages:\n  a: {dependency: 'direct main'}\n  b: {dependency: 'direct dev'}\n  c: {dependency: transitive}\n", [(None, "a", "runtime", None), (None, "b", "dev", None)]),
    ("/p/npm-ls.json", '{"dependencies": {"a": {"version": "1", "dependencies": {"b": {"dependencies": {"c": {}}}}}}, "devDependencies": {"d": {}}}', [(None, "a", "runtime", None), ("a", "b", None, None), ("b", "c", None, None), (None, "d", "dev", None)]),
    ("/p/bun.lock", '{"workspaces": {"": {"dependencies": {"a": "^1"},}}, "packages": {"a": ["a@1.0.0", "", {"dependencies": {"b": "2"}}, "h"], "b": ["b@2.0.0", "", {}, "h"],},}', [(None, "a", "runtime", "^1"), ("a", "b", None, "2")]),
    ("/p/Podfile.lock", "PODS:\n  - A (1.0)\n  - B (2.0):\n    - A (= 1.0)\nDEPENDENCIES:\n  - B (~> 2)\n", [("B", "A", None, "= 1.0"), (None, "B", "runtime", "~> 2")]),
    ("/p/packages.lock.json", '{"dependencies": {"net8": {"A": {"type": "Direct", "requested": "[1, )", "dependencies": {"B": "2"}}, "B": {"type": "Transitive"}}}}', [(None, "A", "runtime", "[1, )"), ("A", "B", None, "2")]),
    ("/p/project.assets.json", '{"targets": {"net8": {"A/1": {"dependencies": {"B": "2"}}, "B/2": {}}}}', [("A", "B", None, "2")]),
    ("/p/x.csproj", "<Project><ItemGroup><PackageReference Include='A' Version='1'/><PackageReference Include='T' PrivateAssets='All'/></ItemGroup></Project>", [(None, "A", "runtime", "1"), (None, "T", "build", None)]),
    ("/p/mix.lock", '%{\n  "a": {:hex, :a, "1.0", "h", [:mix], [{:b, "~> 2.0", [hex: :b, repo: "hexpm"]}], "hexpm", "h2"},\n}\n', [("a", "b", None, "~> 2.0")]),
    ("/p/x.gemspec", "s.add_dependency 'a', '~> 1'\ns.add_development_dependency('b')\n", [(None, "a", "runtime", "~> 1"), (None, "b", "dev", None)]),
    ("/p/vcpkg.json", '{"dependencies": ["a", {"name": "b", "version>=": "2", "host": true}]}', [(None, "a", "runtime", None), (None, "b", "build", "2")]),
    ("/p/environment.yml", "dependencies:\n- a=1.2\n- c::b >=2\n- pip:\n  - d==4\n", [(None, "a", "runtime", "=1.2"), (None, "b", "runtime", ">=2")]),
    ("/x/conda-meta/a-1.json", '{"name": "a", "depends": ["b >=1,<2", "c"]}', [("a", "b", None, ">=1,<2"), ("a", "c", None, None)]),
    ("/x/var/lib/pacman/local/a-1/desc", "%NAME%\na\n\n%DEPENDS%\nglibc>=2\nzlib\n\n%OPTDEPENDS%\nperl: for x\n", [("a", "glibc", None, ">=2"), ("a", "zlib", None, None), ("a", "perl", "optional", None)]),
    ("/x/a.dist-info/METADATA", "Name: A\nVersion: 1\nRequires-Dist: b (>=2)\nRequires-Dist: c; extra == 'x'\n\nRequires-Dist: no\n", [("A", "b", None, ">=2"), ("A", "c", None, None)]),
    ("/x/var/lib/dpkg/status", "Package: a\nStatus: install ok installed\nDepends: libc6 (>= 2), b:any | c\nRecommends: d\n\nPackage: z\nStatus: deinstall ok config-files\nDepends: q\n", [("a", "libc6", None, ">= 2"), ("a", "b", None, None), ("a", "d", "optional", None)]),
    ("/x/lib/apk/db/installed", "P:musl\nD:so:libc.musl busybox>=1 !old\n", [("musl", "busybox", None, None)]),
]


def test_relations(spark):
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t, _ in CASES] + [("/r/package.json", bytearray(b"{")), ("/p/node_modules/x/package.json", bytearray(b'{"dependencies": {"y": "1"}}'))], "path string, content binary")
    got = {}
    for r in R.relations(files).collect():
        got.setdefault(r.path, []).append((r.source, r.target, r.scope, r.requested) if not r.error else r.error.split(":")[0])
    for path, _, want in CASES:
        assert sorted(got[path], key=repr) == sorted(want, key=repr), path
    assert got["/r/package.json"] == ["JSONDecodeError"] and "/p/node_modules/x/package.json" not in got
    marked = {(r.source, r.target): r.marker for r in R.relations(files).where("marker is not null").collect()}
    assert marked == {(None, "A"): "python_version > '3'", (None, "b"): "os == 'x'", (None, "c"): 'extra == "all"', ("a", "c"): 'extra == "x"', ("a", "b"): "m", ("A", "c"): "extra == 'x'"}


def test_scan_to_paths(spark):
    lock = '[[package]]\nname = "%s"\nversion = "%s"\n%s'
    files = [
        ("app/pyproject.toml", '[project]\ndependencies = ["web>=1"]\n[dependency-groups]\ntest = ["checker"]\n'),
        ("app/poetry.lock", lock % ("web", "1.2", '[package.dependencies]\ncore = ">=2"\nextra-tool = {version = "*", markers = "extra == \\"all\\""}\n') + lock % ("core", "2.5", "") + lock % ("extra-tool", "0.1", "") + lock % ("checker", "3.0", '[package.dependencies]\ncore = "*"\n')),
        ("venv/web-1.2.dist-info/METADATA", "Name: web\nVersion: 1.2\n"),
        ("venv/core-2.6.dist-info/METADATA", "Name: core\nVersion: 2.6\n"),
        ("venv/stray-1.dist-info/METADATA", "Name: stray\nVersion: 1\n"),
        ("app/tests/package.json", '{"dependencies": {"only-tests": "1.0.0"}}'),
        ("broken/package.json", "{"),
    ]
    graph = scanned(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary"))
    nodes = {r.name: r for r in graph.components.collect()}
    assert {n: (r.version, r.scope, r.tier_cap) for n, r in nodes.items()} == {"web": ("1.2", "runtime", 4), "core": ("2.6", "runtime", 4), "extra-tool": ("0.1", "optional", 3), "checker": ("3.0", "dev", 3), "stray": ("1", None, 4), "only-tests": ("1.0.0", "runtime", 2)}
    assert nodes["only-tests"].excluded == "fixture-only" and nodes["extra-tool"].conditional and nodes["stray"].confidence == 0.76
    notes = {(nodes_by.name, r.code) for r in graph.annotations.collect() for nodes_by in nodes.values() if nodes_by.id == r.component_id}
    assert notes == {("core", "drift:locked-vs-installed"), ("checker", "drift:declared-not-installed"), ("stray", "drift:installed-not-declared")}
    ways = {tuple(r.path) for r in paths_to_roots(graph.edges, spark.createDataFrame([(nodes["core"].id,)], "id long")).collect()}
    names = {r.id: n for n, r in nodes.items()}
    assert {tuple(names.get(k, ".") for k in w) for w in ways} == {(".", "web", "core"), (".", "checker", "core")}
    table = graph.components.select("id", "name", "version", "purl", "ctype", F.col("tier_cap").cast("int").alias("tier_cap"), "confidence", "excluded", F.create_map(F.lit("ecosystem"), "ecosystem", F.lit("scope"), "scope").alias("attrs"))
    assert {r.name for r in dsl.run(table, "components where ecosystem = pypi and scope = runtime", graph.edges).collect()} == {"web", "core"}
    assert [r.root for r in dsl.run(table, "paths from * to core", graph.edges).collect()] != []
