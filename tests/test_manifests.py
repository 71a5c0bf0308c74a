"""Text grammars on small files."""

import pytest

from quillgraph.sources import manifests as M
from quillgraph.sources import plugins

CASES = [
    ("/x/var/lib/dpkg/status", "Package: a\nStatus: install ok installed\nVersion: 1:2-3\nDescription: x\n y\n\nPackage: b\nStatus: deinstall ok config-files\n", [("a", "1:2-3")]),
    ("/x/lib/apk/db/installed", "P:musl\nV:1.2\n\nP:zlib\nV:1.3\n", [("musl", "1.2"), ("zlib", "1.3")]),
    ("/s/a.dist-info/METADATA", "Name: a\nVersion: 2\n\nName: not this\n", [("a", "2")]),
    ("/p/requirements-dev.txt", "# c\nA[x]==1.0 ; python_version > '3'\nb>=2 # why\n-r other\nc \\\n == 3\n", [("A", "1.0"), ("b", None), ("c", "3")]),
    ("/p/go.mod", "module m\nrequire x/y v1.0.0\nrequire (\n\ta/b v2.0.0 // indirect\n)\n", [("a/b", "v2.0.0"), ("x/y", "v1.0.0")]),
    ("/p/go.sum", "a v1 h1:x=\na v1/go.mod h1:y=\n", [("a", "v1")]),
    ("/p/Gemfile.lock", "GEM\n  specs:\n    rack (2.0)\n      dep (>= 1)\n", [("rack", "2.0")]),
    ("/p/yarn.lock", '"@a/b@^1.0":\n  version "1.2"\n\nc@2:\n  version "2.1"\n', [("@a/b", "1.2"), ("c", "2.1")]),
    ("/p/package-lock.json", '{"packages": {"": {}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/@s/b": {"version": "2"}}}', [("a", "1"), ("@s/b", "2")]),
    ("/p/package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}', [("a", "^1"), ("b", "2")]),
    ("/p/pom.xml", "<project><properties><v>3</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>", [("g:a", "3")]),
    ("/p/gradle.lockfile", "# c\ng:a:1.0=compile\nempty=\n", [("g:a", "1.0")]),
    ("/p/mix.lock", '%{"a": {:hex, :a, "1.0", "h"}}', [("a", "1.0")]),
    ("/p/poetry.lock", '[[package]]\nname = "a"\nversion = "1"\n', [("a", "1")]),
    ("/p/composer.lock", '{"packages": [{"name": "v/a", "version": "1"}]}', [("v/a", "1")]),
    ("/p/Pipfile.lock", '{"default": {"a": {"version": "==1"}}}', [("a", "1")]),
]


def test_grammars(spark):
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t, _ in CASES] + [("/q/package.json", bytearray(b"{")), ("/q/readme", bytearray(b""))], "path string, content binary")
    got = {}
    for r in M.detect(files).collect():
        got.setdefault(r.path, []).append((r.name, r.version) if not r.error else r.error.split(":")[0])
    for path, _, want in CASES:
        assert sorted(got[path], key=repr) == sorted(want, key=repr), path
    assert got["/q/package.json"] == ["JSONDecodeError"] and "/q/readme" not in got


@pytest.mark.parametrize("name, confidence, error", [("a", 0.99, None), ("", 0.5, "no name"), ("b" * 600, 0.5, "name too long"), ("c", 1.5, "confidence out of range")])
def test_plugins(spark, name, confidence, error):
    rows = spark.createDataFrame([("p", "d", "binary", name, "1", confidence, "s" * 5000)], "path string, detector string, technique string, name string, version string, confidence double, snippet string")
    r = plugins.checked(rows, "ns").first()
    assert (r.error, r.detector, len(r.snippet)) == (error, "plugin:ns/d", 4096) and r.confidence <= 0.7


def test_registration(spark):
    own = [("own/list", "*.list", "x", 2, lambda text: [(n, None) for n in text.split()]), ("js/package-json", "package.json", "npm", 2, lambda text: [("never", None)])]
    grammars = M.registered(M.GRAMMARS, own)
    assert len(grammars) == len(M.registered(M.GRAMMARS)) + 1
    files = spark.createDataFrame([("a.list", bytearray(b"p q")), ("package.json", bytearray(b'{"dependencies": {"a": "1"}}'))], "path string, content binary")
    assert sorted((r.detector, r.name) for r in M.detect(files, grammars).collect()) == [("js/package-json", "a"), ("own/list", "p"), ("own/list", "q")]
