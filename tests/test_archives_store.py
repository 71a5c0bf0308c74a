"""Archives and the run store on hand-made files."""

import gzip
import io
import tarfile
import zipfile

import pytest

from quillgraph.sources import archives as A
from quillgraph.sources import manifests
from quillgraph.sources.store import VERSION, Store, imported, numbered


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_nested(spark):
    inner = zipped({"go.sum": b"a v1 h1:x=\n"})
    outer = gzip.compress(tarred({"./x/in.zip": inner, "../evil": b"1"}))
    ar = b"!<arch>\n" + b"f.txt/          " + b"0           0     0     100644  3         `\nabc\n"
    files = spark.createDataFrame([("o.tgz", bytearray(outer)), ("p.deb", bytearray(ar)), ("plain", bytearray(b"x")), ("bad.zip", bytearray(b"PK\x03\x04xx"))], "path string, content binary")
    got = {(r.archive, r.path, r.depth, r.error) for r in A.exploded(files).collect()}
    assert {x for x in got if x[0] != "bad.zip"} == {("o.tgz", "x/in.zip", 1, None), ("o.tgz!/x/in.zip", "go.sum", 2, None), ("o.tgz", "../evil", 1, "path leaves the archive"), ("p.deb", "f.txt", 1, None)}
    assert [x[3].split(":")[0] for x in got if x[0] == "bad.zip"] == ["BadZipFile"]
    found = manifests.detect(A.scanned(files))
    assert [(r.path, r.name) for r in found.collect()] == [("o.tgz!/x/in.zip!/go.sum", "a")]


@pytest.mark.parametrize("budget, error", [(A.Budget(members=1), "members"), (A.Budget(total=5), "bytes"), (A.Budget(member=2), "bytes"), (A.Budget(depth=1), "nested")])
def test_budget(budget, error):
    rows = list(A.unfolded("a", zipped({"a": b"123", "b": zipped({"c": b"1"})}), budget))
    assert error in rows[-1][-1]


@pytest.mark.parametrize("raw, path", [("a/./b", "a/b"), ("/a", None), ("a/../b", None), ("C:\\x", None), ("a\\b", "a/b"), (".", None)])
def test_paths(raw, path):
    assert A.safe_path(raw) == path


def test_cpio():
    def entry(name, data, mode=0o100644):
        raw = name.encode() + b"\0"
        head = b"070701" + b"".join(b"%08x" % x for x in (1, mode, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(raw), 0)) + raw
        return head + b"\0" * (-len(head) % 4) + data + b"\0" * (-len(data) % 4)

    assert list(A.members(entry("d", b"", 0o40755) + entry("d/f", b"abcde") + entry("TRAILER!!!", b""), A.Budget())) == [("d/f", b"abcde")]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "run")).create()
    c = spark.createDataFrame([(1, "a", {"x": "1", "y": "2"}), (2, "b", {})], "id long, name string, attrs map<string,string>")
    s.upsert("components", c)
    s.update_attrs(spark.createDataFrame([(1, {"x": None, "z": "3"})], "id long, attrs map<string,string>"))
    s.set_meta("serial", "one")
    s.set_meta("serial", "two")
    for _ in range(2):
        s.insert_missing("projects", spark.createDataFrame([("p", "n"), ("p", "n")], "path string, name string"), ["path"])
    s.add_corrections(spark.createDataFrame([("fp", "a"), ("fp", "b"), ("fp", "b")], "kind string, ref string"))
    assert {r.id: r.attrs for r in s.table("components").collect()} == {1: {"y": "2", "z": "3"}, 2: {}}
    assert s.get_meta("serial") == "two" and s.get_meta("none") is None and s.table("projects").count() == 1
    s.remove_corrections(spark.createDataFrame([("fp", "a"), ("fp", "never")], "kind string, ref string"))
    assert [r.ref for r in s.table("corrections").collect()] == ["b"]
    s.add_corrections(spark.createDataFrame([("fp", "a")], "kind string, ref string"))
    assert sorted(r.ref for r in s.table("corrections").collect()) == ["a", "b"]
    s.export(str(tmp_path / "json"))
    again = imported(spark, str(tmp_path / "json"), str(tmp_path / "again"))
    for name in ("components", "meta", "projects", "corrections"):
        key = lambda t: sorted(map(repr, t.collect()))
        assert key(again.table(name)) == key(s.table(name))
    spark.createDataFrame([("schema_version", "9", 1)], "key string, value string, seq long").write.json(str(tmp_path / "other/meta"))
    with pytest.raises(ValueError):
        imported(spark, str(tmp_path / "other"), str(tmp_path / "no"))


def test_numbers(spark):
    rows = spark.createDataFrame([(f"n{k:03}",) for k in range(100)], "name string").repartition(7)
    assert sorted((r.id, r.name) for r in numbered(rows, "name").collect()) == [(k + 1, f"n{k:03}") for k in range(100)]


def test_versions(spark, tmp_path):
    old = Store(spark, str(tmp_path / "old")).create()
    old.set_meta("schema_version", "1")
    assert old.open().get_meta("schema_version") == str(VERSION)
    old.set_meta("schema_version", str(VERSION + 1))
    with pytest.raises(ValueError):
        old.open()
