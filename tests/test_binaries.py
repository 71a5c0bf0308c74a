"""Binary readers on files made by hand, and on this interpreter."""

import json
import sqlite3
import struct
import sys
import zlib

from test_archives_store import zipped

from quillgraph.sources import binaries as B


def elf_file(sections):
    """A 64-bit file with the given sections and a name table."""
    names, at, body, heads = b"\0", 64, b"", [bytes(64)]
    for name, data in [*sections.items(), (".shstrtab", None)]:
        place = len(names)
        names += name.encode() + b"\0"
        data = names if data is None else data
        heads.append(struct.pack("<IIQQQQIIQQ", place, 1, 0, 0, at + len(body), len(data), 0, 0, 1, 0))
        body += data
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, len(heads), len(heads) - 1)
    return head + body + b"".join(heads)


def test_this_interpreter():
    with open(sys.executable, "rb") as f:
        facts = B.elf(f.read())
    assert "libc.so.6" in facts.needed and ".text" in facts.sections


def test_crates():
    packed = zlib.compress(json.dumps({"packages": [{"name": "a", "version": "1"}, {"name": "b", "version": "2", "kind": "build"}]}).encode())
    assert list(B.found_in("x", elf_file({".dep-v0": packed}))) == [("binary/cargo-auditable", "cargo", "a", "1")]


def test_go():
    mods = b"p\tm\nmod\tm\t(devel)\ndep\ta\tv1\th1:x\ndep\tb\tv2\n=>\tc\tv3\th1:y\n"
    text = bytes(16) + mods + bytes(16)
    info = b"\xff Go buildinf:" + b"\x08\x02" + bytes(16) + bytes([8]) + b"go1.22.1" + bytes([len(text)]) + text
    assert B.go_modules(b"xx" + info) == [("stdlib", "1.22.1"), ("m", "(devel)"), ("a", "v1"), ("c", "v3")]


def test_wasm():
    text = lambda s: bytes([len(s)]) + s
    part = lambda kind, body: bytes([kind, len(body)]) + body
    data = b"\0asm\1\0\0\0" + part(2, b"\2" + text(b"env") + text(b"f") + b"\0\0" + text(b"wasi") + text(b"m") + b"\2\1\1\2") + part(7, b"\1" + text(b"run") + b"\0\0") + part(0, text(b"sbom") + b"{}")
    facts = B.wasm(data)
    assert (facts.needed, facts.symbols, facts.sections) == (["env", "wasi"], ["run"], {"sbom": b"{}"})


def test_macho():
    name = b"/usr/lib/libz.dylib\0" + bytes(4)
    data = b"\xcf\xfa\xed\xfe" + struct.pack("<IIIIIII", 7, 3, 6, 2, 0, 0, 0) + struct.pack("<IIIIII", 0xC, 24 + len(name), 24, 0, 0, 0) + name + struct.pack("<II", 0x1B, 24) + bytes(range(16))
    facts = B.macho(data)
    assert facts.needed == ["/usr/lib/libz.dylib"] and facts.build_id == bytes(range(16)).hex()


def test_pe():
    base = 64 + 24 + 240
    optional = struct.pack("<H", 0x20B) + bytes(110) + struct.pack("<QII", 0, 0x1000, 40) + bytes(112)
    section = struct.pack("<8sIIII16x", b".idata", 0x200, 0x1000, 0x200, 0x200)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, 240, 0) + optional + section
    assert len(optional) == 240 and len(head) == base + 40
    body = struct.pack("<IIIII", 0, 0, 0, 0x1000 + 60, 0) + bytes(40) + b"KERNEL32.dll\0"
    facts = B.pe(head.ljust(0x200, b"\0") + body.ljust(0x200, b"\0"))
    assert facts.needed == ["KERNEL32.dll"] and ".idata" in facts.sections


def test_models():
    head = json.dumps({"__metadata__": {"name": "m"}, "w": {}}).encode()
    assert B.safetensors(struct.pack("<Q", len(head)) + head) == {"name": "m", "tensors": "1"}
    text = lambda s: struct.pack("<Q", len(s)) + s
    data = b"GGUF" + struct.pack("<IQQ", 3, 5, 3) + text(b"general.name") + struct.pack("<I", 8) + text(b"mm") + text(b"l") + struct.pack("<IIQ", 9, 8, 1) + text(b"x") + text(b"n") + struct.pack("<If", 6, 0.5)
    assert B.gguf(data) == {"version": "3", "tensors": "5", "general.name": "mm", "n": "0.5"}


def rpm_blob(name, version, release, epoch):
    store, rows = b"", []
    for tag, value in ((1000, name), (1001, version), (1002, release)):
        rows.append((tag, 6, len(store), 1))
        store += value.encode() + b"\0"
    store += bytes(-len(store) % 4)
    rows.append((1003, 4, len(store), 1))
    store += struct.pack(">I", epoch)
    return struct.pack(">II", len(rows), len(store)) + b"".join(struct.pack(">IIII", *r) for r in rows) + store


def test_detect(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE Packages (hnum INTEGER, blob BLOB)")
    con.executemany("INSERT INTO Packages VALUES (?, ?)", [(1, rpm_blob("zlib", "1.3", "2", 1)), (2, rpm_blob("gpg-pubkey", "x", "y", 0))])
    con.commit()
    files = [
        ("var/lib/rpm/rpmdb.sqlite", con.serialize()),
        ("a.jar", zipped({"META-INF/maven/g/a/pom.properties": "groupId=g\nartifactId=a\nversion=1\n"})),
        ("b.war", zipped({"META-INF/MANIFEST.MF": "Implementation-Title: some\n  thing\nImplementation-Version: 2\n"})),
        ("bad", b"\x7fELF"),
        ("text", b"hello"),
    ]
    frame = spark.createDataFrame([(p, bytearray(d)) for p, d in files], "path string, content binary")
    got = {(r.path, r.name, r.version, bool(r.error)) for r in B.detect(frame).collect()}
    assert got == {("var/lib/rpm/rpmdb.sqlite", "zlib", "1:1.3-2", False), ("a.jar", "g:a", "1", False), ("b.war", "some thing", "2", False), ("bad", None, None, True)}
    assert B.marks(frame).count() == 0
