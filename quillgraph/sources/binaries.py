"""Facts inside binary files: libraries they load, packages they were built from, models, package databases.

First bytes are compared in the JVM, so only files of a known format reach Python. A file
that can't be read is a row with its error.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.lockfiles import FINDINGS

#: First bytes.
MAGIC = {"elf": (b"\x7fELF",), "pe": (b"MZ",), "wasm": (b"\0asm",), "macho": (b"\xcf\xfa\xed\xfe", b"\xce\xfa\xed\xfe"), "zip": (b"PK\x03\x04",), "gguf": (b"GGUF",), "sqlite": (b"SQLite format 3\0",)}


class Facts(NamedTuple):
    kind: str
    needed: list[str]
    symbols: list[str]
    build_id: str | None
    sections: dict[str, bytes]


def kind_of(data: bytes) -> str | None:
    return next((k for k, marks in MAGIC.items() if data.startswith(marks)), None)


def _string(data: bytes, at: int) -> str:
    return data[at : data.index(b"\0", at)].decode("utf-8", "replace")


def elf(data: bytes) -> Facts:
    """Either word size and byte order: sections by name, DT_NEEDED, defined dynamic symbols, the build id."""
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    table, = struct.unpack_from(order + ("Q" if wide else "I"), data, 40 if wide else 32)
    size, count, names_at = struct.unpack_from(order + "HHH", data, 58 if wide else 46)
    layout = order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII")
    heads = [struct.unpack_from(layout, data, table + k * size) for k in range(count)]
    body = lambda h: b"" if h[1] == 8 else data[h[4] : h[4] + h[5]]
    names = body(heads[names_at]) if heads else b""
    sections = {_string(names, h[0]): body(h) for h in heads if h[0] < len(names)}
    needed: list[str] = []
    symbols: list[str] = []
    for h in heads:
        if h[1] == 6:
            words = body(heads[h[6]])
            needed += [_string(words, v) for t, v in struct.iter_unpack(order + ("qQ" if wide else "iI"), body(h)[: len(body(h)) // (16 if wide else 8) * (16 if wide else 8)]) if t == 1]
        elif h[1] == 11:
            words = body(heads[h[6]])
            rows = struct.iter_unpack(order + ("IBBHQQ" if wide else "IIIBBH"), body(h))
            symbols += [_string(words, r[0]) for r in rows if r[0] and (r[3] if wide else r[5])]
    note = sections.get(".note.gnu.build-id", b"")
    return Facts("elf", needed, symbols, note[16:].hex() or None, sections)


def pe(data: bytes) -> Facts:
    """Names of imported libraries and sections."""
    at, = struct.unpack_from("<I", data, 60)
    if data[at : at + 4] != b"PE\0\0":
        raise ValueError("no PE header")
    n, optional = struct.unpack_from("<xxH12xH", data, at + 4)
    wide = struct.unpack_from("<H", data, at + 24)[0] == 0x20B
    heads = [struct.unpack_from("<8sIIII", data, at + 24 + optional + 40 * k) for k in range(n)]
    sections = {h[0].rstrip(b"\0").decode("latin-1"): data[h[4] : h[4] + h[3]] for h in heads}

    def place(address: int) -> int:
        return next((address - h[2] + h[4] for h in heads if h[2] <= address < h[2] + max(h[1], h[3])), -1)

    imports, = struct.unpack_from("<I", data, at + 24 + (120 if wide else 104))
    needed, row = [], place(imports) if imports else -1
    while row >= 0 and (name := struct.unpack_from("<12xI4x", data, row)[0]):
        needed.append(_string(data, place(name)))
        row += 20
    return Facts("pe", needed, [], None, sections)


def macho(data: bytes) -> Facts:
    """Libraries and the unique id that load commands name."""
    wide = data[0] == 0xCF
    count, = struct.unpack_from("<I", data, 16)
    at, needed, unique = 32 if wide else 28, [], None
    for _ in range(count):
        command, size = struct.unpack_from("<II", data, at)
        if command & 0x7FFFFFFF in (0xC, 0x18, 0x1F):
            needed.append(_string(data, at + struct.unpack_from("<I", data, at + 8)[0]))
        elif command == 0x1B:
            unique = data[at + 8 : at + 24].hex()
        at += size
    return Facts("macho", needed, [], unique, {})


def _leb(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def wasm(data: bytes) -> Facts:
    """Modules that are imported from, exported names, custom sections."""
    at, needed, symbols, sections = 8, [], [], {}

    def text(at: int) -> tuple[str, int]:
        n, at = _leb(data, at)
        return data[at : at + n].decode("utf-8", "replace"), at + n

    def limits(at: int) -> int:
        flag, at = _leb(data, at)
        for _ in range(2 if flag & 1 else 1):
            _, at = _leb(data, at)
        return at

    while at < len(data):
        kind = data[at]
        size, begin = _leb(data, at + 1)
        at = begin + size
        if kind == 0:
            name, inner = text(begin)
            sections[name] = data[inner:at]
        elif kind in (2, 7):
            n, k = _leb(data, begin)
            for _ in range(n):
                first, k = text(k)
                if kind == 7:
                    symbols.append(first)
                    _, k = _leb(data, k + 1)
                    continue
                needed.append(first)
                _, k = text(k)
                what = data[k]
                k = limits(k + 2) if what == 1 else limits(k + 1) if what == 2 else k + 3 if what == 3 else _leb(data, k + 1)[1]
    return Facts("wasm", sorted(set(needed)), symbols, None, sections)


READERS: dict[str, Callable[[bytes], Facts]] = {"elf": elf, "pe": pe, "macho": macho, "wasm": wasm}


def go_modules(data: bytes) -> list[tuple[str, str | None]]:
    """The toolchain and modules that a Go build records inline; a replaced module counts as its replacement."""
    at = data.find(b"\xff Go buildinf:")
    if at < 0 or not data[at + 15] & 2:
        return []
    texts, k = [], at + 32
    for _ in range(2):
        n, k = _leb(data, k)
        texts.append(data[k : k + n])
        k += n
    out: list[tuple[str, str | None]] = [("stdlib", texts[0].decode().removeprefix("go"))]
    for line in texts[1][16:-16].decode("utf-8", "replace").splitlines():
        word, *rest = line.split("\t")
        if word in ("dep", "mod") and len(rest) >= 2:
            out.append((rest[0], rest[1]))
        elif word == "=>" and len(out) > 1:
            out[-1] = (rest[0], rest[1])
    return out


def auditable_crates(facts: Facts) -> list[tuple[str, str | None]]:
    packed = facts.sections.get(".dep-v0")
    found = json.loads(zlib.decompress(packed))["packages"] if packed else []
    return [(p["name"], p.get("version")) for p in found if p.get("kind", "runtime") == "runtime"]


def jar(data: bytes) -> list[tuple[str, str | None]]:
    """Maven coordinates that an archive carries; without any, its manifest's title and version."""
    out: list[tuple[str, str | None]] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if re.fullmatch(r"META-INF/maven/[^/]+/[^/]+/pom\.properties", name):
                f = dict(re.findall(r"^(\w+)\s*=\s*(.*?)\s*$", z.read(name).decode("utf-8", "replace"), re.M))
                out.append((f"{f.get('groupId')}:{f.get('artifactId')}", f.get("version")))
        if not out and "META-INF/MANIFEST.MF" in z.namelist():
            text = re.sub(r"\r?\n ", "", z.read("META-INF/MANIFEST.MF").decode("utf-8", "replace"))
            f = dict(re.findall(r"^([\w-]+):\s*(.*?)\s*$", text, re.M))
            title = f.get("Bundle-SymbolicName", f.get("Implementation-Title", "")).split(";")[0]
            out += [(title, f.get("Bundle-Version") or f.get("Implementation-Version"))] if title else []
    return out


def safetensors(data: bytes) -> dict[str, str]:
    size, = struct.unpack_from("<Q", data)
    head = json.loads(data[8 : 8 + size])
    return {**{k: str(v) for k, v in (head.get("__metadata__") or {}).items()}, "tensors": str(len([k for k in head if k != "__metadata__"]))}


#: Sizes of the scalar types of a model header.
_SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


def gguf(data: bytes) -> dict[str, str]:
    """The scalar and text fields of a model header; arrays are stepped over."""
    version, tensors, fields = struct.unpack_from("<IQQ", data, 4)
    at, out = 24, {"version": str(version), "tensors": str(tensors)}

    def value(kind: int) -> object:
        nonlocal at
        if kind == 8:
            n, = struct.unpack_from("<Q", data, at)
            at += 8 + n
            return data[at - n : at].decode("utf-8", "replace")
        if kind == 9:
            inner, n = struct.unpack_from("<IQ", data, at)
            at += 12
            if inner in _SCALARS:
                at += n * struct.calcsize("<" + _SCALARS[inner])
            else:
                for _ in range(n):
                    value(inner)
            return None
        found, = struct.unpack_from("<" + _SCALARS[kind], data, at)
        at += struct.calcsize("<" + _SCALARS[kind])
        return found

    for _ in range(fields):
        key = value(8)
        kind, = struct.unpack_from("<I", data, at)
        at += 4
        found = value(kind)
        if found is not None:
            out[str(key)] = str(found)
    return out


def rpm_header(blob: bytes) -> dict[int, object]:
    """Texts and 32-bit numbers of a package header by tag."""
    n, size = struct.unpack_from(">II", blob)
    store, out = blob[8 + 16 * n : 8 + 16 * n + size], {}
    for tag, kind, at, _ in struct.iter_unpack(">IIII", blob[8 : 8 + 16 * n]):
        if kind in (6, 8, 9):
            out[tag] = _string(store, at)
        elif kind == 4:
            out[tag] = struct.unpack_from(">I", store, at)[0]
    return out


def rpm_packages(data: bytes) -> list[tuple[str, str | None]]:
    """Packages of an SQLite database of headers, versions as epoch:version-release."""
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(data)
        heads = [rpm_header(b) for (b,) in con.execute("SELECT blob FROM Packages")]
    finally:
        con.close()
    return [(h[1000], (f"{h[1003]}:" if h.get(1003) else "") + f"{h.get(1001)}-{h.get(1002)}") for h in heads if 1000 in h and h[1000] != "gpg-pubkey"]


def model_row(path: str, facts: dict[str, str]) -> list[tuple[str, str | None]]:
    name = facts.get("general.name") or facts.get("name") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return [(name, facts.get("general.version") or facts.get("version_name"))]


def found_in(path: str, data: bytes) -> Iterator[tuple[str, str, str, str | None]]:
    """(detector, package type, name, version) of all that one file holds."""
    kind = kind_of(data[:16])
    if kind in READERS:
        facts = READERS[kind](data)
        yield from (("go/binary", "golang", n, v) for n, v in go_modules(data))
        yield from (("binary/cargo-auditable", "cargo", n, v) for n, v in auditable_crates(facts))
        yield from (("binary/native", "generic", n, None) for n in facts.needed)
    elif kind == "zip" and path.endswith((".jar", ".war", ".ear")):
        yield from (("jvm/jar", "maven", n, v) for n, v in jar(data))
    elif kind == "gguf":
        yield from (("ml/model", "generic", n, v) for n, v in model_row(path, gguf(data)))
    elif kind == "sqlite" and path.endswith("rpmdb.sqlite"):
        yield from (("os/rpm", "rpm", n, v) for n, v in rpm_packages(data))
    elif path.endswith(".safetensors"):
        yield from (("ml/model", "generic", n, v) for n, v in model_row(path, safetensors(data)))


def detect(files: DataFrame) -> DataFrame:
    """Findings of the binary files among ``files`` (path, content), installed tier but for loaded libraries (inferred)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content, digest in zip(frame["path"], frame["content"], frame["sha256"], strict=True):
                try:
                    rows += [(path, d, p, n, v, 1 if d == "binary/native" else 4, digest, None) for d, p, n, v in found_in(path, bytes(content))]
                except Exception as e:  # one bad file is a gap, not a failed scan
                    rows.append((path, "binary", None, None, None, 4, digest, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    known = F.col("path").endswith(".safetensors")
    for marks in MAGIC.values():
        for m in marks:
            known = known | (F.substring("content", 1, len(m)) == F.lit(m))
    return files.where(known).select("path", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(run, FINDINGS)


def marks(files: DataFrame) -> DataFrame:
    """(subject, mark): the dynamic symbols of each binary, as votes for libraries count them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                data = bytes(content)
                try:
                    symbols = READERS[kind_of(data[:16])](data).symbols
                except (ValueError, IndexError, struct.error):
                    symbols = []
                yield pd.DataFrame({"subject": [path] * len(symbols), "mark": symbols}).astype({"subject": object, "mark": object})

    some = F.lit(False)
    for m in (m for k in READERS for m in MAGIC[k]):
        some = some | (F.substring("content", 1, len(m)) == F.lit(m))
    return files.where(some).select("path", "content").mapInPandas(run, "subject string, mark string")
