"""Archives as tables: members of zip, tar, ar, and cpio files, nested ones too, within a budget.

Files come in Arrow batches, members leave as rows; an archive that breaks its budget or
can't be read gives a row with its error beside the members read so far.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import re
import tarfile
import unicodedata
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First bytes of the formats.
MAGIC = {"zip": b"PK\x03\x04", "gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd", "ar": b"!<arch>\n", "cpio": b"070701"}
MEMBERS = "archive string, path string, depth int, size long, content binary, error string"


@dataclass
class Budget:
    """What one outermost archive may unfold to."""

    depth: int = 4
    members: int = 200_000
    total: int = 4 << 30
    member: int = 1 << 30
    used: list[int] = field(default_factory=lambda: [0, 0])

    def take(self, size: int) -> None:
        self.used[0] += 1
        self.used[1] += size
        if self.used[0] > self.members:
            raise ValueError("more members than the budget allows")
        if self.used[1] > self.total or size > self.member:
            raise ValueError("more bytes than the budget allows")


def kind_of(head: bytes) -> str | None:
    """The archive format of a file by its first 262 bytes or more."""
    for kind, magic in MAGIC.items():
        if head.startswith(magic):
            return kind
    return "tar" if head[257:262] == b"ustar" else None


def kind_column(content: Column) -> Column:
    """The same within Spark's own functions, for filters before any content leaves the JVM."""
    out = F.when(F.substring(content, 258, 5) == F.lit(b"ustar"), "tar")
    for kind, magic in MAGIC.items():
        out = out.when(F.substring(content, 1, len(magic)) == F.lit(magic), kind)
    return out


def safe_path(raw: str) -> str | None:
    """A member's path in NFC without ``.``; None for one that leaves the archive."""
    path = unicodedata.normalize("NFC", raw.replace("\\", "/"))
    if path.startswith("/") or re.match(r"[A-Za-z]:", path) or ".." in path.split("/"):
        return None
    clean = posixpath.normpath(path)
    return None if clean in (".", "") else clean


def _bounded(stream: io.BufferedIOBase, most: int) -> bytes:
    data = stream.read(most + 1)
    if len(data) > most:
        raise ValueError("more bytes than the budget allows")
    return data


def _decompressed(data: bytes, kind: str, most: int) -> bytes:
    if kind == "zstd":
        import zstandard

        return _bounded(zstandard.ZstdDecompressor().stream_reader(data), most)
    opener = {"gzip": gzip.GzipFile, "bzip2": bz2.BZ2File, "xz": lzma.LZMAFile}[kind]
    return _bounded(opener(io.BytesIO(data)) if kind != "gzip" else opener(fileobj=io.BytesIO(data)), most)


def _ar(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 8
    while at + 60 <= len(data):
        name, size = data[at : at + 16].decode("ascii", "replace").strip().rstrip("/"), int(data[at + 48 : at + 58])
        yield name, data[at + 60 : at + 60 + size]
        at += 60 + size + size % 2


def _cpio(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while data[at : at + 6] in (b"070701", b"070702"):
        fields = [int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16) for k in range(13)]
        mode, size, length = fields[1], fields[6], fields[11]
        name = data[at + 110 : at + 110 + length - 1].decode("utf-8", "replace")
        begin = (at + 110 + length + 3) // 4 * 4
        if name == "TRAILER!!!":
            return
        if mode & 0o170000 == 0o100000:
            yield name, data[begin : begin + size]
        at = (begin + size + 3) // 4 * 4


def members(data: bytes, budget: Budget) -> Iterator[tuple[str, bytes]]:
    """(raw path, content) of an archive's plain files."""
    kind = kind_of(data)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    with z.open(info) as f:
                        yield info.filename, _bounded(f, budget.member)
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isreg():
                    if info.size > budget.member:
                        raise ValueError("more bytes than the budget allows")
                    yield info.name, t.extractfile(info).read()
    elif kind in ("gzip", "bzip2", "xz", "zstd"):
        inner = _decompressed(data, kind, budget.total)
        if kind_of(inner):
            yield from members(inner, budget)
        else:
            yield "content", inner
    elif kind == "ar":
        yield from _ar(data)
    elif kind == "cpio":
        yield from _cpio(data)


def unfolded(path: str, data: bytes, budget: Budget | None = None, depth: int = 1) -> Iterator[tuple]:
    """Rows of MEMBERS for an archive and the archives in it; a nested path is parted by ``!/``."""
    budget = budget or Budget()
    try:
        for raw, content in members(data, budget):
            name = safe_path(raw)
            if name is None:
                yield path, raw, depth, len(content), None, "path leaves the archive"
                continue
            budget.take(len(content))
            yield path, name, depth, len(content), content, None
            if kind_of(content[:300]):
                if depth >= budget.depth:
                    yield path, name, depth, len(content), None, "nested deeper than the budget allows"
                else:
                    yield from unfolded(f"{path}!/{name}", content, budget, depth + 1)
    except (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, NotImplementedError, RuntimeError) as e:
        yield path, None, depth, None, None, f"{type(e).__name__}: {e}"


def exploded(files: DataFrame, depth: int = 4, most_members: int = 200_000, most_bytes: int = 4 << 30, member_bytes: int = 1 << 30, rows_at_once: int = 64) -> DataFrame:
    """MEMBERS of the archives among ``files`` (path, content); other files have none.

    The budget holds for each file of the table. Members leave the task in small batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for row in unfolded(path, bytes(content), Budget(depth, most_members, most_bytes, member_bytes)):
                    rows.append(row)
                    if len(rows) >= rows_at_once:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.where(kind_column(F.col("content")).isNotNull()).select("path", "content").mapInPandas(run, MEMBERS)


def scanned(files: DataFrame, **budget: int) -> DataFrame:
    """The files themselves and all members of the archives among them, as (path, content) for the detectors."""
    inner = exploded(files, **budget).where("error is null").select(F.concat_ws("!/", "archive", "path").alias("path"), "content")
    return files.select("path", "content").unionByName(inner)
