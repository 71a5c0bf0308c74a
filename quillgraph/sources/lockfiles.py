"""Lockfiles by declaration: a spec names where packages lie in a document and which fields they have.

Files are read with Spark's binary reader, matched by name in an equi-join key plus a
residual pattern, and parsed in Arrow batches; a file that fails becomes a row with its
error and stops nothing.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.scratch import shuffle_partitions

FINDINGS = "path string, detector string, ptype string, name string, version string, tier int, sha256 string, error string"


@dataclass(frozen=True)
class Spec:
    detector: str
    match: str
    format: str
    path: str
    ptype: str
    name: str
    version: str
    tier: int = 3


#: Files, the place of their packages, and the fields of name and version.
SPECS = [
    Spec("dart/pubspec-lock", "pubspec.lock", "yaml", "$.packages.*", "pub", "@key", "version"),
    Spec("rust/cargo-lock", "Cargo.lock", "toml", "$.package[*]", "cargo", "name", "version"),
    Spec("r/renv-lock", "renv.lock", "json", "$.Packages.*", "cran", "Package", "Version"),
    Spec("julia/manifest-toml", "Manifest.toml", "toml", "$.deps.*[*]", "julia", "@key", "version"),
    Spec("nim/nimble-lock", "nimble.lock", "json", "$.packages.*", "nimble", "@key", "version"),
    Spec("crystal/shard-lock", "shard.lock", "yaml", "$.shards.*", "shards", "@key", "version"),
    Spec("conda/conda-meta", "*conda-meta/*.json", "json", "$", "conda", "name", "version", 4),
    Spec("python/pdm-lock", "pdm.lock", "toml", "$.package[*]", "pypi", "name", "version"),
    Spec("nix/flake-lock", "flake.lock", "json", "$.nodes.*", "nix", "@key", "locked.rev"),
    Spec("unity/packages-manifest", "*Packages/manifest.json", "json", "$.dependencies.*", "unity", "@key", "@value", 2),
    Spec("os/snap", "*meta/snap.yaml", "yaml", "$", "snap", "name", "version", 4),
]


def load(content: bytes, kind: str) -> object:
    if kind == "json":
        return json.loads(content)
    if kind == "toml":
        import tomllib

        return tomllib.loads(content.decode())
    from quillgraph.sources.grammars_locks import parsed_yaml

    return parsed_yaml(content)


def walk(doc: object, path: str, key: str | None = None) -> Iterator[tuple[str | None, object]]:
    """(key, node) of each node that a path of ``.name``, ``.*`` and ``[*]`` reaches."""
    if path in ("", "$"):
        yield key, doc
        return
    rest = path.removeprefix("$")
    if rest.startswith("[*]"):
        for node in doc if isinstance(doc, list) else ():
            yield from walk(node, "$" + rest[3:], key)
        return
    name, cut = "", 1
    while cut < len(rest) and rest[cut] not in ".[":
        name += rest[cut]
        cut += 1
    if isinstance(doc, dict):
        for k, node in doc.items():
            if name in ("*", k):
                yield from walk(node, "$" + rest[cut:], str(k) if name == "*" else key)


def field(key: str | None, node: object, name: str) -> str | None:
    if name == "@key":
        return key
    for part in [] if name == "@value" else name.split("."):
        node = node.get(part) if isinstance(node, dict) else None
    return node if isinstance(node, str) else None if node is None or isinstance(node, dict | list) else str(node)


def packages(spec: Spec, content: bytes) -> list[tuple[str, str | None]]:
    found = ((field(k, n, spec.name), field(k, n, spec.version)) for k, n in walk(load(content, spec.format), spec.path))
    return [(a, b) for a, b in found if a]


def matches(spec: Spec, path: str) -> bool:
    return fnmatch.fnmatchcase(path, spec.match) if "/" in spec.match else fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], spec.match)


def dealt(files: DataFrame, key: str = "path") -> DataFrame:
    """The files over all tasks by path, or other rows by a key: reading is work for the processor, which the files' bytes don't tell, so few small partitions won't do."""
    spark = files.sparkSession
    return files.repartition(max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism), key)


#: Rows of a batch that is handed back; what a task holds doesn't grow with its files.
ROWS = 20_000


def batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of at most ROWS; a text column's other values become text."""
    fields = [c.split() for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[kind] for _, kind in fields]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = []
        for values, kind in zip(zip(*held, strict=True), kinds, strict=True):
            columns.append(pa.array([v if v is None or isinstance(v, str) else str(v) for v in values] if kind == pa.string() else values, kind))
        return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def each(frames: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches one at a time."""
    for frame in frames:
        at = [frame.schema.get_field_index(c) for c in columns]
        for k in range(frame.num_rows):
            yield tuple(frame.column(i)[k].as_py() for i in at)


def detect(files: DataFrame, specs: list[Spec] = SPECS) -> DataFrame:
    """Findings of the files (path, content) that a spec matches; rows with error instead of a name where one can't be read."""

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, content, digest in each(frames, "path", "content", "sha256"):
            for spec in specs:
                if not matches(spec, path):
                    continue
                try:
                    rows = [(n, v) for n, v in packages(spec, content)]
                except Exception as e:  # one bad file is a gap, not a failed scan
                    yield path, spec.detector, spec.ptype, None, None, spec.tier, digest, f"{type(e).__name__}: {e}"
                    continue
                for n, v in rows:
                    yield path, spec.detector, spec.ptype, n, v, spec.tier, digest, None

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(found(frames), FINDINGS)

    names = F.element_at(F.split("path", "/"), -1)
    patterns = "|".join(fnmatch.translate(s.match.rsplit("/", 1)[-1]) for s in specs)
    return dealt(files.where(names.rlike(patterns)).select("path", "content")).select("path", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(run, FINDINGS)


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content, role) of the files under a folder."""
    from quillgraph.functions.text import path_role

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", "content", path_role(F.col("path")).alias("role"))
