"""Manifests in text grammars: one function a grammar, from a file's text to (name, version, scope) rows.

``detect`` runs them beside the declared lockfiles: Arrow batches of files in, findings
out, a file that fails kept as a row with its error.
"""

from __future__ import annotations

import fnmatch
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources import grammars_declared, grammars_infra, grammars_locks
from quillgraph.sources.lockfiles import FINDINGS, batches, dealt, each

Row = tuple[str, str | None]


def stanzas(text: str) -> Iterator[dict[str, str]]:
    """Fields of blocks that blank lines part; a line that begins with a blank continues the one before."""
    for block in re.split(r"\n\s*\n", text):
        fields: dict[str, str] = {}
        last = ""
        for line in block.splitlines():
            if line[:1] in " \t" and last:
                fields[last] += "\n" + line.strip()
            elif ":" in line:
                last, _, value = line.partition(":")
                fields[last] = value.strip()
        if fields:
            yield fields


def dpkg(text: str) -> list[Row]:
    return [(s["Package"], s.get("Version")) for s in stanzas(text) if "Package" in s and not s.get("Status", "installed").startswith("deinstall")]


def apk(text: str) -> list[Row]:
    return [(s["P"], s.get("V")) for s in stanzas(text) if "P" in s]


def dist_info(text: str) -> list[Row]:
    head = next(stanzas(text), {})
    return [(head["Name"], head.get("Version"))] if "Name" in head else []


def requirements(text: str) -> list[Row]:
    out = []
    for line in re.sub(r"\\\r?\n", "", text).splitlines():
        m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:===?\s*([^\s;,#]+))?", line.split(" #")[0])
        if m and not line.lstrip().startswith(("#", "-")):
            out.append((m[1], m[2]))
    return out


def go_mod(text: str) -> list[Row]:
    inside = re.findall(r"^require\s*\((.*?)^\)", text, re.M | re.S)
    lines = [x for block in inside for x in block.splitlines()] + re.findall(r"^require\s+([^(\s].*)$", text, re.M)
    found = (re.match(r"\s*(\S+)\s+(v\S+)", x) for x in lines)
    return [(m[1], m[2]) for m in found if m]


def go_sum(text: str) -> list[Row]:
    found = (x.split() for x in text.splitlines())
    return sorted({(x[0], x[1]) for x in found if len(x) == 3 and not x[1].endswith("/go.mod")})


def gemfile_lock(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r"^    ([^\s(]+) \(([^)]+)\)$", text, re.M)]


def yarn_lock(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r'^"?((?:@[^/"]+/)?[^@"\s]+)@[^\n]*:\n\s+version:? "?([^"\n]+)"?', text, re.M)]


def gradle_lock(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r"^([^#\s:]+:[^:]+):([^=\s]+)=", text, re.M)]


def mix_lock(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r'"([^"]+)":\s*\{:hex,\s*:[^,]+,\s*"([^"]+)"', text)]


def package_json(text: str) -> list[Row]:
    doc = json.loads(text)
    return [(n, str(v)) for part in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies") for n, v in (doc.get(part) or {}).items()]


def package_lock(text: str) -> list[Row]:
    doc = json.loads(text)
    if "packages" in doc:
        return [(p.rsplit("node_modules/", 1)[-1], x.get("version")) for p, x in doc["packages"].items() if p and not x.get("link")]
    out: list[Row] = []
    open_ones = [doc.get("dependencies") or {}]
    while open_ones:
        for name, x in open_ones.pop().items():
            out.append((name, x.get("version")))
            open_ones.append(x.get("dependencies") or {})
    return out


def composer_lock(text: str) -> list[Row]:
    doc = json.loads(text)
    return [(x["name"], x.get("version")) for part in ("packages", "packages-dev") for x in doc.get(part) or []]


def pipfile_lock(text: str) -> list[Row]:
    doc = json.loads(text)
    return [(n, (x.get("version") or "").lstrip("=") or None) for part in ("default", "develop") for n, x in (doc.get(part) or {}).items() if isinstance(x, dict)]


def toml_packages(text: str) -> list[Row]:
    import tomllib

    return [(x["name"], x.get("version")) for x in tomllib.loads(text).get("package", [])]


def pom(text: str) -> list[Row]:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document types are not read")
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    known = {f"${{{e.tag}}}": e.text or "" for e in root.findall("properties/*")}
    known |= {"${project.version}": root.findtext("version") or root.findtext("parent/version") or ""}
    managed = {(d.findtext("groupId"), d.findtext("artifactId")): d.findtext("version") for d in root.findall("dependencyManagement/dependencies/dependency")}
    out = []
    for d in root.findall("dependencies/dependency"):
        group, name = d.findtext("groupId"), d.findtext("artifactId")
        version = d.findtext("version") or managed.get((group, name))
        out.append((f"{group}:{name}", known.get(version, version) if version else None))
    return out


#: Detector, file pattern, package type, tier, grammar.
GRAMMARS: list[tuple[str, str, str, int, Callable[[str], list[Row]]]] = [
    ("os/dpkg", "*var/lib/dpkg/status", "deb", 4, dpkg),
    ("os/apk", "*lib/apk/db/installed", "apk", 4, apk),
    ("python/dist-info", "*.dist-info/METADATA", "pypi", 4, dist_info),
    ("python/requirements", "requirements*.txt", "pypi", 2, requirements),
    ("python/poetry-lock", "poetry.lock", "pypi", 3, toml_packages),
    ("python/uv-lock", "uv.lock", "pypi", 3, toml_packages),
    ("python/pipfile-lock", "Pipfile.lock", "pypi", 3, pipfile_lock),
    ("go/go-mod", "go.mod", "golang", 2, go_mod),
    ("go/go-sum", "go.sum", "golang", 3, go_sum),
    ("ruby/gemfile-lock", "Gemfile.lock", "gem", 3, gemfile_lock),
    ("js/package-json", "package.json", "npm", 2, package_json),
    ("js/npm-lock", "package-lock.json", "npm", 3, package_lock),
    ("js/yarn-lock", "yarn.lock", "npm", 3, yarn_lock),
    ("php/composer-lock", "composer.lock", "composer", 3, composer_lock),
    ("jvm/maven-pom", "pom.xml", "maven", 2, pom),
    ("jvm/gradle-lockfile", "gradle.lockfile", "maven", 3, gradle_lock),
    ("elixir/mix-lock", "mix.lock", "hex", 3, mix_lock),
    ("js/npm-lock", "npm-shrinkwrap.json", "npm", 3, package_lock),
    *grammars_locks.GRAMMARS,
    *grammars_declared.GRAMMARS,
    *grammars_infra.GRAMMARS,
]


def registered(*lists: list) -> list:
    """Grammars of several lists; of those with one detector and pattern the first counts."""
    found: dict[tuple[str, str], tuple] = {}
    for grammar in (g for one in lists for g in one):
        found.setdefault(grammar[:2], grammar)
    return list(found.values())


def fits(pattern: str, path: str) -> bool:
    return fnmatch.fnmatchcase(path if "/" in pattern else path.rsplit("/", 1)[-1], pattern if "/" not in pattern or pattern.startswith("*") else "*" + pattern)


def chooser(patterns: list[str]) -> Callable[[str], list[int]]:
    """Which of the patterns a path ``fits``, in their order; patterns that end otherwise aren't tried."""
    tails = [re.split(r"[*?\]]", p)[-1] for p in patterns]
    tests = [(k, tail, re.compile(fnmatch.translate(p if "/" not in p or p.startswith("*") else "*" + p)).match, "/" in p) for k, (p, tail) in enumerate(zip(patterns, tails, strict=True))]
    known = tuple(set(tails))

    def chosen(path: str) -> list[int]:
        if not path.endswith(known):
            return []
        base = path.rsplit("/", 1)[-1]
        return [k for k, tail, test, whole in tests if path.endswith(tail) and test(path if whole else base)]

    return chosen


def detect(files: DataFrame, grammars: list = GRAMMARS) -> DataFrame:
    """Findings of the files (path, content) that a grammar matches; rows with error instead of a name where one can't be read."""

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        chosen = chooser([g[1] for g in grammars])
        for path, content, digest in each(frames, "path", "content", "sha256"):
            for k in chosen(path):
                detector, _, kind, tier, grammar = grammars[k]
                try:
                    rows = [(n, v) for n, v in grammar(content.decode("utf-8", "replace"))]
                except Exception as e:  # one bad file is a gap, not a failed scan
                    yield path, detector, kind, None, None, tier, digest, f"{type(e).__name__}: {e}"
                    continue
                for n, v in rows:
                    yield path, detector, kind, n, v, tier, digest, None

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(found(frames), FINDINGS)

    names = F.element_at(F.split("path", "/"), -1)
    wanted = "|".join(sorted({fnmatch.translate(g[1].rsplit("/", 1)[-1]) for g in grammars}))
    return dealt(files.where(names.rlike(wanted)).select("path", "content")).select("path", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(run, FINDINGS)
