"""What manifests and lockfiles say about who needs what: one function a grammar, from a file's text to relations.

A relation is (source, target, scope, requested, direct, marker); the source None is the
project whose file it is. ``relations`` turns them into claimed edges between references
(``project:folder``, ``family:ecosystem/name``), which reconciliation resolves.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.grammars_locks import name_at_version, parsed_xml, parsed_yaml
from quillgraph.sources.lockfiles import batches, dealt, each
from quillgraph.sources.manifests import chooser, stanzas

Relation = tuple[str | None, str, str | None, str | None, bool, str | None]


def _own(names: dict | None, scope: str | None, value: Callable = lambda v: v if isinstance(v, str) else None) -> Iterator[Relation]:
    """The project's own needs."""
    return ((None, n, scope, value(v), True, None) for n, v in (names or {}).items())


def _inner(source: str, names, scope: str | None = None) -> Iterator[Relation]:
    """What a package needs: names, or names with ranges."""
    return ((source, n, scope, v if isinstance(v, str) else None, False, None) for n, v in (names.items() if isinstance(names, dict) else ((x, None) for x in names or ())))


#: How npm's and PHP's manifests name their groups.
NPM_GROUPS = {"dependencies": "runtime", "devDependencies": "dev", "optionalDependencies": "optional", "peerDependencies": "runtime"}
PHP_GROUPS = {"require": "runtime", "require-dev": "dev"}


def package_json(text: str) -> Iterator[Relation]:
    doc = json.loads(text)
    for group, scope in NPM_GROUPS.items():
        yield from _own(doc.get(group), scope)


def package_lock(text: str) -> Iterator[Relation]:
    doc = json.loads(text)
    for place, x in (doc.get("packages") or {}).items():
        if not place:
            for group, scope in NPM_GROUPS.items():
                yield from _own(x.get(group), scope)
            continue
        name = place.rsplit("node_modules/", 1)[-1]
        yield from _inner(name, x.get("dependencies") or {})
        yield from _inner(name, x.get("optionalDependencies") or {}, "optional")
    open_ones = [doc.get("dependencies") or {}] if "packages" not in doc else []
    while open_ones:
        for name, x in open_ones.pop().items():
            yield from _inner(name, x.get("requires") if isinstance(x.get("requires"), dict) else {})
            open_ones.append(x.get("dependencies") or {})


def yarn_lock(text: str) -> Iterator[Relation]:
    for block in re.split(r"\n(?=\S)", text):
        head = re.match(r'"?((?:@[^/"]+/)?[^@"\s]+)@', block)
        needs = re.search(r"\n  (?:dependencies|optionalDependencies):\n((?:    .*\n?)+)", block)
        if head and needs:
            for m in re.finditer(r'^    "?((?:@[^/"]+/)?[^"\s:]+)"?:? "?([^"\n]+?)"?$', needs[1], re.M):
                yield head[1], m[1], None, m[2], False, None


def pnpm_lock(text: str) -> Iterator[Relation]:
    doc = parsed_yaml(text) or {}
    for project in (doc.get("importers") or {".": doc}).values():
        for group, scope in NPM_GROUPS.items():
            yield from _own(project.get(group), scope, lambda v: v.get("specifier") if isinstance(v, dict) else v if isinstance(v, str) else None)
    for part in ("snapshots", "packages"):
        for key, x in (doc.get(part) or {}).items():
            name, _ = name_at_version(re.sub(r"\(.*$", "", key).removeprefix("/"))
            yield from _inner(name, {n: None for n in (x or {}).get("dependencies") or {}})


def _python(line: str, scope: str, extra: str | None = None) -> Iterator[Relation]:
    """One requirement: name[extras] range ; marker."""
    m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;)#]*)\)?\s*(?:;\s*(.*?))?\s*$", line.split(" #")[0])
    if m and not line.lstrip().startswith(("#", "-")):
        yield None, m[1], scope, m[2].strip() or None, True, " and ".join(x for x in (m[3], extra) if x) or None


def requirements(text: str, path: str = "") -> Iterator[Relation]:
    scope = "dev" if re.search(r"(dev|test)", path.rsplit("/", 1)[-1]) else "runtime"
    for line in re.sub(r"\\\r?\n", "", text).splitlines():
        yield from _python(line, scope)


def pyproject(text: str) -> Iterator[Relation]:
    doc = tomllib.loads(text)
    project, poetry = doc.get("project") or {}, (doc.get("tool") or {}).get("poetry") or {}
    for line in project.get("dependencies") or []:
        yield from _python(line, "runtime")
    for extra, lines in (project.get("optional-dependencies") or {}).items():
        for line in lines:
            yield from _python(line, "optional", f'extra == "{extra}"')
    for lines in (doc.get("dependency-groups") or {}).values():
        for line in lines:
            if isinstance(line, str):
                yield from _python(line, "dev")
    for line in (doc.get("build-system") or {}).get("requires") or []:
        yield from _python(line, "build")
    spec = lambda v: v.get("version") if isinstance(v, dict) else v if isinstance(v, str) else None
    yield from (r for r in _own(poetry.get("dependencies"), "runtime", spec) if r[1] != "python")
    yield from _own(poetry.get("dev-dependencies"), "dev", spec)
    for group in (poetry.get("group") or {}).values():
        yield from _own(group.get("dependencies"), "dev", spec)


def poetry_lock(text: str) -> Iterator[Relation]:
    for x in tomllib.loads(text).get("package", []):
        for name, spec in (x.get("dependencies") or {}).items():
            for s in spec if isinstance(spec, list) else [spec]:
                yield x["name"], name, None, s.get("version") if isinstance(s, dict) else s, False, s.get("markers") if isinstance(s, dict) else None


def uv_lock(text: str) -> Iterator[Relation]:
    for x in tomllib.loads(text).get("package", []):
        virtual = {"virtual", "editable"} & set(x.get("source") or {})
        source = None if virtual else x["name"]
        for d in x.get("dependencies") or []:
            yield source, d["name"], "runtime" if virtual else None, None, bool(virtual), d.get("marker")
        for extra, needs in (x.get("optional-dependencies") or {}).items():
            for d in needs:
                yield source, d["name"], "optional" if virtual else None, None, bool(virtual), f'extra == "{extra}"'
        for needs in (x.get("dev-dependencies") or {}).values():
            for d in needs:
                yield source, d["name"], "dev", None, bool(virtual), d.get("marker")


def pipfile_lock(text: str) -> Iterator[Relation]:
    doc = json.loads(text)
    for part, scope in (("default", "runtime"), ("develop", "dev")):
        for name, x in (doc.get(part) or {}).items():
            yield None, name, scope, x.get("version") if isinstance(x, dict) else None, True, x.get("markers") if isinstance(x, dict) else None


def cargo_toml(text: str) -> Iterator[Relation]:
    doc = tomllib.loads(text)
    spec = lambda v: v.get("version") if isinstance(v, dict) else v
    for place in [doc, *(doc.get("target") or {}).values()]:
        for part, scope in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
            for name, v in (place.get(part) or {}).items():
                known = v.get("package", name) if isinstance(v, dict) else name
                yield None, known, "optional" if isinstance(v, dict) and v.get("optional") else scope, spec(v), True, None


def cargo_lock(text: str) -> Iterator[Relation]:
    for x in tomllib.loads(text).get("package", []):
        yield from _inner(x["name"], [d.split(" ")[0] for d in x.get("dependencies") or []])


def go_mod(text: str) -> Iterator[Relation]:
    inside = [x for block in re.findall(r"^require\s*\((.*?)^\)", text, re.M | re.S) for x in block.splitlines()]
    for line in inside + re.findall(r"^require\s+([^(\s].*)$", text, re.M):
        m = re.match(r"\s*(\S+)\s+(v\S+)(.*)", line)
        if m and "// indirect" not in m[3]:
            yield None, m[1], "runtime", m[2], True, None


def gemfile_lock(text: str) -> Iterator[Relation]:
    source = None
    for line in text.splitlines():
        if m := re.match(r"^    ([^\s(]+) \(", line):
            source = m[1]
        elif (m := re.match(r"^      ([^\s(]+)(?: \(([^)]+)\))?$", line)) and source:
            yield source, m[1], None, m[2], False, None
    for m in re.finditer(r"^  ([^\s(!]+)!?(?: \(([^)]+)\))?$", (re.search(r"^DEPENDENCIES\n((?:  .*\n?)+)", text, re.M) or [None, ""])[1], re.M):
        yield None, m[1], "runtime", m[2], True, None


def composer_json(text: str) -> Iterator[Relation]:
    doc = json.loads(text)
    for group, scope in PHP_GROUPS.items():
        yield from (r for r in _own(doc.get(group), scope) if "/" in r[1])


def composer_lock(text: str) -> Iterator[Relation]:
    doc = json.loads(text)
    for part in ("packages", "packages-dev"):
        for x in doc.get(part) or []:
            yield from (r for r in _inner(x["name"], x.get("require") or {}) if "/" in r[1])


def pom(text: str) -> Iterator[Relation]:
    scopes = {"test": "test", "provided": "build", "system": "build"}
    for d in parsed_xml(text).findall("dependencies/dependency"):
        scope = "optional" if d.findtext("optional") == "true" else scopes.get(d.findtext("scope") or "", "runtime")
        yield None, f"{d.findtext('groupId')}:{d.findtext('artifactId')}", scope, d.findtext("version"), True, None


def gradle_build(text: str) -> Iterator[Relation]:
    kinds = {"testImplementation": "test", "testRuntimeOnly": "test", "compileOnly": "build", "annotationProcessor": "build", "kapt": "build", "classpath": "build"}
    for kind, group, name, version in re.findall(r"""\b(implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt|classpath)\s*\(?\s*["']([\w.-]+):([\w.-]+)(?::([^"'@:]+))?""", text):
        yield None, f"{group}:{name}", kinds.get(kind, "runtime"), version or None, True, None


def pubspec_lock(text: str) -> Iterator[Relation]:
    for name, x in ((parsed_yaml(text) or {}).get("packages") or {}).items():
        kind = x.get("dependency") or ""
        if kind.startswith("direct"):
            yield None, name, "dev" if "dev" in kind else "runtime", None, True, None


def dpkg(text: str) -> Iterator[Relation]:
    for s in stanzas(text):
        if "Package" in s and not s.get("Status", "installed").startswith("deinstall"):
            for part, scope in (("Depends", None), ("Pre-Depends", None), ("Recommends", "optional")):
                for one in re.split(r"\s*,\s*", s.get(part, "")):
                    m = re.match(r"([^\s(|:]+)(?::\w+)?\s*(?:\(([^)]+)\))?", one)  # of alternatives the first
                    if m:
                        yield s["Package"], m[1], scope, m[2], False, None


def apk(text: str) -> Iterator[Relation]:
    for s in stanzas(text):
        for need in s.get("D", "").split():
            if "P" in s and ":" not in need and not need.startswith(("!", "/")):
                yield s["P"], re.split(r"[<>=~]", need)[0], None, None, False, None


def npm_listing(text: str) -> Iterator[Relation]:
    doc = json.loads(text)
    for root in doc if isinstance(doc, list) else [doc]:
        for group, scope in NPM_GROUPS.items():
            open_ones = [(None, n, x or {}) for n, x in (root.get(group) or {}).items()]
            while open_ones:
                source, name, x = open_ones.pop()
                yield source, name, scope if source is None else None, x.get("from") if source is None else None, source is None, None
                open_ones += [(name, n, c or {}) for n, c in (x.get("dependencies") or {}).items()]


def bun_lock(text: str) -> Iterator[Relation]:
    doc = json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text))
    for project in (doc.get("workspaces") or {}).values():
        for group, scope in NPM_GROUPS.items():
            yield from _own(project.get(group), scope)
    for x in (doc.get("packages") or {}).values():
        needs = next((e for e in x[1:] if isinstance(e, dict)), {}) if isinstance(x, list) and x else {}
        if needs:
            name, _ = name_at_version(x[0])
            yield from _inner(name, needs.get("dependencies") or {})
            yield from _inner(name, needs.get("optionalDependencies") or {}, "optional")


def podfile_lock(text: str) -> Iterator[Relation]:
    doc = parsed_yaml(text) or {}
    part = lambda line: re.match(r"(\S+)(?: \(([^)]+)\))?", line)
    for pod in doc.get("PODS") or []:
        for head, needs in pod.items() if isinstance(pod, dict) else ():
            for need in needs or []:
                yield part(head)[1], part(need)[1], None, part(need)[2], False, None
    for need in doc.get("DEPENDENCIES") or []:
        yield None, part(need)[1], "runtime", part(need)[2], True, None


def packages_lock(text: str) -> Iterator[Relation]:
    for framework in (json.loads(text).get("dependencies") or {}).values():
        for name, x in framework.items():
            if x.get("type") == "Direct":
                yield None, name, "runtime", x.get("requested"), True, None
            yield from _inner(name, x.get("dependencies") or {})


def dotnet_targets(text: str) -> Iterator[Relation]:
    for target in (json.loads(text).get("targets") or {}).values():
        for key, x in target.items():
            yield from _inner(key.rsplit("/", 1)[0], (x or {}).get("dependencies") or {})


def csproj(text: str) -> Iterator[Relation]:
    for e in parsed_xml(text).iter("PackageReference"):
        if e.get("Include"):
            private = (e.get("PrivateAssets") or e.findtext("PrivateAssets") or "").lower() == "all"
            yield None, e.get("Include"), "build" if private else "runtime", e.get("Version") or e.findtext("Version"), True, None


def mix_lock(text: str) -> Iterator[Relation]:
    for m in re.finditer(r'^\s*"([^"]+)":\s*\{:hex,(.*)$', text, re.M):
        for need in re.finditer(r'\{:(\w+),\s*"([^"]*)"', m[2]):
            yield m[1], need[1], None, need[2] or None, False, None


def gemspec(text: str) -> Iterator[Relation]:
    for kind, name, wanted in re.findall(r"""\.add_(runtime_|development_)?dependency\s*\(?\s*["']([\w-]+)["'](?:\s*,\s*["']([^"']+)["'])?""", text):
        yield None, name, "dev" if kind.startswith("dev") else "runtime", wanted or None, True, None


def vcpkg_manifest(text: str) -> Iterator[Relation]:
    for d in json.loads(text).get("dependencies") or []:
        name, wanted, host = (d, None, False) if isinstance(d, str) else (d["name"], d.get("version>="), d.get("host"))
        yield None, name, "build" if host else "runtime", wanted, True, None


def conda_environment(text: str) -> Iterator[Relation]:
    for d in (parsed_yaml(text) or {}).get("dependencies") or []:
        m = re.match(r"(?:[^:]+::)?([A-Za-z0-9._-]+)\s*(.*)$", d) if isinstance(d, str) else None
        if m:
            yield None, m[1], "runtime", m[2].strip() or None, True, None


def conda_meta(text: str) -> Iterator[Relation]:
    doc = json.loads(text)
    for need in doc.get("depends") or []:
        name, _, wanted = need.partition(" ")
        yield doc["name"], name, None, wanted or None, False, None


def pacman_desc(text: str) -> Iterator[Relation]:
    blocks = dict(re.findall(r"^%(\w+)%\n((?:.+\n?)+)", text, re.M))
    for part, scope in (("DEPENDS", None), ("OPTDEPENDS", "optional")):
        for line in blocks.get(part, "").splitlines():
            m = re.match(r"([^\s<>=:]+)([<>=]+\S+)?", line)
            if m and blocks.get("NAME"):
                yield blocks["NAME"].strip(), m[1], scope, m[2], False, None


def dist_info(text: str) -> Iterator[Relation]:
    head = next(stanzas(text), {}).get("Name")
    for line in re.findall(r"^Requires-Dist:\s*(.+)$", text.split("\n\n", 1)[0], re.M):
        for _, name, _, wanted, _, marker in _python(line, ""):
            if head:
                yield head, name, None, wanted, False, marker


#: File pattern, package type, grammar.
GRAMMARS: list[tuple[str, str, Callable[..., Iterator[Relation]]]] = [
    ("package.json", "npm", package_json),
    ("package-lock.json", "npm", package_lock),
    ("npm-shrinkwrap.json", "npm", package_lock),
    ("yarn.lock", "npm", yarn_lock),
    ("pnpm-lock.yaml", "npm", pnpm_lock),
    ("requirements*.txt", "pypi", requirements),
    ("pyproject.toml", "pypi", pyproject),
    ("poetry.lock", "pypi", poetry_lock),
    ("uv.lock", "pypi", uv_lock),
    ("Pipfile.lock", "pypi", pipfile_lock),
    ("Cargo.toml", "cargo", cargo_toml),
    ("Cargo.lock", "cargo", cargo_lock),
    ("go.mod", "golang", go_mod),
    ("Gemfile.lock", "gem", gemfile_lock),
    ("composer.json", "composer", composer_json),
    ("composer.lock", "composer", composer_lock),
    ("pom.xml", "maven", pom),
    ("build.gradle", "maven", gradle_build),
    ("build.gradle.kts", "maven", gradle_build),
    ("pubspec.lock", "pub", pubspec_lock),
    ("npm-ls.json", "npm", npm_listing),
    ("bun.lock", "npm", bun_lock),
    ("Podfile.lock", "cocoapods", podfile_lock),
    ("packages.lock.json", "nuget", packages_lock),
    ("project.assets.json", "nuget", dotnet_targets),
    ("*.deps.json", "nuget", dotnet_targets),
    *((name, "nuget", csproj) for name in ("*.csproj", "*.fsproj", "*.vbproj")),
    ("mix.lock", "hex", mix_lock),
    ("*.gemspec", "gem", gemspec),
    ("vcpkg.json", "vcpkg", vcpkg_manifest),
    ("environment.yml", "conda", conda_environment),
    ("environment.yaml", "conda", conda_environment),
    ("*conda-meta/*.json", "conda", conda_meta),
    ("*var/lib/pacman/local/*/desc", "alpm", pacman_desc),
    ("*.dist-info/METADATA", "pypi", dist_info),
    ("*var/lib/dpkg/status", "deb", dpkg),
    ("*lib/apk/db/installed", "apk", apk),
]
RELATIONS = "path string, ptype string, source string, target string, scope string, requested string, direct boolean, marker string, error string"


def relations(files: DataFrame) -> DataFrame:
    """RELATIONS of the files (path, content) that a grammar matches; a file that can't be read is a row with its error."""

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        chosen = chooser([g[0] for g in GRAMMARS])
        for path, content in each(frames, "path", "content"):
            for k in chosen(path) if "node_modules/" not in path else ():
                _, kind, grammar = GRAMMARS[k]
                try:
                    text = content.decode("utf-8", "replace")
                    rows = list(grammar(text, path) if grammar is requirements else grammar(text))
                except Exception as e:  # one bad file is a gap, not a failed scan
                    yield path, kind, None, None, None, None, None, None, f"{type(e).__name__}: {e}"
                    continue
                for r in rows:
                    yield path, kind, *r, None

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(found(frames), RELATIONS)

    return dealt(files.select("path", "content")).mapInArrow(run, RELATIONS)


def folder_of(path: str) -> Column:
    """The folder of a path; "." at the top."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def claimed_edges(found: DataFrame) -> DataFrame:
    """``relations`` as edges between references, in an order of their own."""
    ref = lambda c: F.concat(F.lit("family:"), "ptype", F.lit("/"), F.lower(c))
    src = F.when(F.col("source").isNull(), F.concat(F.lit("project:"), folder_of("path"))).otherwise(ref("source"))
    order = F.xxhash64("path", "source", "target", "scope", "requested")
    return found.where("target is not null").select(order.alias("ordinal"), F.lit("DEPENDS_ON").alias("kind"), src.alias("src"), ref("target").alias("dst"), "scope", "requested", "direct", "marker", F.create_map().cast("map<string,string>").alias("attrs"))


def projects_of(found: DataFrame) -> DataFrame:
    """(id, path) of the folders that are projects; ids are below 0, as components' are above."""
    paths = found.where("source is null and target is not null").select(folder_of("path").alias("path")).distinct()
    return paths.select((-F.abs(F.xxhash64("path")) - 1).alias("id"), "path")
