"""Grammars of manifests that declare dependencies: (name, version) rows; a range stays as written."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from quillgraph.sources.grammars_locks import Row, parsed_xml, parsed_yaml


def _toml(text: str) -> dict:
    import tomllib

    return tomllib.loads(text)


def python_requirement(spec: str) -> Row | None:
    """Name and, if pinned, the version of a requirement."""
    m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:\(?\s*===?\s*([^\s;,)]+))?", spec)
    return (m[1], m[2]) if m else None


def pyproject(text: str) -> list[Row]:
    doc = _toml(text)
    project = doc.get("project") or {}
    groups = [*(project.get("optional-dependencies") or {}).values(), *(doc.get("dependency-groups") or {}).values()]
    specs = [*(project.get("dependencies") or []), *(x for g in groups for x in g if isinstance(x, str))]
    out = [r for r in map(python_requirement, specs) if r]
    poetry = (doc.get("tool") or {}).get("poetry") or {}
    tables = [poetry.get("dependencies"), poetry.get("dev-dependencies"), *((g or {}).get("dependencies") for g in (poetry.get("group") or {}).values())]
    out += [(n, v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None) for t in tables for n, v in (t or {}).items() if n != "python"]
    return out


def setup_py(text: str) -> list[Row]:
    """Literal lists of install_requires, tests_require and setup_requires; what code computes is left out."""
    import ast

    out: list[Row] = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.keyword) and node.arg in ("install_requires", "tests_require", "setup_requires") and isinstance(node.value, ast.List | ast.Tuple):
            out += [r for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str) and (r := python_requirement(e.value))]
    return out


def conda_environment(text: str) -> list[Row]:
    out: list[Row] = []
    for d in (parsed_yaml(text) or {}).get("dependencies") or []:
        if isinstance(d, dict):
            out += [r for x in d.get("pip") or [] if (r := python_requirement(x))]
            continue
        m = re.match(r"(?:[^:\s]+::)?([A-Za-z0-9_.-]+)\s*(?:(==?|[<>~!]=?)\s*([^=\s]+))?", d)
        if m:
            out.append((m[1], m[3] if m[2] in ("=", "==") else None))
    return out


def cargo_toml(text: str) -> list[Row]:
    doc = _toml(text)
    homes = [doc, doc.get("workspace") or {}, *(doc.get("target") or {}).values()]
    tables = [h.get(k) or {} for h in homes for k in ("dependencies", "dev-dependencies", "build-dependencies")]
    return [((v.get("package") if isinstance(v, dict) else None) or n, v if isinstance(v, str) else v.get("version")) for t in tables for n, v in t.items()]


def conanfile_txt(text: str) -> list[Row]:
    out: list[Row] = []
    for part in re.split(r"^\[", text, flags=re.M)[1:]:
        head, _, body = part.partition("]")
        if head in ("requires", "tool_requires", "build_requires", "test_requires"):
            out += [(m[1], m[2]) for m in re.finditer(r"^\s*([\w.+-]+)/([\w.+-]+)", body, re.M)]
    return out


def conanfile_py(text: str) -> list[Row]:
    calls = re.findall(r"""(?:requires|tool_requires|build_requires|test_requires)\s*(?:\(|=)\s*(.*?)(?:\)|$)""", text, re.M)
    return [(m[0], m[1]) for c in calls for m in re.findall(r"""["']([\w.+-]+)/([\w.+-]+)""", c)]


def vcpkg_manifest(text: str) -> list[Row]:
    doc = json.loads(text)
    forced = {o["name"]: o.get("version") or o.get("version-semver") or o.get("version-string") for o in doc.get("overrides") or []}
    asked = [*(doc.get("dependencies") or []), *(d for f in (doc.get("features") or {}).values() for d in f.get("dependencies") or [])]
    rows = ((d, None) if isinstance(d, str) else (d.get("name"), d.get("version>=")) for d in asked)
    return [(n, forced.get(n) or v) for n, v in rows if n]


def cmake(text: str) -> list[Row]:
    plain = re.sub(r"#[^\n]*", "", text)
    out: list[Row] = [(m[1], m[2]) for m in re.finditer(r"\bfind_package\s*\(\s*([\w.+-]+)(?:\s+v?([0-9][\w.]*))?", plain, re.I)]
    for m in re.finditer(r"\bFetchContent_Declare\s*\(\s*([\w.+-]+)([^)]*)\)", plain, re.I):
        tag = re.search(r"GIT_TAG\s+(\S+)", m[2]) or re.search(r"URL\s+\S*?v?([0-9][\w.]*?)(?:\.tar|\.zip)", m[2])
        out.append((m[1], tag[1] if tag else None))
    return out


def meson_wrap(text: str) -> list[Row]:
    fields = dict(re.findall(r"^([\w-]+)\s*=\s*(.*?)\s*$", text, re.M))
    directory = fields.get("directory", "")
    m = re.fullmatch(r"(.+?)-v?([0-9]\S*)", directory)
    if m:
        return [(m[1], m[2])]
    name = directory or re.sub(r"\.git$", "", fields.get("url", "").rstrip("/")).rsplit("/", 1)[-1]
    return [(name, fields.get("revision"))] if name else []


def gitmodules(text: str) -> list[Row]:
    return [(re.sub(r"\.git$", "", u.rstrip("/")).rsplit("/", 1)[-1], None) for u in re.findall(r"^\s*url\s*=\s*(\S+)", text, re.M)]


def makefile(text: str) -> list[Row]:
    return [(n, None) for n in sorted(set(re.findall(r"(?:^|\s)-l([A-Za-z0-9_+.-]+)", text)))]


def csproj(text: str) -> list[Row]:
    return [(p.get("Include") or p.get("Update"), p.get("Version") or p.findtext("Version")) for p in parsed_xml(text).iter("PackageReference") if p.get("Include") or p.get("Update")]


def package_swift(text: str) -> list[Row]:
    out: list[Row] = []
    for url, rest in re.findall(r'\.package\s*\([^)]*?url:\s*"([^"]+)"([^)]*)\)', text):
        version = re.search(r'"([^"]+)"', rest)
        out.append((re.sub(r"\.git$", "", url.rstrip("/")).rsplit("/", 1)[-1], version[1] if version else None))
    return out


def sbt(text: str) -> list[Row]:
    return [(f"{g}:{a}", v) for g, a, v in re.findall(r'"([\w.-]+)"\s*%{1,3}\s*"([\w.-]+)"\s*%\s*"([^"]+)"', text)]


def bazel_module(text: str) -> list[Row]:
    calls = re.findall(r"bazel_dep\s*\(([^)]*)\)", text)
    fields = [dict(re.findall(r'(\w+)\s*=\s*"([^"]*)"', c)) for c in calls]
    return [(f["name"], f.get("version")) for f in fields if "name" in f]


def clojure(text: str) -> list[Row]:
    named = re.findall(r'([\w.-]+(?:/[\w.-]+)?)\s*\{\s*:mvn/version\s+"([^"]+)"', text)
    return named + re.findall(r'\[\s*([\w.-]+(?:/[\w.-]+)?)\s+"([0-9][^"]*)"', text)


def opam(text: str) -> list[Row]:
    dune = re.findall(r"\(depends(.*?)\)\s*\)", text, re.S)
    if dune:
        return [(m[1], m[2]) for m in re.finditer(r"\(\s*([a-z][\w-]*)(?:\s+\(\s*(?:=|>=)\s+([^)\s]+)\s*\))?", " ".join(dune))]
    block = re.search(r"^depends:\s*\[(.*?)\]", text, re.M | re.S)
    return [(m[1], m[2]) for m in re.finditer(r'"([\w-]+)"\s*(?:\{[^}"]*?=\s*"([^"]+)"[^}]*\})?', block[1] if block else "")]


def cpanfile(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r"""^\s*(?:requires|recommends|test_requires)\s+["']([\w:]+)["'](?:\s*(?:,|=>)\s*["']?([^"';\s]+))?""", text, re.M) if m[1] != "perl"]


def perl_meta(text: str) -> list[Row]:
    phases = (json.loads(text).get("prereqs") or {}).values()
    return sorted({(n, str(v) if v not in (0, "0") else None) for p in phases for kind in p.values() for n, v in kind.items() if n != "perl"}, key=str)


def rockspec(text: str) -> list[Row]:
    block = re.search(r"\bdependencies\s*=\s*\{(.*?)\}", text, re.S)
    found = (re.match(r"([\w.-]+)\s*(?:==?\s*(\S+))?", s) for s in re.findall(r"""["']([^"']+)["']""", block[1] if block else ""))
    return [(m[1], m[2]) for m in found if m and m[1] != "lua"]


def gradle_catalog(text: str) -> list[Row]:
    doc = _toml(text)
    versions = doc.get("versions") or {}
    out: list[Row] = []
    for x in (doc.get("libraries") or {}).values():
        if isinstance(x, str):
            group, name, version = [*x.split(":"), None, None][:3]
        else:
            group, _, name = (x.get("module") or f"{x.get('group')}:{x.get('name')}").partition(":")
            version = x.get("version")
            version = versions.get(version.get("ref")) if isinstance(version, dict) and "ref" in version else version
        version = version if isinstance(version, str | None) else version.get("strictly") or version.get("require") or version.get("prefer")
        out.append((f"{group}:{name}", version))
    return out


def gradle_build(text: str) -> list[Row]:
    call = r"""\b(?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt|classpath)\s*\(?\s*(?:platform\s*\(\s*)?["']([\w.-]+):([\w.-]+)(?::([^"'@:]+))?"""
    return [(f"{g}:{a}", v or None) for g, a, v in re.findall(call, text)]


def gemspec(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r"""\.add_(?:runtime_|development_)?dependency\s*\(?\s*["']([\w-]+)["'](?:\s*,\s*["']([^"']+)["'])?""", text)]


def composer_json(text: str) -> list[Row]:
    doc = json.loads(text)
    return [(n, v) for part in ("require", "require-dev") for n, v in (doc.get(part) or {}).items() if "/" in n]


#: Detector, file pattern, package type, tier, grammar.
GRAMMARS: list[tuple[str, str, str, int, Callable[[str], list[Row]]]] = [
    ("python/pyproject", "pyproject.toml", "pypi", 2, pyproject),
    ("python/setup-py", "setup.py", "pypi", 2, setup_py),
    ("conda/environment", "environment.yml", "conda", 2, conda_environment),
    ("conda/environment", "environment.yaml", "conda", 2, conda_environment),
    ("rust/cargo-toml", "Cargo.toml", "cargo", 2, cargo_toml),
    ("cpp/conanfile-txt", "conanfile.txt", "conan", 2, conanfile_txt),
    ("cpp/conanfile-py", "conanfile.py", "conan", 2, conanfile_py),
    ("cpp/vcpkg-manifest", "vcpkg.json", "vcpkg", 2, vcpkg_manifest),
    ("cpp/cmake", "CMakeLists.txt", "generic", 2, cmake),
    ("cpp/cmake", "*.cmake", "generic", 2, cmake),
    ("cpp/meson-wrap", "*subprojects/*.wrap", "generic", 3, meson_wrap),
    ("cpp/gitmodules", ".gitmodules", "generic", 2, gitmodules),
    *(("cpp/makefile", name, "generic", 1, makefile) for name in ("Makefile", "makefile", "GNUmakefile")),
    *(("dotnet/csproj", name, "nuget", 2, csproj) for name in ("*.csproj", "*.fsproj", "*.vbproj")),
    ("swift/package-swift", "Package.swift", "swift", 2, package_swift),
    ("jvm/build-sbt", "build.sbt", "maven", 2, sbt),
    ("jvm/build-sbt", "*project/*.scala", "maven", 2, sbt),
    ("bazel/module", "MODULE.bazel", "bazel", 2, bazel_module),
    ("clojure/deps", "deps.edn", "clojars", 2, clojure),
    ("clojure/deps", "project.clj", "clojars", 2, clojure),
    ("ocaml/opam", "*.opam", "opam", 2, opam),
    ("ocaml/opam", "dune-project", "opam", 2, opam),
    ("perl/cpanfile", "cpanfile", "cpan", 2, cpanfile),
    ("perl/meta-json", "META.json", "cpan", 2, perl_meta),
    ("lua/rockspec", "*.rockspec", "luarocks", 2, rockspec),
    ("jvm/gradle-version-catalog", "libs.versions.toml", "maven", 2, gradle_catalog),
    ("jvm/gradle-build", "build.gradle", "maven", 2, gradle_build),
    ("jvm/gradle-build", "build.gradle.kts", "maven", 2, gradle_build),
    ("ruby/gemspec", "*.gemspec", "gem", 2, gemspec),
    ("php/composer-json", "composer.json", "composer", 2, composer_json),
]
