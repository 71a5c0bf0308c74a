"""Grammars of lockfiles and of stores of installed packages: (name, version) rows of a file's text."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

Row = tuple[str, str | None]


def parsed_yaml(text: str) -> object:
    import yaml

    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # noqa: S506  both are safe


def parsed_xml(text: str) -> ET.Element:
    """The root with names free of namespaces; document types are refused."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document types are not read")
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    return root


def name_at_version(spec: str) -> Row:
    """``@scope/name@1.0`` in two; no version: None."""
    name, at, version = spec.rpartition("@")
    return (name, version or None) if name else (spec, None)


def conan_lock(text: str) -> list[Row]:
    doc = json.loads(text)
    refs = [r for part in ("requires", "build_requires", "python_requires") for r in doc.get(part) or []]
    refs += [n["ref"] for n in ((doc.get("graph_lock") or {}).get("nodes") or {}).values() if n.get("ref")]
    found = (re.match(r"([^/\s]+)/([^@#%\s]+)", r) for r in refs)
    return [(m[1], m[2]) for m in found if m]


def vcpkg_status(text: str) -> list[Row]:
    blocks = (dict(re.findall(r"^(\w[\w-]*):[ \t]*(.*)$", b, re.M)) for b in re.split(r"\n\s*\n", text))
    return [(b["Package"], b.get("Version")) for b in blocks if "Package" in b and "Feature" not in b and b.get("Status", "").endswith(" installed")]


def pkg_config(text: str) -> list[Row]:
    variables = dict(re.findall(r"^(\w+)\s*=\s*(.*?)\s*$", text, re.M))
    fields = dict(re.findall(r"^(\w[\w.]*):\s*(.*?)\s*$", text, re.M))
    version = re.sub(r"\$\{(\w+)\}", lambda m: variables.get(m[1], m[0]), fields.get("Version", ""))
    return [(fields["Name"], version or None)] if fields.get("Name") else []


def packages_lock(text: str) -> list[Row]:
    frameworks = (json.loads(text).get("dependencies") or {}).values()
    return sorted({(n, x.get("resolved")) for f in frameworks for n, x in f.items() if x.get("type") != "Project"})


def project_assets(text: str) -> list[Row]:
    found = (json.loads(text).get("libraries") or {}).items()
    return [tuple(k.rsplit("/", 1)) for k, x in found if "/" in k and x.get("type") == "package"]


def deps_json(text: str) -> list[Row]:
    found = (json.loads(text).get("libraries") or {}).items()
    return [tuple(k.rsplit("/", 1)) for k, x in found if "/" in k and x.get("type") in ("package", "runtimepack")]


def pnpm_lock(text: str) -> list[Row]:
    out = set()
    for key, x in ((parsed_yaml(text) or {}).get("packages") or {}).items():
        plain = re.sub(r"\(.*$", "", key).removeprefix("/")
        old = re.fullmatch(r"((?:@[^/]+/)?[^/@]+)/([^/_]+)(?:_.*)?", plain)
        name, version = old.groups() if old else name_at_version(plain)
        out.add((name, (x or {}).get("version") or version))
    return sorted(out)


def bun_lock(text: str) -> list[Row]:
    strict = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)  # commas before a bracket, outside strings
    return sorted({name_at_version(x[0]) for x in (json.loads(strict).get("packages") or {}).values() if isinstance(x, list) and x and not x[0].endswith(("@workspace:", "@root:"))})


def deno_lock(text: str) -> list[Row]:
    doc = json.loads(text)
    parts = doc.get("packages") or doc
    return sorted({name_at_version(re.sub(r"_.*$", "", k) if k.count("@") > 1 and "_" in k.rsplit("@", 1)[-1] else k) for kind in ("npm", "jsr") for k in parts.get(kind) or {}})


def installed_package_json(text: str) -> list[Row]:
    doc = json.loads(text)
    return [(doc["name"], doc.get("version"))] if doc.get("name") else []


def gradle_verification(text: str) -> list[Row]:
    return [(f"{c.get('group')}:{c.get('name')}", c.get("version")) for c in parsed_xml(text).iter("component")]


def stack_lock(text: str) -> list[Row]:
    hackage = (((p or {}).get("completed") or {}).get("hackage") or ((p or {}).get("original") or {}).get("hackage") for p in (parsed_yaml(text) or {}).get("packages") or [])
    found = (re.match(r"(.+)-([0-9][0-9.]*)(?:@|$)", h) for h in hackage if h)
    return [(m[1], m[2]) for m in found if m]


def cabal_freeze(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r"any\.([\w-]+)\s*==\s*([0-9.]+)", text)]


def package_resolved(text: str) -> list[Row]:
    doc = json.loads(text)
    pins = doc.get("pins") or (doc.get("object") or {}).get("pins") or []
    return [(p.get("identity") or p.get("package"), (p.get("state") or {}).get("version") or (p.get("state") or {}).get("revision")) for p in pins]


def podfile_lock(text: str) -> list[Row]:
    heads = (next(iter(p)) if isinstance(p, dict) else p for p in (parsed_yaml(text) or {}).get("PODS") or [])
    found = (re.match(r"(\S+)(?: \(([^)]+)\))?", h) for h in heads)
    return [(m[1], m[2]) for m in found if m]


def cartfile(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r'^\s*(?:github|git|binary)\s+"([^"]+)"\s+"([^"]+)"', text, re.M)]


def zon(text: str) -> list[Row]:
    block = re.search(r"\.dependencies\s*=\s*\.\{(.*)\}", text, re.S)
    out: list[Row] = []
    for m in re.finditer(r'\.(?:@"([^"]+)"|(\w+))\s*=\s*\.\{([^{}]*)\}', block[1] if block else ""):
        version = re.search(r'\.hash\s*=\s*"([^"]+)"', m[3]) or re.search(r'\.url\s*=\s*"[^"]*?v?([0-9][\w.]*?)(?:\.tar|\.zip|")', m[3])
        out.append((m[1] or m[2], version[1] if version else None))
    return out


def rebar_lock(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r'<<"([^"]+)">>\s*,\s*\{pkg\s*,\s*<<"[^"]+">>\s*,\s*<<"([^"]+)">>', text)]


def paket_lock(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r"^    (\S+) \(([^)\s]+)\)", text, re.M)]


def pacman_desc(text: str) -> list[Row]:
    fields = dict(re.findall(r"^%(\w+)%\n(.+)$", text, re.M))
    return [(fields["NAME"], fields.get("VERSION"))] if "NAME" in fields else []


def portage_pf(text: str) -> list[Row]:
    m = re.fullmatch(r"(.+?)-([0-9]\S*)", text.strip())
    return [(m[1], m[2])] if m else []


def brew_receipt(text: str) -> list[Row]:
    doc = json.loads(text)
    source = doc.get("source") or {}
    name = doc.get("token") or doc.get("name") or re.sub(r"\.(rb|json)$", "", (source.get("path") or "").rsplit("/", 1)[-1])
    version = doc.get("version") or (source.get("versions") or {}).get("stable")
    return [(name if isinstance(name, str) else name[0], version)] if name else []


def composer_installed(text: str) -> list[Row]:
    doc = json.loads(text)
    return [(x["name"], x.get("version")) for x in (doc.get("packages") if isinstance(doc, dict) else doc) or []]


def kernel(text: str) -> list[Row]:
    m = re.match(r"Linux version (\S+)", text)
    return [("linux", m[1])] if m else []


def kernel_modules(text: str) -> list[Row]:
    return [(m[1], None) for m in re.finditer(r"^(\w+) \d+ \d+ ", text, re.M)]


def node_header(text: str) -> list[Row]:
    parts = [re.search(rf"#define\s+NODE_{p}_VERSION\s+(\d+)", text) for p in ("MAJOR", "MINOR", "PATCH")]
    return [("node", ".".join(m[1] for m in parts))] if all(parts) else []


def terraform_lock(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r'provider\s+"([^"]+)"\s*\{[^}]*?\bversion\s*=\s*"([^"]+)"', text, re.S)]


def chart_lock(text: str) -> list[Row]:
    return [(d["name"], str(d["version"]) if d.get("version") else None) for d in (parsed_yaml(text) or {}).get("dependencies") or []]


def conda_lock(text: str) -> list[Row]:
    return sorted({(x["name"], x.get("version")) for x in (parsed_yaml(text) or {}).get("package") or []})


def tree_of(node: dict, below: str = "dependencies") -> Iterator[Row]:
    """All (name, version) of a nested tool listing, whatever its depth."""
    open_ones = [node]
    while open_ones:
        for name, child in ((open_ones.pop() or {}).get(below) or {}).items():
            yield name, (child or {}).get("version")
            open_ones.append(child)


def npm_listing(text: str) -> list[Row]:
    doc = json.loads(text)
    roots = doc if isinstance(doc, list) else [doc]
    return sorted({row for r in roots for part in ("dependencies", "devDependencies") for row in tree_of(r, part)}, key=str)


#: Detector, file pattern, package type, tier, grammar.
GRAMMARS: list[tuple[str, str, str, int, Callable[[str], list[Row]]]] = [
    ("cpp/conan-lock", "conan.lock", "conan", 3, conan_lock),
    ("cpp/vcpkg-status", "*vcpkg/status", "vcpkg", 4, vcpkg_status),
    ("cpp/vcpkg-status", "*vcpkg_installed/*/status", "vcpkg", 4, vcpkg_status),
    ("cpp/pkg-config", "*.pc", "generic", 4, pkg_config),
    ("dotnet/packages-lock", "packages.lock.json", "nuget", 3, packages_lock),
    ("dotnet/project-assets", "project.assets.json", "nuget", 4, project_assets),
    ("dotnet/deps-json", "*.deps.json", "nuget", 4, deps_json),
    ("js/pnpm-lock", "pnpm-lock.yaml", "npm", 3, pnpm_lock),
    ("js/bun-lock", "bun.lock", "npm", 3, bun_lock),
    ("js/deno-lock", "deno.lock", "npm", 3, deno_lock),
    ("tool/npm-ls", "npm-ls.json", "npm", 3, npm_listing),
    ("js/node-modules", "*node_modules/*package.json", "npm", 4, installed_package_json),
    ("jvm/gradle-verification", "verification-metadata.xml", "maven", 3, gradle_verification),
    ("haskell/stack-lock", "stack.yaml.lock", "hackage", 3, stack_lock),
    ("haskell/cabal-freeze", "cabal.project.freeze", "hackage", 3, cabal_freeze),
    ("swift/package-resolved", "Package.resolved", "swift", 3, package_resolved),
    ("cocoapods/podfile-lock", "Podfile.lock", "cocoapods", 3, podfile_lock),
    ("carthage/cartfile-resolved", "Cartfile.resolved", "carthage", 3, cartfile),
    ("zig/build-zon", "build.zig.zon", "zig", 3, zon),
    ("erlang/rebar-lock", "rebar.lock", "hex", 3, rebar_lock),
    ("dotnet/paket-lock", "paket.lock", "nuget", 3, paket_lock),
    ("os/pacman", "*var/lib/pacman/local/*/desc", "alpm", 4, pacman_desc),
    ("os/portage", "*var/db/pkg/*/*/PF", "ebuild", 4, portage_pf),
    ("os/homebrew", "*Cellar/*/*/INSTALL_RECEIPT.json", "brew", 4, brew_receipt),
    ("os/homebrew", "*Caskroom/*/.metadata/*/*/Casks/*.json", "brew", 4, brew_receipt),
    ("php/composer-installed", "*vendor/composer/installed.json", "composer", 4, composer_installed),
    ("host/kernel", "*proc/version", "generic", 5, kernel),
    ("host/kernel-modules", "*proc/modules", "generic", 5, kernel_modules),
    ("runtime/node", "node_version.h", "generic", 4, node_header),
    ("iac/terraform-lock", ".terraform.lock.hcl", "terraform", 3, terraform_lock),
    ("iac/helm-chart", "Chart.lock", "helm", 3, chart_lock),
    ("conda/lock", "conda-lock.yml", "conda", 3, conda_lock),
    ("os/dpkg-d", "*var/lib/dpkg/status.d/*", "deb", 4, lambda text: [(b["Package"], b.get("Version")) for b in [dict(re.findall(r"^([\w-]+):[ \t]*(.*)$", text, re.M))] if "Package" in b]),
]
