"""Grammars of infrastructure as code: images, modules, charts and roles that a file names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from quillgraph.sources.grammars_locks import Row


def documents(text: str) -> list[object]:
    """All documents of a YAML file; custom tags are read as plain values."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    def plain(loader: yaml.Loader, _suffix: str, node: yaml.Node) -> object:
        build = {yaml.MappingNode: loader.construct_mapping, yaml.SequenceNode: loader.construct_sequence}
        return build.get(type(node), loader.construct_scalar)(node)

    Loader.add_multi_constructor("!", plain)
    return [d for d in yaml.load_all(text, Loader) if d is not None]


def image(reference: str) -> Row | None:
    """Name and digest or tag of an image; None for one that a variable hides."""
    m = re.fullmatch(r"((?:[^/\s@:]+(?::\d+)?/)?[^:@\s]+)(?::([^@\s]+))?(?:@(\S+))?", reference.strip())
    return (m[1], m[3] or m[2]) if m and not re.search(r"[${}]", reference) else None


def _nodes(doc: object) -> Iterator[dict]:
    open_ones = [doc]
    while open_ones:
        node = open_ones.pop()
        if isinstance(node, dict):
            yield node
            open_ones += node.values()
        elif isinstance(node, list):
            open_ones += node


def logical_lines(text: str) -> list[str]:
    """Lines with their continuations, without comments."""
    kept = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("#"))
    return [x.strip() for x in re.sub(r"\\[ \t]*\n", " ", kept).splitlines() if x.strip()]


def dockerfile(text: str) -> list[Row]:
    """Base images, with ARG defaults filled in, and packages that RUN lines install."""
    args: dict[str, str] = {}
    stages: set[str] = set()
    out: list[Row] = []
    for line in logical_lines(text):
        word, _, rest = line.partition(" ")
        word = word.upper()
        if word == "ARG" and "=" in rest:
            name, _, value = rest.partition("=")
            args[name.strip()] = value.strip().strip("\"'")
        elif word == "FROM":
            parts = [p for p in rest.split() if not p.startswith("--")]
            name = re.sub(r"\$\{?(\w+)\}?", lambda m: args.get(m[1], m[0]), parts[0]) if parts else ""
            if name and name not in stages and name != "scratch" and (found := image(name)):
                out.append(found)
            if len(parts) == 3:
                stages.add(parts[2])
        elif word == "RUN":
            out += installed(rest)
    return out


def installed(command: str) -> list[Row]:
    """Packages named by apt-get, apk, yum, dnf, pip and npm install commands."""
    out: list[Row] = []
    for part in re.split(r"&&|\|\||;", command):
        m = re.match(r"\s*(?:sudo\s+)?(?:(?:apt-get|apt|yum|dnf)\b.*?\binstall|apk\b.*?\badd|pip3?\s+install|npm\s+(?:install|i))\b(.*)", part)
        for w in m[1].split() if m else ():
            if w.startswith(("-", ".", "/", "$")) or "://" in w or w.endswith(".txt"):
                continue
            name, _, version = w.replace("==", "=").partition("=")
            if "=" not in w and "@" in w[1:]:
                name, _, version = w.rpartition("@")
            out.append((name.strip("\"'"), version.strip("\"'") or None))
    return out


def kubernetes(docs: list[object]) -> list[Row]:
    """Images of the containers of every object with a kind; other YAML has none."""
    objects = [d for d in docs if isinstance(d, dict) and d.get("apiVersion") and d.get("kind")]
    lists = (n[k] for d in objects for n in _nodes(d) for k in ("containers", "initContainers", "ephemeralContainers") if isinstance(n.get(k), list))
    named = (c.get("image") for x in lists for c in x if isinstance(c, dict))
    return sorted({r for n in named if isinstance(n, str) and (r := image(n))}, key=str)


def compose(docs: list[object]) -> list[Row]:
    services = [s for d in docs if isinstance(d, dict) and isinstance(d.get("services"), dict) for s in d["services"].values()]
    return [r for s in services if isinstance(s, dict) and isinstance(s.get("image"), str) and (r := image(s["image"]))]


def yaml_images(text: str) -> list[Row]:
    docs = [] if "{{" in text else documents(text)  # templates are not YAML yet
    return kubernetes(docs) or compose(docs)


def helm_chart(text: str) -> list[Row]:
    doc = (documents(text) or [{}])[0]
    return [(d["name"], str(d["version"]) if d.get("version") else None) for d in doc.get("dependencies") or []]


def helm_template(text: str) -> list[Row]:
    """Images written out in a template; those that values fill in are unknown."""
    return [r for x in re.findall(r"""^\s*-?\s*image:\s*["']?([^\s"'#{}]+)["']?\s*$""", text, re.M) if (r := image(x))]


def kustomize(text: str) -> list[Row]:
    doc = (documents(text) or [{}])[0]
    return [(i.get("newName") or i.get("name"), i.get("digest") or (str(i["newTag"]) if i.get("newTag") else None)) for i in doc.get("images") or []]


def cloudformation(text: str) -> list[Row]:
    named = (n.get("Image") for d in documents(text) if isinstance(d, dict) and "Resources" in d for n in _nodes(d["Resources"]))
    return [r for n in named if isinstance(n, str) and (r := image(n))]


def bicep(text: str) -> list[Row]:
    return [(m[1], m[2]) for m in re.finditer(r"^\s*(?:resource|module)\s+\w+\s+'(?:br:|br/[^:']*:|ts:)?([^'@:]+)[@:]([^']+)'", text, re.M)]


def ansible_requirements(text: str) -> list[Row]:
    doc = (documents(text) or [[]])[0]
    entries = doc if isinstance(doc, list) else [*(doc.get("roles") or []), *(doc.get("collections") or [])]
    rows = ((e, None) if isinstance(e, str) else (e.get("name") or e.get("src"), e.get("version")) for e in entries)
    return [(n, str(v) if v is not None else None) for n, v in rows if n]


#: Task modules that install packages.
INSTALLERS = ("apt", "yum", "dnf", "apk", "pip", "npm", "package")


def ansible_playbook(text: str) -> list[Row]:
    out: list[Row] = []
    for doc in documents(text):
        for node in _nodes(doc):
            for key, task in node.items():
                if str(key).rsplit(".", 1)[-1] in INSTALLERS and isinstance(task, dict) and task.get("name"):
                    names = task["name"] if isinstance(task["name"], list) else str(task["name"]).split(",")
                    for n in names:
                        name, _, version = str(n).strip().replace("==", "=").partition("=")
                        out.append((name, version or (str(task["version"]) if task.get("version") else None)))
    return sorted((r for r in out if "{{" not in r[0]), key=str)


def blocks(text: str, kind: str) -> Iterator[tuple[str, str]]:
    """(label, body) of each block ``kind "label" { ... }``, braces matched outside strings and comments."""
    plain = re.sub(r"(\"(?:[^\"\\\n]|\\.)*\")|#[^\n]*|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    for m in re.finditer(rf'^\s*{kind}\b(?:\s+"([^"]*)")?(?:\s+"[^"]*")?\s*\{{', plain, re.M):
        depth, at = 1, m.end()
        for token in re.finditer(r'"(?:[^"\\\n]|\\.)*"|[{}]', plain[m.end() :]):
            depth += {"{": 1, "}": -1}.get(token[0], 0)
            if not depth:
                at = m.end() + token.start()
                break
        yield m[1] or "", plain[m.end() : at]


def terraform(text: str) -> list[Row]:
    """Modules and required providers; a source that is a folder of the project is left out."""
    out: list[Row] = []
    for _, body in blocks(text, "module"):
        fields = dict(re.findall(r'^\s*(source|version)\s*=\s*"([^"]*)"', body, re.M))
        if fields.get("source") and not fields["source"].startswith("."):
            source, _, ref = fields["source"].partition("?ref=")
            out.append((source, fields.get("version") or ref or None))
    for _, body in blocks(text, "required_providers"):
        for name, inner in re.findall(r"(\w+)\s*=\s*\{(.*?)\}", body, re.S):
            fields = dict(re.findall(r'(source|version)\s*=\s*"([^"]*)"', inner))
            out.append((fields.get("source", name), fields.get("version")))
    return out


#: Detector, file pattern, package type, tier, grammar.
GRAMMARS: list[tuple[str, str, str, int, Callable[[str], list[Row]]]] = [
    *(("iac/dockerfile", name, "docker", 2, dockerfile) for name in ("Dockerfile", "Dockerfile.*", "*.dockerfile")),
    ("iac/kubernetes", "*.yaml", "docker", 2, yaml_images),
    ("iac/kubernetes", "*.yml", "docker", 2, yaml_images),
    ("iac/helm-chart", "Chart.yaml", "helm", 2, helm_chart),
    ("iac/helm-template", "*templates/*.yaml", "docker", 1, helm_template),
    ("iac/helm-template", "*templates/*.yml", "docker", 1, helm_template),
    ("iac/kustomize", "kustomization.yaml", "docker", 2, kustomize),
    ("iac/kustomize", "kustomization.yml", "docker", 2, kustomize),
    *(("iac/cloudformation", name, "docker", 2, cloudformation) for name in ("*.template", "template.yaml", "template.yml", "cloudformation.yaml")),
    ("iac/bicep", "*.bicep", "bicep", 2, bicep),
    ("iac/ansible-requirements", "requirements.yml", "ansible", 2, ansible_requirements),
    ("iac/ansible-requirements", "requirements.yaml", "ansible", 2, ansible_requirements),
    *(("iac/ansible-playbook", name, "generic", 2, ansible_playbook) for name in ("*playbook*.yml", "*playbooks/*.yml", "*tasks/*.yml")),
    ("iac/terraform", "*.tf", "terraform", 2, terraform),
]
