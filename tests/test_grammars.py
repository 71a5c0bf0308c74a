"""Each further grammar on a small file."""

import pytest

from quillgraph.sources import manifests as M

CASES = [
    ("cpp/conan-lock", '{"requires": ["zlib/1.3#a%1", "b/2@u/c#x"]}', [("zlib", "1.3"), ("b", "2")]),
    ("cpp/vcpkg-status", "Package: zlib\nVersion: 1.3\nStatus: install ok installed\n\nPackage: zlib\nFeature: x\nStatus: install ok installed\n\nPackage: old\nStatus: purge ok not-installed\n", [("zlib", "1.3")]),
    ("cpp/pkg-config", "v=1.2\nName: foo\nVersion: ${v}.3\n", [("foo", "1.2.3")]),
    ("dotnet/packages-lock", '{"dependencies": {"net8": {"A": {"type": "Direct", "resolved": "1"}, "P": {"type": "Project"}}}}', [("A", "1")]),
    ("dotnet/project-assets", '{"libraries": {"A/1": {"type": "package"}, "P/1": {"type": "project"}}}', [("A", "1")]),
    ("dotnet/deps-json", '{"libraries": {"A/1": {"type": "package"}, "app/1": {"type": "project"}}}', [("A", "1")]),
    ("js/pnpm-lock", "packages:\n  /a/1.0.0:\n    resolution: {}\n  '@s/b@2.0.0(react@18)':\n    resolution: {}\n", [("@s/b", "2.0.0"), ("a", "1.0.0")]),
    ("js/bun-lock", '{"packages": {"a": ["a@1.0.0", "", {}, "h"], "s": ["@s/b@2.0.0",],},}', [("@s/b", "2.0.0"), ("a", "1.0.0")]),
    ("js/deno-lock", '{"npm": {"a@1.0.0": {}}, "jsr": {"@std/x@1.1": {}}}', [("@std/x", "1.1"), ("a", "1.0.0")]),
    ("js/node-modules", '{"name": "a", "version": "1"}', [("a", "1")]),
    ("jvm/gradle-verification", "<verification-metadata xmlns='x'><components><component group='g' name='a' version='1'/></components></verification-metadata>", [("g:a", "1")]),
    ("haskell/stack-lock", "packages:\n- completed:\n    hackage: a-b-1.2@sha256:x,1\n", [("a-b", "1.2")]),
    ("haskell/cabal-freeze", "constraints: any.a ==1.0,\n  any.b-c ==2.0\n", [("a", "1.0"), ("b-c", "2.0")]),
    ("swift/package-resolved", '{"pins": [{"identity": "a", "state": {"version": "1"}}]}', [("a", "1")]),
    ("cocoapods/podfile-lock", "PODS:\n  - A (1.0)\n  - B (2.0):\n    - A (= 1.0)\n", [("A", "1.0"), ("B", "2.0")]),
    ("carthage/cartfile-resolved", 'github "o/a" "1.0"\n', [("o/a", "1.0")]),
    ("zig/build-zon", '.{ .dependencies = .{ .a = .{ .url = "https://x/v1.2.tar.gz", .hash = "h1" } } }', [("a", "h1")]),
    ("erlang/rebar-lock", '{"1.2.0",[{<<"a">>,{pkg,<<"a">>,<<"1.0">>},0}]}.', [("a", "1.0")]),
    ("dotnet/paket-lock", "NUGET\n  remote: x\n    A (1.0)\n      B (>= 1)\n", [("A", "1.0")]),
    ("os/pacman", "%NAME%\nzlib\n\n%VERSION%\n1:1.3-1\n", [("zlib", "1:1.3-1")]),
    ("os/portage", "zlib-ng-1.3-r1\n", [("zlib-ng", "1.3-r1")]),
    ("os/homebrew", '{"source": {"path": "/x/zlib.rb", "versions": {"stable": "1.3"}}}', [("zlib", "1.3")]),
    ("php/composer-installed", '[{"name": "v/a", "version": "1"}]', [("v/a", "1")]),
    ("host/kernel", "Linux version 6.1.0-x (gcc)", [("linux", "6.1.0-x")]),
    ("host/kernel-modules", "ext4 1 2 - Live 0x0\n", [("ext4", None)]),
    ("runtime/node", "#define NODE_MAJOR_VERSION 20\n#define NODE_MINOR_VERSION 1\n#define NODE_PATCH_VERSION 2\n", [("node", "20.1.2")]),
    ("iac/terraform-lock", 'provider "r/h/aws" {\n  version = "5.0"\n  hashes = []\n}\n', [("r/h/aws", "5.0")]),
    ("tool/npm-ls", '{"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2"}}}}}', [("a", "1"), ("b", "2")]),
    ("python/pyproject", '[project]\ndependencies = ["a==1", "b>=2"]\n[tool.poetry.dependencies]\npython = "3"\nc = "^3"\n', [("a", "1"), ("b", None), ("c", "^3")]),
    ("python/setup-py", "from setuptools import setup\nsetup(install_requires=['a==1', 'b'], x=f())\n", [("a", "1"), ("b", None)]),
    ("conda/environment", "dependencies:\n- a=1.2\n- c::b>=2\n- pip:\n  - d==4\n", [("a", "1.2"), ("b", None), ("d", "4")]),
    ("conda/lock", "package:\n- name: a\n  version: 1.0.0\n", [("a", "1.0.0")]),
    ("rust/cargo-toml", '[dependencies]\na = "1"\nb = {version = "2", package = "bb"}\n[target.x.dependencies]\nc = {path = "."}\n', [("a", "1"), ("bb", "2"), ("c", None)]),
    ("cpp/conanfile-txt", "[requires]\nzlib/1.3\n[generators]\nx/1\n", [("zlib", "1.3")]),
    ("cpp/conanfile-py", 'class A:\n    requires = "a/1", "b/2"\n    def r(self):\n        self.requires("c/3")\n', [("a", "1"), ("b", "2"), ("c", "3")]),
    ("cpp/vcpkg-manifest", '{"dependencies": ["a", {"name": "b", "version>=": "2"}], "overrides": [{"name": "a", "version": "1"}]}', [("a", "1"), ("b", "2")]),
    ("cpp/cmake", "find_package(Foo 1.2 REQUIRED) # find_package(No)\nFetchContent_Declare(b GIT_REPOSITORY u GIT_TAG v2)\n", [("Foo", "1.2"), ("b", "v2")]),
    ("cpp/meson-wrap", "[wrap-file]\ndirectory = zlib-1.3\n", [("zlib", "1.3")]),
    ("cpp/gitmodules", '[submodule "x"]\n\turl = https://h/o/r.git\n', [("r", None)]),
    ("cpp/makefile", "LIBS = -lssl -lz\n", [("ssl", None), ("z", None)]),
    ("dotnet/csproj", "<Project><ItemGroup><PackageReference Include='A' Version='1'/><PackageReference Include='B'><Version>2</Version></PackageReference></ItemGroup></Project>", [("A", "1"), ("B", "2")]),
    ("swift/package-swift", '.package(url: "https://h/o/a.git", from: "1.1.0")', [("a", "1.1.0")]),
    ("jvm/build-sbt", 'libraryDependencies += "g" %% "a" % "1"', [("g:a", "1")]),
    ("bazel/module", 'bazel_dep(name = "a", version = "1")', [("a", "1")]),
    ("clojure/deps", '{:deps {g/a {:mvn/version "1"}}}', [("g/a", "1")]),
    ("ocaml/opam", 'depends: [\n "a" {>= "1"}\n "b"\n]\n', [("a", "1"), ("b", None)]),
    ("perl/cpanfile", "requires 'A::B', '1.0';\nrequires 'perl', '5';\n", [("A::B", "1.0")]),
    ("perl/meta-json", '{"prereqs": {"runtime": {"requires": {"A": "1", "B": "0"}}}}', [("A", "1"), ("B", None)]),
    ("lua/rockspec", 'dependencies = { "lua >= 5", "a == 1.0" }', [("a", "1.0")]),
    ("jvm/gradle-version-catalog", '[versions]\nv = "1"\n[libraries]\na = {module = "g:a", version.ref = "v"}\nb = "g:b:2"\n', [("g:a", "1"), ("g:b", "2")]),
    ("jvm/gradle-build", "implementation 'g:a:1'\ntestImplementation(\"g:b\")\n", [("g:a", "1"), ("g:b", None)]),
    ("ruby/gemspec", "s.add_dependency 'a', '~> 1'\n", [("a", "~> 1")]),
    ("php/composer-json", '{"require": {"php": "8", "v/a": "^1"}}', [("v/a", "^1")]),
    ("iac/dockerfile", "ARG V=3\nFROM alpine:$V AS b\nFROM b\nRUN apk add --no-cache zlib=1.3 && \\\n  pip install a==2 -r r.txt\n", [("alpine", "3"), ("zlib", "1.3"), ("a", "2")]),
    ("iac/kubernetes", "apiVersion: v1\nkind: Pod\nspec:\n  containers:\n  - image: r.io:5000/a/b:1\n", [("r.io:5000/a/b", "1")]),
    ("iac/helm-chart", "dependencies:\n- name: a\n  version: 1.0.0\n", [("a", "1.0.0")]),
    ("iac/helm-template", "  image: a:1\n  image: {{ .Values.x }}\n", [("a", "1")]),
    ("iac/kustomize", "images:\n- name: a\n  newTag: v2\n", [("a", "v2")]),
    ("iac/cloudformation", "Resources:\n  T:\n    Properties:\n      X: !Ref Y\n      Image: a:1\n", [("a", "1")]),
    ("iac/bicep", "module m 'br:reg.io/x:1' = {}\nresource r 'Microsoft.Web/sites@2022-01-01' = {}\n", [("Microsoft.Web/sites", "2022-01-01"), ("reg.io/x", "1")]),
    ("iac/ansible-requirements", "roles:\n- name: a.b\n  version: 1.0.0\ncollections:\n- c.d\n", [("a.b", "1.0.0"), ("c.d", None)]),
    ("iac/ansible-playbook", "- hosts: all\n  tasks:\n  - ansible.builtin.apt:\n      name: [a=1, b]\n", [("a", "1"), ("b", None)]),
    ("iac/terraform", 'module "m" {\n  source = "h/a/b" # {\n  version = "1"\n}\nterraform {\n  required_providers {\n    aws = {\n      source = "h/aws"\n      version = "~> 5"\n    }\n  }\n}\n', [("h/a/b", "1"), ("h/aws", "~> 5")]),
]


@pytest.mark.parametrize("detector, text, want", CASES, ids=[c[0] for c in CASES])
def test_grammar(detector, text, want):
    grammar = next(g[4] for g in M.GRAMMARS if g[0] == detector)
    assert sorted(grammar(text), key=repr) == sorted(want, key=repr)


def test_every_grammar_has_a_case():
    tested = {c[0] for c in CASES}
    further = {g[0] for x in (M.grammars_locks, M.grammars_declared, M.grammars_infra) for g in x.GRAMMARS}
    assert further - tested <= {"os/dpkg-d"}


@pytest.mark.parametrize("text", ["", "\n", "{}"])
def test_empty_files(text):
    for detector, _, _, _, grammar in M.GRAMMARS:
        try:
            assert grammar(text) == [], detector
        except (ValueError, SyntaxError):  # not a document of this format
            pass
