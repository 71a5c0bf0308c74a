"""Queries of the readers of manifests, lockfiles and stores, on files that are written out from the tables, with SQL for what they must find.

A format is a template: how a file of it begins, one record a package, what stands
between records, how it ends. {n} is a package's name, {v} its version.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.queries import EDGES, query
from quillgraph.sources import derived as D
from quillgraph.sources import ignores, images, lockfiles, manifests, poms
from quillgraph.sources.relations import relations

#: detector, file, begin, record, between, end, name, version
Format = tuple[str, str, str, str, str, str, str, str]

LOCKS: list[Format] = [
    ("js/npm-lock", "package-lock.json", '{"packages": {"": {}, ', '"node_modules/{n}": {"version": "{v}"}', ", ", "}}", "{n}", "{v}"),
    ("js/yarn-lock", "yarn.lock", "# yarn\n\n", '{n}@^1:\n  version "{v}"\n', "\n", "", "{n}", "{v}"),
    ("js/pnpm-lock", "pnpm-lock.yaml", "packages:\n", "  /@s/{n}/{v}:\n    resolution: {}", "\n", "\n", "@s/{n}", "{v}"),
    ("js/bun-lock", "bun.lock", '{"packages": {', '"{n}": ["{n}@{v}", "", {}, "h"],', "", "}}", "{n}", "{v}"),
    ("js/deno-lock", "deno.lock", '{"npm": {', '"{n}@{v}": {}', ", ", "}}", "{n}", "{v}"),
    ("python/poetry-lock", "poetry.lock", "", '[[package]]\nname = "{n}"\nversion = "{v}"\n', "\n", "", "{n}", "{v}"),
    ("python/uv-lock", "uv.lock", "version = 1\n", '[[package]]\nname = "{n}"\nversion = "{v}"\n', "\n", "", "{n}", "{v}"),
    ("python/pipfile-lock", "Pipfile.lock", '{"default": {', '"{n}": {"version": "=={v}"}', ", ", "}}", "{n}", "{v}"),
    ("go/go-sum", "go.sum", "", "m/{n} v{v} h1:x=\nm/{n} v{v}/go.mod h1:y=", "\n", "\n", "m/{n}", "v{v}"),
    ("ruby/gemfile-lock", "Gemfile.lock", "GEM\n  specs:\n", "    {n} ({v})\n      dep (>= 1)", "\n", "\n", "{n}", "{v}"),
    ("php/composer-lock", "composer.lock", '{"packages": [', '{"name": "v/{n}", "version": "{v}"}', ", ", "]}", "v/{n}", "{v}"),
    ("jvm/gradle-lockfile", "gradle.lockfile", "# locked\n", "g:{n}:{v}=compile", "\n", "\nempty=\n", "g:{n}", "{v}"),
    ("jvm/gradle-verification", "verification-metadata.xml", "<verification-metadata><components>", "<component group='g' name='{n}' version='{v}'/>", "", "</components></verification-metadata>", "g:{n}", "{v}"),
    ("elixir/mix-lock", "mix.lock", "%{", '"{n}": {:hex, :{n}, "{v}", "h"}', ", ", "}", "{n}", "{v}"),
    ("erlang/rebar-lock", "rebar.lock", '{"1.2.0",[', '{<<"{n}">>,{pkg,<<"{n}">>,<<"{v}">>},0}', ",", "]}.", "{n}", "{v}"),
    ("haskell/stack-lock", "stack.yaml.lock", "packages:\n", "- completed:\n    hackage: {n}-{v}@sha256:x,1", "\n", "\n", "{n}", "{v}"),
    ("haskell/cabal-freeze", "cabal.project.freeze", "constraints: ", "any.{n} =={v}", ",\n  ", "\n", "{n}", "{v}"),
    ("swift/package-resolved", "Package.resolved", '{"pins": [', '{"identity": "{n}", "state": {"version": "{v}"}}', ", ", "]}", "{n}", "{v}"),
    ("cocoapods/podfile-lock", "Podfile.lock", "PODS:\n", "  - {n} ({v})", "\n", "\n", "{n}", "{v}"),
    ("carthage/cartfile-resolved", "Cartfile.resolved", "", 'github "o/{n}" "{v}"', "\n", "\n", "o/{n}", "{v}"),
    ("zig/build-zon", "build.zig.zon", ".{ .dependencies = .{ ", '.{n} = .{ .url = "https://x/{n}/v{v}.tar.gz" }', ", ", " } }", "{n}", "{v}"),
    ("dotnet/packages-lock", "packages.lock.json", '{"dependencies": {"net8": {', '"{n}": {"type": "Direct", "resolved": "{v}"}', ", ", "}}}", "{n}", "{v}"),
    ("dotnet/paket-lock", "paket.lock", "NUGET\n  remote: x\n", "    {n} ({v})", "\n", "\n", "{n}", "{v}"),
    ("cpp/conan-lock", "conan.lock", '{"requires": [', '"{n}/{v}#a%1"', ", ", "]}", "{n}", "{v}"),
    ("conda/lock", "conda-lock.yml", "package:\n", "- name: {n}\n  version: {v}", "\n", "\n", "{n}", "{v}"),
    ("iac/terraform-lock", ".terraform.lock.hcl", "", 'provider "r/h/{n}" {\n  version = "{v}"\n  hashes = []\n}', "\n", "\n", "r/h/{n}", "{v}"),
    ("iac/helm-chart", "Chart.lock", "dependencies:\n", "- name: {n}\n  version: {v}", "\n", "\n", "{n}", "{v}"),
    ("tool/npm-ls", "npm-ls.json", '{"dependencies": {', '"{n}": {"version": "{v}"}', ", ", "}}", "{n}", "{v}"),
]
DECLARED: list[Format] = [
    ("python/requirements", "requirements.txt", "# own\n", "{n}=={v} ; os == 'x'", "\n", "\n-r other.txt\n", "{n}", "{v}"),
    ("python/pyproject", "pyproject.toml", "[project]\ndependencies = [", '"{n}=={v}"', ", ", "]\n", "{n}", "{v}"),
    ("python/setup-py", "setup.py", "from setuptools import setup\nsetup(install_requires=[", "'{n}=={v}'", ", ", "])\n", "{n}", "{v}"),
    ("conda/environment", "environment.yml", "dependencies:\n", "- {n}={v}", "\n", "\n", "{n}", "{v}"),
    ("js/package-json", "package.json", '{"dependencies": {', '"{n}": "^{v}"', ", ", "}}", "{n}", "^{v}"),
    ("go/go-mod", "go.mod", "module m\nrequire (\n", "\tm/{n} v{v}", "\n", "\n)\n", "m/{n}", "v{v}"),
    ("jvm/maven-pom", "pom.xml", "<project><dependencies>", "<dependency><groupId>g</groupId><artifactId>{n}</artifactId><version>{v}</version></dependency>", "", "</dependencies></project>", "g:{n}", "{v}"),
    ("jvm/gradle-build", "build.gradle", "dependencies {\n", "  implementation 'g:{n}:{v}'", "\n", "\n}\n", "g:{n}", "{v}"),
    ("jvm/gradle-version-catalog", "libs.versions.toml", "[libraries]\n", '{n} = "g:{n}:{v}"', "\n", "\n", "g:{n}", "{v}"),
    ("jvm/build-sbt", "build.sbt", "", 'libraryDependencies += "g" %% "{n}" % "{v}"', "\n", "\n", "g:{n}", "{v}"),
    ("rust/cargo-toml", "Cargo.toml", "[dependencies]\n", '{n} = "{v}"', "\n", "\n", "{n}", "{v}"),
    ("cpp/conanfile-txt", "conanfile.txt", "[requires]\n", "{n}/{v}", "\n", "\n[generators]\ncmake\n", "{n}", "{v}"),
    ("cpp/vcpkg-manifest", "vcpkg.json", '{"dependencies": [', '{"name": "{n}", "version>=": "{v}"}', ", ", "]}", "{n}", "{v}"),
    ("dotnet/csproj", "app.csproj", "<Project><ItemGroup>", "<PackageReference Include='{n}' Version='{v}'/>", "", "</ItemGroup></Project>", "{n}", "{v}"),
    ("swift/package-swift", "Package.swift", "let d = [", '.package(url: "https://h/o/{n}.git", from: "{v}")', ", ", "]\n", "{n}", "{v}"),
    ("bazel/module", "MODULE.bazel", "", 'bazel_dep(name = "{n}", version = "{v}")', "\n", "\n", "{n}", "{v}"),
    ("clojure/deps", "deps.edn", "{:deps {", 'g/{n} {:mvn/version "{v}"}', " ", "}}", "g/{n}", "{v}"),
    ("ocaml/opam", "own.opam", "depends: [\n", ' "{n}" {>= "{v}"}', "\n", "\n]\n", "{n}", "{v}"),
    ("perl/cpanfile", "cpanfile", "", "requires '{n}', '{v}';", "\n", "\n", "{n}", "{v}"),
    ("lua/rockspec", "own.rockspec", "dependencies = { ", '"{n} == {v}"', ", ", " }\n", "{n}", "{v}"),
    ("ruby/gemspec", "own.gemspec", "", "s.add_dependency '{n}', '~> {v}'", "\n", "\n", "{n}", "~> {v}"),
    ("php/composer-json", "composer.json", '{"require": {', '"v/{n}": "^{v}"', ", ", "}}", "v/{n}", "^{v}"),
    ("iac/dockerfile", "Dockerfile", "", "FROM img/{n}:{v}", "\n", "\n", "img/{n}", "{v}"),
    ("iac/kustomize", "kustomization.yaml", "images:\n", '- name: {n}\n  newTag: "{v}"', "\n", "\n", "{n}", "{v}"),
]
INSTALLED: list[Format] = [
    ("os/dpkg", "var/lib/dpkg/status", "", "Package: {n}\nStatus: install ok installed\nVersion: {v}\n", "\n", "", "{n}", "{v}"),
    ("os/apk", "lib/apk/db/installed", "", "P:{n}\nV:{v}\n", "\n", "", "{n}", "{v}"),
    ("cpp/vcpkg-status", "vcpkg/status", "", "Package: {n}\nVersion: {v}\nStatus: install ok installed\n", "\n", "", "{n}", "{v}"),
    ("php/composer-installed", "vendor/composer/installed.json", "[", '{"name": "v/{n}", "version": "{v}"}', ", ", "]", "v/{n}", "{v}"),
    ("dotnet/project-assets", "project.assets.json", '{"libraries": {', '"{n}/{v}": {"type": "package"}', ", ", "}}", "{n}", "{v}"),
    ("dotnet/deps-json", "app.deps.json", '{"libraries": {', '"{n}/{v}": {"type": "package"}', ", ", "}}", "{n}", "{v}"),
]
#: One package a file; the file's path has the package's name.
SINGLE: list[Format] = [
    ("python/dist-info", "{n}.dist-info/METADATA", "", "Metadata-Version: 2.1\nName: {n}\nVersion: {v}\n\nName: no\n", "", "", "{n}", "{v}"),
    ("js/node-modules", "node_modules/{n}/package.json", "", '{"name": "{n}", "version": "{v}"}', "", "", "{n}", "{v}"),
    ("os/pacman", "var/lib/pacman/local/{n}-{v}/desc", "", "%NAME%\n{n}\n\n%VERSION%\n{v}\n", "", "", "{n}", "{v}"),
    ("os/portage", "var/db/pkg/sys/{n}/PF", "", "{n}-{v}\n", "", "", "{n}", "{v}"),
    ("os/homebrew", "Cellar/{n}/{v}/INSTALL_RECEIPT.json", "", '{"source": {"path": "/x/{n}.rb", "versions": {"stable": "{v}"}}}', "", "", "{n}", "{v}"),
    ("cpp/pkg-config", "lib/{n}.pc", "", "own={v}\nName: {n}\nVersion: ${own}\n", "", "", "{n}", "{v}"),
    ("cpp/meson-wrap", "subprojects/{n}.wrap", "", "[wrap-file]\ndirectory = {n}-{v}\n", "", "", "{n}", "{v}"),
]
SPECS: list[Format] = [
    ("dart/pubspec-lock", "pubspec.lock", "packages:\n", '  {n}:\n    version: "{v}"', "\n", "\n", "{n}", "{v}"),
    ("rust/cargo-lock", "Cargo.lock", "", '[[package]]\nname = "{n}"\nversion = "{v}"\n', "\n", "", "{n}", "{v}"),
    ("r/renv-lock", "renv.lock", '{"Packages": {', '"{n}": {"Package": "{n}", "Version": "{v}"}', ", ", "}}", "{n}", "{v}"),
    ("julia/manifest-toml", "Manifest.toml", "", '[[deps.{n}]]\nversion = "{v}"\n', "\n", "", "{n}", "{v}"),
    ("nim/nimble-lock", "nimble.lock", '{"packages": {', '"{n}": {"version": "{v}"}', ", ", "}}", "{n}", "{v}"),
    ("crystal/shard-lock", "shard.lock", "shards:\n", '  {n}:\n    version: "{v}"', "\n", "\n", "{n}", "{v}"),
    ("python/pdm-lock", "pdm.lock", "", '[[package]]\nname = "{n}"\nversion = "{v}"\n', "\n", "", "{n}", "{v}"),
    ("nix/flake-lock", "flake.lock", '{"nodes": {', '"{n}": {"locked": {"rev": "{v}"}}', ", ", "}}", "{n}", "{v}"),
    ("unity/packages-manifest", "Packages/manifest.json", '{"dependencies": {', '"{n}": "{v}"', ", ", "}}", "{n}", "{v}"),
]
SPEC_SINGLE: list[Format] = [
    ("conda/conda-meta", "conda-meta/{n}.json", "", '{"name": "{n}", "version": "{v}"}', "", "", "{n}", "{v}"),
    ("os/snap", "{n}/meta/snap.yaml", "", 'name: {n}\nversion: "{v}"\n', "", "", "{n}", "{v}"),
]
FOLDERS = 40


def _filled(template: str) -> Column:
    """The template with each part's name and version."""
    k = F.col("p_partkey")
    values = {"{n}": F.concat(F.lit("lib"), k.cast("string")), "{v}": F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(".0"))}
    pieces = [values.get(x, F.lit(x)) for x in re.split(r"(\{n\}|\{v\})", template) if x]
    return F.concat(*pieces) if pieces else F.lit("")


def _sql(template: str) -> str:
    values = {"{n}": "'lib' || p_partkey", "{v}": "p_size || '.' || (p_partkey % 10) || '.0'"}
    return " || ".join(values.get(x, "'" + x.replace("'", "''") + "'") for x in re.split(r"(\{n\}|\{v\})", template) if x)



def _files(spark: SparkSession, d: str, formats: list[Format], single: bool = False) -> DataFrame:
    """(path, content) of files that hold all parts, each in one file of every format."""
    part = D.table(spark, d, "part").select("p_partkey", "p_size")
    out = None
    for detector, name, begin, record, between, end, _, _ in formats:
        folder = F.lit("") if single else F.concat((F.col("p_partkey") % FOLDERS).cast("string"), F.lit("/"))
        rows = part.select(F.concat(F.lit(f"/srv/{detector}/"), folder, _filled(name)).alias("path"), F.struct(F.col("p_partkey").alias("k"), _filled(record).alias("record")).alias("x"))
        files = lockfiles.dealt(rows).groupBy("path").agg(F.concat(F.lit(begin), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.record), between), F.lit(end)).cast("binary").alias("content"))
        out = files if out is None else out.unionByName(files)
    return out


def _expected(formats: list[Format], single: bool = False) -> str:
    folder = "''" if single else f"(p_partkey % {FOLDERS}) || '/'"
    return " UNION ALL ".join(f"SELECT '{detector}' AS detector, '/srv/{detector}/' || {folder} || {_sql(name)} AS path, {_sql(n)} AS name, {_sql(v)} AS version FROM part" for detector, name, _, _, _, _, n, v in formats)


def _found(df: DataFrame) -> DataFrame:
    return df.select("detector", "path", F.coalesce("name", "error").alias("name"), "version")


@query(_expected(LOCKS))
def detect_locks(spark: SparkSession, d: str) -> DataFrame:
    return _found(manifests.detect(_files(spark, d, LOCKS)))


@query(_expected(DECLARED))
def detect_declared(spark: SparkSession, d: str) -> DataFrame:
    return _found(manifests.detect(_files(spark, d, DECLARED)))


@query(_expected(INSTALLED) + " UNION ALL " + _expected(SINGLE, single=True))
def detect_installed(spark: SparkSession, d: str) -> DataFrame:
    return _found(manifests.detect(_files(spark, d, INSTALLED).unionByName(_files(spark, d, SINGLE, single=True))))


@query(_expected(SPECS) + " UNION ALL " + _expected(SPEC_SINGLE, single=True))
def detect_specs(spark: SparkSession, d: str) -> DataFrame:
    return _found(lockfiles.detect(_files(spark, d, SPECS).unionByName(_files(spark, d, SPEC_SINGLE, single=True))))


#: File, begin, one source with its needs, between sources, end; one need, between needs; what a need asks for.
LINKS = [
    ("package-lock.json", '{"packages": {"": {}, ', '"node_modules/lib{s}": {"version": "1", "dependencies": {{needs}}}', ", ", "}}", '"lib{t}": "^{t}"', ", ", "^{t}"),
    ("Cargo.lock", "", '[[package]]\nname = "lib{s}"\nversion = "1"\ndependencies = [{needs}]\n', "\n", "", '"lib{t}"', ", ", None),
    ("poetry.lock", "", '[[package]]\nname = "lib{s}"\nversion = "1"\n[package.dependencies]\n{needs}\n', "\n", "", 'lib{t} = ">={t}"', "\n", ">={t}"),
    ("yarn.lock", "# yarn\n\n", 'lib{s}@^1:\n  version "1"\n  dependencies:\n{needs}\n', "\n", "", '    lib{t} "^{t}"', "\n", "^{t}"),
    ("Gemfile.lock", "GEM\n  specs:\n", "    lib{s} (1)\n{needs}", "\n", "\n", "      lib{t} (>= {t})", "\n", ">= {t}"),
    ("composer.lock", '{"packages": [', '{"name": "v/lib{s}", "require": {{needs}}}', ", ", "]}", '"v/lib{t}": "^{t}"', ", ", "^{t}"),
    ("var/lib/dpkg/status", "", "Package: lib{s}\nStatus: install ok installed\nDepends: {needs}\n", "\n", "", "lib{t} (>= {t})", ", ", ">= {t}"),
    ("lib/apk/db/installed", "", "P:lib{s}\nV:1\nD:{needs}\n", "\n", "", "lib{t}", " ", None),
]


def _links_sql() -> str:
    each = []
    for name, _, record, _, _, _, _, wanted in LINKS:
        prefix = "v/" if "v/lib" in record else ""
        asked = "NULL::VARCHAR" if wanted is None else "'" + wanted.replace("{t}", "' || dst || '") + "'"
        each.append(f"SELECT '/srv/' || (src % {FOLDERS}) || '/{name}' AS path, '{prefix}lib' || src AS source, '{prefix}lib' || dst AS target, {asked} AS requested FROM links")
    return f"WITH {EDGES}, links AS (SELECT DISTINCT src, dst FROM edges WHERE src > 0) " + " UNION ALL ".join(each)


@query(_links_sql())
def manifest_relations(spark: SparkSession, d: str) -> DataFrame:
    links = D.edges(spark, d).where("src > 0").select("src", "dst").distinct()
    out = None
    for name, begin, record, between, end, need, comma, _ in LINKS:
        fill = lambda text, mark, value: F.concat(*(value if x == mark else F.lit(x) for x in re.split(f"({re.escape(mark)})", text) if x))
        needs = F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda t: fill(need, "{t}", t.cast("string"))), comma)  # noqa: B023
        per = lockfiles.dealt(links, "src").groupBy("src").agg(needs.alias("needs"))
        head, tail = record.split("{needs}")
        own = per.select(F.concat(F.lit("/srv/"), (F.col("src") % FOLDERS).cast("string"), F.lit(f"/{name}")).alias("path"), F.struct("src", F.concat(fill(head, "{s}", F.col("src").cast("string")), "needs", F.lit(tail)).alias("record")).alias("x"))
        files = lockfiles.dealt(own).groupBy("path").agg(F.concat(F.lit(begin), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.record), between), F.lit(end)).cast("binary").alias("content"))
        out = files if out is None else out.unionByName(files)
    return relations(out).select("path", F.coalesce("source", "error").alias("source"), "target", "requested")


# Trees and images -------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_partkey AS k, p_partkey % 7 AS a, p_partkey % 5 AS b, ['log', 'tmp', 'txt'][p_partkey % 3 + 1] AS ext FROM part)
  SELECT 'src/a' || a || '/b' || b || '/f' || k || '.' || ext AS path FROM t WHERE NOT (a = 3 OR b = 4 OR CASE WHEN a = 1 THEN ext = 'txt' ELSE ext = 'log' AND k % 10 <> 5 END)""")
def unignored_tree(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    tree = D.table(spark, d, "part").select(text("src/a", k % 7, "/b", k % 5, "/f", k, ".", F.element_at(F.array(*map(F.lit, ("log", "tmp", "txt"))), (k % 3 + 1).cast("int"))).alias("path"))
    rules = spark.createDataFrame([(".gitignore", bytearray(b"# own\n*.log\n!f*5.log\n/src/a3/\nb4/\n")), ("src/a1/.gitignore", bytearray(b"!*.log\n*.txt\n"))], "path string, content binary")
    return ignores.unignored(tree, ignores.rules_of(rules))


_SUPPLIED = "s AS (SELECT s_suppkey AS k, unnest(range(s_suppkey % 4 + 1)) AS ordinal FROM supplier)"


@query(f"""WITH {_SUPPLIED} SELECT 'oci' AS kind, 'i' || k || '/' AS root, ordinal, 'sha256:l' || k || '-' || ordinal AS digest, 'sha256:d' || ordinal AS diff_id, CASE WHEN ordinal < 3 THEN 'RUN ' || ordinal END AS created_by FROM s WHERE k % 3 > 0
  UNION ALL SELECT 'saved', 'i' || k || '/', ordinal, 'l' || ordinal || '/layer.tar', 'sha256:d' || ordinal, CASE WHEN ordinal < 3 THEN 'RUN ' || ordinal END FROM s WHERE k % 3 = 0""")
def image_layers(spark: SparkSession, d: str) -> DataFrame:
    """One image a supplier: an OCI layout with one platform of two, or a saved archive; three build steps with one that makes no layer between."""
    k = F.col("s_suppkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    numbers = F.sequence(F.lit(0).cast("long"), k % 4)
    listed = lambda f: F.array_join(F.transform(numbers, f), ",")
    config = text('{"history":[{"created_by":"RUN 0"},{"created_by":"ENV x","empty_layer":true},{"created_by":"RUN 1"},{"created_by":"RUN 2"}],"rootfs":{"diff_ids":[', listed(lambda i: text('"sha256:d', i, '"')), "]}}")
    s = D.table(spark, d, "supplier")
    file = lambda rows, name, body: rows.select(text("i", k, "/", name).alias("path"), body.cast("binary").alias("content"))
    oci, saved = s.where(k % 3 > 0), s.where(k % 3 == 0)
    files = file(oci, "index.json", text('{"manifests":[{"digest":"sha256:m', k, '","platform":{"os":"linux","architecture":"amd64"}},{"digest":"sha256:x","platform":{"os":"linux","architecture":"arm64"}}]}'))
    layers = text('{"config":{"digest":"sha256:cfg"},"layers":[', listed(lambda i: text('{"digest":"sha256:l', k, "-", i, '"}')), "]}")
    files = files.unionByName(oci.select(text("i", k, "/blobs/sha256/m", k).alias("path"), layers.cast("binary").alias("content")))
    files = files.unionByName(file(oci, "blobs/sha256/cfg", config)).unionByName(file(saved, "c.json", config))
    files = files.unionByName(file(saved, "manifest.json", text('[{"Config":"c.json","Layers":[', listed(lambda i: text('"l', i, '/layer.tar"')), "]}]")))
    found = images.oci_layers(files, images.chosen(images.platforms_of(files))).select(F.lit("oci").alias("kind"), "*")
    return found.unionByName(images.saved_layers(files).select(F.lit("saved").alias("kind"), "*"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS k, p_partkey AS anc, 0 AS depth FROM part UNION ALL SELECT k, anc // 10, depth + 1 FROM w WHERE anc >= 10),
  r AS (SELECT k, arg_min(anc, depth) FILTER (anc % 3 = 0 OR anc < 10) AS v, arg_min(anc, depth) FILTER (anc % 4 = 0) AS m FROM w GROUP BY 1)
  SELECT '/p/' || k || '/pom.xml' AS path, 'g:dep' AS name, 'x' || v AS version FROM r UNION ALL SELECT '/p/' || k || '/pom.xml', 'g:other', 'm' || m FROM r""")
def effective_poms(spark: SparkSession, d: str) -> DataFrame:
    """A tree of projects, each the child of a tenth of its number: properties from some of them, managed versions from others."""
    k = F.col("p_partkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    parent = F.when(k >= 10, text("<parent><groupId>g</groupId><artifactId>lib", F.floor(k / 10), "</artifactId><version>1</version></parent>")).otherwise("")
    own = F.when((k % 3 == 0) | (k < 10), text("<properties><v>", k, "</v></properties>")).otherwise("")
    managed = F.when(k % 4 == 0, text("<dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>other</artifactId><version>m", k, "</version></dependency></dependencies></dependencyManagement>")).otherwise("")
    needs = "<dependencies><dependency><groupId>g</groupId><artifactId>dep</artifactId><version>x${v}</version></dependency><dependency><groupId>g</groupId><artifactId>other</artifactId></dependency></dependencies>"
    body = text("<project><groupId>g</groupId><artifactId>lib", k, "</artifactId><version>1</version>", parent, own, managed, needs, "</project>")
    files = D.table(spark, d, "part").select(text("/p/", k, "/pom.xml").alias("path"), body.cast("binary").alias("content"))
    return poms.effective_needs(files).select("path", "name", "version")
