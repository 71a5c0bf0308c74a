"""Lookups that tie observations, references, locks and build history to components.

Every fallback chain (exact name, then token, then alias; nearest folder first) is one
equi-join on exploded keys with their rank, not a join for each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.versions import semver_satisfies

#: Library tokens whose package has another name.
ALIASES = {"ssl": "openssl", "crypto": "openssl", "z": "zlib", "c": "glibc", "stdc++": "gcc"}
#: How a dependency's range begins where it names no registry version.
NO_RANGE = ("file:", "link:", "git", "npm:", "workspace:", "http")


def library_token(path: Column) -> Column:
    """libssl.so.3 -> ssl, libfoo-1.2.so -> foo."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "^lib", "")
    return F.lower(F.regexp_replace(F.regexp_replace(base, r"\.so[.\d]*$", ""), r"[-.]\d+(\.\d+)*$", ""))


def attributed(paths: DataFrame, components: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(path, component_id) of loaded files: a component named as the file, as its library token, or as the token's alias.

    ``paths`` has path, ``components`` id, name. Of components with one name the least id
    counts; a path that fits none has no row.
    """
    known = F.create_map(*(F.lit(x) for kv in (aliases or ALIASES).items() for x in kv))
    token = library_token(F.col("path"))
    keys = F.array(F.lower(F.element_at(F.split("path", "/"), -1)), token, F.try_element_at(known, token))
    asked = paths.select("path").distinct().select("path", F.posexplode(keys).alias("rank", "key"))
    index = components.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    return asked.join(index, "key").groupBy("path").agg(F.min_by("id", "rank").alias("component_id"))


def listening_ports(sockets: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(pid, port): the listening sockets (inode, port, state) that a process holds open (pid, inode)."""
    return sockets.where("state = 'LISTEN'").join(descriptors, "inode").select("pid", "port").distinct()


def running(processes: DataFrame, components: DataFrame, ports: DataFrame) -> DataFrame:
    """(component_id, exe, ports) of components that processes (pid, exe, path) run or load; ports in ascending order."""
    hits = processes.join(attributed(processes, components), "path").join(ports, "pid", "left")
    return hits.groupBy("component_id").agg(F.min("exe").alias("exe"), F.array_join(F.transform(F.array_sort(F.collect_set("port")), lambda p: p.cast("string")), ",").alias("ports"))


def resolved_refs(refs: DataFrame, components: DataFrame, projects: DataFrame) -> DataFrame:
    """(ref, target): what ``purl:``, ``family:type/name``, ``resource:name`` and ``project:path`` stand for; null: nothing.

    A family with several components stands for the one of highest tier, then version as
    text, then least id. ``components`` has id, purl, ecosystem, name, version, tier,
    ctype; ``projects`` id, path.
    """
    rank = F.struct("tier", F.coalesce("version", F.lit("")).alias("version"), -F.col("id"))
    family = F.concat(F.lit("family:"), "ecosystem", F.lit("/"), F.lower("name"))
    keys = F.array_compact(F.array(F.concat(F.lit("purl:"), "purl"), family, F.when(F.col("ctype") == "resource", F.concat(F.lit("resource:"), "name"))))
    of_components = components.select(F.explode(keys).alias("key"), F.col("id").alias("target"), rank.alias("rank")).groupBy("key").agg(F.max_by("target", "rank").alias("target"))
    of_projects = projects.groupBy(F.concat(F.lit("project:"), F.coalesce(F.nullif("path", F.lit("")), F.lit("."))).alias("key")).agg(F.min("id").alias("target"))
    place = F.when(F.col("ref").startswith("family:"), F.concat(F.substring_index("ref", "/", 1), F.lit("/"), F.lower(F.expr("substring(ref, instr(ref, '/') + 1)")))).when(F.col("ref") == "project:", "project:.").otherwise(F.col("ref"))
    return refs.withColumn("key", place).join(of_components.unionByName(of_projects), "key", "left").select("ref", "target")


def verified_locks(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """(name, requested, locked, satisfied) of the names that both have; ranges that name no registry version are left out."""
    asked = declared.where(~F.coalesce(F.col("requested").rlike("^(" + "|".join(NO_RANGE) + ")"), F.lit(False)))
    return asked.join(locked.withColumnRenamed("version", "locked"), "name").select("name", "requested", "locked", semver_satisfies("locked", "requested").alias("satisfied"))


def enriched(components: DataFrame, metadata: DataFrame) -> DataFrame:
    """Components with the metadata (name, version, attrs) they lack; an attribute they have is never overwritten."""
    found = components.join(metadata.select("name", "version", F.col("attrs").alias("_new")), ["name", "version"], "left")
    new = F.map_filter(F.coalesce("_new", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~F.map_contains_key("attrs", k))
    return found.withColumn("attrs", F.map_concat("attrs", new)).drop("_new").select(*components.columns)


def linked_history(history: DataFrame, layers: DataFrame) -> DataFrame:
    """(image, ordinal, created_by): the build steps that made layers, one after the other; steps with no layer are skipped.

    ``history`` has image, position, created_by, empty; ``layers`` image, ordinal. A layer
    beyond the recorded steps has an empty one.
    """
    turn = F.row_number().over(Window.partitionBy("image").orderBy("position")) - 1
    made = history.where(~F.coalesce("empty", F.lit(False))).select("image", turn.alias("ordinal"), "created_by")
    return layers.select("image", "ordinal").join(made, ["image", "ordinal"], "left").select("image", "ordinal", F.coalesce("created_by", F.lit("")).alias("created_by"))


def squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def linked_dockerfile(history: DataFrame, lines: DataFrame) -> DataFrame:
    """(image, ordinal, line): build steps (image, ordinal, command) at equal instructions (image, line, instruction).

    Blanks and letter case don't count; the n-th of equal steps takes the n-th equal line.
    """
    turn = lambda key: F.row_number().over(Window.partitionBy("image", "text").orderBy(key))
    steps = history.where("command <> ''").withColumn("text", squeezed(F.col("command"))).withColumn("turn", turn("ordinal"))
    there = lines.withColumn("text", squeezed(F.col("instruction"))).withColumn("turn", turn("line")).select("image", "text", "turn", "line")
    hits = steps.join(there, ["image", "text", "turn"]).select("image", "ordinal", "line")
    return history.select("image", "ordinal").join(hits, ["image", "ordinal"], "left")


def nearest_installed(requests: DataFrame, installed: DataFrame) -> DataFrame:
    """(key, dependency, target): the copy that a package at ``key`` loads: in its own node_modules, else in the nearest folder's above.

    ``requests`` has key, dependency; ``installed`` key. Null target: nowhere.
    """
    parts = F.split("key", "/?node_modules/")
    bases = F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), k), "/node_modules/"), "^/", "")))
    asked = requests.select("key", "dependency", F.posexplode(bases).alias("rank", "base"))
    asked = asked.withColumn("target", F.concat(F.when(F.col("base") == "", F.lit("")).otherwise(F.concat("base", F.lit("/"))), F.lit("node_modules/"), "dependency"))
    hits = asked.join(installed.select(F.col("key").alias("target")).distinct(), "target").groupBy("key", "dependency").agg(F.min_by("target", "rank").alias("target"))
    return requests.join(hits, ["key", "dependency"], "left").select("key", "dependency", "target")


def license_mismatches(declared: DataFrame, detected: DataFrame) -> DataFrame:
    """(project, declared, detected) where a project's manifest and its licence file differ; both have project, license."""
    a, b = declared.select("project", F.col("license").alias("declared")), detected.select("project", F.col("license").alias("detected"))
    return a.join(b, "project").where(F.lower("declared") != F.lower("detected"))


def beyond_required(sums: DataFrame, requires: DataFrame) -> DataFrame:
    """Module versions with a recorded checksum that nothing requires; both have module, version."""
    return sums.select("module", "version").distinct().join(requires, ["module", "version"], "left_anti")


def grafted(components: DataFrame, edges: DataFrame, image: DataFrame, image_edges: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Components and edges with an image's own below component ``at``: new ids follow the old ones, roots hang on a CONTAINS edge.

    Components have an id, edges kind, src, dst.
    """
    top = int(components.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1  # one number
    moved = image.withColumn("id", F.col("id") + top)
    inner = image_edges.withColumn("src", F.col("src") + top).withColumn("dst", F.col("dst") + top)
    roots = moved.join(inner.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    links = roots.select(F.lit("CONTAINS").alias("kind"), F.lit(at).cast("long").alias("src"), F.col("id").cast("long").alias("dst"))
    return components.unionByName(moved, allowMissingColumns=True), edges.unionByName(inner, allowMissingColumns=True).unionByName(links, allowMissingColumns=True)
