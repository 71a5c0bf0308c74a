"""Graph queries by recursive joins on edge tables, one level of the graph a round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.scratch import materialize

MAX_DEPTH = 25
#: Rounds after which what was seen is written as one table, so that plans of long walks stay short.
COMPACT = 8


def extras_gated(marker: str = "marker") -> Column:
    """Whether an edge only counts with an extra asked for."""
    return F.coalesce(F.col(marker).rlike(r"\bextra\s*=="), F.lit(False))


def paths_to_roots(edges: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(target, path, complete) for each way from a root down to each target; no node twice.

    ``targets`` has a column id. Grows paths upward by one edge a round; those that reach
    a node without incoming edges are complete. What has ``max_depth`` nodes and no root
    yet comes with complete false: the ways on from there aren't enumerated. A target with
    only cyclic parents has none. One table is written a round.
    """
    links = materialize(edges.select("src", "dst").distinct(), "links").hint("merge")
    below = links.select(F.col("dst").alias("below")).distinct().hint("merge")
    ways = targets.select(F.col("id").alias("target"), F.array(F.col("id").cast("long")).alias("path"), F.col("id").cast("long").alias("head"))
    done = None
    for depth in range(1, max_depth + 1):
        marked = ways.hint("merge").join(below, F.col("head") == F.col("below"), "left").select("target", "path", "head", F.col("below").isNull().alias("complete"))
        ways = materialize(marked, "paths")
        ends = ways.select("target", "path", "complete")
        ends = ends if depth == max_depth else ends.where("complete")
        done = ends if done is None else done.unionByName(ends)
        ways = ways.where("not complete")
        if depth == max_depth or ways.isEmpty():
            break
        ways = ways.hint("merge").join(links, F.col("head") == F.col("dst")).where(~F.array_contains("path", F.col("src"))).select("target", F.concat(F.array(F.col("src").cast("long")), "path").alias("path"), F.col("src").cast("long").alias("head"))
    return done


def paths_between(components: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """Paths from roots whose label matches ``start`` to the components that ``end`` finds, shortest first."""
    from quillgraph.operators.analytics import find_component

    targets = find_component(components, end).select("id")
    found = paths_to_roots(edges, targets).where("complete")
    root = F.element_at("path", 1)
    label = F.coalesce("name", F.concat(F.lit("project:"), F.col("root").cast("string")))
    glob = "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in start) + "$"
    named = found.withColumn("root", root).join(components.select(F.col("id").alias("cid"), "name"), F.col("root") == F.col("cid"), "left").withColumn("label", label)
    return named.where((F.col("label") == start) | F.col("label").rlike(glob)).select("target", "path", F.size("path").alias("length"), F.col("label").alias("root")).orderBy("length", "path")


def reachable(edges: DataFrame, roots: DataFrame, follow_extras: bool = False) -> DataFrame:
    """(node, depth) of all nodes that ``roots`` (id) reach, at their least depth, however deep; gated edges count if asked for."""
    links = edges if follow_extras else edges.where(~extras_gated())
    links = links.select("src", "dst").distinct()
    seen = materialize(roots.select(F.col("id").cast("long").alias("node"), F.lit(0).alias("depth")).distinct(), "reach")
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").cast("long").alias("node")).distinct()
        step = materialize(step.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")), "reach")
        if step.isEmpty():
            break
        frontier = step
        seen = seen.unionByName(step)
        if depth % COMPACT == 0:
            seen = materialize(seen, "reach-all")
    return seen


def gated_only(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that only gated edges reach."""
    return reachable(edges, roots, follow_extras=True).join(reachable(edges, roots), "node", "left_anti")


def minimal_versions(requires: DataFrame, roots: DataFrame, sort_key: Column | None = None) -> DataFrame:
    """Minimal version selection: of all (module, version) reached, each module's highest version.

    ``requires`` has module, version, dep_module, dep_version; ``roots`` module, version.
    """
    seen = materialize(roots.select("module", "version").distinct(), "mvs")
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = frontier.join(requires, ["module", "version"]).select(F.col("dep_module").alias("module"), F.col("dep_version").alias("version")).distinct()
        step = materialize(step.join(seen, ["module", "version"], "left_anti"), "mvs")
        if step.isEmpty():
            break
        frontier = step
        seen = seen.unionByName(step)
        if depth % COMPACT == 0:
            seen = materialize(seen, "mvs-all")
    key = sort_key if sort_key is not None else F.transform(F.split("version", r"\."), lambda x: x.cast("long"))
    return seen.groupBy("module").agg(F.max_by("version", key).alias("version"))


def nearest_versions(requires: DataFrame, roots: DataFrame, managed: DataFrame | None = None) -> DataFrame:
    """(module, version, depth): nearest wins, the version of least depth for each module, ties by order; ``managed`` (module, version) overrides.

    ``requires`` has module, version, dep_module, dep_version, seq; ``roots`` module,
    version, seq. Goes down a level a round, from each (module, version) once, until
    nothing is new. Of a level, order is that of the seq numbers on the way from the root.
    """
    frontier = roots.select("module", "version", F.array(F.col("seq").cast("long")).alias("way"))
    best, seen, depth = None, None, 0
    while True:
        depth += 1
        level = frontier.groupBy("module", "version").agg(F.min("way").alias("way"))
        level = materialize(level if seen is None else level.join(seen, ["module", "version"], "left_anti"), "nearest")
        if level.isEmpty():
            break
        picked = level.groupBy("module").agg(F.min_by("version", "way").alias("version")).withColumn("depth", F.lit(depth))
        if best is not None:
            picked = picked.join(best.select("module"), "module", "left_anti")
        picked = materialize(picked, "nearest-best")
        best = picked if best is None else best.unionByName(picked)
        mine = level.select("module", "version")
        seen = mine if seen is None else seen.unionByName(mine)
        if depth % COMPACT == 0:
            best, seen = materialize(best, "nearest-best"), materialize(seen, "nearest-seen")
        frontier = level.join(requires, ["module", "version"]).select(F.col("dep_module").alias("module"), F.col("dep_version").alias("version"), F.concat("way", F.array(F.col("seq").cast("long"))).alias("way"))
    if best is None:
        best = roots.select("module", "version", F.lit(0).alias("depth")).limit(0)
    if managed is not None:
        best = best.join(managed.select("module", F.col("version").alias("m")), "module", "left").withColumn("version", F.coalesce("m", "version")).drop("m")
    return best.select("module", "version", "depth")


def scopes_by_reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, scope): runtime where ungated edges reach, conditional where only gated ones do."""
    plain = reachable(edges, roots).select("node", F.lit("runtime").alias("scope"))
    gated = gated_only(edges, roots).select("node", F.lit("conditional").alias("scope"))
    return plain.unionByName(gated)




def resolved_ranges(declared: DataFrame, published: DataFrame, dependencies: DataFrame, max_depth: int = 50) -> tuple[DataFrame, DataFrame]:
    """Dependency ranges resolved breadth first, a level a round: edges (parent, name, wanted, version) and what is incomplete (name, wanted, reason).

    ``declared`` has name, wanted; ``published`` name, versions (an array); ``dependencies``
    name, version, dep_name, dep_wanted. The first request in order (level, then the names
    on its way) decides a name's version; a later one takes that if it fits its range,
    else its own highest. Each (name, version) is expanded once.
    """
    from quillgraph.functions.versions import semver_max_satisfying, semver_satisfies

    spark = declared.sparkSession
    asked = declared.select(F.lit("").alias("parent"), "name", "wanted", F.array("name").alias("way"))
    chosen = spark.createDataFrame([], "name string, main string")
    grown = spark.createDataFrame([], "name string, version string")
    edges, gaps = None, None
    for depth in range(max_depth + 1):
        asked = materialize(asked, "ranges")
        if asked.isEmpty():
            break
        picked = materialize(asked.hint("merge").join(published.hint("merge"), "name", "left").withColumn("own", semver_max_satisfying("versions", "wanted")).withColumn("known", F.coalesce(F.size("versions"), F.lit(0)) > 0).drop("versions"), "ranges-own")
        first = picked.where("own is not null").groupBy("name").agg(F.min_by("own", "way").alias("main")).hint("merge").join(chosen.hint("merge"), "name", "left_anti")
        chosen = materialize(chosen.unionByName(first), "ranges-chosen")
        both = picked.hint("merge").join(chosen.hint("merge"), "name", "left").withColumn("fits", F.coalesce(semver_satisfies("main", "wanted"), F.lit(False)))
        version = F.when(F.col("fits"), F.col("main")).otherwise(F.col("own"))
        done = materialize(both.withColumn("version", version), "ranges-done")
        found = done.where("version is not null").select("parent", "name", "wanted", "version")
        missing = done.where("version is null").select("name", "wanted", F.when(F.col("known"), "no published version fits").otherwise("no metadata").alias("reason"))
        edges = found if edges is None else edges.unionByName(found)
        gaps = missing if gaps is None else gaps.unionByName(missing)
        fresh = done.where("version is not null").groupBy("name", "version").agg(F.min("way").alias("way")).hint("merge").join(grown.hint("merge"), ["name", "version"], "left_anti")
        fresh = materialize(fresh, "ranges-new")
        grown = grown.unionByName(fresh.select("name", "version"))
        asked = fresh.hint("merge").join(dependencies.hint("merge"), ["name", "version"]).select(F.col("name").alias("parent"), F.col("dep_name").alias("name"), F.col("dep_wanted").alias("wanted"), F.concat("way", F.array("dep_name")).alias("way"))
    else:
        gaps = gaps.unionByName(asked.select("name", "wanted", F.lit("deeper than the limit").alias("reason")))
    if edges is None:
        return spark.createDataFrame([], "parent string, name string, wanted string, version string"), spark.createDataFrame([], "name string, wanted string, reason string")
    return edges.distinct(), gaps.distinct()


def explained(components: DataFrame, edges: DataFrame, evidence: DataFrame, ref: str, most: int = 5, most_paths: int = 8) -> DataFrame:
    """(id, kind, place, text): why components are there: their ways from roots (shortest first), then their evidence (highest tier first).

    The first ``most`` components that ``ref`` finds, by name, version and id, and up to
    ``most_paths`` ways of more than one node for each.
    """
    from pyspark.sql import Window

    from quillgraph.operators.analytics import display_ref, find_component

    chosen = materialize(find_component(components, ref).orderBy("name", "version", "id").limit(most).select("id", display_ref().alias("ref")), "explain")
    labels = components.select(F.col("id").alias("node"), display_ref().alias("label"))
    ways = paths_to_roots(edges, chosen).where("complete").where(F.size("path") > 1).withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.size("path"), "path"))).where(F.col("place") <= most_paths)
    steps = ways.select("target", "place", F.posexplode("path").alias("step", "node")).join(labels, "node", "left")
    named = F.struct("step", F.coalesce("label", F.concat(F.lit("project:"), F.col("node").cast("string"))).alias("label"))
    told = steps.groupBy("target", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: x.label), " > ").alias("text")).select(F.col("target").alias("id"), F.lit("path").alias("kind"), "place", "text")
    order = Window.partitionBy("component_id").orderBy(F.desc("tier"), F.desc("confidence"), "finding_id", "ordinal")
    seen = evidence.join(chosen.select(F.col("id").alias("component_id")), "component_id", "left_semi").withColumn("place", F.row_number().over(order))
    facts = seen.select(F.col("component_id").alias("id"), F.lit("evidence").alias("kind"), "place", F.concat_ws(" ", F.col("tier").cast("string"), F.format_string("%.2f", "confidence"), "path").alias("text"))
    return told.unionByName(facts)
