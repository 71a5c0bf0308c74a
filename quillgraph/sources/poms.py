"""Maven project files with what they inherit: parents, properties, managed versions and imported lists, by joins on coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.scratch import materialize
from quillgraph.sources.grammars_locks import parsed_xml
from quillgraph.sources.lockfiles import dealt

_ENTRY = "struct<grp:string,name:string,version:string,scope:string,kind:string,optional:boolean>"
_POM = f"path string, grp string, name string, version string, parent struct<grp:string,name:string,version:string>, properties map<string,string>, managed array<{_ENTRY}>, needs array<{_ENTRY}>"


def _entry(d) -> dict:
    return {"grp": d.findtext("groupId"), "name": d.findtext("artifactId"), "version": d.findtext("version"), "scope": d.findtext("scope"), "kind": d.findtext("type"), "optional": d.findtext("optional") == "true"}


def read_poms(files: DataFrame) -> DataFrame:
    """One row a project file of ``files`` (path, content): coordinates, parent, properties, managed and needed packages as written. Files that can't be read have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    root = parsed_xml(bytes(content).decode("utf-8", "replace"))
                except (ValueError, SyntaxError):
                    continue
                p = root.find("parent")
                parent = None if p is None else {"grp": p.findtext("groupId"), "name": p.findtext("artifactId"), "version": p.findtext("version")}
                own = {e.tag: e.text or "" for e in root.findall("properties/*")}
                entries = lambda at: [_entry(d) for d in root.findall(at)]  # noqa: B023, E731
                rows.append((path, root.findtext("groupId") or (parent or {}).get("grp"), root.findtext("artifactId"), root.findtext("version") or (parent or {}).get("version"), parent, own, entries("dependencyManagement/dependencies/dependency"), entries("dependencies/dependency")))
            yield pd.DataFrame(rows, columns=["path", "grp", "name", "version", "parent", "properties", "managed", "needs"])

    return dealt(files.where(F.col("path").rlike(r"(^|/)pom\.xml$|\.pom$")).select("path", "content")).mapInPandas(run, _POM)


def _filled(text: Column, properties: Column, times: int = 3) -> Column:
    """``${name}`` by its property; values may name further ones, ``times`` deep."""
    for _ in range(times):
        text = F.aggregate(F.map_entries(properties), text, lambda t, e: F.replace(t, F.concat(F.lit("${"), e.key, F.lit("}")), e.value))
    return text


def _over(old: Column, new: Column) -> Column:
    """A map with another's entries over its own."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def _key(c: str = "") -> Column:
    return F.concat_ws(":", *(F.col(f"{c}{x}") for x in ("grp", "name", "version")))


def inherited(poms: DataFrame) -> DataFrame:
    """``read_poms`` with each project's ancestors' properties and managed packages, nearer ones first; a level a round, a parent that is missing or comes again ends the way."""
    known = materialize(poms.dropDuplicates(["grp", "name", "version"]).select(_key().alias("key"), F.col("properties").alias("more"), F.col("managed").alias("theirs"), F.col("parent").alias("above")), "poms")
    rows = poms.withColumn("seen", F.array(_key())).withColumn("next", F.col("parent"))
    done = None
    while True:
        rows = materialize(rows, "poms-up")
        open_ones = rows.where("next is not null")
        ends = rows.where("next is null")
        done = ends if done is None else done.unionByName(ends)
        if open_ones.isEmpty():
            break
        up = open_ones.withColumn("up", _key("next.")).hint("merge").join(known.hint("merge"), F.col("up") == F.col("key"), "left")
        again = F.array_contains("seen", F.col("up"))
        rows = up.select("path", "grp", "name", "version", "parent", F.when(F.col("key").isNull() | again, F.col("properties")).otherwise(_over(F.coalesce("more", F.create_map().cast("map<string,string>")), F.col("properties"))).alias("properties"), F.when(F.col("key").isNull() | again, F.col("managed")).otherwise(F.concat("managed", F.coalesce("theirs", F.array().cast(f"array<{_ENTRY}>")))).alias("managed"), "needs", F.concat("seen", F.array("up")).alias("seen"), F.when(~again, F.col("above")).alias("next"))
    whole = F.map_from_arrays(F.array(*map(F.lit, ("project.version", "project.groupId", "project.artifactId", "project.parent.version", "project.parent.groupId"))), F.array(*(F.coalesce(F.col(c), F.lit("")) for c in ("version", "grp", "name", "parent.version", "parent.grp"))))
    return done.drop("seen", "next").withColumn("properties", _over(F.col("properties"), whole))


def effective_needs(files: DataFrame) -> DataFrame:
    """(path, name, version, scope, optional) of what each project file needs, with inherited and imported versions and properties filled in.

    A version of a need's own counts first, then the nearest managed one, then one of an
    imported list (in the order of imports, their own imports after them). No version
    where nobody tells.
    """
    closed = materialize(inherited(materialize(read_poms(files), "poms-read")), "poms-closed")
    entry = lambda e, p: F.struct(_filled(e.grp, p).alias("grp"), _filled(e["name"], p).alias("name"), _filled(e.version, p).alias("version"), e.scope.alias("scope"), e.kind.alias("kind"), e.optional.alias("optional"))
    filled = closed.select("path", _key().alias("key"), F.transform("managed", lambda e: entry(e, F.col("properties"))).alias("managed"), F.transform("needs", lambda e: entry(e, F.col("properties"))).alias("needs"))
    filled = materialize(filled, "poms-filled")
    lists = materialize(filled.groupBy("key").agg(F.min_by("managed", "path").alias("managed")), "poms-lists")
    told = filled.select("path", F.posexplode("managed").alias("turn", "m")).select("path", F.array(F.col("turn")).alias("order"), "m")
    out, level = None, told
    seen = None
    while True:
        level = materialize(level, "poms-managed")
        plain = level.where("m.scope is null or m.scope <> 'import'").select("path", "order", "m")
        out = plain if out is None else out.unionByName(plain)
        asked = level.where("m.scope = 'import'").select("path", "order", F.concat_ws(":", "m.grp", "m.name", "m.version").alias("list")).groupBy("path", "list").agg(F.min("order").alias("order"))
        asked = asked if seen is None else asked.hint("merge").join(seen.hint("merge"), ["path", "list"], "left_anti")
        asked = materialize(asked, "poms-imports")
        if asked.isEmpty():
            break
        mine = asked.select("path", "list")
        seen = mine if seen is None else seen.unionByName(mine)
        level = asked.hint("merge").join(lists.hint("merge"), F.col("list") == F.col("key")).select("path", "order", F.posexplode("managed").alias("turn", "m")).select("path", F.concat("order", F.array("turn")).alias("order"), "m")
    best = out.groupBy("path", F.col("m.grp").alias("grp"), F.col("m.name").alias("name")).agg(F.min_by(F.struct(F.col("m.version").alias("version"), F.col("m.scope").alias("scope")), F.struct(F.size("order"), "order")).alias("told"))
    needs = filled.select("path", F.explode("needs").alias("n")).select("path", "n.grp", "n.name", F.col("n.version").alias("own"), F.col("n.scope").alias("own_scope"), "n.optional")
    joined = needs.hint("merge").join(best.hint("merge"), ["path", "grp", "name"], "left")
    return joined.select("path", F.concat_ws(":", "grp", "name").alias("name"), F.coalesce("own", "told.version").alias("version"), F.coalesce("own_scope", "told.scope", F.lit("compile")).alias("scope"), F.coalesce("optional", F.lit(False)).alias("optional"))
