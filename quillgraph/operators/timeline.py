"""States of things over ordered layers: transitions, owners, first sight, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_family() -> Window:
    return Window.partitionBy("family").orderBy("ordinal")


def snapshot_timeline(states: DataFrame) -> DataFrame:
    """(family, kind, old_version, old_ordinal, new_version, new_ordinal): upgrades and removals between following ordinals.

    ``states`` has ordinal, family, version; a family missing at an ordinal that others
    have is removed there. old_ordinal is where the old version was first in its run.
    """
    following = states.select("ordinal").distinct().withColumn("next", F.lead("ordinal").over(Window.orderBy("ordinal")))  # one row an ordinal
    w = by_family()
    seen = states.join(F.broadcast(following), "ordinal").withColumn("prev", F.lag("version").over(w)).withColumn("prev_next", F.lag("next").over(w))
    fresh = F.col("prev").isNull() | (F.col("prev") != F.col("version")) | (F.col("prev_next") != F.col("ordinal"))
    seen = seen.withColumn("since", F.last(F.when(fresh, F.col("ordinal")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    seen = seen.withColumn("then", F.lead("ordinal").over(w)).withColumn("then_version", F.lead("version").over(w))
    goes_on = F.col("then") == F.col("next")
    kind = F.when(F.col("next").isNull(), None).when(~F.coalesce(goes_on, F.lit(False)), "removed").when(F.col("then_version") != F.col("version"), "upgraded")
    return seen.select("family", kind.alias("kind"), F.col("version").alias("old_version"), F.col("since").alias("old_ordinal"), F.when(kind == "upgraded", F.col("then_version")).alias("new_version"), F.col("next").alias("new_ordinal")).where("kind is not null")


def first_seen(states: DataFrame) -> DataFrame:
    return states.groupBy("family", "version").agg(F.min("ordinal").alias("first_ordinal"))


def owners_upto(states: DataFrame, upto: int) -> DataFrame:
    """The last state of each family at or before an ordinal."""
    return states.where(F.col("ordinal") <= upto).groupBy("family").agg(F.max("ordinal").alias("ordinal"), F.max_by("version", "ordinal").alias("version"))


def introducing(components: DataFrame, states: DataFrame, layers: DataFrame) -> DataFrame:
    """The layer (ordinal, digest) that first had a component's version (family, version)."""
    return components.join(first_seen(states), ["family", "version"]).join(layers, F.col("first_ordinal") == F.col("ordinal")).select("family", "version", "first_ordinal", "digest")


def layer_transitions(members: DataFrame) -> DataFrame:
    """(path, ordinal, state) of an image's layers: added, modified, removed, opaque-cleared.

    ``members`` has ordinal and path; ``dir/.wh.name`` deletes dir/name and all below it,
    ``dir/.wh..wh..opq`` clears dir. Deletions act on lower layers only, before their own
    layer's additions. Prefixes are joined on exploded ancestors, not by string search.
    """
    base = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    marked = members.select("ordinal", "path", base.alias("base"), folder.alias("folder"))
    files = marked.where(~F.col("base").startswith(".wh.")).select("ordinal", "path")
    gone = F.when(F.col("folder") == "", F.substring("base", 5, 1 << 20)).otherwise(F.concat("folder", F.lit("/"), F.substring("base", 5, 1 << 20)))
    opaque = F.col("base") == ".wh..wh..opq"
    cuts = marked.where(F.col("base").startswith(".wh.")).select(F.col("ordinal").alias("cut_ordinal"), F.when(opaque, F.col("folder")).otherwise(gone).alias("cut"), opaque.alias("opaque"))
    parts = F.split("path", "/")
    prefixes = files.select("path", "ordinal", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("cut"))
    hits = prefixes.join(cuts, "cut").where((F.col("cut_ordinal") > F.col("ordinal")) & ~(F.col("opaque") & (F.col("cut") == F.col("path"))))
    hits = hits.groupBy("path", "cut_ordinal").agg(F.max("ordinal").alias("of"), F.bool_and("opaque").alias("opaque"))
    kinds = files.select("path", "ordinal", F.lit(1).alias("step"), F.lit(None).cast("string").alias("cut")).distinct()
    ends = hits.select("path", F.col("cut_ordinal").alias("ordinal"), F.lit(0).alias("step"), F.when(F.col("opaque"), "opaque-cleared").otherwise("removed").alias("cut"))
    order = Window.partitionBy("path").orderBy("ordinal", "step")
    log = kinds.unionByName(ends).withColumn("before", F.lag("step").over(order))
    there = F.coalesce(F.col("before") == 1, F.lit(False))
    state = F.when(F.col("step") == 1, F.when(there, "modified").otherwise("added")).when(there, F.col("cut"))
    return log.select("path", "ordinal", state.alias("state")).where("state is not null")


def layers_pivot(transitions: DataFrame) -> DataFrame:
    """Files added, modified and removed by each layer."""
    n = lambda s: F.count_if(F.col("state") == s)
    return transitions.groupBy("ordinal").agg(n("added").alias("added"), n("modified").alias("modified"), n("removed").alias("removed"))


def base_split(components: DataFrame, boundary: int) -> DataFrame:
    return components.groupBy(F.when(F.col("ordinal") < boundary, "base").otherwise("added").alias("origin")).agg(F.count("*").alias("count"))


def lineage(runs: DataFrame) -> DataFrame:
    """Each run's document version: a new one wherever the serial differs from the run before.

    ``runs`` has subject, created, run_id, serial.
    """
    w = Window.partitionBy("subject").orderBy("created", "run_id")
    new = F.when(F.lag("serial").over(w).isNull() | (F.lag("serial").over(w) != F.col("serial")), 1).otherwise(0)
    marked = runs.withColumn("new", new)
    reason = F.when(F.col("version") == 1, F.when(F.col("new") == 1, "initial").otherwise("identical")).when(F.col("new") == 0, "identical").otherwise("subject-changed")
    return marked.withColumn("version", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select("subject", "run_id", "version", reason.alias("reason"))


def latest_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("subject").agg(F.max_by("run_id", F.struct("created", "run_id")).alias("run_id"))


def prune_least_used(entries: DataFrame, budget: int) -> DataFrame:
    """Keys to drop, least recently used first, until the rest fits the budget of its shelf.

    ``entries`` has shelf, key, size, last_used; an entry goes if those used after it,
    with itself, are larger than the budget.
    """
    w = Window.partitionBy("shelf").orderBy(F.desc("last_used"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("held", F.sum("size").over(w)).where(F.col("held") > budget).select("shelf", "key")


def merged_databases(states: DataFrame) -> DataFrame:
    """(ordinal, family, version) over several databases (path, ordinal, family, version): the last path wins."""
    return states.groupBy("ordinal", "family").agg(F.max_by("version", "path").alias("version"))


def database_timeline(states: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``snapshot_timeline`` of each database (path); ``snapshots`` (path, ordinal) also has those at which it is empty."""
    following = snapshots.select("path", "ordinal").distinct().withColumn("next", F.lead("ordinal").over(Window.partitionBy("path").orderBy("ordinal")))
    w = Window.partitionBy("path", "family").orderBy("ordinal")
    seen = states.join(following, ["path", "ordinal"]).withColumn("prev", F.lag("version").over(w)).withColumn("prev_next", F.lag("next").over(w))
    fresh = F.col("prev").isNull() | (F.col("prev") != F.col("version")) | (F.col("prev_next") != F.col("ordinal"))
    seen = seen.withColumn("since", F.last(F.when(fresh, F.col("ordinal")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    seen = seen.withColumn("then", F.lead("ordinal").over(w)).withColumn("then_version", F.lead("version").over(w)).where("next is not null")
    goes_on = F.coalesce(F.col("then") == F.col("next"), F.lit(False))
    kind = F.when(~goes_on, "removed").when(F.col("then_version") != F.col("version"), "upgraded")
    return seen.select("path", "family", kind.alias("kind"), F.col("version").alias("old_version"), F.col("since").alias("old_ordinal"), F.when(kind == "upgraded", F.col("then_version")).alias("new_version"), F.col("next").alias("new_ordinal")).where("kind is not null")


def historical(events: DataFrame, findings: DataFrame, include_removed: bool = False) -> DataFrame:
    """(path, family, version, state, layer_ordinal, removed_in_layer, confidence, excluded): a component for each version that an event ended.

    ``events`` as ``database_timeline`` makes them; ``findings`` (path, family, version,
    confidence) has the evidence of the old snapshots: an event without any has no row.
    """
    doubt = F.product(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    scored = findings.groupBy("path", "family", F.col("version").alias("old_version")).agg(F.round(F.least(1 - doubt, F.lit(0.98)), 4).alias("confidence"))
    state = F.when(F.col("kind") == "removed", "removed").otherwise("superseded")
    reason = F.lit(None).cast("string") if include_removed else F.concat(state, F.lit(" during image build"))
    return events.join(scored, ["path", "family", "old_version"]).select("path", "family", F.col("old_version").alias("version"), state.alias("state"), F.col("old_ordinal").alias("layer_ordinal"), F.col("new_ordinal").alias("removed_in_layer"), "confidence", reason.alias("excluded"))


def supersedes(events: DataFrame, components: DataFrame, history: DataFrame) -> DataFrame:
    """(src, family, old_version, layer): edges from the component that is left (family, id; the least id) to the version that an upgrade ended."""
    final = components.groupBy("family").agg(F.min("id").alias("src"))
    there = history.select("path", "family", F.col("version").alias("old_version"), F.col("removed_in_layer").alias("new_ordinal"))
    return events.where("kind = 'upgraded'").join(final, "family").join(there, ["path", "family", "old_version", "new_ordinal"], "left_semi").select("src", "family", "old_version", F.col("new_ordinal").alias("layer"))


def timeline_notes(events: DataFrame, components: DataFrame, layers: DataFrame) -> DataFrame:
    """(family, code, detail): upgrades of what is still there, and removals with the command of their layer (``layers`` ordinal, command). Layers count from 1."""
    final = components.select("family").distinct()
    ups = events.where("kind = 'upgraded'").join(final, "family", "left_semi").select("family", F.lit("pkgdb-upgraded").alias("code"), F.format_string("%s (layer %d) > %s (layer %d)", "old_version", F.col("old_ordinal") + 1, "new_version", F.col("new_ordinal") + 1).alias("detail"))
    by = F.coalesce(F.concat(F.lit(" ("), F.nullif(F.col("command"), F.lit("")), F.lit(")")), F.lit(""))
    gone = events.where("kind = 'removed'").join(layers.select(F.col("ordinal").alias("new_ordinal"), "command"), "new_ordinal", "left").select("family", F.lit("pkgdb-removed").alias("code"), F.concat(F.format_string("installed in layer %d, deleted in layer %d", F.col("old_ordinal") + 1, F.col("new_ordinal") + 1), by).alias("detail"))
    return ups.unionByName(gone)


def layer_of(components: DataFrame, states: DataFrame, evidence: DataFrame, owners: DataFrame, layers: DataFrame) -> DataFrame:
    """(id, ordinal, digest, command): the layer that brought each component, for those that have one.

    An os package comes with the first database state of its version, anything else (or one
    that no state has) with the earliest layer that owns a file of its evidence.
    ``components`` has id, ctype, family, version; ``states`` ordinal, family, version;
    ``evidence`` component_id, path; ``owners`` path, ordinal; ``layers`` ordinal, digest, command.
    """
    seen = components.where("ctype = 'os-package'").join(first_seen(states), ["family", "version"]).select("id", F.col("first_ordinal").alias("first"))
    files = evidence.join(owners, "path").groupBy(F.col("component_id").alias("id")).agg(F.min("ordinal").alias("least"))
    placed = components.select("id").join(seen, "id", "left").join(files, "id", "left").select("id", F.coalesce("first", "least").alias("ordinal")).where("ordinal is not null")
    return placed.join(layers, "ordinal", "left").select("id", "ordinal", "digest", "command")


def versions_of(transitions: DataFrame, path: str) -> DataFrame:
    """The ordinals at which layers add or change a path."""
    return transitions.where((F.col("path") == path) & F.col("state").isin("added", "modified")).select("ordinal").distinct()
