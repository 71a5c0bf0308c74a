"""Diffs, merges and cross-checks of component snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_family(rows: DataFrame) -> DataFrame:
    """The row of smallest id of each family that is neither excluded nor historical."""
    shown = rows
    for c in ("excluded", "state"):
        if c in rows.columns:
            shown = shown.where(F.col(c).isNull())
    turn = Window.partitionBy("family").orderBy("id")
    return shown.withColumn("turn", F.row_number().over(turn)).where("turn = 1").drop("turn")


def diff(a: DataFrame, b: DataFrame, least_change: float = 0.05) -> DataFrame:
    """(family, change, old, new): added, removed, upgraded, downgraded, changed, scope and confidence, each that holds.

    Both sides have family, id, ecosystem, version, scope, confidence, and may have
    excluded and state. Versions compare by the second side's ecosystem; "changed" is
    another spelling of an equal one. No scope is "-".
    """
    from quillgraph.functions.versions import version_compare

    columns = ("ecosystem", "version", "scope", "confidence")
    side = lambda rows, tag: first_of_family(rows).select("family", *(F.col(c).alias(f"{tag}_{c}") for c in columns), F.lit(True).alias(tag))
    both = side(a, "a").join(side(b, "b"), "family", "full_outer")
    there = F.col("a") & F.col("b")
    scope = lambda tag: F.coalesce(F.nullif(F.col(f"{tag}_scope"), F.lit("")), F.lit("-"))
    shown = lambda tag: F.format_string("%.2f", F.col(f"{tag}_confidence").cast("double"))
    change = lambda holds, name, old, new: F.when(holds, F.struct(F.lit(name).alias("change"), old.cast("string").alias("old"), new.cast("string").alias("new")))
    old, new = F.col("a_version"), F.col("b_version")
    kinds = [
        change(F.col("a").isNull(), "added", old, new),
        change(F.col("b").isNull(), "removed", old, new),
        change(there & (scope("a") != scope("b")), "scope", scope("a"), scope("b")),
        change(there & (F.abs(F.col("a_confidence") - F.col("b_confidence")) >= least_change), "confidence", shown("a"), shown("b")),
    ]
    plain = both.select("family", F.explode(F.array_compact(F.array(*kinds))).alias("x")).select("family", "x.*")
    moved = both.where(there & (old != new)).select("family", old.alias("old"), new.alias("new"), version_compare("b_ecosystem", "b_version", "a_version").alias("sign"))
    direction = F.when(F.col("sign") > 0, "upgraded").when(F.col("sign") < 0, "downgraded").otherwise("changed")
    return plain.unionByName(moved.select("family", direction.alias("change"), "old", "new"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change): installed, upgraded, removed between two states of (key, version)."""
    a, b = before.select("key", F.col("version").alias("old")), after.select("key", F.col("version").alias("new"))
    change = F.when(F.col("old").isNull(), "installed").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "upgraded")
    return a.join(b, "key", "full_outer").select("key", "old", "new", change.alias("change")).where("change is not null")


def merged_ids(inputs: DataFrame) -> DataFrame:
    """(entry, merged): the smallest entry of those that shared identity keys join; ``inputs`` has entry (a number over all inputs, in their order) and keys."""
    from quillgraph.operators.resolution import resolved

    return resolved(inputs.select(F.col("entry").alias("id"), "keys"), F.col("keys")).select(F.col("id").alias("entry"), F.col("root").alias("merged"))


def merge(inputs: DataFrame, ids: DataFrame, strategy: str = "union") -> DataFrame:
    """One row a component over labelled inputs: (merged, name, family, version, tier, confidence, hashes, license, labels).

    ``inputs`` has entry, label, name, family, version, tier, confidence, hashes (a map),
    license and excluded (rows with it don't count); ``ids`` is ``merged_ids``. The best
    claim has the highest tier, then confidence (ties: the first entry); hashes are
    united, later entries win; the first license counts. "intersect" keeps what every
    label has; "hierarchical" is a union, to which ``described_by`` adds the inputs.
    """
    if strategy not in ("union", "hierarchical", "intersect"):
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = inputs.where("excluded is null").join(ids, "entry")
    best = F.min_by(F.struct("name", "family", "version", "tier", "confidence"), F.struct(-F.col("tier"), -F.col("confidence"), "entry"))
    license_ = F.min_by("license", F.when(F.col("license").isNotNull(), F.col("entry")))
    found = rows.groupBy("merged").agg(best.alias("x"), license_.alias("license"), F.sort_array(F.collect_set("label")).alias("labels"))
    if strategy == "intersect":
        whole = inputs.agg(F.countDistinct("label").alias("all_labels"))
        found = found.join(F.broadcast(whole), F.size("labels") == F.col("all_labels"))  # one row
    per_key = rows.select("merged", "entry", F.explode("hashes").alias("k", "v")).groupBy("merged", "k").agg(F.max_by("v", "entry").alias("v"))
    hashes = per_key.groupBy("merged").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("hashes"))
    return found.join(hashes, "merged", "left").select("merged", "x.*", "hashes", "license", F.array_join("labels", ",").alias("labels"))


def described_by(inputs: DataFrame, merged: DataFrame, ids: DataFrame) -> DataFrame:
    """(label, merged): which input describes which merged component."""
    return inputs.where("excluded is null").join(ids, "entry").join(merged.select("merged"), "merged", "left_semi").select("label", "merged").distinct()


def remapped_edges(edges: DataFrame, inputs: DataFrame, ids: DataFrame, merged: DataFrame) -> DataFrame:
    """(kind, src, dst, labels): the inputs' edges between merged components, none from one to itself.

    ``edges`` has label, kind, src, dst; ``inputs`` also id, the component's own in its input.
    """
    of = inputs.where("excluded is null").join(ids, "entry").join(merged.select("merged"), "merged", "left_semi").select("label", "id", "merged")
    src, dst = of.select("label", F.col("id").alias("src"), F.col("merged").alias("from")), of.select("label", F.col("id").alias("dst"), F.col("merged").alias("to"))
    met = edges.join(src, ["label", "src"]).join(dst, ["label", "dst"]).where("from <> to")
    return met.groupBy("kind", F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


def merge_conflicts(inputs: DataFrame) -> DataFrame:
    """(family, versions, detail): families on which the inputs disagree."""
    per = inputs.select("family", "version").distinct()
    return per.groupBy("family").agg(F.count("*").alias("versions"), F.array_join(F.array_sort(F.collect_list("version")), " vs ").alias("detail")).where("versions > 1")


def cross_check(claimed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(family, status, claimed, scanned): each claim of an attestation against what a scan found first of its family, and the scanned families that nothing claims.

    Both have family, id, version. A version that either side lacks agrees with any.
    """
    first = scanned.groupBy("family").agg(F.min_by("version", "id").alias("scanned"), F.lit(True).alias("found"))
    differ = F.coalesce(F.col("version") != F.col("scanned"), F.lit(False))
    claims = claimed.join(first, "family", "left").select("family", F.when(F.col("found").isNull(), "claimed-only").when(differ, "version-mismatch").otherwise("matched").alias("status"), F.col("version").alias("claimed"), "scanned")
    rest = first.join(claimed, "family", "left_anti").select("family", F.lit("scanned-only").alias("status"), F.lit(None).cast("string").alias("claimed"), "scanned")
    return claims.unionByName(rest)


def normal_name(name: Column) -> Column:
    return F.translate(F.lower(name), "_", "-")


def observed_and_unused(components: DataFrame, observations: DataFrame) -> DataFrame:
    """(key, status): observed (both sides), phantom (observation alone) or unused (component of a traced ecosystem alone)."""
    c = components.select("ecosystem", normal_name(F.col("name")).alias("key")).distinct()
    o = observations.select("ecosystem", normal_name(F.col("name")).alias("key")).distinct()
    hit = c.join(o, ["ecosystem", "key"], "left_semi").select("ecosystem", "key", F.lit("observed").alias("status"))
    phantom = o.join(c, ["ecosystem", "key"], "left_anti").select("ecosystem", "key", F.lit("phantom").alias("status"))
    unused = c.join(o, ["ecosystem", "key"], "left_anti").join(o.select("ecosystem").distinct(), "ecosystem", "left_semi").select("ecosystem", "key", F.lit("unused").alias("status"))
    return hit.unionByName(phantom).unionByName(unused)


def corrected(components: DataFrame, false_positives: DataFrame, missing: DataFrame) -> DataFrame:
    """Excludes what users marked wrong and adds what they assert (name, version) unless it is there."""
    bad = false_positives.select("name").distinct()
    marked = components.join(bad.withColumn("bad", F.lit(True)), "name", "left").withColumn("excluded", F.when(F.col("bad"), "user-false-positive").otherwise(F.col("excluded"))).drop("bad")
    new = missing.join(components, ["name", "version"], "left_anti").select("name", "version", F.lit("user-asserted").alias("excluded"))
    return marked.select("name", "version", "excluded").unionByName(new)
