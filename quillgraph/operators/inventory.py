"""Views of a finished run: selections, snapshots, summaries as lines, and what a cache of detector results lacks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.analytics import cluster_key, counters, kept
from quillgraph.plans import dsl


def selected_ids(components: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """(id) of the components that a query selects."""
    return dsl.run(components, text, edges).select("id").distinct()


def subgraph(components: DataFrame, ids: DataFrame | None = None, include_excluded: bool = False) -> DataFrame:
    """``components`` with excluded set on all but ``ids`` (None: all stay); ``include_excluded`` lifts it from those that stay."""
    if ids is None:
        return components.withColumn("excluded", F.lit(None).cast("string")) if include_excluded else components
    marked = components.join(ids.select("id").distinct().withColumn("picked", F.lit(True)), "id", "left")
    own = F.lit(None).cast("string") if include_excluded else F.col("excluded")
    return marked.withColumn("excluded", F.when(F.col("picked"), own).otherwise("unselected")).drop("picked").select(*components.columns)


def config_fingerprint(settings: dict) -> str:
    """Sixteen hex digits of settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def cache_key(path: Column, digest: Column, detectors: list[str], fingerprint: str) -> Column:
    """What a detector's result depends on: settings, detectors, content and place."""
    of = hashlib.sha256(",".join(sorted(detectors)).encode()).hexdigest()[:16]
    return F.concat_ws(":", F.lit(f"v1:{fingerprint}:{of}"), digest, path)


def uncached(files: DataFrame, cache: DataFrame, detectors: list[str], fingerprint: str) -> DataFrame:
    """The files (path, digest, ...) whose result the cache (key) lacks, with their key: what is left to parse."""
    return files.withColumn("key", cache_key(F.col("path"), F.col("digest"), detectors, fingerprint)).join(cache.select("key"), "key", "left_anti")


def cached_results(files: DataFrame, cache: DataFrame, detectors: list[str], fingerprint: str) -> DataFrame:
    """The cache's results (key, result) of the files that it has."""
    return files.withColumn("key", cache_key(F.col("path"), F.col("digest"), detectors, fingerprint)).join(cache, "key").select("path", "result")


def cache_stats(entries: DataFrame) -> DataFrame:
    """(shelf, entries, bytes) and the whole as shelf null."""
    return entries.rollup("shelf").agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def installed_snapshot(components: DataFrame) -> DataFrame:
    """(key, version) of what is installed or observed now: tier 4 and up, neither excluded nor historical."""
    state = F.try_element_at("attrs", F.lit("state"))
    return components.where((F.col("tier_cap") >= 4) & F.col("excluded").isNull() & state.isNull()).select(F.concat_ws("/", "ecosystem", "name").alias("key"), "version").distinct()


def fleet_sources(merged: DataFrame) -> DataFrame:
    return merged.select(F.explode("seen_in").alias("x")).select(F.col("x.host").alias("host")).distinct()


def installed_ecosystems(components: DataFrame, evidence: DataFrame) -> DataFrame:
    """(ecosystem) of those with installed evidence anywhere."""
    there = evidence.where("tier = 4").select(F.col("component_id").alias("id"))
    return components.join(there, "id", "left_semi").select("ecosystem").distinct()


def run_summary(components: DataFrame, annotations: DataFrame, layers: DataFrame) -> DataFrame:
    """(fact, count): emitted, sure and excluded components, annotations, layers."""
    c = counters(components, F.lit("all")).select("emitted", "sure", "excluded")
    rows = c.select(F.inline(F.array(*(F.struct(F.lit(n).alias("fact"), F.col(n).alias("count")) for n in c.columns))))
    for name, df in (("annotations", annotations), ("layers", layers)):
        rows = rows.unionByName(df.agg(F.count("*").alias("count")).select(F.lit(name).alias("fact"), "count"))
    return rows


def table_lines(components: DataFrame) -> DataFrame:
    """(name, version, id, line): a line for each emitted component, in columns as wide as their widest entry; in order by name, version, id."""
    empty = F.lit("-")
    cells = [
        ("NAME", F.col("name")),
        ("VERSION", F.coalesce("version", F.concat(F.lit("("), F.coalesce(F.try_element_at("attrs", F.lit("requested")), F.lit("?")), F.lit(")")))),
        ("ECOSYSTEM", cluster_key("ecosystem")),
        ("TIER", dsl.tier_label(F.col("tier_cap"))),
        ("CONF", F.format_string("%.2f", F.col("confidence").cast("double"))),
        ("SCOPE", F.coalesce(F.try_element_at("attrs", F.lit("scope")), empty)),
    ]
    rows = kept(components).select("id", F.col("name").alias("by_name"), F.col("version").alias("by_version"), *(c.alias(n) for n, c in cells))
    widths = rows.agg(*(F.greatest(F.max(F.length(n)), F.lit(len(n))).alias(f"w_{n}") for n, _ in cells))
    line = F.concat_ws("  ", *(F.rpad(F.col(n), F.col(f"w_{n}"), F.lit(" ")) for n, _ in cells))
    return rows.crossJoin(F.broadcast(widths)).select(F.col("by_name").alias("name"), F.col("by_version").alias("version"), "id", line.alias("line"))  # one row


def summary_lines(components: DataFrame, annotations: DataFrame) -> DataFrame:
    """(place, line): counts, by ecosystem and by tier, and the size of drift."""
    whole = counters(components, F.lit("all")).select(F.lit(1).alias("place"), F.format_string("components: %d (%d high confidence)", "emitted", "sure").alias("line"))
    out = whole
    for place, name, key in ((2, "ecosystem", cluster_key("ecosystem")), (3, "tier", dsl.tier_label(F.col("tier_cap")))):
        per = kept(components).groupBy(key.alias("key")).agg(F.count("*").alias("n"))
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "n"))), lambda x: F.concat(x.key, F.lit("="), x.n.cast("string"))), ", ")
        out = out.unionByName(per.agg(listed.alias("l")).select(F.lit(place).alias("place"), F.concat(F.lit(f"by {name}: "), "l").alias("line")))
    gone = counters(components, F.lit("all")).where("excluded > 0").select(F.lit(4).alias("place"), F.format_string("retained in graph, not emitted: %d", "excluded").alias("line"))
    drift = annotations.where(F.col("code").startswith("drift:")).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(5).alias("place"), F.format_string("drift findings: %d", "n").alias("line"))
    return out.unionByName(gone).unionByName(drift)


def tree_lines(components: DataFrame, edges: DataFrame, projects: DataFrame, max_depth: int = 25) -> DataFrame:
    """(way, depth, line): the dependency tree below each project; sorting by way gives the tree's order.

    Children come by name, then id; a node that is on its own way is marked as a cycle and
    not followed. The tree grows with the number of ways, as the rendering does; what is
    deeper than ``max_depth`` is marked as cut.
    """
    from quillgraph.scratch import materialize

    names = kept(components).select(F.col("id").alias("node"), F.struct(F.col("name"), F.col("id")).alias("key"), F.concat(F.col("name"), F.lit("@"), F.coalesce("version", F.lit("?")), F.format_string(" [%s %.2f]", dsl.tier_label(F.col("tier_cap")), F.col("confidence").cast("double"))).alias("label"))
    links = edges.select("src", F.col("dst").alias("node")).distinct().join(names, "node")
    level = projects.select(F.col("id").alias("head"), F.array(F.struct(F.col("path").alias("name"), F.col("id").cast("long").alias("id"))).alias("way"), F.array(F.lit(None).cast("long")).alias("seen"), F.col("path").alias("label"), F.lit(False).alias("cycle"))
    out = None
    for depth in range(max_depth + 1):
        level = materialize(level, "tree")
        if depth and level.isEmpty():
            break
        mark = F.when(F.col("cycle"), " (cycle)").otherwise(" (deeper)" if depth == max_depth else "")
        lines = level.select("way", F.lit(depth).alias("depth"), F.concat(F.lit("  " * depth), "label", mark).alias("line"))
        out = lines if out is None else out.unionByName(lines)
        step = level.where("not cycle").join(links, F.col("head") == F.col("src"))
        level = step.select(F.col("node").alias("head"), F.concat("way", F.array(F.struct(F.col("key.name").alias("name"), F.col("key.id").cast("long").alias("id")))).alias("way"), F.concat("seen", F.array(F.col("head").cast("long"))).alias("seen"), links["label"].alias("label"), F.coalesce(F.array_contains(F.concat("seen", F.array(F.col("head").cast("long"))), F.col("node")), F.lit(False)).alias("cycle"))
    return out


def min_symbol_versions(required: DataFrame) -> DataFrame:
    """(binary, library, version): the least version of each library that meets all symbol versions (``required`` binary, symbol as LIB_1.2.3)."""
    version = F.regexp_extract("symbol", r"^[^_]+_(\d+(?:\.\d+)*)$", 1)
    rows = required.select("binary", F.substring_index("symbol", "_", 1).alias("library"), version.alias("version")).where("version <> ''")
    return rows.groupBy("binary", "library").agg(F.max_by("version", F.transform(F.split("version", r"\."), lambda x: x.cast("long"))).alias("version"))


def tree_matches(hits: DataFrame) -> DataFrame:
    """``votes`` with confidence and whether the tree was changed."""
    return hits.withColumn("modified", F.col("ratio") < 1).withColumn("confidence", F.round(F.least(F.lit(0.85), 0.5 + F.col("ratio") * 0.35), 4))



def tiers_present(components: DataFrame, evidence: DataFrame) -> DataFrame:
    """(family, tiers): the labels of all evidence that a family's components have, lowest first."""
    met = components.select("family", F.col("id").alias("component_id")).join(evidence.select("component_id", "tier").distinct(), "component_id")
    tiers = F.transform(F.sort_array(F.collect_set("tier")), lambda t: dsl.tier_label(t))
    return met.groupBy("family").agg(F.array_join(tiers, ",").alias("tiers"))


def runs_listed(runs: DataFrame, opened: int | None = None) -> DataFrame:
    """(run_id, subject, created, place) of runs, the opened one first, then the newest; ranked by ranges."""
    from quillgraph.sources.store import numbered

    later = F.when(F.col("run_id") == F.lit(opened), 0).otherwise(1)
    rows = runs.select("run_id", "subject", "created").withColumn("k1", later).withColumn("k2", -F.unix_micros(F.col("created").cast("timestamp"))).withColumn("k3", -F.col("run_id"))
    return numbered(rows, "k1", "k2", "k3").select("run_id", "subject", "created", F.col("id").alias("place"))


def component_detail(components: DataFrame, evidence: DataFrame, annotations: DataFrame, ref: int) -> DataFrame:
    """(kind, place, what, text): a component itself, its evidence (highest tier, then confidence first) and its annotations by code."""
    own = components.where(F.col("id") == ref).select(F.lit("component").alias("kind"), F.lit(1).alias("place"), F.col("name").alias("what"), F.coalesce("version", F.lit("?")).alias("text"))
    best = Window.orderBy(F.desc("tier"), F.desc("confidence"), "finding_id", "ordinal")
    seen = evidence.where(F.col("component_id") == ref).select(F.lit("evidence").alias("kind"), F.row_number().over(best).alias("place"), dsl.tier_label(F.col("tier")).alias("what"), "path").withColumnRenamed("path", "text")  # one component's rows
    told = annotations.where(F.col("component_id") == ref).select(F.lit("annotation").alias("kind"), F.row_number().over(Window.orderBy("code", "detail")).alias("place"), F.col("code").alias("what"), F.col("detail").alias("text"))
    return own.unionByName(seen).unionByName(told)
