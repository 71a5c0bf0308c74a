"""Scopes that a project's edges give to what they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import extras_gated, reachable
from quillgraph.scratch import materialize


def propagated_scopes(components: DataFrame, edges: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, scope, conditional) of each component; no scope: nothing reaches it.

    ``components`` has id, ctype, dev; ``edges`` src, dst, scope, marker; ``projects`` id.
    What a project depends on at run time, for development (dev, test) or optionally is
    followed; what it needs for building isn't. Edges that count only with an extra aren't
    followed, but what they point to is optional, with all below it. The first that holds
    counts: runtime, dev, build, optional; os packages and applications that nothing
    reaches are runtime. Conditional is what projects reach by marked edges alone, or only
    an extra does.
    """
    direct = materialize(edges.join(projects.select(F.col("id").alias("src")), "src", "left_semi").groupBy("dst", F.coalesce("scope", F.lit("runtime")).alias("scope")).agg(F.bool_and(F.col("marker").isNotNull()).alias("marked")), "scope-roots")
    kinds = {"runtime": ~F.col("scope").isin("build", "optional", "dev", "test"), "dev": F.col("scope").isin("dev", "test"), "optional": F.col("scope") == "optional", "build": F.col("scope") == "build"}
    roots = {k: direct.where(holds).select(F.col("dst").alias("id")).distinct() for k, holds in kinds.items()}
    gated_edges = edges.where(extras_gated()).select("src", "dst")
    reach = {k: reachable(edges, roots[k]).select(F.col("node").alias("id")) for k in ("runtime", "dev")}
    behind = lambda k: gated_edges.join(reach[k], F.col("src") == F.col("id")).select(F.col("dst").alias("id"))
    gated = materialize(behind("runtime").unionByName(behind("dev")).distinct(), "scope-gated")
    optional = reachable(edges, roots["optional"].unionByName(gated).distinct(), follow_extras=True).select(F.col("node").alias("id"))
    marked = direct.groupBy(F.col("dst").alias("id")).agg(F.bool_and("marked").alias("marked"))
    flags = {"runtime": reach["runtime"], "dev": reach["dev"], "build": roots["build"], "optional": optional, "gated": gated}
    rows = components.select("id", "ctype", "dev")
    for name, ids in flags.items():
        rows = rows.join(ids.distinct().withColumn(f"in_{name}", F.lit(True)), "id", "left")
    rows = rows.join(marked, "id", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    scope = F.when(is_("in_runtime"), "runtime").when(is_("in_dev") | is_("dev"), "dev").when(is_("in_build") | (F.col("ctype") == "build-tool"), "build").when(is_("in_optional"), "optional").when(F.col("ctype").isin("os-package", "application"), "runtime")
    return rows.select("id", scope.alias("scope"), (is_("marked") | (is_("in_gated") & ~is_("in_runtime") & ~is_("in_dev"))).alias("conditional"))
