"""Queries of scopes, whole reconciliation, build histories of databases and views of a run, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import analytics as A
from quillgraph.operators import inventory as I
from quillgraph.operators import matching as M
from quillgraph.operators import observations as O
from quillgraph.operators import reconcile as R
from quillgraph.operators import timeline as L
from quillgraph.operators.scopes import propagated_scopes
from quillgraph.queries import COMPONENTS, EDGES, EVIDENCE, STATES, TIER, query
from quillgraph.sources import derived as D
from quillgraph.sources import plugins as P


def _text(*parts: object):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Scopes -----------------------------------------------------------------------------

_SCOPED = f"""{COMPONENTS}, {EDGES}, e AS (SELECT src, dst, NULL::VARCHAR AS scope, marker FROM edges WHERE src > 0 UNION ALL SELECT 0, p_partkey, CASE p_size % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' WHEN 2 THEN 'build' WHEN 3 THEN 'optional' END, CASE WHEN p_partkey % 4 = 0 THEN 'os == "x"' END FROM part WHERE p_retailprice % 40 < 1),
  direct AS (SELECT dst, coalesce(scope, 'runtime') AS scope, bool_and(marker IS NOT NULL) AS marked FROM e WHERE src = 0 GROUP BY 1, 2), open AS (SELECT src, dst FROM e WHERE src > 0 AND (marker IS NULL OR marker NOT LIKE 'extra ==%')),
  run AS (SELECT dst AS id FROM direct WHERE scope = 'runtime' UNION SELECT open.dst FROM run JOIN open ON src = id), dev AS (SELECT dst AS id FROM direct WHERE scope IN ('dev', 'test') UNION SELECT open.dst FROM dev JOIN open ON src = id),
  gated AS (SELECT DISTINCT dst AS id FROM e WHERE marker LIKE 'extra ==%' AND (src IN (FROM run) OR src IN (FROM dev))), opt AS (SELECT id FROM gated UNION SELECT dst FROM direct WHERE scope = 'optional' UNION SELECT e.dst FROM opt JOIN e ON src = id),
  marked AS (SELECT dst AS id, bool_and(marked) AS marked FROM direct GROUP BY 1)"""


def _project_edges(spark: SparkSession, d: str) -> DataFrame:
    """The part graph, and a project, node 0, that depends on one part of forty in some scope."""
    inner = D.edges(spark, d).where("src > 0").select("src", "dst", F.lit(None).cast("string").alias("scope"), "marker")
    k, size = F.col("p_partkey"), F.col("p_size") % 5
    scope = F.when(size == 0, "dev").when(size == 1, "test").when(size == 2, "build").when(size == 3, "optional")
    own = D.table(spark, d, "part").where("p_retailprice % 40 < 1").select(F.lit(0).cast("long").alias("src"), k.alias("dst"), scope.alias("scope"), F.when(k % 4 == 0, 'os == "x"').alias("marker"))
    return inner.unionByName(own)


@query(f"""WITH RECURSIVE {_SCOPED} SELECT c.id, CASE WHEN c.id IN (FROM run) THEN 'runtime' WHEN c.id IN (FROM dev) OR c.id % 50 = 3 THEN 'dev' WHEN c.id IN (SELECT dst FROM direct WHERE scope = 'build') THEN 'build' WHEN c.id IN (FROM opt) THEN 'optional' WHEN ctype = 'os-package' THEN 'runtime' END AS scope,
  coalesce(marked, false) OR c.id IN (FROM gated) AND c.id NOT IN (FROM run) AND c.id NOT IN (FROM dev) AS conditional FROM components c LEFT JOIN marked m ON m.id = c.id""")
def scope_propagation(spark: SparkSession, d: str) -> DataFrame:
    c = D.components(spark, d).select("id", "ctype", (F.col("id") % 50 == 3).alias("dev"))
    return propagated_scopes(c, _project_edges(spark, d), spark.range(1))


# Whole reconciliation -----------------------------------------------------------------

_CLAIMED = """claims AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'pypi' ELSE 'npm' END AS eco, 'lib' || (p_partkey % 250) AS name, CASE WHEN p_partkey % 5 > 0 THEN (p_size % 4) || '.0' END AS version, CASE WHEN p_partkey % 11 = 0 THEN 'MIT' END AS license FROM part),
  ev AS (SELECT l_partkey AS claim_id, CASE WHEN l_partkey % 6 = 0 THEN 2 + l_linenumber % 2 ELSE 2 + l_partkey % 4 END AS tier, round(l_discount * 9, 4) AS confidence FROM lineitem), ct AS (SELECT claim_id AS id, max(tier) AS tier FROM ev GROUP BY 1), rows AS (SELECT claims.*, tier FROM claims JOIN ct USING (id)),
  k AS (SELECT *, CASE WHEN eco = 'pypi' THEN min(id) OVER (PARTITION BY eco, name, version IS NULL) ELSE min(id) OVER (PARTITION BY eco, name, version) END AS own FROM rows), n AS (SELECT eco, name, count(DISTINCT own) AS n, min(own) AS sole FROM k WHERE version IS NOT NULL GROUP BY ALL), b AS (SELECT eco, name, min(id) AS bare FROM k WHERE version IS NULL GROUP BY ALL),
  m AS (SELECT k.*, CASE WHEN version IS NOT NULL THEN own WHEN n = 1 THEN sole ELSE bare END AS root FROM k LEFT JOIN n USING (eco, name) LEFT JOIN b USING (eco, name)), pins AS (SELECT root, arg_max(version, (tier, version)) FILTER (version IS NOT NULL) AS version, min(eco) AS eco, min(name) AS name, count(*) AS n_claims, max(license) AS license FROM m GROUP BY 1),
  s AS (SELECT root, max(tier) AS tier_cap, product(1 - confidence) AS doubt FROM ev JOIN m ON m.id = claim_id GROUP BY root, 'x'),
  s2 AS (SELECT root, max(e.tier) AS tier_cap, product(1 - greatest(0, least(1, e.confidence))) AS doubt, bool_or(e.tier IN (2, 3)) AS d, bool_or(e.tier IN (4, 5)) AS i, bool_or(e.tier = 4) AS t FROM ev e JOIN m ON m.id = e.claim_id GROUP BY 1),
  nodes AS (SELECT root AS id, eco, name, version, license, n_claims, tier_cap, d, i, t, round(least(1 - doubt, CASE tier_cap WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 WHEN 3 THEN 0.95 WHEN 4 THEN 0.98 ELSE 1.0 END), 4) AS confidence FROM pins JOIN s2 USING (root)),
  ends AS (SELECT -1 AS id, 'project:.' AS ref UNION ALL SELECT arg_max(id, (tier_cap, coalesce(version, ''), -id)), 'family:' || eco || '/' || name FROM nodes GROUP BY eco, name),
  ce AS (SELECT 'project:.' AS src, 'family:' || CASE WHEN p_partkey % 3 = 0 THEN 'pypi' ELSE 'npm' END || '/lib' || (p_partkey % 250) AS dst, 'runtime' AS scope FROM part WHERE p_size > 44 UNION ALL SELECT 'family:npm/lib' || (p_partkey % 250), 'family:npm/lib' || (p_size * 5), NULL FROM part),
  ge AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM ce JOIN ends a ON a.ref = ce.src JOIN ends b ON b.ref = ce.dst WHERE a.id <> b.id), run AS (SELECT dst AS id FROM ge WHERE src = -1 UNION SELECT ge.dst FROM run JOIN ge ON src = run.id),
  fam AS (SELECT eco, name, bool_or(d) AS d, bool_or(i) AS i FROM nodes GROUP BY 1, 2), gates AS (SELECT eco, bool_or(t) AS has_i, bool_or(d) AS has_d FROM nodes GROUP BY 1), codes AS (SELECT eco, name, d AND NOT i AND has_i AS missing, i AND NOT d AND has_d AS orphan FROM fam JOIN gates USING (eco))"""


def _graph(spark: SparkSession, d: str) -> R.Graph:
    part = D.table(spark, d, "part")
    k = F.col("p_partkey")
    eco, name, null = F.when(k % 3 == 0, "pypi").otherwise("npm"), _text("lib", k % 250), F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    claims = part.select(k.alias("id"), F.lit("library").alias("ctype"), eco.alias("ecosystem"), null.alias("namespace"), name.alias("name"), F.when(k % 5 > 0, _text(F.col("p_size") % 4, ".0")).alias("version"), null.alias("purl"), empty.alias("hashes"), empty.alias("qualifiers"), empty.alias("attrs"), F.when(k % 11 == 0, "MIT").alias("license"), null.alias("requested"))
    line, lk = F.col("l_linenumber"), F.col("l_partkey")
    evidence = D.table(spark, d, "lineitem").select(lk.alias("claim_id"), F.when(lk % 6 == 0, 2 + line % 2).otherwise(2 + lk % 4).cast("int").alias("tier"), F.round(F.col("l_discount") * 9, 4).alias("confidence"), F.lit(None).cast("array<string>").alias("modifiers"))
    own = part.where("p_size > 44").select(F.lit("project:.").alias("src"), _text("family:", eco, "/", name).alias("dst"), F.lit("runtime").alias("scope"), k.alias("ordinal"))
    inner = part.select(_text("family:npm/", name).alias("src"), _text("family:npm/lib", F.col("p_size") * 5).alias("dst"), null.alias("scope"), (k + 10**9).alias("ordinal"))
    edges = own.unionByName(inner).select("ordinal", F.lit("DEPENDS_ON").alias("kind"), "src", "dst", "scope", null.alias("requested"), F.lit(True).alias("direct"), null.alias("marker"), empty.alias("attrs"))
    projects = spark.createDataFrame([(-1, ".")], "id long, path string")
    return R.reconciled_graph(claims, evidence, edges, projects)


@query(f"""WITH RECURSIVE {_CLAIMED} SELECT id, nodes.eco AS ecosystem, nodes.name, version, 'pkg:' || nodes.eco || '/' || nodes.name AS purl, license, n_claims, CAST(tier_cap AS INTEGER) AS tier_cap, CASE WHEN id IN (FROM run) THEN 'runtime' END AS scope, round(confidence * CASE WHEN orphan THEN 0.8 ELSE 1 END, 4)::DOUBLE AS confidence FROM nodes JOIN codes ON codes.eco = nodes.eco AND codes.name = nodes.name""")
def reconcile_components(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).components.select("id", "ecosystem", "name", "version", "purl", "license", "n_claims", F.col("tier_cap").cast("int").alias("tier_cap"), "scope", "confidence")


@query(f"WITH RECURSIVE {_CLAIMED} SELECT src, dst FROM ge")
def reconcile_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).edges.select("src", "dst")


@query(f"""WITH RECURSIVE {_CLAIMED}, who AS (SELECT m.root, m.version, m.tier, m.eco, p.version AS pin, max(CASE WHEN m.version IS NOT NULL THEN m.tier END) OVER (PARTITION BY m.root) AS pin_tier FROM m JOIN pins p ON p.root = m.root)
  SELECT root AS component_id, code, count(*) AS n FROM (SELECT DISTINCT root, tier, version, CASE WHEN least(tier, pin_tier) = 3 AND greatest(tier, pin_tier) = 4 THEN 'drift:locked-vs-installed' ELSE 'superseded-version' END AS code FROM who WHERE version <> pin AND tier <> pin_tier) GROUP BY ALL
  UNION ALL SELECT DISTINCT root, 'version-conflict', 1 FROM who WHERE version <> pin AND tier = pin_tier AND eco = 'pypi' UNION ALL SELECT DISTINCT root, 'ambiguous-declared', 1 FROM m JOIN n USING (eco, name) WHERE version IS NULL AND n > 1
  UNION ALL SELECT id, CASE WHEN missing THEN 'drift:declared-not-installed' ELSE 'drift:installed-not-declared' END, 1 FROM nodes JOIN codes ON codes.eco = nodes.eco AND codes.name = nodes.name WHERE missing OR orphan""")
def reconcile_annotations(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).annotations.groupBy("component_id", "code").agg(F.count("*").alias("n"))


# Databases over layers ------------------------------------------------------------------

_DB = f"""{STATES}, db AS (SELECT 'db' || (family % 3) AS path, ordinal, family, version FROM states WHERE NOT (family % 3 = 1 AND ordinal % 5 = 2)), snaps AS (SELECT DISTINCT 'db' || (family % 3) AS path, ordinal FROM states), nx AS (SELECT *, lead(ordinal) OVER (PARTITION BY path ORDER BY ordinal) AS next FROM snaps),
  w AS (SELECT db.*, next, lag(version) OVER f AS prev, lag(next) OVER f AS prev_next, lead(ordinal) OVER f AS after, lead(version) OVER f AS after_version FROM db JOIN nx USING (path, ordinal) WINDOW f AS (PARTITION BY path, family ORDER BY db.ordinal)),
  r AS (SELECT *, max(CASE WHEN prev IS NULL OR prev <> version OR prev_next <> ordinal THEN ordinal END) OVER (PARTITION BY path, family ORDER BY ordinal) AS since FROM w),
  ev AS (SELECT path, family, CASE WHEN after IS DISTINCT FROM next THEN 'removed' ELSE 'upgraded' END AS kind, version AS old_version, since AS old_ordinal, CASE WHEN after = next THEN after_version END AS new_version, next AS new_ordinal FROM r WHERE next IS NOT NULL AND (after IS DISTINCT FROM next OR after_version <> version)),
  finds AS (SELECT path, family, version AS old_version, round(least(1 - product(1 - (0.4 + 0.01 * (ordinal % 7))), 0.98), 4)::DOUBLE AS confidence FROM db WHERE family % 10 <> 4 GROUP BY 1, 2, 3), hist AS (SELECT path, family, old_version, kind, old_ordinal, new_ordinal, confidence FROM ev JOIN finds USING (path, family, old_version)), finals AS (SELECT family % 100 AS fam, min(family) AS id FROM states WHERE family % 2 = 0 GROUP BY 1)"""


def _db(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three package databases; one is empty in some layers."""
    states = D.states(spark, d).withColumn("path", _text("db", F.col("family") % 3))
    return states.where(~((F.col("family") % 3 == 1) & (F.col("ordinal") % 5 == 2))), states.select("path", "ordinal").distinct()


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    states, snapshots = _db(spark, d)
    events = L.database_timeline(states, snapshots)
    finds = states.where("family % 10 <> 4").select("path", "family", "version", (0.4 + 0.01 * (F.col("ordinal") % 7)).alias("confidence"))
    return events, L.historical(events, finds)


@query(f"WITH {_DB} SELECT * FROM ev")
def database_timeline(spark: SparkSession, d: str) -> DataFrame:
    return L.database_timeline(*_db(spark, d))


@query(f"WITH {_DB} SELECT path, family, old_version AS version, CASE kind WHEN 'removed' THEN 'removed' ELSE 'superseded' END AS state, old_ordinal AS layer_ordinal, new_ordinal AS removed_in_layer, confidence, CASE kind WHEN 'removed' THEN 'removed' ELSE 'superseded' END || ' during image build' AS excluded FROM hist")
def historical_components(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d)[1]


@query(f"WITH {_DB} SELECT family AS src, family, old_version, new_ordinal AS layer FROM hist WHERE kind = 'upgraded' AND family % 2 = 0")
def supersedes_edges(spark: SparkSession, d: str) -> DataFrame:
    events, history = _history(spark, d)
    return L.supersedes(events, D.states(spark, d).where("family % 2 = 0").select("family", F.col("family").alias("id")), history)


@query(f"""WITH {_DB} SELECT family, 'pkgdb-upgraded' AS code, old_version || ' (layer ' || (old_ordinal + 1) || ') > ' || new_version || ' (layer ' || (new_ordinal + 1) || ')' AS detail FROM ev WHERE kind = 'upgraded' AND family % 2 = 0
  UNION ALL SELECT family, 'pkgdb-removed', 'installed in layer ' || (old_ordinal + 1) || ', deleted in layer ' || (new_ordinal + 1) || CASE WHEN new_ordinal % 3 > 0 THEN ' (RUN ' || new_ordinal || ')' ELSE '' END FROM ev WHERE kind = 'removed'""")
def timeline_notes(spark: SparkSession, d: str) -> DataFrame:
    events, _ = _history(spark, d)
    layers = D.states(spark, d).select("ordinal").distinct().withColumn("command", F.when(F.col("ordinal") % 3 > 0, _text("RUN ", F.col("ordinal"))))
    return L.timeline_notes(events, D.states(spark, d).where("family % 2 = 0").select("family", F.col("family").alias("id")), layers)


@query(f"WITH {STATES} SELECT ordinal, family // 2 AS family, arg_max(version, family % 3) AS version FROM states GROUP BY 1, 2")
def merged_databases(spark: SparkSession, d: str) -> DataFrame:
    states = D.states(spark, d).select(_text("db", F.col("family") % 3).alias("path"), "ordinal", F.floor(F.col("family") / 2).alias("family"), "version")
    return L.merged_databases(states)


@query(f"""WITH {STATES}, {COMPONENTS}, {EVIDENCE}, c AS (SELECT id, ctype, id % 100 AS family, CASE id % 3 WHEN 0 THEN 'signup' WHEN 1 THEN 'click' ELSE 'none' END AS version FROM components), f AS (SELECT family, version, min(ordinal) AS first FROM states GROUP BY 1, 2), g AS (SELECT component_id AS id, min(finding_id % 9) AS least FROM evidence WHERE finding_id % 4 = 1 GROUP BY 1)
  SELECT c.id, coalesce(CASE WHEN ctype = 'os-package' THEN first END, least) AS ordinal, 'sha-' || coalesce(CASE WHEN ctype = 'os-package' THEN first END, least) AS digest FROM c LEFT JOIN f USING (family, version) LEFT JOIN g ON g.id = c.id WHERE coalesce(CASE WHEN ctype = 'os-package' THEN first END, least) IS NOT NULL""")
def layer_attribution(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    c = D.components(spark, d).select("id", "ctype", (k % 100).alias("family"), F.when(k % 3 == 0, "signup").when(k % 3 == 1, "click").otherwise("none").alias("version"))
    seen = D.evidence(spark, d).select("component_id", _text("f", F.col("finding_id")).alias("path"), "finding_id")
    owners = seen.where("finding_id % 4 = 1").select("path", (F.col("finding_id") % 9).cast("int").alias("ordinal")).distinct()
    layers = spark.range(400).select(k.cast("int").alias("ordinal"), _text("sha-", k).alias("digest"), _text("RUN ", k).alias("command"))
    return L.layer_of(c, D.states(spark, d), seen.select("component_id", "path"), owners, layers).select("id", "ordinal", "digest")


@query(f"WITH {STATES} SELECT DISTINCT ordinal FROM states WHERE family = 7")
def path_versions(spark: SparkSession, d: str) -> DataFrame:
    members = D.states(spark, d).select("ordinal", _text("opt/", F.col("family")).alias("path"))
    return L.versions_of(L.layer_transitions(members), "opt/7")


# Views of a run ---------------------------------------------------------------------------


@query(f"WITH {COMPONENTS} SELECT id, CASE WHEN ecosystem = 'economy' AND confidence < 0.9 THEN excluded ELSE 'unselected' END AS excluded FROM components")
def subgraph_export(spark: SparkSession, d: str) -> DataFrame:
    c = D.components(spark, d)
    return I.subgraph(c, I.selected_ids(c, D.edges(spark, d), "components where ecosystem = economy and confidence < 0.9")).select("id", "excluded")




@query("SELECT 'doc/' || doc_id AS path, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncached_files(spark: SparkSession, d: str) -> DataFrame:
    files = D.table(spark, d, "documents").select(_text("doc/", F.col("doc_id")).alias("path"), F.md5("text").alias("digest"), "doc_id")
    known = files.join(D.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    found, settings = ["js/npm-lock", "os/dpkg"], I.config_fingerprint({"paranoid": False, "scope": "all"})
    cache = known.select(I.cache_key(F.col("path"), F.col("digest"), found[::-1], settings).alias("key"), F.lit("[]").alias("result"))
    return I.uncached(files, cache, found, settings).select("path", "digest")


@query("SELECT c_nationkey::VARCHAR AS shelf, count(*) AS entries, coalesce(sum(1 + c_custkey % 97), 0)::BIGINT AS bytes FROM customer GROUP BY ROLLUP (1)")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.cache_stats(D.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("shelf"), (1 + F.col("c_custkey") % 97).alias("size")))


@query(f"WITH {COMPONENTS} SELECT DISTINCT ecosystem || '/' || name AS key, version FROM components WHERE tier_cap >= 4 AND excluded IS NULL")
def installed_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return I.installed_snapshot(D.components(spark, d))


@query("SELECT DISTINCT 'host' || lpad(l_suppkey::VARCHAR, 5, '0') AS host FROM lineitem WHERE l_partkey % 20 > 0")
def fleet_sources(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.queries import _fleet

    return I.fleet_sources(A.fleet_merge(_fleet(spark, d)))


@query(f"WITH {COMPONENTS}, {EVIDENCE} SELECT DISTINCT ecosystem FROM components WHERE id IN (SELECT component_id FROM evidence WHERE tier = 4)")
def installed_ecosystems(spark: SparkSession, d: str) -> DataFrame:
    return I.installed_ecosystems(D.components(spark, d), D.evidence(spark, d))


@query(f"""WITH {COMPONENTS}, {STATES} SELECT 'emitted' AS fact, count(*) AS count FROM components WHERE excluded IS NULL UNION ALL SELECT 'sure', count(*) FROM components WHERE excluded IS NULL AND confidence >= 0.9 UNION ALL SELECT 'excluded', count(excluded) FROM components
  UNION ALL SELECT 'annotations', count(*) FROM labels UNION ALL SELECT 'layers', count(DISTINCT ordinal) FROM states""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.run_summary(D.components(spark, d), D.table(spark, d, "labels"), D.states(spark, d).select("ordinal").distinct())


@query(f"""WITH {COMPONENTS}, t AS (SELECT id, name, version, ecosystem, {TIER.format('tier_cap')} AS tier, printf('%.2f', confidence) AS conf, scope FROM components WHERE excluded IS NULL), w AS (SELECT greatest(4, max(len(name))) AS a, greatest(7, max(len(version))) AS b, greatest(9, max(len(ecosystem))) AS c, greatest(4, max(len(tier))) AS d, greatest(4, max(len(conf))) AS e, greatest(5, max(len(scope))) AS f FROM t)
  SELECT name, version, id, rpad(name, a::INT, ' ') || '  ' || rpad(version, b::INT, ' ') || '  ' || rpad(ecosystem, c::INT, ' ') || '  ' || rpad(tier, d::INT, ' ') || '  ' || rpad(conf, e::INT, ' ') || '  ' || rpad(scope, f::INT, ' ') AS line FROM t, w""")
def table_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.table_lines(D.components(spark, d))


@query(f"""WITH {COMPONENTS}, k AS (FROM components WHERE excluded IS NULL) SELECT 1 AS place, 'components: ' || count(*) || ' (' || count(*) FILTER (confidence >= 0.9) || ' high confidence)' AS line FROM k
  UNION ALL SELECT 2, 'by ecosystem: ' || string_agg(ecosystem || '=' || n, ', ' ORDER BY ecosystem) FROM (SELECT ecosystem, count(*) AS n FROM k GROUP BY 1) UNION ALL SELECT 3, 'by tier: ' || string_agg(tier || '=' || n, ', ' ORDER BY tier) FROM (SELECT {TIER.format('tier_cap')} AS tier, count(*) AS n FROM k GROUP BY 1)
  UNION ALL SELECT 4, 'retained in graph, not emitted: ' || count(excluded) FROM components UNION ALL SELECT 5, 'drift findings: ' || count(*) FROM labels WHERE toxic = 1""")
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    notes = D.table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "drift:x").otherwise("other").alias("code"))
    return I.summary_lines(D.components(spark, d), notes)


@query("""WITH r AS (SELECT l_orderkey AS bin, l_suppkey % 5 AS lib, l_linenumber AS a, l_partkey % 20 AS b FROM lineitem WHERE l_partkey % 9 > 0) SELECT 'b' || bin AS binary, 'LIB' || lib AS library, arg_max('2.' || a || '.' || b, (a, b)) AS version FROM r GROUP BY bin, lib""")
def symbol_versions(spark: SparkSession, d: str) -> DataFrame:
    i = D.table(spark, d, "lineitem")
    version = F.when(F.col("l_partkey") % 9 == 0, "PRIVATE").otherwise(_text("2.", F.col("l_linenumber"), ".", F.col("l_partkey") % 20))
    return I.min_symbol_versions(i.select(_text("b", F.col("l_orderkey")).alias("binary"), _text("LIB", F.col("l_suppkey") % 5, "_", version).alias("symbol")))


_VOTES = """f AS (SELECT DISTINCT l_suppkey AS subject, l_partkey AS mark FROM lineitem), s AS (SELECT DISTINCT l_partkey % 40 AS library, l_partkey AS mark FROM lineitem WHERE l_quantity > 25), t AS (SELECT library, count(*) AS total FROM s GROUP BY 1)"""


def _marks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = D.table(spark, d, "lineitem")
    return i.select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("mark")), i.where("l_quantity > 25").select((F.col("l_partkey") % 40).alias("library"), F.col("l_partkey").alias("mark"))


@query(f"WITH {_VOTES} SELECT subject, library, count(*) AS matched, round(count(*) / any_value(total), 4) AS ratio FROM f JOIN s USING (mark) JOIN t USING (library) GROUP BY 1, 2 HAVING count(*) >= 12 AND round(count(*) / any_value(total), 4) >= 0.1")
def function_vote(spark: SparkSession, d: str) -> DataFrame:
    return M.votes(*_marks(spark, d), least=12, min_ratio=0.1)


@query(f"WITH {_VOTES}, h AS (SELECT subject, library, count(*) AS matched, round(count(*) / any_value(total), 4) AS ratio FROM f JOIN s USING (mark) JOIN t USING (library) GROUP BY 1, 2) SELECT *, ratio < 1 AS modified, round(least(0.85, 0.5 + ratio * 0.35), 4)::DOUBLE AS confidence FROM h WHERE ratio >= 0.2")
def tree_matches(spark: SparkSession, d: str) -> DataFrame:
    return I.tree_matches(M.votes(*_marks(spark, d), min_ratio=0.2))


@query(f"""WITH {EVIDENCE}, e AS (SELECT finding_id, ordinal, component_id, detector, ['manifest-parse','lockfile-parse','os-package-db','guess'][ordinal % 4 + 1] AS technique, split_part(path, '/', 1) AS dir FROM evidence)
  SELECT finding_id, ordinal, component_id, detector, round(CASE technique WHEN 'manifest-parse' THEN 0.85 WHEN 'lockfile-parse' THEN 0.92 WHEN 'os-package-db' THEN 0.97 ELSE 0.5 END * CASE WHEN dir IN ('tests', 'examples', 'docs') THEN 0.3 ELSE 1 END * CASE WHEN ordinal % 3 = 0 THEN 0.7 ELSE 1 END, 4)::DOUBLE AS confidence,
  CASE dir WHEN 'tests' THEN 'path-role-fixture,' WHEN 'examples' THEN 'path-role-example,' WHEN 'docs' THEN 'path-role-docs,' WHEN 'vendor' THEN 'vendored,' ELSE '' END || CASE WHEN ordinal % 3 = 0 THEN 'stale-lockfile,seen' ELSE 'seen' END AS reasons FROM e""")
def rated_evidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("ordinal")
    e = D.evidence(spark, d).withColumn("technique", F.element_at(F.array(*map(F.lit, ("manifest-parse", "lockfile-parse", "os-package-db", "guess"))), (n % 4 + 1).cast("int")))
    confidence, reasons = P.rated(F.col("technique"), X.path_role(F.col("path")), F.when(n % 3 == 0, F.array(F.lit("stale-lockfile"), F.lit("seen"))).otherwise(F.array(F.lit("seen"))))
    return e.select("finding_id", "ordinal", "component_id", "detector", confidence.alias("confidence"), F.array_join(reasons, ",").alias("reasons"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/srv/node_modules/a/' WHEN 1 THEN 'usr/lib/python3/dist-packages/' WHEN 2 THEN '/root/.m2/repository/x/' WHEN 3 THEN '/home/node_modules_old/' WHEN 4 THEN 'vendor/composer/' ELSE '/opt/' END || page_id AS path FROM pages)
  SELECT page_id, path, page_id % 6 NOT IN (3, 5) AS stored, 'a.zip!b.jar!' || path AS physical FROM p""")
def store_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    folders = F.array(*map(F.lit, ("/srv/node_modules/a/", "usr/lib/python3/dist-packages/", "/root/.m2/repository/x/", "/home/node_modules_old/", "vendor/composer/", "/opt/")))
    rows = D.table(spark, d, "pages").select("page_id", F.concat(F.element_at(folders, (k % 6 + 1).cast("int")), k.cast("string")).alias("path"))
    return rows.select("page_id", "path", X.in_store(F.col("path")).alias("stored"), X.physical_path(F.array(F.lit("a.zip"), F.lit("b.jar"), F.col("path"))).alias("physical"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'linux/arm/v' || page_id WHEN 1 THEN 'windows/amd64' WHEN 2 THEN NULL WHEN 3 THEN 'linux' ELSE '/arm' END AS text FROM pages)
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' WHEN 2 THEN 'linux' END AS os, CASE page_id % 5 WHEN 0 THEN 'arm' WHEN 1 THEN 'amd64' WHEN 2 THEN 'amd64' END AS arch, CASE WHEN page_id % 5 = 0 THEN 'v' || page_id END AS variant FROM p""")
def platforms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    text = F.when(k % 5 == 0, _text("linux/arm/v", k)).when(k % 5 == 1, "windows/amd64").when(k % 5 == 3, "linux").when(k % 5 == 4, "/arm")
    return D.table(spark, d, "pages").select("page_id", X.platform_parts(text).alias("x")).select("page_id", "x.os", "x.arch", "x.variant")


@query("""WITH c AS (SELECT p_partkey AS id, ['npm','maven','c','GitHub'][p_partkey % 4 + 1] AS eco, CASE p_partkey % 3 WHEN 0 THEN 'lib' || p_partkey ELSE 'group' || CASE WHEN p_partkey % 4 = 1 THEN ':' ELSE '/' END || 'art' || p_partkey END AS name FROM part)
  SELECT id, CASE WHEN eco <> 'c' THEN 'pkg:' || lower(eco) || '/' || replace(name, ':', '/') END AS purl, lower(CASE WHEN eco = 'maven' OR name LIKE '%/%' THEN eco || ':' || CASE WHEN id % 3 = 0 THEN '' ELSE 'group' END || ':' || CASE WHEN id % 3 = 0 THEN name ELSE 'art' || id END ELSE eco || '::' || name END) AS family FROM c""")
def versionless_purls(spark: SparkSession, d: str) -> DataFrame:
    k, null = F.col("p_partkey"), F.lit(None).cast("string")
    name = F.when(k % 3 == 0, _text("lib", k)).when(k % 4 == 1, _text("group:art", k)).otherwise(_text("group/art", k))
    rows = D.table(spark, d, "part").select(k.alias("id"), F.element_at(F.array(*map(F.lit, ("npm", "maven", "c", "GitHub"))), (k % 4 + 1).cast("int")).alias("ecosystem"), null.alias("namespace"), name.alias("name"), null.alias("purl"), F.lit("library").alias("ctype"))
    return rows.select("id", R.versionless_purl().alias("purl"), R.family_of().alias("family"))


# Observations ------------------------------------------------------------------------------

_SEEN = f"""{COMPONENTS}, c AS (SELECT id, ecosystem, name || '_' || (id % 400) AS name, version, tier_cap, confidence, scope, excluded FROM components), o AS (SELECT CASE WHEN l_partkey % 6 = 0 THEN 'pypi' ELSE lower(p_type) END AS ecosystem, replace(lower(p_name), '_', '-') || '-' || (p_partkey % 400) AS key, 'v' || l_linenumber AS detail, upper(p_name) || '-' || (p_partkey % 400) AS shown FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48),
  k AS (SELECT DISTINCT ecosystem, key FROM o), m AS (SELECT c.*, excluded IS NULL AND (ecosystem, replace(lower(name), '_', '-')) IN (SELECT (ecosystem, key) FROM k) AS hit FROM c), lost AS (SELECT DISTINCT ecosystem, key, detail FROM o WHERE (ecosystem, key) NOT IN (SELECT (ecosystem, replace(lower(name), '_', '-')) FROM c WHERE excluded IS NULL)), top AS (SELECT max(id) AS t FROM c)"""


def _observed(spark: SparkSession, d: str):
    k = F.col("id")
    c = D.components(spark, d).select("id", "ecosystem", _text(F.col("name"), "_", k % 400).alias("name"), "version", "tier_cap", "confidence", F.col("attrs")["scope"].alias("scope"), "excluded", F.lit(None).cast("string").alias("state"))
    part = D.table(spark, d, "part")
    seen = D.table(spark, d, "lineitem").where("l_quantity > 48").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.when(F.col("l_partkey") % 6 > 0, F.lower("p_type")).alias("ecosystem"), _text(F.upper("p_name"), "-", F.col("p_partkey") % 400).alias("name"), _text("v", F.col("l_linenumber")).alias("version"))
    return O.applied(c, seen)


@query(f"""WITH {_SEEN} SELECT id, name, version, CASE WHEN hit THEN 5 ELSE tier_cap END AS tier_cap, CASE WHEN hit THEN greatest(confidence, 0.98) ELSE confidence END AS confidence, CASE WHEN hit THEN 'runtime-observed' ELSE scope END AS scope FROM m
  UNION ALL SELECT t + row_number() OVER (ORDER BY ecosystem, key, detail), upper(key), detail, 5, 0.98, 'runtime-observed' FROM lost, top""")
def observed_components(spark: SparkSession, d: str) -> DataFrame:
    return _observed(spark, d).components.select("id", "name", "version", "tier_cap", "confidence", "scope")


@query(f"""WITH {_SEEN} SELECT id, 'runtime-observed' AS code FROM m WHERE hit UNION ALL SELECT t + row_number() OVER (ORDER BY ecosystem, key, detail), 'drift:observed-not-declared' FROM lost, top
  UNION ALL SELECT id, 'declared-never-observed' FROM m WHERE NOT hit AND excluded IS NULL AND scope NOT IN ('build', 'dev', 'test') AND ecosystem IN (SELECT ecosystem FROM o WHERE ecosystem <> 'pypi')""")
def observation_notes(spark: SparkSession, d: str) -> DataFrame:
    return _observed(spark, d).annotations


@query(f"""WITH {COMPONENTS}, {EVIDENCE} SELECT family, string_agg({TIER.format('tier')}, ',' ORDER BY tier) AS tiers FROM (SELECT DISTINCT ecosystem || ':' || (id % 700) AS family, tier FROM components JOIN evidence e ON component_id = id) GROUP BY 1""")
def family_tiers(spark: SparkSession, d: str) -> DataFrame:
    c = D.components(spark, d).select("id", _text(F.col("ecosystem"), ":", F.col("id") % 700).alias("family"))
    return I.tiers_present(c, D.evidence(spark, d))


@query("SELECT o_orderkey AS run_id, o_custkey AS subject, o_orderdate AS created, row_number() OVER (ORDER BY o_orderkey <> 37, o_orderdate DESC, o_orderkey DESC) AS place FROM orders")
def runs_listed(spark: SparkSession, d: str) -> DataFrame:
    runs = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("created"))
    return I.runs_listed(runs, 37).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {COMPONENTS}, {EVIDENCE} SELECT 'component' AS kind, 1 AS place, name AS what, version AS text FROM components WHERE id = 42 UNION ALL SELECT 'evidence', row_number() OVER (ORDER BY tier DESC, confidence DESC, finding_id, ordinal), {TIER.format('tier')}, path FROM evidence WHERE component_id = 42
  UNION ALL SELECT 'annotation', row_number() OVER (ORDER BY l_returnflag, l_orderkey::VARCHAR), l_returnflag, l_orderkey::VARCHAR FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem WHERE l_partkey = 42)""")
def component_detail(spark: SparkSession, d: str) -> DataFrame:
    notes = D.table(spark, d, "lineitem").select(F.col("l_partkey").alias("component_id"), F.col("l_returnflag").alias("code"), F.col("l_orderkey").cast("string").alias("detail")).distinct()
    return I.component_detail(D.components(spark, d), D.evidence(spark, d), notes, 42)
