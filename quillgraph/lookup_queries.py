"""Queries of lookups, range resolution and reconciliation over the derived tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import attribution as T
from quillgraph.operators import graph as G
from quillgraph.operators import resolution as R
from quillgraph.queries import COMPONENTS, EDGES, EVIDENCE, query
from quillgraph.sources import derived as D


def _text(*parts: object):
    """Columns and strings in one string."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


_WORD = "split_part(p_name, ' ', 2)"


@query(f"""WITH p AS (SELECT DISTINCT {_WORD} AS word, '/opt/' || CASE WHEN p_partkey % 2 = 0 THEN {_WORD} ELSE 'lib' || {_WORD} || '-1.' || p_size || '.so.2' END AS path FROM part),
  i AS (SELECT {_WORD} AS word, min(p_partkey) AS component_id FROM part GROUP BY 1) SELECT path, component_id FROM p JOIN i USING (word)""")
def attributed_paths(spark: SparkSession, d: str) -> DataFrame:
    part = D.table(spark, d, "part").withColumn("word", F.split_part("p_name", F.lit(" "), F.lit(2)))
    path = F.when(F.col("p_partkey") % 2 == 0, _text("/opt/", F.col("word"))).otherwise(_text("/opt/lib", F.col("word"), "-1.", F.col("p_size"), ".so.2"))
    known = part.select(F.col("p_partkey").alias("id"), F.initcap("word").alias("name"))
    return T.attributed(part.select(path.alias("path")), known)


@query("SELECT DISTINCT l_suppkey AS pid, o_custkey AS port FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def socket_ports(spark: SparkSession, d: str) -> DataFrame:
    sockets = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("inode"), F.col("o_custkey").alias("port"), F.when(F.col("o_orderstatus") == "O", "LISTEN").otherwise("ESTABLISHED").alias("state"))
    return T.listening_ports(sockets, D.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pid"), F.col("l_orderkey").alias("inode")))


@query(f"""WITH {COMPONENTS}, f AS (SELECT ecosystem, name, arg_max(id, (tier_cap, version, -id)) AS target FROM components GROUP BY 1, 2)
  SELECT 'family:' || ecosystem || '/' || upper(name) AS ref, target FROM f UNION ALL SELECT 'project:lib' || r_regionkey, r_regionkey FROM region UNION ALL SELECT 'resource:none', NULL""")
def edge_refs(spark: SparkSession, d: str) -> DataFrame:
    c = D.components(spark, d).withColumn("tier", F.col("tier_cap"))
    families = c.select(_text("family:", F.col("ecosystem"), "/", F.upper("name")).alias("ref")).distinct()
    projects = D.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), _text("lib", F.col("r_regionkey")).alias("path"))
    refs = families.unionByName(projects.select(_text("project:", F.col("path")).alias("ref"))).unionByName(spark.range(1).select(F.lit("resource:none").alias("ref")))
    return T.resolved_refs(refs, c, projects)


@query("SELECT 'lib' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN '^' || p_size || '.0.0' ELSE '>=20.0.0' END AS requested, p_size || '.' || (p_partkey % 10) || '.0' AS locked, p_partkey % 3 = 0 OR p_size >= 20 AS satisfied FROM part WHERE p_partkey % 3 < 2")
def lock_ranges(spark: SparkSession, d: str) -> DataFrame:
    part = D.table(spark, d, "part")
    k, name = F.col("p_partkey"), _text("lib", F.col("p_partkey")).alias("name")
    declared = part.select(name, F.when(k % 3 == 0, _text("^", F.col("p_size"), ".0.0")).when(k % 3 == 1, ">=20.0.0").otherwise("git+https://host/lib").alias("requested"))
    return T.verified_locks(declared, part.select(name, _text(F.col("p_size"), ".", k % 10, ".0").alias("version")))


@query(f"WITH {COMPONENTS}, m AS (SELECT name, version, 'home-' || min(id) AS homepage FROM components WHERE size >= 20 GROUP BY 1, 2) SELECT id, homepage, scope FROM components LEFT JOIN m USING (name, version)")
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    c = D.components(spark, d)
    found = c.where("cast(attrs['size'] as int) >= 20").groupBy("name", "version").agg(F.create_map(F.lit("homepage"), _text("home-", F.min("id")), F.lit("scope"), F.lit("never")).alias("attrs"))
    return T.enriched(c, found).select("id", F.try_element_at("attrs", F.lit("homepage")).alias("homepage"), F.col("attrs")["scope"].alias("scope"))


_STEPS = "steps AS (SELECT l_orderkey AS image, l_linenumber AS position, max(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("position")).agg(F.max("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))


@query(f"""WITH {_STEPS}, made AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY position) - 1 AS ordinal, 'step ' || part AS created_by FROM steps WHERE position % 3 <> 0), layers AS (SELECT o_orderkey AS image, unnest([0, 1, 2]) AS ordinal FROM orders)
  SELECT image, ordinal, coalesce(created_by, '') AS created_by FROM layers LEFT JOIN made USING (image, ordinal)""")
def history_links(spark: SparkSession, d: str) -> DataFrame:
    history = _steps(spark, d).select("image", "position", _text("step ", F.col("part")).alias("created_by"), (F.col("position") % 3 == 0).alias("empty"))
    layers = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ordinal"))
    return T.linked_history(history, layers)


@query(f"""WITH {_STEPS}, a AS (SELECT image, position AS ordinal, part % 3 AS k, row_number() OVER (PARTITION BY image, part % 3 ORDER BY position) AS n FROM steps), b AS (SELECT image, 10 - position AS line, supp % 3 AS k, row_number() OVER (PARTITION BY image, supp % 3 ORDER BY 10 - position) AS n FROM steps)
  SELECT a.image, ordinal, line FROM a LEFT JOIN b ON a.image = b.image AND a.k = b.k AND a.n = b.n""")
def dockerfile_links(spark: SparkSession, d: str) -> DataFrame:
    steps = _steps(spark, d)
    history = steps.select("image", F.col("position").alias("ordinal"), _text("RUN  make\t", F.col("part") % 3).alias("command"))
    lines = steps.select("image", (10 - F.col("position")).alias("line"), _text("run make ", F.col("supp") % 3).alias("instruction"))
    return T.linked_dockerfile(history, lines)


@query(f"""WITH {EDGES}, i AS (SELECT DISTINCT 'node_modules/m' || (src % 20) || '/node_modules/m' || (dst % 20) AS key FROM edges UNION SELECT 'node_modules/m' || unnest(range(10))), r AS (SELECT DISTINCT src % 20 AS a, dst % 20 AS b, (src + dst) % 20 AS c FROM edges),
  w AS (SELECT 'node_modules/m' || a || '/node_modules/m' || b AS key, 'm' || c AS dependency, 'node_modules/m' || a || '/node_modules/m' || b || '/node_modules/m' || c AS one, 'node_modules/m' || a || '/node_modules/m' || c AS two, 'node_modules/m' || c AS three FROM r)
  SELECT w.key, dependency, coalesce(x.key, y.key, z.key) AS target FROM w LEFT JOIN i x ON x.key = one LEFT JOIN i y ON y.key = two LEFT JOIN i z ON z.key = three""")
def nearest_installed(spark: SparkSession, d: str) -> DataFrame:
    e = D.edges(spark, d)
    key = _text("node_modules/m", F.col("src") % 20, "/node_modules/m", F.col("dst") % 20).alias("key")
    there = e.select(key).distinct().unionByName(spark.range(10).select(_text("node_modules/m", F.col("id")).alias("key")))
    return T.nearest_installed(e.select(key, _text("m", (F.col("src") + F.col("dst")) % 20).alias("dependency")).distinct(), there)


@query("SELECT DISTINCT l_orderkey AS project, l_linestatus AS declared, o_orderstatus AS detected FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus <> o_orderstatus")
def license_mismatches(spark: SparkSession, d: str) -> DataFrame:
    declared = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project"), F.col("l_linestatus").alias("license")).distinct()
    return T.license_mismatches(declared, D.table(spark, d, "orders").select(F.col("o_orderkey").alias("project"), F.col("o_orderstatus").alias("license")))


@query("SELECT l_partkey AS module, l_linenumber AS version FROM lineitem EXCEPT SELECT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def beyond_required(spark: SparkSession, d: str) -> DataFrame:
    i = D.table(spark, d, "lineitem")
    names = F.col("l_partkey").alias("module"), F.col("l_linenumber").alias("version")
    return T.beyond_required(i.select(*names), i.where("l_returnflag = 'R'").select(*names))


@query(f"""WITH RECURSIVE {EDGES}, reach AS (SELECT 5::BIGINT AS node UNION SELECT dst FROM reach JOIN edges ON src = node), e AS (SELECT '' AS parent, 5::BIGINT AS node UNION SELECT 'm' || src, dst FROM edges JOIN reach ON src = node)
  SELECT parent, 'm' || node AS name, '^1.0.0' AS wanted, '1.' || (node % 7) || '.0' AS version FROM e""")
def range_resolution(spark: SparkSession, d: str) -> DataFrame:
    published = D.table(spark, d, "part").select(_text("m", F.col("p_partkey")).alias("name"), F.array(F.lit("1.0.0"), _text("1.", F.col("p_partkey") % 7, ".0"), F.lit("2.0.0")).alias("versions"))
    needs = D.edges(spark, d).select(_text("m", F.col("src")).alias("name"), _text("1.", F.col("src") % 7, ".0").alias("version"), _text("m", F.col("dst")).alias("dep_name"), F.lit("^1.0.0").alias("dep_wanted")).distinct()
    return G.resolved_ranges(spark.createDataFrame([("m5", "^1.0.0")], "name string, wanted string"), published, needs)[0]


@query(f"""WITH RECURSIVE {COMPONENTS}, {EVIDENCE}, {EDGES}, links AS (SELECT DISTINCT src, dst FROM edges), t AS (SELECT id, purl FROM components WHERE purl = (SELECT min(purl) FROM components WHERE id = 77) ORDER BY name, version, id LIMIT 5),
  walk AS (SELECT id AS target, [id] AS path, id AS head FROM t UNION ALL SELECT target, list_prepend(src, path), src FROM walk JOIN links ON head = dst WHERE NOT list_contains(path, src)),
  ways AS (SELECT target, path, row_number() OVER (PARTITION BY target ORDER BY len(path), path) AS place FROM walk WHERE NOT EXISTS (SELECT 1 FROM links WHERE dst = head) AND len(path) > 1),
  steps AS (SELECT target, place, unnest(path) AS node, unnest(range(len(path))) AS step FROM ways WHERE place <= 8)
  SELECT target AS id, 'path' AS kind, place, string_agg(coalesce(purl, 'project:' || node), ' > ' ORDER BY step) AS text FROM steps LEFT JOIN components c ON c.id = node GROUP BY 1, 3
  UNION ALL SELECT component_id, 'evidence', row_number() OVER (PARTITION BY component_id ORDER BY tier DESC, e.confidence DESC, finding_id, ordinal), tier || ' ' || printf('%.2f', e.confidence) || ' ' || path FROM evidence e WHERE component_id IN (SELECT id FROM t)""")
def explain_component(spark: SparkSession, d: str) -> DataFrame:
    c = D.components(spark, d)
    ref = c.where("id = 77").agg(F.min("purl")).first()[0]
    return G.explained(c, D.edges(spark, d), D.evidence(spark, d), ref)


_CLAIMS = """claims AS (SELECT p_partkey AS id, 'lib' || (p_partkey % 150) AS name, CASE WHEN p_partkey % 5 > 0 THEN (p_size % 3) || '.0' END AS version, CAST(p_partkey % 4 + 1 AS INTEGER) AS tier FROM part)"""


@query(f"""WITH {_CLAIMS}, k AS (SELECT *, min(id) OVER (PARTITION BY name, version) AS own FROM claims), n AS (SELECT name, count(DISTINCT own) AS n, min(own) AS sole FROM k WHERE version IS NOT NULL GROUP BY 1), b AS (SELECT name, min(id) AS bare FROM k WHERE version IS NULL GROUP BY 1),
  r AS (SELECT k.*, CASE WHEN version IS NOT NULL THEN own WHEN n = 1 THEN sole ELSE bare END AS root, CASE WHEN version IS NULL AND n > 1 THEN 'ambiguous-declared' END AS status FROM k LEFT JOIN n USING (name) LEFT JOIN b USING (name)),
  {EVIDENCE}, s AS (SELECT root, count(*) AS n_evidence, max(e.tier) AS tier_cap, product(1 - greatest(0, least(1, e.confidence))) AS doubt FROM r JOIN evidence e ON e.component_id = r.id GROUP BY 1), g AS (SELECT root, min(name) AS name, max(version) AS version, count(*) AS n_claims, max(status) AS status FROM r GROUP BY 1)
  SELECT root, name, version, n_claims, status, n_evidence, round(least(1 - doubt, CASE tier_cap WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 WHEN 3 THEN 0.95 WHEN 4 THEN 0.98 ELSE 1.0 END), 4)::DOUBLE AS confidence FROM g LEFT JOIN s USING (root)""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    claims = D.table(spark, d, "part").select(k.alias("id"), F.lit("generic").alias("ecosystem"), _text("lib", k % 150).alias("name"), F.when(k % 5 > 0, _text(F.col("p_size") % 3, ".0")).alias("version"), F.lit(None).cast("string").alias("purl"), F.create_map().cast("map<string,string>").alias("hashes"), (k % 4 + 1).cast("int").alias("tier"), F.lit(None).cast("string").alias("license"))
    found = R.reconciled(claims, D.evidence(spark, d).withColumnRenamed("component_id", "claim_id").select("claim_id", "tier", "confidence"))
    return found.select("root", "name", "version", "n_claims", "status", "n_evidence", "confidence")
