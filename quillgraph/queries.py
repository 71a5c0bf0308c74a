"""The queries over the derived tables, each with SQL that an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.versions import semver_in, version_compare
from quillgraph.operators import analytics as A
from quillgraph.operators import graph as G
from quillgraph.operators import matching as M
from quillgraph.operators import resolution as R
from quillgraph.operators import setops as S
from quillgraph.operators import timeline as L
from quillgraph.plans import dsl
from quillgraph.sources import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The derived tables in SQL ------------------------------------------------------

COMPONENTS = """components AS (SELECT p_partkey AS id, p_name AS name, p_size || '.' || (p_partkey % 10) || '.0' AS version, lower(p_type) AS ecosystem,
  'pkg:' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '@' || p_size || '.' || (p_partkey % 10) || '.0' AS purl,
  CASE WHEN p_partkey % 7 = 0 THEN 'os-package' ELSE 'library' END AS ctype, CAST(p_partkey % 5 + 1 AS INTEGER) AS tier_cap,
  round(0.5 + (p_partkey % 50) / 100.0, 4)::DOUBLE AS confidence, CASE WHEN p_partkey % 20 = 0 THEN 'fixture-only' END AS excluded,
  CASE p_partkey % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'dev' ELSE 'test' END AS scope,
  CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS observed, 'layer-' || (p_partkey % 2) AS layer, p_size AS size FROM part)"""
EVIDENCE = """evidence AS (SELECT l_orderkey AS finding_id, l_linenumber AS ordinal, l_partkey AS component_id, l_suppkey AS detector, CAST(l_linenumber % 5 + 1 AS INTEGER) AS tier,
  round(l_discount * 9 + 0.0, 4) AS confidence, CASE WHEN l_partkey % 25 = 0 THEN 'tests' ELSE ['tests','vendor','docs','src','examples'][l_suppkey % 5 + 1] END || '/' || l_orderkey AS path FROM lineitem)"""
EDGES = """edges AS (SELECT p_partkey // 3 AS src, p_partkey AS dst, NULL::VARCHAR AS marker FROM part WHERE p_partkey > 0
  UNION ALL SELECT p_partkey // 7, p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'extra == "all"' END FROM part WHERE p_partkey > 0 AND p_partkey % 4 = 0)"""
TIER = "CASE {0} WHEN 1 THEN 'inferred' WHEN 2 THEN 'declared' WHEN 3 THEN 'locked' WHEN 4 THEN 'installed' WHEN 5 THEN 'observed' END"
CAP = "CASE {0} WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 WHEN 3 THEN 0.95 WHEN 4 THEN 0.98 ELSE 1.0 END"
ROWS = "id, purl, name, version, ecosystem, " + TIER.format("tier_cap") + " AS tier, confidence, scope, excluded"
STATES = """states AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS ordinal, user_id AS family, arg_max(event_type, (ts, event_id)) AS version FROM events GROUP BY 1, 2)"""
SNAP = """snap AS (SELECT l_shipdate < TIMESTAMP '1995-06-17' AS early, l_partkey, max(l_linenumber) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
  sides AS (SELECT early, 'lib-' || (l_partkey % 1500) AS family, l_partkey AS id, n || '.' || CAST(floor(q) AS BIGINT) AS version, CASE WHEN n > 4 THEN 'dev' ELSE 'runtime' END AS scope, round(q / 100 + 0.3, 4) AS confidence, n, q FROM snap)"""
FLEET = """fleet AS (SELECT DISTINCT 'host' || lpad(l_suppkey::VARCHAR, 5, '0') AS host, l_partkey AS id FROM lineitem),
  rows AS (SELECT host, c.name AS identity, c.name, c.version, c.tier_cap AS tier, c.confidence, coalesce(c.observed = 'true', false) AS observed FROM fleet JOIN components c USING (id) WHERE excluded IS NULL)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def asks(name: str, text: str, sql: str) -> None:
    """A query-language query."""
    query(sql, name)(lambda spark, d: dsl.run(D.components(spark, d), text, D.edges(spark, d)))


# Query language -----------------------------------------------------------------

asks("dsl_filter", "components where ecosystem = economy and confidence < 0.9", f"WITH {COMPONENTS} SELECT {ROWS} FROM components WHERE ecosystem = 'economy' AND confidence < 0.9")
asks("dsl_count_by_tier", "components where ecosystem = economy and confidence < 0.9 | count by tier", f"WITH {COMPONENTS} SELECT {TIER.format('tier_cap')} AS bucket, count(*) AS count FROM components WHERE ecosystem = 'economy' AND confidence < 0.9 GROUP BY 1")
asks("dsl_count_by_observed", "components | count by observed", f"WITH {COMPONENTS} SELECT coalesce(observed, '(none)') AS bucket, count(*) AS count FROM components GROUP BY 1")
asks("dsl_glob", 'components where name ~ "*R?d*" or name ~ "small*"', f"WITH {COMPONENTS} SELECT {ROWS} FROM components WHERE name ILIKE '%r_d%' OR name ILIKE 'small%'")
asks("dsl_bool_null", "components where (observed = false or scope = dev) and excluded != x", f"WITH {COMPONENTS} SELECT {ROWS} FROM components WHERE (observed IS NULL OR observed <> 'true' OR scope = 'dev') AND excluded <> 'x'")
asks("dsl_tier", 'components where tier >= locked and (version < "3.1.0" or attrs.size >= 40)', f"WITH {COMPONENTS} SELECT {ROWS} FROM components WHERE tier_cap >= 3 AND (version < '3.1.0' OR size >= 40)")
asks("dsl_layer", 'components where introduced_by.layer = "layer-1" and introduced_by.base_image = false and type = "os-package"', f"WITH {COMPONENTS} SELECT {ROWS} FROM components WHERE layer = 'layer-1' AND ctype = 'os-package'")


@query(f"""WITH RECURSIVE {COMPONENTS}, {EDGES}, links AS (SELECT DISTINCT src, dst FROM edges), t AS (SELECT id FROM components WHERE purl = (SELECT min(purl) FROM components WHERE id = 77)),
  walk AS (SELECT id AS target, [id] AS path, id AS head FROM t UNION ALL SELECT target, list_prepend(src, path), src FROM walk JOIN links ON head = dst WHERE NOT list_contains(path, src))
  SELECT target, list_aggregate(path, 'string_agg', '>') AS path, len(path) AS length, name AS root FROM walk JOIN components ON components.id = path[1] WHERE NOT EXISTS (SELECT 1 FROM links WHERE dst = head)""")
def dsl_paths(spark: SparkSession, d: str) -> DataFrame:
    ref = D.components(spark, d).where("id = 77").agg(F.min("purl")).first()[0]
    found = dsl.run(D.components(spark, d), f'paths from * to "{ref}"', D.edges(spark, d))
    return found.select("target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length", "root")


@query(f"WITH {COMPONENTS} SELECT id, name, version FROM components WHERE lower(name) = 'red widget' AND version = '28.1.0'")
def find_component(spark: SparkSession, d: str) -> DataFrame:
    return A.find_component(D.components(spark, d), "Red Widget@28.1.0").select("id", "name", "version")


@query(f"WITH {COMPONENTS} SELECT DISTINCT purl AS ref FROM components WHERE lower(name) LIKE '%bolt%' ORDER BY 1 LIMIT 5")
def near_matches(spark: SparkSession, d: str) -> DataFrame:
    return A.near_matches(D.components(spark, d), "Bolt")


# Counters, clusters, dependency levels --------------------------------------------

_COUNT = "count(*) FILTER (excluded IS NULL) AS emitted, count(*) FILTER (excluded IS NULL AND confidence >= 0.9) AS sure, count(excluded) AS excluded"


@query(f"WITH {COMPONENTS} SELECT ecosystem AS key, {_COUNT} FROM components GROUP BY 1")
def counters_by_ecosystem(spark: SparkSession, d: str) -> DataFrame:
    return A.counters(D.components(spark, d), F.col("ecosystem"))


@query(f"WITH {COMPONENTS} SELECT {TIER.format('tier_cap')} AS key, {_COUNT} FROM components GROUP BY 1")
def counters_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return A.counters(D.components(spark, d), dsl.tier_label(F.col("tier_cap")))


for _by, _sql in (("ecosystem", "ecosystem"), ("layer", "layer"), ("tier", "tier_cap::VARCHAR")):
    query(f"WITH {COMPONENTS} SELECT {_sql} AS cluster, count(*) AS members, round(max(confidence), 4) AS best FROM components WHERE excluded IS NULL GROUP BY 1", f"lod_overview_{_by}")(lambda spark, d, by=_by: A.lod_overview(D.components(spark, d), by))


@query(f"WITH {COMPONENTS}, {EDGES} SELECT DISTINCT a.ecosystem AS from_cluster, b.ecosystem AS to_cluster FROM edges JOIN components a ON a.id = src JOIN components b ON b.id = dst WHERE a.excluded IS NULL AND b.excluded IS NULL AND a.ecosystem <> b.ecosystem")
def lod_edges(spark: SparkSession, d: str) -> DataFrame:
    return A.lod_edges(D.components(spark, d), D.edges(spark, d))


@query(f"WITH {COMPONENTS} SELECT id, name, version, confidence FROM components WHERE excluded IS NULL AND ecosystem = 'economy' ORDER BY confidence DESC, name, id LIMIT 51")
def lod_expand(spark: SparkSession, d: str) -> DataFrame:
    return A.lod_expand(D.components(spark, d), "economy", budget=50)


@query(f"WITH {COMPONENTS}, {EDGES}, m AS (SELECT id FROM components WHERE excluded IS NULL AND ecosystem = 'economy') SELECT src, dst, marker FROM edges WHERE src IN (FROM m) AND dst IN (FROM m)")
def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    members = A.kept(D.components(spark, d)).where("ecosystem = 'economy'")
    return A.induced_edges(members, D.edges(spark, d)).select("src", "dst", "marker")


_KIDS = "LEFT JOIN (SELECT src, count(DISTINCT dst) AS kids FROM edges GROUP BY src) k ON k.src = c.id"


@query(f"WITH {COMPONENTS}, {EDGES}, base AS (SELECT * FROM edges WHERE src > 0) SELECT c.id, c.name, c.version, coalesce(kids, 0) AS kids FROM components c LEFT JOIN (SELECT src, count(DISTINCT dst) AS kids FROM base GROUP BY src) k ON k.src = c.id WHERE excluded IS NULL AND NOT EXISTS (SELECT 1 FROM base WHERE dst = c.id) ORDER BY name, version, id LIMIT 501")
def deps_roots(spark: SparkSession, d: str) -> DataFrame:
    """Node 0 is the project, not a component: its edges are no dependencies between components."""
    return A.deps_roots(D.components(spark, d), D.edges(spark, d).where("src > 0"))


@query(f"WITH {COMPONENTS}, {EDGES} SELECT c.id, c.name, c.version, coalesce(kids, 0) AS kids FROM components c {_KIDS} WHERE excluded IS NULL AND c.id IN (SELECT dst FROM edges WHERE edges.src = 5)")
def deps_down(spark: SparkSession, d: str) -> DataFrame:
    return A.deps_level(D.components(spark, d), D.edges(spark, d), 5)


@query(f"WITH {COMPONENTS}, {EDGES} SELECT c.id, c.name, c.version, coalesce(kids, 0) AS kids FROM components c {_KIDS} WHERE excluded IS NULL AND c.id IN (SELECT edges.src FROM edges WHERE dst = 88)")
def deps_up(spark: SparkSession, d: str) -> DataFrame:
    return A.deps_level(D.components(spark, d), D.edges(spark, d), 88, down=False)


# Evidence, scores, rules ----------------------------------------------------------


@query(f"WITH {COMPONENTS}, {EVIDENCE} SELECT name, finding_id, ordinal, detector, tier, e.confidence, path FROM evidence e JOIN components c ON c.id = component_id WHERE component_id = 42")
def evidence_detail(spark: SparkSession, d: str) -> DataFrame:
    return A.evidence_detail(D.components(spark, d), D.evidence(spark, d), 42)


@query(f"WITH {EVIDENCE} SELECT component_id, count(*) AS n_evidence, max(tier) AS tier_cap, round(least(1 - product(1 - greatest(0, least(1, confidence))), {CAP.format('max(tier)')}), 4)::DOUBLE AS confidence FROM evidence GROUP BY 1")
def noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return A.noisy_or(D.evidence(spark, d))


@query(f"WITH {EVIDENCE} SELECT component_id, count(*) AS n FROM evidence GROUP BY 1 HAVING bool_and(path LIKE 'tests/%')")
def fixture_only(spark: SparkSession, d: str) -> DataFrame:
    return A.fixture_only(D.evidence(spark, d))


@query(f"""WITH {COMPONENTS}, claims AS (SELECT name AS family, id, tier_cap AS tier, CASE WHEN id % 6 > 0 THEN version END AS version FROM components),
  pins AS (SELECT *, first_value(version IGNORE NULLS) OVER w AS pin, first_value(CASE WHEN version IS NOT NULL THEN tier END IGNORE NULLS) OVER w AS pin_tier FROM claims WINDOW w AS (PARTITION BY family ORDER BY tier DESC, version DESC NULLS LAST, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  SELECT family, id, tier, version, pin, CASE WHEN version IS NULL THEN 'versionless' WHEN version = pin THEN 'pinned' WHEN tier = pin_tier THEN 'version-conflict' ELSE 'superseded-version' END AS state FROM pins""")
def pin_version(spark: SparkSession, d: str) -> DataFrame:
    claims = D.components(spark, d).select(F.col("name").alias("family"), "id", F.col("tier_cap").alias("tier"), F.when(F.col("id") % 6 > 0, F.col("version")).alias("version"))
    return A.pinned(claims)


_DRIFT = """fam AS (SELECT *, ecosystem || ':f' || (id % 300) AS family, id % 300 % 6 AS kind, id % 300 % 4 = 1 AS optional FROM components),
  ev AS (SELECT l_partkey AS component_id, CASE WHEN ecosystem = 'small' OR kind = 0 AND ecosystem <> 'large' THEN 2 + l_linenumber % 2 WHEN kind = 1 OR ecosystem = 'large' THEN 4 + l_linenumber % 2 ELSE l_linenumber % 5 + 1 END AS tier FROM lineitem JOIN fam ON id = l_partkey),
  per AS (SELECT id, family, ecosystem, confidence, optional OR scope = 'build' AS aside, coalesce(bool_or(tier IN (2, 3)), false) AS d, coalesce(bool_or(tier IN (4, 5)), false) AS i, coalesce(bool_or(tier = 4), false) AS t FROM fam LEFT JOIN ev ON component_id = id GROUP BY ALL),
  families AS (SELECT family, ecosystem, bool_or(d) AS d, bool_or(i) AS i, bool_or(t) AS t, bool_and(aside) AS aside FROM per GROUP BY 1, 2), eco AS (SELECT ecosystem, bool_or(t) AS has_i, bool_or(d) AS has_d FROM families GROUP BY 1),
  codes AS (SELECT family, CASE WHEN d AND NOT i AND NOT aside AND has_i THEN 'drift:declared-not-installed' WHEN i AND NOT d AND has_d AND ecosystem NOT IN ('deb', 'apk', 'alpm') THEN 'drift:installed-not-declared' END AS code FROM families JOIN eco USING (ecosystem)),
  drift AS (SELECT id AS component_id, family, code, round(confidence * CASE WHEN code LIKE '%installed-not-declared' THEN 0.8 ELSE 1 END, 4)::DOUBLE AS confidence FROM per JOIN codes USING (family) WHERE code IS NOT NULL)"""


def _drift(spark: SparkSession, d: str) -> DataFrame:
    """Families of one kind each: declared only, installed only, or both; one ecosystem has nothing installed, one nothing declared."""
    part = F.col("id") % 300
    c = D.components(spark, d).select("id", F.concat("ecosystem", F.lit(":f"), part.cast("string")).alias("family"), "ecosystem", "ctype", F.col("attrs")["scope"].alias("scope"), F.lit(False).alias("conditional"), (part % 4 == 1).alias("optional"), "confidence")
    kind, line = part % 6, F.col("l_linenumber")
    declared = (F.col("ecosystem") == "small") | ((kind == 0) & (F.col("ecosystem") != "large"))
    tier = F.when(declared, 2 + line % 2).when((kind == 1) | (F.col("ecosystem") == "large"), 4 + line % 2).otherwise(line % 5 + 1)
    seen = D.table(spark, d, "lineitem").select(F.col("l_partkey").alias("component_id"), "l_linenumber").join(c.select("id", "ecosystem"), F.col("component_id") == F.col("id")).select("component_id", tier.alias("tier"))
    return A.drift(c, seen)


@query(f"WITH {COMPONENTS}, {_DRIFT} SELECT component_id, family, code, confidence FROM drift")
def drift_rules(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d)


@query(f"WITH {COMPONENTS}, {_DRIFT} SELECT code, count(*) AS size, min(purl) AS first_ref FROM drift LEFT JOIN components ON id = component_id GROUP BY 1")
def drift_board(spark: SparkSession, d: str) -> DataFrame:
    return A.drift_board(_drift(spark, d), D.components(spark, d))


_EMIT = """fixtures AS (SELECT component_id FROM evidence GROUP BY 1 HAVING bool_and(path LIKE 'tests/%')),
  emit AS (SELECT id, CASE WHEN id IN (FROM fixtures) THEN 'fixture-only' WHEN tier_cap = 1 AND confidence < 0.8 THEN 'low-confidence' WHEN scope <> 'runtime' THEN 'scope' END AS reason FROM components)"""


def _emit(spark: SparkSession, d: str, **rules) -> DataFrame:
    return A.emit_set(D.components(spark, d), A.fixture_only(D.evidence(spark, d)), **rules)


@query(f"WITH {COMPONENTS}, {EVIDENCE}, {_EMIT} SELECT id, reason FROM emit")
def emit_set(spark: SparkSession, d: str) -> DataFrame:
    return _emit(spark, d)


@query(f"WITH {COMPONENTS}, {EVIDENCE}, {_EMIT} SELECT id, CASE WHEN tier_cap < 3 THEN 'below-locked' WHEN reason <> 'scope' THEN reason END AS reason FROM emit JOIN components USING (id)")
def emit_paranoid(spark: SparkSession, d: str) -> DataFrame:
    return _emit(spark, d, paranoid=True, scopes=())


@query(f"""WITH {COMPONENTS}, {EVIDENCE}, {_DRIFT}, {_EMIT}, rules(rule) AS (VALUES ('drift:installed'), ('low-confidence'), ('weak-crypto')), found AS (SELECT code FROM drift UNION SELECT reason FROM emit WHERE reason = 'low-confidence')
  SELECT rule, EXISTS (SELECT 1 FROM found WHERE starts_with(code, rule)) AS failed FROM rules""")
def policy_gate(spark: SparkSession, d: str) -> DataFrame:
    return A.policy_failed(_drift(spark, d), _emit(spark, d), ("drift:installed", "low-confidence", "weak-crypto"))


@query("""WITH e AS (SELECT l_returnflag AS kind, l_partkey % 100 AS src, l_suppkey % 100 AS dst, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS ordinal, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS scope, CASE WHEN l_linenumber % 4 = 1 THEN '^' || l_suppkey END AS requested, l_tax > 0.07 AS direct, CASE WHEN l_linenumber % 3 = 0 THEN 'm' || l_orderkey END AS marker FROM lineitem WHERE l_partkey % 100 <> l_suppkey % 100)
  SELECT kind, src, dst, arg_min(scope, ordinal) FILTER (scope IS NOT NULL) AS scope, arg_min(requested, ordinal) FILTER (requested IS NOT NULL) AS requested, bool_or(direct) AS direct, arg_max(marker, ordinal) FILTER (marker IS NOT NULL) AS marker, arg_max(ordinal::VARCHAR, ordinal) AS last FROM e GROUP BY 1, 2, 3""")
def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    i, n = D.table(spark, d, "lineitem"), F.col("l_linenumber")
    ordinal = ((F.col("l_orderkey") * 10 + n) * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000
    rows = i.select(F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 100).alias("src"), (F.col("l_suppkey") % 100).alias("dst"), ordinal.alias("ordinal"), F.when(n % 2 == 0, F.col("l_linestatus")).alias("scope"), F.when(n % 4 == 1, F.concat(F.lit("^"), F.col("l_suppkey").cast("string"))).alias("requested"), (F.col("l_tax") > 0.07).alias("direct"), F.when(n % 3 == 0, F.concat(F.lit("m"), F.col("l_orderkey").cast("string"))).alias("marker"), F.create_map(F.lit("last"), ordinal.cast("string")).alias("attrs"))
    return A.merged_edges(rows).withColumn("last", F.col("attrs")["last"]).drop("attrs")


@query(f"WITH {EVIDENCE} SELECT component_id, list_aggregate(list_sort(list(DISTINCT path)), 'string_agg', ',') AS instance_paths FROM evidence GROUP BY 1")
def instance_paths(spark: SparkSession, d: str) -> DataFrame:
    return A.instance_paths(D.evidence(spark, d))


# Layers, snapshots, lineage ---------------------------------------------------------

_TRANS = f"{STATES}, trans AS (SELECT ordinal, CASE WHEN lag(version) OVER (PARTITION BY family ORDER BY ordinal) IS NULL THEN 'added' ELSE 'modified' END AS state FROM states)"


@query(f"WITH {_TRANS} SELECT ordinal, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'modified') AS modified, 0::BIGINT AS removed FROM trans GROUP BY 1")
def layers_pivot(spark: SparkSession, d: str) -> DataFrame:
    members = D.states(spark, d).select("ordinal", F.concat(F.lit("opt/"), F.col("family").cast("string")).alias("path"))
    return L.layers_pivot(L.layer_transitions(members))


@query(f"WITH {STATES}, f AS (SELECT family, min(ordinal) AS ordinal FROM states GROUP BY 1) SELECT CASE WHEN ordinal < 1 THEN 'base' ELSE 'added' END AS origin, count(*) AS count FROM f GROUP BY 1")
def base_split(spark: SparkSession, d: str) -> DataFrame:
    return L.base_split(D.states(spark, d).groupBy("family").agg(F.min("ordinal").alias("ordinal")), 1)


@query(f"WITH {STATES} SELECT family, version, min(ordinal) AS first_ordinal FROM states GROUP BY 1, 2")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return L.first_seen(D.states(spark, d))


@query(f"WITH {STATES}, f AS (SELECT DISTINCT family, 12 AS at FROM states) SELECT f.family, s.ordinal, s.version FROM f ASOF JOIN states s ON f.family = s.family AND f.at >= s.ordinal")
def asof_owner(spark: SparkSession, d: str) -> DataFrame:
    return L.owners_upto(D.states(spark, d), 12)


@query(f"""WITH {STATES}, days AS (SELECT ordinal, lead(ordinal) OVER (ORDER BY ordinal) AS next FROM (SELECT DISTINCT ordinal FROM states)),
  runs AS (SELECT a.family, a.ordinal, a.version, d.next, (SELECT max(b.ordinal) FROM states b WHERE b.family = a.family AND b.ordinal <= a.ordinal AND NOT EXISTS (SELECT 1 FROM states c JOIN days e ON c.ordinal = e.ordinal WHERE c.family = b.family AND e.next = b.ordinal AND c.version = b.version)) AS since FROM states a JOIN days d USING (ordinal))
  SELECT r.family, CASE WHEN n.version IS NULL THEN 'removed' ELSE 'upgraded' END AS kind, r.version AS old_version, since AS old_ordinal, n.version AS new_version, r.next AS new_ordinal FROM runs r LEFT JOIN states n ON n.family = r.family AND n.ordinal = r.next WHERE r.next IS NOT NULL AND (n.version IS NULL OR n.version <> r.version)""")
def snapshot_timeline(spark: SparkSession, d: str) -> DataFrame:
    return L.snapshot_timeline(D.states(spark, d))


@query(f"WITH {STATES}, f AS (SELECT family, version, min(ordinal) AS first_ordinal FROM states GROUP BY 1, 2) SELECT family, version, first_ordinal, 'sha-' || first_ordinal AS digest FROM f WHERE version = 'signup'")
def introducing_layer(spark: SparkSession, d: str) -> DataFrame:
    states = D.states(spark, d)
    layers = states.select("ordinal").distinct().withColumn("digest", F.concat(F.lit("sha-"), F.col("ordinal").cast("string")))
    return L.introducing(states.where("version = 'signup'").select("family", "version").distinct(), states, layers)


_RUNS = "runs AS (SELECT o_custkey AS subject, o_orderdate AS created, o_orderkey AS run_id, o_orderstatus AS serial FROM orders)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("serial"))


@query(f"""WITH {_RUNS}, a AS (SELECT *, CASE WHEN lag(serial) OVER w IS DISTINCT FROM serial THEN 1 ELSE 0 END AS new FROM runs WINDOW w AS (PARTITION BY subject ORDER BY created, run_id)), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY subject ORDER BY created, run_id) AS BIGINT) AS version FROM a)
  SELECT subject, run_id, version, CASE WHEN version = 1 AND new = 1 THEN 'initial' WHEN new = 0 THEN 'identical' ELSE 'subject-changed' END AS reason FROM b""")
def lineage_versions(spark: SparkSession, d: str) -> DataFrame:
    return L.lineage(_runs(spark, d))


@query(f"WITH {_RUNS} SELECT subject, arg_max(run_id, (created, run_id)) AS run_id FROM runs GROUP BY 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_runs(_runs(spark, d))


@query("WITH e AS (SELECT c_nationkey AS shelf, c_custkey AS key, sum(1 + c_custkey % 97) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC ROWS UNBOUNDED PRECEDING) AS held FROM customer) SELECT shelf, key FROM e WHERE held > 1000")
def cache_lru_prune(spark: SparkSession, d: str) -> DataFrame:
    c = D.table(spark, d, "customer")
    return L.prune_least_used(c.select(F.col("c_nationkey").alias("shelf"), F.col("c_custkey").alias("key"), (1 + F.col("c_custkey") % 97).alias("size"), F.col("c_acctbal").alias("last_used")), 1000)


@query(f"WITH {COMPONENTS}, c AS (SELECT name, version, id FROM components ORDER BY name, version, id) SELECT id, name, version FROM c WHERE (name, version, id) > ('red plate', '3', 7) ORDER BY name, version, id LIMIT 100")
def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    return A.page(D.components(spark, d).select("id", "name", "version"), A.cursor_of(("red plate", "3", 7)), 100)


# Fleet, diff, merge -----------------------------------------------------------------


def _fleet(spark: SparkSession, d: str) -> DataFrame:
    held = D.presence(spark, d)
    observed = F.coalesce(F.col("attrs")["observed"] == "true", F.lit(False))
    c = D.components(spark, d).select(F.col("id").alias("component_id"), "name", "version", F.col("tier_cap").alias("tier"), "confidence", observed.alias("observed"), F.when(observed, "443").otherwise("").alias("ports"), "excluded")
    return held.join(c, "component_id").select("host", F.col("name").alias("identity"), "name", "version", "tier", "confidence", "observed", "ports", "excluded")


@query(f"""WITH {COMPONENTS}, {FLEET} SELECT identity, arg_min(version, (-tier, -confidence, host, version)) AS version, max(tier) AS tier, max((tier, confidence))[2] AS confidence, count(DISTINCT host) AS hosts, bool_or(observed) AS observed,
  md5(string_agg(host || ' ' || version || CASE WHEN observed THEN ' observed 443' ELSE '' END, ',' ORDER BY host, version, observed)) AS seen_in FROM rows GROUP BY 1""")
def fleet_merge(spark: SparkSession, d: str) -> DataFrame:
    seen = F.transform("seen_in", lambda x: F.concat(x.host, F.lit(" "), x.version, F.when(x.observed, F.concat(F.lit(" observed "), x.ports)).otherwise("")))
    return A.fleet_merge(_fleet(spark, d)).select("identity", "version", "tier", "confidence", "hosts", "observed", F.md5(F.array_join(seen, ",")).alias("seen_in"))


@query(f"WITH {COMPONENTS}, {FLEET} SELECT host, name, version, observed FROM rows WHERE name ILIKE 'red%' AND version < '20' AND observed")
def fleet_rows(spark: SparkSession, d: str) -> DataFrame:
    return _fleet(spark, d).where(F.col("excluded").isNull() & F.col("name").ilike("red%") & (F.col("version") < "20") & F.col("observed")).select("host", "name", "version", "observed")


@query(f"WITH {COMPONENTS}, {FLEET} SELECT host, count(*) AS components, count(*) FILTER (observed) AS observed FROM rows GROUP BY 1")
def fleet_rollup(spark: SparkSession, d: str) -> DataFrame:
    return A.fleet_rollup(A.fleet_merge(_fleet(spark, d)))


@query(f"""WITH {COMPONENTS}, {FLEET}, s AS (SELECT name FROM rows GROUP BY 1 HAVING count(DISTINCT version) > 1 ORDER BY name LIMIT 100)
  SELECT name, host, list_aggregate(list_sort(list(DISTINCT version)), 'string_agg', ',') AS versions FROM rows SEMI JOIN s USING (name) GROUP BY 1, 2""")
def version_skew(spark: SparkSession, d: str) -> DataFrame:
    return A.version_skew(A.fleet_merge(_fleet(spark, d)))


@query(f"""WITH {SNAP}, one AS (SELECT * FROM sides WHERE id % 20 > 0 QUALIFY row_number() OVER (PARTITION BY early, family ORDER BY id) = 1),
  j AS (SELECT coalesce(a.family, b.family) AS family, a.version AS old, b.version AS new, a.scope AS sa, b.scope AS sb, a.confidence AS ca, b.confidence AS cb, (a.n, floor(a.q)) < (b.n, floor(b.q)) AS up, a.family IS NULL AS added, b.family IS NULL AS removed FROM (FROM one WHERE early) a FULL JOIN (FROM one WHERE NOT early) b ON a.family = b.family)
  SELECT family, 'added' AS change, old, new FROM j WHERE added UNION ALL SELECT family, 'removed', old, new FROM j WHERE removed UNION ALL SELECT family, CASE WHEN up THEN 'upgraded' ELSE 'downgraded' END, old, new FROM j WHERE old <> new
  UNION ALL SELECT family, 'scope', sa, sb FROM j WHERE sa <> sb UNION ALL SELECT family, 'confidence', printf('%.2f', ca), printf('%.2f', cb) FROM j WHERE abs(ca - cb) >= 0.05""")
def sbom_diff(spark: SparkSession, d: str) -> DataFrame:
    side = lambda early: D.snapshot(spark, d, early).withColumn("ecosystem", F.lit("npm")).withColumn("excluded", F.when(F.col("id") % 20 == 0, "user"))
    return S.diff(side(True), side(False))


@query(f"WITH {STATES} SELECT coalesce(a.family, b.family) AS key, a.version AS old, b.version AS new, CASE WHEN a.version IS NULL THEN 'installed' WHEN b.version IS NULL THEN 'removed' ELSE 'upgraded' END AS change FROM (FROM states WHERE ordinal = 3) a FULL JOIN (FROM states WHERE ordinal = 4) b USING (family) WHERE a.version IS DISTINCT FROM b.version")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: D.states(spark, d).where(F.col("ordinal") == k).select(F.col("family").alias("key"), "version")
    return S.snapshot_diff(at(3), at(4))


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    """Two inventories: a claim's keys are its package and version, and for a third of them a digest that the other side's has too."""
    k = F.col("id")
    keys = F.array_compact(F.array(F.concat(F.lit("purl:"), F.concat_ws("@", "family", "version")), F.when(k % 3 == 0, F.concat(F.lit("digest:x:"), k.cast("string")))))
    side = lambda early, label, first: D.snapshot(spark, d, early).select(
        (k + first).alias("entry"), F.lit(label).alias("label"), "id", F.col("family").alias("name"), "family", "version", (F.floor(F.col("confidence") * 100) % 5 + 1).cast("int").alias("tier"), "confidence",
        F.when(k % 3 == 0, F.create_map(F.lit("x"), k.cast("string"))).alias("hashes"), F.when(k % 4 == 0, F.concat(F.lit("L"), (k % 7).cast("string"))).alias("license"), F.when(k % 20 == 0, "user").alias("excluded"), keys.alias("keys"))
    return side(True, "a", 0).unionByName(side(False, "b", 1 << 40))


_INPUTS = f"""{SNAP}, inputs AS (SELECT id + CASE WHEN early THEN 0 ELSE 1099511627776 END AS entry, CASE WHEN early THEN 'a' ELSE 'b' END AS label, id, family, version, confidence, CAST(floor(confidence * 100) AS BIGINT) % 5 + 1 AS tier FROM sides WHERE id % 20 > 0),
  keyed AS (SELECT entry, family || '@' || version AS key FROM inputs UNION ALL SELECT entry, 'd' || id FROM inputs WHERE id % 3 = 0), hub AS (SELECT key, min(entry) AS m FROM keyed GROUP BY 1), half AS (SELECT DISTINCT entry AS a, m AS b FROM keyed JOIN hub USING (key) WHERE entry <> m), links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
  walk AS (SELECT entry, entry AS root FROM inputs UNION SELECT b, root FROM walk JOIN links ON a = walk.entry WHERE b > root), ids AS (SELECT entry, min(root) AS merged FROM walk GROUP BY 1), held AS (SELECT * FROM inputs JOIN ids USING (entry)),
  merge AS (SELECT merged, arg_min({{'family': family, 'version': version, 'tier': tier, 'confidence': confidence}}, (-tier, -confidence, entry)) AS x, arg_min('L' || (id % 7), entry) FILTER (id % 4 = 0) AS license, arg_max(id::VARCHAR, entry) FILTER (id % 3 = 0) AS digest, list_aggregate(list_sort(list(DISTINCT label)), 'string_agg', ',') AS labels FROM held GROUP BY 1)"""
_MERGED = "SELECT merged, x.family, x.version, x.tier, x.confidence, license, digest, labels FROM merge"


def _merged(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    inputs = _inputs(spark, d)
    found = S.merge(inputs, S.merged_ids(inputs.where("excluded is null")), strategy)
    return found.select("merged", "family", "version", F.col("tier").cast("long").alias("tier"), "confidence", "license", F.col("hashes")["x"].alias("digest"), "labels")


@query(f"WITH RECURSIVE {_INPUTS} {_MERGED}")
def merge_union(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "union")


@query(f"WITH RECURSIVE {_INPUTS} {_MERGED} WHERE labels = 'a,b'")
def merge_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "intersect")


@query(f"WITH RECURSIVE {_INPUTS} SELECT DISTINCT label, merged FROM held")
def merge_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    inputs = _inputs(spark, d)
    ids = S.merged_ids(inputs.where("excluded is null"))
    return S.described_by(inputs, S.merge(inputs, ids, "hierarchical"), ids)


@query(f"""WITH RECURSIVE {_INPUTS}, {EDGES}, e AS (SELECT 'a' AS label, src, dst FROM edges UNION ALL SELECT 'b', src, dst FROM edges WHERE marker IS NULL)
  SELECT 'depends' AS kind, x.merged AS src, y.merged AS dst, list_aggregate(list_sort(list(DISTINCT e.label)), 'string_agg', ',') AS labels FROM e JOIN held x ON x.label = e.label AND x.id = e.src JOIN held y ON y.label = e.label AND y.id = e.dst WHERE x.merged <> y.merged GROUP BY 2, 3""")
def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    inputs = _inputs(spark, d)
    ids = S.merged_ids(inputs.where("excluded is null"))
    e = D.edges(spark, d)
    edges = e.select(F.lit("a").alias("label"), "src", "dst").unionByName(e.where("marker is null").select(F.lit("b").alias("label"), "src", "dst")).withColumn("kind", F.lit("depends"))
    return S.remapped_edges(edges, inputs, ids, S.merge(inputs, ids))


@query(f"WITH RECURSIVE {_INPUTS} SELECT x.family AS family, count(DISTINCT x.version) AS versions, list_aggregate(list_sort(list(DISTINCT x.version)), 'string_agg', ' vs ') AS detail FROM merge GROUP BY 1 HAVING count(DISTINCT x.version) > 1")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_conflicts(_merged(spark, d, "union"))


@query(f"""WITH {SNAP}, a AS (SELECT family, version FROM sides WHERE early AND n > 2), b AS (SELECT family, arg_min(version, id) AS version FROM sides WHERE NOT early AND q > 44 GROUP BY 1)
  SELECT a.family, CASE WHEN b.family IS NULL THEN 'claimed-only' WHEN a.version = b.version THEN 'matched' ELSE 'version-mismatch' END AS status, a.version AS claimed, b.version AS scanned FROM a LEFT JOIN b USING (family) UNION ALL SELECT family, 'scanned-only', NULL, version FROM b ANTI JOIN a USING (family)""")
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """Claims of lines past the second, scans of large quantities."""
    n, q = F.split_part("version", F.lit("."), F.lit(1)).cast("int"), F.round((F.col("confidence") - 0.3) * 100, 2)
    return S.cross_check(D.snapshot(spark, d, True).where(n > 2), D.snapshot(spark, d, False).where(q > 44))


@query(f"""WITH {COMPONENTS}, c AS (SELECT DISTINCT ecosystem, lower(replace(name, '_', '-')) || '-' || id AS key FROM components WHERE size <= 30), o AS (SELECT DISTINCT ecosystem, lower(replace(name, '_', '-')) || '-' || id AS key FROM components WHERE size >= 20 AND ecosystem <> 'small')
  SELECT ecosystem, key, 'observed' AS status FROM c SEMI JOIN o USING (ecosystem, key) UNION ALL SELECT ecosystem, key, 'phantom' FROM o ANTI JOIN c USING (ecosystem, key) UNION ALL SELECT ecosystem, key, 'unused' FROM c ANTI JOIN o USING (ecosystem, key) WHERE ecosystem IN (SELECT ecosystem FROM o)""")
def phantom_unused(spark: SparkSession, d: str) -> DataFrame:
    """Small sizes are known, large ones were seen running, some are both."""
    c = D.components(spark, d).select("ecosystem", F.concat_ws("_", "name", F.col("id").cast("string")).alias("name"), F.col("attrs")["size"].cast("int").alias("size"))
    return S.observed_and_unused(c.where("size <= 30"), c.where("size >= 20 and ecosystem <> 'small'"))


@query(f"WITH {COMPONENTS} SELECT name, version, CASE WHEN name LIKE 'red%' THEN 'user-false-positive' ELSE excluded END AS excluded FROM components UNION ALL SELECT 'my lib', '1.0', 'user-asserted'")
def corrections(spark: SparkSession, d: str) -> DataFrame:
    c = D.components(spark, d)
    missing = spark.createDataFrame([("my lib", "1.0")], "name string, version string")
    return S.corrected(c, c.where(F.col("name").startswith("red")), missing)


# Graph --------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {EDGES}, links AS (SELECT DISTINCT src, dst FROM edges), walk AS (SELECT p_partkey AS target, [p_partkey] AS path, p_partkey AS head FROM part UNION ALL SELECT target, list_prepend(src, path), src FROM walk JOIN links ON head = dst WHERE NOT list_contains(path, src) AND len(path) < 25)
  SELECT target, list_aggregate(path, 'string_agg', '>') AS path, true AS complete FROM walk WHERE NOT EXISTS (SELECT 1 FROM links WHERE dst = head)""")
def paths_to_roots(spark: SparkSession, d: str) -> DataFrame:
    found = G.paths_to_roots(D.edges(spark, d), D.components(spark, d).select("id"))
    return found.select("target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "complete")


@query(f"""WITH RECURSIVE {EDGES}, plain AS (SELECT 5::BIGINT AS node UNION SELECT dst FROM plain JOIN edges ON src = node WHERE marker IS NULL), every_one AS (SELECT 5::BIGINT AS node UNION SELECT dst FROM every_one JOIN edges ON src = node)
  SELECT node, 'runtime' AS scope FROM plain UNION ALL SELECT node, 'conditional' FROM every_one WHERE node NOT IN (FROM plain)""")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    return G.scopes_by_reach(D.edges(spark, d), spark.range(5, 6))


_MODULES = "req AS (SELECT DISTINCT 'm' || (src % 200) AS module, (src % 7) || '.' || (src % 13) AS version, 'm' || (dst % 200) AS dep_module, (dst % 7) || '.' || (dst % 13) AS dep_version FROM edges)"


@query(f"""WITH RECURSIVE {EDGES}, {_MODULES}, reach AS (SELECT 'm1' AS module, '1.1' AS version UNION SELECT dep_module, dep_version FROM reach JOIN req USING (module, version))
  SELECT module, arg_max(version, (split_part(version, '.', 1)::INT, split_part(version, '.', 2)::INT)) AS version FROM reach GROUP BY 1""")
def mvs_build_list(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("m"), (F.col(c) % 200).cast("string"))
    version = lambda c: F.concat_ws(".", (F.col(c) % 7).cast("string"), (F.col(c) % 13).cast("string"))
    requires = D.edges(spark, d).select(name("src").alias("module"), version("src").alias("version"), name("dst").alias("dep_module"), version("dst").alias("dep_version")).distinct()
    return G.minimal_versions(requires, spark.createDataFrame([("m1", "1.1")], "module string, version string"))


@query(f"""WITH RECURSIVE {EDGES}, req AS (SELECT DISTINCT src % 300 AS module, src % 5 AS version, dst % 300 AS dep, dst % 5 AS dep_version, dst AS seq FROM edges WHERE marker IS NULL),
  walk AS (SELECT 1::BIGINT AS module, 1::BIGINT AS version, 1 AS depth, [0::BIGINT] AS way UNION ALL SELECT dep, dep_version, depth + 1, min(list_append(way, seq)) FROM walk JOIN req USING (module, version) WHERE depth < 25 GROUP BY 1, 2, 3)
  SELECT 'm' || module AS module, CASE WHEN module % 50 = 7 THEN 'managed' ELSE 'v' || arg_min(version, (depth, way)) END AS version, min(depth) AS depth FROM walk GROUP BY walk.module""")
def maven_nearest(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c, k: F.concat(F.lit("m" if k == 300 else "v"), (F.col(c) % k).cast("string"))
    requires = D.edges(spark, d).where("marker is null").select(name("src", 300).alias("module"), name("src", 5).alias("version"), name("dst", 300).alias("dep_module"), name("dst", 5).alias("dep_version"), F.col("dst").alias("seq")).distinct()
    managed = spark.range(300).where("id % 50 = 7").select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("module"), F.lit("managed").alias("version"))
    return G.nearest_versions(requires, spark.createDataFrame([("m1", "v1", 0)], "module string, version string, seq long"), managed)


@query("""WITH RECURSIVE k AS (SELECT doc_id AS id, md5(text) AS key FROM documents UNION ALL SELECT doc_id, md5(lower(text)) || 'p' FROM documents), e AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM k a JOIN k b USING (key)),
  walk AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.dst, root FROM walk JOIN e ON e.src = walk.id WHERE e.dst > root) SELECT id, min(root) AS root FROM walk GROUP BY 1""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("whole"), F.concat(F.md5(F.lower("text")), F.lit("p")).alias("lower"))
    return R.resolved(docs, F.array("whole", "lower"))


@query(f"""WITH {COMPONENTS}, c AS (SELECT name || '-' || (id % 200) AS family, id, CASE WHEN id % 6 > 0 THEN version END AS version, CASE WHEN id % 6 > 0 THEN id // 4 * 4 ELSE id END AS root FROM components), n AS (SELECT family, count(DISTINCT root) AS n, min(root) AS sole FROM c WHERE version IS NOT NULL GROUP BY 1), b AS (SELECT family, min(root) AS bare FROM c WHERE version IS NULL GROUP BY 1)
  SELECT id, CASE WHEN version IS NULL AND n = 1 THEN sole WHEN version IS NULL THEN bare ELSE root END AS root, CASE WHEN version IS NULL AND n > 1 THEN 'ambiguous-declared' END AS status FROM c LEFT JOIN n USING (family) LEFT JOIN b USING (family)""")
def attach_versionless(spark: SparkSession, d: str) -> DataFrame:
    whole, k = F.col("id") % 6 > 0, F.col("id")
    c = D.components(spark, d).select(F.concat_ws("-", "name", (k % 200).cast("string")).alias("family"), "id", F.when(whole, F.col("version")).alias("version"), F.when(whole, F.floor(k / 4) * 4).otherwise(k).alias("root"))
    return R.attached_versionless(c)


# Matching -----------------------------------------------------------------------------


@query("""WITH i AS (SELECT l_orderkey AS image, list(l_partkey % 4 ORDER BY l_linenumber, l_partkey, l_suppkey) AS layers FROM lineitem GROUP BY 1), b(base, chain) AS (VALUES ('alpha', [1]), ('beta', [1, 2]), ('gamma', [1, 2, 3]), ('delta', [0, 0]))
  SELECT image, arg_max(base, len(chain)) AS base, max(len(chain)) AS n_layers FROM i JOIN b ON layers[1:len(chain)] = chain GROUP BY 1""")
def base_image_prefix(spark: SparkSession, d: str) -> DataFrame:
    i = D.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x.l_partkey % 4).alias("layers"))
    bases = spark.createDataFrame([("alpha", [1]), ("beta", [1, 2]), ("gamma", [1, 2, 3]), ("delta", [0, 0])], "base string, chain array<bigint>")
    return M.base_image(i, bases)


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS bin, l_partkey % 50 AS so FROM lineitem), d AS (SELECT l_orderkey AS bin, l_suppkey AS dir, min(l_linenumber * 1000 + l_suppkey) AS pos FROM lineitem GROUP BY 1, 2), f AS (SELECT DISTINCT l_suppkey AS dir, l_partkey % 50 AS so FROM lineitem WHERE l_quantity > 40),
  h AS (SELECT bin, so, arg_min(dir, pos) AS dir FROM n JOIN d USING (bin) JOIN f USING (dir, so) GROUP BY 1, 2)
  SELECT 'b' || bin AS binary, 'lib' || so || '.so' AS soname, coalesce('d' || dir || '/lib' || so || '.so', '') AS path, 'pkg' || dir AS owner FROM n LEFT JOIN h USING (bin, so)""")
def link_search_path(spark: SparkSession, d: str) -> DataFrame:
    i = D.table(spark, d, "lineitem")
    tag = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    so = F.concat(F.lit("lib"), (F.col("l_partkey") % 50).cast("string"), F.lit(".so"))
    needed = i.select(tag("b", F.col("l_orderkey")).alias("binary"), so.alias("soname")).distinct()
    dirs = i.groupBy(tag("b", F.col("l_orderkey")).alias("binary"), tag("d", F.col("l_suppkey")).alias("dir")).agg(F.min(F.col("l_linenumber") * 1000 + F.col("l_suppkey")).alias("position"))
    files = i.where("l_quantity > 40").select(tag("d", F.col("l_suppkey")).alias("dir"), so.alias("soname"), tag("pkg", F.col("l_suppkey")).alias("owner")).distinct()
    return M.resolved_links(needed, dirs, files)


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z]+'), lambda x: len(x) > 5)"


def _words(column: str):
    return F.filter(F.split(F.lower(column), "[^a-z]+"), lambda w: F.length(w) > 5)


@query(f"""WITH f AS (SELECT DISTINCT doc_id AS subject, unnest({_WORDS.format('text')}) AS mark FROM documents), s AS (SELECT DISTINCT item_id AS library, unnest({_WORDS.format('text')}) AS mark FROM benchmark), t AS (SELECT library, count(*) AS total FROM s GROUP BY 1)
  SELECT subject, library, count(*) AS matched, round(count(*) / any_value(total), 4) AS ratio FROM f JOIN s USING (mark) JOIN t USING (library) GROUP BY 1, 2 HAVING count(*) >= 8 AND round(count(*) / any_value(total), 4) >= 0.5""")
def symbol_vote(spark: SparkSession, d: str) -> DataFrame:
    found = D.table(spark, d, "documents").select(F.col("doc_id").alias("subject"), F.explode(_words("text")).alias("mark"))
    known = D.table(spark, d, "benchmark").select(F.col("item_id").alias("library"), F.explode(_words("text")).alias("mark"))
    return M.votes(found, known, least=8, min_ratio=0.5)


@query(f"""WITH s AS (SELECT DISTINCT item_id AS library, unnest({_WORDS.format('text')}) AS value FROM benchmark), v AS (SELECT DISTINCT value FROM s), f AS (SELECT doc_id AS subject, value FROM documents JOIN v ON contains(lower(text), value))
  SELECT subject, library, count(*) AS hits, round(least(1 - product(1 - len(value) / 64.0), 0.85), 4)::DOUBLE AS confidence FROM f JOIN s USING (value) GROUP BY 1, 2""")
def constant_hits(spark: SparkSession, d: str) -> DataFrame:
    blobs = D.table(spark, d, "documents").select(F.col("doc_id").alias("subject"), F.lower("text").alias("text"))
    values = D.table(spark, d, "benchmark").select(F.col("item_id").alias("library"), F.explode(F.array_distinct(_words("text"))).alias("value"))
    return M.constant_hits(blobs, values.withColumn("precision", F.length("value") / 64.0))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS subject, l_partkey AS mark FROM lineitem), s AS (SELECT DISTINCT l_suppkey AS library, l_partkey AS mark FROM lineitem WHERE l_quantity > 25), t AS (SELECT library, count(*) AS total FROM s GROUP BY 1)
  SELECT subject, library, count(*) AS matched, round(count(*) / any_value(total), 4) AS ratio FROM f JOIN s USING (mark) JOIN t USING (library) GROUP BY 1, 2 HAVING count(*) >= 4""")
def source_tree_vote(spark: SparkSession, d: str) -> DataFrame:
    i = D.table(spark, d, "lineitem")
    return M.votes(i.select(F.col("l_orderkey").alias("subject"), F.col("l_partkey").alias("mark")), i.where("l_quantity > 25").select(F.col("l_suppkey").alias("library"), F.col("l_partkey").alias("mark")), least=4)


# Text and versions ------------------------------------------------------------------------

_BIGRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"


_TOKENS = "regexp_extract_all(lower(regexp_replace(text, '(?im)^[ \\t]*copyright\\b.*$', ' ', 'g')), '[a-z0-9]+')"


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS a FROM documents), b AS (SELECT item_id, {_TOKENS} AS b FROM benchmark), x AS (SELECT doc_id, unnest({_BIGRAMS.format('a')}) AS g FROM t WHERE len(a) >= 10), y AS (SELECT item_id, unnest({_BIGRAMS.format('b')}) AS g FROM b),
  n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1), m AS (SELECT item_id, count(*) AS m FROM y GROUP BY 1), s AS (SELECT doc_id, item_id, round(2 * count(*) / (any_value(n) + any_value(m)), 4)::DOUBLE AS score FROM x JOIN y USING (g) JOIN n USING (doc_id) JOIN m USING (item_id) GROUP BY 1, 2)
  SELECT doc_id, arg_min(item_id, (-score, item_id)) AS entry, max(score) AS score FROM s WHERE score >= 0.05 GROUP BY 1""")
def license_dice(spark: SparkSession, d: str) -> DataFrame:
    texts, corpus = D.table(spark, d, "documents").select(F.col("doc_id").alias("subject"), "text"), D.table(spark, d, "benchmark").select(F.col("item_id").alias("entry"), "text")
    return M.detected_licenses(texts, corpus, 0.05).select(F.col("subject").alias("doc_id"), "entry", "score")


@query(rf"SELECT doc_id, md5(regexp_replace(text, '(?i)\b([\w-]*(?:{X.SECRET_KEYS})[\w-]*\s*[=:]\s*)[^\s,;]+', '\1***', 'g')) AS masked FROM documents WHERE regexp_matches(text, '(?i)({X.SECRET_KEYS})')")
def mask_secrets(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "documents").where(F.col("text").rlike(f"(?i)({X.SECRET_KEYS})")).select("doc_id", F.md5(X.masked(F.col("text"))).alias("masked"))


@query(f"WITH {EVIDENCE} SELECT CASE WHEN starts_with(path, 'tests/') THEN 'fixture' WHEN starts_with(path, 'vendor/') THEN 'vendored' WHEN starts_with(path, 'examples/') THEN 'example' WHEN starts_with(path, 'docs/') THEN 'docs' END AS role, count(*) AS count FROM evidence GROUP BY 1")
def path_role(spark: SparkSession, d: str) -> DataFrame:
    return D.evidence(spark, d).groupBy(X.path_role(F.col("path")).alias("role")).agg(F.count("*").alias("count"))


@query("SELECT doc_id, CASE WHEN instr(text, 'License') > 0 THEN len(string_split(left(text, instr(text, 'License') - 1), chr(10))) END AS line FROM documents WHERE contains(text, 'License')")
def line_span(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "documents").where(F.col("text").contains("License")).select("doc_id", X.line_of(F.col("text"), F.lit("License")).alias("line"))


@query(f"WITH {COMPONENTS} SELECT id, 'pkg:' || ecosystem || '/' || replace(name, ' ', '%20') || '@' || version AS purl, ecosystem AS ptype FROM components")
def purl_build(spark: SparkSession, d: str) -> DataFrame:
    made = X.purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    return D.components(spark, d).select("id", made.alias("purl"), X.purl_part(made, "type").alias("ptype"))


@query("SELECT p_partkey AS id, p_size >= 10 AND p_size < 20 OR p_size = 30 AND p_partkey % 10 >= 5 AND p_partkey % 10 < 8 AS fits FROM part")
def semver_range(spark: SparkSession, d: str) -> DataFrame:
    return D.components(spark, d).select("id", semver_in(F.col("version"), ">=10.0.0 <20.0.0 || 30.5 - 30.7").alias("fits"))


_ORDER = """v AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'npm' WHEN 1 THEN 'deb' WHEN 2 THEN 'pypi' WHEN 3 THEN 'gem' WHEN 4 THEN 'apk' ELSE 'other' END AS eco, p_size AS a, p_partkey % 10 AS b, p_partkey // 6 % 4 AS kind FROM part)"""


@query(f"""WITH {_ORDER}, s AS (SELECT *, CASE kind WHEN 0 THEN a || '.' || b || '.0' WHEN 1 THEN a || '.' || b WHEN 2 THEN a || '.5.a' ELSE a || '.5.0' || CASE eco WHEN 'npm' THEN '-rc1' WHEN 'gem' THEN '-rc1' WHEN 'deb' THEN '~rc1' WHEN 'apk' THEN '~rc1' WHEN 'pypi' THEN 'rc1' ELSE '.rc1' END END AS version FROM v)
  SELECT id, eco, version, CASE WHEN a <> 25 THEN CASE WHEN a < 25 THEN -1 ELSE 1 END WHEN kind < 2 AND b <> 5 THEN CASE WHEN b < 5 THEN -1 ELSE 1 END WHEN kind = 0 THEN 0
    WHEN kind = 1 THEN CASE WHEN eco IN ('npm', 'gem', 'pypi') THEN 0 ELSE -1 END WHEN kind = 2 THEN CASE eco WHEN 'npm' THEN 0 WHEN 'gem' THEN 0 WHEN 'pypi' THEN -1 ELSE 1 END ELSE CASE WHEN eco = 'other' THEN 1 ELSE -1 END END AS sign FROM s""")
def version_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    eco = F.element_at(F.array(*map(F.lit, ("npm", "deb", "pypi", "gem", "apk", "other"))), (k % 6 + 1).cast("int"))
    tail = F.when(eco.isin("npm", "gem"), "-rc1").when(eco.isin("deb", "apk"), "~rc1").when(eco == "pypi", "rc1").otherwise(".rc1")
    kinds = F.array(F.concat_ws(".", F.col("p_size").cast("string"), (k % 10).cast("string"), F.lit("0")), F.concat_ws(".", F.col("p_size").cast("string"), (k % 10).cast("string")), F.concat(F.col("p_size").cast("string"), F.lit(".5.a")), F.concat(F.col("p_size").cast("string"), F.lit(".5.0"), tail))
    rows = D.table(spark, d, "part").select(k.alias("id"), eco.alias("eco"), F.element_at(kinds, (F.floor(k / 6) % 4 + 1).cast("int")).alias("version"))
    return rows.select("id", "eco", "version", version_compare("eco", "version", F.lit("25.5.0")).alias("sign"))


# Emission ---------------------------------------------------------------------------------


@query(f"WITH {COMPONENTS} SELECT id, row_number() OVER (ORDER BY purl, lower(name), version, id) AS place FROM components WHERE excluded IS NULL")
def emission_order(spark: SparkSession, d: str) -> DataFrame:
    return A.emission_order(D.components(spark, d)).withColumn("place", F.col("place").cast("long"))


_FACTS = f"{COMPONENTS}, {EVIDENCE}, {EDGES}, facts AS (SELECT 'components' AS fact, count(*) AS count FROM components UNION ALL SELECT 'versions', count(version) FROM components UNION ALL SELECT 'purls', count(purl) FROM components UNION ALL SELECT 'scopes', count(scope) FROM components UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'markers', count(marker) FROM edges UNION ALL SELECT 'evidence', count(*) FROM evidence)"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return A.capabilities(D.components(spark, d), D.edges(spark, d), D.evidence(spark, d))


@query(f"WITH {_FACTS} SELECT * FROM facts")
def graph_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d)


@query(f"WITH {_FACTS} SELECT * FROM facts WHERE count > 0 AND fact NOT IN ('components', 'versions', 'purls', 'edges')")
def loss_report(spark: SparkSession, d: str) -> DataFrame:
    return A.losses(_facts(spark, d), ("components", "versions", "purls", "edges"))
