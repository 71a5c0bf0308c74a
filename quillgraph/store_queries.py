"""Queries of the run store, inventories written and read again, and text functions, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.licenses import license_expression
from quillgraph.operators import attribution as T
from quillgraph.operators import resolution as R
from quillgraph.queries import COMPONENTS, EDGES, query
from quillgraph.scratch import scratch_dir
from quillgraph.sources import derived as D
from quillgraph.sources import sbom, sbom_formats
from quillgraph.sources.lockfiles import dealt
from quillgraph.sources.store import Store, imported


def _text(*parts: object):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# The run store ---------------------------------------------------------------------------


def _stored(spark: SparkSession, d: str) -> Store:
    """A store of all components; attributes of a third of them changed, every other source written twice, projects offered twice."""
    s = Store(spark, _folder(spark, "store")).create()
    k = F.col("id")
    c = D.components(spark, d).select("id", "purl", "ctype", "name", "version", "confidence", "tier_cap", "excluded", F.create_map(F.lit("size"), F.col("attrs")["size"], F.lit("old"), F.lit("1")).alias("attrs"))
    s.upsert("components", c)
    s.update_attrs(c.where("id % 3 = 0").select("id", F.create_map(F.lit("old"), F.lit(None).cast("string"), F.lit("new"), _text("n", k)).alias("attrs")))
    nations = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit("dir").alias("kind"), F.col("n_name").alias("ref"))
    s.upsert("sources", nations)
    s.upsert("sources", nations.where("cast(id as int) % 2 = 0").withColumn("ref", _text("new ", F.col("ref"))))
    regions = D.table(spark, d, "region").select(_text("p/", F.col("r_regionkey")).alias("path"), F.col("r_name").alias("name"))
    s.insert_missing("projects", regions.where("path < 'p/3'"), ["path"])
    s.insert_missing("projects", regions.withColumn("name", F.lit("later")), ["path"])
    s.append("edges", D.edges(spark, d).select(F.lit("DEPENDS_ON").alias("kind"), "src", "dst"))
    s.append("annotations", c.where("id % 5 = 0").select(F.lit("component").alias("subject_kind"), k.alias("subject_id"), _text("code-", k % 4).alias("code"), F.lit("x").alias("detail")))
    told = D.table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("ref"), "c_custkey")
    s.add_corrections(told)
    s.remove_corrections(told.where("c_custkey % 4 = 0"))
    s.add_corrections(told.where("c_custkey % 8 = 0"))
    s.set_meta("subject", "one")
    s.set_meta("subject", "two")
    return s


@query(f"WITH {COMPONENTS} SELECT id, name, version, size::VARCHAR AS size, CASE WHEN id % 3 > 0 THEN '1' END AS old, CASE WHEN id % 3 = 0 THEN 'n' || id END AS new FROM components")
def store_attributes(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.try_element_at("attrs", F.lit(k)).alias(k)
    return _stored(spark, d).table("components").select("id", "name", "version", at("size"), at("old"), at("new"))


@query("""SELECT 'source' AS what, n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' ELSE '' END || n_name AS value FROM nation UNION ALL SELECT 'project', 'p/' || r_regionkey, CASE WHEN r_regionkey < 3 THEN r_name ELSE 'later' END FROM region
  UNION ALL SELECT DISTINCT 'correction', c_mktsegment, c_name FROM customer WHERE c_custkey % 4 > 0 OR c_custkey % 8 = 0 UNION ALL SELECT 'meta', 'subject', 'two' UNION ALL SELECT 'meta', 'schema_version', '2'""")
def store_upserts(spark: SparkSession, d: str) -> DataFrame:
    s = _stored(spark, d)
    row = lambda what, df, key, value: df.select(F.lit(what).alias("what"), F.col(key).alias("key"), F.col(value).alias("value"))
    return row("source", s.table("sources"), "id", "ref").unionByName(row("project", s.table("projects"), "path", "name")).unionByName(row("correction", s.table("corrections"), "kind", "ref")).unionByName(row("meta", s.table("meta"), "key", "value"))


@query(f"WITH {EDGES} SELECT 'edge' AS what, src, dst FROM edges UNION ALL SELECT 'annotation', p_partkey, p_partkey % 4 FROM part WHERE p_partkey % 5 = 0")
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Exported as JSON lines and read into another store."""
    out = _folder(spark, "export")
    _stored(spark, d).export(out)
    again = imported(spark, out, _folder(spark, "again"))
    notes = again.table("annotations").select(F.lit("annotation").alias("what"), F.col("subject_id").alias("src"), F.substring("code", 6, 9).cast("long").alias("dst"))
    return again.table("edges").select(F.lit("edge").alias("what"), "src", "dst").unionByName(notes)


# Inventories -----------------------------------------------------------------------------


def _round_trip(spark: SparkSession, d: str, kind: str, read) -> DataFrame:
    """The component graph as one document and read again; a document is one row, as its reader needs it."""
    c = D.components(spark, d).select(_text("c-", F.col("id")).alias("ref"), F.lit("library").alias("ctype"), "name", "version", "purl", F.col("attrs")["scope"].alias("scope"))
    e = D.edges(spark, d).where("src > 0").select(_text("c-", F.col("src")).alias("src"), _text("c-", F.col("dst")).alias("dst")).distinct()
    lines = sbom_formats.WRITERS[kind](c, e, "urn:uuid:0")
    whole = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "place", "value"))), lambda x: x.value), "").alias("value"))
    path = _folder(spark, kind)
    whole.write.text(path)
    found, edges = read(spark, path)
    rows = found.select(F.lit("component").alias("what"), "ref", "name", "version", "purl")
    null = F.lit(None).cast("string")
    return rows.unionByName(edges.select(F.lit("edge").alias("what"), F.col("src").alias("ref"), F.col("dst").alias("name"), null.alias("version"), null.alias("purl")))


_GRAPH = f"WITH {COMPONENTS}, {EDGES} SELECT 'component' AS what, 'c-' || id AS ref, name, version, purl FROM components UNION ALL SELECT DISTINCT 'edge', 'c-' || src, 'c-' || dst, NULL, NULL FROM edges WHERE src > 0"


@query(_GRAPH)
def cyclonedx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "cyclonedx", sbom.read_cyclonedx)


@query(_GRAPH)
def spdx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "spdx", sbom.read_spdx)


@query("""WITH c AS (SELECT 'c-' || (p_partkey % 1900) AS ref, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 5 > 0 THEN p_size::VARCHAR END AS version, CASE WHEN p_partkey % 7 > 0 THEN 'pkg:x/' || p_partkey END AS purl FROM part)
  SELECT ref, 'missing-name' AS rule FROM c WHERE name IS NULL UNION ALL SELECT ref, 'missing-version' FROM c WHERE version IS NULL UNION ALL SELECT ref, 'missing-identifier' FROM c WHERE purl IS NULL UNION ALL SELECT ref, 'duplicate-ref' FROM c GROUP BY ref HAVING count(*) > 1""")
def inventory_violations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = D.table(spark, d, "part").select(F.lit("one").alias("document"), _text("c-", k % 1900).alias("ref"), F.when(k % 4 > 0, F.col("p_name")).alias("name"), F.when(k % 5 > 0, F.col("p_size").cast("string")).alias("version"), F.when(k % 7 > 0, _text("pkg:x/", k)).alias("purl"))
    return sbom.violations(c)


# Identity, references and text ---------------------------------------------------------------


@query("""WITH c AS (SELECT p_partkey AS id, lower(p_type) AS eco, p_name AS name, CASE WHEN p_partkey % 5 > 0 THEN p_size::VARCHAR END AS version FROM part)
  SELECT id, CASE WHEN id % 3 = 0 THEN 'digest:sha256:ab' || id END AS digest, CASE WHEN id % 4 = 0 THEN 'purl:pkg:' || eco || '/' || id WHEN version IS NOT NULL THEN 'name' || chr(31) || eco || chr(31) || name || chr(31) || version END AS named, eco || ':' || name AS family FROM c""")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = D.table(spark, d, "part").select(k.alias("id"), F.lower("p_type").alias("ecosystem"), F.col("p_name").alias("name"), F.when(k % 5 > 0, F.col("p_size").cast("string")).alias("version"), F.when(k % 4 == 0, _text("pkg:", F.lower("p_type"), "/", k)).alias("purl"), F.when(k % 3 == 0, F.create_map(F.lit("SHA256"), _text("AB", k))).alias("hashes"))
    keys = c.select("id", R.identity_keys().alias("keys"), R.family_key().alias("family"))
    pick = lambda holds: F.try_element_at(F.filter("keys", holds), F.lit(1))
    return keys.select("id", pick(lambda x: x.startswith("digest:")).alias("digest"), pick(lambda x: ~x.startswith("digest:")).alias("named"), "family")


@query("SELECT p_partkey AS id, 'npm' AS kind, '@s' AS namespace, 'a' || p_partkey AS name, p_size || '.0' AS version FROM part")
def purl_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    made = X.purl(F.lit("NPM"), _text("a", k), _text(F.col("p_size"), ".0"), F.lit("@s"))
    rows = D.table(spark, d, "part").select(k.alias("id"), made.alias("p"))
    return rows.select("id", X.purl_part(F.col("p"), "type").alias("kind"), F.url_decode(X.purl_part(F.col("p"), "namespace")).alias("namespace"), X.purl_part(F.col("p"), "name").alias("name"), X.purl_part(F.col("p"), "version").alias("version"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'RUN make ' || o_custkey WHEN 1 THEN 'CMD [\"x\"]' ELSE 'COPY a b' END AS step FROM orders")
def created_by(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, _text("/bin/sh -c RUN   make\t", F.col("o_custkey"))).when(k % 3 == 1, '/bin/sh -c #(nop)  CMD ["x"]').otherwise(" COPY a\n b ")
    return D.table(spark, d, "orders").select(k.alias("id"), X.created_by(raw).alias("step"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'reg.io:5000' ELSE 'docker.io' END AS registry, 'org/app' || p_partkey AS repository, CASE WHEN p_partkey % 3 = 0 THEN 'v' || p_size END AS tag, CASE WHEN p_partkey % 5 = 0 THEN 'sha256:' || p_partkey END AS digest, p_partkey % 5 = 0 AS pinned FROM part""")
def image_references(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.concat(F.when(k % 2 == 0, "reg.io:5000/").otherwise(""), _text("org/app", k), F.when(k % 3 == 0, _text(":v", F.col("p_size"))).otherwise(""), F.when(k % 5 == 0, _text("@sha256:", k)).otherwise(""))
    return D.table(spark, d, "part").select(k.alias("id"), X.image_reference(raw).alias("x")).select("id", "x.*")


@query("SELECT doc_id, 'sha256' AS algorithm, sha256(text) AS hex FROM documents WHERE text IS NOT NULL")
def sri_hashes(spark: SparkSession, d: str) -> DataFrame:
    packed = F.concat(F.lit("sha256-"), F.base64(F.unhex(F.sha2("text", 256))))
    return D.table(spark, d, "documents").where("text is not null").select("doc_id", X.sri(packed).alias("x")).select("doc_id", "x.*")


@query("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines, len(string_split(left(text, instr(text, 'License') - 1), chr(10))) AS k FROM documents WHERE contains(text, 'License'))
  SELECT doc_id, md5(array_to_string(lines[greatest(k - 1, 1):k + 1], chr(10))) AS snippet FROM t""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "documents").where(F.col("text").contains("License")).select("doc_id", F.md5(X.snippet(F.col("text"), F.lit("License"), 1)).alias("snippet"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'MIT' WHEN 1 THEN 'MIT OR Apache-2.0' WHEN 2 THEN '(MIT AND BSD-3-Clause) OR L' || p_size WHEN 3 THEN 'GPL-2.0+ WITH Classpath-exception-2.0' END AS expression FROM part""")
def license_expressions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, " MIT ").when(k % 6 == 1, "MIT or  Apache-2.0").when(k % 6 == 2, _text("( MIT and BSD-3-Clause ) OR L", F.col("p_size"))).when(k % 6 == 3, "GPL-2.0+ with Classpath-exception-2.0").when(k % 6 == 4, "MIT or").otherwise("(MIT")
    return D.table(spark, d, "part").select(k.alias("id"), license_expression(raw).alias("expression"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS pid, l_partkey % 60 AS n FROM lineitem), s AS (SELECT l_suppkey AS pid, string_agg(port, ',' ORDER BY port::INT) AS ports FROM (SELECT DISTINCT l_suppkey, (l_linenumber + 80)::VARCHAR AS port FROM lineitem WHERE l_suppkey % 2 = 0 AND l_quantity > 45) GROUP BY 1),
  q AS (SELECT n, min('exe' || pid) AS exe FROM p GROUP BY 1), r AS (SELECT n, string_agg(port::VARCHAR, ',' ORDER BY port) AS ports FROM (SELECT DISTINCT n, l_linenumber + 80 AS port FROM p JOIN lineitem ON l_suppkey = pid WHERE pid % 2 = 0 AND l_quantity > 45) GROUP BY 1)
  SELECT n + 1 AS component_id, exe, coalesce(ports, '') AS ports FROM q LEFT JOIN r USING (n)""")
def running_components(spark: SparkSession, d: str) -> DataFrame:
    i = D.table(spark, d, "lineitem")
    n = F.col("l_partkey") % 60
    processes = i.select(F.col("l_suppkey").alias("pid"), _text("exe", F.col("l_suppkey")).alias("exe"), _text("/usr/lib/libx", n, ".so.1").alias("path")).distinct()
    components = spark.range(60).select((F.col("id") + 1).alias("id"), _text("x", F.col("id")).alias("name"))
    ports = i.where("l_suppkey % 2 = 0 and l_quantity > 45").select(F.col("l_suppkey").alias("pid"), (F.col("l_linenumber") + 80).alias("port")).distinct()
    return T.running(processes, components, ports)


@query(f"""WITH {COMPONENTS}, {EDGES}, top AS (SELECT max(id) + 1 AS t FROM components), img AS (SELECT id, name FROM components WHERE ecosystem = 'small'), ie AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM img) AND dst IN (SELECT id FROM img))
  SELECT 'component' AS what, id AS src, id AS dst FROM components UNION ALL SELECT 'component', id + t, id + t FROM img, top UNION ALL SELECT DISTINCT 'DEPENDS_ON', src, dst FROM edges UNION ALL SELECT 'DEPENDS_ON', src + t, dst + t FROM ie, top UNION ALL SELECT 'CONTAINS', 5, id + t FROM img, top WHERE id NOT IN (SELECT dst FROM ie)""")
def grafted_image(spark: SparkSession, d: str) -> DataFrame:
    c, e = D.components(spark, d).select("id", "name", "ecosystem"), D.edges(spark, d).select(F.lit("DEPENDS_ON").alias("kind"), "src", "dst").distinct()
    image = c.where("ecosystem = 'small'")
    ids = image.select("id")
    inner = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    nodes, edges = T.grafted(c, e, image, inner, 5)
    return nodes.select(F.lit("component").alias("what"), F.col("id").alias("src"), F.col("id").alias("dst")).unionByName(edges.select(F.col("kind").alias("what"), "src", "dst"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'pkg:pypi/my-lib' || p_partkey || '@1.0?a=x&b=' || p_size WHEN 1 THEN 'pkg:npm/%40Scope/Name' || p_partkey || '@1.0' WHEN 2 THEN 'pkg:github/own/repo' || p_partkey || '#sub/dir' WHEN 3 THEN 'pkg:deb/debian/Lib%2B%2B' || p_partkey || '@1:2' END AS purl FROM part""")
def canonical_purls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, _text("pkg:PyPI/My_Lib", k, "@1.0?B=", F.col("p_size"), "&c=&A=x")).when(k % 5 == 1, _text("pkg:npm/@Scope/Name", k, "@1.0")).when(k % 5 == 2, _text("PKG://GitHub/Own/Repo", k, "#sub/dir")).when(k % 5 == 3, _text("pkg:deb//debian/Lib++", k, "@1%3A2")).otherwise("pkg:only")
    rows = dealt(D.table(spark, d, "part").select(k.alias("id"), raw.alias("raw")), "id")
    return rows.select("id", X.canonical_purl(F.col("raw")).alias("purl"))
