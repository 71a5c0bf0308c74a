"""A run's tables as Parquet: schemas, appends, upserts and the lossless JSON export.

Rows are never changed in place. An upsert is a row of higher ``seq``; readers take the
last one of each key. Ids are dense ranks over content, so they don't depend on the
order in which findings arrive.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.scratch import materialize

VERSION = 2
#: Columns of the tables, and the key that an upsert goes by.
SCHEMAS = {
    "meta": "key string, value string, seq long",
    "sources": "id string, kind string, ref string, provenance map<string,string>, seq long",
    "files": "source_id string, path string, digest string, size long, role string",
    "projects": "path string, name string, kind string, source_id string",
    "findings": "id long, detector string, name string, version string, purl string",
    "evidence": "finding_id long, ordinal int, technique string, tier int, path string, confidence double",
    "components": "id long, purl string, ctype string, name string, version string, confidence double, tier_cap int, excluded string, hashes map<string,string>, attrs map<string,string>, seq long",
    "links": "finding_id long, component_id long",
    "edges": "kind string, src long, dst long, attrs map<string,string>",
    "layers": "digest string, source_id string, ordinal int, created_by string, seq long",
    "file_states": "source_id string, path string, layer_digest string, ordinal int, state string",
    "annotations": "subject_kind string, subject_id long, code string, detail string",
    "corrections": "kind string, ref string, gone boolean, seq long",
}
KEYS = {"meta": ["key"], "sources": ["id"], "components": ["id"], "layers": ["digest"], "corrections": ["kind", "ref"]}


class Store:
    """The tables of one run below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self) -> Store:
        for name, schema in SCHEMAS.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}")
        self.set_meta("schema_version", str(VERSION))
        return self

    def open(self) -> Store:
        """Brings a store of an earlier version to this one; refuses one of a later version.

        Columns that came later are null in older files, so only the mark changes; tables
        that came later are made.
        """
        found = int(self.get_meta("schema_version") or 0)
        if found > VERSION:
            raise ValueError(f"schema version {found} is newer than {VERSION}")
        return self.create() if found < VERSION else self

    def table(self, name: str) -> DataFrame:
        """All rows as they are now: of an upserted table the last one of each key, of corrections those that weren't taken back."""
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        if name not in KEYS:
            return rows
        whole = F.struct(*(c for c in rows.columns if c not in KEYS[name]))
        last = rows.groupBy(*KEYS[name]).agg(F.max_by(whole, F.coalesce("seq", F.lit(0))).alias("x")).select(*(F.col(c) if c in KEYS[name] else F.col(f"x.{c}").alias(c) for c in rows.columns))
        return last.where("not coalesce(gone, false)") if name == "corrections" else last

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows at the end of a table; columns that they lack are null."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        have = {c.lower() for c in rows.columns}
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema)).write.mode("append").parquet(f"{self.folder}/{name}")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows that replace those of the same key; of equal keys in ``rows`` any one counts. Of two writers the later one wins; nothing is read."""
        self.append(name, rows.withColumn("seq", F.lit(time.time_ns()).cast("long")))

    def insert_missing(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Only the rows whose key the table doesn't have yet."""
        there = self.table(name).select(*keys).distinct()
        self.append(name, rows.dropDuplicates(keys).join(there, keys, "left_anti"))

    def set_meta(self, key: str, value: str) -> None:
        self.upsert("meta", self.spark.createDataFrame([(key, value)], "key string, value string"))

    def get_meta(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).first()
        return row["value"] if row else None

    def update_attrs(self, changes: DataFrame) -> None:
        """Components (id, attrs) with attributes added or replaced; a null value removes one."""
        old = self.table("components")
        new = changes.select("id", F.col("attrs").alias("_new"))
        kept = F.map_filter("attrs", lambda k, v: ~F.map_contains_key("_new", k))
        merged = F.map_concat(kept, F.map_filter("_new", lambda k, v: v.isNotNull()))
        self.upsert("components", old.join(new, "id").withColumn("attrs", merged).select(*old.columns))

    def add_corrections(self, rows: DataFrame) -> None:
        """What users say (kind, ref); saying it again changes nothing."""
        self.upsert("corrections", rows.select("kind", "ref").distinct())

    def remove_corrections(self, rows: DataFrame) -> None:
        """Takes corrections (kind, ref) back."""
        self.upsert("corrections", rows.select("kind", "ref").distinct().withColumn("gone", F.lit(True)))

    def annotations_of(self, kind: str, subject: int) -> DataFrame:
        return self.table("annotations").where((F.col("subject_kind") == kind) & (F.col("subject_id") == subject))

    def export(self, folder: str) -> None:
        """Every table as JSON lines in the order of its columns."""
        for name in SCHEMAS:
            rows = self.table(name)
            plain = [c for c, kind in rows.dtypes if not kind.startswith("map")]
            rows.repartitionByRange(*plain).sortWithinPartitions(*plain).write.mode("overwrite").json(f"{folder}/{name}")


def imported(spark: SparkSession, exported: str, folder: str) -> Store:
    """A store from an export; one of another schema version is refused."""
    found = spark.read.schema(SCHEMAS["meta"]).json(f"{exported}/meta").where("key = 'schema_version'").first()
    if found is None or found["value"] != str(VERSION):
        raise ValueError(f"schema version {found and found['value']!r} is not {VERSION}")
    for name, schema in SCHEMAS.items():
        spark.read.schema(schema).json(f"{exported}/{name}").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    return Store(spark, folder)


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with an id from 1 on by content: places within sorted range partitions, plus the sizes of the partitions before.

    The bounds of the ranges come from samples that differ from one evaluation to the next,
    so the dealt rows are written once; their places and the sizes are read from that table.
    No single task sees all rows; only one count a partition is joined back.
    """
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, turn = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2**33 - 1) + 1
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.withColumn("_part", part).join(F.broadcast(before.select("_part", "_before")), "_part")  # one row a partition
    return placed.withColumn("id", F.col("_before") + turn).drop("_part", "_at", "_before")
