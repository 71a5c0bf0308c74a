"""Container images as files: an OCI layout or a saved archive, from its JSON documents to layers and build steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLATFORM = "struct<os:string,architecture:string,variant:string>"
_INDEX = f"manifests array<struct<mediaType:string,digest:string,platform:{_PLATFORM},annotations:map<string,string>>>"
_MANIFEST = "config struct<digest:string>, layers array<struct<mediaType:string,digest:string,size:bigint>>"
_CONFIG = "os string, architecture string, variant string, history array<struct<created_by:string,empty_layer:boolean>>, rootfs struct<diff_ids:array<string>>"
_SAVED = "array<struct<Config:string,RepoTags:array<string>,Layers:array<string>>>"


def _blobs(files: DataFrame) -> DataFrame:
    """(root, digest, text) of a layout's documents, by the place of each."""
    at = r"^(.*?/?)blobs/([^/]+)/([^/]+)$"
    return files.where(F.col("path").rlike(at)).select(F.regexp_extract("path", at, 1).alias("root"), F.concat(F.regexp_extract("path", at, 2), F.lit(":"), F.regexp_extract("path", at, 3)).alias("digest"), F.col("content").cast("string").alias("text"))


def platforms_of(files: DataFrame) -> DataFrame:
    """(root, digest, os, arch, variant, tag) of each image that an OCI layout's index, or an index within it, names; attestations aren't images."""
    index = files.where(F.col("path").rlike(r"(^|/)index\.json$")).select(F.regexp_replace("path", r"index\.json$", "").alias("root"), F.from_json(F.col("content").cast("string"), _INDEX).alias("x"))
    entry = lambda rows: rows.select("root", F.explode("x.manifests").alias("m")).select("root", "m.digest", "m.mediaType", "m.platform", F.try_element_at("m.annotations", F.lit("org.opencontainers.image.ref.name")).alias("tag"))
    top = entry(index)
    nested = F.col("mediaType").rlike("index|manifest.list")
    inner = top.where(nested).join(_blobs(files), ["root", "digest"]).select("root", F.col("tag").alias("outer"), F.from_json("text", _INDEX).alias("x"))
    below = inner.select("root", "outer", F.explode("x.manifests").alias("m")).select("root", "m.digest", "m.mediaType", "m.platform", F.col("outer").alias("tag"))
    found = top.where(~F.coalesce(nested, F.lit(False))).unionByName(below)
    return found.where("platform is null or platform.architecture <> 'unknown'").select("root", "digest", F.col("platform.os").alias("os"), F.col("platform.architecture").alias("arch"), F.col("platform.variant").alias("variant"), "tag")


def chosen(images: DataFrame, os: str = "linux", arch: str = "amd64", variant: str | None = None) -> DataFrame:
    """Of each layout the image of a platform: the one that says so (a variant, if asked for), else one that says nothing; ties: the least digest."""
    says = (F.col("os") == os) & (F.col("arch") == arch) & (F.col("variant") == variant if variant else F.lit(True))
    fit = images.withColumn("rank", F.when(says, 0).when(F.col("arch").isNull(), 1)).where("rank is not null")
    return fit.groupBy("root").agg(F.min_by(F.struct("digest", "tag"), F.struct("rank", "digest")).alias("x")).select("root", "x.digest", "x.tag")


def _with_steps(rows: DataFrame) -> DataFrame:
    """(root, ordinal, digest, diff_id, created_by) from layers, diff_ids and history; steps without a layer are skipped, a layer without a step has none."""
    steps = F.filter(F.coalesce("history", F.array().cast("array<struct<created_by:string,empty_layer:boolean>>")), lambda h: ~F.coalesce(h.empty_layer, F.lit(False)))
    each = rows.select("root", "diff_ids", steps.alias("steps"), F.posexplode("layers").alias("ordinal", "digest"))
    get = lambda c: F.try_element_at(c, F.col("ordinal") + 1)
    return each.select("root", "ordinal", "digest", get("diff_ids").alias("diff_id"), get(F.col("steps"))["created_by"].alias("created_by"))


def oci_layers(files: DataFrame, images: DataFrame) -> DataFrame:
    """Layers of the images (root, digest) of OCI layouts among ``files`` (path, content)."""
    blobs = _blobs(files)
    manifests = images.join(blobs, ["root", "digest"]).select("root", F.from_json("text", _MANIFEST).alias("m"))
    config = blobs.withColumnsRenamed({"digest": "config", "text": "body"})
    joined = manifests.select("root", F.col("m.config.digest").alias("config"), F.transform("m.layers", lambda x: x.digest).alias("layers")).join(config, ["root", "config"], "left").withColumn("c", F.from_json("body", _CONFIG))
    return _with_steps(joined.select("root", "layers", F.col("c.history").alias("history"), F.col("c.rootfs.diff_ids").alias("diff_ids")))


def saved_layers(files: DataFrame) -> DataFrame:
    """Layers of saved archives: folders with a manifest.json that names the config and the layers' files."""
    place = r"(^|/)manifest\.json$"
    saved = files.where(F.col("path").rlike(place)).select(F.regexp_replace("path", r"manifest\.json$", "").alias("root"), F.explode(F.from_json(F.col("content").cast("string"), _SAVED)).alias("m"))
    config = files.where("path like '%json'").select(F.col("path").alias("at"), F.from_json(F.col("content").cast("string"), _CONFIG).alias("c"))
    joined = saved.join(config, F.concat("root", "m.Config") == F.col("at"), "left")
    return _with_steps(joined.select("root", F.col("m.Layers").alias("layers"), F.col("c.history").alias("history"), F.col("c.rootfs.diff_ids").alias("diff_ids")))
