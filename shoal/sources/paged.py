"""JSON documents of assets and albums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions import scalar as S

_DOC = "subtype string, payload struct<captureDate: string, importSource: struct<fileName: string>, location: struct<latitude: double, longitude: double>, camera: struct<serial: string>>"


def first_assets(assets: DataFrame, n: int) -> DataFrame:
    return assets.orderBy("asset_id").limit(n)


def asset_meta(docs: DataFrame, doc: Column) -> DataFrame:
    """Flat metadata of asset documents: a name and extension, '' for no time, a place only where both coordinates are there."""
    p = docs.withColumn("p", F.from_json(doc, _DOC)["payload"])
    name = F.coalesce("p.importSource.fileName", F.lit(""))
    placed = F.col("p.location.latitude").isNotNull() & F.col("p.location.longitude").isNotNull()
    ext = F.when(S.file_stem(name) != name, S.file_ext(name))
    return p.select("asset_id", "album_id", S.file_stem(name).alias("name"), ext.alias("ext"), F.coalesce("p.captureDate", F.lit("")).alias("taken"), F.when(placed, F.col("p.location.latitude")).alias("lat"), F.when(placed, F.col("p.location.longitude")).alias("lng"), F.col("p.camera.serial").alias("serial"))


def asset_documents(meta: DataFrame) -> DataFrame:
    """The inverse of asset_meta: (asset_id, album_id, doc)."""
    name = F.concat_ws(".", "name", "ext")
    location = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")))
    camera = F.when(F.col("serial") != "", F.struct("serial"))
    payload = F.struct(F.col("taken").alias("captureDate"), F.struct(name.alias("fileName")).alias("importSource"), location.alias("location"), camera.alias("camera"))
    return meta.select("asset_id", "album_id", F.to_json(F.struct(F.lit("image").alias("subtype"), payload.alias("payload"))).alias("doc"))


def albums(docs: DataFrame, doc: Column) -> DataFrame:
    """(album_id, name) of album documents: collections, whose id and name are texts."""
    v = docs.withColumn("v", F.try_parse_json(doc))
    at = lambda path: F.try_variant_get("v", path, "string")
    text = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING"
    return v.where((at("$.subtype") == "collection") & text("$.id") & text("$.payload.name")).select(at("$.id").alias("album_id"), at("$.payload.name").alias("name"))
