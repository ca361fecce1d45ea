"""Column contracts (asset, verdict, name, filing, listing) filled from the driver's tables.

The operators are written against the contracts; these adapters only say which table stands in for which. ORACLE holds the same
adapters as common table expressions for the SQL side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def half_bits(vector: Column, start: int) -> Column:
    """Signs of 32 components as a bigint, the first in the lowest bit."""
    bit = lambda s, i: s + F.when(F.element_at(vector, i + start + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), bit)


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, lo, hi, label): a 64-bit luma hash in two halves."""
    return read(spark, sf_dir, "embeddings").select("vec_id", half_bits(F.col("embedding"), 0).alias("lo"), half_bits(F.col("embedding"), 32).alias("hi"), "label")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, album_id, ms, camera, lo, hi): timed, hashed assets; every 11th has no hash, every 13th no time."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    vectors = read(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"))  # one row
    events = events.join(F.broadcast(vectors))
    timed = events.select(
        F.col("event_id").alias("asset_id"), F.col("user_id").alias("album_id"), F.when(F.col("event_id") % 13 != 0, F.unix_millis("ts")).alias("ms"), F.col("event_type").alias("camera"), F.when(F.col("event_id") % 11 != 0, F.col("event_id") % F.col("vectors")).alias("vec_id")
    )
    return timed.join(hashes(spark, sf_dir).select("vec_id", "lo", "hi"), "vec_id", "left").select("asset_id", "album_id", "ms", "camera", "lo", "hi")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, album, name, ord): file names with edit and merge suffixes."""
    stem = F.concat(F.lit("IMG_"), (F.col("doc_id") - F.col("doc_id") % 5).cast("string"))
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", "-Edit.jpg", "-Enhanced-NR.DNG", "-HDR-2.jpg", "-HDR-Pano.jpg"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id"), F.col("source").alias("album"), F.concat(stem, suffix).alias("name"), F.col("doc_id").alias("ord"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, status, starred, save_only) of labelled documents."""
    status = F.when(F.col("toxic") == 1, "rejected").when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "toEdit").when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 1), "toPrint").when(F.col("quality") == 1, "kept").when(F.col("doc_id") % 2 == 0, "backlog").otherwise("maybe")
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"), status.alias("status"), (F.col("doc_id") % 5 == 0).alias("starred"), (F.col("doc_id") % 7 == 0).alias("save_only"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, album, filed_at): one row for each album an asset was filed in."""
    docs = read(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    named = F.element_at(F.array(*map(F.lit, ("Edit", "Keep", "Print"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("asset_id"), named.alias("album"), (F.col("doc_id") * 1000).alias("filed_at"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, album, original_id): what albums hold; a tombstone has an id of its own and points at the asset it was."""
    docs = read(spark, sf_dir, "documents").where("doc_id % 4 <> 0")
    dead = F.col("doc_id") % 10 == 2
    named = F.element_at(F.array(*map(F.lit, ("Edit", "Keep", "Print"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(F.when(dead, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("id"), named.alias("album"), F.when(dead, F.col("doc_id")).alias("original_id"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, asset_id, pos): groups of three to six assets, as recorded by lines of orders."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("asset_id"), F.col("l_linenumber").alias("pos"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, album_id, pos, name, ms, camera, lat, lng): an album's assets in its own order, with edits and both eyes among their
    names; every 13th has no time, every 17th no place."""
    e = read(spark, sf_dir, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", "-Edit.jpg", "_L.jpg", "_R.jpg"))), (F.col("pos") % 4 + 1).cast("int"))
    name = F.concat(F.lit("IMG_"), (F.col("pos") - F.col("pos") % 4).cast("string"), suffix)
    placed = F.col("event_id") % 17 != 0
    ms = F.when(F.col("event_id") % 13 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    return e.select(F.col("event_id").alias("asset_id"), F.col("user_id").alias("album_id"), "pos", name.alias("name"), ms.alias("ms"), F.col("event_type").alias("camera"), F.when(placed, F.col("value") / 1000).alias("lat"), F.when(placed, F.col("value") / 500).alias("lng"))


def shot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, album_id, type, asset_id, pos): every second three of an album's assets make a group."""
    third = F.floor(F.col("pos") / 3)
    kind = F.element_at(F.array(*map(F.lit, ("burst", "pano", "stereo"))), (third % 3 + 1).cast("int"))
    return shots(spark, sf_dir).where(third % 2 == 0).select(F.concat_ws(":", F.col("album_id").cast("string"), third.cast("string")).alias("group_id"), "album_id", kind.alias("type"), "asset_id", "pos")


def shot_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, status, starred, save_only) of four assets in five."""
    n = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("backlog", "kept", "toPrint", "toEdit", "maybe", "rejected"))), (n % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").where(n % 5 != 0).select(n.alias("asset_id"), status.alias("status"), (n % 7 == 0).alias("starred"), (n % 9 == 0).alias("save_only"))


def shot_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, g): an 8x8 luma grid for each asset that has one."""
    from shoal.operators.vectors import grid

    vectors = read(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"))  # one row
    has = read(spark, sf_dir, "events").where("event_id % 11 <> 0").join(F.broadcast(vectors)).select(F.col("event_id").alias("asset_id"), (F.col("event_id") % F.col("vectors")).alias("vec_id"))
    return has.join(read(spark, sf_dir, "embeddings").select("vec_id", grid(F.col("embedding")).alias("g")), "vec_id").select("asset_id", "g")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two (id, updated) snapshots of one album list."""
    docs = read(spark, sf_dir, "documents")
    old = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("string").alias("updated"))
    new = docs.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).cast("string").alias("updated"))
    return old, new


_BIT = "list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + {0} + 1] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE CAST(0 AS BIGINT) END))"
ORACLE = {
    "hashes": f"SELECT vec_id, CAST({_BIT.format(0)} AS BIGINT) AS lo, CAST({_BIT.format(32)} AS BIGINT) AS hi, label FROM embeddings",
    "assets": f"SELECT event_id AS asset_id, user_id AS album_id, CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) // 1000 END AS ms, event_type AS camera, lo, hi FROM events e LEFT JOIN hashes h ON h.vec_id = CASE WHEN event_id % 11 <> 0 THEN event_id % (SELECT count(*) FROM embeddings) END",
    "meta": "SELECT doc_id AS asset_id, source AS album, 'IMG_' || CAST(doc_id - doc_id % 5 AS VARCHAR) || ['.jpg', '-Edit.jpg', '-Enhanced-NR.DNG', '-HDR-2.jpg', '-HDR-Pano.jpg'][doc_id % 5 + 1] AS name, doc_id AS ord FROM documents",
    "verdicts": "SELECT doc_id AS asset_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 AND doc_id % 3 = 0 THEN 'toEdit' WHEN quality = 1 AND doc_id % 3 = 1 THEN 'toPrint' WHEN quality = 1 THEN 'kept' WHEN doc_id % 2 = 0 THEN 'backlog' ELSE 'maybe' END AS status, doc_id % 5 = 0 AS starred, doc_id % 7 = 0 AS save_only FROM labels",
    "filings": "SELECT doc_id AS asset_id, ['Edit', 'Keep', 'Print'][doc_id % 3 + 1] AS album, doc_id * 1000 AS filed_at FROM documents WHERE doc_id % 2 = 0",
    "listing": "SELECT CASE WHEN doc_id % 10 = 2 THEN doc_id + 1000000000 ELSE doc_id END AS id, ['Edit', 'Keep', 'Print'][doc_id % 3 + 1] AS album, CASE WHEN doc_id % 10 = 2 THEN doc_id END AS original_id FROM documents WHERE doc_id % 4 <> 0",
    "members": "SELECT l_orderkey AS group_id, l_partkey AS asset_id, l_linenumber AS pos FROM lineitem",
    "shots": "SELECT event_id AS asset_id, user_id AS album_id, pos, 'IMG_' || (pos - pos % 4) || ['.jpg', '-Edit.jpg', '_L.jpg', '_R.jpg'][pos % 4 + 1] AS name, CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) // 1000 END AS ms, event_type AS camera, CASE WHEN event_id % 17 <> 0 THEN value / 1000 END AS lat, CASE WHEN event_id % 17 <> 0 THEN value / 500 END AS lng FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events)",
    "shot_groups": "SELECT album_id || ':' || (pos // 3) AS group_id, album_id, ['burst', 'pano', 'stereo'][pos // 3 % 3 + 1] AS type, asset_id, pos FROM shots WHERE pos // 3 % 2 = 0",
    "shot_verdicts": "SELECT event_id AS asset_id, ['backlog', 'kept', 'toPrint', 'toEdit', 'maybe', 'rejected'][event_id % 6 + 1] AS status, event_id % 7 = 0 AS starred, event_id % 9 = 0 AS save_only FROM events WHERE event_id % 5 <> 0",
    "shot_grids": "SELECT event_id AS asset_id, list_transform(embedding, lambda x: floor((CAST(x AS DOUBLE) + 1) * 127.5)) AS g FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings) WHERE event_id % 11 <> 0",
    "old_snapshot": "SELECT doc_id AS id, CAST(n_chars AS VARCHAR) AS updated FROM documents WHERE doc_id % 7 <> 0",
    "new_snapshot": "SELECT doc_id AS id, CAST(n_chars + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS updated FROM documents WHERE doc_id % 9 <> 0",
}
_NEEDS = {"assets": ("hashes",), "shot_groups": ("shots",)}


def with_adapters(sql: str) -> str:
    """The SQL with those adapters in front that it names."""
    named = {n for n in ORACLE if re.search(rf"\b{n}\b", sql)}
    used = [n for n in ORACLE if n in named or any(n in _NEEDS.get(m, ()) for m in named)]
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({ORACLE[n]})" for n in used) + (", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else " " + sql)) if used else sql
