"""Groups as people have corrected them. A correction names a set of members and goes for every group that shares more than half of
the union with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators import lineage
from shoal.sources.session import materialise


def corrected(groups: DataFrame, members: DataFrame, dissolved: DataFrame, reclassified: DataFrame, memberships: DataFrame, meta: DataFrame) -> DataFrame:
    """(set_id, origin, type, orientation, album_id, asset_id) of all groups after corrections.

    groups(group_id, type, album_id, orientation), members(group_id, asset_id); dissolved(set_id, asset_id);
    reclassified(set_id, asset_id, ord, type, orientation); memberships(set_id, asset_id, ord, frame_ids); meta(asset_id, album_id). A
    dissolved group goes; of the reclassifications and memberships of a group the first one (by ord) counts. A membership that fits no
    group asserts one of its own if it has two frames and a known one: of the type it was given, else a panorama."""
    own = materialise(members.select("group_id", "asset_id").distinct())
    memberships, reclassified = materialise(memberships), materialise(reclassified)
    gone = lineage.majority_matches(dissolved.select("set_id", "asset_id").distinct(), own).select(F.col("detected").alias("group_id")).distinct()
    said = _first(reclassified, own, ["type", "orientation"]).select("group_id", F.col("type").alias("new_type"), F.col("orientation").alias("new_orientation"), F.lit(True).alias("said"))
    listed = _first(memberships, own, ["frame_ids"]).select("group_id", "frame_ids")
    left = groups.join(gone, "group_id", "left_anti").join(said, "group_id", "left").join(listed, "group_id", "left")
    kept = left.join(own.groupBy("group_id").agg(F.collect_list("asset_id").alias("own")), "group_id")
    columns = [F.when(F.col("said"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("type", "orientation")]
    detected = kept.select(F.col("group_id").alias("set_id"), F.lit("detected").alias("origin"), *columns, "album_id", F.explode(F.coalesce("frame_ids", "own")).alias("asset_id"))
    return detected.unionByName(asserted(own, reclassified, memberships, meta))


def _first(corrections: DataFrame, sets: DataFrame, values: list[str]) -> DataFrame:
    """(group_id, values...): the first correction of each set that it fits."""
    fits = lineage.majority_matches(corrections.select("set_id", "asset_id").distinct(), sets).select(F.col("recorded").alias("set_id"), F.col("detected").alias("group_id"))
    facts = corrections.select("set_id", "ord", *values).dropDuplicates(["set_id"])
    best = materialise(fits.join(facts, "set_id").groupBy("group_id").agg(F.min_by(F.struct(*values), F.struct("ord", "set_id")).alias("v")))
    return best.select("group_id", *[F.col("v")[c].alias(c) for c in values])


def asserted(sets: DataFrame, reclassified: DataFrame, memberships: DataFrame, meta: DataFrame) -> DataFrame:
    """Groups that memberships assert which fit no detected one."""
    claimed = lineage.majority_matches(memberships.select("set_id", "asset_id").distinct(), sets).select(F.col("recorded").alias("set_id")).distinct()
    free = memberships.select("set_id", "asset_id", "ord", "frame_ids").join(claimed, "set_id", "left_anti").where(F.size("frame_ids") >= 2)
    free = materialise(free)
    said = _first(reclassified, free.select(F.col("set_id").alias("group_id"), "asset_id").distinct(), ["type", "orientation"]).withColumnRenamed("group_id", "set_id")
    frames = free.select("set_id", "frame_ids").dropDuplicates(["set_id"]).select("set_id", F.posexplode("frame_ids").alias("place", "asset_id"))
    album = frames.join(meta.select("asset_id", "album_id"), "asset_id").groupBy("set_id").agg(F.min_by("album_id", "place").alias("album_id"))
    both = frames.join(album, "set_id").join(said, "set_id", "left")
    kind = F.coalesce("type", F.lit("pano"))
    axis = F.when(kind != "burst", F.coalesce("orientation", F.lit("horizontal")))
    return both.select("set_id", F.lit("asserted").alias("origin"), kind.alias("type"), axis.alias("orientation"), "album_id", "asset_id")


def as_stereo(groups: DataFrame, both_eyes: DataFrame) -> DataFrame:
    """Detected groups of albums that hold both eyes are stereo sets, whatever they were taken for."""
    marked = groups.join(both_eyes.select("album_id", F.lit(True).alias("both")).distinct(), "album_id", "left")
    return marked.withColumn("type", F.when(F.col("both") & (F.col("origin") == "detected"), "stereo").otherwise(F.col("type"))).drop("both")
