"""Writes as table-to-table rewrites: every mutation is a new version of a keyed table, fit for an overwrite or a merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """changes replace rows of equal key and add the others."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(table.columns))


def update_existing(table: DataFrame, changes: DataFrame, key: list[str], column: str) -> DataFrame:
    """One column changes where the key exists; other changes are dropped."""
    new = changes.select(*key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def keep_only(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_semi")


def decide(units: DataFrame, status: Column) -> DataFrame:
    """units(unit_id, members) to one verdict row for the unit itself and one for every member."""
    ids = F.explode(F.array_distinct(F.concat(F.array("unit_id"), "members")))
    return units.select(ids.alias("asset_id"), status.alias("status"))


def partner_links(links: DataFrame, changes: DataFrame) -> DataFrame:
    """One-to-one links: a change displaces every link that holds either of its sides. Both have (left_id, right_id)."""
    free = links.join(changes.select("left_id"), "left_id", "left_anti").join(changes.select("right_id"), "right_id", "left_anti")
    return free.unionByName(changes)


def clear(table: DataFrame) -> DataFrame:
    """The table without rows."""
    return table.limit(0)


def decided_edits(units: DataFrame) -> DataFrame:
    """Assets of units(members, status) decided for editing: their baselines are captured first."""
    return units.where("status = 'toEdit'").select(F.explode("members").alias("asset_id")).distinct()


def get_or_create(table: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The table with the trimmed names that it lacks, whatever their case; of names that differ in case alone the smallest is created."""
    new = wanted.select(F.trim(name).alias(name)).withColumn("_low", F.lower(name)).groupBy("_low").agg(F.min(name).alias(name))
    return table.select(name).unionByName(new.join(table.select(F.lower(name).alias("_low")), "_low", "left_anti").select(name))


def replace_partitions(new: DataFrame, path: str, by: list[str]) -> None:
    """Rows of `new` become the whole of the partitions that they name in the table at path, which is partitioned by `by`; other partitions
    keep their files. Nothing is replaced before all rows are written, so a write that fails leaves the table as it was."""
    new.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_keyed(new: DataFrame, path: str, key: str, shelf: str) -> None:
    """Rows of `new` become the whole of the keys that they name in the table at path, which is partitioned by `shelf`, a column that follows from
    the key: many keys share a folder. Shelves without a named key keep their files; nothing is replaced before all rows are written."""
    old = new.sparkSession.read.schema(new.schema).parquet(path)
    kept = old.join(new.select(shelf).distinct(), shelf, "left_semi").join(new.select(key).distinct(), key, "left_anti")
    replace_partitions(kept.select(new.columns).unionByName(new), path, [shelf])


def standing(actions: DataFrame, owner: str, seq: str, undo: str) -> DataFrame:
    """Of actions(owner, seq, undo, ...) those that still stand: an undo takes back the owner's latest action that was not taken back yet,
    and none if there is none. An owner's height is the number of actions that stand; one stands at the end if the height never falls
    below the one it made."""
    order = Window.partitionBy(owner).orderBy(seq)
    total = F.sum(F.when(F.col(undo), -1).otherwise(1)).over(order)
    with_total = actions.withColumn("_total", total)
    high = with_total.withColumn("_height", F.col("_total") - F.least(F.lit(0), F.min("_total").over(order)))
    later = F.min("_height").over(order.rowsBetween(1, Window.unboundedFollowing))
    return high.withColumn("_later", later).where(~F.col(undo) & (F.coalesce("_later", F.col("_height")) >= F.col("_height"))).drop("_total", "_height", "_later")


def replayed(initial: DataFrame, changes: DataFrame, key: str, seq: str, gone: str) -> DataFrame:
    """The table that initial and changes(key, seq, gone, ...) leave: each key's last change, or nothing if that removes it, else its initial row.
    With changes up to a version it is the table of that version."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in changes.columns if c != key]), seq).alias("_last"))
    kept = last.where(~F.col(f"_last.{gone}")).select(key, *[F.col(f"_last.{c}").alias(c) for c in initial.columns if c != key])
    return initial.join(last.select(key), key, "left_anti").unionByName(kept.select(initial.columns))
