"""Decisions and what follows from them, as rewrites of keyed tables: every function returns the new version of each table it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import scalar as S
from shoal.operators import lineage, tables
from shoal.operators.running import running_sums


def set_status(verdicts: DataFrame, ids: DataFrame, status: str, save_only: bool | None = None) -> DataFrame:
    """ids(asset_id) get a status; stars stay, and so does save_only unless it is given. Ids without a verdict get one."""
    own = ids.select("asset_id").distinct().join(verdicts, "asset_id", "left")
    flag = F.coalesce("save_only", F.lit(False)) if save_only is None else F.lit(save_only)
    return tables.upsert(verdicts, own.select("asset_id", F.lit(status).alias("status"), F.coalesce("starred", F.lit(False)).alias("starred"), flag.alias("save_only")), ["asset_id"])


def promote(verdicts: DataFrame, progress: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids(asset_id, day) go to print; every one counts as an edit of its day in progress(day, edits)."""
    more = ids.groupBy("day").agg(F.count("*").alias("more"))
    counted = progress.join(more, "day", "full_outer").select("day", (F.coalesce("edits", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("edits"))
    return set_status(verdicts, ids, "toPrint"), counted


def stand_down(verdicts: DataFrame, baselines: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames that a merged photo replaces are kept for the archive only, and nothing is compared with their baselines any more."""
    return set_status(verdicts, frames, "kept", save_only=True), tables.delete(baselines, frames, ["asset_id"])


def settle_merge(verdicts: DataFrame, baselines: DataFrame, records: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """merges(merged_id, frame_ids, at) are recorded, their frames stand down as in stand_down, the merged photos go to print, in one pass
    over the verdicts."""
    from shoal.sources.session import materialise

    merges = materialise(merges.select(records.columns))  # read four times
    frames = merges.select(F.explode("frame_ids").alias("asset_id"), F.lit(False).alias("merged"))
    marks = materialise(frames.union(merges.select("merged_id", F.lit(True))).groupBy("asset_id").agg(F.bool_or("merged").alias("merged"), (~F.bool_and("merged")).alias("frame")))
    both = verdicts.join(marks, "asset_id", "full_outer")
    status = F.when(F.col("merged"), "toPrint").when(F.col("frame"), "kept").otherwise(F.col("status"))
    new = {"status": status, "starred": F.when(F.col("frame").isNotNull(), F.coalesce("starred", F.lit(False))).otherwise(F.col("starred")), "save_only": F.when(F.col("frame").isNotNull(), F.col("frame") | F.coalesce("save_only", F.lit(False))).otherwise(F.col("save_only"))}
    decided = both.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in verdicts.columns])
    return decided, tables.delete(baselines, marks.where("frame"), ["asset_id"]), tables.upsert(records, merges, ["merged_id"])


def manifest_stamps(ids: DataFrame, meta: DataFrame, manifests: DataFrame) -> DataFrame:
    """(asset_id, stamp) that the manifest of the asset's album holds: manifests(album_id, asset_id, stamp)."""
    return ids.select("asset_id").join(meta.select("asset_id", "album_id"), "asset_id").join(manifests, ["album_id", "asset_id"]).select("asset_id", "stamp")


def capture_baselines(baselines: DataFrame, seen: DataFrame, cached: DataFrame, fresh: DataFrame, stamps: DataFrame, at: Column) -> DataFrame:
    """seen(asset_id, hash, stamp) become baselines: the hash seen, else the cached, else a fresh one; the stamp seen, else the manifest's."""
    rows = seen.join(cached.select("asset_id", F.col("hash").alias("h1")), "asset_id", "left").join(fresh.select("asset_id", F.col("hash").alias("h2")), "asset_id", "left").join(stamps.select("asset_id", F.col("stamp").alias("s1")), "asset_id", "left")
    return tables.upsert(baselines, rows.select("asset_id", F.coalesce("hash", "h1", "h2").alias("hash"), F.coalesce("stamp", "s1").alias("stamp"), at.alias("at")), ["asset_id"])


def keep_editing(baselines: DataFrame, findings: DataFrame, chosen: DataFrame, at: Column) -> DataFrame:
    """Frames of the chosen sets that were touched are compared with what they are now from here on."""
    touched = findings.join(chosen.select("set_id"), "set_id", "left_semi").where("state <> 'untouched'")
    return tables.upsert(baselines, touched.select("asset_id", "hash", "stamp", at.alias("at")), ["asset_id"])


def requeue(verdicts: DataFrame, filings: DataFrame, ids: DataFrame, album: str, room: int) -> DataFrame:
    """Filings of ids in the album are forgotten; of all that is then outstanding there the oldest go again while there is room."""
    forgotten = tables.delete(filings, ids.select("asset_id", F.lit(album).alias("album")), ["asset_id", "album"])
    waiting = lineage.outstanding(verdicts, forgotten).where(F.col("album") == album).select("asset_id", "album").distinct()
    return running_sums(waiting, ["asset_id"], {"ahead": F.lit(1)}).where(F.col("ahead") < room).select("asset_id", "album")


def file_in_batches(requests: DataFrame, present: DataFrame, batch: int) -> DataFrame:
    """requests(album, asset_id) sent in batches of an album: a batch that holds an asset the album has already is refused as a whole and
    sent again row by row, where that answer counts as success. Returns (album, asset_id, outcome)."""
    n = F.row_number().over(Window.partitionBy("album").orderBy("asset_id")) - 1
    sent = requests.withColumn("batch", F.floor(n / batch)).join(present.select("album", "asset_id", F.lit(True).alias("there")).distinct(), ["album", "asset_id"], "left")
    refused = F.max(F.coalesce("there", F.lit(False))).over(Window.partitionBy("album", "batch"))
    return sent.select("album", "asset_id", F.when(F.col("there"), "already").when(refused, "alone").otherwise("batch").alias("outcome"))


def apply_tag(asset_tags: DataFrame, changes: DataFrame) -> DataFrame:
    """asset_tags(asset_id, tags): the one tag of changes(asset_id, tag) replaces all tags of its asset."""
    return tables.upsert(asset_tags, changes.select("asset_id", F.array("tag").alias("tags")), ["asset_id"])


def toggle_tag(asset_tags: DataFrame, changes: DataFrame) -> DataFrame:
    """A tag that the asset has goes; one that it has not becomes its only one. Assets without tags leave the table."""
    both = changes.join(asset_tags, "asset_id", "left")
    new = F.when(F.array_contains("tags", F.col("tag")), F.array_remove("tags", F.col("tag"))).otherwise(F.array("tag"))
    return tables.upsert(asset_tags, both.select("asset_id", new.alias("tags")), ["asset_id"]).where(F.size("tags") > 0)


def swipe_tag(asset_tags: DataFrame, sets: DataFrame, swipes: DataFrame) -> DataFrame:
    """The tag of swipes(asset_id, tag) goes to every asset of the swiped one's set; the last swiped asset of a set counts."""
    said = swipes.join(sets, "asset_id").groupBy("set_id").agg(F.max_by("tag", "asset_id").alias("tag"))
    return apply_tag(asset_tags, sets.join(said, "set_id").select("asset_id", "tag"))


def set_direction(directions: DataFrame, changes: DataFrame, fixed: str) -> DataFrame:
    """directions(owner, dir, tag), one direction for each tag of an owner: a change(owner, dir, tag) frees both its direction and the
    direction its tag had; a null tag only clears. The fixed direction never changes."""
    wanted = changes.where(F.col("dir") != fixed)
    by_dir = directions.join(wanted.select("owner", "dir"), ["owner", "dir"], "left_anti")
    by_tag = by_dir.join(wanted.where("tag is not null").select("owner", "tag"), ["owner", "tag"], "left_anti")
    return by_tag.select("owner", "dir", "tag").unionByName(wanted.where("tag is not null").select("owner", "dir", "tag"))


def printable(verdicts: DataFrame) -> DataFrame:
    """Prints of a group: those not kept for the archive only."""
    return verdicts.where(~F.coalesce("save_only", F.lit(False)))


def send_to_bin(bins: DataFrame, occupied: DataFrame, album: str, photos: DataFrame) -> DataFrame:
    """The first free bin (smallest name) takes an album's printable photos; nothing is occupied where there are none or no bin is free.
    Returns (bin, album, photos)."""
    free = bins.join(occupied.select("bin"), "bin", "left_anti").agg(F.min("bin").alias("bin")).where("bin is not null")
    filed = printable(photos).agg(F.count("*").alias("photos")).where("photos > 0")
    new = free.join(filed).select("bin", F.lit(album).alias("album"), "photos")  # one row each
    return occupied.select("bin", "album", "photos").unionByName(new)


def set_roles(roles: DataFrame, links: DataFrame, manifests: DataFrame, queued: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """changes(album, role), null clears: roles and links(left_album, right_album) stay consistent, manifests of the changed albums are
    forgotten and their queued units leave."""
    new = tables.delete(roles, changes, ["album"]).unionByName(changes.where("role is not null").select("album", "role"))
    left, right = (new.where(F.col("role") == side).select(F.col("album").alias(f"{side}_album")) for side in ("left", "right"))
    kept = links.join(left, "left_album", "left_semi").join(right, "right_album", "left_semi").select("left_album", "right_album")
    return new, kept, tables.delete(manifests, changes, ["album"]), tables.delete(queued, changes, ["album"])


def goals_met(log: DataFrame, key: str, day: str, order: str, goal: int) -> DataFrame:
    """The row with which a day's work of a key reaches its goal, once a day, and the streak of days that it extends."""
    met = log.withColumn("_n", F.row_number().over(Window.partitionBy(key, day).orderBy(order))).where(F.col("_n") == goal).drop("_n")
    w = Window.partitionBy(key).orderBy(day)
    island = met.withColumn("_i", F.date_sub(F.col(day), F.row_number().over(w).cast("int")))
    return island.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_i").orderBy(day)).cast("long")).drop("_i")


def last_overrides(log: DataFrame) -> DataFrame:
    """log(members, action, at) to the sets that are overridden now: the last action on a set of members counts, whatever their order."""
    signed = log.select(S.set_signature(F.col("members")).alias("signature"), "action", "at")
    last = signed.groupBy("signature").agg(F.max_by("action", F.struct("at", "action")).alias("action"), F.max("at").alias("at"))
    return last.where("action <> 'restore'")


def stale_stores(rules: DataFrame, versions: DataFrame, now: int) -> DataFrame:
    """(owner, store) to clear on an upgrade of versions(owner, version) to `now`: rules(version, store) that came in between."""
    return versions.join(rules.where(F.col("version") <= now).select(F.col("version").alias("since"), "store"), F.col("since") > F.col("version")).select("owner", "store").distinct()


def record_shown(log: DataFrame, shown: DataFrame, now: Column) -> DataFrame:
    """log(user_id, id, n, last_ms, claims) after shown(user_id, id, claim): one more, now, and a claim that is new is added to the claims."""
    new = shown.withColumnRenamed("claim", "_claim").withColumn("_shown", F.lit(True))
    both = log.join(new, ["user_id", "id"], "full_outer")
    had = F.coalesce("claims", F.array().cast("array<string>"))
    claims = F.when(F.col("_claim").isNotNull() & ~F.array_contains(had, F.col("_claim")), F.array_append(had, F.col("_claim"))).otherwise(had)
    seen = F.coalesce("_shown", F.lit(False))
    return both.select("user_id", "id", (F.coalesce("n", F.lit(0)) + seen.cast("int")).alias("n"), F.when(seen, now).otherwise(F.col("last_ms")).alias("last_ms"), F.when(seen, claims).otherwise(had).alias("claims"))


def baseline_unknown(baselines: DataFrame, seen: DataFrame) -> DataFrame:
    """seen(id, updated, hash) become baselines where there was none and a hash is known."""
    return baselines.unionByName(seen.where("hash is not null").join(baselines.select("id"), "id", "left_anti").select(baselines.columns))
