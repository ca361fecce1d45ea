"""Aggregates over verdicts, filings, days and albums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import scalar as S


def status_counts(deck: DataFrame, key: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in S.VERDICTS_IN_ORDER]
    return deck.groupBy(F.coalesce(key, F.lit("No album")).alias(key)).agg(F.count("*").alias("n"), *counts)


def census(known: DataFrame, verdicts: DataFrame, deletions: DataFrame, day: Column) -> DataFrame:
    """One row for a day: known assets, verdicts of each status but backlog, verdicts whose asset is gone, known assets without a verdict
    (backlog), and deletions that the user made (deletions(asset_id, found_gone): those found gone are not counted). Review cards, which
    are no assets, are left out."""
    ruled = verdicts.where(~S.is_unit(F.col("asset_id"))).select("asset_id", "status")
    both = known.select("asset_id", F.lit(True).alias("known")).join(ruled, "asset_id", "full_outer")
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in S.VERDICTS_IN_ORDER if s != "backlog"]
    met = F.count_if(F.col("known") & F.col("status").isNotNull())
    made = deletions.agg(F.count_if(~F.col("found_gone")).alias("deleted_ever"))  # one row, as the other side
    counted = both.agg(F.count_if("known").alias("known"), *counts, F.count_if(F.col("status").isNotNull() & F.col("known").isNull()).alias("gone"), F.greatest(F.count_if("known") - met, F.lit(0)).alias("backlog"))
    return counted.join(F.broadcast(made)).select(day.alias("day"), "*")


def first_writes(log: DataFrame, key: str, at: str) -> DataFrame:
    """The first entry of each key stays; ties go to the smallest row."""
    rest = [c for c in log.columns if c not in (key, at)]
    return log.groupBy(key).agg(F.min(F.struct(at, *rest)).alias("_row")).select(*[key if c == key else F.col("_row")[c].alias(c) for c in log.columns])


def last_writes(log: DataFrame, key: str, at: str) -> DataFrame:
    """The last entry of each key stays; ties go to the largest row."""
    rest = [c for c in log.columns if c not in (key, at)]
    return log.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_row")).select(*[key if c == key else F.col("_row")[c].alias(c) for c in log.columns])


def finished(members: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """Albums scanned to their end of which no member is undecided, to be edited or a maybe, and at least one can be printed."""
    undone = F.coalesce("status", F.lit("backlog")).isin("backlog", "toEdit", "maybe")
    counted = members.join(scanned, key, "left_semi").groupBy(key).agg(F.count_if(F.col("status").isin("kept", "toPrint")).alias("printable"), F.count_if(undone).alias("undone"))
    return counted.where("printable > 0 and undone = 0").drop("undone")


def edit_queue(live: DataFrame, verdicts: DataFrame, baselines: DataFrame, merged: DataFrame, now: int, late: int) -> DataFrame:
    """(asset_id, since, overdue) of live assets of the edit album still to be edited and in no merged photo: how long they have been, a
    missing baseline counting as for ever."""
    open_ = live.join(verdicts.where("status = 'toEdit'").select("asset_id"), "asset_id", "left_semi").join(merged, "asset_id", "left_anti").join(baselines, "asset_id", "left")
    since = F.coalesce("at", F.lit(0))
    return open_.select("asset_id", since.alias("since"), (F.lit(now) - since > late).alias("overdue"))


def record_albums(days: DataFrame, contents: DataFrame, day: Column) -> DataFrame:
    """days(day, album, live, deleted) with what albums hold now as the rows of `day`, instead of those that the day had of them."""
    now = contents.groupBy("album").agg(F.count_if(~F.col("gone")).alias("live"), F.count_if("gone").alias("deleted")).select(day.alias("day"), "album", "live", "deleted")
    return days.join(now.select("day", "album"), ["day", "album"], "left_anti").unionByName(now)


def filed_sets(log: DataFrame) -> DataFrame:
    """log(asset_id, album, at) to (asset_id, albums, at): the albums in the order of their first filing, and the latest time."""
    first = log.groupBy("asset_id", "album").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    made = first.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("first", "album"))).alias("a"), F.max("last").alias("at"))
    return made.select("asset_id", F.transform("a", lambda x: x["album"]).alias("albums"), "at")


def manifest_hashes(assets: DataFrame, key: str) -> DataFrame:
    """(key, hash): FNV-1a in hexadecimal of the lines id@updated of each key, by id."""
    line = F.concat(F.col("id").cast("string"), F.lit("@"), "updated")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    joined = assets.groupBy(key).agg(F.array_join(lines, "\n").alias("t"))
    return joined.select(key, F.lower(F.lpad(F.hex(S.fingerprint(F.col("t"))), 8, "0")).alias("hash"))


def work_waiting(assets: DataFrame, verdicts: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row: whether anything is undecided, to be edited, or a keeper without a tag; a library without assets has work too."""
    open_ = assets.join(verdicts.where("status <> 'backlog'").select("asset_id"), "asset_id", "left_anti").limit(1).agg((F.count("*") > 0).alias("open"))
    edits = verdicts.where("status = 'toEdit'").limit(1).agg((F.count("*") > 0).alias("edits"))
    untagged = verdicts.where(F.col("status").isin("kept", "toPrint")).join(tagged, "asset_id", "left_anti").limit(1).agg((F.count("*") > 0).alias("untagged"))
    none = assets.limit(1).agg((F.count("*") == 0).alias("none"))
    return open_.join(edits).join(untagged).join(none).select((F.col("none") | F.col("open") | F.col("edits") | F.col("untagged")).alias("work"))  # one row each


def offset_vote(left: DataFrame, right: DataFrame, block: str, bin_ms: int, least_votes: int, least_share: float, reach_ms: int) -> DataFrame:
    """Clock offset of each block: all gaps of at most reach_ms between a left and a right time vote for a bin; the modal bin (the lowest of
    a tie) needs max(least_votes, ceil(least_share * smaller side)) votes, and the answer is the median in it. Times are dealt by
    slices of reach_ms, so a time meets only those of its own and the neighbouring slices."""
    slot = F.floor(F.col("ms") / reach_ms)
    l = left.select(block, F.col("ms").alias("lms"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    r = right.select(block, F.col("ms").alias("rms"), slot.alias("slot"))
    gaps = l.join(r, [block, "slot"]).withColumn("gap", F.col("rms") - F.col("lms")).where(F.abs("gap") <= reach_ms)
    bins = gaps.withColumn("bin", S.half_up(F.col("gap") / bin_ms)).groupBy(block, "bin").agg(F.count("*").alias("votes"), S.half_up(F.percentile("gap", 0.5)).alias("offset_ms"))
    top = bins.withColumn("_n", F.row_number().over(Window.partitionBy(block).orderBy(F.col("votes").desc(), "bin"))).where("_n = 1").drop("_n")
    sizes = left.groupBy(block).agg(F.count("*").alias("nl")).join(right.groupBy(block).agg(F.count("*").alias("nr")), block)
    enough = F.col("votes") >= F.greatest(F.lit(least_votes), F.ceil(F.least("nl", "nr") * least_share))
    return top.join(sizes, block).where(enough).select(block, "offset_ms", "votes")


def serial_vote(votes: DataFrame, key: str, serial: Column, vote: Column) -> DataFrame:
    """The serial with the highest sum of votes of each key; a tie names none."""
    sums = votes.groupBy(key, serial.alias("serial")).agg(F.sum(vote).alias("score"))
    w = Window.partitionBy(key)
    best = sums.withColumn("top", F.max("score").over(w)).where("score = top")
    return best.withColumn("ties", F.count("*").over(w)).where("ties = 1").select(key, "serial", F.col("score").cast("long").alias("score"))


def usage(records: DataFrame, group: Column, size: Column) -> DataFrame:
    return records.groupBy(group.alias("store")).agg(F.count("*").alias("records"), F.sum(size).cast("long").alias("bytes")).where("records > 0")
