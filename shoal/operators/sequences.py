"""Operators over rows in time or queue order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.running import running_sums


def hamming(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.bit_count(lo1.bitwiseXOR(lo2)) + F.bit_count(hi1.bitwiseXOR(hi2))


def time_runs(assets: DataFrame, gap_ms: int, max_hamming: int | None = None, same_camera: bool = False) -> DataFrame:
    """assets(asset_id, album_id, ms, camera, lo, hi) with a run number within the album. Neighbours in time are in one run if the gap
    is gap_ms at most and, where asked, cameras are equal (a missing one equals a missing or empty one) and hashes near; a missing hash is near, a missing time is in no run."""
    w = Window.partitionBy("album_id").orderBy("ms", "asset_id")
    near = F.col("ms") - F.lag("ms").over(w) <= gap_ms
    if same_camera:
        near = near & (F.coalesce("camera", F.lit("")) == F.coalesce(F.lag("camera").over(w), F.lit("")))
    if max_hamming is not None:
        near = near & F.coalesce(hamming(F.col("lo"), F.col("hi"), F.lag("lo").over(w), F.lag("hi").over(w)) <= max_hamming, F.lit(True))
    starts = assets.where("ms is not null").withColumn("start", F.when(near, 0).otherwise(1))
    return starts.withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("start")


def bursts(runs: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least `least` assets."""
    return runs.groupBy("album_id", "run").agg(F.count("*").alias("n"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.min("asset_id").alias("first_id")).where(F.col("n") >= least)


def run_neighbours(runs: DataFrame, least: int = 2) -> DataFrame:
    """For each burst the asset just before and just after it in the album: its gap in time and distance in bits (null without a hash)."""
    w = Window.partitionBy("album_id").orderBy("ms", "asset_id")
    beside = lambda f, c: f(c).over(w)
    near = runs.withColumn("before", F.col("ms") - beside(F.lag, "ms")).withColumn("after", beside(F.lead, "ms") - F.col("ms"))
    for name, f in (("bits_before", F.lag), ("bits_after", F.lead)):
        near = near.withColumn(name, hamming(F.col("lo"), F.col("hi"), beside(f, "lo"), beside(f, "hi")).cast("long"))
    pos = Window.partitionBy("album_id", "run").orderBy("ms", "asset_id")
    marked = near.withColumn("i", F.row_number().over(pos)).withColumn("n", F.count("*").over(Window.partitionBy("album_id", "run"))).where(F.col("n") >= least)
    first, last = (lambda c: F.max(F.when(F.col("i") == 1, F.col(c)))), (lambda c: F.max(F.when(F.col("i") == F.col("n"), F.col(c))))
    return marked.groupBy("album_id", "run").agg(first("before").alias("gap_before"), last("after").alias("gap_after"), first("bits_before").alias("bits_before"), last("bits_after").alias("bits_after"))


def scan_end(assets: DataFrame, cursor: int, budget: int, gap_ms: int) -> DataFrame:
    """For each album the first position at or after cursor + budget where a gap over gap_ms, or a missing time, ends the slice."""
    w = Window.partitionBy("album_id").orderBy(F.col("ms").asc_nulls_last(), "asset_id")
    placed = assets.withColumn("pos", F.row_number().over(w)).withColumn("next", F.lead("ms").over(w) - F.col("ms"))
    stop = (F.col("pos") >= cursor + budget) & F.coalesce(F.col("next") > gap_ms, F.lit(True))
    return placed.groupBy("album_id").agg(F.coalesce(F.min(F.when(stop, F.col("pos"))), F.max("pos")).cast("long").alias("end_pos"))


def admission(units: DataFrame, room: int) -> DataFrame:
    """units(queue, unit, size, since): whole units, oldest first, while room is left before them; the last may overshoot."""
    before = Window.partitionBy("queue").orderBy("since", "unit").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("ahead") < room)


def day_streaks(days: DataFrame) -> DataFrame:
    """days(user_id, day), distinct, to runs of consecutive days."""
    island = F.date_sub(F.col("day"), F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("int"))
    return days.withColumn("island", island).groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("island")


def streaks_with_freezes(days: DataFrame, earn_every: int = 60, most: int = 3) -> DataFrame:
    """days(user_id, day, met, work), one row for each day a user opened, to the state after the last one. Opening settles the days missed
    since the last opening: without work waiting they pause the streak; else each spends a freeze, and if there are too few all are
    spent and the streak starts anew. A day on which the goal is met extends the streak, and every `earn_every` days earn a freeze,
    of which `most` are held. The state folds over one user's days, an array no longer than their calendar."""
    folded = days.groupBy("user_id").agg(F.sort_array(F.collect_set(F.struct("day", "met", "work"))).alias("all"))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("held"), F.lit(None).cast("date").alias("last"), F.lit(0).alias("spent"))

    def step(s: Column, d: Column) -> Column:
        missed = F.when(d["work"], F.greatest(F.coalesce(F.datediff(d["day"], s["last"]) - 1, F.lit(0)), F.lit(0))).otherwise(F.lit(0))
        lives = missed <= s["held"]
        spent = F.when(lives, missed).otherwise(s["held"])
        run = F.when(lives, s["run"]).otherwise(F.lit(0)) + d["met"].cast("int")
        earned = (d["met"] & (run % earn_every == 0)).cast("int")
        return F.struct(run.alias("run"), F.least(s["held"] - spent + earned, F.lit(most)).alias("held"), d["day"].alias("last"), (s["spent"] + spent).alias("spent"))

    return folded.select("user_id", F.aggregate("all", start, step).alias("s")).select("user_id", F.col("s.run").alias("streak"), F.col("s.held").alias("freezes"), F.col("s.spent").alias("spent"), F.col("s.last").alias("last_day"))


def queue_room(queue: DataFrame, held: DataFrame, waiting: DataFrame, cap: int) -> DataFrame:
    """Assets of waiting(asset_id, unit, since) that the queue still has room for: none while anything in it is overdue, else whole units,
    oldest first, until the cap less the held ones is used up. The running sum over the waiting units is a distributed one."""
    late = queue.agg(F.coalesce(F.bool_or("overdue"), F.lit(False)).alias("late"))
    room = held.agg((F.lit(cap) - F.count("*")).alias("left")).join(late).select(F.when(F.col("late"), 0).otherwise(F.col("left")).alias("room"))  # one row
    units = waiting.groupBy("unit").agg(F.count("*").alias("size"), F.min("since").alias("since"))
    admitted = running_sums(units, ["since", "unit"], {"ahead": F.col("size")}).join(F.broadcast(room)).where("ahead < room")
    return waiting.join(admitted.select("unit"), "unit", "left_semi").select("asset_id")


def advance_cursors(assets: DataFrame, cursors: DataFrame, failed: DataFrame, budget: int, gap_ms: int) -> DataFrame:
    """(album_id, start, reached, exhausted, skipped) of one scan of every album. assets(album_id, asset_id, ms) in time order;
    cursors(album_id, scanned, unchanged): a changed album starts anew. A scan takes `budget` assets from the cursor and goes on while the
    next is within the gap; where an asset of the prefix is in failed(asset_id), as its pixels could not be had, the cursor stays."""
    w = Window.partitionBy("album_id").orderBy(F.col("ms").asc_nulls_first(), "asset_id")
    whole = Window.partitionBy("album_id")
    start = F.when(F.col("unchanged"), F.coalesce("scanned", F.lit(0))).otherwise(0)
    placed = assets.withColumn("pos", F.row_number().over(w)).withColumn("n", F.count("*").over(whole)).withColumn("near", F.coalesce(F.lead("ms").over(w) - F.col("ms") <= gap_ms, F.lit(False)))
    known = placed.join(cursors, "album_id", "left").withColumn("start", F.coalesce(start, F.lit(0))).join(failed.select("asset_id", F.lit(True).alias("bad")).distinct(), "asset_id", "left")
    least = F.least(F.col("start") + max(budget, 1), F.col("n"))
    stop = F.min(F.when((F.col("pos") >= least) & ~F.col("near"), F.col("pos")))
    ends = known.groupBy("album_id", "start", "n").agg(stop.alias("end"), F.min(F.when(F.col("bad"), F.col("pos"))).alias("bad_at"), F.bool_or(F.coalesce("unchanged", F.lit(False))).alias("unchanged"))
    skipped = F.col("unchanged") & (F.col("start") >= F.col("n"))
    reached = F.when(skipped | (F.col("bad_at") <= F.col("end")), F.col("start")).otherwise(F.col("end"))
    return ends.select("album_id", F.col("start").cast("long").alias("start"), reached.cast("long").alias("reached"), (reached >= F.col("n")).alias("exhausted"), skipped.alias("skipped"))
