"""Deterministic sampling, rules and matching. A seeded md5 stands for the random draw, so every engine draws alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, *parts: Column) -> Column:
    """A hexadecimal draw: order by it to shuffle."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]))


def album_order(albums: DataFrame, key: str, weight: Column, seed: str) -> DataFrame:
    """Weighted order of keys: each draws `weight` times and its best draw counts."""
    copies = albums.withColumn("copy", F.explode(F.sequence(F.lit(1), weight)))
    return copies.groupBy(key).agg(F.min(draw(seed, F.col(key), F.col("copy"))).alias("best"))


def stratified(units: DataFrame, key: str, unit: str, most: int, seed: str) -> DataFrame:
    """At most `most` units of each key, in drawn order."""
    w = Window.partitionBy(key).orderBy(draw(seed, F.col(unit)), unit)
    return units.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= most)


def disjoint_units(members: DataFrame, unit: str, asset: str) -> DataFrame:
    """Units that keep all their assets when each asset goes to the smallest unit that holds it."""
    owner = members.withColumn("owner", F.min(unit).over(Window.partitionBy(asset)))
    return owner.groupBy(unit).agg(F.count_if(F.col("owner") != F.col(unit)).alias("lost"), F.count("*").alias("n")).where("lost = 0").drop("lost")


def top_priority(candidates: DataFrame, key: str, priority: str, unit: str, seed: str) -> DataFrame:
    """Of the candidates of highest priority of each key, one by draw."""
    w = Window.partitionBy(key).orderBy(F.col(priority).desc(), draw(seed, F.col(unit)), unit)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def weighted_pick(candidates: DataFrame, key: str, order: str, weight: str, ticket: Column) -> DataFrame:
    """The first candidate whose running weight exceeds ticket * total."""
    w = Window.partitionBy(key)
    run = candidates.withColumn("run", F.sum(weight).over(w.orderBy(order))).withColumn("total", F.sum(weight).over(w)).where(F.col("run") > ticket * F.col("total"))
    return run.withColumn("_n", F.row_number().over(w.orderBy(order))).where("_n = 1").drop("_n", "run", "total")


def greedy_pairs(pairs: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """Greedy one-to-one matching in the given order (unique with both sides added): in every round pairs that are the best of both
    their sides are taken and their sides leave. The result is that of the sequential rule, as a pair that is best on both sides comes
    before every pair that could take one of them."""
    from shoal.sources.session import materialise

    key = F.struct(*order, left, right)
    rest, taken = materialise(pairs.select(left, right, *order)), None
    while not rest.isEmpty():
        best_l, best_r = (rest.groupBy(side).agg(F.min(key).alias("best")).select("best.*") for side in (left, right))  # thinned out before they meet
        mutual = materialise(best_l.join(best_r.select(left, right), [left, right], "left_semi").select(left, right, *order))
        taken = mutual if taken is None else taken.unionByName(mutual)
        free = rest.join(mutual.select(left), left, "left_anti").join(mutual.select(right), right, "left_anti")
        rest = materialise(free.select(left, right, *order))  # a join puts its key first
    return pairs.select(left, right, *order).limit(0) if taken is None else taken


def reminders(slots: DataFrame, now: Column, days: int) -> DataFrame:
    """slots(slot, minute, skip_today) on `days` days from today: only what is still to come, and not today where that is to be skipped."""
    today = F.to_date(now)
    every = slots.withColumn("day", F.explode(F.sequence(today, F.date_add(today, days - 1))))
    at = F.unix_seconds(F.col("day").cast("timestamp")) + F.col("minute") * 60
    return every.where((at > F.unix_seconds(now)) & ~(F.col("skip_today") & (F.col("day") == today)))


def celebrate(candidates: DataFrame, key: str, order: str, weight: str, ticket: Column) -> DataFrame:
    """One candidate a key: of those with an unspent claim the heaviest, the first of a tie; without any, a weighted draw."""
    claimed = candidates.where("unspent").groupBy(key).agg(F.min_by(F.struct(*candidates.columns), F.struct(-F.col(weight), order)).alias("c")).select("c.*")
    return claimed.unionByName(weighted_pick(candidates.join(claimed.select(key), key, "left_anti"), key, order, weight, ticket).select(*candidates.columns))


def messages_due(stats: DataFrame, messages: DataFrame, stat: Column, since: Column) -> DataFrame:
    """stats(..., day) with messages(id, type, a, b, cool, ...) whose condition is met and which are not in their cooldown of days: a rule on
    figures, a date or range of dates, or none. The messages are a short catalog that goes to every row."""
    from shoal.functions.rules import date_rule

    both = stats.crossJoin(F.broadcast(messages))
    met = F.when(F.col("type") == "stat", stat).when(F.col("type") == "date", date_rule(F.col("day"), F.col("a"), F.col("b"))).otherwise(True)
    return both.where(met & ((F.col("cool") == 0) | (since >= F.col("cool"))))
