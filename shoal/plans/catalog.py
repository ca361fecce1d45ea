"""Queries over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions import scalar as S
from shoal.operators import facts, lineage, selection, sequences, tables, vectors
from shoal.sources import adapters as A
from shoal.sources.session import checkpoint_root
from shoal.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOURS3 = 3 * 3_600_000
HAM = "bit_count(xor({a}.lo, {b}.lo)) + bit_count(xor({a}.hi, {b}.hi))"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = A.with_adapters(sql)
        return f

    return put


STEM = "CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^(.+)\\.([^.]+)$', 1) ELSE name END"
FILED = "CASE status WHEN 'toEdit' THEN 'Edit' WHEN 'kept' THEN 'Keep' WHEN 'toPrint' THEN 'Print' END"
RUNS = f"""WITH lagged AS (SELECT *, lag(ms) OVER w AS pms, lag(lo) OVER w AS plo, lag(hi) OVER w AS phi, lag(camera) OVER w AS pcam FROM assets WHERE ms IS NOT NULL WINDOW w AS (PARTITION BY album_id ORDER BY ms, asset_id)),
runs AS (SELECT *, sum(CASE WHEN ms - pms <= {HOURS3} AND coalesce(camera, '') = coalesce(pcam, '') AND coalesce(bit_count(xor(lo, plo)) + bit_count(xor(hi, phi)) <= 32, true) THEN 0 ELSE 1 END) OVER (PARTITION BY album_id ORDER BY ms, asset_id ROWS UNBOUNDED PRECEDING) AS run FROM lagged)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return sequences.time_runs(A.assets(spark, d), HOURS3, max_hamming=32, same_camera=True)


@query("win_burst", f"{RUNS} SELECT album_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(ms) AS start_ms, max(ms) AS end_ms, min(asset_id) AS first_id FROM runs GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    return sequences.bursts(_runs(spark, d)).withColumn("run", F.col("run").cast("long"))


@query("win_time_runs", f"WITH l AS (SELECT *, lag(ms) OVER w AS pms, lag(camera) OVER w AS pc FROM assets WHERE ms IS NOT NULL WINDOW w AS (PARTITION BY album_id ORDER BY ms, asset_id)), r AS (SELECT *, sum(CASE WHEN ms - pms <= {HOURS3} AND coalesce(camera, '') = coalesce(pc, '') THEN 0 ELSE 1 END) OVER (PARTITION BY album_id ORDER BY ms, asset_id ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT album_id, CAST(run AS BIGINT) AS run, count(*) AS n FROM r GROUP BY 1, 2")
def _(spark, d):
    return sequences.time_runs(A.assets(spark, d), HOURS3, same_camera=True).groupBy("album_id", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"))


@query("win_neighbours", f"{RUNS}, m AS (SELECT *, ms - lag(ms) OVER w AS b, lead(ms) OVER w - ms AS a, bit_count(xor(lo, lag(lo) OVER w)) + bit_count(xor(hi, lag(hi) OVER w)) AS bb, bit_count(xor(lo, lead(lo) OVER w)) + bit_count(xor(hi, lead(hi) OVER w)) AS ba, row_number() OVER (PARTITION BY album_id, run ORDER BY ms, asset_id) AS i, count(*) OVER (PARTITION BY album_id, run) AS n FROM runs WINDOW w AS (PARTITION BY album_id ORDER BY ms, asset_id)) SELECT album_id, CAST(run AS BIGINT) AS run, max(CASE WHEN i = 1 THEN b END) AS gap_before, max(CASE WHEN i = n THEN a END) AS gap_after, CAST(max(CASE WHEN i = 1 THEN bb END) AS BIGINT) AS bits_before, CAST(max(CASE WHEN i = n THEN ba END) AS BIGINT) AS bits_after FROM m WHERE n >= 2 GROUP BY 1, 2")
def _(spark, d):
    return sequences.run_neighbours(_runs(spark, d)).withColumn("run", F.col("run").cast("long"))


@query("win_scan_end", f"WITH p AS (SELECT album_id, row_number() OVER w AS pos, lead(ms) OVER w - ms AS nxt FROM assets WINDOW w AS (PARTITION BY album_id ORDER BY ms ASC NULLS LAST, asset_id)) SELECT album_id, CAST(coalesce(min(CASE WHEN pos >= 15 AND coalesce(nxt > {HOURS3}, true) THEN pos END), max(pos)) AS BIGINT) AS end_pos FROM p GROUP BY 1")
def _(spark, d):
    return sequences.scan_end(A.assets(spark, d), 5, 10, HOURS3)


@query("win_admission", "WITH u AS (SELECT l_suppkey AS queue, l_orderkey AS unit, count(*) AS size, min(epoch_us(l_shipdate) // 1000) AS since FROM lineitem GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY queue ORDER BY since, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM u) SELECT queue, unit, size, since, CAST(ahead AS BIGINT) AS ahead FROM r WHERE ahead < 50")
def _(spark, d):
    units = A.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("queue"), F.col("l_orderkey").alias("unit")).agg(F.count("*").alias("size"), F.min(F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("since"))
    return sequences.admission(units, 50)


DAYS = "WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)"


def _days(spark, d):
    return A.read(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()


@query("win_streak", f"{DAYS}, i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM days) SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY user_id, island")
def _(spark, d):
    return sequences.day_streaks(_days(spark, d))


@query("win_settle")
def _(spark, d):
    opened = A.read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.count("*") >= 2).alias("met"), F.bool_or(F.col("event_type") != "click").alias("work"))
    return sequences.streaks_with_freezes(opened, earn_every=7)


@query("win_streak_on", f"{DAYS}, i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM days), s AS (SELECT user_id, max(day) AS last_day, count(*) AS n FROM i GROUP BY user_id, island), t AS (SELECT max(day) AS today FROM days) SELECT user_id, CAST(max(CASE WHEN last_day >= today - 1 THEN n ELSE 0 END) AS BIGINT) AS streak FROM s, t GROUP BY user_id")
def _(spark, d):
    days = _days(spark, d)
    today = days.agg(F.max("day").alias("today"))  # one row
    return sequences.day_streaks(days).join(F.broadcast(today)).groupBy("user_id").agg(F.max(F.when(F.col("last_day") >= F.date_sub("today", 1), F.col("days")).otherwise(0)).alias("streak"))


@query("win_undo", "SELECT user_id, event_id, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return A.read(spark, d, "events").withColumn("n", F.row_number().over(w).cast("long")).where("n <= 20").select("user_id", "event_id", "n")


@query("win_overdue", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS BIGINT) AS age FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) <= DATE '1998-01-01' - 30")
def _(spark, d):
    day = F.to_date("o_orderdate")
    return A.read(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (day <= F.date_sub(F.lit("1998-01-01").cast("date"), 30))).select("o_orderkey", F.datediff(F.lit("1998-01-01").cast("date"), day).cast("long").alias("age"))


@query("win_history", "WITH p AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM p")
def _(spark, d):
    per = A.read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return per.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("day")))  # one row a day


# Lineage and reconciliation


@query("join_edit_original", f"WITH s AS (SELECT asset_id, ord, lower({STEM}) AS stem FROM meta), e AS (SELECT *, regexp_replace(stem, '-(enhanced-nr|enhanced|edit)$', '') AS base FROM s), o AS (SELECT stem, arg_max(asset_id, ord) AS original_id FROM e WHERE base = stem GROUP BY stem) SELECT e.asset_id AS edit_id, original_id FROM e JOIN o ON o.stem = e.base WHERE e.base <> e.stem")
def _(spark, d):
    return lineage.edit_pairs(A.meta(spark, d))


@query("join_edits_excl", f"WITH s AS (SELECT asset_id, ord, lower({STEM}) AS stem FROM meta), e AS (SELECT *, regexp_replace(stem, '-(enhanced-nr|enhanced|edit)$', '') AS base FROM s) SELECT asset_id FROM e WHERE NOT (base <> stem AND base IN (SELECT stem FROM e WHERE base = stem))")
def _(spark, d):
    meta = A.meta(spark, d)
    return meta.join(lineage.edit_pairs(meta).select(F.col("edit_id").alias("asset_id")), "asset_id", "left_anti").select("asset_id")


_NEAREST = f"s AS (SELECT asset_id, ord, lower({STEM}) AS stem FROM meta), p AS (SELECT asset_id, 0 AS level, regexp_replace(stem, '-(hdr|pano)(-[0-9]+)?$', '') AS st FROM s WHERE regexp_matches(stem, '-(hdr|pano)(-[0-9]+)?$') UNION ALL SELECT asset_id, level + 1, regexp_replace(st, '-(hdr|pano)(-[0-9]+)?$', '') FROM p WHERE regexp_matches(st, '-(hdr|pano)(-[0-9]+)?$')), n AS (SELECT stem, arg_max(asset_id, ord) AS source_id FROM s GROUP BY stem), m AS (SELECT p.asset_id AS merged_id, level, source_id, row_number() OVER (PARTITION BY p.asset_id ORDER BY level) AS k FROM p JOIN n ON n.stem = p.st), near AS (SELECT merged_id, CASE WHEN stem LIKE '%-hdr%' AND stem LIKE '%-pano%' THEN 'HDR panorama' WHEN stem LIKE '%-hdr%' THEN 'HDR' ELSE 'panorama' END AS kind, source_id, CAST(level AS BIGINT) AS level FROM m JOIN s ON s.asset_id = merged_id WHERE k = 1)"


@query("join_merges", f"WITH {_NEAREST}, st AS (SELECT asset_id // 12 AS set_id, asset_id FROM meta WHERE asset_id % 12 < 7), fr AS (SELECT merged_id, kind, coalesce(f.asset_id, source_id) AS frame_id FROM near LEFT JOIN st h ON h.asset_id = source_id LEFT JOIN st f ON f.set_id = h.set_id) SELECT DISTINCT merged_id, kind, frame_id FROM fr WHERE merged_id IN (SELECT merged_id FROM fr WHERE frame_id IN (SELECT asset_id FROM verdicts WHERE status = 'toEdit'))")
def _(spark, d):
    sets = A.meta(spark, d).where("asset_id % 12 < 7").select(F.floor(F.col("asset_id") / 12).alias("set_id"), "asset_id")
    return lineage.find_merges(A.meta(spark, d), sets, A.verdicts(spark, d).where("status = 'toEdit'"))


@query("join_verdict_overlay", "SELECT m.asset_id, album, coalesce(status, 'backlog') AS status, coalesce(starred, false) AS starred, coalesce(save_only, false) AS save_only FROM meta m LEFT JOIN verdicts v USING (asset_id)")
def _(spark, d):
    return lineage.overlay(A.meta(spark, d), A.verdicts(spark, d))


@query("join_undecided", "SELECT group_id, count(*) AS n FROM members GROUP BY group_id HAVING NOT bool_or(asset_id IN (SELECT asset_id FROM verdicts WHERE status <> 'backlog'))")
def _(spark, d):
    return lineage.undecided_groups(A.members(spark, d), A.verdicts(spark, d))


@query("join_stale", f"WITH w AS (SELECT asset_id, {FILED} AS wanted FROM verdicts) SELECT f.asset_id, f.album FROM filings f LEFT JOIN w USING (asset_id) WHERE wanted IS NULL OR wanted <> album")
def _(spark, d):
    return lineage.stale(A.verdicts(spark, d), A.filings(spark, d))


@query("join_stale_present", f"WITH w AS (SELECT asset_id, {FILED} AS wanted FROM verdicts), s AS (SELECT f.asset_id, f.album FROM filings f LEFT JOIN w USING (asset_id) WHERE wanted IS NULL OR wanted <> album) SELECT s.* FROM s JOIN listing l ON l.id = s.asset_id AND l.album = s.album WHERE l.original_id IS NULL")
def _(spark, d):
    live = A.listing(spark, d).where("original_id is null").select(F.col("id").alias("asset_id"), "album")
    return lineage.stale(A.verdicts(spark, d), A.filings(spark, d)).join(live, ["asset_id", "album"])


@query("join_contents", "SELECT album, coalesce(original_id, id) AS asset_id, original_id IS NOT NULL AS gone FROM listing")
def _(spark, d):
    return lineage.contents(A.listing(spark, d))


@query("join_manifest_diff", "SELECT id, CASE WHEN o.updated IS NULL THEN 'added' WHEN n.updated IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old_snapshot o FULL JOIN new_snapshot n USING (id) WHERE o.updated IS DISTINCT FROM n.updated")
def _(spark, d):
    return lineage.snapshot_diff(*A.snapshots(spark, d))


@query("join_repair", f"WITH s AS (SELECT asset_id, ord, lower({STEM}) AS stem FROM meta), e AS (SELECT *, regexp_replace(stem, '-(enhanced-nr|enhanced|edit)$', '') AS base FROM s), o AS (SELECT stem, arg_max(asset_id, ord) AS original_id FROM e WHERE base = stem GROUP BY stem), p AS (SELECT e.asset_id AS edit_id, original_id FROM e JOIN o ON o.stem = e.base WHERE e.base <> e.stem) SELECT original_id, arg_min(status, edit_id) AS status FROM p JOIN verdicts v ON v.asset_id = edit_id WHERE original_id NOT IN (SELECT asset_id FROM verdicts) GROUP BY original_id")
def _(spark, d):
    return lineage.repaired(lineage.edit_pairs(A.meta(spark, d)), A.verdicts(spark, d))


@query("join_group_match", "WITH m AS (SELECT DISTINCT group_id, asset_id FROM members), r AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM m WHERE group_id % 2 = 0), x AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM (SELECT group_id + 1 AS group_id, asset_id FROM m WHERE group_id % 2 = 0 AND asset_id % 5 <> 0)) SELECT r.group_id AS recorded, x.group_id AS detected, count(*) AS shared FROM r JOIN x USING (asset_id) GROUP BY r.group_id, x.group_id, r.n, x.n HAVING 2 * count(*) > r.n + x.n - count(*)")
def _(spark, d):
    sets = A.members(spark, d).select("group_id", "asset_id").distinct().where("group_id % 2 = 0")
    return lineage.majority_matches(sets, sets.where("asset_id % 5 <> 0").select(F.col("group_id") + 1, "asset_id"))


@query("join_hamming_banded", f"SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, CAST({HAM.format(a='a', b='b')} AS BIGINT) AS bits FROM hashes a JOIN hashes b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {HAM.format(a='a', b='b')} <= 7")
def _(spark, d):
    return lineage.near_pairs(A.hashes(spark, d), "label", 7)


# Facts


@query("agg_by_album", "SELECT coalesce(album, 'No album') AS album, count(*) AS n, min(ord) AS first_ord FROM meta GROUP BY 1")
def _(spark, d):
    return A.meta(spark, d).groupBy(F.coalesce("album", F.lit("No album")).alias("album")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in S.VERDICTS_IN_ORDER)


@query("agg_status_counts", f"WITH k AS (SELECT album, coalesce(status, 'backlog') AS status FROM meta LEFT JOIN verdicts USING (asset_id)) SELECT coalesce(album, 'No album') AS album, count(*) AS n, {_COUNTS} FROM k GROUP BY 1")
def _(spark, d):
    return facts.status_counts(lineage.overlay(A.meta(spark, d), A.verdicts(spark, d)), "album")


_DELETED = "log AS (SELECT asset_id, album, noted_at, found_gone FROM (SELECT original_id AS asset_id, album, original_id % 1000 AS noted_at, original_id % 3 = 0 AS found_gone FROM listing WHERE original_id IS NOT NULL UNION ALL SELECT asset_id, album, filed_at % 700, asset_id % 4 <> 0 FROM filings WHERE asset_id % 10 = 2) QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY noted_at, album, found_gone) = 1)"


def _deletions(spark, d):
    """The log of deletions: those noted as they were made and those found gone later, the first entry of an asset staying."""
    gone = A.listing(spark, d).where("original_id is not null").select(F.col("original_id").alias("asset_id"), "album", (F.col("original_id") % 1000).alias("noted_at"), (F.col("original_id") % 3 == 0).alias("found_gone"))
    more = A.filings(spark, d).where("asset_id % 10 = 2").select("asset_id", "album", (F.col("filed_at") % 700).alias("noted_at"), (F.col("asset_id") % 4 != 0).alias("found_gone"))
    return facts.first_writes(gone.unionByName(more), "asset_id", "noted_at")


_RULED = [s for s in S.VERDICTS_IN_ORDER if s != "backlog"]
_DAYS = f"DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS day, CAST(n_regionkey AS BIGINT) AS known, {', '.join(f'CAST(0 AS BIGINT) AS n_{s.lower()}' for s in _RULED)}, CAST(0 AS BIGINT) AS gone, CAST(0 AS BIGINT) AS backlog, CAST(n_nationkey AS BIGINT) AS deleted_ever"


@query("agg_census", f"WITH {_DELETED}, b AS (SELECT m.asset_id IS NOT NULL AS known, v.status FROM (SELECT CAST(asset_id AS VARCHAR) AS asset_id FROM meta WHERE asset_id % 6 <> 0) m FULL JOIN (SELECT CAST(asset_id AS VARCHAR) AS asset_id, status FROM verdicts) v ON v.asset_id = m.asset_id) SELECT DATE '2024-01-10' AS day, count(*) FILTER (known) AS known, {', '.join(f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in _RULED)}, count(*) FILTER (status IS NOT NULL AND NOT known) AS gone, count(*) FILTER (known AND status IS NULL) AS backlog, (SELECT count(*) FROM log WHERE NOT found_gone) AS deleted_ever FROM b UNION ALL SELECT {_DAYS} FROM nation WHERE n_nationkey <> 9")
def _(spark, d):
    name = F.col("asset_id").cast("string").alias("asset_id")
    verdicts = A.verdicts(spark, d)
    cards = verdicts.where("asset_id % 5 = 0").select(F.concat(F.lit("burst:"), F.col("asset_id").cast("string")).alias("asset_id"), "status")
    today = facts.census(A.meta(spark, d).where("asset_id % 6 <> 0").select(name), verdicts.select(name, "status").unionByName(cards), _deletions(spark, d), F.to_date(F.lit("2024-01-10")))
    zeros = [F.lit(0).cast("long").alias(c) for c in [f"n_{s.lower()}" for s in _RULED] + ["gone", "backlog"]]
    days = A.read(spark, d, "nation").select(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("n_nationkey").cast("int")).alias("day"), F.col("n_regionkey").cast("long").alias("known"), *zeros, F.col("n_nationkey").cast("long").alias("deleted_ever"))
    return tables.upsert(days, today, ["day"])


@query("agg_deletions", f"WITH {_DELETED} SELECT album, count(*) FILTER (NOT found_gone) AS deleted, count(*) FILTER (found_gone) AS found FROM log GROUP BY 1")
def _(spark, d):
    return _deletions(spark, d).groupBy("album").agg(F.count_if(~F.col("found_gone")).alias("deleted"), F.count_if("found_gone").alias("found"))


@query("agg_gone_note", f"WITH {_DELETED} SELECT * FROM log")
def _(spark, d):
    return _deletions(spark, d).select("asset_id", "album", "noted_at", "found_gone")


@query("st_verdict_log", "SELECT user_id, event_id, event_type, logged FROM (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS logged, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC, event_type DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    log = A.read(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("logged"))
    return facts.last_writes(log, "user_id", "logged")


@query("agg_cameras", "SELECT camera, album_id % 7 AS model, count(*) AS n FROM assets GROUP BY 1, 2")
def _(spark, d):
    return A.assets(spark, d).groupBy("camera", (F.col("album_id") % 7).alias("model")).agg(F.count("*").alias("n"))


@query("agg_usage", "SELECT lang AS store, count(*) AS records, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def _(spark, d):
    return facts.usage(A.read(spark, d, "documents"), F.col("lang"), F.col("n_chars"))


@query("agg_offset_vote", "WITH l AS (SELECT album_id, ms FROM assets WHERE ms IS NOT NULL AND asset_id % 2 = 0), r AS (SELECT album_id, ms FROM assets WHERE ms IS NOT NULL AND asset_id % 2 = 1), g AS (SELECT l.album_id, r.ms - l.ms AS gap FROM l JOIN r USING (album_id) WHERE abs(r.ms - l.ms) <= 7200000), b AS (SELECT album_id, CAST(floor(gap / 600000.0 + 0.5) AS BIGINT) AS bin, count(*) AS votes, CAST(floor(quantile_cont(gap, 0.5) + 0.5) AS BIGINT) AS offset_ms FROM g GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY votes DESC, bin) AS k FROM b), s AS (SELECT album_id, (SELECT count(*) FROM l WHERE l.album_id = a.album_id) AS nl, (SELECT count(*) FROM r WHERE r.album_id = a.album_id) AS nr FROM (SELECT DISTINCT album_id FROM l) a) SELECT t.album_id, offset_ms, votes FROM t JOIN s USING (album_id) WHERE k = 1 AND votes >= greatest(2, ceil(least(nl, nr) * 0.05))")
def _(spark, d):
    timed = A.assets(spark, d).where("ms is not null").select("album_id", "ms", "asset_id")
    return facts.offset_vote(timed.where("asset_id % 2 = 0"), timed.where("asset_id % 2 = 1"), "album_id", 600_000, 2, 0.05, 7_200_000)


@query("agg_serial_vote", "WITH s AS (SELECT user_id, event_type AS serial, sum(CASE WHEN value > 50 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END) AS score FROM events GROUP BY 1, 2), m AS (SELECT *, max(score) OVER (PARTITION BY user_id) AS top FROM s), b AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS ties FROM m WHERE score = top) SELECT user_id, serial, CAST(score AS BIGINT) AS score FROM b WHERE ties = 1")
def _(spark, d):
    return facts.serial_vote(A.read(spark, d, "events"), "user_id", F.col("event_type"), F.when(F.col("value") > 50, 1).when(F.col("value") < 20, -1).otherwise(0))


@query("agg_missing_albums", "SELECT name AS album FROM (VALUES ('Edit'), ('Keep'), ('Print'), ('Archive')) t(name) WHERE name NOT IN (SELECT album FROM listing)")
def _(spark, d):
    return spark.createDataFrame([("Edit",), ("Keep",), ("Print",), ("Archive",)], "album string").join(A.listing(spark, d), "album", "left_anti")


# Selection and sets


@query("smp_shuffle", "SELECT asset_id, md5('s1:' || CAST(asset_id AS VARCHAR)) AS draw FROM meta")
def _(spark, d):
    return A.meta(spark, d).select("asset_id", selection.draw("s1", F.col("asset_id")).alias("draw"))


@query("smp_album_order", "SELECT o_custkey, min(md5('s2:' || CAST(o_custkey AS VARCHAR) || ':' || CAST(copy AS VARCHAR))) AS best FROM (SELECT DISTINCT o_custkey, unnest(range(1, CASE WHEN o_custkey % 4 = 0 THEN 4 ELSE 2 END)) AS copy FROM orders) GROUP BY 1")
def _(spark, d):
    return selection.album_order(A.read(spark, d, "orders").select("o_custkey").distinct(), "o_custkey", F.when(F.col("o_custkey") % 4 == 0, 3).otherwise(1), "s2")


@query("smp_exclusive_units", "WITH o AS (SELECT *, min(group_id) OVER (PARTITION BY asset_id) AS owner FROM members) SELECT group_id, count(*) AS n FROM o GROUP BY 1 HAVING bool_and(owner = group_id)")
def _(spark, d):
    return selection.disjoint_units(A.members(spark, d), "group_id", "asset_id")


@query("smp_notify", "SELECT c_mktsegment, c_custkey, prio FROM (SELECT c_mktsegment, c_custkey, c_nationkey % 5 AS prio, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey % 5 DESC, md5('s4:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS k FROM customer WHERE c_acctbal > 0) WHERE k = 1")
def _(spark, d):
    eligible = A.read(spark, d, "customer").where("c_acctbal > 0").select("c_mktsegment", "c_custkey", (F.col("c_nationkey") % 5).alias("prio"))
    return selection.top_priority(eligible, "c_mktsegment", "prio", "c_custkey", "s4")


@query("smp_weighted", "WITH r AS (SELECT p_brand, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS run, sum(p_size) OVER (PARTITION BY p_brand) AS total FROM part) SELECT p_brand, min(p_partkey) AS p_partkey FROM r WHERE run > 0.4 * total GROUP BY 1")
def _(spark, d):
    return selection.weighted_pick(A.read(spark, d, "part"), "p_brand", "p_partkey", "p_size", F.lit(0.4)).select("p_brand", "p_partkey")


@query("mat_pair_eyes")
def _(spark, d):
    h = A.hashes(spark, d)
    left, right = h.where("vec_id % 2 = 0").toDF("left_id", "lo1", "hi1", "label"), h.where("vec_id % 2 = 1").toDF("right_id", "lo2", "hi2", "label")
    bits = sequences.hamming(F.col("lo1"), F.col("hi1"), F.col("lo2"), F.col("hi2")).cast("long")
    return selection.greedy_pairs(left.join(right, "label").withColumn("bits", bits).where("bits <= 26"), "left_id", "right_id", ["bits"])


@query("lim_first_bin", "SELECT min(name) AS bin FROM (VALUES ('Bin 1'), ('Bin 2'), ('Edit'), ('Print')) t(name) WHERE name NOT IN (SELECT album FROM listing)")
def _(spark, d):
    return spark.createDataFrame([("Bin 1",), ("Bin 2",), ("Edit",), ("Print",)], "album string").join(A.listing(spark, d), "album", "left_anti").agg(F.min("album").alias("bin"))


@query("set_signature", "SELECT group_id, md5(string_agg(CAST(asset_id AS VARCHAR), chr(10) ORDER BY CAST(asset_id AS VARCHAR))) AS signature FROM members GROUP BY 1")
def _(spark, d):
    return A.members(spark, d).groupBy("group_id").agg(F.md5(F.concat_ws("\n", F.sort_array(F.collect_list(F.col("asset_id").cast("string"))))).alias("signature"))


@query("set_absorbed", "SELECT DISTINCT group_id FROM members WHERE asset_id IN (SELECT asset_id FROM members WHERE group_id <= 20)")
def _(spark, d):
    members = A.members(spark, d)
    return members.join(members.where("group_id <= 20").select("asset_id"), "asset_id", "left_semi").select("group_id").distinct()


# Scalars


@query("fn_names", f"SELECT asset_id, {STEM} AS stem, CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^(.+)\\.([^.]+)$', 2) ELSE '' END AS ext, regexp_replace({STEM}, '(?i)-(Enhanced-NR|Enhanced|Edit)$', '') AS base, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace({STEM}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}-', '') AS term FROM meta")
def _(spark, d):
    name = F.col("name")
    return A.meta(spark, d).select("asset_id", S.file_stem(name).alias("stem"), F.when(S.file_stem(name) != name, S.file_ext(name)).otherwise("").alias("ext"), S.edit_base(S.file_stem(name)).alias("base"), S.slug(name).alias("slug"), S.search_term(name).alias("term"))


@query("fn_verdicts", f"SELECT asset_id, {FILED} AS album, NOT save_only AND status IN ('kept', 'toPrint') AS in_bin, CAST(list_position(['backlog', 'kept', 'toPrint', 'toEdit', 'maybe', 'rejected'], status) AS BIGINT) AS rank FROM verdicts")
def _(spark, d):
    return A.verdicts(spark, d).select("asset_id", S.album_for(F.col("status")).alias("album"), S.in_print_bin(F.col("status"), F.col("save_only")).alias("in_bin"), S.verdict_rank(F.col("status")).alias("rank"))


@query("fn_swipe", "WITH s AS (SELECT event_id, CAST(event_id % 41 - 20 AS DOUBLE) AS dx, CAST(event_id % 29 - 14 AS DOUBLE) AS dy FROM events) SELECT event_id, CASE WHEN dx = 0 AND dy = 0 THEN NULL WHEN abs(dx) >= abs(dy) AND dx > 0 THEN 'kept' WHEN abs(dx) >= abs(dy) THEN 'rejected' WHEN dy < 0 THEN 'toEdit' ELSE 'maybe' END AS verdict, least(1.0, greatest(abs(dx), abs(dy)) / 16.0) AS strength, CAST((CAST(floor(atan2(dy, dx) * 4 / pi() + 0.5) AS BIGINT) % 8 + 8) % 8 AS BIGINT) AS sector FROM s")
def _(spark, d):
    s = A.read(spark, d, "events").select("event_id", (F.col("event_id") % 41 - 20).cast("double").alias("dx"), (F.col("event_id") % 29 - 14).cast("double").alias("dy"))
    return s.select("event_id", S.swipe_verdict(F.col("dx"), F.col("dy")).alias("verdict"), S.swipe_strength(F.col("dx"), F.col("dy"), 16.0).alias("strength"), S.swipe_sector(F.col("dx"), F.col("dy")).cast("long").alias("sector"))


@query("fn_haversine", "WITH p AS (SELECT event_id, value * 0.9 AS a, value * 1.7 AS b, value * 0.9 + 0.001 AS c, value * 1.7 - 0.002 AS e FROM events) SELECT event_id, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(e - b) / 2), 2)))), 3) AS metres FROM p")
def _(spark, d):
    a, b = F.col("value") * 0.9, F.col("value") * 1.7
    return A.read(spark, d, "events").select("event_id", F.round(S.haversine(a, b, a + 0.001, b - 0.002), 3).alias("metres"))


@query("fn_bytes", "WITH b AS (SELECT doc_id, n_chars * n_chars AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1000000000 THEN 'big' WHEN n >= 1000000 THEN CASE WHEN n / 1000000.0 < 10 THEN printf('%.1f', floor(n / 1000000.0 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(n / 1000000.0 + 0.5) AS BIGINT) AS VARCHAR) END || ' MB' WHEN n >= 1000 THEN CASE WHEN n / 1000.0 < 10 THEN printf('%.1f', floor(n / 1000.0 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(n / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) END || ' kB' ELSE CAST(n AS VARCHAR) || ' B' END AS label FROM b")
def _(spark, d):
    n = F.col("n_chars") * F.col("n_chars")
    return A.read(spark, d, "documents").select("doc_id", F.when(n >= 1_000_000_000, "big").otherwise(S.byte_label(n)).alias("label"))


@query("fn_dates", "SELECT event_id, strftime(ts, '%m-%d') BETWEEN '01-05' AND '01-20' AS in_range, strftime(ts, '%m-%d') >= '12-20' OR strftime(ts, '%m-%d') <= '01-10' AS over_new_year, strftime(ts, '%Y-%m-%d') AS day_key FROM events")
def _(spark, d):
    day = F.to_date("ts")
    return A.read(spark, d, "events").select("event_id", S.date_matches(day, F.lit("01-05"), F.lit("01-20")).alias("in_range"), S.date_matches(day, F.lit("12-20"), F.lit("01-10")).alias("over_new_year"), F.date_format(day, "yyyy-MM-dd").alias("day_key"))


@query("fn_template", "SELECT c_custkey, replace(replace('Hi {{name}}, {{count}} left of {{goal}}', '{{name}}', c_name), '{{count}}', CAST(c_nationkey AS VARCHAR)) AS line FROM customer")
def _(spark, d):
    return A.read(spark, d, "customer").select("c_custkey", S.template(F.lit("Hi {{name}}, {{count}} left of {{goal}}"), {"name": F.col("c_name"), "count": F.col("c_nationkey")}).alias("line"))


@query("hlp_pct", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 0.0 ELSE least(100.0, c_custkey * 100.0::DOUBLE / c_nationkey) END AS pct FROM customer")
def _(spark, d):
    return A.read(spark, d, "customer").select("c_custkey", S.percent(F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("double")).alias("pct"))


@query("io_dedupe_id", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def _(spark, d):
    return facts.first_writes(A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")


# Streams, drained to the end of their input


@query("st_progress", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    return state.drain(state.daily_progress(state.events(spark, d)), "update", ["user_id", "day"])


@query("st_deletions", "SELECT user_id, event_type, (array_agg(event_id ORDER BY ts, event_id))[1] AS event_id FROM events GROUP BY 1, 2")
def _(spark, d):
    return state.drain(state.first_deletions(state.events(spark, d)), "update", ["user_id", "event_type"])


@query("st_last_verdicts", "SELECT user_id, (array_agg(event_id ORDER BY ts DESC, event_id DESC, event_type DESC))[1] AS event_id, (array_agg(event_type ORDER BY ts DESC, event_id DESC, event_type DESC))[1] AS status FROM events GROUP BY 1")
def _(spark, d):
    return state.drain(state.last_verdicts(state.events(spark, d)), "update", ["user_id"])


@query("st_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def _(spark, d):
    return state.drain(state.sessions(state.events(spark, d)), "append").select("user_id", F.unix_millis("start").alias("start_ms"), "n")


def refuse_sevenths(key: str, ids: list[int]) -> None:
    """A service that refuses a batch with an id that seven divides."""
    if any(i % 7 == 0 for i in ids):
        raise ValueError("refused")


_SENT = "SELECT event_type AS key, event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'refused' ELSE 'filed' END AS outcome FROM events"


@query("st_batch_split", _SENT)
def _(spark, d):
    return state.send(A.read(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("id")), refuse_sevenths)


@query("st_sweep", _SENT)
def _(spark, d):
    requests, ledger = state.events(spark, d).select(F.col("event_type").alias("key"), F.col("event_id").alias("id")), f"{checkpoint_root(spark)}/ledger-{uuid.uuid4().hex}"
    state.sweep(requests, refuse_sevenths, ledger, availableNow=True).start().awaitTermination()
    return state.outcomes(spark, ledger).select("key", "id", "outcome")


@query("lim_low_water")
def _(spark, d):
    return state.drain(state.low_water(state.events(spark, d), 10.0, 60.0), "append")


# Vector kernels


GRID = "list_transform(embedding, lambda x: floor((CAST(x AS DOUBLE) + 1) * 127.5))"


def _grids(spark, d):
    return A.read(spark, d, "embeddings").select("vec_id", "label", vectors.grid(F.col("embedding")).alias("g"))


def _grid_pairs(spark, d):
    a = _grids(spark, d)
    return a.toDF("vec_id", "label", "ga").join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("gb")), "vec_id")


_SHIFTED = "least(" + ", ".join(f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN i % 8 + ({dx}) BETWEEN 0 AND 7 THEN abs(a.g[i + 1] - b.g[i + 1 + ({dx})]) ELSE 0 END)) / {8.0 * (8 - abs(dx))}" for dx in range(-2, 3)) + ")"
_JITTER = "least(" + ", ".join(f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN i % 8 + ({dx}) BETWEEN 0 AND 7 AND i // 8 + ({dy}) BETWEEN 0 AND 7 THEN abs((a.g[i + 1] - a.m) - (b.g[i + 1 + ({dx}) + 8 * ({dy})] - b.m)) ELSE 0 END)) / {float((8 - abs(dx)) * (8 - abs(dy)))}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + ")"


@query("vec_aligned", f"WITH g AS (SELECT vec_id, {GRID} AS g FROM embeddings) SELECT a.vec_id, round({_SHIFTED}, 6) AS distance FROM g a JOIN g b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    return _grid_pairs(spark, d).select("vec_id", F.round(vectors.aligned_distance(F.col("ga"), F.col("gb")), 6).alias("distance"))


@query("vec_mad", f"WITH g AS (SELECT vec_id, {GRID} AS g FROM embeddings), m AS (SELECT *, list_sum(g) / 64.0 AS m FROM g) SELECT a.vec_id, floor({_JITTER} + 0.5) AS mad FROM m a JOIN m b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    return _grid_pairs(spark, d).select("vec_id", vectors.signature_distance(F.col("ga"), F.col("gb")).alias("mad"))


@query("vec_reduce", f"WITH g AS (SELECT vec_id, {GRID} AS g FROM embeddings) SELECT vec_id, k AS cell, CAST(floor((g[k // 4 * 16 + k % 4 * 2 + 1] + g[k // 4 * 16 + k % 4 * 2 + 2] + g[k // 4 * 16 + k % 4 * 2 + 9] + g[k // 4 * 16 + k % 4 * 2 + 10]) / 4) AS BIGINT) AS mean FROM g, range(0, 16) r(k)")
def _(spark, d):
    return _grids(spark, d).select("vec_id", F.posexplode(vectors.box_means(F.col("g"), 8, 2)).alias("cell", "mean")).select("vec_id", F.col("cell").cast("long").alias("cell"), "mean")


@query("vec_hamming", f"SELECT a.vec_id, CAST({HAM.format(a='a', b='b')} AS BIGINT) AS bits, CAST(bit_count(xor(a.lo, b.lo)) AS BIGINT) AS low_bits FROM hashes a JOIN hashes b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    h = A.hashes(spark, d)
    b = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    bits = sequences.hamming(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2")).cast("long")
    return h.join(b, "vec_id").select("vec_id", bits.alias("bits"), F.bit_count(F.col("lo").bitwiseXOR(F.col("lo2"))).cast("long").alias("low_bits"))


@query("join_nearest", f"WITH p AS (SELECT a.vec_id, b.vec_id AS other, {HAM.format(a='a', b='b')} AS bits FROM hashes a JOIN hashes b ON a.label = b.label AND b.vec_id % 2 = 1 WHERE a.vec_id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY bits, other) AS k FROM p) SELECT vec_id, other, CAST(bits AS BIGINT) AS bits FROM r WHERE k = 1")
def _(spark, d):
    h = A.hashes(spark, d)
    return vectors.nearest_hashes(h.where("vec_id % 2 = 0"), h.where("vec_id % 2 = 1"), "label").toDF("vec_id", "other", "bits")


# More joins and sets


@query("join_frame_set", "SELECT asset_id, max(group_id) AS group_id FROM members GROUP BY 1")
def _(spark, d):
    return A.members(spark, d).groupBy("asset_id").agg(F.max("group_id").alias("group_id"))


@query("join_forget_merges", "SELECT asset_id FROM meta WHERE asset_id NOT IN (SELECT original_id FROM listing WHERE original_id IS NOT NULL)")
def _(spark, d):
    gone = A.listing(spark, d).where("original_id is not null").select(F.col("original_id").alias("asset_id"))
    return tables.delete(A.meta(spark, d).select("asset_id"), gone, ["asset_id"])


@query("join_decided", "SELECT id, album, coalesce(status, 'backlog') AS status FROM listing l LEFT JOIN verdicts v ON v.asset_id = l.id WHERE original_id IS NULL")
def _(spark, d):
    live = A.listing(spark, d).where("original_id is null")
    return live.join(A.verdicts(spark, d).withColumnRenamed("asset_id", "id"), "id", "left").select("id", "album", F.coalesce("status", F.lit("backlog")).alias("status"))


@query("clu_mixed", "WITH b AS (SELECT DISTINCT asset_id FROM members WHERE group_id % 300 = 0) SELECT group_id, count(*) AS n FROM members WHERE group_id % 300 <> 0 GROUP BY 1 HAVING NOT bool_or(asset_id IN (SELECT asset_id FROM b))")
def _(spark, d):
    members = A.members(spark, d)
    bursts, panos = members.where("group_id % 300 = 0"), members.where("group_id % 300 <> 0")
    hit = panos.join(bursts.select("asset_id"), "asset_id", "left_semi").select("group_id").distinct()
    return panos.join(hit, "group_id", "left_anti").groupBy("group_id").agg(F.count("*").alias("n"))


@query("clu_merge_sets")
def _(spark, d):
    m = A.members(spark, d).select("group_id", "asset_id")
    first = m.groupBy("asset_id").agg(F.min("group_id").alias("b"))
    return lineage.components(m.join(first, "asset_id").select(F.col("group_id").alias("a"), "b"))


@query("mat_drift", "WITH p AS (SELECT asset_id, ms - lag(ms) OVER (PARTITION BY album_id ORDER BY ms NULLS FIRST, asset_id) AS gap FROM assets) SELECT asset_id, coalesce(abs(gap - 1000), 9007199254740991) AS drift FROM p")
def _(spark, d):
    gap = F.col("ms") - F.lag("ms").over(Window.partitionBy("album_id").orderBy(F.col("ms").asc_nulls_first(), "asset_id"))
    return A.assets(spark, d).select("asset_id", F.coalesce(F.abs(gap - 1000), F.lit(9007199254740991)).alias("drift"))


@query("smp_milestone", "SELECT c_custkey, CAST(floor(c_custkey / 250) * 250 AS BIGINT) AS step, list_max(list_filter([10, 50, 100, 500, 1000], lambda x: x <= c_custkey)) AS rung FROM customer")
def _(spark, d):
    n = F.col("c_custkey")
    rungs = F.array(*map(F.lit, (10, 50, 100, 500, 1000)))
    return A.read(spark, d, "customer").select("c_custkey", (F.floor(n / 250) * 250).cast("long").alias("step"), F.array_max(F.filter(rungs, lambda x: x <= n)).alias("rung"))


@query("lim_drop_album", "SELECT asset_id FROM meta WHERE album IS NULL OR album NOT IN ('src1', 'src2')")
def _(spark, d):
    return A.meta(spark, d).join(spark.createDataFrame([("src1",), ("src2",)], "album string"), "album", "left_anti").select("asset_id")


@query("st_edit_verdict", "SELECT n.id, CASE WHEN o.updated IS NULL THEN 'unknown' WHEN o.updated = n.updated THEN 'untouched' WHEN n.id % 2 = 0 THEN 'edited' ELSE 'touched' END AS state FROM new_snapshot n LEFT JOIN old_snapshot o USING (id)")
def _(spark, d):
    old, new = A.snapshots(spark, d)
    return lineage.edit_states(old.withColumn("hash", F.lit("a")), new.withColumn("hash", F.when(F.col("id") % 2 == 0, "b").otherwise("a")))


@query("st_forget_baseline", "SELECT id, updated FROM old_snapshot WHERE id IN (SELECT id FROM new_snapshot)")
def _(spark, d):
    old, new = A.snapshots(spark, d)
    return tables.keep_only(old, new, ["id"])


# Mutations


@query("dml_save_only", "SELECT asset_id, status, CASE WHEN asset_id % 2 = 0 THEN true ELSE save_only END AS save_only FROM verdicts")
def _(spark, d):
    changes = A.meta(spark, d).where("asset_id % 2 = 0").select("asset_id", F.lit(True).alias("save_only"))
    return tables.update_existing(A.verdicts(spark, d), changes, ["asset_id"], "save_only").select("asset_id", "status", "save_only")


@query("dml_reverdict", "SELECT asset_id, CASE WHEN status = 'maybe' THEN 'kept' ELSE status END AS status, starred, save_only FROM verdicts")
def _(spark, d):
    verdicts = A.verdicts(spark, d)
    return tables.upsert(verdicts, verdicts.where("status = 'maybe'").withColumn("status", F.lit("kept")), ["asset_id"])


@query("dml_partner", "WITH l AS (SELECT c_custkey AS left_id, c_custkey * 7 % 1009 AS right_id FROM customer WHERE c_custkey % 3 = 0), c AS (SELECT c_custkey AS left_id, c_custkey + 1 AS right_id FROM customer WHERE c_custkey % 30 = 0) SELECT * FROM l WHERE left_id NOT IN (SELECT left_id FROM c) AND right_id NOT IN (SELECT right_id FROM c) UNION ALL SELECT * FROM c")
def _(spark, d):
    key = F.col("c_custkey")
    customers = A.read(spark, d, "customer")
    links = customers.where("c_custkey % 3 = 0").select(key.alias("left_id"), (key * 7 % 1009).alias("right_id"))
    return tables.partner_links(links, customers.where("c_custkey % 30 = 0").select(key.alias("left_id"), (key + 1).alias("right_id")))


@query("dml_note_contents", "SELECT album, count(*) FILTER (original_id IS NULL) AS live, count(*) FILTER (original_id IS NOT NULL) AS deleted FROM listing GROUP BY 1")
def _(spark, d):
    return A.listing(spark, d).groupBy("album").agg(F.count_if(F.col("original_id").isNull()).alias("live"), F.count_if(F.col("original_id").isNotNull()).alias("deleted"))


@query("dml_session_pick", "SELECT user_id, CAST(ts AS DATE) AS day, (array_agg(event_id ORDER BY md5('s5:' || CAST(event_id AS VARCHAR)), event_id))[1] AS pick FROM events GROUP BY 1, 2")
def _(spark, d):
    e = A.read(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.struct(selection.draw("s5", F.col("event_id")), "event_id").alias("draw"))
    return e.groupBy("user_id", "day").agg(F.min("draw").getField("event_id").alias("pick"))


@query("st_session_picks", "SELECT user_id AS owner, strftime(ts, '%Y-%m-%d') AS session, (array_agg(event_id ORDER BY md5('s5:' || CAST(event_id AS VARCHAR)), event_id))[1] AS item FROM events GROUP BY 1, 2")
def _(spark, d):
    asked = state.events(spark, d).select(F.col("user_id").alias("owner"), F.date_format("ts", "yyyy-MM-dd").alias("session"), F.col("event_id").alias("item"), selection.draw("s5", F.col("event_id")).alias("draw"))
    with state.keyed_state(spark):
        return state.drain(state.session_picks(asked), "update", ["owner", "session"], once=True).select("owner", "session", "item")


@query("hlp_album_search", "SELECT DISTINCT album FROM meta WHERE contains(lower(album), 'c1') AND album NOT IN ('src11')")
def _(spark, d):
    found = A.meta(spark, d).select("album").distinct().where(F.contains(F.lower("album"), F.lit("c1")))
    return found.join(spark.createDataFrame([("src11",)], "album string"), "album", "left_anti")


@query("io_json_guard", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    guarded = F.concat(F.lit("while(1){}"), F.col("props"))
    return A.read(spark, d, "events").select("event_id", F.get_json_object(S.json_guard(guarded), "$.k").alias("k"))


@query("fn_units", "SELECT asset_id, contains('pano:' || name, ':') AS is_unit, 'burst:' || name AS retyped, CASE WHEN regexp_matches(name, '(?i)-hdr(-[0-9]+)?\\.[^.]+$') THEN 'HDR' WHEN regexp_matches(name, '(?i)-hdr-pano') THEN 'HDR panorama' END AS kind FROM meta")
def _(spark, d):
    unit = F.concat(F.lit("pano:burst:pano:"), F.col("name"))
    return A.meta(spark, d).select("asset_id", S.is_unit(unit).alias("is_unit"), S.retyped(unit, "burst").alias("retyped"), S.merge_kind(S.file_stem(F.col("name"))).alias("kind"))


@query("fn_times", "WITH t AS (SELECT event_id, CAST(event_id % 30 AS VARCHAR) || ':' || lpad(CAST(event_id % 70 AS VARCHAR), 2, '0') AS t FROM events) SELECT event_id, CASE WHEN event_id % 30 <= 23 AND event_id % 70 <= 59 THEN CAST(event_id % 30 * 60 + event_id % 70 AS BIGINT) END AS minute FROM t")
def _(spark, d):
    n = F.col("event_id")
    text = F.concat((n % 30).cast("string"), F.lit(":"), F.lpad((n % 70).cast("string"), 2, "0"))
    return A.read(spark, d, "events").select("event_id", S.time_of_day(text).cast("long").alias("minute"))
