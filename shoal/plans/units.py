"""Queries over review units, shot sets and decks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoal.functions import scalar as S
from shoal.operators import lineage, tables, units
from shoal.plans.catalog import STEM, query
from shoal.sources import adapters as A

BASE = f"named AS (SELECT album_id, asset_id, pos, lower({STEM}) AS stem FROM shots), based AS (SELECT *, regexp_replace(stem, '-(enhanced-nr|enhanced|edit)$', '') AS base FROM named), roots AS (SELECT album_id, stem, arg_max(asset_id, pos) AS original_id FROM based WHERE base = stem GROUP BY 1, 2), pairs AS (SELECT b.album_id, b.asset_id, r.original_id FROM based b JOIN roots r ON r.album_id = b.album_id AND r.stem = b.base WHERE b.base <> b.stem)"
BUILT = f"""{BASE}, held AS (SELECT g.*, s.ms FROM shot_groups g JOIN shots s USING (album_id, asset_id) WHERE (album_id, asset_id) NOT IN (SELECT (album_id, asset_id) FROM pairs)),
grouped AS (SELECT group_id, type, album_id, array_agg(asset_id ORDER BY g.pos, asset_id) AS members, min(ms) AS taken FROM held g GROUP BY 1, 2, 3 HAVING count(DISTINCT asset_id) >= 2),
used AS (SELECT DISTINCT album_id, unnest(members) AS asset_id FROM grouped),
free AS (SELECT s.album_id, s.asset_id, s.ms, p.original_id, CASE WHEN s.asset_id % 23 = 0 THEN 'right' END AS missing, EXISTS (SELECT 1 FROM pairs q WHERE q.album_id = s.album_id AND q.original_id = s.asset_id AND (q.album_id, q.asset_id) NOT IN (SELECT (album_id, asset_id) FROM used)) AS replaced FROM shots s LEFT JOIN (SELECT * FROM pairs WHERE (album_id, original_id) NOT IN (SELECT (album_id, asset_id) FROM used)) p ON p.album_id = s.album_id AND p.asset_id = s.asset_id WHERE (s.album_id, s.asset_id) NOT IN (SELECT (album_id, asset_id) FROM used)),
units AS (SELECT type || ':' || album_id || ':' || members[1] AS unit_id, type AS kind, album_id, len(members) AS n, taken, NULL::BIGINT AS original_id, members FROM grouped
UNION ALL SELECT CASE WHEN missing IS NOT NULL THEN 'stereo-gap:' ELSE '' END || asset_id, CASE WHEN missing IS NOT NULL THEN 'incomplete' WHEN original_id IS NOT NULL THEN 'edit' ELSE 'photo' END, album_id, 1, ms, CASE WHEN missing IS NULL THEN original_id END, [asset_id] FROM free WHERE missing IS NOT NULL OR original_id IS NOT NULL OR NOT replaced)"""
HELD = "holds AS (SELECT unit_id, kind, album_id, unnest(CASE WHEN kind = 'edit' THEN members || [original_id] ELSE members END) AS asset_id FROM units)"


def gaps(spark, d):
    return A.shots(spark, d).where("asset_id % 23 = 0").select("asset_id", F.lit("right").alias("missing"))


def built(spark, d):
    return units.build(A.shots(spark, d).withColumn("ord", F.col("pos")), A.shot_groups(spark, d), gaps(spark, d))


@query("smp_units_build", f"WITH {BUILT} SELECT unit_id, kind, album_id, n, taken, original_id FROM units")
def _(spark, d):
    return built(spark, d).select("unit_id", "kind", "album_id", F.col("n").cast("long").alias("n"), "taken", "original_id")


@query("fn_unit_ids", f"WITH {BUILT}, {HELD} SELECT unit_id, album_id, asset_id FROM holds")
def _(spark, d):
    return units.unit_members(built(spark, d))


@query("hlp_unit_holds", f"WITH {BUILT}, {HELD}, ids AS (SELECT asset_id FROM shots WHERE asset_id % 10 = 3) SELECT DISTINCT unit_id, i.asset_id FROM units u JOIN ids i ON u.unit_id = CAST(i.asset_id AS VARCHAR) UNION SELECT unit_id, asset_id FROM holds WHERE kind IN ('burst', 'pano', 'stereo', 'incomplete') AND asset_id IN (SELECT asset_id FROM ids)")
def _(spark, d):
    return units.holders(built(spark, d), A.shots(spark, d).where("asset_id % 10 = 3"))


@query("hlp_incomplete", f"WITH {BUILT} SELECT unit_id, album_id, 'Stereo pair · right eye missing' AS name, members[1] AS left_frame FROM units WHERE kind = 'incomplete'")
def _(spark, d):
    found = built(spark, d).where("kind = 'incomplete'").join(gaps(spark, d).withColumnRenamed("asset_id", "own"), F.col("members")[0] == F.col("own"))
    return found.select("unit_id", "album_id", S.gap_label(F.col("missing")).alias("name"), F.when(F.col("missing") != "left", F.col("members")[0]).alias("left_frame"))


@query("dml_gap_settle", f"WITH {BUILT} SELECT unit_id AS asset_id, 'kept' AS status, false AS starred, false AS save_only FROM units WHERE kind = 'incomplete' UNION ALL SELECT CAST(members[1] AS VARCHAR), 'kept', false, false FROM units WHERE kind = 'incomplete'")
def _(spark, d):
    halves = built(spark, d).where("kind = 'incomplete'").select("unit_id", F.transform("members", lambda x: x.cast("string")).alias("members"))
    return units.settle(halves, "kept")


@query("fn_frame_to_photo", f"WITH {BUILT} SELECT m.asset_id, {STEM} AS name, s.album_id AS album, m.taken, 'backlog' AS status, false AS starred, false AS save_only FROM (SELECT unit_id, taken, album_id, unnest(members) AS asset_id FROM units WHERE kind = 'burst') m JOIN shots s USING (album_id, asset_id)")
def _(spark, d):
    return units.frames_to_photos(built(spark, d).where("kind = 'burst'"), A.shots(spark, d))


@query("fn_to_pano", f"WITH {BUILT} SELECT 'pano:' || substr(unit_id, 7) AS unit_id, 'Panorama · ' || n || ' frames' AS name, 'horizontal' AS orientation FROM units WHERE kind = 'burst' UNION ALL SELECT 'burst:' || substr(unit_id, 6), 'Burst · ' || n || ' frames', NULL FROM units WHERE kind = 'pano'")
def _(spark, d):
    both = built(spark, d).where("kind in ('burst', 'pano')")
    return both.select(F.when(F.col("kind") == "burst", S.retyped(F.col("unit_id"), "pano")).otherwise(S.retyped(F.col("unit_id"), "burst")).alias("unit_id"), S.unit_name(F.when(F.col("kind") == "burst", "pano").otherwise("burst"), F.col("n")).alias("name"), F.when(F.col("kind") == "burst", "horizontal").alias("orientation"))


@query("smp_units")
def _(spark, d):
    return units.select_units(built(spark, d), F.when(F.col("album_id") % 4 == 0, 3).otherwise(1), 200, 4, "s3").select("unit_id", "album_id", "place")


@query("lim_buffer_fill")
def _(spark, d):
    drawn = units.select_units(built(spark, d), F.lit(1), 200, 4, "s7")
    shown = A.shots(spark, d).where("asset_id % 19 = 0")
    return units.buffer_fill(drawn, A.shot_verdicts(spark, d), shown, 40).select("unit_id", "place")


@query("smp_server_feed", "WITH k AS (SELECT asset_id, album_id, row_number() OVER (PARTITION BY album_id ORDER BY md5('s8:' || asset_id), asset_id) AS k FROM shots WHERE album_id IS NOT NULL) SELECT asset_id, md5('s8:all:' || asset_id) AS place FROM k WHERE k <= CASE WHEN album_id % 4 = 0 THEN 9 ELSE 3 END ORDER BY place LIMIT 60")
def _(spark, d):
    return units.server_feed(A.shots(spark, d), F.when(F.col("album_id") % 4 == 0, 3).otherwise(1), 60, 3, "s8")


@query("agg_gather", "WITH l AS (SELECT asset_id, max(group_id) AS group_id FROM shot_groups GROUP BY 1), k AS (SELECT s.asset_id, s.asset_id AS ord, coalesce(group_id, '#' || s.asset_id) AS key FROM shots s LEFT JOIN l USING (asset_id)) SELECT asset_id, min(ord) OVER (PARTITION BY key) AS unit_ord, row_number() OVER (PARTITION BY key ORDER BY ord) AS place FROM k")
def _(spark, d):
    return units.gather_by_set(A.shots(spark, d).select("asset_id", F.col("asset_id").alias("ord")), A.shot_groups(spark, d))


_SETS = f"""named AS (SELECT asset_id, album_id, pos, album_id || '/' || lower({STEM}) AS stem FROM shots), src AS (SELECT asset_id, regexp_replace(stem, '-(enhanced-nr|enhanced|edit)$', '') AS s FROM named WHERE regexp_matches(stem, '-(enhanced-nr|enhanced|edit)$')),
own AS (SELECT stem, max(asset_id) AS b FROM named GROUP BY 1), links AS (SELECT group_id || 'g' AS key, asset_id FROM shot_groups UNION ALL SELECT (asset_id // 40) || 'm', asset_id FROM shots WHERE asset_id % 20 = 7), heads AS (SELECT key, min(asset_id) AS b FROM links GROUP BY 1),
e AS (SELECT asset_id AS a, b FROM links JOIN heads USING (key) UNION SELECT asset_id, b FROM src JOIN own ON own.stem = src.s), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen), c AS (SELECT node, min(seen) AS set_id FROM r GROUP BY 1)"""


def sets(spark, d):
    names = A.shots(spark, d).select("asset_id", F.concat_ws("/", F.col("album_id").cast("string"), S.file_stem(F.col("name"))).alias("stem"), F.col("asset_id").alias("ord"))
    merges = A.shots(spark, d).where("asset_id % 20 = 7").select(F.floor(F.col("asset_id") / 40).alias("key"), "asset_id")
    return units.shot_sets(names, A.shot_groups(spark, d).select(F.col("group_id").alias("key"), "asset_id"), merges)


@query("clu_shot_sets", f"WITH {_SETS} SELECT asset_id, coalesce(set_id, asset_id) AS set_id FROM shots LEFT JOIN c ON node = asset_id")
def _(spark, d):
    return sets(spark, d)


@query("lim_tag_queue", f"WITH {_SETS}, s AS (SELECT asset_id, coalesce(set_id, asset_id) AS set_id FROM shots LEFT JOIN c ON node = asset_id), t AS (SELECT DISTINCT set_id FROM s WHERE asset_id % 9 = 0) SELECT set_id, max(asset_id) AS asset_id FROM s JOIN shot_verdicts v USING (asset_id) WHERE v.status IN ('kept', 'toPrint') AND set_id NOT IN (SELECT set_id FROM t) GROUP BY 1")
def _(spark, d):
    return units.tag_queue(sets(spark, d), A.shot_verdicts(spark, d), A.shots(spark, d).where("asset_id % 9 = 0"))


_DECK = f"{BUILT}, {HELD}, deck AS (SELECT album_id AS deck_id, row_number() OVER (PARTITION BY album_id ORDER BY unit_id) - 1 AS pos, unit_id, kind, members, CASE WHEN kind = 'edit' THEN members || [original_id] ELSE members END AS assets FROM units)"


def deck(spark, d):
    w = Window.partitionBy("album_id").orderBy("unit_id")
    held = units.asset_ids(F.col("kind"), F.col("members"), F.col("original_id"))
    return built(spark, d).select(F.col("album_id").alias("deck_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), "unit_id", "kind", "members", held.alias("assets"))


@query("dml_assemble", f"WITH {_DECK}, cur AS (SELECT deck_id, arg_min(unit_id, pos) AS current, arg_min(members, pos) AS m FROM deck WHERE kind = 'pano' GROUP BY 1), nxt AS (SELECT deck_id, arg_min(members, pos) AS m2 FROM deck WHERE kind = 'photo' GROUP BY 1), ch AS (SELECT deck_id, current, m || coalesce(m2, []) AS frames FROM cur LEFT JOIN nxt USING (deck_id)) SELECT deck_id, row_number() OVER (PARTITION BY deck_id ORDER BY pos) - 1 AS pos, CASE WHEN unit_id = current THEN 'burst:' || substr(unit_id, 6) ELSE unit_id END AS unit_id FROM deck LEFT JOIN ch USING (deck_id) WHERE current IS NULL OR unit_id = current OR NOT list_has_any(assets, frames)")
def _(spark, d):
    all_, chosen = _assembled(spark, d)
    return units.assemble(all_.select("deck_id", "pos", "unit_id", "assets"), chosen, "burst").drop("assets")


def _assembled(spark, d):
    """Decks, and for each the frames of its first panorama and first photo, put together by hand."""
    all_ = deck(spark, d)
    current = all_.where("kind = 'pano'").groupBy("deck_id").agg(F.min_by("unit_id", "pos").alias("unit_id"), F.min_by("members", "pos").alias("m"))
    other = all_.where("kind = 'photo'").groupBy("deck_id").agg(F.min_by("members", "pos").alias("m2"))
    chosen = current.join(other, "deck_id", "left").select("deck_id", "unit_id", F.concat("m", F.coalesce("m2", F.array().cast("array<long>"))).alias("frames"))
    return all_, chosen


@query("dml_assemble_records", f"WITH {_DECK}, cur AS (SELECT deck_id, arg_min(unit_id, pos) AS current, arg_min(members, pos) AS m FROM deck WHERE kind = 'pano' GROUP BY 1), nxt AS (SELECT deck_id, arg_min(members, pos) AS m2 FROM deck WHERE kind = 'photo' GROUP BY 1), ch AS (SELECT deck_id, current, m || coalesce(m2, []) AS frames FROM cur LEFT JOIN nxt USING (deck_id)), r AS (SELECT deck_id, unit_id, assets, current, frames FROM deck JOIN ch USING (deck_id)) SELECT deck_id, 'members' AS record, unit_id, len(assets) AS detected, CAST(list_sum(frames) AS BIGINT) AS frames, NULL AS type FROM r WHERE unit_id = current UNION ALL SELECT deck_id, 'type', unit_id, len(assets), NULL, 'burst' FROM r WHERE unit_id = current UNION ALL SELECT deck_id, 'dissolved', unit_id, len(assets), NULL, NULL FROM r WHERE unit_id <> current AND list_has_any(assets, frames)")
def _(spark, d):
    all_, chosen = _assembled(spark, d)
    records = units.assembly_records(all_.select("deck_id", "unit_id", "assets"), chosen, "burst")
    total = F.when(F.size("frames") > 0, F.aggregate("frames", F.lit(0).cast("long"), lambda s, x: s + x))
    return records.select("deck_id", "record", "unit_id", F.size("detected").cast("long").alias("detected"), total.alias("frames"), "type")


@query("win_bring_back", f"WITH {_DECK}, b AS (SELECT deck_id, arg_max(unit_id, pos) AS back, arg_max(assets, pos) AS own, 2 AS idx, deck_id % 2 = 0 AS place FROM deck GROUP BY 1), x AS (SELECT d.deck_id, unit_id, back, idx, place, row_number() OVER (PARTITION BY d.deck_id ORDER BY pos) - 1 AS i FROM deck d JOIN b USING (deck_id) WHERE (unit_id = back OR NOT list_has_any(assets, own)) AND (deck_id % 3 <> 0 OR unit_id <> back)), y AS (SELECT *, max(CASE WHEN unit_id = back THEN i END) OVER (PARTITION BY deck_id) AS spot, count(*) OVER (PARTITION BY deck_id) AS n FROM x), z AS (SELECT deck_id, unit_id, CASE WHEN NOT (place AND spot IS NOT NULL) AND i > spot THEN i - 1.0::DOUBLE ELSE i::DOUBLE END AS k FROM y WHERE (place AND spot IS NOT NULL) OR unit_id <> back UNION ALL SELECT b.deck_id, b.back, least(CASE WHEN spot < b.idx THEN b.idx - 1 ELSE b.idx END, coalesce(n, 0) - CASE WHEN spot IS NULL THEN 0 ELSE 1 END) - 0.5::DOUBLE FROM b LEFT JOIN (SELECT DISTINCT deck_id, spot, n FROM y) m USING (deck_id) WHERE NOT (b.place AND spot IS NOT NULL)) SELECT deck_id, row_number() OVER (PARTITION BY deck_id ORDER BY k) - 1 AS pos, unit_id FROM z")
def _(spark, d):
    all_ = deck(spark, d)
    back = all_.groupBy("deck_id").agg(F.max_by("unit_id", "pos").alias("unit_id"), F.max_by("assets", "pos").alias("assets"))
    left = all_.join(back.select("deck_id", F.col("unit_id").alias("gone")), "deck_id").where("deck_id % 3 <> 0 or unit_id <> gone").drop("gone")
    return units.bring_back(left.select("deck_id", "pos", "unit_id", "assets"), back, F.lit(2), F.col("deck_id") % 2 == 0)


@query("dml_undo", "WITH prior AS (SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN NULL ELSE 'maybe' END AS status FROM shots WHERE asset_id % 6 = 0) SELECT asset_id, status, starred, save_only FROM shot_verdicts WHERE asset_id NOT IN (SELECT asset_id FROM prior) UNION ALL SELECT asset_id, status, false, false FROM prior WHERE status IS NOT NULL")
def _(spark, d):
    n = F.col("asset_id")
    prior = A.shots(spark, d).where(n % 6 == 0).select("asset_id", F.when(n % 4 != 0, "maybe").alias("status"), F.lit(False).alias("starred"), F.lit(False).alias("save_only"))
    return units.undo(A.shot_verdicts(spark, d), prior)


_UNDO = "event_id % 5 IN (2, 4)"


@query("dml_undo_log", f"WITH a AS (SELECT user_id, list([event_id] ORDER BY event_id) AS l FROM events GROUP BY 1), s AS (SELECT user_id, unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), l), lambda s, e: CASE WHEN {_UNDO.replace('event_id', 'e[1]')} THEN s[:-2] ELSE s || e END)) AS event_id FROM a), c AS (SELECT user_id, event_id % 9 AS slot, arg_max(event_type, event_id) AS status FROM s JOIN events USING (user_id, event_id) GROUP BY 1, 2), i AS (SELECT DISTINCT user_id, slot, 'new' AS status FROM events, range(0, 9) r(slot)) SELECT i.user_id, CAST(i.slot AS BIGINT) AS slot, coalesce(c.status, i.status) AS status FROM i LEFT JOIN c USING (user_id, slot) WHERE coalesce(c.status, '') <> 'view'")
def _(spark, d):
    e = A.read(spark, d, "events").select("user_id", "event_id", F.expr(_UNDO).alias("undo"), "event_type")
    initial = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("slot"), F.lit("new").alias("status"))
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("slot").cast("string")).alias("key")
    changes = tables.standing(e, "user_id", "event_id", "undo").select("user_id", (F.col("event_id") % 9).alias("slot"), "event_id", F.col("event_type").alias("status"), (F.col("event_type") == "view").alias("gone"))
    return tables.replayed(initial.select("*", key), changes.select("*", key), "key", "event_id", "gone").select("user_id", "slot", "status")


_WINDOW = """{mine}, dec AS (SELECT asset_id FROM shot_verdicts WHERE status <> 'backlog'),
r AS (SELECT s.album_id, s.asset_id, m.asset_id IS NOT NULL AS own, row_number() OVER (PARTITION BY s.album_id ORDER BY ms NULLS FIRST, s.asset_id) AS rk FROM shots s LEFT JOIN mine m USING (album_id, asset_id) WHERE m.asset_id IS NOT NULL OR s.asset_id NOT IN (SELECT asset_id FROM dec)),
iv AS (SELECT album_id, min(rk) - {reach} AS a, max(rk) + {reach} AS z, true AS own FROM r WHERE own GROUP BY 1 UNION ALL SELECT album_id, a, z, false FROM (SELECT g.album_id, group_id, count(*) AS n, count(rk) AS k, count(*) FILTER (own) AS o, min(rk) AS a, max(rk) AS z FROM shot_groups g LEFT JOIN r USING (album_id, asset_id) GROUP BY 1, 2) WHERE n = k AND o = 0),
grown AS (SELECT album_id, a, z FROM iv WHERE own UNION SELECT g.album_id, least(g.a, iv.a), greatest(g.z, iv.z) FROM grown g JOIN iv ON iv.album_id = g.album_id AND iv.a <= g.z AND iv.z >= g.a), wide AS (SELECT album_id, min(a) AS a, max(z) AS z FROM grown GROUP BY 1) SELECT r.album_id, r.asset_id, own AS mine FROM r JOIN wide USING (album_id) WHERE rk BETWEEN a AND z"""
_FIRST_PANO = "mine AS (SELECT album_id, asset_id FROM (SELECT *, min(group_id) OVER (PARTITION BY album_id) AS f FROM shot_groups WHERE type = 'pano') WHERE group_id = f)"


@query("win_candidate_frames", f"WITH {_WINDOW.format(mine='mine AS (SELECT album_id, min(asset_id) AS asset_id FROM shots WHERE pos % 7 = 5 GROUP BY 1)', reach=6)}")
def _(spark, d):
    some = A.shots(spark, d).where("pos % 7 = 5").groupBy("album_id").agg(F.min("asset_id").alias("asset_id"))
    return units.candidate_window(some, A.shots(spark, d), A.shot_verdicts(spark, d), A.shot_groups(spark, d), 6)


@query("hlp_pano_candidates", f"WITH {_WINDOW.format(mine=_FIRST_PANO, reach=3)}")
def _(spark, d):
    groups = A.shot_groups(spark, d)
    panos = groups.where("type = 'pano'")
    first = panos.groupBy("album_id").agg(F.min("group_id").alias("group_id"))
    return units.candidate_window(panos.join(first, ["album_id", "group_id"]), A.shots(spark, d), A.shot_verdicts(spark, d), groups, 3)


@query("clu_candidates", "WITH l AS (SELECT *, lag(ms) OVER w AS p, lag(camera) OVER w AS pc FROM assets WHERE ms IS NOT NULL WINDOW w AS (PARTITION BY album_id ORDER BY ms, asset_id)), r AS (SELECT *, sum(CASE WHEN ms - p <= 10800000 AND coalesce(camera, '') = coalesce(pc, '') THEN 0 ELSE 1 END) OVER (PARTITION BY album_id ORDER BY ms, asset_id ROWS UNBOUNDED PRECEDING) AS run FROM l), n AS (SELECT album_id, asset_id, count(*) OVER (PARTITION BY album_id, run) AS n FROM r) SELECT album_id, asset_id FROM n WHERE n >= 2 AND album_id % 10 <> 0 UNION ALL SELECT album_id, asset_id FROM assets WHERE album_id % 10 = 0")
def _(spark, d):
    marked = A.assets(spark, d).select("album_id").distinct().where("album_id % 10 = 0")
    return lineage.scan_candidates(A.assets(spark, d), marked, 10_800_000, 2)
