"""Queries over eyes, stereo sets and corrected groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoal.operators import corrections, facts, lineage, sequences, stereo, units
from shoal.plans.catalog import GRID, HAM, query
from shoal.plans.units import built
from shoal.sources import adapters as A
from shoal.sources.session import materialise

FRAMES = "frames AS (SELECT *, CASE WHEN album_id % 2 = 0 THEN 's' || asset_id % 2 ELSE camera END AS serial, CASE pos % 4 WHEN 2 THEN 'L' WHEN 3 THEN 'R' END AS named FROM shots)"
SIDES = f"{FRAMES}, votes AS (SELECT album_id, serial, sum(CASE named WHEN 'L' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS score FROM frames WHERE serial <> '' GROUP BY 1, 2), pick AS (SELECT album_id, (array_agg(serial ORDER BY score DESC, serial))[1] AS l FROM votes GROUP BY 1 HAVING count(*) = 2), sides AS (SELECT album_id, serial, CASE WHEN serial = l THEN 'L' ELSE 'R' END AS eye FROM votes JOIN pick USING (album_id))"


def frames(spark, d):
    serial = F.when(F.col("album_id") % 2 == 0, F.concat(F.lit("s"), (F.col("asset_id") % 2).cast("string"))).otherwise(F.col("camera"))
    return A.shots(spark, d).withColumn("serial", serial)


@query("mat_serial_sides", f"WITH {SIDES} SELECT album_id, serial, eye FROM sides")
def _(spark, d):
    return stereo.serial_sides(frames(spark, d))


@query("mat_split_eyes", f"WITH {SIDES} SELECT asset_id, coalesce(named, eye) AS eye FROM frames LEFT JOIN sides USING (album_id, serial)")
def _(spark, d):
    return stereo.split_eyes(frames(spark, d)).select("asset_id", "eye")


def set_frames(spark, d):
    return A.shot_groups(spark, d).select("group_id", "album_id", "asset_id", "pos").join(frames(spark, d).drop("pos"), ["album_id", "asset_id"])


_SIDED = f"{FRAMES}, mem AS (SELECT g.group_id, f.* FROM shot_groups g JOIN frames f USING (album_id, asset_id)), sd AS (SELECT *, count(*) FILTER (named = 'L') OVER w AS lefts, count(*) FILTER (named = 'R') OVER w AS rights, count(*) OVER w AS n FROM mem WINDOW w AS (PARTITION BY group_id)), lf AS (SELECT *, CASE WHEN lefts > 0 THEN coalesce(named = 'L', false) ELSE coalesce(named <> 'R', true) END AS is_left FROM sd WHERE lefts + rights > 0), lk AS (SELECT *, count(*) FILTER (is_left) OVER (PARTITION BY group_id) AS k FROM lf), lid AS (SELECT group_id, asset_id FROM lk WHERE is_left AND k > 0 AND k < n)"


@query("mat_left_ids", f"WITH {_SIDED} SELECT * FROM lid")
def _(spark, d):
    return stereo.left_ids(set_frames(spark, d))


_METRES = "floor(2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2))) + 0.5)"


@query("agg_stereo_baselines", f"""WITH {_SIDED}, ch AS (SELECT DISTINCT album_id, 's1' AS chosen FROM frames WHERE album_id % 4 = 0), b AS (SELECT m.*, (m.group_id, m.asset_id) IN (SELECT (group_id, asset_id) FROM lid) AS named_left, m.group_id IN (SELECT group_id FROM lid) AS by_name, ch.chosen, row_number() OVER w AS i, first_value(lat) OVER w AS lat0, first_value(lng) OVER w AS lng0 FROM mem m LEFT JOIN ch USING (album_id) WINDOW w AS (PARTITION BY m.group_id ORDER BY m.pos, m.asset_id)),
c AS (SELECT *, CAST({_METRES} AS BIGINT) AS mt FROM b), e AS (SELECT *, bool_and(mt IS NOT NULL) OVER (PARTITION BY group_id) AS placed, max(mt) OVER (PARTITION BY group_id) AS reach, len(list_distinct(list(nullif(serial, '')) OVER (PARTITION BY group_id))) AS serials, CASE WHEN bool_or(serial = chosen) OVER (PARTITION BY group_id) THEN chosen ELSE min(nullif(serial, '')) OVER (PARTITION BY group_id) END AS rig FROM c),
f AS (SELECT *, CASE WHEN by_name THEN 'names' WHEN serials >= 2 THEN 'cameras' WHEN placed AND reach > 0 THEN 'places' ELSE 'first' END AS way FROM e), g AS (SELECT *, CASE way WHEN 'names' THEN named_left WHEN 'cameras' THEN coalesce(serial = rig, false) WHEN 'places' THEN mt = 0 ELSE i = 1 END AS lft FROM f)
SELECT group_id, asset_id, way, CASE WHEN lft THEN -1 WHEN way = 'places' THEN dense_rank() OVER (PARTITION BY group_id, lft ORDER BY mt) - 1 ELSE 0 END AS baseline, CASE WHEN way = 'places' THEN mt END AS metres FROM g""")
def _(spark, d):
    chosen = frames(spark, d).where("album_id % 4 = 0").select("album_id", F.lit("s1").alias("left_serial")).distinct()
    return stereo.baselines(set_frames(spark, d), chosen)


# Pairs of eyes

TO_FINE = "flatten(list_transform(range(0, 16), lambda y: list_transform(range(0, 16), lambda x: g[y // 2 * 8 + x // 2 + 1])))"


def fine_grids(spark, d):
    """16x16 grids, every cell of the 8x8 ones four times."""
    at = F.array(*[F.lit(y // 2 * 8 + x // 2 + 1) for y in range(16) for x in range(16)])
    return A.shot_grids(spark, d).select("asset_id", F.transform(at, lambda i: F.element_at("g", i)).alias("g"))


def _align(side, shift, a="a", b="b"):
    return "least(" + ", ".join(f"list_sum(list_transform(range(0, {side * side}), lambda i: CASE WHEN i % {side} + ({dx}) BETWEEN 0 AND {side - 1} THEN abs({a}[i + 1] - {b}[i + 1 + ({dx})]) ELSE 0 END)) / {float(side * (side - abs(dx)))}" for dx in range(-shift, shift + 1)) + ")"


ROUGH, MOST = 17.0, 17.0


@query("mat_score", f"WITH g AS (SELECT vec_id, {GRID} AS g FROM embeddings), f AS (SELECT vec_id, g, {TO_FINE} AS h FROM g), p AS (SELECT a.vec_id, {_align(8, 2, 'a.g', 'b.g')} AS rough, a.h AS ah, b.h AS bh FROM f a JOIN f b ON b.vec_id = a.vec_id + 1), s AS (SELECT vec_id, CASE WHEN rough <= {ROUGH} THEN {_align(16, 3, 'ah', 'bh')} END AS d FROM p) SELECT vec_id, round(d, 6) AS distance FROM s WHERE d <= {MOST}")
def _(spark, d):
    from shoal.operators.vectors import grid

    at = F.array(*[F.lit(y // 2 * 8 + x // 2 + 1) for y in range(16) for x in range(16)])
    fine = A.read(spark, d, "embeddings").select("vec_id", grid(F.transform(at, lambda i: F.element_at("embedding", i))).alias("g"))  # a grid within the lambda would be made for every cell
    left, right = fine.select(F.col("vec_id").alias("pair"), F.col("vec_id").alias("asset_id"), "g"), fine.select((F.col("vec_id") - 1).alias("pair"), F.col("vec_id").alias("asset_id"), "g")
    return stereo.scored_pairs(left, right, "pair", (16, 3), (8, 2), ROUGH).where(F.col("distance") <= MOST).select(F.col("left_id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def eyes(spark, d):
    """Both sides of every album, with 16x16 grids (null where a frame has none); the 8x8 ones travel, as bytes."""
    small = A.shot_grids(spark, d).select("asset_id", F.transform("g", lambda x: x.cast("short")).alias("c"))
    at = F.array(*[F.lit(y // 2 * 8 + x // 2 + 1) for y in range(16) for x in range(16)])
    fine = F.when(F.col("c").isNotNull(), F.transform(at, lambda i: F.element_at("c", i).cast("double")))
    sided = stereo.split_eyes(frames(spark, d)).join(small, "asset_id", "left").withColumn("g", fine).drop("c")
    return sided.where("eye = 'L'"), sided.where("eye = 'R'")


def large_albums(spark, d):
    return A.read(spark, d, "events").groupBy(F.col("user_id").alias("album_id")).agg(F.count("*").alias("n")).where(F.col("n") > stereo.CHUNK)


def scored(spark, d, left, right):
    return stereo.scored_pairs(left.where("g is not null"), right.where("g is not null"), "album_id", (16, 3), (8, 2), ROUGH, large_albums(spark, d))


def both_eyes(spark, d):
    left, right = eyes(spark, d)
    timed = [x.where("ms is not null").select("album_id", "ms") for x in (left, right)]
    offsets = facts.offset_vote(*timed, "album_id", 1000, 2, 0.2, 86_400_000)
    near = scored(spark, d, stereo.moved(left, offsets, "album_id"), right.withColumn("at", F.col("ms").cast("long")))
    pairs = materialise(stereo.drift(near).select("album_id", "left_id", "right_id", "distance", "drift"))
    return left, right, pairs, stereo.pair_eyes(pairs, MOST)


@query("join_eye_candidates")
def _(spark, d):
    return scored(spark, d, *eyes(spark, d)).where(F.col("distance") <= MOST).select("album_id", "left_id", "right_id", F.round("distance", 6).alias("distance"))


@query("mat_both_eyes")
def _(spark, d):
    return both_eyes(spark, d)[3].select("left_id", "right_id", F.round("distance", 6).alias("distance"))


@query("mat_report")
def _(spark, d):
    left, right, pairs, matched = both_eyes(spark, d)
    return stereo.report(left, right, "album_id", pairs, matched, MOST).withColumn("distance", F.round("distance", 6))


# Split albums

_SPLIT = """al AS (SELECT DISTINCT album_id FROM shots), roles AS (SELECT album_id, ['left', 'right', 'both'][album_id % 4 + 1] AS role FROM al WHERE album_id % 4 < 3), links AS (SELECT album_id AS l, album_id + 1 AS r FROM roles WHERE role = 'left' AND album_id % 8 = 0), done AS (SELECT album_id FROM al WHERE album_id % 3 <> 0), good AS (SELECT l, r, l IN (SELECT * FROM done) AND r IN (SELECT * FROM done) AS settled FROM links WHERE r IN (SELECT album_id FROM roles WHERE role = 'right')),
pairs AS (SELECT a.asset_id AS l, b.asset_id AS r FROM shots a JOIN good ON good.l = a.album_id JOIN shots b ON b.album_id = good.r AND b.pos = a.pos WHERE a.pos % 5 <> 0), taken AS (SELECT l AS asset_id FROM pairs UNION SELECT r FROM pairs), lk AS (SELECT l AS album_id, settled FROM good UNION ALL SELECT r, settled FROM good),
f AS (SELECT s.asset_id, role, s.album_id IN (SELECT * FROM done) AS dn, settled, s.asset_id IN (SELECT asset_id FROM taken) AS paired, s.asset_id IN (SELECT asset_id FROM shot_groups) AS held FROM shots s JOIN roles USING (album_id) LEFT JOIN lk USING (album_id)),
o AS (SELECT asset_id, role, settled, CASE WHEN role = 'both' AND held THEN 'grouped' WHEN role = 'both' AND dn THEN 'gap' WHEN role = 'both' THEN 'withheld' WHEN settled IS NULL THEN 'gap' WHEN paired THEN 'paired' WHEN settled THEN 'gap' WHEN role = 'left' THEN 'withheld' END AS outcome FROM f), res AS (SELECT asset_id, role, settled, outcome, CASE WHEN outcome = 'gap' THEN CASE role WHEN 'both' THEN 'unknown' WHEN 'left' THEN 'right' ELSE 'left' END END AS missing FROM o WHERE outcome IS NOT NULL)"""


def split(spark, d):
    shots = A.shots(spark, d)
    albums = shots.select("album_id").distinct()
    n = F.col("album_id")
    role = F.element_at(F.array(*map(F.lit, ("left", "right", "both"))), (n % 4 + 1).cast("int"))
    roles = albums.where(n % 4 < 3).select("album_id", role.alias("role"))
    links = roles.where("role = 'left' and album_id % 8 = 0").select(n.alias("left_album"), (n + 1).alias("right_album"))
    there = links.join(albums.select(n.alias("right_album")), "right_album")
    left = shots.where("pos % 5 <> 0").select(n.alias("left_album"), "pos", F.col("asset_id").alias("left_id")).join(there, "left_album")
    pairs = left.join(shots.select(n.alias("right_album"), "pos", F.col("asset_id").alias("right_id")), ["right_album", "pos"]).select("left_id", "right_id")
    out = stereo.split_albums(shots, roles, links, albums.where(n % 3 != 0), A.shot_groups(spark, d), pairs)
    return out, roles, links, pairs


@query("join_split_albums", f"WITH {_SPLIT} SELECT asset_id, outcome, missing FROM res")
def _(spark, d):
    return split(spark, d)[0]


@query("hlp_both_album", f"WITH {_SPLIT} SELECT asset_id, outcome, missing FROM res WHERE role = 'both' AND outcome <> 'grouped'")
def _(spark, d):
    out, roles, _links, _pairs = split(spark, d)
    both = A.shots(spark, d).join(roles.where("role = 'both'"), "album_id", "left_semi").select("asset_id")
    return out.join(both, "asset_id", "left_semi").where("outcome <> 'grouped'")


@query("hlp_whole_album", f"WITH {_SPLIT} SELECT asset_id, missing FROM res WHERE role <> 'both' AND settled IS NULL")
def _(spark, d):
    out, roles, links, _pairs = split(spark, d)
    linked = links.select(F.col("left_album").alias("album_id")).union(links.select("right_album"))
    alone = roles.where("role <> 'both'").join(linked, "album_id", "left_anti")
    mine = A.shots(spark, d).join(alone, "album_id", "left_semi").select("asset_id")
    return out.join(mine, "asset_id", "left_semi").select("asset_id", "missing")


# Near sets

_NEAR = f"fr AS (SELECT s.asset_id, s.album_id, a.lo, a.hi, lat, lng FROM shots s JOIN assets a USING (asset_id)), e AS (SELECT a.asset_id AS a, b.asset_id AS b FROM fr a JOIN fr b ON a.album_id = b.album_id AND a.asset_id < b.asset_id WHERE coalesce({HAM.format(a='a', b='b')} <= 22, true) AND coalesce(2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))) <= 4000, true))"
_CLOSE = "u AS (SELECT a, b FROM {e} UNION SELECT b, a FROM {e}), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen), c AS (SELECT node, min(seen) AS set_id FROM r GROUP BY 1)"


def near(spark, d):
    hashed = A.shots(spark, d).join(A.assets(spark, d).select("asset_id", "lo", "hi"), "asset_id")
    return stereo.near_sets(hashed, "album_id", 22, 4000.0)


def links(spark, d):
    hashed = A.shots(spark, d).join(A.assets(spark, d).select("asset_id", "lo", "hi"), "asset_id")
    return stereo.near_links(hashed, "album_id", 22, 4000.0)


@query("join_hamming", f"WITH {_NEAR} SELECT a, b FROM e")
def _(spark, d):
    return near(spark, d)


@query("clu_single_link", f"WITH {_NEAR}, {_CLOSE.format(e='e')} SELECT node AS asset_id, set_id FROM c WHERE set_id IN (SELECT set_id FROM c GROUP BY 1 HAVING count(*) >= 3)")
def _(spark, d):
    return lineage.large_sets(stereo.union_sets(links(spark, d)), 3)


@query("clu_stereo_union", f"WITH {_NEAR}, nm AS (SELECT a.asset_id AS a, b.asset_id AS b FROM shots a JOIN shots b ON a.album_id = b.album_id AND b.pos = a.pos + 1 WHERE a.pos % 4 = 2), lg AS (SELECT asset_id, album_id, ms, camera, lag(asset_id) OVER w AS p, lag(ms) OVER w AS pm, lag(camera) OVER w AS pc FROM assets WHERE ms IS NOT NULL WINDOW w AS (PARTITION BY album_id ORDER BY ms, asset_id)), al AS (SELECT a, b FROM e UNION ALL SELECT a, b FROM nm UNION ALL SELECT p, asset_id FROM lg WHERE ms - pm <= 10800000 AND coalesce(camera, '') = coalesce(pc, '')), {_CLOSE.format(e='al')} SELECT node AS asset_id, set_id FROM c")
def _(spark, d):
    s = A.shots(spark, d).select("album_id", "pos", "asset_id")
    named = s.where("pos % 4 = 2").select("album_id", (F.col("pos") + 1).alias("pos"), F.col("asset_id").alias("a")).join(s.withColumnRenamed("asset_id", "b"), ["album_id", "pos"])
    runs = sequences.time_runs(A.assets(spark, d), 10_800_000, same_camera=True)
    before = F.lag("asset_id").over(Window.partitionBy("album_id", "run").orderBy("ms", "asset_id"))
    steps = runs.select(before.alias("a"), F.col("asset_id").alias("b")).where("a is not null")
    return stereo.union_sets(links(spark, d), named, steps)


# Corrections

_MM = "(SELECT r.set_id, x.group_id FROM (SELECT *, count(*) OVER (PARTITION BY set_id) AS n FROM {r}) r JOIN (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM {x}) x USING (asset_id) GROUP BY r.set_id, x.group_id, r.n, x.n HAVING 2 * count(*) > r.n + x.n - count(*))"
_FIXED = f"""own AS (SELECT group_id, asset_id FROM shot_groups), dis AS (SELECT 'd' || group_id AS set_id, asset_id FROM shot_groups WHERE album_id % 7 = 0 AND pos % 3 < 2), odd AS (SELECT 'n' || album_id || ':' || pos // 3 AS set_id, album_id, asset_id, pos FROM shots WHERE pos // 3 % 2 = 1 AND album_id % 4 = 1),
rec AS (SELECT 'r' || group_id AS set_id, asset_id, album_id AS ord, 'stereo' AS type, NULL AS orientation FROM shot_groups WHERE album_id % 3 = 0 AND pos % 3 > 0 UNION ALL SELECT 'q' || set_id, asset_id, album_id, 'burst', NULL FROM odd WHERE album_id % 8 = 1), mb AS (SELECT 'm' || group_id AS set_id, asset_id, album_id AS ord FROM shot_groups WHERE album_id % 4 = 1 AND pos % 3 < 2 UNION ALL SELECT set_id, asset_id, album_id FROM odd), mf AS (SELECT set_id, array_agg(asset_id) AS f FROM mb GROUP BY 1),
gone AS (SELECT group_id FROM {_MM.format(r='dis', x='own')}), sd AS (SELECT group_id, (array_agg(type ORDER BY ord, set_id))[1] AS nt FROM {_MM.format(r='(SELECT DISTINCT set_id, asset_id FROM rec)', x='own')} JOIN (SELECT DISTINCT set_id, ord, type FROM rec) USING (set_id) GROUP BY 1), ml AS (SELECT group_id, (array_agg(set_id ORDER BY ord, set_id))[1] AS mset FROM {_MM.format(r='(SELECT set_id, asset_id FROM mb)', x='own')} JOIN (SELECT DISTINCT set_id, ord FROM mb) USING (set_id) GROUP BY 1),
gr AS (SELECT DISTINCT group_id, type, album_id, CASE WHEN type = 'pano' THEN 'vertical' END AS orientation FROM shot_groups), lf AS (SELECT gr.*, nt, mset FROM gr LEFT JOIN sd USING (group_id) LEFT JOIN ml USING (group_id) WHERE group_id NOT IN (SELECT group_id FROM gone)),
det AS (SELECT lf.group_id AS set_id, 'detected' AS origin, coalesce(nt, type) AS type, CASE WHEN nt IS NULL THEN orientation END AS orientation, album_id, o.asset_id FROM lf JOIN (SELECT lf.group_id, unnest(coalesce(f, own_f)) AS asset_id FROM lf JOIN (SELECT group_id, array_agg(asset_id) AS own_f FROM own GROUP BY 1) USING (group_id) LEFT JOIN mf ON mf.set_id = mset) o USING (group_id)),
fr AS (SELECT set_id, asset_id FROM mb WHERE set_id NOT IN (SELECT set_id FROM {_MM.format(r='(SELECT set_id, asset_id FROM mb)', x='own')}) AND set_id IN (SELECT set_id FROM mf WHERE len(f) >= 2)), sa AS (SELECT group_id AS set_id, (array_agg(type ORDER BY ord, set_id))[1] AS nt FROM (SELECT m.set_id, group_id, ord, type FROM {_MM.format(r='(SELECT DISTINCT set_id, asset_id FROM rec)', x='(SELECT set_id AS group_id, asset_id FROM fr)')} m JOIN (SELECT DISTINCT set_id, ord, type FROM rec) USING (set_id)) GROUP BY 1),
ass AS (SELECT fr.set_id, 'asserted' AS origin, coalesce(nt, 'pano') AS type, CASE WHEN coalesce(nt, 'pano') <> 'burst' THEN 'horizontal' END AS orientation, s.album_id, fr.asset_id FROM fr JOIN shots s USING (asset_id) LEFT JOIN sa ON sa.set_id = fr.set_id), cg AS (SELECT * FROM det UNION ALL SELECT * FROM ass)"""


def _parts(spark, d):
    g = A.shot_groups(spark, d)
    third, n = F.floor(F.col("pos") / 3), F.col("album_id")
    groups = g.select("group_id", "type", "album_id", F.when(F.col("type") == "pano", "vertical").alias("orientation")).distinct()
    name = lambda c, x: F.concat(F.lit(c), x)
    odd = A.shots(spark, d).where((third % 2 == 1) & (n % 4 == 1)).select(F.concat(F.lit("n"), n.cast("string"), F.lit(":"), third.cast("string")).alias("set_id"), "album_id", "asset_id")
    dissolved = g.where("album_id % 7 = 0 and pos % 3 < 2").select(name("d", F.col("group_id")).alias("set_id"), "asset_id")
    no = F.lit(None).cast("string").alias("orientation")
    said = g.where("album_id % 3 = 0 and pos % 3 > 0").select(name("r", F.col("group_id")).alias("set_id"), "asset_id", n.alias("ord"), F.lit("stereo").alias("type"), no)
    said = said.union(odd.where("album_id % 8 = 1").select(name("q", F.col("set_id")), "asset_id", n, F.lit("burst"), no))
    listed = g.where("album_id % 4 = 1 and pos % 3 < 2").select(name("m", F.col("group_id")).alias("set_id"), "asset_id", n.alias("ord")).union(odd.select("set_id", "asset_id", n))
    own_frames = listed.groupBy("set_id").agg(F.sort_array(F.collect_list("asset_id")).alias("frame_ids"))
    return groups, g, dissolved, said, listed.join(own_frames, "set_id"), A.shots(spark, d)


@query("join_corrected", f"WITH {_FIXED} SELECT set_id, origin, type, orientation, album_id, asset_id FROM cg")
def _(spark, d):
    return corrections.corrected(*_parts(spark, d))


@query("join_corrections", f"WITH {_FIXED} SELECT set_id, type, orientation, count(*) AS n FROM det GROUP BY 1, 2, 3")
def _(spark, d):
    kept = corrections.corrected(*_parts(spark, d)).where("origin = 'detected'")
    return kept.groupBy("set_id", "type", "orientation").agg(F.count("*").alias("n"))


@query("join_asserted", f"WITH {_FIXED} SELECT set_id, type, orientation, album_id, asset_id FROM ass")
def _(spark, d):
    _groups, members, _gone, said, listed, meta = _parts(spark, d)
    return corrections.asserted(members.select("group_id", "asset_id").distinct(), said, listed, meta).drop("origin")


@query("hlp_retype_both", f"WITH {_FIXED} SELECT DISTINCT album_id, set_id, CASE WHEN origin = 'detected' AND album_id % 4 = 2 THEN 'stereo' ELSE type END AS type FROM cg")
def _(spark, d):
    albums = A.shots(spark, d).where("album_id % 4 = 2").select("album_id")
    return corrections.as_stereo(corrections.corrected(*_parts(spark, d)), albums).select("album_id", "set_id", "type").distinct()


@query("hlp_all_groups", f"WITH {_FIXED}, {_SPLIT.replace('f AS (', 'ff AS (').replace('FROM f)', 'FROM ff)')} SELECT set_id, CASE WHEN origin = 'detected' AND album_id % 4 = 2 THEN 'stereo' ELSE type END AS type, asset_id FROM cg UNION ALL SELECT 'p' || l, 'stereo', unnest([l, r]) FROM pairs")
def _(spark, d):
    out, roles, _links, pairs = split(spark, d)
    stored = corrections.as_stereo(corrections.corrected(*_parts(spark, d)), roles.where("role = 'both'")).select("set_id", "type", "asset_id")
    made = pairs.select(F.concat(F.lit("p"), F.col("left_id").cast("string")).alias("set_id"), F.lit("stereo").alias("type"), F.explode(F.array("left_id", "right_id")).alias("asset_id"))
    return stored.union(made)


@query("hlp_settle_search", "WITH w AS (SELECT asset_id FROM shots WHERE asset_id % 50 = 0), al AS (SELECT DISTINCT album_id FROM shots WHERE asset_id IN (SELECT asset_id FROM w)), m AS (SELECT group_id, max(asset_id) AS merged_id, array_agg(asset_id) AS f FROM shot_groups WHERE type = 'pano' AND album_id IN (SELECT album_id FROM al) GROUP BY 1) SELECT merged_id, len(f) AS n FROM m WHERE list_has_any(f, (SELECT list(asset_id) FROM w))")
def _(spark, d):
    merges = A.shot_groups(spark, d).where("type = 'pano'").groupBy("group_id", "album_id").agg(F.max("asset_id").alias("merged_id"), F.collect_list("asset_id").alias("frame_ids"))
    wanted = A.shots(spark, d).where("asset_id % 50 = 0").select("asset_id")
    return lineage.merges_touching(merges, A.shots(spark, d), wanted).select("merged_id", F.size("frame_ids").cast("long").alias("n"))


@query("hlp_lab_stereo", f"WITH {_NEAR}, {_CLOSE.format(e='e')} SELECT set_id, 'Stereo set · ' || count(*) || ' frames' AS name, count(*) AS n, min(ms) AS taken FROM c JOIN shots ON asset_id = node GROUP BY 1")
def _(spark, d):
    return units.stereo_sets(stereo.union_sets(links(spark, d)), A.shots(spark, d))
