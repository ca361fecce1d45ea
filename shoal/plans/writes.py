"""Queries over decisions, tags, bins, roles and paged sources, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoal.functions import scalar as S
from shoal.operators import lineage, tables, writes
from shoal.plans.catalog import FILED, STEM, query
from shoal.plans.units import _SETS, sets
from shoal.sources import adapters as A
from shoal.sources import paged, pages
from shoal.sources.session import checkpoint_root


def _some(spark, d, rest, by=8):
    return A.shots(spark, d).where(F.col("asset_id") % by == rest).select("asset_id")


def _set_status(status, ids, save_only="save_only"):
    return f"SELECT asset_id, status, starred, save_only FROM shot_verdicts WHERE asset_id NOT IN ({ids}) UNION ALL SELECT asset_id, '{status}', coalesce(starred, false), coalesce({save_only}, false) FROM ({ids}) LEFT JOIN shot_verdicts USING (asset_id)"


_BASES = "bases AS (SELECT asset_id, 'h' || asset_id AS hash, 's' || asset_id % 50 AS stamp FROM shots WHERE asset_id % 3 <> 1)"


def _bases(spark, d):
    return A.shots(spark, d).where(F.col("asset_id") % 3 != 1).select("asset_id", F.concat(F.lit("h"), F.col("asset_id").cast("string")).alias("hash"), F.concat(F.lit("s"), (F.col("asset_id") % 50).cast("string")).alias("stamp"))


@query("dml_printable", _set_status("toPrint", "SELECT asset_id FROM shots WHERE asset_id % 8 = 3"))
def _(spark, d):
    return writes.set_status(A.shot_verdicts(spark, d), _some(spark, d, 3), "toPrint")


@query("dml_promote", f"SELECT 'verdict' AS part, CAST(asset_id AS VARCHAR) AS id, status, save_only, NULL AS edits FROM ({_set_status('toPrint', 'SELECT event_id AS asset_id FROM events WHERE event_id % 8 = 3')}) UNION ALL SELECT 'day', strftime(coalesce(p.day, m.day), '%Y-%m-%d'), NULL, NULL, coalesce(edits, 0) + coalesce(more, 0) FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS edits FROM events WHERE event_type = 'purchase' GROUP BY 1) p FULL JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS more FROM events WHERE event_id % 8 = 3 GROUP BY 1) m ON p.day = m.day")
def _(spark, d):
    events = A.read(spark, d, "events").select(F.col("event_id").alias("asset_id"), F.to_date("ts").alias("day"), "event_type")
    progress = events.where("event_type = 'purchase'").groupBy("day").agg(F.count("*").alias("edits"))
    verdicts, days = writes.promote(A.shot_verdicts(spark, d), progress, events.where(F.col("asset_id") % 8 == 3))
    return verdicts.selectExpr("'verdict' AS part", "CAST(asset_id AS STRING) AS id", "status", "save_only", "CAST(NULL AS LONG) AS edits").unionByName(days.selectExpr("'day' AS part", "CAST(day AS STRING) AS id", "CAST(NULL AS STRING) AS status", "CAST(NULL AS BOOLEAN) AS save_only", "edits"))


@query("dml_stand_down", f"WITH {_BASES} SELECT 'verdict' AS part, asset_id, status, save_only FROM ({_set_status('kept', 'SELECT asset_id FROM shots WHERE asset_id % 8 = 5', 'true')}) UNION ALL SELECT 'baseline', asset_id, NULL, NULL FROM bases WHERE asset_id % 8 <> 5")
def _(spark, d):
    verdicts, bases = writes.stand_down(A.shot_verdicts(spark, d), _bases(spark, d), _some(spark, d, 5))
    return verdicts.select(F.lit("verdict").alias("part"), "asset_id", "status", "save_only").union(bases.select(F.lit("baseline"), "asset_id", F.lit(None).cast("string"), F.lit(None).cast("boolean")))


@query("dml_merge_settle", f"WITH {_BASES}, m AS (SELECT max(asset_id) AS merged_id, array_agg(asset_id) AS f FROM shot_groups WHERE type = 'pano' GROUP BY group_id), fr AS (SELECT DISTINCT unnest(f) AS asset_id FROM m), mg AS (SELECT merged_id AS asset_id FROM m), k AS (SELECT asset_id, status, starred FROM shot_verdicts UNION ALL SELECT asset_id, NULL, NULL FROM fr WHERE asset_id NOT IN (SELECT asset_id FROM shot_verdicts)) SELECT 'verdict' AS part, asset_id, CASE WHEN asset_id IN (SELECT asset_id FROM mg) THEN 'toPrint' WHEN asset_id IN (SELECT asset_id FROM fr) THEN 'kept' ELSE status END AS status, coalesce(starred, false) AS starred FROM k UNION ALL SELECT 'baseline', asset_id, NULL, NULL FROM bases WHERE asset_id NOT IN (SELECT asset_id FROM fr) UNION ALL SELECT 'record', merged_id, CAST(len(f) AS VARCHAR), true FROM m UNION ALL SELECT 'record', asset_id, '1', false FROM shots WHERE asset_id % 40 = 0 AND asset_id NOT IN (SELECT merged_id FROM m)")
def _(spark, d):
    merges = A.shot_groups(spark, d).where("type = 'pano'").groupBy("group_id").agg(F.max("asset_id").alias("merged_id"), F.collect_list("asset_id").alias("frame_ids")).select("merged_id", "frame_ids", F.lit(1).alias("at"))
    older = A.shots(spark, d).where("asset_id % 40 = 0").select(F.col("asset_id").alias("merged_id"), F.array("asset_id").alias("frame_ids"), F.lit(0).alias("at"))
    verdicts, bases, records = writes.settle_merge(A.shot_verdicts(spark, d), _bases(spark, d), older, merges)
    parts = [verdicts.selectExpr("'verdict' AS part", "asset_id", "status", "starred"), bases.selectExpr("'baseline' AS part", "asset_id", "CAST(NULL AS STRING) AS status", "CAST(NULL AS BOOLEAN) AS starred")]
    return parts[0].unionByName(parts[1]).unionByName(records.selectExpr("'record' AS part", "merged_id AS asset_id", "CAST(size(frame_ids) AS STRING) AS status", "at = 1 AS starred"))


_MANIFEST = "manifest AS (SELECT album_id, asset_id, 'm' || asset_id % 9 AS stamp FROM shots WHERE asset_id % 5 <> 2)"


def _manifest(spark, d):
    return A.shots(spark, d).where(F.col("asset_id") % 5 != 2).select("album_id", "asset_id", F.concat(F.lit("m"), (F.col("asset_id") % 9).cast("string")).alias("stamp"))


@query("dml_stamp_lookup", f"WITH {_MANIFEST} SELECT asset_id, stamp FROM manifest WHERE asset_id % 8 = 1")
def _(spark, d):
    return writes.manifest_stamps(_some(spark, d, 1), A.shots(spark, d), _manifest(spark, d))


@query("dml_baseline", f"WITH {_BASES}, {_MANIFEST} SELECT asset_id, hash, stamp, 0 AS at FROM bases WHERE asset_id % 8 <> 1 UNION ALL SELECT s.asset_id, CASE WHEN s.asset_id % 3 = 0 THEN 'seen' WHEN lo IS NOT NULL THEN CAST(lo AS VARCHAR) ELSE 'fresh' END, CASE WHEN s.asset_id % 7 = 0 THEN 'now' ELSE m.stamp END, 1 FROM shots s JOIN assets a USING (asset_id) LEFT JOIN manifest m ON m.asset_id = s.asset_id WHERE s.asset_id % 8 = 1")
def _(spark, d):
    seen = _some(spark, d, 1).select("asset_id", F.when(F.col("asset_id") % 3 == 0, "seen").alias("hash"), F.when(F.col("asset_id") % 7 == 0, "now").alias("stamp"))
    cached = A.assets(spark, d).where("lo is not null").select("asset_id", F.col("lo").cast("string").alias("hash"))
    fresh = A.shots(spark, d).select("asset_id", F.lit("fresh").alias("hash"))
    stamps = writes.manifest_stamps(seen, A.shots(spark, d), _manifest(spark, d))
    return writes.capture_baselines(_bases(spark, d).withColumn("at", F.lit(0)), seen, cached, fresh, stamps, F.lit(1))


@query("dml_keep_editing", f"WITH {_BASES}, t AS (SELECT asset_id, 'n' || asset_id AS hash, 'u' || asset_id % 50 AS stamp FROM shots WHERE asset_id // 6 % 4 = 1 AND asset_id % 3 <> 0) SELECT asset_id, hash, stamp, 0 AS at FROM bases WHERE asset_id NOT IN (SELECT asset_id FROM t) UNION ALL SELECT asset_id, hash, stamp, 1 FROM t")
def _(spark, d):
    state = F.when(F.col("asset_id") % 3 == 0, "untouched").otherwise("edited")
    findings = A.shots(spark, d).select("asset_id", F.floor(F.col("asset_id") / 6).alias("set_id"), state.alias("state"), F.concat(F.lit("n"), F.col("asset_id").cast("string")).alias("hash"), F.concat(F.lit("u"), (F.col("asset_id") % 50).cast("string")).alias("stamp"))
    return writes.keep_editing(_bases(spark, d).withColumn("at", F.lit(0)), findings, findings.where("set_id % 4 = 1"), F.lit(1))


@query("dml_requeue", f"WITH w AS (SELECT asset_id, {FILED} AS album FROM verdicts), o AS (SELECT asset_id FROM w WHERE album = 'Edit' AND (asset_id % 10 = 0 OR asset_id NOT IN (SELECT asset_id FROM filings WHERE album = 'Edit'))) SELECT asset_id, 'Edit' AS album FROM o ORDER BY asset_id LIMIT 25")
def _(spark, d):
    again = A.meta(spark, d).where(F.col("asset_id") % 10 == 0).select("asset_id")
    return writes.requeue(A.verdicts(spark, d), A.filings(spark, d), again, "Edit", 25)


@query("io_add_sink", "WITH r AS (SELECT album, asset_id, (row_number() OVER (PARTITION BY album ORDER BY asset_id) - 1) // 20 AS batch, (asset_id % 4 <> 0 AND asset_id % 10 <> 2 AND asset_id % 7 = 0) AS there FROM filings) SELECT album, asset_id, CASE WHEN there THEN 'already' WHEN bool_or(there) OVER (PARTITION BY album, batch) THEN 'alone' ELSE 'batch' END AS outcome FROM r")
def _(spark, d):
    present = A.listing(spark, d).where("original_id is null and id % 7 = 0").select("album", F.col("id").alias("asset_id"))
    return writes.file_in_batches(A.filings(spark, d).select("album", "asset_id"), present, 20)


_TAGS = "tags AS (SELECT asset_id, 't' || asset_id % 4 AS a, CASE WHEN asset_id % 6 = 0 THEN 't9' END AS b FROM shots WHERE asset_id % 2 = 0)"


def _tags(spark, d):
    own = F.concat(F.lit("t"), (F.col("asset_id") % 4).cast("string"))
    return A.shots(spark, d).where(F.col("asset_id") % 2 == 0).select("asset_id", F.when(F.col("asset_id") % 6 == 0, F.array(own, F.lit("t9"))).otherwise(F.array(own)).alias("tags"))


def _flat(tags):
    return tags.select("asset_id", F.array_join("tags", ",").alias("tags"))


@query("dml_tag_apply", f"WITH {_TAGS} SELECT asset_id, concat_ws(',', a, b) AS tags FROM tags WHERE asset_id % 5 <> 0 UNION ALL SELECT asset_id, 't2' FROM shots WHERE asset_id % 5 = 0")
def _(spark, d):
    return _flat(writes.apply_tag(_tags(spark, d), _some(spark, d, 0, 5).withColumn("tag", F.lit("t2"))))


@query("dml_tag_toggle", f"WITH {_TAGS} SELECT asset_id, concat_ws(',', a, b) AS tags FROM tags WHERE asset_id % 5 <> 0 UNION ALL SELECT s.asset_id, CASE WHEN a = 't2' THEN b ELSE 't2' END FROM shots s LEFT JOIN tags t USING (asset_id) WHERE s.asset_id % 5 = 0 AND NOT coalesce(a = 't2' AND b IS NULL, false)")
def _(spark, d):
    return _flat(writes.toggle_tag(_tags(spark, d), _some(spark, d, 0, 5).withColumn("tag", F.lit("t2"))))


@query("dml_tag_swipe", f"WITH {_SETS}, {_TAGS}, s AS (SELECT asset_id, coalesce(set_id, asset_id) AS set_id FROM shots LEFT JOIN c ON node = asset_id), sw AS (SELECT set_id, 't' || max(asset_id) % 4 AS tag FROM s WHERE asset_id % 10 = 1 GROUP BY 1) SELECT asset_id, concat_ws(',', a, b) AS tags FROM tags WHERE asset_id NOT IN (SELECT asset_id FROM s JOIN sw USING (set_id)) UNION ALL SELECT asset_id, tag FROM s JOIN sw USING (set_id)")
def _(spark, d):
    swipes = _some(spark, d, 1, 10).withColumn("tag", F.concat(F.lit("t"), (F.col("asset_id") % 4).cast("string")))
    return _flat(writes.swipe_tag(_tags(spark, d), sets(spark, d), swipes))


@query("dml_tag_dir", "WITH dirs AS (SELECT c_custkey AS owner, k AS dir, 't' || (c_custkey + k) % 5 AS tag FROM customer, range(4) r(k)), ch AS (SELECT c_custkey AS owner, c_custkey % 4 AS dir, CASE WHEN c_custkey % 3 <> 0 THEN 't' || c_custkey % 5 END AS tag FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 4 <> 3), w AS (SELECT * FROM ch WHERE dir <> 0) SELECT * FROM dirs WHERE (owner, dir) NOT IN (SELECT (owner, dir) FROM w) AND (owner, tag) NOT IN (SELECT (owner, tag) FROM w WHERE tag IS NOT NULL) UNION ALL SELECT * FROM w WHERE tag IS NOT NULL")
def _(spark, d):
    key = F.col("c_custkey")
    tag = lambda x: F.concat(F.lit("t"), (x % 5).cast("string"))
    c = A.read(spark, d, "customer")
    directions = c.select(key.alias("owner"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("dir")).withColumn("tag", tag(F.col("owner") + F.col("dir")))
    changes = c.where((key % 2 == 0) & (key % 4 != 3)).select(key.alias("owner"), (key % 4).alias("dir"), F.when(key % 3 != 0, tag(key)).alias("tag"))
    return writes.set_direction(directions, changes, "0")


@query("dml_prints_in", "SELECT asset_id, status FROM shot_verdicts WHERE NOT save_only AND status = 'toPrint'")
def _(spark, d):
    return writes.printable(A.shot_verdicts(spark, d).where("status = 'toPrint'")).select("asset_id", "status")


@query("dml_bin_send", "SELECT 'Bin 1' AS bin, 'old' AS album, CAST(3 AS BIGINT) AS photos UNION ALL SELECT 'Bin 2', 'new', count(*) FROM shot_verdicts WHERE NOT save_only AND status = 'toPrint' HAVING count(*) > 0")
def _(spark, d):
    bins = spark.createDataFrame([("Bin 3",), ("Bin 1",), ("Bin 2",)], "bin string")
    occupied = spark.createDataFrame([("Bin 1", "old", 3)], "bin string, album string, photos long")
    return writes.send_to_bin(bins, occupied, "new", A.shot_verdicts(spark, d).where("status = 'toPrint'"))


_ROLES = "role0 AS (SELECT s_suppkey AS album, ['left', 'right', 'both'][s_suppkey % 3 + 1] AS role FROM supplier), ch AS (SELECT s_suppkey AS album, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'left' ELSE 'right' END AS role FROM supplier WHERE s_suppkey % 5 = 0), roles AS (SELECT * FROM role0 WHERE album NOT IN (SELECT album FROM ch) UNION ALL SELECT * FROM ch WHERE role IS NOT NULL), links0 AS (SELECT s_suppkey AS left_album, s_suppkey + 1 AS right_album FROM supplier), links AS (SELECT l.* FROM links0 l JOIN roles a ON a.album = left_album AND a.role = 'left' JOIN roles b ON b.album = right_album AND b.role = 'right')"


def roles(spark, d):
    """Roles and links after some changes, with manifests and queued units of the albums."""
    key = F.col("s_suppkey")
    s = A.read(spark, d, "supplier")
    role = F.element_at(F.array(*map(F.lit, ("left", "right", "both"))), (key % 3 + 1).cast("int"))
    changes = s.where(key % 5 == 0).select(key.alias("album"), F.when(key % 4 == 0, None).when(key % 4 == 1, "left").otherwise("right").alias("role"))
    albums = s.select(key.alias("album"))
    return writes.set_roles(s.select(key.alias("album"), role.alias("role")), s.select(key.alias("left_album"), (key + 1).alias("right_album")), albums, albums, changes)


@query("dml_role", f"WITH {_ROLES} SELECT 'role' AS part, album, role FROM roles UNION ALL SELECT 'link', left_album, CAST(right_album AS VARCHAR) FROM links UNION ALL SELECT 'manifest', s_suppkey, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT album FROM ch)")
def _(spark, d):
    new, links, manifests, _queued = roles(spark, d)
    return new.select(F.lit("role").alias("part"), "album", "role").union(links.select(F.lit("link"), "left_album", F.col("right_album").cast("string"))).union(manifests.select(F.lit("manifest"), "album", F.lit(None).cast("string")))


@query("hlp_right_albums", f"WITH {_ROLES} SELECT album FROM roles WHERE role = 'right'")
def _(spark, d):
    return lineage.albums_of_role(roles(spark, d)[0], "right")


@query("hlp_claimant", f"WITH {_ROLES} SELECT right_album, min(left_album) AS left_album FROM links GROUP BY 1")
def _(spark, d):
    return lineage.claimants(roles(spark, d)[1])


@query("dml_deck_reset", "SELECT count(*) AS deleted, CAST(0 AS BIGINT) AS rows_left FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events)")
def _(spark, d):
    decks = A.read(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    left = tables.clear(decks)
    return decks.agg(F.count("*").alias("deleted")).join(left.agg(F.count("*").alias("rows_left")))  # one row each


@query("dml_celebrate_day", "WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS i FROM m WHERE n = 2) SELECT user_id, day, event_id, row_number() OVER (PARTITION BY user_id, i ORDER BY day) AS streak FROM g")
def _(spark, d):
    return writes.goals_met(A.read(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id"), "user_id", "day", "event_id", 2)


@query("dml_overrides", "WITH g AS (SELECT group_id, string_agg(CAST(asset_id AS VARCHAR), '|' ORDER BY CAST(asset_id AS VARCHAR)) AS signature FROM shot_groups GROUP BY 1), l AS (SELECT signature, 'dissolve' AS action, 1 AS ts FROM g UNION ALL SELECT signature, 'restore', 2 FROM g WHERE contains(signature, '7') UNION ALL SELECT signature, 'dissolve', 3 FROM g WHERE contains(signature, '77')) SELECT signature, arg_max(action, ts) AS action, max(ts) AS at FROM l GROUP BY 1 HAVING arg_max(action, ts) <> 'restore'")
def _(spark, d):
    groups = A.shot_groups(spark, d).groupBy("group_id").agg(F.collect_list("asset_id").alias("members"))
    text = S.set_signature(F.col("members"))
    acts = [groups.select("members", F.lit("dissolve").alias("action"), F.lit(1).alias("at")), groups.where(F.contains(text, F.lit("7"))).select(F.reverse("members"), F.lit("restore"), F.lit(2)), groups.where(F.contains(text, F.lit("77"))).select("members", F.lit("dissolve"), F.lit(3))]
    return writes.last_overrides(acts[0].union(acts[1]).union(acts[2]))


@query("io_kv_scan", "SELECT asset_id, CASE WHEN asset_id % 8 = 6 THEN 'kept' ELSE status END AS status FROM (SELECT asset_id, status FROM shot_verdicts UNION SELECT asset_id, 'kept' FROM shots WHERE asset_id % 8 = 6 AND asset_id NOT IN (SELECT asset_id FROM shot_verdicts))")
def _(spark, d):
    pending = _some(spark, d, 6).select("asset_id", F.lit("kept").alias("status"))
    return tables.upsert(A.shot_verdicts(spark, d).select("asset_id", "status"), pending, ["asset_id"])


# Made-up rules: a store is built anew for owners that come from before the version.
STALE = [(5, "groups"), (9, "deck"), (14, "hashes"), (20, "deck"), (28, "buffer"), (33, "groups")]


@query("io_invalidate", f"WITH r(version, store) AS (VALUES {', '.join(map(str, STALE))}), v AS (SELECT c_custkey AS owner, c_custkey % 36 AS version FROM customer) SELECT DISTINCT owner, store FROM v JOIN r ON r.version > v.version AND r.version <= 34")
def _(spark, d):
    rules = spark.createDataFrame(STALE, "version int, store string")
    return writes.stale_stores(rules, A.read(spark, d, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 36).alias("version")), 34)


@query("io_flat_scan", "SELECT asset_id, name FROM meta ORDER BY asset_id LIMIT 50")
def _(spark, d):
    return paged.first_assets(A.meta(spark, d), 50).select("asset_id", "name")


PAGE_ROWS, BUDGET = 20, 15
_PAGES = f"p AS (SELECT *, (row_number() OVER (PARTITION BY album_id ORDER BY asset_id) - 1) // {PAGE_ROWS} AS page FROM shots)"


def _pages(spark, d) -> str:
    """A folder with the listing of every album as page files."""
    path = f"{checkpoint_root(spark)}/pages-{uuid.uuid4().hex}"
    pages.write_album_pages(A.shots(spark, d), path, PAGE_ROWS)
    return path


@query("io_album_page", f"WITH {_PAGES} SELECT album_id, asset_id, name FROM p WHERE page = 0")
def _(spark, d):
    return pages.read_album_pages(spark, _pages(spark, d), limit=PAGE_ROWS).select("album_id", "asset_id", "name")


@query("io_album_all", f"WITH {_PAGES} SELECT album_id, CAST(page AS INTEGER) AS page, asset_id, name FROM p WHERE album_id > 3")
def _(spark, d):
    return pages.read_album_pages(spark, _pages(spark, d)).where("album_id > 3").select("album_id", "page", "asset_id", "name")


def _no_pixels(album: int, ids: list[int]) -> list[int]:
    return [i for i in ids if i % 40 == 7]


@query("st_cursor_scan", f"WITH p AS (SELECT album_id, asset_id, row_number() OVER (PARTITION BY album_id ORDER BY asset_id) - 1 AS pos FROM shots), o AS (SELECT *, asset_id % 40 <> 7 AS had FROM p), f AS (SELECT album_id, CASE WHEN bool_and(had) THEN {BUDGET} ELSE 0 END AS start FROM o WHERE pos < {BUDGET} GROUP BY 1) SELECT 1 AS scan, album_id, asset_id, had FROM o WHERE pos < {BUDGET} UNION ALL SELECT 2, album_id, asset_id, had FROM o JOIN f USING (album_id) WHERE pos >= start AND pos < start + {BUDGET}")
def _(spark, d):
    path, out = _pages(spark, d), f"{checkpoint_root(spark)}/scans-{uuid.uuid4().hex}"

    def look(seen, scan):
        seen.select("album_id", "asset_id", "had").write.mode("overwrite").parquet(f"{out}/looked/scan={scan}")

    for _ in range(2):
        pages.scan_once(spark, path, f"{out}/places", BUDGET, _no_pixels, look)
    return spark.read.schema("album_id long, asset_id long, had boolean, scan int").parquet(f"{out}/looked")


@query("hlp_meta", f"SELECT asset_id, album_id, {STEM} AS name, 'jpg' AS ext, coalesce(CAST(ms AS VARCHAR), '') AS taken, lat, lng, camera AS serial FROM shots")
def _(spark, d):
    return paged.asset_meta(_docs(spark, d), F.col("doc"))


@query("hlp_unmeta", "SELECT asset_id, name AS file_name, lat, lng, camera AS serial FROM shots")
def _(spark, d):
    back = paged.asset_documents(paged.asset_meta(_docs(spark, d), F.col("doc")))
    at = lambda path: F.get_json_object("doc", f"$.payload.{path}")
    return back.select("asset_id", at("importSource.fileName").alias("file_name"), at("location.latitude").cast("double").alias("lat"), at("location.longitude").cast("double").alias("lng"), at("camera.serial").alias("serial"))


def _docs(spark, d):
    location = F.when(F.col("lat").isNotNull(), F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")))
    payload = F.struct(F.col("ms").cast("string").alias("captureDate"), F.struct(F.col("name").alias("fileName")).alias("importSource"), location.alias("location"), F.struct(F.col("camera").alias("serial")).alias("camera"))
    return A.shots(spark, d).select("asset_id", "album_id", F.to_json(F.struct(F.lit("image").alias("subtype"), payload.alias("payload"))).alias("doc"))


@query("hlp_edited", "SELECT n.id FROM new_snapshot n JOIN old_snapshot o USING (id) WHERE o.updated <> n.updated AND n.id % 3 <> 0")
def _(spark, d):
    old, new = A.snapshots(spark, d)
    return lineage.edit_states(old.withColumn("hash", F.lit("a")), new.withColumn("hash", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))).where("state = 'edited'").select("id")


@query("hlp_batch", "SELECT asset_id, filed_at FROM filings WHERE album = 'Edit' ORDER BY filed_at, asset_id LIMIT 12")
def _(spark, d):
    return A.filings(spark, d).where("album = 'Edit'").orderBy("filed_at", "asset_id").limit(12).select("asset_id", "filed_at")  # a goal's worth of the queue
