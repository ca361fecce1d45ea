"""Queries over corrections, queues, sources and table writes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoal.operators import lineage, selection, tables
from shoal.operators.running import running_sums
from shoal.plans.catalog import query
from shoal.sources import adapters as A
from shoal.sources.session import checkpoint_root



@query("join_album_name", "SELECT asset_id, n_name AS album FROM meta LEFT JOIN nation ON n_nationkey = asset_id % 30")
def _(spark, d):
    nations = A.read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("album"))
    return A.meta(spark, d).drop("album").withColumn("n_nationkey", (F.col("asset_id") % 30).cast("int")).join(nations, "n_nationkey", "left").select("asset_id", "album")


@query("join_leftovers", "WITH l AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0) SELECT id, 'left' AS side FROM l WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'right' FROM r WHERE id NOT IN (SELECT id FROM l)")
def _(spark, d):
    left = A.read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    right = A.read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")).distinct()
    return left.join(right, "id", "left_anti").withColumn("side", F.lit("left")).union(right.join(left, "id", "left_anti").withColumn("side", F.lit("right")))


@query("join_links", "WITH role AS (SELECT s_suppkey AS album, CASE s_suppkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'both' END AS role FROM supplier), p AS (SELECT s_suppkey AS left_album, s_suppkey + 1 AS right_album FROM supplier) SELECT p.* FROM p JOIN role a ON a.album = left_album AND a.role = 'left' JOIN role b ON b.album = right_album AND b.role = 'right'")
def _(spark, d):
    key = F.col("s_suppkey")
    s = A.read(spark, d, "supplier")
    roles = s.select(key.alias("album"), F.when(key % 3 == 0, "left").when(key % 3 == 1, "right").otherwise("both").alias("role"))
    links = s.select(key.alias("left_album"), (key + 1).alias("right_album"))
    return links.join(roles.where("role = 'left'").select(F.col("album").alias("left_album")), "left_album", "left_semi").join(roles.where("role = 'right'").select(F.col("album").alias("right_album")), "right_album", "left_semi").select("left_album", "right_album")


@query("agg_decided", "SELECT album, CAST(sum(CASE WHEN asset_id % 5 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS photos FROM meta JOIN verdicts USING (asset_id) WHERE status <> 'backlog' GROUP BY 1")
def _(spark, d):
    decided = A.meta(spark, d).join(lineage.decided(A.verdicts(spark, d)), "asset_id")
    return decided.groupBy("album").agg(F.sum(F.when(F.col("asset_id") % 5 == 0, 3).otherwise(1)).alias("photos"))


@query("agg_totals", "SELECT count(*) FILTER (status <> 'backlog') AS reviewed, count(*) FILTER (status = 'toEdit') AS edits, count(*) FILTER (starred) AS starred FROM verdicts")
def _(spark, d):
    return A.verdicts(spark, d).agg(F.count_if(F.col("status") != "backlog").alias("reviewed"), F.count_if(F.col("status") == "toEdit").alias("edits"), F.count_if("starred").alias("starred"))


@query("agg_fold_sets", "WITH s AS (SELECT asset_id // 6 AS set_id, asset_id, row_number() OVER (PARTITION BY asset_id // 6 ORDER BY CASE WHEN asset_id % 4 = 0 THEN 0 WHEN asset_id % 4 = 1 THEN 1 ELSE 2 END, asset_id) AS k FROM meta) SELECT set_id, asset_id AS lead FROM s WHERE k = 1")
def _(spark, d):
    rank = F.when(F.col("asset_id") % 4 == 0, 0).when(F.col("asset_id") % 4 == 1, 1).otherwise(2)
    ranked = A.meta(spark, d).select(F.floor(F.col("asset_id") / 6).alias("set_id"), F.struct(rank.alias("rank"), "asset_id").alias("s"))
    return ranked.groupBy("set_id").agg(F.min("s").getField("asset_id").alias("lead"))


@query("agg_scan_summary", "WITH a AS (SELECT album_id, count(*) AS n FROM assets GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY album_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a) SELECT count(*) AS albums, CAST(sum(n) AS BIGINT) AS images FROM r WHERE before < 800")
def _(spark, d):
    albums = A.assets(spark, d).groupBy("album_id").agg(F.count("*").alias("n"))
    return running_sums(albums, ["album_id"], {"before": F.col("n")}).where("before < 800").agg(F.count("*").alias("albums"), F.sum("n").alias("images"))


@query("win_capture_order", "SELECT album_id, asset_id, row_number() OVER (PARTITION BY album_id ORDER BY ms NULLS FIRST, asset_id) AS pos FROM assets")
def _(spark, d):
    return A.assets(spark, d).select("album_id", "asset_id", F.row_number().over(Window.partitionBy("album_id").orderBy(F.col("ms").asc_nulls_first(), "asset_id")).cast("long").alias("pos"))


@query("win_first_backlog", "SELECT album, coalesce(min(CASE WHEN coalesce(status, 'backlog') = 'backlog' THEN ord END), 0) AS cursor_at FROM meta LEFT JOIN verdicts USING (asset_id) GROUP BY 1")
def _(spark, d):
    deck = lineage.overlay(A.meta(spark, d), A.verdicts(spark, d)).join(A.meta(spark, d).select("asset_id", "ord"), "asset_id")
    return deck.groupBy("album").agg(F.coalesce(F.min(F.when(F.col("status") == "backlog", F.col("ord"))), F.lit(0)).alias("cursor_at"))


@query("win_queue_state", "SELECT o_custkey, count(*) AS held, count(*) FILTER (CAST(o_orderdate AS DATE) <= DATE '1997-12-02') AS overdue FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def _(spark, d):
    late = F.to_date("o_orderdate") <= F.lit("1997-12-02").cast("date")
    return A.read(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("held"), F.count_if(late).alias("overdue"))


@query("lim_more", "SELECT asset_id FROM meta WHERE asset_id NOT IN (SELECT asset_id FROM verdicts) ORDER BY md5('s6:' || CAST(asset_id AS VARCHAR)) LIMIT 40")
def _(spark, d):
    fresh = A.meta(spark, d).join(A.verdicts(spark, d), "asset_id", "left_anti").select("asset_id")
    return fresh.orderBy(selection.draw("s6", F.col("asset_id"))).limit(40)


@query("st_change_gate", "WITH o AS (SELECT id % 20 AS album, md5(string_agg(id || '@' || updated, chr(10) ORDER BY id)) AS h FROM old_snapshot GROUP BY 1), n AS (SELECT id % 20 AS album, md5(string_agg(id || '@' || updated, chr(10) ORDER BY id)) AS h FROM new_snapshot GROUP BY 1) SELECT n.album, n.h IS DISTINCT FROM o.h AS scan FROM n LEFT JOIN o USING (album)")
def _(spark, d):
    def marks(rows, name):
        lines = F.sort_array(F.collect_list(F.struct("id", F.concat(F.col("id").cast("string"), F.lit("@"), "updated").alias("line"))))
        return rows.groupBy((F.col("id") % 20).alias("album")).agg(F.md5(F.concat_ws("\n", F.transform(lines, lambda x: x["line"]))).alias(name))

    old, new = A.snapshots(spark, d)
    return marks(new, "now").join(marks(old, "was"), "album", "left").select("album", (~F.col("now").eqNullSafe(F.col("was"))).alias("scan"))


@query("st_stamp", "SELECT n.id, coalesce(o.updated, '') = '' OR o.updated <> n.updated AS moved FROM new_snapshot n LEFT JOIN old_snapshot o USING (id)")
def _(spark, d):
    old, new = A.snapshots(spark, d)
    both = new.join(old.withColumnRenamed("updated", "was"), "id", "left")
    return both.select("id", ((F.coalesce("was", F.lit("")) == "") | (F.col("was") != F.col("updated"))).alias("moved"))


@query("dml_print_state", "SELECT album, CASE WHEN album = 'Edit' THEN 'ordered' ELSE 'toPrint' END AS state, count(*) AS n FROM listing GROUP BY 1")
def _(spark, d):
    states = spark.createDataFrame([("Edit", "ordered")], "album string, state string")
    return A.listing(spark, d).groupBy("album").agg(F.count("*").alias("n")).join(states, "album", "left").select("album", F.coalesce("state", F.lit("toPrint")).alias("state"), "n")


@query("dml_refusal", "SELECT album, count(*) FILTER (original_id IS NOT NULL) AS gone, count(*) FILTER (original_id IS NULL AND id % 5 = 1) AS refused FROM listing GROUP BY 1")
def _(spark, d):
    return A.listing(spark, d).groupBy("album").agg(F.count_if(F.col("original_id").isNotNull()).alias("gone"), F.count_if(F.col("original_id").isNull() & (F.col("id") % 5 == 1)).alias("refused"))


@query("dml_refill_budget", "SELECT greatest(2000 - count(*), 0) AS budget FROM meta WHERE asset_id NOT IN (SELECT asset_id FROM verdicts WHERE status <> 'backlog')")
def _(spark, d):
    return A.meta(spark, d).join(lineage.decided(A.verdicts(spark, d)), "asset_id", "left_anti").agg(F.greatest(2000 - F.count("*"), F.lit(0)).alias("budget"))


@query("hlp_fingerprints", "SELECT id % 20 AS album, string_agg(id || '@' || updated, ',' ORDER BY id) AS lines FROM new_snapshot GROUP BY 1")
def _(spark, d):
    rows = A.snapshots(spark, d)[1]
    lines = F.sort_array(F.collect_list(F.struct("id", F.concat(F.col("id").cast("string"), F.lit("@"), "updated").alias("line"))))
    return rows.groupBy((F.col("id") % 20).alias("album")).agg(F.concat_ws(",", F.transform(lines, lambda x: x["line"])).alias("lines"))


@query("hlp_median", "SELECT o_custkey, CAST(floor(quantile_cont(o_orderkey, 0.5) + 0.5) AS BIGINT) AS median FROM orders GROUP BY 1")
def _(spark, d):
    return A.read(spark, d, "orders").groupBy("o_custkey").agg(F.floor(F.percentile("o_orderkey", 0.5) + 0.5).alias("median"))


@query("hlp_prints_due", "SELECT count(*) FILTER (o_orderstatus = 'O') AS due FROM orders")
def _(spark, d):
    return A.read(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("due"))


@query("hlp_live_edit", "SELECT DISTINCT asset_id - asset_id % 5 AS original_id FROM meta WHERE asset_id % 5 IN (1, 2) AND asset_id % 7 <> 3 AND asset_id - asset_id % 5 IN (SELECT asset_id FROM meta)")
def _(spark, d):
    grouped = A.meta(spark, d).where("asset_id % 7 = 3").select("asset_id")
    return lineage.live_edits(lineage.edit_pairs(A.meta(spark, d)), grouped)


@query("io_prune", "SELECT asset_id FROM meta WHERE asset_id IN (SELECT asset_id FROM verdicts WHERE starred)")
def _(spark, d):
    return tables.keep_only(A.meta(spark, d).select("asset_id"), A.verdicts(spark, d).where("starred"), ["asset_id"])


@query("io_evict", "SELECT preview FROM (SELECT doc_id || ':' || (doc_id % 3) AS preview, doc_id FROM documents) WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    previews = A.read(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), (F.col("doc_id") % 3).cast("string")).alias("preview"))
    keep = A.read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("kept"))
    return previews.join(keep, F.split_part("preview", F.lit(":"), F.lit(1)) == F.col("kept"), "left_semi")


@query("io_replace_part", "SELECT album_id, group_id, asset_id FROM shot_groups WHERE album_id % 4 <> 0 OR pos % 3 = 1 OR album_id NOT IN (SELECT album_id FROM shot_groups WHERE pos % 3 = 1)")
def _(spark, d):
    groups, path = A.shot_groups(spark, d), f"{checkpoint_root(spark)}/groups-{uuid.uuid4().hex}"
    groups = groups.withColumn("shelf", F.pmod(F.xxhash64("album_id"), F.lit(64)).cast("int"))
    groups.repartition("shelf").write.partitionBy("shelf").parquet(path)
    tables.replace_keyed(groups.where("album_id % 4 = 0 and pos % 3 = 1"), path, "album_id", "shelf")
    return spark.read.schema("group_id string, type string, asset_id long, pos long, album_id long, shelf int").parquet(path).select("album_id", "group_id", "asset_id")


@query("io_device", "SELECT page_id FROM pages WHERE page_id % 10 IN (1, 4, 7)")
def _(spark, d):
    folders = spark.createDataFrame([(1,), (4,), (7,)], "folder int")
    return A.read(spark, d, "pages").withColumn("folder", (F.col("page_id") % 10).cast("int")).join(folders, "folder", "left_semi").select("page_id")
