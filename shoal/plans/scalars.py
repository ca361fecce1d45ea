"""One query for each scalar rule and row-wise reshaping, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.functions import scalar as S
from shoal.plans.catalog import FILED, STEM, query
from shoal.sources import adapters as A

_TABLES = {"meta": ("asset_id", A.meta), "verdicts": ("asset_id", A.verdicts), "assets": ("asset_id", A.assets), "listing": ("id", A.listing)}
_RAW = {"events": "event_id", "documents": "doc_id", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "pages": "page_id"}


def scalar(name: str, table: str, column, sql: str | None):
    key = _TABLES[table][0] if table in _TABLES else _RAW[table]

    @query(name, sql and f"SELECT {key}, {sql} AS value FROM {table}")
    def _(spark, d):
        rows = _TABLES[table][1](spark, d) if table in _TABLES else A.read(spark, d, table)
        return rows.select(key, column().alias("value"))


name, stem = lambda: F.col("name"), lambda: S.file_stem(F.col("name"))
scalar("fn_split_name", "meta", stem, STEM)
scalar("fn_is_unit", "meta", lambda: S.is_unit(F.concat(F.lit("burst:"), name())), "contains('burst:' || name, ':')")
scalar("fn_retype_id", "meta", lambda: S.retyped(F.concat(F.lit("burst:pano:"), name()), "pano"), "'pano:' || name")
scalar("fn_edit_suffix", "meta", lambda: S.edit_base(stem()), f"regexp_replace({STEM}, '(?i)-(Enhanced-NR|Enhanced|Edit)$', '')")
scalar("fn_search_term", "meta", lambda: S.search_term(F.concat(F.lit("2024-05-06-"), name())), STEM)
scalar("fn_slug", "meta", lambda: S.slug(name()), "trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '-')")
scalar("fn_eye_name", "meta", lambda: S.eye(F.concat(stem(), F.when(F.col("asset_id") % 3 == 0, "_l").when(F.col("asset_id") % 3 == 1, "-R").otherwise(""))), "CASE asset_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' END")
scalar("fn_merge_kind", "meta", lambda: S.merge_kind(stem()), "CASE asset_id % 5 WHEN 3 THEN 'HDR' WHEN 4 THEN 'HDR panorama' END")
scalar("fn_merge_sources", "meta", lambda: F.array_join(S.merge_sources(stem()), "|"), "CASE asset_id % 5 WHEN 3 THEN 'IMG_' || (asset_id - 3) WHEN 4 THEN 'IMG_' || (asset_id - 4) || '-HDR|IMG_' || (asset_id - 4) ELSE '' END")
scalar("fn_album_for", "verdicts", lambda: S.album_for(F.col("status")), FILED)
scalar("fn_in_print_bin", "verdicts", lambda: S.in_print_bin(F.col("status"), F.col("save_only")), "NOT save_only AND status IN ('kept', 'toPrint')")
scalar("fn_verdict_order", "verdicts", lambda: S.verdict_rank(F.col("status")), "CAST(list_position(['backlog', 'kept', 'toPrint', 'toEdit', 'maybe', 'rejected'], status) AS BIGINT)")
scalar("fn_day_key", "events", lambda: F.date_format("ts", "yyyy-MM-dd"), "strftime(ts, '%Y-%m-%d')")
scalar("fn_days_between", "orders", lambda: F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate")).cast("long"), "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS BIGINT)")
scalar("fn_day_label", "events", lambda: F.date_format("ts", "EEEE d MMMM"), "strftime(ts, '%A %-d %B')")
scalar("fn_ms_midnight", "events", lambda: 86_401_000 - F.pmod(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(86_400_000)), "86401000 - (epoch_us(ts) // 1000) % 86400000")
scalar("fn_parse_hm", "events", lambda: S.time_of_day(F.concat((F.col("event_id") % 30).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 70).cast("string"), 2, "0"))).cast("long"), "CASE WHEN event_id % 30 <= 23 AND event_id % 70 <= 59 THEN CAST(event_id % 30 * 60 + event_id % 70 AS BIGINT) END")
scalar("fn_is_capture", "assets", lambda: (F.col("camera") != "") & F.col("camera").isNotNull(), "coalesce(camera <> '', false)")
scalar("fn_swipe_dir", "events", lambda: S.swipe_sector((F.col("event_id") % 41 - 20).cast("double"), (F.col("event_id") % 29 - 14).cast("double")).cast("long"), "CAST((CAST(floor(atan2(event_id % 29 - 14, event_id % 41 - 20) * 4 / pi() + 0.5) AS BIGINT) % 8 + 8) % 8 AS BIGINT)")
scalar("fn_swipe_aim", "events", lambda: S.swipe_strength((F.col("event_id") % 41 - 20).cast("double"), (F.col("event_id") % 29 - 14).cast("double"), 16.0), "least(1.0::DOUBLE, greatest(abs(event_id % 41 - 20), abs(event_id % 29 - 14)) / 16.0::DOUBLE)")
scalar("agg_scan_target", "customer", lambda: F.least(F.lit(800.0), F.greatest(F.lit(200.0), F.coalesce(F.try_divide(F.col("c_custkey") * 200.0, F.col("c_nationkey")), F.lit(800.0)))).cast("double"), "least(800.0::DOUBLE, greatest(200.0::DOUBLE, CASE WHEN c_nationkey = 0 THEN 800.0::DOUBLE ELSE c_custkey * 200.0::DOUBLE / c_nationkey END))")
