"""Queries over panoramas and picture kernels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.operators import panorama, vectors
from shoal.plans.catalog import GRID, query
from shoal.sources import adapters as A

OPTS = panorama.Options(side=8, min_overlap=0.25, max_overlap=0.9, anchor=60.0, seam=75.0, whole=6, window_ms=12 * 3_600_000, least=3)
_L = "flatten(list_transform(range(0, 8), lambda k: list_transform(range(0, 8), lambda j: g[{cell}] - list_avg(list_transform(range(0, 8), lambda i: g[{mean}])))))"
LINES = f"SELECT *, {_L.format(cell='j * 8 + k + 1', mean='i * 8 + k + 1')} AS lh, {_L.format(cell='k * 8 + j + 1', mean='k * 8 + i + 1')} AS lv FROM shot_grids"
_PARTS = " UNION ALL ".join(
    f"SELECT asset_id, prev_id, '{ax}' AS ax, {(2 + gap) / 8}::DOUBLE AS overlap, {'true' if ahead else 'false'} AS fwd, {gap * 2 + (not ahead)} AS ord, least(list_sum(list_transform(pl{ax}[{i * 8 + 1}:{i * 8 + 16}], lambda x: abs(x))), list_sum(list_transform(l{ax}[{j * 8 + 1}:{j * 8 + 16}], lambda x: abs(x)))) / 16 AS act, list_sum(list_transform(list_zip(pl{ax}[{i * 8 + 1}:{i * 8 + 16}], l{ax}[{j * 8 + 1}:{j * 8 + 16}]), lambda x: abs(x[1] - x[2]))) / 16 AS diff FROM adj WHERE plh IS NOT NULL AND lh IS NOT NULL"
    for ax in "hv"
    for gap in range(6)
    for ahead, i, j in ((True, 6, gap), (False, 0, 6 - gap))
)
_W = "WINDOW w AS (PARTITION BY album_id ORDER BY ms, a.asset_id)"
SEAMS = f"""WITH gl AS ({LINES}), src AS (SELECT album_id, a.asset_id, ms, camera, lo, hi, lh, lv, CASE WHEN a.asset_id % 10 <> 0 THEN CASE WHEN a.asset_id % 7 = 0 THEN 0.7 ELSE 1.5 END END AS aspect FROM assets a LEFT JOIN gl ON gl.asset_id = a.asset_id WHERE ms IS NOT NULL),
adj AS (SELECT *, lag(a.asset_id) OVER w AS prev_id, ms - lag(ms) OVER w AS gap_ms, bit_count(xor(lo, lag(lo) OVER w)) + bit_count(xor(hi, lag(hi) OVER w)) AS bits, lag(lh) OVER w AS plh, lag(lv) OVER w AS plv, coalesce(ms - lag(ms) OVER w <= {OPTS.window_ms} AND coalesce(camera, '') = coalesce(lag(camera) OVER w, ''), false) AS near, coalesce(greatest(aspect / lag(aspect) OVER w, lag(aspect) OVER w / aspect) <= 1.3, true) AS alike FROM src a {_W}),
cand AS ({_PARTS}), top AS (SELECT asset_id, ax, arg_min(diff, diff * 1000 + ord / 100.0) AS score, arg_min(overlap, diff * 1000 + ord / 100.0) AS overlap, arg_min(fwd, diff * 1000 + ord / 100.0) AS fwd FROM cand WHERE act >= 8 GROUP BY 1, 2),
sm AS (SELECT asset_id, CAST('inf' AS DOUBLE) AS inf FROM adj WHERE plh IS NOT NULL AND lh IS NOT NULL),
pr AS (SELECT j.album_id, j.asset_id, ms, prev_id, gap_ms, bits, CAST(sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY album_id ORDER BY ms, j.asset_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run, CASE WHEN sm.asset_id IS NOT NULL THEN coalesce(h.score, inf) END AS h, CASE WHEN sm.asset_id IS NOT NULL THEN coalesce(h.overlap, 0) END AS ho, CASE WHEN sm.asset_id IS NOT NULL THEN coalesce(h.fwd, true) END AS hf, CASE WHEN sm.asset_id IS NOT NULL THEN coalesce(v.score, inf) END AS v, CASE WHEN sm.asset_id IS NOT NULL THEN coalesce(v.overlap, 0) END AS vo, CASE WHEN sm.asset_id IS NOT NULL THEN coalesce(v.fwd, true) END AS vf, near AND sm.asset_id IS NOT NULL AND coalesce(bits >= 6, true) AND alike AS eligible FROM adj j LEFT JOIN sm ON sm.asset_id = j.asset_id LEFT JOIN top h ON h.asset_id = j.asset_id AND h.ax = 'h' LEFT JOIN top v ON v.asset_id = j.asset_id AND v.ax = 'v'),
ax AS (SELECT album_id, run, best_h, best_v, CASE WHEN least(coalesce(best_h, CAST('inf' AS DOUBLE)), coalesce(best_v, CAST('inf' AS DOUBLE))) <= {OPTS.anchor} THEN CASE WHEN coalesce(best_h, CAST('inf' AS DOUBLE)) <= coalesce(best_v, CAST('inf' AS DOUBLE)) THEN 'horizontal' ELSE 'vertical' END END AS orientation FROM (SELECT album_id, run, count(*) AS n, min(CASE WHEN eligible AND ho <= {OPTS.cap} THEN h END) AS best_h, min(CASE WHEN eligible AND vo <= {OPTS.cap} THEN v END) AS best_v FROM pr GROUP BY 1, 2) WHERE n >= 3),
aim AS (SELECT pr.*, orientation, CASE WHEN orientation = 'horizontal' THEN h ELSE v END AS score FROM pr JOIN ax USING (album_id, run) WHERE orientation IS NOT NULL), pt AS (SELECT *, sum(CASE WHEN eligible AND score <= {OPTS.seam} THEN 0 ELSE 1 END) OVER (PARTITION BY album_id, run ORDER BY ms, asset_id ROWS UNBOUNDED PRECEDING) AS part FROM aim),
pano AS (SELECT album_id, asset_id, ms, orientation, first_value(asset_id) OVER (PARTITION BY album_id, run, part ORDER BY ms, asset_id) AS first_id, count(*) OVER (PARTITION BY album_id, run, part) AS n FROM pt)"""


def pairs(spark, d):
    aspect = F.when(F.col("asset_id") % 10 != 0, F.when(F.col("asset_id") % 7 == 0, 0.7).otherwise(1.5))
    return panorama.neighbours(A.assets(spark, d).withColumn("aspect", aspect), A.shot_grids(spark, d), OPTS)


@query("vec_seam", f"{SEAMS} SELECT asset_id, prev_id, h, ho AS h_overlap, hf AS h_forward, v, vo AS v_overlap, vf AS v_forward FROM pr WHERE h IS NOT NULL")
def _(spark, d):
    return pairs(spark, d).where("s.h is not null").select("asset_id", "prev_id", "s.*")


@query("vec_lines", f"WITH gl AS ({LINES}) SELECT asset_id, k AS line, list_avg(list_transform(lh[k * 8 + 1:k * 8 + 8], lambda x: abs(x))) AS activity FROM gl, range(0, 8) r(k)")
def _(spark, d):
    return A.shot_grids(spark, d).select("asset_id", F.posexplode(vectors.line_activity(F.col("g"), 8)).alias("line", "activity")).withColumn("line", F.col("line").cast("long"))


@query("win_pano_axis", f"{SEAMS} SELECT album_id, run, best_h, best_v, orientation FROM ax")
def _(spark, d):
    return panorama.axes(pairs(spark, d), OPTS)


@query("win_pano", f"{SEAMS} SELECT album_id, first_id, asset_id, orientation, n FROM pano WHERE n >= 3")
def _(spark, d):
    return panorama.panoramas(pairs(spark, d), OPTS).select("album_id", "first_id", "asset_id", "orientation", "n")


@query("win_pano_neighbours", f"{SEAMS}, ends AS (SELECT album_id, first_id, orientation, arg_max(asset_id, ms * 1000000 + asset_id) AS last_id FROM pano WHERE n >= 3 GROUP BY 1, 2, 3), wide AS (SELECT *, lead(asset_id) OVER w AS next_id, lead(gap_ms) OVER w AS gap_after, lead(bits) OVER w AS bits_after, lead(h) OVER w AS nh, lead(v) OVER w AS nv FROM pr WINDOW w AS (PARTITION BY album_id ORDER BY ms, asset_id)) SELECT e.album_id, first_id, last_id, f.prev_id, f.gap_ms AS gap_before, CAST(f.bits AS BIGINT) AS bits_before, CASE WHEN orientation = 'horizontal' THEN f.h ELSE f.v END AS score_before, l.next_id, l.gap_after, CAST(l.bits_after AS BIGINT) AS bits_after, CASE WHEN orientation = 'horizontal' THEN l.nh ELSE l.nv END AS score_after FROM ends e JOIN wide f ON f.asset_id = first_id JOIN wide l ON l.asset_id = last_id")
def _(spark, d):
    near = pairs(spark, d)
    return panorama.around(near, panorama.panoramas(near, OPTS))


@query("hlp_seam_report", f"{SEAMS} SELECT asset_id, CAST(floor(h + 0.5) AS BIGINT) AS h_score, CAST(floor(v + 0.5) AS BIGINT) AS v_score, ho AS overlap, CASE WHEN hf THEN 100 - ho * 100 ELSE 0 END AS a_left, CASE WHEN hf THEN 0 ELSE 100 - ho * 100 END AS b_left, ho * 100 AS width FROM pr WHERE eligible AND h < 1000 AND v < 1000")
def _(spark, d):
    shown = pairs(spark, d).where("eligible and s.h < 1000 and s.v < 1000").select("asset_id", panorama.strips(F.col("s"), F.lit("horizontal")).alias("r"))
    return shown.select("asset_id", "r.h_score", "r.v_score", "r.overlap", F.col("r.a.left").alias("a_left"), F.col("r.b.left").alias("b_left"), F.col("r.a.width").alias("width"))


# Kernels of single pictures


def _grids(spark, d):
    return A.read(spark, d, "embeddings").select("vec_id", vectors.grid(F.col("embedding")).alias("g"))


_CELLS = f"WITH g AS (SELECT vec_id, {GRID} AS g FROM embeddings), q AS (SELECT vec_id, g || g[1:8] AS q, list_transform(range(0, 20), lambda i: g[i + 1] - g[i + 21]) AS rg, list_transform(range(0, 20), lambda i: (g[i + 1] + g[i + 21]) / 2 - g[i + 41]) AS yb FROM g)"
_BITS = "list_sum(list_transform(range(0, {n}), lambda k: CASE WHEN {c}[k // {w} * {w1} + k % {w} + 1 + {o}] - {c}[k // {w} * {w1} + k % {w} + 2 + {o}] > {m} THEN CAST(1 AS BIGINT) << CAST({n} - 1 - k AS INTEGER) ELSE 0 END))"
_LUMA = "format('{{:08x}}', CAST(" + _BITS.format(n=32, c="q", w=8, w1=9, o=0, m=6) + " AS BIGINT)) || format('{{:08x}}', CAST(" + _BITS.format(n=32, c="q", w=8, w1=9, o=36, m=6) + " AS BIGINT))"
_COLOUR = "format('{{:04x}}', CAST(" + _BITS.format(n=16, c="rg", w=4, w1=5, o=0, m=14) + " AS BIGINT)) || format('{{:04x}}', CAST(" + _BITS.format(n=16, c="yb", w=4, w1=5, o=0, m=14) + " AS BIGINT))"
_LUMA, _COLOUR = _LUMA.replace("{{", "{").replace("}}", "}"), _COLOUR.replace("{{", "{").replace("}}", "}")


def _hashed(spark, d):
    g = F.col("g")
    red, green, blue = (F.slice("g", i, 20) for i in (1, 21, 41))
    return _grids(spark, d).select("vec_id", vectors.gradient_hex(F.concat(g, F.slice("g", 1, 8)), 9, 8, 6).alias("luma"), vectors.colour_hex(red, green, blue).alias("colour"))


@query("vec_dhash", f"{_CELLS} SELECT vec_id, {_LUMA} AS hash FROM q")
def _(spark, d):
    return _hashed(spark, d).select("vec_id", F.col("luma").alias("hash"))


@query("vec_cdhash", f"{_CELLS} SELECT vec_id, {_COLOUR} AS hash FROM q")
def _(spark, d):
    return _hashed(spark, d).select("vec_id", F.col("colour").alias("hash"))


_XOR = "bit_count(xor(CAST('0x' || {a} AS UBIGINT), CAST('0x' || {b} AS UBIGINT)))"


@query("vec_hash_split", f"{_CELLS}, h AS (SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN {_LUMA} END AS luma, CASE WHEN vec_id % 11 <> 0 THEN {_COLOUR} END AS colour FROM q), x AS (SELECT a.vec_id, CAST({_XOR.format(a='a.luma', b='b.luma')} AS BIGINT) AS luma, CAST({_XOR.format(a='a.colour', b='b.colour')} AS BIGINT) AS colour FROM h a JOIN h b ON b.vec_id = a.vec_id + 1) SELECT vec_id, luma + colour AS full_bits, luma, colour FROM x")
def _(spark, d):
    whole = _hashed(spark, d).select("vec_id", F.when(F.col("vec_id") % 11 != 0, F.concat("luma", "colour")).alias("hash"))
    split = vectors.hash_split(F.col("hash"), F.col("other"))
    return whole.join(whole.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("other")), "vec_id").select("vec_id", split.alias("x")).select("vec_id", "x.full_bits", "x.luma", "x.colour")


@query("vec_luma_hamming", f"{_CELLS}, h AS (SELECT vec_id, {_LUMA} AS luma FROM q) SELECT a.vec_id, CAST({_XOR.format(a='a.luma', b='b.luma')} AS BIGINT) AS bits FROM h a JOIN h b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    whole = _hashed(spark, d).select("vec_id", F.concat("luma", "colour").alias("hash"))
    both = whole.join(whole.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("other")), "vec_id")
    return both.select("vec_id", vectors.hash_split(F.col("hash"), F.col("other"))["luma"].alias("bits"))


@query("vec_sig", f"WITH g AS (SELECT vec_id, {GRID} AS g FROM embeddings), l AS (SELECT vec_id, list_transform(range(0, 16), lambda p: 0.299::DOUBLE * g[p * 4 + 1] + 0.587::DOUBLE * g[p * 4 + 2] + 0.114::DOUBLE * g[p * 4 + 3]) AS y FROM g) SELECT vec_id, k AS cell, CAST(floor((y[k // 2 * 8 + k % 2 * 4 + 1] + y[k // 2 * 8 + k % 2 * 4 + 2] + y[k // 2 * 8 + k % 2 * 4 + 3] + y[k // 2 * 8 + k % 2 * 4 + 4]) / 4) AS BIGINT) AS luma FROM l, range(0, 4) r(k)")
def _(spark, d):
    return _grids(spark, d).select("vec_id", F.posexplode(vectors.signature(F.col("g"), 8, 2, 2)).alias("cell", "luma")).select("vec_id", F.col("cell").cast("long").alias("cell"), "luma")


@query("vec_aspect", "SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_size / (p_partkey % 7)::DOUBLE ELSE 1.0::DOUBLE END AS aspect FROM part")
def _(spark, d):
    return A.read(spark, d, "part").select("p_partkey", vectors.aspect(F.col("p_size"), F.col("p_partkey") % 7).alias("aspect"))
