"""Stereo: which eye a frame is, which frames are pairs, and what becomes of frames without a partner."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from shoal.functions import scalar as S
from shoal.operators import lineage
from shoal.operators.selection import greedy_pairs
from shoal.operators.sequences import hamming

FAR = 9007199254740991  # drift of a pair without two times or an offset


def serial_sides(frames: DataFrame) -> DataFrame:
    """(album_id, serial, eye) of albums with exactly two cameras: names vote (left +1, right -1), in a tie the smaller serial is left."""
    vote = F.when(S.eye(S.file_stem(F.col("name"))) == "L", 1).when(S.eye(S.file_stem(F.col("name"))) == "R", -1).otherwise(0)
    score = frames.where("serial <> ''").groupBy("album_id", "serial").agg(F.sum(vote).alias("score"))
    two = score.groupBy("album_id").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("score")).alias("s"), "serial"))["serial"].alias("left"))
    return score.join(two.where("n = 2").select("album_id", "left"), "album_id").select("album_id", "serial", F.when(F.col("serial") == F.col("left"), "L").otherwise("R").alias("eye"))


def split_eyes(frames: DataFrame) -> DataFrame:
    """frames(album_id, asset_id, name, serial, ...) with the eye that the name or else the camera tells; null where neither does."""
    told = frames.join(serial_sides(frames), ["album_id", "serial"], "left")
    return told.withColumn("eye", F.coalesce(S.eye(S.file_stem(F.col("name"))), F.col("eye")))


def left_ids(members: DataFrame) -> DataFrame:
    """(group_id, asset_id) of the frames that names put on the left: those named so, or all that aren't named right where none is; no
    answer for groups without a named frame or with all on one side."""
    eye = S.eye(S.file_stem(F.col("name")))
    w = Window.partitionBy("group_id")
    marked = members.withColumn("eye", eye).withColumn("lefts", F.count_if(F.col("eye") == "L").over(w)).withColumn("rights", F.count_if(F.col("eye") == "R").over(w))
    is_left = F.when(F.col("lefts") > 0, F.coalesce(F.col("eye") == "L", F.lit(False))).otherwise(F.coalesce(F.col("eye") != "R", F.lit(True)))
    sided = marked.where("lefts + rights > 0").withColumn("is_left", is_left)
    sided = sided.withColumn("k", F.count_if("is_left").over(w)).withColumn("n", F.count("*").over(w))
    return sided.where("is_left and k > 0 and k < n").select("group_id", "asset_id")


#: Blocks are dealt to BUCKETS groups of a cogrouped kernel, those of more than CHUNK frames a side in parts; PAIRS are compared at once.
BUCKETS, CHUNK, PAIRS = 4096, 512, 4096


def _packed(grids: Column) -> Column:
    """Grids as bytes: one a cell where all are whole numbers up to 255, else eight."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def pack(g) -> bytes | None:
            if g is None:
                return None
            cells = np.asarray(g, float)
            small = ((cells >= 0) & (cells <= 255) & (cells == np.floor(cells))).all()
            return cells.astype(np.uint8).tobytes() if small else cells.tobytes()

        return s.map(pack)

    return run(grids)


def _unpacked(packed: pa.ChunkedArray, cells: int) -> np.ndarray:
    parts = packed.to_pylist()
    if all(len(p) == cells for p in parts):
        return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, cells).astype(np.int16)
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == cells else float).astype(float) for p in parts])


def _nearest_shift(a: np.ndarray, b: np.ndarray, side: int, shift: int) -> np.ndarray:
    """Least mean absolute difference of grids, row by row, over shifts sideways."""
    p, q = (g.reshape(-1, side, side) for g in (a, b))
    return np.min([np.abs(p[:, :, max(0, -dx) : side - max(0, dx)] - q[:, :, max(0, dx) : side + min(0, dx)]).sum(axis=(1, 2), dtype=float) / (side * (side - abs(dx))) for dx in range(-shift, shift + 1)], axis=0)


def _score(left: pa.Table, right: pa.Table, fine: tuple[int, int], rough: tuple[int, int], most: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(left rows, right rows, rough, distance) of a bucket's pairs of frames of one part, PAIRS at a time."""
    parts = [t.select(["part"]).to_pandas()["part"].to_numpy() for t in (left, right)]
    grids = [_unpacked(t["g"], fine[0] * fine[0]) for t in (left, right)]
    by = fine[0] // rough[0]
    small = [np.floor(g.reshape(-1, rough[0], by, rough[0], by).mean((2, 4))).reshape(len(g), -1) if by > 1 else g for g in grids]
    low, high = [], []
    for g in small:  # means of the columns that remain when up to `shift` of either side go
        columns = g.reshape(-1, rough[0], rough[0]).mean(1)
        means = np.stack([m.mean(1) for k in range(rough[1] + 1) for m in (columns[:, : rough[0] - k], columns[:, k:])], 1)
        low.append(means.min(1))
        high.append(means.max(1))
    order = np.argsort(parts[1], kind="stable")
    first, last = (np.searchsorted(parts[1][order], parts[0], s) for s in ("left", "right"))
    ends = np.cumsum(last - first)
    slack = most + 2e-6  # of rounding in sums
    for at in range(0, int(ends[-1]), PAIRS):
        n = np.arange(at, min(at + PAIRS, int(ends[-1])))
        i = np.searchsorted(ends, n, "right")
        j = order[last[i] - (ends[i] - n)]
        met = (low[0][i] - slack <= high[1][j]) & (low[1][j] <= high[0][i] + slack)  # a mean difference is at least that of the means
        i, j = i[met], j[met]
        near = _nearest_shift(small[0][i], small[1][j], *rough)
        close = near <= most
        i, j = i[close], j[close]
        if len(i):
            yield i, j, near[close], _nearest_shift(grids[0][i], grids[1][j], *fine)


def scored_pairs(left: DataFrame, right: DataFrame, block: str, fine: tuple[int, int], rough: tuple[int, int], most: float, large: DataFrame | None = None) -> DataFrame:
    """(block, left_id, right_id, rough, distance) of the left and right frames(block, asset_id, g) of a block that are near. Grids reduced to
    rough = (side, shift) are compared first, where their mean lumas don't rule that out, and the fine ones of those that are at most `most`
    apart. Both frames of a pair come from one block, an album or a pair of albums. With a column `at` in the frames there are left_at and
    right_at. large(block, n) names blocks of more than CHUNK frames, whose frames meet in parts; it changes no result. Every
    frame is sent once, as packed cells, and once for each part of the other side; pairs are made where they meet."""
    timed = "at" in left.columns

    def side(frames: DataFrame, own: str, other: str) -> DataFrame:
        f = frames.select(F.col(block).alias("block"), "asset_id", *(["at"] if timed else []), _packed(F.col("g")).alias("g"))
        if large is None:
            return f.withColumn("part", F.xxhash64("block"))
        n = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int")
        f = f.join(F.broadcast(large.select(F.col(block).alias("block"), "n")), "block", "left").withColumn("n", n)  # one row for CHUNK frames at most
        f = f.withColumn(own, F.pmod(F.hash("asset_id"), "n")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        return f.withColumn("part", F.xxhash64("block", "l", "r")).drop("n", "l", "r")

    kinds = {"block": left.schema[block].dataType, "left_id": left.schema["asset_id"].dataType, "right_id": right.schema["asset_id"].dataType}
    out = StructType([StructField(n, t) for n, t in kinds.items()] + [StructField(n, DoubleType()) for n in ("rough", "distance")] + ([StructField(n, LongType()) for n in ("left_at", "right_at")] if timed else []))

    def run(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        if not a.num_rows or not b.num_rows:
            return
        for i, j, near, distance in _score(a, b, fine, rough, most):
            x, y = a.take(i), b.take(j)
            same = pc.equal(x["block"], y["block"])  # blocks whose hashes agree
            columns = [x["block"], x["asset_id"], y["asset_id"], pa.array(near), pa.array(distance), *([x["at"], y["at"]] if timed else [])]
            yield from pa.table(columns, names=out.names).filter(same).to_batches()

    l, r = side(left, "l", "r"), side(right, "r", "l")
    r = r.select(*[F.col(c).alias(c) for c in r.columns])  # columns of its own, also where both sides come from one frame
    bucket = F.pmod("part", F.lit(BUCKETS))
    return l.groupBy(bucket).cogroup(r.groupBy(bucket)).applyInArrow(lambda a, b: pa.Table.from_batches(list(run(a, b)), schema=to_arrow_schema(out)), out).withColumnRenamed("block", block)


def moved(left: DataFrame, offsets: DataFrame, block: str) -> DataFrame:
    """Left frames with `at`, their time moved by the block's clock offset; null without either."""
    return left.join(offsets.select(block, "offset_ms"), block, "left").withColumn("at", (F.col("ms") + F.col("offset_ms")).cast("long")).drop("offset_ms")


def drift(pairs: DataFrame) -> DataFrame:
    """pairs(left_at, right_at, ...) with how far the times of both sides, less the block's clock offset, lie apart."""
    return pairs.withColumn("drift", F.coalesce(F.abs(F.col("right_at") - F.col("left_at")), F.lit(FAR))).drop("left_at", "right_at")


def pair_eyes(scored: DataFrame, most: float) -> DataFrame:
    """One-to-one pairs (left_id, right_id, distance, drift), nearest first, then least drift."""
    return greedy_pairs(scored.where(F.col("distance") <= most), "left_id", "right_id", ["distance", "drift"])


def report(left: DataFrame, right: DataFrame, block: str, scored: DataFrame, pairs: DataFrame, most: float) -> DataFrame:
    """(asset_id, outcome, other_id, distance, reason) of every left frame: paired, notHashed, noCandidates (its block has no right frame with
    a grid), or rejected with its nearest right frame: over tolerance, or taken by the left frame it went to."""
    best = scored.where("distance is not null").groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("near"))
    met = left.join(right.where("g is not null").select(block).distinct(), block, "left_semi").select(F.col("asset_id").alias("left_id"), F.lit(True).alias("met"))
    p = pairs.select("left_id", F.col("right_id").alias("partner"), F.col("distance").alias("pair_distance"))
    winner = pairs.select(F.col("right_id").alias("wanted"), F.col("left_id").alias("claimed_by"))
    rows = left.select(F.col("asset_id").alias("left_id"), F.col("g").isNotNull().alias("hashed")).join(p, "left_id", "left").join(best, "left_id", "left").join(met, "left_id", "left")
    rows = rows.join(winner, F.col("near.right_id") == F.col("wanted"), "left")
    outcome = F.when(F.col("partner").isNotNull(), "paired").when(~F.col("hashed"), "notHashed").when(F.col("met").isNull(), "noCandidates").otherwise("rejected")
    reason = F.when(F.col("outcome") != "rejected", "").when(F.col("near").isNull() | (F.col("near.distance") > most), "over tolerance").otherwise("taken")
    out = rows.withColumn("outcome", outcome)
    return out.select(F.col("left_id").alias("asset_id"), "outcome", F.coalesce("partner", F.when(F.col("outcome") == "rejected", F.col("near.right_id"))).alias("other_id"), F.coalesce("pair_distance", F.when(F.col("outcome") == "rejected", F.col("near.distance"))).alias("distance"), reason.alias("reason"))


def baselines(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """(group_id, asset_id, way, baseline, metres) of stereo sets; members(group_id, album_id, asset_id, pos, name, serial, lat, lng),
    chosen(album_id, left_serial). Baseline -1 is the left eye. Named eyes come first, then two cameras (the chosen one or the smaller
    serial is left), then places (whole metres from the first frame, nearer baselines first), else the first frame is left."""
    w = Window.partitionBy("group_id")
    named = left_ids(members).withColumn("is_left", F.lit(True))
    m = members.join(named, ["group_id", "asset_id"], "left").join(chosen, "album_id", "left")
    first = w.orderBy("pos", "asset_id")
    m = m.withColumn("by_name", F.max(F.coalesce("is_left", F.lit(False))).over(w)).withColumn("serials", F.size(F.array_remove(F.collect_set(F.coalesce("serial", F.lit(""))).over(w), "")))
    present = F.max(F.col("serial") == F.col("left_serial")).over(w)
    m = m.withColumn("rig", F.when(F.coalesce(present, F.lit(False)), F.col("left_serial")).otherwise(F.min(F.nullif("serial", F.lit(""))).over(w)))
    m = m.withColumn("i", F.row_number().over(first)).withColumn("lat0", F.first("lat").over(first)).withColumn("lng0", F.first("lng").over(first))
    m = m.withColumn("metres", S.half_up(S.haversine(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng"))).cast("long"))
    m = m.withColumn("placed", F.min(F.col("metres").isNotNull()).over(w)).withColumn("reach", F.max("metres").over(w))
    way = F.when(F.col("by_name"), "names").when(F.col("serials") >= 2, "cameras").when(F.col("placed") & (F.col("reach") > 0), "places").otherwise("first")
    m = m.withColumn("way", way)
    left = F.when(F.col("way") == "names", F.coalesce("is_left", F.lit(False))).when(F.col("way") == "cameras", F.coalesce(F.col("serial") == F.col("rig"), F.lit(False))).when(F.col("way") == "places", F.col("metres") == 0).otherwise(F.col("i") == 1)
    m = m.withColumn("left", left)
    rank = F.dense_rank().over(Window.partitionBy("group_id", "left").orderBy("metres")) - 1
    index = F.when(F.col("left"), -1).when(F.col("way") == "places", rank).otherwise(0)
    return m.select("group_id", "asset_id", "way", index.cast("long").alias("baseline"), F.when(F.col("way") == "places", F.col("metres")).alias("metres"))


def split_albums(frames: DataFrame, roles: DataFrame, links: DataFrame, scanned: DataFrame, grouped: DataFrame, pairs: DataFrame) -> DataFrame:
    """(asset_id, outcome, missing) of every frame of an album with a role: part of a pair or group, a gap that names the missing eye, or
    withheld while an album is not scanned to its end. frames(album_id, asset_id), roles(album_id, role), links(left_album,
    right_album), scanned(album_id), grouped(asset_id), pairs(left_id, right_id). A link counts if its albums have those roles; albums of
    one eye without a link are gaps throughout. Frames of a right album whose link is not settled are left out."""
    done = scanned.select("album_id", F.lit(True).alias("done")).distinct()
    role = roles.select("album_id", "role").join(done, "album_id", "left").select("album_id", "role", F.coalesce("done", F.lit(False)).alias("done"))
    lefts, rights = role.where("role = 'left'"), role.where("role = 'right'")
    good = links.join(lefts.select(F.col("album_id").alias("left_album"), F.col("done").alias("ldone")), "left_album").join(rights.select(F.col("album_id").alias("right_album"), F.col("done").alias("rdone")), "right_album").select("left_album", "right_album", (F.col("ldone") & F.col("rdone")).alias("settled"))
    linked = good.select(F.col("left_album").alias("album_id"), "settled").union(good.select("right_album", "settled"))
    taken = pairs.select(F.col("left_id").alias("asset_id")).union(pairs.select("right_id")).distinct().withColumn("paired", F.lit(True))
    held = grouped.select("asset_id").distinct().withColumn("held", F.lit(True))
    f = frames.select("album_id", "asset_id").join(role, "album_id").join(linked, "album_id", "left").join(taken, "asset_id", "left").join(held, "asset_id", "left")
    both, alone = F.col("role") == "both", F.col("settled").isNull()
    outcome = (
        F.when(both & F.col("held"), "grouped").when(both & F.col("done"), "gap").when(both, "withheld")
        .when(alone, "gap").when(F.col("paired"), "paired").when(F.col("settled"), "gap").when(F.col("role") == "left", "withheld")
    )
    missing = F.when(both, "unknown").when(F.col("role") == "left", "right").otherwise("left")
    return f.withColumn("outcome", outcome).where("outcome is not null").select("asset_id", "outcome", F.when(F.col("outcome") == "gap", missing).alias("missing"))


#: Hashes are looked up by words of 16 bits with up to PROBED bits changed; beyond that, nearly every word would be a neighbour of every other.
WORD_BITS, PROBED = 16, 2


def _sides(frames: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
    columns = ("asset_id", "lo", "hi", "lat", "lng")
    return tuple(frames.select(block, *[F.col(c) for c in frames.columns if c not in (block, *columns)], *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "ab")


def _cells(frames: DataFrame, metres: float) -> DataFrame:
    """frames with the cube of `metres` that holds their place on the globe: x, y, z; a chord is no longer than its arc, so frames that lie
    near each other are in the same or in neighbouring cubes, at the poles and across the date line too."""
    size, up, along = metres * (1 + 1e-9) / S.EARTH_METRES, F.radians("lat"), F.radians("lng")
    place = (F.cos(up) * F.cos(along), F.cos(up) * F.sin(along), F.sin(up))
    return frames.withColumns({n: F.floor(p / size) for n, p in zip("xyz", place, strict=True)})


def _words(frames: DataFrame, changed: int) -> DataFrame:
    """A row for each word of the hash, and for each way to change up to `changed` of its bits."""
    masks = [m for m in range(1 << WORD_BITS) if m.bit_count() <= changed]
    word = [F.call_function("shiftright", F.col(h), F.lit(WORD_BITS * i)).bitwiseAND(F.lit((1 << WORD_BITS) - 1)) for h in ("lo", "hi") for i in range(32 // WORD_BITS)]
    rows = frames.where("lo is not null").select("*", F.posexplode(F.array(*word)).alias("which", "own"))
    return rows.withColumn("word", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("own").bitwiseXOR(m)))).drop("own")


#: Frames of a block that are compared with each other at once: fewer bytes than 27 neighbouring cubes of each frame.
FEW = 256


def near_sets(frames: DataFrame, block: str, most_bits: int, most_metres: float, few: int = FEW) -> DataFrame:
    """Edges (a, b) of frames(asset_id, lo, hi, lat, lng) of one block whose hashes are near and which lie near each other; a missing hash
    or place is near everything. Blocks of up to `few` frames are compared whole; in others frames with places are met within neighbouring cubes of the globe. One without a place is met through the
    words of its hash: of two hashes that differ in most_bits one of four words differs in a quarter of them at most. Only what has neither
    to go by, and hashes for which so many bits may differ that words tell nothing (PROBED), is compared with its whole block."""
    sized = frames.select(block, "asset_id", "lo", "hi", "lat", "lng").withColumn("n", F.count("*").over(Window.partitionBy(block)))
    small, own = sized.where(F.col("n") <= few).drop("n"), sized.where(F.col("n") > few).drop("n")
    placed, free = own.where("lat is not null and lng is not null"), own.where("lat is null or lng is null")
    bits = hamming(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"))
    alike = F.coalesce(bits <= most_bits, F.lit(True))
    close = F.coalesce(S.haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")) <= most_metres, F.lit(True))
    celled = _cells(placed, most_metres)
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{n}") for n, d in zip("xyz", step, strict=True)]) for step in itertools.product((-1, 0, 1), repeat=3)])
    around = celled.select("*", F.explode(steps).alias("step")).select(block, "asset_id", "lo", "hi", "lat", "lng", *[(F.col(n) + F.col(f"step.d{n}")).alias(n) for n in "xyz"])
    near = [_sides(around, block)[0].join(_sides(celled, block)[1], [block, "x", "y", "z"]).where("asset_id_a < asset_id_b")]
    near.append(_sides(small, block)[0].join(_sides(small, block)[1], block).where("asset_id_a < asset_id_b"))
    once = F.col("placed") | (F.col("asset_id_a") < F.col("asset_id_b"))  # of two frames without a place the smaller looks for the other
    marked = own.withColumn("placed", F.col("lat").isNotNull() & F.col("lng").isNotNull())
    probes = most_bits // (64 // WORD_BITS)
    if probes <= PROBED:
        words = _sides(_words(free, probes), block)[0].join(_sides(_words(marked, 0), block)[1], [block, "which", "word"])
        apart = [F.bit_count(F.call_function("shiftright", F.col(f"{h}_a").bitwiseXOR(F.col(f"{h}_b")), F.lit(WORD_BITS * i)).bitwiseAND(F.lit((1 << WORD_BITS) - 1))) for h in ("lo", "hi") for i in range(32 // WORD_BITS)]
        first = F.array_position(F.transform(F.array(*apart), lambda n: n <= probes), True) - 1  # a pair is taken by the first word that both share
        near.append(words.where(once & (F.col("asset_id_a") != F.col("asset_id_b")) & (F.col("which") == first)))
        near += [_sides(x, block)[0].join(_sides(y, block)[1], block).where(once & (F.col("asset_id_a") != F.col("asset_id_b"))) for x, y in ((free.where("lo is null"), marked), (free.where("lo is not null"), marked.where("lo is null")))]
    else:
        near.append(_sides(free, block)[0].repartition(block, "asset_id_a").join(_sides(marked, block)[1], block).where(once & (F.col("asset_id_a") != F.col("asset_id_b"))))
    edges = [n.where(alike & close).select(F.least("asset_id_a", "asset_id_b").alias("a"), F.greatest("asset_id_a", "asset_id_b").alias("b")) for n in near]
    return functools.reduce(DataFrame.unionByName, edges)


def near_links(frames: DataFrame, block: str, most_bits: int, most_metres: float) -> DataFrame:
    """Edges that connect what near_sets connects, fewer of them: in a block with a frame that has neither hash nor place, which is near all, all
    are linked to the first such frame and no others are compared."""
    joker = frames.where("lo is null and (lat is null or lng is null)").groupBy(block).agg(F.min("asset_id").alias("joker"))
    star = frames.join(joker, block).where("asset_id <> joker").select(F.least("joker", "asset_id").alias("a"), F.greatest("joker", "asset_id").alias("b"))
    return star.unionByName(near_sets(frames.join(joker, block, "left_anti"), block, most_bits, most_metres))


def union_sets(*edges: DataFrame) -> DataFrame:
    """(asset_id, set_id): sets of eye pairs and of all clusterers, joined wherever they share a frame; all of them stereo."""
    every = edges[0].select("a", "b")
    for more in edges[1:]:
        every = every.union(more.select("a", "b"))
    return lineage.components(every).toDF("asset_id", "set_id")
