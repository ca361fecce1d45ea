"""Panoramas: seams between neighbouring frames and the runs that they hold together. Grids are square luma signatures, rows first."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.sequences import hamming

BAND, FLOOR, ASPECT = 0.25, 8.0, 1.3  # fixed values: template's share of a side, least activity of a template, most ratio of aspects


@dataclass(frozen=True)
class Options:
    """side: of a grid; overlaps as shares of a side; anchor: the score one seam of a run has to reach; seam: the score of every seam."""

    side: int = 64
    min_overlap: float = 0.3
    max_overlap: float = 0.9
    anchor: float = 10.0
    seam: float = 24.0
    whole: int = 6
    window_ms: int = 10_000
    least: int = 3

    @property
    def band(self) -> int:
        return max(1, int(BAND * self.side + 0.5))

    @property
    def gaps(self) -> range:
        reach = min(self.side - self.band, int(self.max_overlap * self.side + 0.5) - self.band)
        return range(max(0, int(self.min_overlap * self.side + 0.5) - self.band), reach + 1)

    @property
    def cap(self) -> float:
        """Overlaps beyond it are an edge of the search and anchor nothing."""
        return (self.band + self.gaps[-1]) / self.side - 1.5 / self.side


def lines(grids: np.ndarray, horizontal: bool) -> np.ndarray:
    """(m, side, side): columns (or rows) of each grid less their means."""
    x = grids.transpose(0, 2, 1) if horizontal else grids
    return x - x.mean(axis=2, keepdims=True)


def best_seams(a: np.ndarray, b: np.ndarray, horizontal: bool, opts: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, overlap, forward) of m pairs of grids: an edge band of the first slides over the second in both directions, bands
    without structure are no match, the first of equal scores counts."""
    n, band = opts.side, opts.band
    la, lb = lines(a, horizontal), lines(b, horizontal)
    act_a, act_b = np.abs(la).mean(axis=2), np.abs(lb).mean(axis=2)
    score, overlap, forward = np.full(len(a), np.inf), np.zeros(len(a)), np.ones(len(a), bool)
    for gap in opts.gaps:
        for ahead, i, j in ((True, n - band, gap), (False, 0, n - band - gap)):
            structured = np.minimum(act_a[:, i : i + band].sum(1), act_b[:, j : j + band].sum(1)) / band >= FLOOR
            apart = np.abs(la[:, i : i + band] - lb[:, j : j + band]).sum(axis=(1, 2)) / (band * n)
            better = structured & (apart < score)
            score, overlap, forward = np.where(better, apart, score), np.where(better, (band + gap) / n, overlap), np.where(better, ahead, forward)
    return score, overlap, forward


def seams(a: Column, b: Column, opts: Options) -> Column:
    """A struct of both axes' score, overlap and direction for two grids; nulls where a grid is missing."""

    @F.pandas_udf("h double, h_overlap double, h_forward boolean, v double, v_overlap double, v_forward boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        both = (x.notna() & y.notna()).to_numpy()
        out = pd.DataFrame({c: np.full(len(x), None, object) for c in ("h", "h_overlap", "h_forward", "v", "v_overlap", "v_forward")})
        if both.any():
            p, q = (np.stack(s[both].to_numpy()).astype(float).reshape(-1, opts.side, opts.side) for s in (x, y))
            for axis, horizontal in (("h", True), ("v", False)):
                for c, v in zip((axis, f"{axis}_overlap", f"{axis}_forward"), best_seams(p, q, horizontal, opts), strict=True):
                    out.loc[both, c] = v
        for c in out:
            out[c] = out[c].astype("boolean" if c.endswith("forward") else float)
        return out

    return run(a, b)


def neighbours(assets: DataFrame, grids: DataFrame, opts: Options) -> DataFrame:
    """assets(asset_id, album_id, ms, camera, lo, hi, aspect) in time order, each with its run (gap and camera), the pair with the asset
    before it in the album (prev_id, gap_ms, bits, s) and whether that pair is within the run and may be a seam."""
    w = Window.partitionBy("album_id").orderBy("ms", "asset_id")
    was = {c: F.lag(c).over(w) for c in ("asset_id", "ms", "camera", "lo", "hi", "aspect", "g")}
    near = (F.col("ms") - was["ms"] <= opts.window_ms) & (F.coalesce("camera", F.lit("")) == F.coalesce(was["camera"], F.lit("")))
    timed = assets.where("ms is not null").join(grids, "asset_id", "left")
    bits = hamming(F.col("lo"), F.col("hi"), was["lo"], was["hi"]).cast("long")
    ratio = F.greatest(F.col("aspect") / was["aspect"], was["aspect"] / F.col("aspect"))
    paired = timed.select("album_id", "asset_id", "ms", "g", was["g"].alias("pg"), was["asset_id"].alias("prev_id"), (F.col("ms") - was["ms"]).alias("gap_ms"), bits.alias("bits"), F.coalesce(near, F.lit(False)).alias("near"), F.coalesce(ratio <= ASPECT, F.lit(True)).alias("alike"))
    run = F.sum(F.when(F.col("near"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    made = paired.withColumn("run", run.cast("long")).withColumn("s", seams(F.col("pg"), F.col("g"), opts))
    may = F.col("near") & F.col("s.h").isNotNull() & F.coalesce(F.col("bits") >= opts.whole, F.lit(True)) & F.col("alike")
    return made.select("album_id", "asset_id", "ms", "prev_id", "gap_ms", "bits", "run", "s", may.alias("eligible"))


def axes(pairs: DataFrame, opts: Options) -> DataFrame:
    """(album_id, run, best_h, best_v, orientation) of runs of `least` frames: the axis of the best seam that is no edge of the search,
    horizontal in a tie; runs without a seam at the anchor's score have none."""
    best = {a: F.min(F.when(F.col("eligible") & (F.col(f"s.{a}_overlap") <= opts.cap), F.col(f"s.{a}"))) for a in "hv"}
    runs = pairs.groupBy("album_id", "run").agg(F.count("*").alias("n"), best["h"].alias("best_h"), best["v"].alias("best_v")).where(F.col("n") >= opts.least)
    far = F.lit(float("inf"))
    h, v = F.coalesce("best_h", far), F.coalesce("best_v", far)
    axis = F.when(F.least(h, v) <= opts.anchor, F.when(h <= v, "horizontal").otherwise("vertical"))
    return runs.select("album_id", "run", "best_h", "best_v", axis.alias("orientation"))


def panoramas(pairs: DataFrame, opts: Options) -> DataFrame:
    """Frames of panoramas: runs with an axis, cut where a pair may be no seam or scores over `seam`, parts of `least` frames."""
    w = Window.partitionBy("album_id", "run").orderBy("ms", "asset_id")
    aimed = pairs.join(axes(pairs, opts).where("orientation is not null").select("album_id", "run", "orientation"), ["album_id", "run"])
    score = F.when(F.col("orientation") == "horizontal", F.col("s.h")).otherwise(F.col("s.v"))
    joined = F.col("eligible") & (score <= opts.seam)
    parts = aimed.withColumn("score", score).withColumn("part", F.sum(F.when(joined, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("album_id", "run", "part")
    first = F.min(F.struct("ms", "asset_id")).over(whole)["asset_id"]
    return parts.withColumn("n", F.count("*").over(whole)).where(F.col("n") >= opts.least).select("album_id", first.alias("first_id"), "asset_id", "ms", "orientation", "n", "score", "gap_ms", "bits")


def around(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """For each panorama the frame just before and just after it in the album: gap, seam score on the panorama's axis and hash distance."""
    w = Window.partitionBy("album_id").orderBy("ms", "asset_id")
    nxt = {c: F.lead(c).over(w) for c in ("asset_id", "gap_ms", "bits", "s")}
    wide = pairs.select("album_id", "asset_id", "prev_id", F.col("gap_ms").alias("gap_before"), F.col("bits").alias("bits_before"), F.col("s").alias("s_before"), nxt["asset_id"].alias("next_id"), nxt["gap_ms"].alias("gap_after"), nxt["bits"].alias("bits_after"), nxt["s"].alias("s_after"))
    ends = frames.groupBy("album_id", "first_id", "orientation").agg(F.max_by("asset_id", F.struct("ms", "asset_id")).alias("last_id"))
    axis = lambda s: F.when(F.col("orientation") == "horizontal", F.col(f"{s}.h")).otherwise(F.col(f"{s}.v"))
    head = ends.join(wide, (ends["album_id"] == wide["album_id"]) & (ends["first_id"] == wide["asset_id"])).select(ends["album_id"], "first_id", "last_id", "orientation", "prev_id", "gap_before", "bits_before", axis("s_before").alias("score_before"))
    return head.join(wide.select("album_id", F.col("asset_id").alias("last_id"), "next_id", "gap_after", "bits_after", "s_after"), ["album_id", "last_id"]).withColumn("score_after", axis("s_after")).drop("s_after", "orientation")


def strips(s: Column, orientation: Column) -> Column:
    """What a seam shows: both rounded scores, the overlap, and the strips of both frames that overlap, in percent of a frame."""
    flat = orientation == "horizontal"
    o = F.when(flat, s["h_overlap"]).otherwise(s["v_overlap"]) * 100
    ahead = F.when(flat, s["h_forward"]).otherwise(s["v_forward"])
    far = 100 - o
    zero, full = F.lit(0.0), F.lit(100.0)

    def strip(end: Column) -> Column:
        return F.struct(F.when(flat & end, far).otherwise(zero).alias("left"), F.when(~flat & end, far).otherwise(zero).alias("top"), F.when(flat, o).otherwise(full).alias("width"), F.when(flat, full).otherwise(o).alias("height"))

    return F.struct(F.floor(s["h"] + 0.5).alias("h_score"), F.floor(s["v"] + 0.5).alias("v_score"), (o / 100).alias("overlap"), strip(ahead).alias("a"), strip(~ahead).alias("b"))
