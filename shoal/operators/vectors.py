"""Kernels over luma grids and hashes: higher-order functions in the JVM, and numpy over Arrow batches where a kernel slides."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(vector: Column) -> Column:
    """64 cells of 0..255 from components of -1..1."""
    return F.transform(vector, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("double"))


def _apart(a: Column, b: Column, dx: int):
    return lambda s, i: s + F.abs(F.element_at(a, i + 1) - F.element_at(b, i + 1 + dx))


def aligned_distance(a: Column, b: Column, shift: int = 2, side: int = 8) -> Column:
    """Least mean absolute difference over horizontal shifts, on the columns that both grids have; null where a grid is missing."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out, both = np.full(len(x), np.nan), (x.notna() & y.notna()).to_numpy()
        if both.any():
            p, q = (np.stack(s[both].to_numpy()).astype(float).reshape(-1, side, side) for s in (x, y))
            out[both] = np.min([np.abs(p[:, :, max(0, -dx) : side - max(0, dx)] - q[:, :, max(0, dx) : side + min(0, dx)]).mean(axis=(1, 2)) for dx in range(-shift, shift + 1)], axis=0)
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return run(a, b)


def signature_distance(a: Column, b: Column, side: int = 8) -> Column:
    """Least mean absolute difference of grids less their means over shifts of one cell on both axes, on the cells that both have, rounded."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out, both = np.full(len(x), np.nan), (x.notna() & y.notna()).to_numpy()
        if both.any():
            p, q = (np.stack(s[both].to_numpy()).astype(float).reshape(-1, side, side) for s in (x, y))
            p, q = (g - g.mean(axis=(1, 2), keepdims=True) for g in (p, q))
            part = lambda g, dy, dx: g[:, max(0, dy) : side + min(0, dy), max(0, dx) : side + min(0, dx)]
            out[both] = np.floor(np.min([np.abs(part(p, -dy, -dx) - part(q, dy, dx)).mean(axis=(1, 2)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0) + 0.5)
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return run(a, b)


def _bits(cells: Column, places: list[int], margin: float) -> Column:
    at = F.array(*map(F.lit, places))
    return F.aggregate(at, F.lit(0).cast("long"), lambda s, i: F.call_function("shiftleft", s, F.lit(1)).bitwiseOR(F.when(F.element_at(cells, i) - F.element_at(cells, i + 1) > margin, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def gradient_hex(cells: Column, width: int, height: int, margin: float) -> Column:
    """A bit for each cell that exceeds its right neighbour by more than margin, rows first, as hexadecimal text of 32 bits a part."""
    places = [r * width + c + 1 for r in range(height) for c in range(width - 1)]
    parts = [places[i : i + 32] for i in range(0, len(places), 32)]
    return F.concat(*[F.lower(F.lpad(F.hex(_bits(cells, p, margin)), len(p) // 4, "0")) for p in parts])


def colour_hex(red: Column, green: Column, blue: Column, width: int = 5, height: int = 4, margin: float = 14) -> Column:
    """Gradient hashes of red less green and of yellow less blue."""
    warm = F.zip_with(red, green, lambda r, g: r - g)
    yellow = F.zip_with(F.zip_with(red, green, lambda r, g: (r + g) / 2), blue, lambda y, b: y - b)
    return F.concat(gradient_hex(warm, width, height, margin), gradient_hex(yellow, width, height, margin))


def hash_split(a: Column, b: Column, luma: int = 16) -> Column:
    """Different bits of two hexadecimal hashes: all, those of the luma part, and those of the colour part; null where one is missing."""

    def apart(start: int, n: int) -> Column:
        x, y = (F.conv(F.substring(h, start, n), 16, 10).cast("decimal(20,0)") for h in (a, b))
        low = F.lit(4294967296).cast("decimal(20,0)")
        half = lambda v: (F.floor(v / low).cast("long"), (v % low).cast("long"))
        (xh, xl), (yh, yl) = half(x), half(y)
        return (F.bit_count(xh.bitwiseXOR(yh)) + F.bit_count(xl.bitwiseXOR(yl))).cast("long")

    grey, colour = apart(1, luma), apart(luma + 1, 8)
    return F.struct((grey + colour).alias("full_bits"), grey.alias("luma"), colour.alias("colour"))


def area_means(rgba: np.ndarray, width: int, height: int, side: int) -> np.ndarray:
    """Truncated mean lumas of side x side areas of a picture, four channels a pixel, rows first; small pictures repeat their pixels. Areas
    differ by a row and a column at most, so all of them are summed together, pixel by pixel in the order of the rows."""
    pixels = np.asarray(rgba)[: 4 * width * height].reshape(height, width, 4).astype(float)
    luma = 0.299 * pixels[..., 0] + 0.587 * pixels[..., 1] + 0.114 * pixels[..., 2]
    k = np.arange(side)
    y0, x0 = k * height // side, k * width // side
    y1, x1 = np.maximum(y0 + 1, (k + 1) * height // side), np.maximum(x0 + 1, (k + 1) * width // side)
    total = np.zeros((side, side))
    for dy in range(int((y1 - y0).max())):
        for dx in range(int((x1 - x0).max())):
            y, x = y0 + dy, x0 + dx
            inside = (y < y1)[:, None] & (x < x1)[None, :]
            total += np.where(inside, luma[np.minimum(y, height - 1)][:, np.minimum(x, width - 1)], 0)
    return np.floor(total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])).astype(np.int64).ravel()


def signature(rgba: Column, width: Column | int, height: Column | int, side: int = 64) -> Column:
    """area_means of pictures as bytes or as arrays of numbers; null for a picture that lacks pixels."""

    @F.pandas_udf("array<long>")
    def run(pictures: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        out = []
        for picture, w, h in zip(pictures, widths, heights, strict=True):
            data = np.frombuffer(picture, np.uint8) if isinstance(picture, bytes) else picture
            out.append(area_means(data, int(w), int(h), side) if data is not None and w > 0 and h > 0 and len(data) >= 4 * w * h else None)
        return pd.Series(out)

    size = [F.lit(x) if isinstance(x, int) else x for x in (width, height)]
    return run(rgba, *size)


def aspect(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(F.lit(1.0))


def _by_grid(kernel, returns: str, cells: Column) -> Column:
    """kernel(grids, one a row) over the grids of a batch that are there, null for the others."""

    @F.pandas_udf(returns)
    def run(grids: pd.Series) -> pd.Series:
        there = grids.notna()
        made = iter(kernel(np.stack(grids[there].to_list()).astype(float)) if there.any() else ())
        return pd.Series([next(made) if t else None for t in there], dtype=object)

    return run(cells)


def line_activity(cells: Column, side: int) -> Column:
    """Mean absolute deviation of every column of square grids from its mean."""

    def kernel(g: np.ndarray) -> np.ndarray:
        g = g[:, : side * side].reshape(-1, side, side)
        return np.abs(g - g.mean(1, keepdims=True)).mean(1)

    return _by_grid(kernel, "array<double>", cells)


def box_means(cells: Column, side: int, by: int) -> Column:
    """Truncated means of by x by boxes of square grids."""
    n = side // by
    return _by_grid(lambda g: np.floor(g[:, : side * side].reshape(-1, n, by, n, by).mean((2, 4))).astype(np.int64).reshape(-1, n * n), "array<long>", cells)


def mean_range(cells: Column, side: int, shift: int) -> Column:
    """[low, high]: the least and the largest mean of the columns of square grids that remain when up to `shift` of either side go."""

    def kernel(g: np.ndarray) -> np.ndarray:
        columns = g[:, : side * side].reshape(-1, side, side).mean(1)
        means = np.stack([part.mean(1) for k in range(shift + 1) for part in (columns[:, : side - k], columns[:, k:])], 1)
        return np.stack([means.min(1), means.max(1)], 1)

    return _by_grid(kernel, "array<double>", cells)


def nearest_hashes(queries: DataFrame, candidates: DataFrame, block: str, part: int = 4096) -> DataFrame:
    """(query, near, bits): of the candidates(vec_id, lo, hi) of its block the one whose hash differs in the fewest bits, the smaller id in a
    tie. All are compared, in parts of about `part` rows a side, so no task holds a block, and a part gives one row a query."""
    counts = queries.groupBy(block).agg(F.count("*").alias("nq")).join(candidates.groupBy(block).agg(F.count("*").alias("nc")), block)  # one row a block

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        parts = lambda n: F.ceil(F.col(n) / part).cast("int")
        r = rows.select(block, "vec_id", "lo", "hi").join(counts, block).withColumn("own", F.pmod(F.hash("vec_id"), parts(own)))
        r = r.withColumn("met", F.explode(F.sequence(F.lit(0), parts(other) - 1)))
        return r.select(F.col(block).alias("b"), *[F.col(c).alias(c) for c in ("own", "met", "vec_id", "lo", "hi")])

    def nearest(q: pa.Table, c: pa.Table) -> pa.Table:
        ids, near, bits = [q["vec_id"].to_numpy()] if c.num_rows else [np.zeros(0, np.int64)], [], []
        if c.num_rows and q.num_rows:
            order = np.argsort(c["vec_id"].to_numpy(), kind="stable")
            ours, theirs = ([t[h].to_numpy() for h in ("lo", "hi")] for t in (q, c))
            theirs, other = [x[order] for x in theirs], c["vec_id"].to_numpy()[order]
            for at in range(0, q.num_rows, 64):
                apart = sum(np.bitwise_count((a[at : at + 64, None] ^ b[None]).view(np.uint64)) for a, b in zip(ours, theirs, strict=True))
                first = apart.argmin(1)
                near.append(other[first])
                bits.append(apart[np.arange(len(first)), first].astype(np.int64))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"query": join(ids) if near else np.zeros(0, np.int64), "near": join(near), "bits": join(bits)})

    q, c = dealt(queries, "nq", "nc"), dealt(candidates, "nc", "nq")
    met = q.groupBy("b", "own", "met").cogroup(c.groupBy("b", "met", "own")).applyInArrow(nearest, "query long, near long, bits long")
    return met.groupBy("query").agg(F.min(F.struct("bits", "near")).alias("n")).select("query", "n.near", "n.bits")
