"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one entry from each of BOOKS full-dimensional codebooks. The codebooks are fitted on at most SAMPLE vectors
(those of smallest hashed id): k-means on residuals gives the first ones, then each in turn is
fitted by least squares to beam-search codes.
Every row of the table is encoded by a beam search over all codebooks and kept as its codes and the squared norm of the sum, so
the distance to a query is that norm less twice a sum of table lookups, one table a query. The DEPTH best candidates of each query
are then ranked by exact distances on the original vectors.

Codes stay where they are encoded: rounds of at most BLOCK queries are broadcast to them, every task keeps the DEPTH best of its codes
for each query, and only these are sent on; a round's best candidates are then broadcast to the vectors, at most BLOCK * DEPTH ids, so that
no vector is moved to be compared. Of equal vectors a query can only return those with the smallest ids, so PART codes
offer at most k + 1 of them and a vector that fills a third of the table cannot crowd out others; that drops no possible answer.

Vectors that are null, zero, of another length than most of the sample (no distance is defined between lengths), or that hold null or
non-finite components take no part, nor do rows with a null id. Rows that repeat an id count as one, with the smallest of their
vectors. Equal distances go by vec_id. Fewer than k candidates are all returned; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.shared import materialise, table

BOOKS, ENTRIES, BEAM, SAMPLE, DEPTH = 16, 256, 4, 12_000, 600
BLOCK, PART = 1024, 65_536
ROUNDS, SWEEPS = 1, 4


class Codebooks:
    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.float32)  # (books, entries, dim)
        self._tables()

    def __getstate__(self) -> np.ndarray:
        return self.entries

    def __setstate__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self._tables()

    def _tables(self) -> None:
        entries = self.entries
        self.flat = self.entries.reshape(-1, entries.shape[2])
        self.cross = self.flat @ self.flat.T
        self.norms = (self.flat**2).sum(1).reshape(entries.shape[:2])

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, books). A state's cost is the squared distance less that of the vector, from inner products alone."""
        books, size, _ = self.entries.shape
        n, dots = len(x), (x @ self.flat.T).reshape(len(x), books, size)
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m in range(books):
            inner = np.zeros((n, codes.shape[1], size), np.float32)
            for j in range(m):
                inner += self.cross[j * size + codes[:, :, j], m * size : (m + 1) * size]
            step = cost[:, :, None] + self.norms[m] - 2 * dots[:, None, m] + 2 * inner
            step = step.reshape(n, -1)
            width = min(beam if m + 1 < books else 1, step.shape[1])
            best = np.argpartition(step, width - 1, axis=1)[:, :width]
            cost = np.take_along_axis(step, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // size)[:, :, None], 1), (best % size)[:, :, None]], 2)
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.entries[m][codes[:, m]] for m in range(len(self.entries)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            centres[:, d] = np.where(count > 0, np.bincount(near, x[:, d], k) / np.maximum(count, 1), centres[:, d])
    return centres


def fit_codebooks(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = ROUNDS, seed: int = 3) -> Codebooks:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    k = max(1, min(entries, len(x) // 4))
    rest, first = x.copy(), []
    for _ in range(books):
        first.append(_kmeans(rest, k, rng))
        rest -= first[-1][((first[-1] ** 2).sum(1) - 2 * rest @ first[-1].T).argmin(1)]
    model = Codebooks(np.stack(first))
    for _ in range(rounds):
        codes = np.concatenate([model.encode(x[lo : lo + 512]) for lo in range(0, len(x), 512)])
        table, rest = model.entries.copy(), x - model.decode(codes)
        for m in [*range(books)] * SWEEPS:  # each book's least squares with the others held
            rest += table[m][codes[:, m]]
            count = np.bincount(codes[:, m], minlength=k)
            for d in range(x.shape[1]):
                table[m][:, d] = np.where(count > 0, np.bincount(codes[:, m], rest[:, d], k) / np.maximum(count, 1), table[m][:, d])
            rest -= table[m][codes[:, m]]
        model = Codebooks(table)
    return model


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with v an array of doubles that may take part, one row for each id."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    ok = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    return rows.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v")).where(ok).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def encode_rows(vectors: DataFrame, model) -> DataFrame:
    """(vec_id, codes, norm, same) of every row; same is a hash of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                codes = model.value.encode(_matrix(part.column(1)).astype(np.float32))
                norms = (model.value.decode(codes) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(norms), part.column(2)], ["vec_id", "codes", "norm", "same"])

    return vectors.select("vec_id", "v", F.xxhash64("v").alias("same")).mapInArrow(run, "vec_id long, codes binary, norm float, same long")


def _top(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest by (score, id)."""
    if len(score) > n:
        limit = np.partition(score, n - 1)[n - 1]
        near = np.flatnonzero(score <= limit)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], score[near]))[:n]]


def _scored(codes: DataFrame, model, queries, k: int, depth: int) -> DataFrame:
    """(query_id, vec_id): the `depth` codes nearest to each of the broadcast queries."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (query_ids, q) = model.value, queries.value
        tables = (q @ m.flat.T).reshape(len(q), len(m.entries), -1)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(q)
        held: list[pa.RecordBatch] = []

        def take() -> None:
            t = pa.Table.from_batches(held)
            held.clear()
            ids, same = t["vec_id"].to_numpy(), t["same"].to_numpy()
            order = np.lexsort((ids, same))
            new = np.ones(len(order), bool)
            new[1:] = same[order][1:] != same[order][:-1]
            order = order[np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] <= k]
            ids, norm = ids[order], t["norm"].to_numpy()[order]
            code = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(t.num_rows, -1)[order].T.astype(np.intp)
            for i, lookup in enumerate(tables):
                found = norm - 2 * sum(lookup[b][c] for b, c in enumerate(code))
                top = _top(found, ids, depth + 1)
                both_ids, both = np.concatenate([best[i][0], ids[top]]), np.concatenate([best[i][1], found[top]])
                top = _top(both, both_ids, depth + 1)
                best[i] = both_ids[top], both[top]

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PART:
                take()
        if held:
            take()
        for i in range(0, len(q), 64):
            part = best[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[i : i + 64]), pa.array([b[0] for b in part], pa.list_(pa.int64())), pa.array([b[1].astype(float) for b in part], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        ids, scores = (t[c].combine_chunks().flatten().to_numpy() for c in ("ids", "scores"))
        ids, scores = (a[ids != key[0].as_py()] for a in (ids, scores))
        ids = ids[_top(scores, ids, depth)]
        return pa.table({"query_id": np.full(len(ids), key[0].as_py(), np.int64), "vec_id": ids.astype(np.int64)})

    found = codes.mapInArrow(score, "query_id long, ids array<long>, scores array<double>").where(F.size("ids") > 0)
    return found.groupBy("query_id").applyInArrow(gather, "query_id long, vec_id long")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, depth: int = DEPTH, model: Codebooks | None = None) -> DataFrame:
    """The k nearest rows found of each query: (query_id, rank, vec_id, score). rows and queries have vec_id and embedding."""
    spark = rows.sparkSession
    vectors, asked = usable(rows), usable(queries)
    if model is None:
        got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        sizes = pa.compute.list_value_length(got).to_numpy()
        dim = int(np.bincount(sizes).argmax()) if len(sizes) else 1
        sample = _matrix(got.filter(pa.array(sizes == dim))).astype(np.float32) if len(sizes) else np.ones((1, 1), np.float32)
        model = fit_codebooks(sample)
    dim = model.entries.shape[2]
    vectors, asked = (d.where(F.size("v") == dim) for d in (vectors, asked))
    shared = spark.sparkContext.broadcast(model)
    vectors, asked = materialise(vectors), materialise(asked)
    codes = materialise(encode_rows(vectors, shared))
    n_rounds = -(-asked.count() // (BLOCK * 3 // 4)) or 1  # queries are dealt by a hash, so rounds differ a little
    round_of = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_rounds))
    square = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
    exact = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for n in range(n_rounds):
        block = asked.where(round_of == n)
        some = block.toArrow()
        if some.num_rows:
            own = spark.sparkContext.broadcast((some["vec_id"].to_numpy(), _matrix(some["v"].combine_chunks()).astype(np.float32)))
            near = materialise(_scored(codes, shared, own, k, depth))
            own.destroy()
            pairs = vectors.join(F.broadcast(near), "vec_id").join(F.broadcast(block.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))), "query_id")  # a round's queries and candidates
            exact = exact.union(materialise(pairs.select("query_id", "vec_id", F.sqrt(square).alias("score"))))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_additive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"))
