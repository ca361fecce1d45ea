"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents (pieces, where one is longer than a sequence) and gaps are whole numbers up to the capacity, so the range sort of
either is run-length coded: one row per length with a count, one row per gap with runs of sequences. Each bulk-synchronous
round takes all pieces of the next length at once, sweeps for the successor among the gaps (the smallest that holds the
length), gives the pieces places by their rank within the length, updates the gaps and repeats. The rounds thus read a
histogram of at most `capacity` rows, whatever the size of the corpus; the result is that of best-fit decreasing. Pieces that fill a
sequence, which are most of a corpus of long documents, take part in no round and get numbers of their own where they lie. Ranks
of the others are dealt by Spark: a length has SALTS salts and one more for every SHARE pieces, pieces are counted per (length, salt), prefix sums over
the salts give each (length, salt) its first rank, and a row number within (length, salt) the rest, so no length meets in one task.

Every run of sequences is split at most twice a round and each visit halves its gap at least, so a plan has at most
4 * capacity * log2(capacity) steps (3 MB for 2,048): that bounds what is broadcast.

A null text is empty, which is the closing id alone; a null doc_id stays null. Repeated rows are packed once each; pieces that tie in
doc_id, piece and ids share ranks in any order, which changes only which of the equal pieces lies where. A very long text is
tokenised whole, by the task that reads it. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.shared import materialise, table

CAPACITY, END_ID, SALTS, SHARE = 2048, 0, 32, 1_000_000
#: Characters on which both tokenizer libraries agree for certain: Latin letters, ASCII and common typographic marks.
_PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e\xa0-ɏ‐-‧‰-›€]*")


def encoder(json_path: str, ranks_path: str | None = None) -> Callable[[str], list[int]]:
    """Ids as the tokenizer file gives them without special tokens added. With `ranks_path`, the same vocabulary as a rank
    file, texts of plain characters go to the faster library, which gives the same ids for them."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and not any(s in text for s in special):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, json_name: str = "byte_bpe_50k.json", ranks_name: str | None = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; the first piece of a long one takes the remainder."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(public_tokenizers.path(json_name), ranks_name and public_tokenizers.path(ranks_name))
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                first = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first + k * capacity]
                    for column, value in zip(out, (doc_id, k, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=False):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, first sequence, pieces a sequence, first offset) of best-fit decreasing over a histogram."""
    gaps: dict[int, deque] = {}
    order: list[int] = []  # gaps with open runs, ascending
    steps, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, deque()).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                first, n, gap = opened, -(-left // (capacity // length)), capacity
                opened += n
            else:
                gap = order[at]
                first, n = gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0  # fewer pieces than a sequence of this run holds
            steps.append((length, rank, first, each, capacity - gap))
            put(gap - each * length, first, full)
            if rest:
                put(gap - rest * length, first + full, 1)
            put(gap, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return steps


def pack(parts: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """parts (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset; parts should be a checkpoint or a table, as the numbers
    of full pieces are those of their places in it."""
    spark = parts.sparkSession
    full = parts.where(F.col("length") == capacity).select(*[F.col(f"`{c}`") for c in parts.columns], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # fewer than capacity rows
    salts = spark.createDataFrame([(k, SALTS + n // share) for k, n in histogram.items()], "length long, salts int")
    salted = rest.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int"))
    bases, before = [], {}
    for r in sorted(salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()):  # capacity * SALTS rows, and one for every `share` pieces
        bases.append((r["length"], r["salt"], before.get(r["length"], 0)))
        before[r["length"]] = before.get(r["length"], 0) + r["n"]
    steps: dict[int, list] = {}
    for length, *step in plan(histogram, capacity):
        steps.setdefault(length, []).append(tuple(step))
    ranks = spark.createDataFrame(bases, "length long, salt int, base long")
    places = spark.createDataFrame(list(steps.items()), "length long, steps array<struct<rank: long, first: long, each: long, offset: long>>")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(F.broadcast(ranks), ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    placed = ranked.join(F.broadcast(places), "length").withColumn("step", F.element_at(F.filter("steps", lambda s: s["rank"] <= F.col("rank")), -1))
    ahead = F.col("rank") - F.col("step.rank")
    return placed.select(
        *[F.col(f"`{c}`") for c in parts.columns],
        (F.col("step.first") + F.floor(ahead / F.col("step.each"))).cast("long").alias("sequence_id"),
        (F.col("step.offset") + F.pmod(ahead, F.col("step.each")) * F.col("length")).cast("long").alias("offset"),
    ).unionByName(full)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialise(pieces(table(spark, sf_dir, "documents"))))
