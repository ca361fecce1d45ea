"""Exact substring deduplication by a sparse, distributed suffix sort.

A byte goes if a span of SPAN bytes that covers it starts anywhere else too. Sorting every suffix of the corpus is not needed to
know that: each span has an anchor, the position in it whose GRAM-byte hash is least. Equal spans have equal anchors at equal
places, so only suffixes whose anchors share a gram can agree on SPAN bytes.

1. Runs of neighbouring spans with one anchor make a row (gram hash, hash of the run's whole bytes). Counting these rows with
   map-side sums settles most of them: a gram seen once has no repeat, and a whole run seen twice is repeated throughout.
2. Of the rest, one row for each different run of a gram is sent to the gram's unit with its bytes. A unit is sorted by a
   mergesort of suffixes: polynomial prefix hashes and a binary search find the common extension of two suffixes in a
   logarithm of SPAN steps, and the next byte orders them. Neighbours that extend over SPAN bytes are repeats; their bytes are
   compared, so a collision of hashes is found out.
3. Grams with more than HOT different runs (a passage that very many documents share, each with neighbours of its own) don't meet
   in a unit. Their spans are hashed where they lie, repeats within a task are settled there, and one row for each other hash is
   dealt by that hash; two independent 64-bit hashes stand for the bytes there.
4. The spans found are merged per document and cut out.

Texts are UTF-8 bytes, null counts as empty; matches never cross documents; strings are judged on the input. Rows are told apart
by doc_id and text: rows that repeat both are separate documents, equal to each other. A null doc_id is returned as null. Runs of
very long texts are made piece by piece, so no array is longer than a piece; a text may have up to 2 GB. Of tied hashes the first place
is the anchor. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.shared import table
from shoal.llm.text import Polynomial, WindowKeys, mix, slices, span_hashes

SPAN, GRAM = 400, 128
HOT, HOT_BUCKETS, HOT_FLUSH = 256, 256, 500_000
UNIT_BYTES, PIECE = 1 << 20, 1 << 22
_FIRST, _SECOND, _KEYS = Polynomial(51), Polynomial(52), WindowKeys(50)
_PLACE = 28
_WINDOW = np.dtype([("one", "<u8"), ("two", "<u8"), ("did", "<i8"), ("row", "<i8"), ("start", "<i8"), ("quiet", "?")])
_NO_ID = -(1 << 63)


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of spans with one anchor: row, first start, last start, anchor (counted from the row's start), gram hash, run hash."""
    lengths = np.diff(offs)
    ok = lengths >= SPAN
    if not ok.any():
        return *(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2))
    n, width = len(data) - GRAM + 1, SPAN - GRAM + 1
    grams = _KEYS.of(data, GRAM)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(n, dtype=np.uint64)
    ahead = np.minimum.accumulate(blocks.reshape(-1, width), axis=1).ravel()
    behind = np.minimum.accumulate(blocks.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int8)
    inside[offs[:-1][ok]] += 1
    inside[offs[1:][ok] - SPAN + 1] -= 1
    valid = np.cumsum(inside[:-1], dtype=np.int8) > 0
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    change[offs[:-1][ok]] = True
    cuts = np.flatnonzero(change)
    keep = valid[cuts[:-1]]
    first, last = cuts[:-1][keep], cuts[1:][keep] - 1
    a = at[first]
    row = np.searchsorted(offs, first, "right") - 1
    shape = mix(((a - first) * 1024 + (last - first)).astype(np.uint64))
    whole = mix(span_hashes(data, first, last + SPAN, 53) + shape)
    return row, first - offs[row], last - offs[row], a - offs[row], grams[a], whole


def _long_pieces(data: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of one text that share SPAN - 1 bytes with the next, so that each span lies in exactly one."""
    for lo in range(0, max(len(data) - SPAN + 1, 1), limit):
        yield lo, data[lo : lo + limit + SPAN - 1]


def runs(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """docs(did, row, text) to one row for each run of spans with one anchor; a text longer than a slice is cut into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(2)):
                parts = [(0, data, offs)] if hi - lo > 1 else [(p, d, np.array([0, len(d)])) for p, d in _long_pieces(data, piece)]
                for base, d, o in parts:
                    r, first, last, a, gram, whole = anchors(d, o)
                    take = pa.array(lo + r)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x.view(np.int64)) for x in (gram, whole)), pa.array(first + base), pa.array((last - first).astype(np.int32)), pa.array((a - first).astype(np.int32))],
                        ["did", "row", "gram", "whole", "first", "more", "ahead"],
                    )

    return docs.mapInArrow(run, "did long, row long, gram long, whole long, first long, more int, ahead int")


def _compare(prefix: np.ndarray, data: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common extension of the suffixes at x and y, up to SPAN, and whether the first is less."""
    common, most = np.zeros(len(x), np.int64), np.full(len(x), SPAN)
    for _ in range(SPAN.bit_length()):
        mid = (common + most + 1) >> 1
        same = _FIRST.spans(prefix, x, x + mid) == _FIRST.spans(prefix, y, y + mid)
        common, most = np.where(same, mid, common), np.where(same, most, np.maximum(mid - 1, common))
    short = np.minimum(common, SPAN - 1)
    return common, (common < SPAN) & (data[x + short] < data[y + short])


def merge_sorted(prefix: np.ndarray, data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Suffix starts, already together by group, in order of their SPAN bytes within each group: a bottom-up mergesort whose
    merges place every element of a run by binary search in the neighbouring run."""
    order = np.arange(len(starts))
    lo_of = np.searchsorted(group, group, "left")
    hi_of = np.searchsorted(group, group, "right")
    width, largest = 1, int((hi_of - lo_of).max(initial=0))
    while width < largest:
        at = np.flatnonzero(hi_of - lo_of > width)
        place = at - lo_of[at]
        index, own = place // width, place % width
        left = index % 2 == 0
        lo = np.minimum(lo_of[at] + (index + np.where(left, 1, -1)) * width, hi_of[at])
        hi = np.minimum(lo + width, hi_of[at])
        base = lo.copy()
        me = starts[order[at]]
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            other = starts[order[mid]]
            x, y = np.where(left[live], other, me[live]), np.where(left[live], me[live], other)
            less = _compare(prefix, data, x, y)[1]
            before = np.where(left[live], less, ~less)  # the other run's element goes first
            lo[live] = np.where(before, mid + 1, lo[live])
            hi[live] = np.where(before, hi[live], mid)
            live = live[lo[live] < hi[live]]
        moved = order.copy()
        moved[lo_of[at] + index // 2 * 2 * width + own + lo - base] = order[at]
        order, width = moved, 2 * width
    return order


def repeats(data: np.ndarray, begin: np.ndarray, n: np.ndarray, ahead: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """For spans' bytes laid end to end (run i starts at begin[i] and holds n[i] spans), which spans occur in another run of
    their unit. Returned per span, run by run."""
    run = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    starts = begin[run] + within
    group = unit[run] * 2048 + within - ahead[run] + 1024
    together = np.argsort(group, kind="stable")
    prefix = _FIRST.prefix(data)
    order = together[merge_sorted(prefix, data, starts[together], group[together])]
    x, y = order[:-1], order[1:]
    near = np.flatnonzero(group[x] == group[y])
    x, y = x[near], y[near]
    full = _compare(prefix, data, starts[x], starts[y])[0] == SPAN
    x, y = x[full], y[full]
    # Verification: all bytes of the first of neighbouring spans of one pair of runs, and of each other its last byte.
    by_pair = np.lexsort((within[x], run[y], run[x]))
    x, y = x[by_pair], y[by_pair]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (run[x][1:] != run[x][:-1]) | (run[y][1:] != run[y][:-1]) | (within[x][1:] != within[x][:-1] + 1) | (within[y][1:] != within[y][:-1] + 1)
    good = data[starts[x] + SPAN - 1] == data[starts[y] + SPAN - 1]
    for lo in range(0, int(fresh.sum()), 4096):
        f = np.flatnonzero(fresh)[lo : lo + 4096]
        good[f] = (data[starts[x[f]][:, None] + np.arange(SPAN)] == data[starts[y[f]][:, None] + np.arange(SPAN)]).all(1)
    good = np.minimum.reduceat(good, np.flatnonzero(fresh))[np.cumsum(fresh) - 1] if len(x) else good
    out = np.zeros(len(run), bool)
    out[x[good]] = out[y[good]] = True
    return out


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [lo, hi) as maximal intervals, touching ones joined."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    return lo[new], reach[np.append(new[1:], True)] if len(lo) else reach


_PASSED = "kind int, unit long, did long, row long, lo long, hi long, ahead int, solved boolean, data binary"


def _passed(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], [c.split()[0] for c in _PASSED.split(", ")])


def _hot_out(held: list[np.ndarray]) -> list[tuple]:
    """Spans of hot grams: those met twice here are settled; one row of each hash goes to the bucket of the hash."""
    w = np.concatenate(held)
    w = w[np.lexsort((~w["quiet"], w["two"], w["one"]))]
    new = np.ones(len(w), bool)
    new[1:] = (w["one"][1:] != w["one"][:-1]) | (w["two"][1:] != w["two"][:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(w)))
    twice = np.repeat(size > 1, size)
    mine = w[twice & ~w["quiet"]]
    rows = []
    for did, row in set(zip(mine["did"].tolist(), mine["row"].tolist(), strict=True)):
        own = mine["start"][(mine["did"] == did) & (mine["row"] == row)]
        rows += [(2, row, did, row, lo, hi, 0, True, None) for lo, hi in zip(*(e.tolist() for e in _merged(own, own + SPAN)), strict=True)]
    sent = w[new]
    sent["quiet"] |= size > 1
    bucket = sent["one"] % np.uint64(HOT_BUCKETS)
    for b in np.unique(bucket):
        rows.append((1, int(b), 0, 0, 0, 0, 0, False, sent[bucket == b].tobytes()))
    return rows


def _collect(joined: DataFrame, most: int) -> DataFrame:
    """(did, row, text, found) to the spans that are settled already (kind 2), runs to be sorted (0) and hot spans (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[np.ndarray] = []
        for batch in batches:
            rows: list[tuple] = []
            for did, row, text, found in zip(*batch.columns, strict=True):
                did, row, f = did.as_py(), row.as_py(), found.values
                first, more, ahead, n, m, rep, gram = (f.field(c).to_numpy(zero_copy_only=False) for c in ("first", "more", "ahead", "n", "m", "rep", "gram"))
                settled = n > 1
                lo, hi = _merged(first[settled], first[settled] + more[settled] + SPAN)
                rows += [(2, row, did, row, a, b, 0, True, None) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                raw = text.as_buffer()
                for i in np.flatnonzero((m > 1) & (rep | ~settled)):
                    a, b = int(first[i]), int(first[i] + more[i]) + SPAN
                    if m[i] <= most:
                        rows.append((0, int(gram[i]), did, row, a, b, int(ahead[i]), bool(settled[i]), raw[a:b].to_pybytes()))
                        continue
                    d = np.frombuffer(raw, np.uint8, b - a, a)
                    s = np.arange(b - a - SPAN + 1)
                    w = np.zeros(len(s), _WINDOW)
                    place = mix((s - int(ahead[i])).astype(np.uint64) + np.uint64(int(gram[i]) & (1 << 64) - 1))
                    for name, poly in (("one", _FIRST), ("two", _SECOND)):
                        w[name] = mix(poly.spans(poly.prefix(d), s, s + SPAN) + place)
                    w["did"], w["row"], w["start"], w["quiet"] = did, row, s + a, settled[i]
                    hot.append(w)
            if sum(map(len, hot)) > HOT_FLUSH:
                rows += _hot_out(hot)
                hot = []
            yield _passed(rows)
        if hot:
            yield _passed(_hot_out(hot))

    return joined.mapInArrow(run, _PASSED)


def _resolve(passed: DataFrame) -> DataFrame:
    """Rows that lie together by (kind, unit) to repeated intervals (did, row, lo, hi)."""
    names = ["did", "row", "lo", "hi"]

    def out(did, row, lo, hi) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (did, row, lo, hi)], names)

    def sort_units(t: pa.Table) -> Iterator[pa.RecordBatch]:
        did, row, lo, hi, ahead, solved, gram = (t[c].to_numpy() for c in ("did", "row", "lo", "hi", "ahead", "solved", "unit"))
        unit = np.unique(gram, return_inverse=True)[1]
        n = hi - lo - SPAN + 1
        begin = np.cumsum(hi - lo) - (hi - lo)
        hit = repeats(np.frombuffer(b"".join(t["data"].to_pylist()), np.uint8), begin, n, ahead, unit)
        hit &= ~np.repeat(solved, n)
        edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        run = np.repeat(np.arange(len(n)), n)
        cut = np.zeros(len(hit), bool)
        cut[np.cumsum(n)[:-1]] = True  # a run's first span starts an interval of its own
        start = np.flatnonzero(hit & ((edge[:-1] == 1) | cut))
        stop = np.flatnonzero(hit & ((edge[1:] == -1) | np.append(cut[1:], False)))
        shift = (np.cumsum(n) - n)[run]
        yield out(did[run[start]], row[run[start]], lo[run[start]] + start - shift[start], lo[run[stop]] + stop - shift[stop] + SPAN)

    def match_hot(t: pa.Table) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(b"".join(t["data"].to_pylist()), _WINDOW)
        w = w[np.lexsort((w["two"], w["one"]))]
        new = np.ones(len(w), bool)
        new[1:] = (w["one"][1:] != w["one"][:-1]) | (w["two"][1:] != w["two"][:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(w)))
        w = w[np.repeat(size > 1, size) & ~w["quiet"]]
        yield out(w["did"], w["row"], w["start"], w["start"] + SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from (sort_units if held[0]["kind"][0].as_py() == 0 else match_hot)(pa.Table.from_batches(held))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, unit = batch["kind"].to_numpy(), batch["unit"].to_numpy()
            done = kind == 2
            if done.any():
                yield batch.filter(pa.array(done)).select(names)
            cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]) | (kind[1:] != kind[:-1])) + 1), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if kind[lo] == 2:
                    continue
                last = held[-1] if held else None
                other = last is not None and (last["kind"][0].as_py(), last["unit"][0].as_py()) != (kind[lo], unit[lo])
                if other and (size > UNIT_BYTES or kind[lo] == 1):
                    yield from flush()
                    size = 0
                held.append(batch.slice(lo, hi - lo))
                size += sum(len(v.as_buffer()) for v in batch["data"].slice(lo, hi - lo))
        yield from flush()

    return passed.repartition("kind", "unit").sortWithinPartitions("kind", "unit").mapInArrow(run, "did long, row long, lo long, hi long")


def repeated_spans(docs: DataFrame, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """docs(did, row, text) to (did, row, text, spans): repeated intervals of each text, not merged; null where there are none."""
    found = runs(docs, piece)
    token = F.xxhash64("did", "row", "first")
    seen = found.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(token).alias("token"))
    grams = seen.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where("total > 1").select("gram", "m")
    known = seen.join(grams, "gram")
    facts = F.struct("first", "more", "ahead", "n", "m", (token == F.col("token")).alias("rep"), "gram")
    listed = found.join(known, ["gram", "whole"]).groupBy("did", "row").agg(F.collect_set(facts).alias("found"))  # a set: rows equal in id and text have the same runs
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.repartition(parts, "did", "row")
    joined = texts.join(listed.hint("shuffle_hash"), ["did", "row"]).select("did", "row", "text", "found")
    spans = _resolve(_collect(joined, hot)).groupBy("did", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return texts.join(spans.hint("shuffle_hash"), ["did", "row"], "left").select("did", "row", "text", "spans")


def remove_repeats(docs: DataFrame, with_bytes: bool = False, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeat[, kept]; kept holds the remaining bytes."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeat boolean" + ", kept binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw, lo, hi = text.as_buffer(), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if spans.is_valid:
                    lo, hi = _merged(*(spans.values.field(c).to_numpy() for c in ("lo", "hi")))
                kept = b"".join(raw[a:b].to_pybytes() for a, b in zip(np.append(0, hi).tolist(), np.append(lo, len(raw)).tolist(), strict=True))
                rows.append((None if did == _NO_ID else did, len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), len(kept) < len(raw), *([kept] if with_bytes else [])))
            types = [pa.int64()] * 4 + [pa.string(), pa.bool_()] + [pa.binary()] * with_bytes
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return repeated_spans(keyed, hot, piece).select("did", "text", "spans").mapInArrow(run, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
