"""Near-duplicate detection with b-bit MinHash.

Every text's set of word shingles gets PERMS minima. Bands of ROWS whole minima generate candidates; of each minimum BITS low bits
are retained and packed into words of 64, and the share of equal b-bit groups, counted by xor and bit count and corrected for
chance collisions, estimates the similarity. Candidates whose estimate is MARGIN standard errors under the threshold go; the
rest is confirmed on the full sets. With 32 bands of 5 a pair at similarity 0.85 misses all bands once in 10**8, at 0.8 once in
300,000.

Groups may be of any size, so pairs are never listed within a group:
1. texts with equal sets form a class, represented by its smallest doc_id;
2. in each band bucket every representative is a candidate of the bucket's smallest one only; confirmed links give components;
3. buckets that still hold several components are compared in full, in blocks of bounded size, between components only, first by
   the packed signatures, then on the sets; a task returns no more links than it has members. So no link is lost to step 2.

Null and empty texts have no shingles and link with nothing. Rows with a null doc_id link with nothing and have a null component.
Rows that share a doc_id count as one document. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.shared import materialise, table
from shoal.llm.text import constants, mix, row_of, shingles, slices, word_hashes, words
from shoal.operators.lineage import components

BANDS, ROWS, BITS, MARGIN = 32, 5, 4, 5.0
PERMS = BANDS * ROWS
WORDS64 = PERMS * BITS // 64
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
_MUL = (constants(41, PERMS) >> np.uint64(32)) | np.uint64(1)
_ADD = constants(42, PERMS) >> np.uint64(32)
_ONES = 0x1111111111111111


def sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in ascending order, and the index of each row's first."""
    starts, ends, first = words(data, offs)
    hashes, at = shingles(word_hashes(data, starts, ends, 31, fold_case=True), first, k)
    rows = row_of(at)
    order = np.lexsort((hashes, rows))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=len(offs) - 1))])


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """PERMS minima of each row that has a shingle, by 32-bit multiply-add permutations of the hashes' upper half."""
    low, full = hashes >> np.uint64(32), at[:-1][np.diff(at) > 0]
    if not len(full):
        return np.zeros((0, PERMS), np.uint64)
    return np.stack([np.minimum.reduceat((low * m + a) & np.uint64(0xFFFFFFFF), full) for m, a in zip(_MUL, _ADD, strict=True)], 1)


def packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of each minimum (after mixing, as a minimum's own low bits are not uniform), 16 to a word."""
    low = (mix(minima) & np.uint64((1 << BITS) - 1)).reshape(len(minima), WORDS64, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(minima: np.ndarray) -> np.ndarray:
    rolled = (minima.reshape(len(minima), BANDS, ROWS) * constants(43, ROWS)).sum(2, dtype=np.uint64)
    return mix(rolled + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    seen = chance + (1 - chance) * threshold
    return threshold - MARGIN * (seen * (1 - seen) / PERMS) ** 0.5 / (1 - chance)


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures (arrays of long) by bit counts."""
    differing = F.lit(0)
    for i in range(WORDS64):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(_ONES)))
    chance = 2.0**-BITS
    return ((1 - differing / F.lit(float(PERMS))) - chance) / (1 - chance)


def features(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature, bands); set_id is a 128-bit identity of the set, null without shingles."""
    schema = "doc_id long, n_shingles long, set_id binary, signature array<long>, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                hashes, at = sets(data, offs, k)
                n, minima = np.diff(at), signatures(hashes, at)
                full = n > 0
                sums = np.stack([np.add.reduceat(mix(hashes ^ np.uint64(s)), at[:-1][full]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], 1) if full.any() else np.zeros((0, 2), np.uint64)
                place = np.where(full, np.cumsum(full) - 1, -1)

                def rows(values: np.ndarray, full: np.ndarray = full, place: np.ndarray = place) -> pa.Array:
                    width = values.shape[1]
                    starts = pa.array(np.append(np.maximum(np.cumsum(full) - full, 0), full.sum()).astype(np.int32) * width, mask=np.append(~full, False))
                    return pa.ListArray.from_arrays(starts, pa.array(values.astype(np.int64).ravel()))

                ids = pa.array([sums[p].tobytes() if p >= 0 else None for p in place], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), ids, rows(packed(minima)), rows(band_keys(minima))], ["doc_id", "n_shingles", "set_id", "signature", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, members): the full shingle sets, as bytes of ascending 64-bit hashes, of documents whose id is in wanted(rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                hashes, at = sets(data, offs, k)
                members = pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), members], ["rep", "members"])

    return docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(run, "rep long, members binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b, set_a, set_b) to the pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _units(members: DataFrame) -> DataFrame:
    """members(key, rep, component, n_shingles) of mixed buckets dealt to units (key, i, j) of two blocks at most; a bucket of one block
    is one unit."""
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _by_unit(df: DataFrame, work, schema: str) -> DataFrame:
    """work(key, table of one unit) over units that lie together; a unit is bounded by two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def unit(b: pa.RecordBatch, r: int) -> tuple:
            return b["key"][r].as_py(), b["i"][r].as_py(), b["j"][r].as_py()

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and unit(held[0], 0) != unit(batch, lo):
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(run, schema)


def _lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _open_pairs(t: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the earlier ones of another component whose estimate may reach the threshold, in the first bucket that
    the two share and in one unit of it only."""
    comp, block = t["component"].to_numpy(), t["block"].to_numpy()
    key, i, j = (t[c][0].as_py() for c in ("key", "i", "j"))
    sig, bands = _lists(t["signature"], WORDS64).view(np.uint64), _lists(t["bands"], BANDS)
    if (comp == comp[0]).all():
        return
    chance = 2.0**-BITS
    most = (1 - (chance + (1 - chance) * least)) * PERMS
    for x in range(1, len(comp)):
        y = np.flatnonzero((comp[:x] != comp[x]) & ((i == j) | (block[:x] != block[x])))
        if not len(y):
            continue
        d = sig[y] ^ sig[x]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        y = y[np.bitwise_count(d & np.uint64(_ONES)).sum(1) <= most]
        if len(y):
            first = (bands[y] == bands[x]).argmax(1)
            y = y[bands[x][first] == key]
        if len(y):
            yield x, y


def across(members: DataFrame, reps: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between components of mixed buckets: members(key, rep, component, n_shingles). What is wide, signatures and bands of
    reps(rep, signature, bands), joins the dealt rows, so that it moves once."""
    least = least_estimate(percent / 100)
    columns = "key long, rep long, component long, signature array<long>, bands array<long>, block int, i int, j int"

    def active(t: pa.Table) -> Iterator[pa.RecordBatch]:
        used = np.zeros(t.num_rows, bool)
        for x, y in _open_pairs(t, least):
            used[x] = used[y] = True
        yield from t.filter(pa.array(used)).to_batches()

    def verify(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, comp = t["rep"].to_numpy(), t["component"].to_numpy()
        own = [np.frombuffer(b.as_buffer(), np.uint64) for b in t["members"].combine_chunks()]
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for x, ys in _open_pairs(t, least):
            for y in ys:
                cx, cy = find(int(comp[x])), find(int(comp[y]))
                if cx != cy and similar(own[x], own[y], percent):
                    root[max(cx, cy)] = min(cx, cy)
                    out.append((int(rep[x]), int(rep[y])))
        yield pa.RecordBatch.from_arrays([pa.array([p[q] for p in out], pa.int64()) for q in (0, 1)], ["a", "b"])

    names = [c.split()[0] for c in columns.split(", ")]
    live = materialise(_by_unit(_units(members).join(reps, "rep").select(*names), active, columns))
    return _by_unit(live.join(full, "rep").select(*names, "members"), verify, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_shingles, component_id, kept) for every row."""
    feats = materialise(features(docs, k))
    classes = feats.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    reps = materialise(feats.join(classes, (feats["set_id"] == classes["set_id"]) & (feats["doc_id"] == classes["rep"])).select("rep", "n_shingles", "signature", "bands"))
    buckets = reps.select("rep", F.col("n_shingles").cast("int").alias("n_shingles"), F.explode("bands").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("top")).where("head < top").select("key", "head")
    shared = materialise(buckets.join(heads, "key"))
    full = materialise(full_sets(docs, shared.select("rep").distinct(), k))
    signed = reps.select("rep", "signature")
    star = shared.where("rep != head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    star = star.join(signed.toDF("a", "sig_a"), "a").join(signed.toDF("b", "sig_b"), "b").where(estimate(F.col("sig_a"), F.col("sig_b")) >= least_estimate(percent / 100)).select("a", "b")
    links = confirmed(star.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b"), percent)
    found = components(links)
    named = shared.select("key", "rep", "n_shingles").join(found.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    more = across(named.join(mixed, "key"), reps.select("rep", "signature", "bands"), full, percent)
    named_by = found.toDF("node", "component")
    linked = more.join(named_by.toDF("a", "ca"), "a", "left").join(named_by.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(linked).toDF("component", "final")
    nodes = found.join(second, "component", "full").select(F.coalesce("node", "component").alias("rep"), F.coalesce("final", "component").alias("component_id"))
    of_set = classes.join(nodes, "rep", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id"))
    out = feats.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one document of each group of near duplicates (that of the smallest doc_id), all columns kept. Of rows that
    repeat a doc_id the one of smallest hash stays, the same on every run. Rows with a null doc_id stay."""
    kept = near_duplicates(docs, k, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    row, least = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    single = rows.groupBy("doc_id").agg(F.min_by(row, least).alias("_row")).select("_row.*")
    return single.unionByName(docs.where("doc_id is null"))
