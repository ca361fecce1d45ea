"""Phrase collocations, counted by pivot partitioning.

Words are ordered by their frequency in a language. An n-gram belongs to its rarest word, the pivot. For every occurrence of a word a
fragment goes to that word's partition: the words around it, cut off at the first one that is rarer, infrequent or beyond the piece.
Equal fragments of a slice of the text go as one with a count. In a partition n-grams around the pivot are cut out of the fragments and
counted where they lie, so each is counted in one place and no n-gram of rarer words is ever sent. An occurrence that holds its pivot
twice is counted at the first of them: to the left of the pivot words are strictly more frequent. A word that is very common is the pivot
of few different fragments, as these hold only words that are more common still.

Tasks need the order of words, whose number grows with the corpus. They get a count table of fixed size (two rows of BUCKETS
counts, 16 MB) of the frequent words, filled by hash: a word's place in the order is the lesser of its two counts, then its hash, then the
word itself. Collisions can only make a word look more frequent, which changes where n-grams are counted and how many fragments are cut
short, never what is counted.

Nulls: a null text is empty, a null language is `und`, and so is that word itself. A null doc_id is no matter, repeated rows count as often
as they come, an empty table gives an empty result. A very long text is one slice of its task. Other columns are ignored whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.shared import materialise, table
from shoal.llm.text import row_of, slices, words

LONGEST, LEAST, COVER, TOP = 3, 10, 50, 2000
BUCKETS = 1 << 20
SLICE_BYTES = 4 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Tokens:
    """The words of a slice: item[p] is the number of word p's (language, word) among `langs` and `words`, follows[p] whether it comes right
    after word p - 1 in one piece."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: pa.Array):
        data = _LOWER[data]
        starts, ends, first = words(data, offs, _APART)
        lengths = np.concatenate([[0], np.cumsum(ends - starts)])
        kept = np.ascontiguousarray(data[~_APART[data]])
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(kept)]).dictionary_encode()
        langs = langs.dictionary_encode()
        rows = row_of(first)
        n = max(len(coded.dictionary), 1)
        pair = langs.indices.to_numpy(zero_copy_only=False)[rows].astype(np.int64) * n + coded.indices.to_numpy(zero_copy_only=False)
        self.item, seen = pd.factorize(pair)
        self.langs, self.words = langs.dictionary.take(pa.array(seen // n)), coded.dictionary.take(pa.array(seen % n))
        breaks = np.cumsum(_BREAK[data], dtype=np.int64 if len(data) >> 31 else np.int32)[starts]  # a word's first byte is none
        self.follows = np.zeros(len(starts), bool)
        self.follows[1:] = (breaks[1:] == breaks[:-1]) & (rows[1:] == rows[:-1])


def tokens(batch: pa.RecordBatch) -> Iterator[Tokens]:
    """Tokens of a batch of (text, lang), slice by slice."""
    langs = pc.fill_null(batch.column(1), "und")
    for lo, hi, data, offs in slices(batch.column(0), SLICE_BYTES):
        yield Tokens(data, offs, langs.slice(lo, hi - lo))


def hashes(langs: pa.Array, found: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (language, word); a language has no tab in front of a word's, as words have none."""
    joined = pc.binary_join_element_wise(langs.cast(pa.large_string()), found.cast(pa.large_string()), pa.scalar("\t", pa.large_string()))
    return pd.util.hash_array(joined.to_numpy(zero_copy_only=False), categorize=False)


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(BUCKETS)).astype(np.int64), (h // np.uint64(BUCKETS) % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, n) of the words that occur `least` times at least, and for each language its number of words at a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tokens(batch):
                n = np.bincount(t.item, minlength=len(t.words))
                yield pa.RecordBatch.from_arrays([t.langs.cast(pa.string()), t.words.cast(pa.string()), pa.array(n)], ["lang", "word", "n"])
                total = pa.table({"lang": t.langs.cast(pa.string()), "n": n}).group_by("lang").aggregate([("n", "sum")])
                yield pa.RecordBatch.from_arrays([total["lang"].combine_chunks(), pa.nulls(total.num_rows, pa.string()), total["n_sum"].combine_chunks()], ["lang", "word", "n"])

    counted = docs.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("word").isNull() | (F.col("n") >= least))


def count_table(counts: DataFrame) -> np.ndarray:
    """Sums of word counts by hash in two rows of BUCKETS; at most that many sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            for b in buckets(hashes(batch.column(0), batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(b), own], ["bucket", "n"])

    sums = counts.where("word is not null").select("lang", "word", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BUCKETS, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def places(t: Tokens, sums: np.ndarray, least: int) -> np.ndarray:
    """Each item's place in the order of frequency, 0 for the most frequent; infrequent ones get the number of items."""
    h = hashes(t.langs, t.words)
    low, high = buckets(h)
    n = np.minimum(sums[low], sums[high])
    order = np.lexsort((h, -n))
    if len(h) > 1 and ((h[order][1:] == h[order][:-1]) & (n[order][1:] == n[order][:-1])).any():
        own = t.words.to_pylist()
        order = np.array(sorted(range(len(h)), key=lambda k: (-n[k], h[k], own[k])))
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    place[n < least] = len(h)
    return place


def fragments(docs: DataFrame, sums: np.ndarray, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, pivot, left, right, n_left, n_right, n): words around the occurrences of each word that are more frequent, up to longest - 1 on
    either side, equal ones of a slice as one row with their number."""
    sent = docs.sparkSession.sparkContext.broadcast(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tokens(batch):
                if not len(t.item):
                    continue
                none = len(t.words)
                place = np.append(places(t, sent.value, least), none + 1)
                item = np.concatenate([np.full(longest, none), t.item, np.full(longest, none)])
                follows = np.concatenate([np.zeros(longest, bool), t.follows, np.zeros(longest, bool)])
                at = np.flatnonzero(place[item] < none)
                own = place[item[at]]
                around = []
                for side in (-1, 1):
                    ok = np.ones(len(at), bool)
                    for k in range(1, longest):
                        beside = at + side * k
                        ok = ok & follows[beside + (side < 0)] & (place[item[beside]] < own + (side > 0))
                        around.append(np.where(ok, item[beside], none))
                around = [a[keep] for a in around] if not (keep := (around[0] < none) | (around[longest - 1] < none)).all() else around
                pivot = item[at][keep]
                code = pivot.astype(np.int64)
                for a in around:
                    code = pd.factorize(code * (none + 1) + a)[0]
                n = np.bincount(code)
                first = np.empty(len(n), np.int64)
                first[code[::-1]] = np.arange(len(code))[::-1]
                together = np.lexsort((around[longest - 1][first], around[0][first], pivot[first]))  # like rows side by side take less room in a shuffle
                first, n = first[together], n[together]
                texts = t.words.cast(pa.string())
                beside = [texts.take(pa.array(a[first], mask=a[first] == none)) for a in around]
                join = lambda parts: pc.utf8_trim(pc.binary_join_element_wise(*parts, " ", null_handling="replace", null_replacement=""), " ")
                left, right = join(beside[: longest - 1][::-1]), join(beside[longest - 1 :])
                sizes = [np.sum([a[first] < none for a in side], axis=0).astype(np.int32) for side in (around[: longest - 1], around[longest - 1 :])]
                chosen = pa.array(pivot[first])
                yield pa.RecordBatch.from_arrays([t.langs.cast(pa.string()).take(chosen), texts.take(chosen), left, right, pa.array(sizes[0]), pa.array(sizes[1]), pa.array(n)], ["lang", "pivot", "left", "right", "n_left", "n_right", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, pivot string, left string, right string, n_left int, n_right int, n long")


def mined(parts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, a) of all n-grams of 2 to `longest` words that occur `least` times at least. Fragments are dealt by pivot; n-grams
    are cut out and summed in the same stage, without another shuffle."""
    dealt = parts.repartition("lang", "pivot")
    grams = []
    for i in range(longest):
        for j in range(longest - i):
            if i + j:
                words_of = [F.substring_index("left", " ", -i)] * (i > 0) + [F.col("pivot")] + [F.substring_index("right", " ", j)] * (j > 0)
                gram = F.struct(F.concat_ws(" ", *words_of).alias("phrase"), F.lit(i + j + 1).alias("size"))
                grams.append(F.when((F.col("n_left") >= i) & (F.col("n_right") >= j), gram))
    cut = dealt.select("lang", "pivot", "n", F.explode(F.array(*grams)).alias("g")).where("g is not null")
    return cut.groupBy("lang", "pivot", F.col("g.phrase").alias("phrase"), F.col("g.size").alias("size")).agg(F.sum("n").alias("a")).where(F.col("a") >= least).select("lang", "phrase", "size", "a")


def part(phrase: Column, start: int, size: int) -> Column:
    """Words start to start + size of a phrase of words joined by spaces."""
    return F.substring_index(F.substring_index(phrase, " ", start + size), " ", -size)


def uncovered(found: DataFrame, longest: int = LONGEST, cover: int = COVER) -> DataFrame:
    """found without phrases of which `cover` percent or more stand in one longer phrase."""
    inner = [F.when(F.col("size") == m, F.struct(part(F.col("phrase"), s, k).alias("phrase"))) for m in range(3, longest + 1) for k in range(2, m) for s in range(m - k + 1)]
    if not inner:
        return found
    most = found.where("size > 2").select("lang", F.explode(F.array(*inner)).alias("p"), "a").where("p is not null").groupBy("lang", F.col("p.phrase").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = found.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    return kept.select("lang", "phrase", "size", "a")


def scored(kept: DataFrame, found: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the lowest-scoring cut. Counts below 10**16 are multiplied exactly as decimals of 38 digits; a
    larger one stops the query."""
    units = counts.where("word is not null").select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).union(found.where(F.col("size") < longest).select("lang", "phrase", "a"))
    cut = [F.when(F.col("size") == m, F.struct(F.lit(k).alias("k"), part(F.col("phrase"), 0, k).alias("first"), part(F.col("phrase"), k, m - k).alias("rest"))) for m in range(2, longest + 1) for k in range(1, m)]
    cuts = kept.select("lang", "phrase", "a", F.explode(F.array(*cut)).alias("c")).where("c is not null").select("lang", "phrase", "a", "c.*")
    both = cuts.join(units.toDF("lang", "first", "l"), ["lang", "first"]).join(units.toDF("lang", "rest", "r"), ["lang", "rest"])
    exact = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    score = F.expr(f"{exact('a')} * {exact('a')} * CAST(1000000 AS DECIMAL(7, 0)) DIV ({exact('l')} * {exact('r')})")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    return lowest.select("lang", "phrase", "a", "s.l", "s.r", "s.score")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first `top` rows with their rank; a language's rows are thinned to `top` in many parts before they meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    thin = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """docs(text, lang) to (lang, rank, phrase, a, l, r, n, score)."""
    counts = materialise(word_counts(docs, least))
    found = materialise(mined(fragments(docs, count_table(counts), longest, least), longest, least))
    best = ranked(scored(uncovered(found, longest, cover), found, counts, longest), top)
    totals = counts.where("word is null").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
inner2 AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner2 i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y FROM kept, (SELECT unnest([1, 2]) AS k) WHERE k < size),
s AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r.r AS r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
