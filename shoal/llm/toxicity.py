"""Toxicity scores from subword bags.

A word is the bag of its byte n-grams (3 to 5, with word boundaries, hashed to buckets); bucket vectors are averaged per word
and over the places of a window of `WINDOW` words, where a word that repeats one of the window counts once, and go through a
linear softmax. Vectors and softmax are trained jointly in numpy with AdaGrad.
Misspellings that were never seen share most n-grams with their word, so they share its vectors; half the n-grams are dropped at
random while training, so that no single one carries a word. A label marks a document, not a place in it: after a first phase on
all windows, only windows of toxic documents that the model itself finds toxic, one at least, stay positive, against the
windows of other documents that it finds most toxic and as many random ones. A document's score is that
of its highest window. As the softmax is linear, scoring folds each bucket's vector to one number and reads every text once.

The model is fitted on at most MAX_POSITIVE and MAX_NEGATIVE labelled rows (those of smallest hashed id) and at most MAX_WINDOWS
windows of each, all three parameters of fit; scores come from all windows of all texts. It holds BUCKETS numbers (1 MB) whatever the size of the corpus, which bounds its broadcast.

Null and empty texts, and all texts where no labelled row of both classes exists, score the prior (0 without positives).
Repeated rows score alike, as do ties; a very long text is scored by all its windows; an empty table gives no rows. Labels with a null id or mark are ignored; of several labels for an id the highest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.shared import table
from shoal.llm.text import Polynomial, mix, row_of, slices, words

MAX_POSITIVE, MAX_NEGATIVE, MAX_WINDOWS = 1200, 2400, 96
WINDOW, STRIDE, GRAMS = 16, 8, (3, 4, 5)
BUCKETS, DIM, BATCH, RATE, KEEP = 1 << 17, 8, 256, 0.3, 0.5
FIRST_WINDOWS, NEXT_EPOCHS = 200_000, 4  # the first phase sees so many windows, or each once
THRESHOLD = 0.3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_HASH = Polynomial(21, fold_case=True)


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n the bucket at every position of the words laid end to end with a boundary byte on both sides and whether an
    n-gram of one word starts there; and the index of each word's first position."""
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths + 2)])
    laid = np.full(at[-1], 0x20, np.uint32)
    word = np.repeat(np.arange(len(starts), dtype=np.int64), lengths)
    within = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    laid[at[word] + 1 + within] = _LOWER[data[starts[word] + within]]
    left = (np.repeat(at[1:], lengths + 2) - np.arange(at[-1])).astype(np.int32)  # positions to the end of the word
    out, h = [], laid.copy()
    for n in range(2, GRAMS[-1] + 1):
        whole = max(len(h) - n + 1, 0)
        h[:whole] = h[:whole] * np.uint32(0x01000193) + laid[n - 1 :]
        if n in GRAMS:
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            out.append(((g >> np.uint32(9)) & np.uint32(BUCKETS - 1), left >= n))
    return out, at[:-1]


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0)
    by_n, at = grams(data, starts, ends)
    total = np.zeros(len(by_n[0][0]), np.float32)
    count = np.zeros(len(total), np.float32)
    for bucket, valid in by_n:
        total += weight[bucket] * valid
        count += valid
    return np.add.reduceat(total, at) / np.add.reduceat(count, at)


def fresh(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which words are none of the WINDOW - 1 words before them in their row."""
    words_at = _HASH.spans(_HASH.prefix(data), starts, ends)
    out = np.ones(len(starts), bool)
    for back in range(1, min(WINDOW, len(starts))):
        out[back:] &= (words_at[back:] != words_at[:-back]) | (rows[back:] != rows[:-back])
    return out


def windows(n_words: int) -> np.ndarray:
    """First words of the windows of a text; the last window ends with the text."""
    last = max(n_words - WINDOW, 0)
    return np.unique(np.append(np.arange(0, last, STRIDE), last))


def score(data: np.ndarray, offs: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """The highest window's probability of each row."""
    starts, ends, first = words(data, offs)
    counted = word_scores(data, starts, ends, weight) * fresh(data, starts, ends, row_of(first))
    sums = np.concatenate([[0], np.cumsum(counted.astype(float))])
    n = np.diff(first)
    best = np.full(len(n), bias)
    last = np.maximum(n - WINDOW, 0)
    k = -(-last // STRIDE) + 1  # windows of each row
    rows = np.repeat(np.arange(len(n)), k)
    lo = np.minimum((np.arange(len(rows)) - np.repeat(np.cumsum(k) - k, k)) * STRIDE, last[rows])
    hi = np.minimum(lo + WINDOW, n[rows])
    mean = (sums[first[rows] + hi] - sums[first[rows] + lo]) / WINDOW
    if len(n):
        best = np.maximum.reduceat(mean, np.cumsum(k) - k) + bias
    return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def train(texts: pa.Array, docs: np.ndarray, labels: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Windows of labelled documents to (number of each bucket, bias). docs: the document of each window."""
    labels = labels.astype(np.int64)
    if not labels.any() or labels.all():
        return np.zeros(BUCKETS, np.float32), -30.0 if not labels.any() else 0.0
    found, base = [], 0
    for _, _, data, offs in slices(texts):
        starts, ends, first = words(data, offs)
        found.append((_HASH.spans(_HASH.prefix(data), starts, ends), starts + base, ends + base, np.diff(first), data))
        base += len(data)
    spans, starts, ends, sizes, data = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.concatenate([[0], np.cumsum(sizes)])
    hashes, at, word = np.unique(spans, return_index=True, return_inverse=True)
    del found, spans
    once = np.unique(row_of(first) * len(hashes) + word)  # a word counts once a window
    bag, window = (once % len(hashes)).astype(np.int32), once // len(hashes)
    bag_first = np.searchsorted(window, np.arange(len(texts) + 1))
    del word, window, once
    lengths = (ends - starts)[at]
    by_n, _ = grams(data, starts[at], ends[at])
    valid = np.stack([v for _, v in by_n], 1)
    gram_bucket = np.stack([b for b, _ in by_n], 1)[valid].astype(np.int32)  # word by word
    ends_at = np.cumsum(lengths + 2)
    gram_first = np.concatenate([[0], np.cumsum(valid.sum(1, dtype=np.int32))[ends_at - 1]])
    del by_n, valid, starts, ends, data

    def scores(fold: np.ndarray, bias: np.ndarray) -> np.ndarray:
        each = np.add.reduceat(fold[gram_bucket], gram_first[:-1]) / np.diff(gram_first)
        sums = np.concatenate([[0], np.cumsum(each[bag], dtype=float)])
        return (sums[bag_first[1:]] - sums[bag_first[:-1]]) / WINDOW + bias[1] - bias[0]

    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    soft, bias = rng.uniform(-0.1, 0.1, (DIM, 2)), np.zeros(2)
    v_sq, s_sq, b_sq = np.full((BUCKETS, DIM), 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    aside = mix(docs.astype(np.uint64)) % np.uint64(4) == 0  # documents kept for the calibration
    if len(np.unique(labels[aside])) < 2 or len(np.unique(labels[~aside])) < 2:
        aside[:] = False
    full = (np.diff(bag_first) > 0) & ~aside
    use = full.copy()
    phases = max(1, min(20, FIRST_WINDOWS // len(texts))) + NEXT_EPOCHS
    for epoch in range(phases):
        rows = rng.permutation(np.flatnonzero(use))
        share = labels[rows].mean()
        for lo in range(0, len(rows), BATCH):
            part = rows[lo : lo + BATCH]
            size = np.diff(bag_first)[part]
            row = np.repeat(np.arange(len(part)), size)
            flat = bag[bag_first[part][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
            seen, inverse = np.unique(flat, return_inverse=True)
            count = gram_first[seen + 1] - gram_first[seen]
            own = np.repeat(np.arange(len(seen)), count)
            pick = gram_first[seen][own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            held = rng.random(len(own)) < KEEP
            held |= np.repeat(np.bincount(own, held, len(seen)) == 0, count)
            own, bucket = own[held], gram_bucket[pick[held]]
            kept = np.bincount(own, minlength=len(seen))
            word = np.stack([np.bincount(own, vectors[bucket, d], len(seen)) for d in range(DIM)], 1) / kept[:, None]
            mean = np.stack([np.bincount(row, word[inverse, d], len(part)) for d in range(DIM)], 1) / WINDOW
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[part]
            g = p - np.eye(2)[y]
            g *= np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))[:, None]
            d_word = (g @ soft.T / WINDOW)[row]
            d_word = np.stack([np.bincount(inverse, d_word[:, d], len(seen)) for d in range(DIM)], 1) / kept[:, None]
            touched, local = np.unique(bucket, return_inverse=True)
            d_vec = np.stack([np.bincount(local, d_word[own, d], len(touched)) for d in range(DIM)], 1)
            for value, square, grad, index in ((soft, s_sq, mean.T @ g, slice(None)), (bias, b_sq, g.sum(0), slice(None)), (vectors, v_sq, d_vec, touched)):
                square[index] += grad**2
                value[index] -= RATE * grad / np.sqrt(square[index])
        fold = (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        if epoch < phases - NEXT_EPOCHS - 1 or epoch == phases - 1:
            continue
        z = scores(fold, bias)
        clean, toxic = np.flatnonzero(full & (labels == 0)), np.flatnonzero(full & (labels == 1))
        hard = max(len(clean) // 8, 1)
        use = np.zeros(len(labels), bool)
        use[clean[np.argsort(-z[clean], kind="stable")[:hard]]] = True
        use[rng.choice(clean, hard, replace=False)] = True
        by_doc = toxic[np.lexsort((-z[toxic], docs[toxic]))]
        use[by_doc[np.concatenate([[True], docs[by_doc][1:] != docs[by_doc][:-1]])]] = True
        use[toxic[z[toxic] > max(np.quantile(z[clean], 0.999), 0)]] = True
    z = scores(fold, bias)
    held = aside if aside.any() else np.ones(len(labels), bool)
    of = np.unique(docs[held])
    best = np.full(len(of), -np.inf)
    np.maximum.at(best, np.searchsorted(of, docs[held]), z[held])
    mark = np.zeros(len(of), np.int64)
    np.maximum.at(mark, np.searchsorted(of, docs[held]), labels[held])
    slope, shift = calibrate(best, mark)
    return (fold * slope).astype(np.float32), float((bias[1] - bias[0]) * slope + shift)


def calibrate(z: np.ndarray, mark: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from documents' highest windows to their labels, targets smoothed for their number."""
    n1, n0 = mark.sum(), len(mark) - mark.sum()
    target = np.where(mark == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    center, w = z.mean(), np.array([1.0, 0.0])
    x = np.stack([z - center, np.ones(len(z))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.eye(2) * 0.05, x.T @ (p - target) + [0.05 * (w[0] - 1), 0])
        w -= np.clip(step, -1, 1)
        w[0] = max(w[0], 0.05)
    return float(w[0]), float(w[1] - w[0] * center)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_windows: int = MAX_WINDOWS) -> tuple[np.ndarray, float]:
    """Vectors folded to one number a bucket, and a bias, fitted on at most max_positive and max_negative labelled texts and max_windows
    windows of each, those of smallest hash."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    of = lambda mark, n: known.where(mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = of("toxic > 0", max_positive).union(of("toxic <= 0", max_negative))  # at most the two bounds: it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ws = (text or "").encode().split()
                lo = windows(len(ws))
                if len(lo) > max_windows:
                    key = mix(lo.astype(np.uint64) + np.uint64(doc_id & (1 << 62) - 1))
                    lo = np.sort(lo[np.argsort(key)[:max_windows]])
                out += [(doc_id, mark, b" ".join(ws[i : i + WINDOW]).decode(errors="replace")) for i in lo]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "toxic", "text"])

    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    got = marked.mapInArrow(run, "doc_id long, toxic int, text string").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(got["text"].combine_chunks(), got["doc_id"].to_numpy(), got["toxic"].to_numpy() > 0)


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs(doc_id, text) to (doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score(data, offs, *shared.value))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
