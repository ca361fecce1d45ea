"""Phrase mining against brute force: any length, odd rows, colliding hashes, very frequent words, exact scores."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, cover=50, top=2000):
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(FOLD)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = {(lang, p[i:j]) for (lang, p), b in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * b >= cover * f[lang, p[i:j]]}
    for (lang, p), a in found.items():
        if (lang, p) not in covered:
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    result = []
    for lang, p, a, le, r, n_, s in out:
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], p, a, le, r, n_, s))
    return sorted(result)


def texts(seed, n=300, vocabulary=12):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "ÉA", "a\xa0b", "\x00", "ß", *[f"w{k}" for k in range(vocabulary)]]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";"]) for w in rng.choices(words, weights, k=rng.randrange(40))), rng.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("   ", "zz"), ("the of " * 3000, "en"), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, "z", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(3)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_any_length(spark, longest):
    rows = texts(longest)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), longest).collect())) == brute(rows, longest)


def test_few_rows_a_language_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 500)
    rows = texts(7)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), top=5).collect())) == brute(rows, top=5)


def test_colliding_hashes_change_nothing():
    rows = [(t, lang or "und") for t, lang in texts(8, 60)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], ["text", "lang"])
    (t,) = phrases.tokens(batch)
    sums = np.full(2 * phrases.BUCKETS, 10**6)
    place = phrases.places(t, sums, 10)
    assert sorted(place) == list(range(len(place)))
    before = phrases.hashes
    try:
        phrases.hashes = lambda langs, found: np.zeros(len(found), np.uint64)
        assert sorted(phrases.places(t, sums, 10)) == list(range(len(place)))  # a strict order by the words themselves
    finally:
        phrases.hashes = before


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, []).where("n < 0")).collect() == []


def test_scores_of_large_counts_are_exact(spark):
    rng = random.Random(5)
    cases = []
    for k in range(50):
        a = rng.randrange(10**14, 10**15)
        cases.append((f"x{k}", a, a + rng.randrange(10**15), a + rng.randrange(10**15)))
    found = spark.createDataFrame([("en", f"{w} y{w}", 2, a) for w, a, _, _ in cases], "lang string, phrase string, size int, a long")
    counts = spark.createDataFrame([row for w, _, le, r in cases for row in (("en", w, le), ("en", f"y{w}", r))], "lang string, word string, n long")
    have = {r["phrase"].split()[0]: r["score"] for r in phrases.scored(found, found, counts).collect()}
    assert have == {w: 10**6 * a * a // (le * r) for w, a, le, r in cases}


def test_pivot_is_the_rarest_word_and_fragments_hold_no_rarer_one(spark):
    rows = texts(9)
    docs = frame(spark, rows)
    counts = phrases.word_counts(docs).cache()
    n = {(r["lang"], r["word"]): r["n"] for r in counts.where("word is not null").collect()}
    seen = phrases.fragments(docs, phrases.count_table(counts)).where(F.col("n") > 0).collect()
    assert seen and all(n[r["lang"], w] >= n[r["lang"], r["pivot"]] for r in seen for side in ("left", "right") for w in r[side].split(" ") if w)
    assert all(len([w for w in r[side].split(" ") if w]) == r[f"n_{side}"] for r in seen for side in ("left", "right"))
