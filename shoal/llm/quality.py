"""Quality rules as a short-circuit cascade.

Each rule reads metrics of a text and rejects it. On a bounded sample the cost of each rule's metrics (seconds of one task's
clock) and its selectivity (share rejected) are measured; the cascade then runs the rules by rejection per cost and computes a
rule's metrics only for the texts that every rule before it passed. A text is kept if no rule rejects it, so the order changes
the time, never the verdict.

Nulls: a null text has no words, and fails like an empty one. Rows are judged one by one, so repeated rows and ties get equal
verdicts; other columns ride along under any name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.shared import table
from shoal.llm.text import Polynomial, per_row, row_of, shingles, slices, word_hashes, words

SAMPLE_ROWS = 400
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER, _BANG = (np.zeros(256, bool) for _ in range(3))
_UPPER[0x41:0x5B], _LOWER[0x61:0x7B], _BANG[0x21] = True, True, True
_HASH = Polynomial(11)


class Texts:
    """A slice of texts whose metrics are computed when first asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n, self.have = data, offs, len(offs) - 1, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.have:
            self.have[name] = METRICS[name](self)
        return self.have[name]

    def count(self, of: np.ndarray) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
        return np.diff(seen[self.offs])

    def some(self, rows: np.ndarray) -> Texts:
        lengths = np.diff(self.offs)[rows]
        data = np.concatenate([self.data[self.offs[r] : self.offs[r + 1]] for r in rows]) if len(rows) else self.data[:0]
        return Texts(data, np.concatenate([[0], np.cumsum(lengths)]))


def _prefix(t: Texts) -> np.ndarray:
    return _HASH.prefix(t.data)


def _repeat_words(t: Texts) -> np.ndarray:
    starts, ends, first = t["words"]
    windows, at = shingles(word_hashes(t.data, starts, ends, 11), first, WINDOW, whole=False)
    rows = row_of(at)
    keys = windows + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # one sort for all rows
    order = np.argsort(keys, kind="stable")
    same = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.flatnonzero(twice)
    place = first[:-1][rows[hit]] + hit - at[:-1][rows[hit]]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + WINDOW, -1)
    return per_row((np.cumsum(cover[:-1]) > 0).astype(float), row_of(first), t.n)


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them that are equal to an earlier one."""
    brk = np.flatnonzero(t.data == 0x0A)
    lo = np.concatenate([t.offs[:-1], brk + 1])
    rows = np.concatenate([np.arange(t.n), np.searchsorted(t.offs, brk, "right") - 1])
    order = np.lexsort((lo, rows))
    lo, rows = lo[order], rows[order]
    hi = np.minimum(np.concatenate([lo[1:] - 1, [len(t.data)]]), t.offs[rows + 1])
    last = np.concatenate([rows[1:] != rows[:-1], [True]])
    hi[last] = t.offs[rows[last] + 1]
    starts = t["words"][0]
    full = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi, rows = lo[full], hi[full], rows[full]
    keys = np.stack([rows.astype(np.uint64), _HASH.spans(t["prefix"], lo, hi), (hi - lo).astype(np.uint64)])
    distinct = np.unique(keys, axis=1)[0].astype(np.int64) if len(rows) else rows
    n = per_row(np.ones(len(rows)), rows, t.n)
    return n, n - per_row(np.ones(len(distinct)), distinct, t.n)


def _unspaced(t: Texts) -> np.ndarray:
    """Characters of scripts that put no spaces between words: Thai, Lao, Myanmar, Khmer, kana and Han with their punctuation."""
    a, b = t.data, np.append(t.data[1:], np.uint8(0))
    return t.count(
        ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F))) | ((a == 0xE3) & (((b >= 0x80) & (b <= 0x83)) | (b >= 0x90)))
        | ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & (((b >= 0xA4) & (b <= 0xAB)) | (b == 0xBC) | (b == 0xBD))) | ((a == 0xF0) & (b >= 0xA0) & (b <= 0xB3))
    )


METRICS: dict[str, Callable[[Texts], np.ndarray]] = {
    "words": lambda t: words(t.data, t.offs),
    "prefix": _prefix,
    "n_words": lambda t: np.diff(t["words"][2]),
    "word_chars": lambda t: t.count(((t.data & 0xC0) != 0x80) & (t.data != 0x20) & ((t.data < 0x09) | (t.data > 0x0D))),
    "n_symbols": lambda t: t.count(_SYMBOL[t.data]),
    "lines": _lines,
    "n_lines": lambda t: t["lines"][0],
    "n_dup_lines": lambda t: t["lines"][1],
    "n_repeat_words": _repeat_words,
    "n_upper": lambda t: t.count(_UPPER[t.data]),
    "n_lower": lambda t: t.count(_LOWER[t.data]),
    "n_other": lambda t: t.count(t.data >= 0xC0),
    "n_unspaced": _unspaced,
    "n_bang": lambda t: t.count(_BANG[t.data]),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


BASE = (
    Rule("few_words", lambda t: t["n_words"] < MIN_WORDS),
    Rule("repeated_windows", lambda t: 100 * t["n_repeat_words"] > REPEAT_PERCENT * t["n_words"]),
)
#: Thresholds in whole percents of words, letters or lines. Ordinary prose in Latin script stays far below all of them.
STYLE = (
    Rule("symbols", lambda t: 100 * t["n_symbols"] > 20 * t["n_words"]),
    Rule("shouting", lambda t: 100 * t["n_upper"] > 40 * (t["n_upper"] + t["n_lower"])),
    Rule("exclamations", lambda t: 100 * t["n_bang"] > 50 * t["n_words"]),
    Rule("duplicate_lines", lambda t: 100 * t["n_dup_lines"] > 50 * t["n_lines"]),
    Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] > 15 * t["n_words"])),
)
RULES = {r.name: r for r in BASE + STYLE}
#: The rules of a corpus in any language, by the same names: capitals are related to all letters, and characters of scripts without
#: spaces don't make words long. op6 keeps the rules of its SQL.
CORPUS = RULES | {
    "shouting": Rule("shouting", lambda t: (t["n_upper"] >= MIN_WORDS) & (100 * t["n_upper"] > 40 * (t["n_upper"] + t["n_lower"] + t["n_other"]))),
    "word_length": Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] - t["n_unspaced"] > 15 * t["n_words"])),
}
DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, rules: tuple[Rule, ...] = BASE + STYLE, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on the first `sample_rows` texts that the scan meets. Only the order of the rules follows from it."""
    names = [r.name for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                for name in names:
                    t = Texts(data, offs)
                    t["words"]  # every rule finds them there, so none is charged for them
                    began = time.perf_counter()
                    out = RULES[name].rejects(t).sum()
                    yield pa.RecordBatch.from_pydict({"rule": [name], "seconds": [time.perf_counter() - began], "rejected": [float(out)], "texts": [float(t.n)]})

    got = docs.select("text").limit(sample_rows).mapInArrow(run, "rule string, seconds double, rejected double, texts double")
    rows = got.groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("texts")).collect()
    return [(r[0], r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in rows]


def plan(measured: list[tuple[str, float, float]], rules: tuple[Rule, ...] = BASE + STYLE) -> list[str]:
    """Rule names by rejection per cost, dearest last; rules that were not measured keep their place at the end."""
    gain = {name: share / max(seconds, 1e-9) for name, seconds, share in measured}
    return sorted((r.name for r in rules), key=lambda n: -gain.get(n, 0.0))


def passes(t: Texts, order: list[str], rules: dict[str, Rule] = RULES) -> np.ndarray:
    """The cascade: each rule sees only the texts that all before it passed."""
    alive, rest = np.arange(t.n), t
    for name in order:
        if not len(alive):
            break
        ok = ~rules[name].rejects(rest)
        if not ok.all():
            alive, rest = alive[ok], rest.some(np.flatnonzero(ok))
    out = np.zeros(t.n, bool)
    out[alive] = True
    return out


def quality_filter(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, all columns kept."""
    order = order or plan(measure(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(passes(Texts(data, offs), order, CORPUS)))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest needs the base metrics of every row, so the base verdict comes first and the cascade runs over the style rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = plan(measure(docs, STYLE), STYLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                t = Texts(data, offs)
                failed = BASE[0].rejects(t) | BASE[1].rejects(t)
                kept = np.zeros(t.n, bool)
                alive = np.flatnonzero(~failed)
                kept[alive[passes(t.some(alive) if failed.any() else t, order)]] = True
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(t[m].astype(np.int64)) for m in DIGEST), pa.array(failed), pa.array(kept)], ["doc_id", *DIGEST, "base_failed", "kept"])

    return docs.mapInArrow(run, f"doc_id long, {', '.join(f'{m} long' for m in DIGEST)}, base_failed boolean, kept boolean")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, len(list(word) OVER f) AS n, md5(string_agg(word, ' ') OVER f) AS gram FROM u WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g WHERE n = 8),
c AS (SELECT u.r, u.i, bool_or(coalesce(t.twice, false)) OVER (PARTITION BY u.r ORDER BY u.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM u LEFT JOIN t ON u.r = t.r AND u.i = t.i),
rep AS (SELECT r, count(*) FILTER (hit) AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_aggregate(list_concat(ws, ['']), 'string_agg', '')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
      coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS up, len(regexp_extract_all(text, '[a-z]')) AS lo, len(regexp_extract_all(text, '!')) AS bang
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dl USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * up > 40 * (up + lo) OR 100 * bang > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""
