"""Near-duplicate passages by compact windows.

Tokens are five-word shingles. Under a hash function, the subsequences of at least LEAST tokens of a text whose minimum sits at place
c are exactly those within a compact window (l, c, r), read off the Cartesian tree of the token hashes: l and r are the nearest
places around c with a smaller hash. Windows of one text under AGREE of FUNCTIONS functions are intersected; those of different
texts that share these minima hold subsequences that agree on AGREE min-hashes. The links between such windows are joined as
intervals for each pair of texts and verified on the shingles themselves: a stretch between common tokens of both sides must hold
LEAST tokens and reach the similarity. Two passages at a similarity of 0.8 share no key once in 37 times for each LEAST tokens.

Equal texts count once, represented by their smallest doc_id; their other documents are returned as copies of it. Up to PAIRS windows
that share a key are all linked to each other. Larger keys would make a number of pairs that grows with the square, so the texts of all
keys that have the same first text (their home) meet, each with its tokens once, and there the windows of a key are compared with the first
one, then those that are not yet joined by similar stretches around the key's places with each other: any two windows of a key are compared or joined,
unless they have too few common tokens to be similar. A home of more than a block meets block by block, then what is still apart across
blocks. Windows of one text alone make no link.

Texts of fewer than five words and null texts have no tokens. Rows with a null doc_id take no part. Rows that repeat doc_id and text
count once; rows of one doc_id with different texts are different texts of it. Of ties (equal minima) the first place counts. A text is held whole
by the task that reads it, however long. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.shared import materialise, table
from shoal.llm.text import constants, mix, row_of, shingles, slices, word_hashes, words

WORDS, LEAST, PERCENT = 5, 46, 80
FUNCTIONS, AGREE, SHIFT, PAIRS = 4, 2, 32, 16
FLUSH = 2_000_000
BLOCK_TEXTS, BLOCK_TOKENS, BLOCK_MEMBERS = 2048, 1 << 20, 1 << 17
_MUL, _ADD = (constants(72, FUNCTIONS) >> np.uint64(32)) | np.uint64(1), constants(73, FUNCTIONS) >> np.uint64(32)
_WINDOW = np.dtype([("key", "<u8"), ("text", "<i8"), ("l", "<i4"), ("c", "<i4"), ("r", "<i4")])
_LINK = "a long, b long, la int, ra int, lb int, rb int, shift int, key long"  # key: of a member of a large key, else -1
_MEMBER = np.dtype([("key", "<i8"), ("group", "<i8"), ("l", "<i4"), ("c", "<i4"), ("r", "<i4")])


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offs)
    return shingles(word_hashes(data, starts, ends, 71, fold_case=True), first, WORDS, whole=False)


def compact_windows(values: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least `least` places, for rows laid end to end; of equal minima the first counts."""
    n = len(values)
    lengths = np.diff(first)
    if n < least or not (lengths >= least).any():
        return (np.zeros(0, np.int64),) * 3
    ranked = (values.astype(np.uint64) << np.uint64(31)) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // least) * least, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = ranked
    ahead = np.minimum.accumulate(blocks.reshape(-1, least), axis=1).ravel()
    behind = np.minimum.accumulate(blocks.reshape(-1, least)[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[: n - least + 1], ahead[least - 1 : n]) & np.uint64((1 << 31) - 1)).astype(np.int64)
    row = row_of(first)
    own = row[: n - least + 1] == row[least - 1 :]
    c = at[own]  # never falls from one run to the next
    c = c[np.diff(c, prepend=-1) > 0]
    lo, hi = first[:-1][row[c]], first[1:][row[c]]
    levels = [ranked]
    while 2 << (len(levels) - 1) <= lengths.max():
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    left, right, v = c.copy(), c + 1, ranked[c]  # ranked has no ties: an equal value further left is smaller
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        ok = left - size >= lo
        ok[ok] = levels[k][left[ok] - size] > v[ok]
        left[ok] -= size
        ok = right + size <= hi
        ok[ok] = levels[k][right[ok]] > v[ok]
        right[ok] += size
    return left, c, right - 1


def joint_windows(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, c, l, r) for each pair of functions: a run of LEAST places slides over each row, and wherever its minimum under either
    function changes, the compact windows of both minima are intersected. Every subsequence of [l, r] that holds both minima has
    that pair of min-hashes, so one key stands for agreement under AGREE functions. Keys of 48 bits make the shuffle smaller; those that
agree by chance are a link more to verify."""
    made = []
    for f in range(FUNCTIONS):
        l, c, r = compact_windows(((hashes >> np.uint64(32)) * _MUL[f] + _ADD[f]) & np.uint64(0xFFFFFFFF), first)
        made.append((l, c, r, np.maximum(l, c - LEAST + 1)))  # the last: the first run whose minimum this is
    for n, (f, g) in enumerate(itertools.combinations(range(FUNCTIONS), AGREE)):
        (fl, fc, fr, fs), (gl, gc, gr, gs) = made[f], made[g]
        at = np.sort(np.concatenate([fs, gs]), kind="stable")
        at = at[np.diff(at, prepend=-1) > 0]
        i, j = np.searchsorted(fs, at, "right") - 1, np.searchsorted(gs, at, "right") - 1
        key = mix(hashes[fc[i]] * np.uint64(2 * n + 3) + mix(hashes[gc[j]] + np.uint64(n)))
        yield key & np.uint64((1 << 48) - 1), fc[i], np.maximum(fl[i], gl[j]), np.minimum(fr[i], gr[j])


def widest(w: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which windows lie in no other one of their run (a text's windows of a key)."""
    order = np.lexsort((-w["r"].astype(np.int64), w["l"], run))
    reach = w["r"][order].astype(np.int64) + (run[order].astype(np.int64) << 32)
    out = np.ones(len(w), bool)
    out[order[1:]] = (run[order[1:]] != run[order[:-1]]) | (reach[1:] > np.maximum.accumulate(reach)[:-1])
    return out


def stars(w: np.ndarray, last: bool = True, large: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(links, windows that stand for their keys). Within a key of up to PAIRS windows, each is linked to all those of other texts; unless
    these are the last to come, all of them are sent on instead. Within a larger key every window is linked to the first window of the
    text that comes first in one order of all texts (that text's own windows to the second text's); unless these are the last to come, those
    that lie in no other of their text are sent on instead. Without `large` the windows are the last to come, larger keys make no links,
    and what stands for these is their members: for each text the windows that lie in no other, the first window before all."""
    order = np.argsort(w["key"], kind="stable")
    same = np.diff(w["key"][order]) == 0
    many = np.flatnonzero(np.append(same, False) | np.append(False, same))  # places of keys that more than one window has
    x = w[order[many]]
    order[many] = order[many][np.lexsort((x["c"], x["text"], mix(x["text"].astype(np.uint64)), x["key"]))]
    w = w[order]
    first, new = np.ones(len(w), bool), np.ones(len(w), bool)
    first[1:] = w["key"][1:] != w["key"][:-1]
    new[1:] = first[1:] | (w["text"][1:] != w["text"][:-1]) | (w["c"][1:] != w["c"][:-1])  # equal texts make equal windows
    w, first = w[new], first[new]
    group, head = np.cumsum(first) - 1, np.flatnonzero(first)
    size = np.diff(np.append(head, len(w)))
    few = size[group] <= PAIRS
    wide = ~few
    wide[wide] = widest(w[wide], np.cumsum(first | np.append(True, w["text"][1:] != w["text"][:-1])[: len(w)])[wide])
    other = w["text"] != w["text"][head[group]] if len(w) else first
    second = np.full(len(head), len(w))
    np.minimum.at(second, group[other], np.flatnonzero(other))
    partner = np.where(other, head[group], second[group]) if len(w) else group
    pairs = [np.flatnonzero((partner < len(w)) & ~first & ~few & (last | ~wide) & large)]  # a head is linked by its partners
    pairs = [np.stack([partner[pairs[0]], pairs[0]])]
    for n in np.unique(size[(size > 1) & (size <= PAIRS)]).tolist() if last else ():
        pairs.append((head[size == n] + np.stack(np.triu_indices(n, 1))[:, :, None]).reshape(2, -1))
    a, b = np.concatenate(pairs, 1)
    unlike = w["text"][a] != w["text"][b]
    a, b = a[unlike], b[unlike]
    swap = w["text"][a] > w["text"][b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    links = np.stack([w["text"][a], w["text"][b], *(w[n][s].astype(np.int64) for s in (a, b) for n in ("l", "r")), w["c"][b].astype(np.int64) - w["c"][a]], 1)
    alone = ~other & (partner == len(w))
    return merged_links(links), w[few | first | wide | alone if large else ~few & ~alone & (wide | first)]


def merged_links(x: np.ndarray) -> np.ndarray:
    """Interval join: links of one pair of texts whose shifts are alike and whose intervals overlap become one."""
    if not len(x):
        return x
    x = x[np.lexsort((x[:, 2], x[:, 6] // SHIFT, x[:, 1], x[:, 0]))]
    group = np.ones(len(x), bool)
    group[1:] = (x[1:, :2] != x[:-1, :2]).any(1) | (x[1:, 6] // SHIFT != x[:-1, 6] // SHIFT)
    gid = np.cumsum(group) << 32
    new = group.copy()
    new[1:] |= x[1:, 2] + gid[1:] > np.maximum.accumulate(x[:, 3] + gid)[:-1]
    at = np.flatnonzero(new)
    return np.stack([x[at, 0], x[at, 1], np.minimum.reduceat(x[:, 2], at), np.maximum.reduceat(x[:, 3], at), np.minimum.reduceat(x[:, 4], at), np.maximum.reduceat(x[:, 5], at), x[at, 6]], 1)


_PACKED = (("key", "<u8"), ("text", "<i8"), ("l", "<u4"), ("c", "<u4"), ("r", "<u4"))


def pack(w: np.ndarray) -> bytes:
    """Windows as planes of bytes, c and r as distances, so that the shuffle's compression finds the empty bytes."""
    columns = (w["key"], w["text"], w["l"], w["c"] - w["l"], w["r"] - w["c"])
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(x.astype(t)).view(np.uint8).reshape(len(w), -1).T).tobytes() for x, (_, t) in zip(columns, _PACKED, strict=True))


def unpack(data: np.ndarray) -> np.ndarray:
    n = len(data) // _WINDOW.itemsize
    w, at = np.zeros(n, _WINDOW), 0
    for name, t in _PACKED:
        size = np.dtype(t).itemsize
        w[name] = np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(t)[:, 0]
        at += n * size
    w["c"] += w["l"]
    w["r"] += w["c"]
    return w


def linked_windows(texts: DataFrame, buckets: int) -> DataFrame:
    """texts(text_id, text) to links between windows that share a key, dealt by `buckets` (a power of two) of keys, and members (text, home, l, r, c) of larger
    keys. Keys meet in a task first; for each key PAIRS windows at most or one a text (more only for a text that repeats itself) go on,
    packed with others of its bucket of keys."""
    sent = "kind int, bucket int, data binary"
    names = [c.split()[0] for c in _LINK.split(", ")]

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            made, heads = stars(np.concatenate(held), last=False)
            held.clear()
            rows = []
            for kind, part, to in ((1, heads, heads["key"] & np.uint64(buckets - 1)), (2, made, mix(made[:, 1].astype(np.uint64)) % np.uint64(buckets))):
                order = np.argsort(to, kind="stable")
                part, ends = part[order], np.flatnonzero(np.diff(to[order], append=np.uint64(buckets)))
                rows += [(kind, int(to[order[e]]), pack(part[s : e + 1]) if kind == 1 else part[s : e + 1].tobytes()) for s, e in zip([0, *(ends[:-1] + 1)], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["kind", "bucket", "data"])

        for batch in batches:
            for lo, _, data, offs in slices(batch.column(1)):
                hashes, first = tokens(data, offs)
                ids = batch.column(0).slice(lo, len(offs) - 1).to_numpy()
                row = row_of(first)
                for key, c, l, r in joint_windows(hashes, first):
                    w = np.zeros(len(c), _WINDOW)
                    base = first[row[c]]
                    w["key"], w["text"], w["l"], w["c"], w["r"] = key, ids[row[c]], l - base, c - base, r - base
                    held.append(w)
                if sum(map(len, held)) > FLUSH:
                    yield from out()
        if held:
            yield from out()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bucket = -1

        def rows(made: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(made), 1 << 16):
                part = made[lo : lo + (1 << 16)]
                part = part if part.shape[1] == 8 else np.concatenate([part, np.full((len(part), 1), -1)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(part[:, i] if i in (0, 1, 7) else part[:, i].astype(np.int32)) for i in range(8)], names)

        def met() -> Iterator[pa.RecordBatch]:
            made, w = stars(np.concatenate(held), large=False)
            held.clear()
            yield from rows(made)
            home = w["text"][np.maximum.accumulate(np.where(np.append(True, w["key"][1:] != w["key"][:-1])[: len(w)], np.arange(len(w)), 0))]
            yield from rows(np.stack([w["text"], home, w["l"], w["r"], w["c"], w["c"], w["c"], w["key"].astype(np.int64)], 1).astype(np.int64))

        for batch in batches:
            for kind, to, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == 2:
                    yield from rows(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, 7))
                    continue
                if to != bucket and held:
                    yield from met()
                bucket = to
                held.append(unpack(np.frombuffer(data.as_buffer(), np.uint8)))
        if held:
            yield from met()

    packed = texts.select("text_id", "text").mapInArrow(generate, sent)
    return packed.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(match, _LINK)


def candidates(links: DataFrame) -> DataFrame:
    """All links of a pair of texts, merged once more; members of a text at a home as pieces of the text (a, b: text and home, la, ra) that hold
    those members whose windows overlap."""
    names = ["a", "b", "la", "ra", "lb", "rb", "members"]

    def pieces(x: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
        gid = np.cumsum(np.append(True, (x[1:, :2] != x[:-1, :2]).any(1))) << 32
        at = np.flatnonzero(np.append(True, x[1:, 2] + gid[1:] > np.maximum.accumulate(x[:, 3] + gid)[:-1]))
        m = np.zeros(len(x), _MEMBER)
        m["key"], m["l"], m["r"], m["c"] = x[:, 7], x[:, 2], x[:, 3], x[:, 4]
        m["group"] = mix(x[:, 0].astype(np.uint64) + mix(x[:, 2].astype(np.uint64))).astype(np.int64)  # a name for a window of a key
        ends = np.append(at[1:], len(x))
        return np.stack([x[at, 0], x[at, 1], x[at, 2], np.maximum.reduceat(x[:, 3], at), at * 0, at * 0], 1), [m[s:e].tobytes() for s, e in zip(at, ends, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def out(x: np.ndarray) -> pa.RecordBatch:
            own = x[:, 7] >= 0
            made, members = pieces(x[own]) if own.any() else (np.zeros((0, 6), np.int64), [])
            x = merged_links(x[~own])
            members += [None] * len(x)
            x = np.concatenate([made, x[:, :6]])
            return pa.RecordBatch.from_arrays([*(pa.array(x[:, i] if i < 2 else x[:, i].astype(np.int32)) for i in range(6)), pa.array(members, pa.binary())], names)

        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            x = x if held is None else np.concatenate([held, x])
            if not len(x):
                continue
            last = int(np.flatnonzero((x[:, :2] == x[-1, :2]).all(1))[0])  # rows lie together by pair
            held = x[last:]
            if last:
                yield out(x[:last])
        if held is not None:
            yield out(held)

    return links.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long, la int, ra int, lb int, rb int, members binary")


def verify(x: np.ndarray, y: np.ndarray, percent: int = PERCENT, least: int = LEAST) -> list[tuple[int, int, int, int, float]]:
    """Similar stretches of two token sequences: (lo, hi, lo, hi, similarity). A stretch begins and ends with a common token. If the whole
    is not similar, those from the start of a run of common tokens to the end of one are tried, the furthest end first (within a run a
    longer stretch is never less similar); of those that are similar so many are returned that each token of any lies in one."""
    if not len(x) or not len(y):
        return []
    order = np.argsort(y, kind="stable")
    near = order[np.minimum(np.searchsorted(y[order], x), len(y) - 1)]
    common = y[near] == x
    if not common.any():
        return []

    def previous(z: np.ndarray) -> np.ndarray:
        """Where the token of a place stood last, -1 if nowhere."""
        out, at = np.full(len(z), -1), np.argsort(z, kind="stable")
        again = np.flatnonzero(z[at[1:]] == z[at[:-1]])
        out[at[again + 1]] = at[again]
        return out

    places = np.flatnonzero(common)
    there = near[places]
    shift = there - places
    before_x, before_y = previous(x), previous(y)

    def similar(s: int, e: int, i: int, j: int, kinds: int, shared: int) -> tuple[int, int, int, int, float] | None:
        """The stretch [s, e), whose common tokens are places[i:j]; kinds and shared: its different tokens, all and common."""
        own, to = shift[i:j], there[i:j]
        middle = np.partition(own, len(own) // 2)[len(own) // 2]
        close = to[np.abs(own - middle) <= (e - s) // 4 + SHIFT]
        p, q = int(close.min()), int(close.max()) + 1
        if max(e - s, q - p) < least:
            return None
        other = int(np.count_nonzero(before_y[p:q] < p))
        if 100 * min(shared, other) < percent * (kinds + other - min(shared, other)):
            return None
        both = len(np.intersect1d(x[s:e], y[p:q]))
        return (s, e, p, q, both / (kinds + other - both)) if 100 * both >= percent * (kinds + other - both) else None

    edges = np.flatnonzero(np.diff(np.concatenate([[False], common, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    s, e = int(starts[0]), int(ends[-1])
    fresh = before_x[s:e] < s
    if whole := similar(s, e, 0, len(places), int(fresh.sum()), int((fresh & common[s:e]).sum())):
        return [whole]
    held = np.concatenate([[0], np.cumsum(ends - starts)])
    gain = 100 * held  # a stretch with enough common tokens on this side gains no less by its end than `percent` for each token
    rise = np.maximum.accumulate((gain[1:] - percent * ends)[::-1])[::-1]
    last = np.searchsorted(-rise, percent * starts - gain[:-1], "right") - 1
    hopeful = np.flatnonzero(gain[1:][np.maximum(last, 0)] - gain[:-1] >= percent * least)
    if not len(hopeful):
        return []
    shifts = shift[np.lexsort((shift, np.repeat(np.arange(len(starts)), ends - starts)))][held[:-1] + (ends - starts) // 2]
    found: list[tuple[int, int, int, int, float]] = []
    vain: list[int] = []  # starts without a similar stretch
    for i in hopeful.tolist():
        s, end = int(starts[i]), int(last[i]) + 1
        if found and ends[end - 1] <= found[-1][1]:
            continue
        fresh = before_x[s : ends[end - 1]] < s
        kinds, shared = np.cumsum(fresh)[ends[i:end] - s - 1], np.cumsum(fresh & common[s : ends[end - 1]])[ends[i:end] - s - 1]
        both, size = held[i + 1 : end + 1] - held[i], ends[i:end] - s
        other = np.maximum(ends[i:end] + shifts[i:end] - s - shifts[i], both)
        able = (100 * both >= percent * (size + other - both)) & (np.maximum(size, other) >= least) & (100 * shared >= percent * kinds)
        for v in vain[-4:]:  # the same tokens as from there, as in a text that repeats its lines
            unlike = np.flatnonzero(x[s : ends[end - 1]] != x[v : v + ends[end - 1] - s])
            able &= size > (unlike[0] if len(unlike) else size[-1])
        for n in np.flatnonzero(able)[::-1].tolist():
            e = int(ends[i + n])
            if found and e <= found[-1][1]:
                break
            if one := similar(s, e, int(held[i]), int(held[i + n + 1]), int(kinds[n]), int(shared[n])):
                found.append(one)
                break
        else:
            vain.append(s)
    out = []
    for n, one in enumerate(found):
        if not out or n + 1 == len(found) or found[n + 1][0] > out[-1][1]:
            out.append(one)
    return out


def either_way(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """verify, from the other side too if tokens repeat: a token that y alone repeats is met there at its first place only."""
    found = verify(x, y)
    if found or len(np.unique(x)) == len(x) and len(np.unique(y)) == len(y):
        return found
    return [(s, e, p, q, sim) for p, q, s, e, sim in verify(y, x)]


@dataclass
class Piece:
    """A stretch of a text at a home, from token `lo`, and the members of large keys in it. Between blocks those that ask are compared with those of
    other blocks that don't."""

    text: int
    lo: int
    tokens: np.ndarray
    members: np.ndarray
    block: int = 0
    asks: bool = True


def fewest(x: np.ndarray, least: int = LEAST) -> int:
    """The least number of different tokens in any run of `least`; x has that many tokens."""
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    before, at = order[again], order[again + 1]
    near = at - before < least
    before, at = before[near], at[near]
    n = len(x) - least + 1
    repeats = np.bincount(np.maximum(at - least + 1, 0), minlength=n + 1) - np.bincount(np.minimum(before + 1, n), minlength=n + 1)
    return least - int(np.cumsum(repeats)[:n].max())


def stretches(row: np.ndarray, place: np.ndarray, there: np.ndarray, rows: int, width: int, percent: int = PERCENT, least: int = LEAST) -> np.ndarray:
    """For a text of `width` tokens and others, one a row, none of which repeats a token: which places of the text can lie in a similar stretch of it
    and the other. place, there: the places of the common tokens in the text (ascending) and in the other; row < 0
    is left out. If common tokens are in the same order, SHIFT apart at most, the stretch of the other goes from the first to the last of
    them as in `verify`, and from common token a to b there are b - a + 1 common ones and as many different ones as both stretches have places
    less that: similar if `percent` * places <= (100 + percent) * common, a sum of differences. Otherwise `percent` of the text's own places must be common."""
    of = np.flatnonzero(row >= 0)
    of = of[np.argsort(row[of].astype(np.uint16) if rows < 1 << 16 else row[of], kind="stable")]
    row, place, there = row[of], place[of], there[of]
    count = np.bincount(row, minlength=rows)
    begin = np.cumsum(count) - count
    k = np.arange(len(row)) - begin[row]
    follows = np.append(False, row[1:] == row[:-1])[: len(row)]
    alike = np.ones(rows, bool)
    alike[row[np.flatnonzero(follows & (np.diff(there, prepend=0) <= 0))]] = False
    full, shift = np.flatnonzero(count), there - place
    alike[full] &= np.maximum.reduceat(shift, begin[full]) - np.minimum.reduceat(shift, begin[full]) <= SHIFT
    long = np.zeros(rows, bool)  # a stretch begins and ends with a common token
    for x in (place, there):
        long[full] |= np.maximum.reduceat(x, begin[full]) - np.minimum.reduceat(x, begin[full]) >= least - 1
    most, n = int(count.max()), -(-percent * least // 100) - 1
    around = np.zeros((rows, width), bool)
    if most <= n:
        return around
    far = 1 << 30
    value = (100 * k - percent * place + np.where(alike[row], percent * (k - there), 0)).astype(np.int32)
    low, high = np.full((rows, most), far, np.int32), np.full((rows, most), -far, np.int32)
    low[row, k], high[row, k] = value, value + 100 - percent
    low = np.minimum.accumulate(low, 1)
    ends = np.zeros((rows, most + n + 1), np.int32)  # places that a stretch may end at, summed
    ends[:, n + 1 : most + 1] = np.cumsum(high[:, n:] >= low[:, : most - n], 1)
    ends[:, most + 1 :] = ends[:, most : most + 1]
    held = ends[:, n : n + most] > ends[:, :most]  # a stretch of just enough tokens or more ends within the next n
    high = np.maximum.accumulate(high[:, ::-1], 1)[:, ::-1]
    held[:, : most - n] |= high[:, n:] >= low[:, : most - n]
    around[row, place] = held[row, k] & long[row]
    return around


def meet(pieces: list[Piece], home: int, between: bool = False) -> list[tuple[int, int, int, int, int, int, float]]:
    """Similar stretches (text, lo, hi, text, lo, hi, similarity) of the windows of each key. The home's are compared with all others, then those of
    different groups with each other; windows with a similar stretch around their places become one group, that of the home's first one is
    named by it. Pairs with fewer common tokens than any similar stretch needs are left out. Stretches elsewhere are returned if they join
    texts that were not joined, or are the home's. `between`: the pieces are of several blocks, each of which has met by itself."""
    own, places = zip(*(np.unique(p.tokens, return_index=True) for p in pieces), strict=True)
    at, where = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(places)
    token = np.concatenate(own)
    order = np.argsort(token, kind="stable")
    token, at, where = token[order], at[order], where[order]
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    size = np.diff(np.append(start, len(token)))
    gid = np.repeat(np.arange(len(start)), size)
    shared = np.flatnonzero(size[gid] > 1)
    shared = shared[np.lexsort((where[shared], at[shared]))]
    first = np.searchsorted(at[shared], np.arange(len(pieces) + 1))
    least = np.array([fewest(p.tokens) for p in pieces])  # different tokens of a similar stretch, on its longer side
    short = -(-PERCENT * LEAST // 100)  # common ones, if no token stands twice
    plain = np.array([len(x) == len(p.tokens) for x, p in zip(own, pieces, strict=True)])  # no token stands twice

    def common(x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, place in x, place there) of the tokens of x in all pieces, by their first places, in order of the place in x."""
        of = shared[first[x] : first[x + 1]]
        n = size[gid[of]]
        to = np.arange(int(n.sum())) + np.repeat(start[gid[of]] - np.cumsum(n) + n, n)
        return at[to], np.repeat(where[of], n), where[to]

    texts, blocks, asks = np.array([p.text for p in pieces]), np.array([p.block for p in pieces]), np.array([p.asks for p in pieces])
    joined = np.where([bool((p.members["group"] == home).any()) for p in pieces], home, texts)  # texts by what they are joined to
    part = np.repeat(np.arange(len(pieces)), [len(p.members) for p in pieces])
    m = np.concatenate([p.members for p in pieces])
    order = np.lexsort((m["c"], texts[part], texts[part] != home, m["key"]))
    m, part = m[order], part[order]
    group, homely = m["group"], texts == home
    new = np.append(True, m["key"][1:] != m["key"][:-1])
    group[new & homely[part]] = home
    lo = np.flatnonzero(new)
    hi, key = np.append(lo[1:], len(m)), np.cumsum(new) - 1
    l, c, r = (m[n].astype(np.int64) for n in "lcr")
    by_piece = np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=len(pieces)))[:-1])
    rank = np.empty(len(pieces), np.int64)
    turns = np.argsort(~homely, kind="stable")
    rank[turns] = np.arange(len(pieces))
    out = []

    def open_pairs(x: int) -> np.ndarray:
        """Members of a piece and those of other pieces that it is to be compared with."""
        found = [np.zeros((2, 0), np.int64)]
        able = (rank > rank[x] if not between else ~asks & (blocks != blocks[x])) & (texts != texts[x])
        for i in by_piece[x].tolist():
            s, e = lo[key[i]], hi[key[i]]
            if between and group[i] == home or e - s == 1:
                continue
            apart = group[s:e] != group[i]
            if not apart.any():
                continue
            apart &= able[part[s:e]]
            if between:
                apart &= (group[s:e] == home) | (texts[part[s:e]] > texts[x])
            j = s + np.flatnonzero(apart)
            found.append(np.stack([np.full(len(j), i), j]))
        return np.concatenate(found, 1)

    def hopeful(x: int, pairs: np.ndarray, tokens: tuple[np.ndarray, ...]) -> np.ndarray:
        """The pairs that may have a similar stretch around their places, or anywhere if their texts are not joined."""
        out = np.ones(pairs.shape[1], bool)
        other = part[pairs[1]]
        ys = np.unique(other[plain[other]]) if plain[x] else other[:0]
        width = len(pieces[x].tokens)
        for some in np.array_split(ys, -(-len(ys) * width // (1 << 21))) if len(ys) else ():
            row = np.full(len(pieces), -1)
            row[some] = np.arange(len(some))
            around = stretches(row[tokens[0]], tokens[1], tokens[2], len(some), width)
            of = np.flatnonzero(row[other] >= 0)
            n = row[other[of]]
            anywhere = homely[x] | (joined[other[of]] != joined[x])
            out[of] = around[n, c[pairs[0, of]] - pieces[x].lo] | anywhere & around.any(1)[n]
        return out

    once = [np.bincount(x, minlength=len(p.tokens)) > 0 for x, p in zip(places, pieces, strict=True)]

    def dense(x: int, y: int, length: int) -> bool:
        """Whether a similar stretch's side of `length` places or more can be in x: PERCENT of its different tokens are common; these are no more
        than the places of common ones, the others no fewer than those that stand in it for the first time in x."""
        z, there = pieces[x].tokens, own[y]
        alike = there[np.minimum(np.searchsorted(there, z), len(there) - 1)] == z
        gain = np.concatenate([[0], np.cumsum(np.where(alike, (100 - PERCENT << 32) + 1, np.where(once[x], -PERCENT << 32, 0)))])  # at least one is common
        return bool((gain[length:] > np.minimum.accumulate(gain[: len(gain) - length])).any())

    for x in turns.tolist():
        if between and not asks[x]:
            continue
        pairs = open_pairs(x)
        if not pairs.size:
            continue
        tokens = common(x)
        enough = 100 * np.bincount(tokens[0], minlength=len(pieces)) >= PERCENT * np.minimum(least[x], least)
        pairs = pairs[:, enough[part[pairs[1]]]]
        pairs = pairs[:, hopeful(x, pairs, tokens)]
        pairs = pairs[:, np.argsort(part[pairs[1]], kind="stable")]
        for i, j in np.split(pairs, np.flatnonzero(np.diff(part[pairs[1]]) > 0) + 1, axis=1) if pairs.size else ():
            apart = group[i] != group[j]
            if not apart.any():
                continue
            i, j, y = i[apart], j[apart], int(part[j[0]])
            if not (dense(x, y, short) and dense(y, x, short) if plain[x] and plain[y] else dense(x, y, LEAST) or dense(y, x, LEAST)):
                continue
            anywhere = homely[x] or joined[x] != joined[y]
            a, b = pieces[x], pieces[y]
            around = np.zeros(len(i), bool)
            whole = [[0, 0, a.lo, a.lo + len(a.tokens) - 1, b.lo, b.lo + len(b.tokens) - 1, 0]]
            for _, _, la, ra, lb, rb, _ in whole if plain[x] and plain[y] else merged_links(np.stack([0 * i, 0 * i, l[i], r[i], l[j], r[j], c[j] - c[i]], 1)).tolist():
                for s, e, q, t, sim in either_way(a.tokens[la - a.lo : ra - a.lo + 1], b.tokens[lb - b.lo : rb - b.lo + 1]):
                    s, e, q, t = s + la, e + la, q + lb, t + lb
                    here = (s <= c[i]) & (c[i] < e) & (q <= c[j]) & (c[j] < t)
                    if here.any() or anywhere:
                        out.append((a.text, s, e, b.text, q, t, sim))
                        joined[joined == joined[y]] = joined[x]
                    around |= here
            for u, v in zip(i[around].tolist(), j[around].tolist(), strict=True):
                all_ = group[lo[key[u]] : hi[key[u]]]
                gu, gv = group[u], group[v]
                all_[(all_ == gu) | (all_ == gv)] = home if home in (gu, gv) else gu
    back = np.empty_like(m)
    back[order] = m
    for piece, members in zip(pieces, np.split(back, np.cumsum([len(p.members) for p in pieces])[:-1]), strict=True):
        piece.members = members
    return out


def across(wide: DataFrame, both_ways, schema: str) -> DataFrame:
    """What blocks of one home have in common: the pieces with members outside the group of the home, in blocks of their own, meet all pieces
    of the home, block by block."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [bool((np.frombuffer(m.as_buffer(), _MEMBER)["group"] != h.as_py()).any()) for m, h in zip(batch["members"], batch["home"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(some, pa.bool_())], [*batch.schema.names, "open"])

    columns = "home long, text long, lo int, block int, data binary, members binary"
    named = wide.select(F.col("match_id").alias("home"), F.col("text_id").alias("text"), F.col("start_word").cast("int").alias("lo"), "block", "data", "members")
    pieces = materialise(named.mapInArrow(opened, f"{columns}, open boolean"))
    askers = F.count_if("open")
    sizes = pieces.groupBy("home").agg((F.max("block") + 1).alias("blocks"), F.ceil(F.greatest(askers / BLOCK_TEXTS, F.sum(F.when(F.col("open"), F.length("data"))) / (4 * BLOCK_TOKENS), F.sum(F.when(F.col("open"), F.length("members"))) / (_MEMBER.itemsize * BLOCK_MEMBERS))).cast("int").alias("parts")).where("parts > 0")
    sized = pieces.join(sizes, "home")
    asking = sized.where("open").withColumn("part", F.pmod(F.xxhash64("text", F.lit(1)), F.col("parts")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    given = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("to", F.col("block"))
    names = [*(c.split()[0] for c in columns.split(", ")), "part", "to"]
    rows = asking.select(*names, F.lit(True).alias("asks")).union(given.select(*names, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: list[dict] = []

        def out() -> pa.RecordBatch:
            own = [Piece(r["text"], r["lo"], np.frombuffer(r["data"], np.uint32), np.frombuffer(r["members"], _MEMBER), r["block"], r["asks"]) for r in unit]
            made = [x[:7] for x in both_ways(meet(own, unit[0]["home"], between=True) if any(p.asks for p in own) else [])]
            unit.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 7, [pa.int64()] * 6 + [pa.float64()], strict=True)], [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if unit and any(unit[0][n] != r[n] for n in ("home", "part", "to")):
                    yield out()
                unit.append(r)
        if unit:
            yield out()

    return rows.repartition("home", "part", "to").sortWithinPartitions("home", "part", "to").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to rows (doc_id, start_word, end_word, match_doc_id, match_start_word, match_end_word, similarity)."""
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    classes = keyed.groupBy("text_id").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"))
    buckets = 8 << int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()  # a task holds an eighth of its partition at a time, or less
    found = materialise(candidates(linked_windows(keyed, buckets)).withColumn("pid", F.monotonically_increasing_id()))
    copied = classes.where("rep < other").selectExpr("text_id", "-1L AS pid", "2 AS side", "0 AS lo", "0 AS hi", "0 AS block", "CAST(NULL AS BINARY) AS members")
    sides = [found.where("members is null").selectExpr(f"{t} AS text_id", "pid", f"{i} AS side", f"l{t} AS lo", f"r{t} AS hi", "0 AS block", "members") for i, t in enumerate("ab")]
    pieces = found.where("members is not null")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum(F.col("ra") - F.col("la") + 1) / BLOCK_TOKENS, F.sum(F.length("members")) / (_MEMBER.itemsize * BLOCK_MEMBERS)))
    dealt = pieces.join(pieces.groupBy("b").agg(blocks.cast("int").alias("blocks")), "b")
    block = F.when(F.col("a") == F.col("b"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")))
    side = F.when((F.col("blocks") > 1) & (F.col("a") != F.col("b")), 4).otherwise(3)  # 4: goes on to meet other blocks
    homes = dealt.select(F.col("a").alias("text_id"), F.col("b").alias("pid"), side.alias("side"), F.col("la").alias("lo"), F.col("ra").alias("hi"), F.explode(block).alias("block"), "members")
    every = sides[0].union(sides[1]).union(homes).union(copied)
    asked = every.groupBy("text_id").agg(F.collect_list(F.struct("pid", "side", "lo", "hi", "block", "members")).alias("asked"))
    wanted = asked.join(classes, "text_id").select(F.col("text_id").alias("tid"), "rep", "asked")
    cut = "pid long, side int, text_id long, lo int, data binary, block int, members binary"

    def slice_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
        for batch in batches:
            for text_id, text, asked in zip(*batch.columns, strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                starts, ends, first = words(data, np.array([0, len(data)]))
                hashes = shingles(word_hashes(data, starts, ends, 71, fold_case=True), first, WORDS, whole=False)[0]
                hashes = (hashes >> np.uint64(32)).astype(np.uint32)  # two different tokens of a pair of passages agree once in 4 * 10**9
                rows = [(a["pid"], a["side"], text_id.as_py(), len(starts) if a["side"] == 2 else a["lo"], b"" if a["side"] == 2 else hashes[a["lo"] : a["hi"] + 1].tobytes(), a["block"], a["members"]) for a in asked.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in cut.split(", ")])

    texts = keyed.join(wanted.hint("shuffle_hash"), (F.col("text_id") == F.col("tid")) & (F.col("doc_id") == F.col("rep"))).select("text_id", "text", "asked")
    passage = [f"{n} long" for n in ("text_id", "start_word", "end_word", "match_id", "match_start_word", "match_end_word")] + ["similarity double"]
    checks = ", ".join([*passage, "block int", "data binary", "members binary"])
    none = (None, None, None)

    def both_ways(found: list[tuple]) -> list[tuple]:
        out = []
        for a, s, e, b, p, q, sim in found:
            one, two = (a, s, e + WORDS - 1), (b, p, q + WORDS - 1)
            out += [(*one, *two, sim, *none), (*two, *one, sim, *none)]
        return out

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        unit: list[dict] = []

        def at_home() -> list[tuple]:
            one = {(r["text_id"], r["lo"]): r for r in unit}.values()  # rows that repeat a doc_id and its text make a piece twice
            own = [Piece(r["text_id"], r["lo"], np.frombuffer(r["data"], np.uint32), np.frombuffer(r["members"], _MEMBER)) for r in one]
            out = both_ways(meet(own, unit[0]["pid"]))
            unit.clear()
            return out + [(p.text, p.lo, 0, r["pid"], 0, 0, 1.0, r["block"], r["data"], p.members.tobytes()) for p, r in zip(own, one, strict=True) if r["side"] == 4]

        types = [pa.int64()] * 6 + [pa.float64(), pa.int32(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in checks.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["side"] == 2:
                    rows.append((r["text_id"], 0, r["lo"], None, 0, r["lo"], 1.0, *none))  # a text with copies and its number of words
                elif r["side"] > 2:
                    if unit and (unit[0]["pid"], unit[0]["block"]) != (r["pid"], r["block"]):
                        yield batch_of(at_home())
                    unit.append(r)
                elif held is None or held["pid"] != r["pid"]:
                    held = r
                elif held["side"] == 0 and r["side"] == 1:  # rows that repeat a doc_id and its text make a side twice
                    a, b, held = held, r, r
                    rows += both_ways([(a["text_id"], s + a["lo"], e + a["lo"], b["text_id"], p + b["lo"], q + b["lo"], sim) for s, e, p, q, sim in either_way(np.frombuffer(a["data"], np.uint32), np.frombuffer(b["data"], np.uint32))])
            yield batch_of(rows)
        if unit:
            yield batch_of(at_home())

    place = F.when(F.col("side") < 2, F.col("pid")).when(F.col("side") == 2, F.col("text_id")).otherwise(F.xxhash64("pid", "block"))
    checked = materialise(texts.mapInArrow(slice_tokens, cut).repartition(place).sortWithinPartitions(F.col("side") > 2, "pid", "block", "side").mapInArrow(check, checks))
    near = checked.where("match_id is not null and data is null").drop("block", "data", "members")
    wide = checked.where("data is not null")
    if not wide.isEmpty():
        near = near.union(across(wide, both_ways, ", ".join(passage)))
    near = near.distinct()
    rep = classes.select("text_id", "rep")
    near = near.join(rep, "text_id").withColumnRenamed("rep", "doc_id").join(rep.toDF("match_id", "match_doc_id"), "match_id")
    counts = checked.where("match_id is null and end_word >= 50").select("text_id", F.col("end_word").alias("n")).distinct()
    many = counts.join(classes.where("rep < other"), "text_id")
    copies = keyed.select("doc_id", "text_id").distinct().join(many, "text_id").select(
        "doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.when(F.col("doc_id") == F.col("rep"), F.col("other")).otherwise(F.col("rep")).alias("match_doc_id"), F.lit(0).cast("long").alias("match_start_word"), F.col("n").alias("match_end_word"), F.lit(1.0).alias("similarity")
    )
    columns = ["doc_id", "start_word", "end_word", "match_doc_id", "match_start_word", "match_end_word", "similarity"]
    return near.select(columns).union(copies.select(columns))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
