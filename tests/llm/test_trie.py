"""The trie of conversations against a sequential one."""

import hashlib
import random
import zlib

import pytest

from shoal.llm import trie
from shoal.llm.registry import QUERIES

ROWS = "conv_id long, turn long, role string, text string, depth long, owner string"


def brute(rows):
    own = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    nodes = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + t[h:]
        for d in range(len(full) + 1):
            nodes.setdefault(tuple(full[:d]), []).append((c, d == len(full)))
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def walk(p):
        stack, order = [p], []
        while stack:
            order.append(stack.pop())
            stack += children.get(order[-1], [])
        return order

    for p, members in nodes.items():
        below = walk(p)
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(c for c, _ in members), len(p), parent, len(members), len(children.get(p, [])), sum(q not in children for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd(seed):
    rng = random.Random(seed)
    texts = ["", None, "hi", "é", "one", "two", "x" * 500]
    rows = []
    for c in [*range(130), 205, 207, 300, 399, -1, -100, -105, 10**12, None]:
        rows += [(c, rng.choice([None, *range(9)]) if rng.random() < 0.2 else t, rng.choice(["user", "assistant", None, ""]), rng.choice(texts)) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 470) for t in range(9)]  # copies
    rows += [(c, t, "user", f"deep {t}") for c in (501, 502, 503) for t in range(c - 430)]  # prefixes of one another
    rows += [rows[5], rows[5], rows[40]]
    rng.shuffle(rows)
    return [(*r, 1, "z") for r in rows]


@pytest.mark.parametrize("block", [64, 3])
def test_nodes_of_odd_conversations(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = odd(block)
    spark.createDataFrame(rows, ROWS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    have = sorted(map(tuple, QUERIES["op11_conversation_trie"](spark, str(tmp_path)).collect()), key=str)
    assert have == brute([r[:4] for r in rows])


def test_ranks_are_the_preorder(spark):
    rows = [(c, d, bytes([x]), 1) for c, p in enumerate([[1, 2, 3], [1, 2], [1, 3], [0], [2, 2, 2, 2], []]) for d, x in enumerate(p, 1)]
    out = trie.trie(spark.createDataFrame(rows, "conv_id long, depth long, digest binary, chars long"), spark.range(6).toDF("conv_id"))
    have = [(r["conv_id"], r["depth"], r["last"] - r["rank"] + 1) for r in sorted(out.collect(), key=lambda r: r["rank"])]
    assert have == [(0, 0, 10), (3, 1, 1), (0, 1, 4), (0, 2, 2), (0, 3, 1), (2, 2, 1), (4, 1, 4), (4, 2, 3), (4, 3, 2), (4, 4, 1)]


def test_no_conversations_and_turnless_ones(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["op11_conversation_trie"](spark, f"{tmp_path}/none").collect() == []
    c = next(c for c in range(1000) if zlib.crc32(str(c).encode()) % 6 > 2 and c % 100)
    spark.createDataFrame([(c, 0, "user", "gone", 1, "z")], ROWS).write.parquet(f"{tmp_path}/one/conversations.parquet")
    ends = hashlib.sha256(str(c).encode()).hexdigest()
    assert list(map(tuple, QUERIES["op11_conversation_trie"](spark, f"{tmp_path}/one").collect())) == [(c, 0, None, 1, 0, 1, 0, ends)]
