"""Queries and operators that SQL cannot express, against sequential versions."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (its plans register their queries)
from shoal.operators import lineage, panorama, selection, sequences, stereo, units
from shoal.plans.catalog import QUERIES
from shoal.streaming import state


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def greedy(pairs):
    left, right, out = set(), set(), set()
    for p in sorted(pairs):
        if p[-2] not in left and p[-1] not in right:
            left.add(p[-2])
            right.add(p[-1])
            out.add((p[-2], p[-1]))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_greedy_pairs(spark, seed):
    """Several rounds, with ties and with chains in which one pair frees or takes another's side."""
    rng = random.Random(seed)
    pairs = {(rng.randrange(6), a, b) for a in range(25) for b in range(20) if rng.random() < 0.4} | {(100 - i, i, i + 1) for i in range(30, 45)} | {(100 - i, i, i) for i in range(30, 45)}
    pairs = {(min(d for d, x, y in pairs if (x, y) == (a, b)), a, b) for _, a, b in pairs}
    got = selection.greedy_pairs(spark.createDataFrame(list(pairs), "bits long, l long, r long"), "l", "r", ["bits"])
    assert got.columns == ["l", "r", "bits"] and {(x.l, x.r) for x in got.collect()} == greedy(pairs)


def test_pair_eyes_query(spark, small):
    data = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    bits = {r.vec_id: (np.array(r.embedding) > 0, r.label) for r in data.itertuples()}
    pairs = [(int((bits[a][0] != bits[b][0]).sum()), a, b) for a in bits for b in bits if a % 2 == 0 and b % 2 == 1 and bits[a][1] == bits[b][1]]
    want = greedy([p for p in pairs if p[0] <= 26])
    assert {(r.left_id, r.right_id) for r in QUERIES["mat_pair_eyes"](spark, small).collect()} == want


def aligned(a, b, side, shift):
    a, b = (np.array(x).reshape(side, side) for x in (a, b))
    return min(np.abs(a[:, max(0, -k) : side - max(0, k)] - b[:, max(0, k) : side - max(0, -k)]).mean() for k in range(-shift, shift + 1))


def every_pair(lefts, rights, most):
    """All left with all right frames of an album, rough grids first."""
    half = lambda g: np.floor(np.array(g).reshape(8, 2, 8, 2).mean((1, 3)))
    for x in lefts:
        for y in rights:
            if x.album_id == y.album_id and aligned(half(x.g), half(y.g), 8, 2) <= most:
                yield x.asset_id, y.asset_id, round(float(aligned(x.g, y.g, 16, 3)), 6)


def test_dark_and_bright_frames_are_not_compared(spark):
    """Frames that differ in their mean luma alone: all near pairs are found, few others are looked at."""
    rng = np.random.default_rng(4)
    made = [(side, k, 0, (np.clip(rng.normal(level, 6, 64), 0, 255)).tolist()) for side in "LR" for k, level in enumerate(rng.uniform(10, 245, 60))]
    left, right = (spark.createDataFrame([(k + 100 * (s == "R"), a, g) for s, k, a, g in made if s == side], "asset_id long, album_id long, g array<double>") for side in "LR")
    pairs = stereo.scored_pairs(left, right, "album_id", (8, 2), (8, 2), 12.0).collect()
    want = {(i, j + 100) for s, i, _, g in made for t, j, _, h in made if (s, t) == ("L", "R") and aligned(g, h, 8, 2) <= 12}
    assert {(r.left_id, r.right_id) for r in pairs if r.rough <= 12} == want and len(want) <= len(pairs) < 3600 / 4


def test_both_eyes_and_report(spark, small):
    from shoal.plans import stereo as plan

    left, right, pairs, matched = plan.both_eyes(spark, small)
    every = pairs.collect()
    rows = [(r.distance, r.drift, r.left_id, r.right_id) for r in every if r.distance is not None]
    lefts, rights = ([r for r in x.select("album_id", "asset_id", "g").collect()] for x in (left, right))
    sided = {r.album_id for r in rights if r.g is not None}
    met = {r.asset_id for r in lefts if r.album_id in sided}
    near = {(a, b): x for a, b, x in every_pair([r for r in lefts if r.g], [r for r in rights if r.g], plan.ROUGH)}
    assert {(r[2], r[3]): round(r[0], 6) for r in rows} == near
    assert {(r.left_id, r.right_id): r.distance for r in QUERIES["join_eye_candidates"](spark, small).collect()} == {k: x for k, x in near.items() if x <= plan.MOST}
    want = greedy([r for r in rows if r[0] <= plan.MOST])
    assert {(r.left_id, r.right_id) for r in matched.collect()} == want and {(r.left_id, r.right_id) for r in QUERIES["mat_both_eyes"](spark, small).collect()} == want
    report = {r.asset_id: r for r in QUERIES["mat_report"](spark, small).collect()}
    frames = {r.asset_id: r.g is not None for r in left.collect()}
    assert set(report) == set(frames)
    partner = dict(want)
    for a, hashed in frames.items():
        own = [(d, r) for d, _, x, r in rows if x == a]
        assert report[a].outcome == ("paired" if a in partner else "notHashed" if not hashed else "rejected" if a in met else "noCandidates")
        if a in partner:
            assert report[a].other_id == partner[a]
        elif own and hashed:
            assert report[a].other_id == min(own)[1] and report[a].reason == ("over tolerance" if min(own)[0] > plan.MOST else "taken")


def build(rng):
    """Units of some albums, overlapping within an album."""
    out = []
    for album in range(12):
        for u in range(rng.randrange(1, 12)):
            out.append((f"u:{album}:{u}", "burst", album, None, sorted({100 * album + rng.randrange(12) for _ in range(rng.randrange(1, 4))})))
    return out


@pytest.mark.parametrize("limit", [10, 30, 200])
def test_select_units(spark, limit):
    rows = build(random.Random(4))
    df = spark.createDataFrame(rows, "unit_id string, kind string, album_id long, original_id long, members array<long>")
    got = units.select_units(df, F.when(F.col("album_id") % 4 == 0, 3).otherwise(1), limit, 4, "s").collect()
    by_album = {}
    for u, _, album, _, members in rows:
        by_album.setdefault(album, []).append((md5("s:unit", u), u, members))
    order = sorted(by_album, key=lambda a: min(md5("s:album", a, c) for c in range(1, 4 if a % 4 == 0 else 2)))
    used, picked, later = set(), [], []
    for a in order:
        taken = 0
        for _, u, members in sorted(by_album[a]):
            if len(picked) >= limit:
                break
            if taken >= 4:
                later.append((md5("s:rest", u), u, members))
            elif not used & set(members):
                used |= set(members)
                picked.append(u)
                taken += 1
    for _, u, members in sorted(later):
        if len(picked) < limit and not used & set(members):
            used |= set(members)
            picked.append(u)
    assert sorted(r.unit_id for r in got) == sorted(picked) and all(r.place == md5("s:deck", r.unit_id) for r in got)


def test_buffer_fill(spark):
    rows = build(random.Random(5))
    df = spark.createDataFrame(rows, "unit_id string, kind string, album_id long, original_id long, members array<long>").withColumn("place", F.md5("unit_id"))
    verdicts = spark.createDataFrame([(i, "kept" if i % 9 == 0 else "backlog") for i in range(1200)], "asset_id long, status string")
    shown = spark.createDataFrame([(i,) for i in range(0, 1200, 13)], "asset_id long")
    got = {r.unit_id for r in units.buffer_fill(df, verdicts, shown, 8).collect()}
    drawn = sorted((md5(u), u, m) for u, _, _, _, m in rows)
    assert got == {u for _, u, m in [x for x in drawn if not any(i % 9 == 0 or i % 13 == 0 for i in x[2])][:8]}
    assert QUERIES["lim_buffer_fill"] and got


def test_settle(spark):
    """Against the rule told day by day: pauses, freezes spent by a failed rescue, freezes earned."""
    rng, rows, want = random.Random(6), [], set()
    for user in range(40):
        day, run, held, spent, last = 0, 0, 0, 0, None
        for _ in range(rng.randrange(1, 60)):
            day += rng.choice([1, 1, 1, 1, 2, 3, 6])
            met, work = rng.random() < 0.8, rng.random() < 0.7
            rows.append((user, f"{pd.Timestamp('2024-01-01') + pd.Timedelta(days=day):%F}", met, work))
            missed = 0 if last is None or not work else day - last - 1
            if missed <= held:
                held, spent = held - missed, spent + missed
            else:
                run, spent, held = 0, spent + held, 0
            if met:
                run += 1
                held = min(held + (run % 5 == 0), 2)
            last = day
        want.add((user, run, held, spent))
    days = spark.createDataFrame(rows, "user_id long, day string, met boolean, work boolean").withColumn("day", F.to_date("day"))
    assert {(r.user_id, r.streak, r.freezes, r.spent) for r in sequences.streaks_with_freezes(days, 5, 2).collect()} == want


def test_settle_query(spark, small):
    got = {r.user_id: r for r in QUERIES["win_settle"](spark, small).collect()}
    e = spark.read.parquet(f"{small}/events.parquet").select("user_id", F.to_date("ts").alias("day"), "event_type").toPandas()
    for user, own in e.groupby("user_id"):
        run = held = spent = 0
        last = None
        for day, rows in sorted(own.groupby("day"), key=lambda x: x[0]):
            missed = (day - last).days - 1 if last is not None and (rows.event_type != "click").any() else 0
            if missed <= held:
                held, spent = held - missed, spent + missed
            else:
                run, spent, held = 0, spent + held, 0
            if len(rows) >= 2:
                run += 1
                held = min(held + (run % 7 == 0), 3)
            last = day
        assert (got[user].streak, got[user].freezes, got[user].spent) == (run, held, spent)


def test_low_water(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    want = []
    for user, own in e.groupby("user_id"):
        on = False
        for r in own.itertuples():
            now = r.value <= 10.0 or (on and r.value < 60.0)
            if now != on:
                want.append((user, r.event_id, now))
            on = now
    assert sorted((r.user_id, r.event_id, r.low) for r in QUERIES["lim_low_water"](spark, small).collect()) == sorted(want)


def test_seams_of_shifted_pictures():
    """A band moved by a known overlap is found on its axis and in its direction."""
    rng = np.random.default_rng(0)
    opts = panorama.Options(side=64)
    wide = rng.integers(0, 255, (64, 100)).astype(float)
    a, b = wide[:, :64][None], wide[:, 36:][None]
    score, overlap, forward = panorama.best_seams(a, b, True, opts)
    assert score[0] < 1e-9 and overlap[0] == 28 / 64 and bool(forward[0])
    score, overlap, forward = panorama.best_seams(b.transpose(0, 2, 1), a.transpose(0, 2, 1), False, opts)
    assert score[0] < 1e-9 and not forward[0]
    assert panorama.best_seams(np.full((1, 64, 64), 7.0), b, True, opts)[0][0] == np.inf


def test_majority_matches(spark):
    rng = random.Random(1)
    r = {i: {0} | {rng.randrange(1, 40) for _ in range(rng.randrange(1, 6))} for i in range(60)}
    d = {100 + i: {0} | {rng.randrange(1, 40) for _ in range(rng.randrange(1, 6))} for i in range(60)}
    rows = lambda x: spark.createDataFrame([(k, a) for k, v in x.items() for a in v], "set_id long, asset_id long")
    want = {(i, j, len(x & y)) for i, x in r.items() for j, y in d.items() if 2 * len(x & y) > len(x | y)}
    assert want and {tuple(t) for t in lineage.majority_matches(rows(r), rows(d)).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.node: r.component for r in lineage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_components_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 7), (9, 8)], "a long, b long").mapInArrow(count, "a long, b long")
    got = {r.node: r.component for r in lineage.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8} and made.value == 4


def test_send(spark):
    """A refused batch is sent again row by row; a lost connection fails the job; every batch is of one key."""
    calls = spark.sparkContext.accumulator(0)

    def sink(key, ids):
        calls.add(1)
        if "lost" in key:
            raise ConnectionError
        if any(i % 100 == 0 for i in ids):
            raise ValueError
        assert len(ids) <= 10

    rows = [(k, i) for k in "ab" for i in range(1, 231)]
    got = {(r.key, r.id): r.outcome for r in state.send(spark.createDataFrame(rows, "key string, id long"), sink, 10).collect()}
    assert got == {(k, i): "refused" if i % 100 == 0 else "filed" for k, i in rows} and calls.value == 2 * (23 + 2 * 10)
    with pytest.raises(Exception, match="ConnectionError"):
        state.send(spark.createDataFrame([("lost", 1)], "key string, id long"), sink).collect()
    assert state.send(spark.createDataFrame([], "key string, id long"), sink).count() == 0


def test_near_sets_let_missing_sides_pass(spark):
    rows = [(1, 0, 0, 0, 1.0, 1.0), (2, 0, 1, 0, 1.0, 1.0001), (3, 0, None, None, None, None), (4, 0, -1, -1, 1.0, 1.0), (5, 0, 0, 0, 50.0, 1.0), (6, 1, 0, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "asset_id long, album_id long, lo long, hi long, lat double, lng double")
    assert {(r.a, r.b) for r in stereo.near_sets(df, "album_id", 4, 100.0).collect()} == {(1, 2), (1, 3), (2, 3), (3, 4), (3, 5)}


def test_merge_sets_of_all_groups(spark, small):
    """Groups that share an asset, over the whole table, against a union-find."""
    rows = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    first = {}
    for group, asset in rows:
        a, b = find(group), find(first.setdefault(asset, group))
        root[max(a, b)] = min(a, b)
    assert {r["node"]: r["component"] for r in QUERIES["clu_merge_sets"](spark, small).collect()} == {g: find(g) for g, _ in rows}


def camera(document):
    """The walk as a recursive one over parsed JSON."""
    import json

    root, out = json.loads(document), {}
    own = root.get("camera") if isinstance(root, dict) else None
    said = (own["serial"] if own.get("serial") is not None else own["make"] if own.get("make") is not None else own.get("model")) if isinstance(own, dict) else None
    if said is not None and said != "" and said != 0:
        return tuple(own.get(k) if isinstance(own.get(k), str) else None for k in ("serial", "make", "model"))

    def visit(node):
        for key, value in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else []:
            k = str(key).lower()
            if isinstance(value, str):
                if not out.get("serial") and "serial" in k:
                    out["serial"] = value
                elif not out.get("make") and k == "make":
                    out["make"] = value
                elif not out.get("model") and k == "model":
                    out["model"] = value
            else:
                visit(value)

    visit(root)
    return tuple(out.get(k) or None for k in ("serial", "make", "model"))


def test_camera_identity(spark):
    import json

    from shoal.functions import rules

    rng = random.Random(6)
    keys = ["serial", "bodySerialNumber", "Make", "MODEL", "x", "camera", "a\"serial\": \"no", "lens"]

    def made(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return rng.choice(["", "v1", "v2", None, 7, True, 'text with "serial": "no"', "\\u00e9 \n"])
        if kind == 3:
            return [made(depth - 1) for _ in range(rng.randrange(3))]
        return {k: made(depth - 1) for k in rng.sample(keys, rng.randrange(5))}

    docs = [json.dumps(made(4)) for _ in range(600)] + ['{"camera": {"serial": "", "make": "m"}, "exif": {"Serial": "deep"}}', '{"camera": {"make": "m"}, "serial": "s"}', '{"serial": "", "x": {"mySerial": "later"}}', '[[{"model": "M"}], {"model": "N"}]']
    odd = [None, "", "no json", "[" * 100_000, "3"]
    got = [tuple(r["c"]) for r in spark.createDataFrame([(k, x) for k, x in enumerate(docs + odd)], "k long, doc string").select("k", rules.camera_identity("doc").alias("c")).orderBy("k").collect()]
    assert got[: len(docs)] == [camera(x) for x in docs] and got[len(docs) :] == [(None, None, None)] * 5


def test_signatures_of_real_sizes(spark):
    from shoal.operators import vectors

    rng = np.random.default_rng(3)
    pictures = [(k, rng.integers(0, 256, 4 * w * h).astype(np.uint8).tobytes(), w, h) for k, (w, h) in enumerate([(640, 480), (100, 300), (64, 64), (40, 7), (1, 1)])]
    df = spark.createDataFrame([*pictures, (9, b"abc", 2, 2), (10, None, 2, 2)], "k long, rgba binary, w int, h int")
    have = {r["k"]: r["s"] for r in df.select("k", vectors.signature(F.col("rgba"), F.col("w"), F.col("h")).alias("s")).collect()}
    assert have.pop(9) is None and have.pop(10) is None
    for k, rgba, w, h in pictures:
        want = []
        for oy in range(64):
            for ox in range(64):
                y0, x0 = oy * h // 64, ox * w // 64
                total, n = 0.0, 0
                for y in range(y0, max(y0 + 1, (oy + 1) * h // 64)):
                    for x in range(x0, max(x0 + 1, (ox + 1) * w // 64)):
                        r, g, b = rgba[4 * (y * w + x) : 4 * (y * w + x) + 3]
                        total, n = total + (0.299 * r + 0.587 * g + 0.114 * b), n + 1
                want.append(int(total / n))
        assert have[k] == want


def test_partitions_are_replaced_and_others_keep_their_files(spark, tmp_path):
    import os

    from shoal.operators import tables

    path = f"{tmp_path}/t"
    spark.range(30).selectExpr("id % 3 AS album_id", "id").write.partitionBy("album_id").parquet(path)
    files = lambda: {(d, f): os.stat(f"{path}/{d}/{f}").st_mtime_ns for d in os.listdir(path) if "=" in d for f in os.listdir(f"{path}/{d}")}
    before = files()
    tables.replace_partitions(spark.createDataFrame([(1, 100), (1, 101), (5, 500)], "album_id long, id long"), path, ["album_id"])
    after = files()
    assert {k: v for k, v in after.items() if k[0] in ("album_id=0", "album_id=2")} == {k: v for k, v in before.items() if k[0] in ("album_id=0", "album_id=2")}
    rows = lambda: sorted((r["album_id"], r["id"]) for r in spark.read.parquet(path).collect())
    want = sorted([(i % 3, i) for i in range(30) if i % 3 != 1] + [(1, 100), (1, 101), (5, 500)])
    assert rows() == want
    failing = spark.range(40).selectExpr("id % 3 AS album_id", "CASE WHEN id = 39 THEN raise_error('stop') ELSE id END AS id")
    with pytest.raises(Exception, match="stop"):
        tables.replace_partitions(failing, path, ["album_id"])
    assert rows() == want


def test_several_undos_in_a_row(spark):
    from shoal.operators import tables

    rng = random.Random(7)
    actions = [(owner, seq, rng.random() < 0.45, rng.randrange(5), rng.choice("abx")) for owner in range(8) for seq in range(60)]
    log = spark.createDataFrame(actions, "owner long, seq long, undo boolean, slot long, status string")
    initial = [(f"{o}:{s}", "new") for o in range(8) for s in range(0, 5, 2)]
    for version in (0, 13, 59):
        stand = tables.standing(log.where(F.col("seq") <= version), "owner", "seq", "undo")
        changes = stand.select(F.concat_ws(":", "owner", "slot").alias("key"), "seq", "status", (F.col("status") == "x").alias("gone"))
        have = {r["key"]: r["status"] for r in tables.replayed(spark.createDataFrame(initial, "key string, status string"), changes, "key", "seq", "gone").collect()}
        want = dict(initial)
        for owner in range(8):
            stack = []
            for o, seq, undo, slot, status in actions:
                if o == owner and seq <= version:
                    if undo:
                        stack = stack[:-1]
                    else:
                        stack.append((slot, status))
            for slot, status in stack:
                want[f"{owner}:{slot}"] = status
                if status == "x":
                    del want[f"{owner}:{slot}"]
        assert have == want


@pytest.mark.parametrize("bits", [0, 5, 10, 22])
def test_near_sets_against_all_pairs(spark, bits):
    """Random hashes around a few, places around the poles, the date line and elsewhere, missing sides; each pair once."""
    import math

    rng = random.Random(bits)
    centres, spots = [rng.getrandbits(64) for _ in range(6)], [(52.1, 5.1), (89.9999, 10.0), (89.9999, -170.0), (-90.0, 0.0), (0.0, 179.9999), (0.0, -179.9999)]
    rows = []
    for i in range(220):
        h = centres[rng.randrange(6)]
        for b in rng.sample(range(64), rng.randrange(8)):
            h ^= 1 << b
        lat, lng = rng.choice(spots)
        lat, lng = max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * 4e-4)), lng + rng.uniform(-1, 1) * 4e-4
        kind = rng.random()
        lo, hi = (None, None) if kind < 0.1 or rng.random() < 0.05 else (h & 0xFFFFFFFF, h >> 32)
        rows.append((i, rng.randrange(2), lo, hi, None if kind < 0.05 or kind > 0.8 else lat, None if kind > 0.75 else lng))
    rows.append((900, 0, None, None, None, 1.0))

    def near(x, y):
        if x[1] != y[1]:
            return False
        if x[2] is not None and y[2] is not None and (x[2] ^ y[2]).bit_count() + (x[3] ^ y[3]).bit_count() > bits:
            return False
        if None in (x[4], x[5], y[4], y[5]):
            return True
        a, b = (math.radians(v[4]) for v in (x, y))
        s = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(y[5] - x[5]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(s))) <= 25

    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and near(x, y))
    df = spark.createDataFrame(rows, "asset_id long, album_id long, lo long, hi long, lat double, lng double")
    assert sorted((r.a, r.b) for r in stereo.near_sets(df, "album_id", bits, 25.0).collect()) == want
    joined = {r.asset_id: r.set_id for r in stereo.union_sets(stereo.near_links(df, "album_id", bits, 25.0)).collect()}
    assert joined == {r.asset_id: r.set_id for r in stereo.union_sets(spark.createDataFrame(want, "a long, b long")).collect()}


def test_a_new_frame_comes_last(spark, tmp_path):
    """Groups whose ids lie more than a million apart: the frame put in is smaller than others."""
    import duckdb

    from shoal.plans.catalog import ORACLES

    ids = [0, 10, 20, 5, 3_000_000, 30, 40, 1_000_030, 2_000_000, 7, 2_000_001]
    days = pd.Timestamp("2024-01-01")
    pd.DataFrame({"event_id": ids, "ts": [days] * len(ids), "user_id": [1] * 9 + [2] * 2, "event_type": "x", "value": 1.0, "props": "{}"}).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = {tuple(r) for r in QUERIES["set_toggle"](spark, str(tmp_path)).collect()}
    assert got == set(db.sql(ORACLES["set_toggle"]).fetchall())
    assert ("2:0", "7,2000001,1000007") in got


def test_large_blocks_meet_in_parts(spark):
    """Blocks named as large are dealt in parts: the same pairs, each once, also of cells that are no whole numbers; times come along."""
    rng = np.random.default_rng(5)
    rows = [(k, int(k % 3), 1000 * k, (rng.integers(0, 60, 64) + (0.25 if k % 5 == 0 else 0.0)).tolist()) for k in range(120)]
    left, right = (spark.createDataFrame([r for r in rows if r[0] % 2 == s], "asset_id long, album_id long, at long, g array<double>") for s in (0, 1))
    large = spark.createDataFrame([(0, 4 * stereo.CHUNK), (2, stereo.CHUNK + 1)], "album_id long, n long")
    whole, parts = (sorted(tuple(r) for r in stereo.scored_pairs(left, right, "album_id", (8, 2), (8, 2), 19.0, x).select("album_id", "left_id", "right_id", "distance", "left_at", "right_at").collect()) for x in (None, large))
    want = sorted((a[1], a[0], b[0], a[2], b[2]) for a in rows for b in rows if a[0] % 2 == 0 and b[0] % 2 == 1 and a[1] == b[1] and aligned(a[3], b[3], 8, 2) <= 19)
    assert whole == parts and [(r[0], r[1], r[2], r[4], r[5]) for r in parts] == want and 0 < len(want) < 1200


@pytest.mark.parametrize("part", (4096, 7))
def test_nearest_hashes_in_parts(spark, part):
    from shoal.operators import vectors

    rng = random.Random(part)
    rows = [(k, rng.randrange(-(2**31), 2**32), rng.randrange(8), f"b{k % 3}") for k in range(150)] + [(500, 1, 1, "alone"), (502, 1, 1, None), (503, 1, 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, lo long, hi long, label string")
    bits = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a[1:3], b[1:3], strict=True))
    want = {(a[0], *min((bits(a, b), b[0]) for b in rows if b[0] % 2 and b[3] == a[3])[::-1]) for a in rows if a[0] % 2 == 0 and a[3] is not None and a[0] < 500}
    got = vectors.nearest_hashes(df.where("vec_id % 2 = 0"), df.where("vec_id % 2 = 1"), "label", part)
    assert {tuple(r) for r in got.collect()} == want
    assert max(r["count"] for r in got.groupBy("query").count().collect()) == 1


@pytest.mark.parametrize("bits", (4, 22))
def test_small_and_large_blocks_have_the_same_near_sets(spark, bits):
    """Blocks compared whole and blocks met through cubes and words: the same edges, and few bytes sent for small ones."""
    rng = random.Random(bits)
    rows = [(k, k % 4 if k < 90 else 9, *(None if k % 7 == 0 else rng.choice((0, 7, 2**31, rng.randrange(2**32))) for _ in "lh"), *(None if k % 5 == 0 else 10 + rng.random() / 500 for _ in "xy")) for k in range(110)]
    df = spark.createDataFrame(rows, "asset_id long, album_id long, lo long, hi long, lat double, lng double")
    found = [sorted((r.a, r.b) for r in stereo.near_sets(df, "album_id", bits, 60.0, few).collect()) for few in (0, 20, 256)]
    assert found[0] == found[1] == found[2] and len(set(found[0])) == len(found[0]) > 20


def test_keys_that_share_a_folder_are_replaced(spark, tmp_path):
    """Only the named keys change; a shelf without one keeps its file."""
    import os

    from shoal.operators import tables

    path, cut = f"{tmp_path}/t", "k long, v string, shelf int"
    spark.createDataFrame([(k, f"{k}{x}", k % 3) for k in range(12) for x in "ab"], cut).repartition("shelf").write.partitionBy("shelf").parquet(path)
    before = os.listdir(f"{path}/shelf=2")
    tables.replace_keyed(spark.createDataFrame([(3, "new", 0), (4, "n1", 1), (4, "n2", 1), (15, "more", 0)], cut), path, "k", "shelf")
    got = {(r.k, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {(k, f"{k}{x}") for k in range(12) if k not in (3, 4) for x in "ab"} | {(3, "new"), (4, "n1"), (4, "n2"), (15, "more")}
    assert os.listdir(f"{path}/shelf=2") == before and len(os.listdir(path)) < 6


def test_units_are_built_from_few_readings(spark, small):
    """Edits and group units are kept, not worked out again for each of their uses."""
    plan = QUERIES["hlp_incomplete"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number()") <= 2
    named = spark.createDataFrame([(1, 1, "a.jpg", 1), (1, 2, "A.jpg", 2), (1, 3, "a-Edit.jpg", 3), (None, 4, "a.jpg", 4), (None, 5, "a-Edit.jpg", 5), (2, 6, "b-edit.jpg", 6), (1, 7, None, 7), (1, 8, "A-Enhanced.dng", 8)], "album_id long, asset_id long, name string, ord int")
    assert sorted(map(tuple, lineage.album_edit_pairs(named).collect())) == [(1, 3, 2), (1, 8, 2)]


def test_only_contested_units_go_through_rounds(spark, monkeypatch):
    from shoal.sources import session

    kept, own = [], session.materialise
    monkeypatch.setattr(session, "materialise", lambda df: kept.append(own(df)) or kept[-1])
    rows = [(f"u{i}", i, f"{i:03}") for i in range(60)] + [("x", 3, "000"), ("y", 4, "999")]
    got = sorted(r.unit_id for r in units.disjoint(spark.createDataFrame(rows, "unit_id string, asset_id long, rank string"), "rank").collect())
    assert got == sorted({f"u{i}" for i in range(60)} - {"u3"} | {"x"})
    assert sum(df.count() > 10 for df in kept) == 1


def test_merges_settle_in_one_pass(spark, small):
    from shoal.operators import tables, writes

    plan = QUERIES["dml_merge_settle"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number()") <= 2 and plan.count("Join") <= 8
    rng = random.Random(12)
    verdicts = spark.createDataFrame([(i, rng.choice(["kept", "maybe", None]), rng.choice([True, False, None]), rng.choice([True, False, None])) for i in range(0, 60, 2)], "asset_id long, status string, starred boolean, save_only boolean")
    bases = spark.createDataFrame([(i, "h") for i in range(0, 60, 3)], "asset_id long, hash string")
    merges = spark.createDataFrame([(m, rng.sample(range(60), 4), 1) for m in (3, 8, 90)] + [(20, [20, 21], 1)], "merged_id long, frame_ids array<long>, at int")
    records = merges.where("merged_id < 10").withColumn("at", F.lit(0)).union(spark.createDataFrame([(5, [1], 0)], merges.schema))
    frames = merges.select(F.explode("frame_ids").alias("asset_id"))
    kept, want_bases = writes.stand_down(verdicts, bases, frames)
    want = writes.set_status(kept, merges.select(F.col("merged_id").alias("asset_id")), "toPrint"), want_bases, tables.upsert(records, merges, ["merged_id"])
    for got, own in zip(writes.settle_merge(verdicts, bases, records, merges), want, strict=True):
        assert sorted(map(repr, got.collect())) == sorted(map(repr, own.select(got.columns).collect()))


def test_majority_matches_of_small_and_large_sets(spark):
    rng = random.Random(17)
    base = [rng.sample(range(400), n) for n in (1, 2, 3, 5, 30, 40, 60, 64, 65, 70, 90, 120, 150) for _ in range(3)]
    grown = [sorted(set(rng.sample(b, max(1, int(len(b) * rng.choice((0.6, 0.8, 1.0)))))) | set(rng.sample(range(400), rng.randrange(1 + len(b) // 3)))) for b in base for _ in range(2)]
    r, d = ({i: set(s) for i, s in enumerate(x)} for x in (base, grown))
    frames = [spark.createDataFrame([(i, a) for i, s in x.items() for a in s], "set_id long, asset_id long") for x in (r, d)]
    want = {(i, j, len(s & t)) for i, s in r.items() for j, t in d.items() if 2 * len(s & t) > len(s | t)}
    got = lineage.majority_matches(*frames)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert any(len(r[i]) <= 64 < len(d[j]) for i, j, _ in want) and any(len(r[i]) > 64 and len(d[j]) > 64 for i, j, _ in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan  # small sets are compared where they meet
