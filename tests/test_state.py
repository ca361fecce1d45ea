"""Streams that are stopped and started again: sweeps that crash between sending and committing, picks that outlive a run."""

import random

import pytest

from shoal.streaming import state


class Crash(Exception):
    pass


@pytest.fixture
def requests(spark, tmp_path):
    def add(ids):
        rows = [(f"k{i % 3}", i) for i in ids]
        spark.createDataFrame(rows, "key string, id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    add([])
    add.stream = lambda: spark.readStream.schema("key string, id long").parquet(f"{tmp_path}/in")
    return add


def sent_to(folder):
    """A service that writes down each call."""

    def sink(key, ids):
        import os
        import uuid

        if any(i % 7 == 0 for i in ids):
            raise ValueError("refused")
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{key} {' '.join(map(str, ids))}")

    return sink


def calls(folder):
    return sorted(int(i) for f in folder.iterdir() for i in f.read_text().split()[1:])


def test_a_sweep_that_crashes_after_sending_is_not_sent_again(spark, tmp_path, requests):
    ledger, sink, numbers = f"{tmp_path}/ledger", sent_to(f"{tmp_path}/service"), []

    def crash(number):
        raise Crash

    requests(range(1, 40))
    with pytest.raises(Exception, match="Crash"):
        state.sweep(requests.stream(), sink, ledger, 10, crash, availableNow=True).start().awaitTermination()
    want = [i for i in range(1, 40) if i % 7]
    assert calls(tmp_path / "service") == want
    requests(range(40, 50))
    state.sweep(requests.stream(), sink, ledger, 10, numbers.append, availableNow=True).start().awaitTermination()
    assert calls(tmp_path / "service") == [i for i in range(1, 50) if i % 7]  # each once, though sweep 0 ran twice
    assert numbers == [0, 1]
    said = {r["id"]: (r["outcome"], r["sweep"]) for r in state.outcomes(spark, ledger).collect()}
    assert said == {i: ("filed" if i % 7 else "refused", int(i >= 40)) for i in range(1, 50)}


def test_a_lost_connection_stops_the_sweep_and_leaves_it_to_be_sent(spark, tmp_path, requests):
    def down(key, ids):
        raise ConnectionError("down")

    requests(range(1, 5))
    ledger = f"{tmp_path}/ledger"
    with pytest.raises(Exception, match="down"):
        state.sweep(requests.stream(), down, ledger, availableNow=True).start().awaitTermination()
    state.sweep(requests.stream(), sent_to(f"{tmp_path}/service"), ledger, availableNow=True).start().awaitTermination()
    assert calls(tmp_path / "service") == [1, 2, 3, 4]


def test_picks_are_restored_by_later_batches_and_runs(spark, tmp_path):
    rng, source = random.Random(2), f"{tmp_path}/asked"
    schema = "owner long, session string, item long, draw string"
    spark.createDataFrame([], schema).write.parquet(source)
    picked, had = {}, {}

    def put(batch, number):
        had.setdefault(number, {(r["owner"], r["session"]): (r["item"], r["restored"]) for r in batch.collect()})

    with state.keyed_state(spark):
        for run in range(3):
            rows = [(rng.randrange(6), f"day {rng.randrange(1 + run)}", i, f"{rng.randrange(4)}") for i in range(run * 40, run * 40 + 25)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            had.clear()
            stream = state.session_picks(spark.readStream.schema(schema).parquet(source))
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(put).trigger(once=True).start().awaitTermination()
            want = {}
            for key in {(o, s) for o, s, _, _ in rows}:
                want[key] = (picked[key], True) if key in picked else (min((d, i) for o, s, i, d in rows if (o, s) == key)[1], False)
            assert {k: v for batch in had.values() for k, v in batch.items()} == want
            picked |= {k: i for k, (i, _) in want.items()}
    assert len(picked) > 8


def test_picks_are_forgotten_after_their_time(spark, tmp_path):
    import time

    source, schema, seen = f"{tmp_path}/asked", "owner long, session string, item long, draw string", []
    with state.keyed_state(spark):
        for item in (1, 2):
            spark.createDataFrame([(1, "s", item, "d")], schema).coalesce(1).write.mode("append").parquet(source)
            stream = state.session_picks(spark.readStream.schema(schema).parquet(source), "1 second")
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, _: seen.extend((r["item"], r["restored"]) for r in b.collect())).trigger(once=True).start().awaitTermination()
            time.sleep(1.5)
    assert seen == [(1, False), (2, False)]


def test_sessions_share_rows_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "STATES", 8, raising=False)
    source, schema, seen = f"{tmp_path}/asked", "owner long, session string, item long, draw string", []
    own = lambda n: (None if n == 7 else (1 << 60) + n % 50, None if n % 90 == 5 else f"s{n % 90}")
    with state.keyed_state(spark):
        for run in range(2):
            spark.createDataFrame([(*own(n), run * 1000 + n, f"{n % 3}") for n in range(300)], schema).coalesce(1).write.mode("append").parquet(source)
            stream = state.session_picks(spark.readStream.schema(schema).parquet(source))
            query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, _: seen.append({(r["owner"], r["session"]): (r["item"], r["restored"]) for r in b.collect()})).trigger(once=True).start()
            query.awaitTermination()
            assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    want = {k: min((f"{n % 3}", n) for n in range(300) if own(n) == k)[1] for k in map(own, range(300))}
    assert seen == [{k: (i, False) for k, i in want.items()}, {k: (i, True) for k, i in want.items()}]
