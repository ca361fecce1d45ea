"""Stateful operators as Structured Streaming queries.

Sources are append-only files; results are written per batch by foreachBatch, so a restarted query overwrites what it wrote
before. Times are cast to TIMESTAMP first, as watermarks need it. Each function takes the stream and returns the streaming DataFrame;
`drain` runs one to the end of its input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shoal.sources.session import checkpoint_root

STATES = 1 << 12


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_progress(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Counters of each user that start anew every day; in update mode a day's state goes, and rows later than `late` with it, once the
    watermark has passed it."""
    day = F.window("ts", "1 day")
    return log.withWatermark("ts", late).groupBy("user_id", day).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.to_date("window.start").alias("day"), "n", F.round("value", 6).alias("value"))


def sessions(log: DataFrame, gap: str = "3 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user, given out (append mode) once the watermark has passed their end; the state of open ones is all that is kept."""
    window = F.session_window("ts", gap)
    return log.withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_deletions(log: DataFrame) -> DataFrame:
    """First write wins: the earliest entry of each key, however late others come; the state is one row a key. For update mode."""
    return log.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first")).select("user_id", "event_type", F.col("first.event_id").alias("event_id"))


def last_verdicts(log: DataFrame) -> DataFrame:
    """Last write wins; the state is one row a key. For update mode."""
    return log.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last")).select("user_id", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("status"))


def low_water(log: DataFrame, low: float, high: float) -> DataFrame:
    """Hysteresis for each user: on at values up to `low`, off again at `high`; one row for each change."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        on, out = (state.get[0] if state.exists else False), []
        for event_id, value in zip(rows.event_id, rows.value, strict=True):
            now = value <= low or (on and value < high)
            if now != on:
                out.append((key[0], event_id, now))
            on = now
        state.update((on,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "low"])

    return log.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, low boolean", "on boolean", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None, change=None, once: bool = False) -> DataFrame:
    """Runs a stream over what its source holds and returns what it wrote: all rows (append), or with `keys` the newest row of each key
    (update). Every micro-batch writes its own folder, so a batch that is run again replaces what it wrote before. `change` maps a
    micro-batch before it is written. `once` takes all input as one batch: state with a time to live asks for further batches without end."""
    spark = stream.sparkSession
    path = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    change = change or (lambda batch: batch)
    schema = change(spark.createDataFrame([], stream.schema)).schema

    def put(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(**({"once": True} if once else {"availableNow": True})).start()
    query.awaitTermination()
    written = spark.read.schema(schema.add("batch", "long")).parquet(f"{path}/out")
    if keys is None:
        return written.drop("batch")
    rest = [c for c in schema.names if c not in (*keys, "batch")]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def send(requests: DataFrame, sink, batch_rows: int = 50) -> DataFrame:
    """requests(key, id) sent to sink(key, ids) in batches of one key, from the tasks that hold them: (key, id, outcome). A batch that
    is refused is sent again row by row, and a row refused alone is 'refused'; a ConnectionError stops the task, whose rows are sent
    again with the next attempt. The sink must take the same row twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"key": [], "id": []})

        def out(part: pd.DataFrame) -> pd.DataFrame:
            key, ids = part["key"].iloc[0], part["id"].tolist()
            try:
                sink(key, ids)
                return part.assign(outcome="filed")
            except ConnectionError:
                raise
            except Exception:  # refused for one of its rows: each is asked alone
                said = []
                for one in ids:
                    try:
                        sink(key, [one])
                        said.append("filed")
                    except ConnectionError:
                        raise
                    except Exception:
                        said.append("refused")
                return part.assign(outcome=said)

        for frame in frames:
            held = pd.concat([held, frame]) if len(held) else frame
            while len(held):
                same = (held["key"] != held["key"].iloc[0]).to_numpy()
                size = min(int(same.argmax()) if same.any() else len(held), batch_rows)
                if size == len(held) and size < batch_rows:
                    break  # more of this key may follow
                yield out(held.iloc[:size])
                held = held.iloc[size:]
        if len(held):
            yield out(held)

    dealt = requests.select("key", "id").repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInPandas(run, "key string, id long, outcome string")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def sweep(stream: DataFrame, sink, ledger: str, batch_rows: int = 50, after=None, **trigger) -> DataStreamWriter:
    """A stream of requests(key, id) as a writer to start(): what came in together is sent as one sweep, by default 5 seconds after the last
    one began at the earliest. `ledger` is a folder that keeps the stream's checkpoint and the outcomes of each sweep by number. A sweep's
    outcomes are kept before the stream moves on, so a sweep that is run again after a crash is not sent again if they are there; what was
    sent by a sweep that crashed before is sent with it once more, in the same batches. Sweeps of a stream follow each other, and a second
    query on the ledger stops the first, so no two are under way. after(number) is called when a sweep's outcomes are kept."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        kept = f"{ledger}/outcomes/sweep={number}"
        if not _exists(spark, f"{kept}/_SUCCESS"):
            send(batch, sink, batch_rows).write.mode("overwrite").parquet(kept)
        if after is not None:
            after(number)

    return stream.writeStream.trigger(**(trigger or {"processingTime": "5 seconds"})).option("checkpointLocation", f"{ledger}/stream").foreachBatch(put)


def outcomes(spark: SparkSession, ledger: str) -> DataFrame:
    """(key, id, outcome, sweep) of all sweeps in a ledger."""
    return spark.read.schema("key string, id long, outcome string, sweep long").parquet(f"{ledger}/outcomes")


def session_picks(requests: DataFrame, keep: str = "36 hours") -> DataFrame:
    """requests(owner, session, item, draw) to (owner, session, item, restored): one pick for each session, the item of least draw (ties to the
    smaller item) of the batch that first asks for it. It is kept in the state store, so later batches and later runs of the stream
    get the same one back; `keep` after it was picked it is forgotten. Sessions share STATES keys of state by hash, as a call of Python and
    a row of state for each of many millions take far longer than what they do."""
    amount, unit = keep.split()
    keep_ms = int(pd.Timedelta(int(amount), unit.rstrip("s")).total_seconds() * 1000)
    names = ["owner", "session"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        owners, sessions, items, at = state.get if state.exists else ([], [], [], [])
        kept = {(o, s): (i, t) for o, s, i, t in zip(owners, sessions, items, at, strict=True) if t + keep_ms > now}
        best: pd.DataFrame | None = None
        for frame in () if state.hasTimedOut else frames:
            best = pd.concat([frame] if best is None else [best, frame]).sort_values(["draw", "item"]).drop_duplicates(names)
        if best is not None and len(best):
            asked = list(zip(best["owner"], best["session"], strict=True))
            restored = [k in kept for k in asked]
            for k, item in zip(asked, best["item"].tolist(), strict=True):
                kept.setdefault(k, (item, now))
            yield pd.DataFrame({"owner": best["owner"], "session": best["session"], "item": [kept[k][0] for k in asked], "restored": restored})
        if kept:
            state.update(([o for o, _ in kept], [s for _, s in kept], [i for i, _ in kept.values()], [t for _, t in kept.values()]))
            state.setTimeoutDuration(max(t for _, t in kept.values()) + keep_ms - now)
        elif state.exists:
            state.remove()

    keyed = requests.select(F.pmod(F.xxhash64(*names), F.lit(STATES)).alias("key"), F.col("owner").cast("string").alias("owner"), "session", "item", "draw")
    picked = keyed.groupBy("key").applyInPandasWithState(step, "owner string, session string, item long, restored boolean", "owners array<string>, sessions array<string>, items array<long>, at array<long>", "update", GroupStateTimeout.ProcessingTimeTimeout)
    return picked.select(F.col("owner").cast("long").alias("owner"), "session", "item", "restored")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, outside the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
