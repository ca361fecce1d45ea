"""Running sums over a whole table, without a task that reads all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.sources.session import materialise


def running_sums(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """df with a long column for each entry of `sums`: the sum over all rows that stand before the row in `order`, itself left out.

    The table is range-partitioned by the order and checkpointed; each partition's total is summed (one row a partition reaches the
    driver), and a partition starts from the total of those before it. Rows that tie in `order` meet in one partition and stand there in any
    order, so `order` should end with what tells rows apart. A null counts as 0; an empty table stays empty.
    """
    names = list(sums)
    added = df.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(n) for n, c in sums.items()])
    rows = materialise(added.repartitionByRange(*order).sortWithinPartitions(*order))
    totals = {r[0]: r[1:] for r in rows.groupBy(F.spark_partition_id()).agg(*[F.sum(n) for n in names]).collect()}
    before, start = {}, [0] * len(names)
    for p in sorted(totals):
        before[p] = start
        start = [a + b for a, b in zip(start, totals[p], strict=True)]
    places = [rows.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sofar = list(before.get(TaskContext.get().partitionId(), [0] * len(names)))
        for batch in batches:
            columns = list(batch.columns)
            for k, at in enumerate(places):
                own = columns[at].to_numpy(zero_copy_only=False)
                through = np.cumsum(own, dtype=np.int64) + sofar[k]
                columns[at] = pa.array(through - own)
                sofar[k] = int(through[-1]) if len(through) else sofar[k]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]))


def sums_within(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """As running_sums, but anew for each value of `keys` (not null), whatever share of the rows a value has: the running sums of the whole
    table less those at the value's first row. The added numbers must not be negative."""
    rows = materialise(running_sums(df, [F.col(k) for k in keys] + order, sums))
    first = rows.groupBy(*keys).agg(*[F.min(n).alias(f"_first_{n}") for n in sums])
    joined = rows.join(first, keys)
    return joined.select(*[F.col(f"`{c}`") if c not in sums else (F.col(c) - F.col(f"_first_{c}")).alias(c) for c in rows.columns])
