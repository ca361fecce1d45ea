"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target and so a repetition rate = target / size, and each document is emitted
floor(rate) times plus once more if its seeded hash falls below the rate's fraction. Rates stop at `max_rate`; what a stopped
source cannot take is shared again among the others by weight. With sources in order of (max_rate * size) / weight the stopped
ones are a prefix, so one running sum over the small table of sources finds them without a loop.

Nulls: a null source is a source of its own and comes last; a null or empty text has size 0. A null doc_id is hashed as ''.
Repeated rows are documents of their own and draw alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.shared import materialise, table, word_count

MAX_RATE = 3.0
CYCLE = 3
FEW_SOURCES = 10_000


def source_targets(sizes: DataFrame, max_rate: float = MAX_RATE, cycle: int = CYCLE) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights 1..cycle by code point of the name, nulls last."""
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(max_rate))
    shared = weighed.withColumn("level", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # A source is stopped if its share of what the sources before it leave reaches its cap; after the first that isn't, all share alike.
    open_rate = F.first(F.when(F.col("fair") < F.col("level"), F.col("fair")), ignorenulls=True).over(every)
    return (
        shared.withColumn("fair", left / weights)
        .withColumn("rate", F.coalesce(open_rate, F.lit(float("inf"))))
        .select("source", "source_size", F.least("cap", F.round(F.col("weight") * F.col("rate"), 6)).alias("target"))
    )


def draw(doc_id, seed: str = "mix"):
    """A number in [0, 1) from the document's id and the seed, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def with_copies(docs: DataFrame, max_rate: float = MAX_RATE, cycle: int = CYCLE, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and copies (0 to ceil(max_rate)); doc_id, text and source are read, others ride along."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    sizes = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sizes, max_rate, cycle).withColumnRenamed("source", "mix_source")
    if sizes.count() <= FEW_SOURCES:  # else both sides are shuffled
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, max_rate: float = MAX_RATE, cycle: int = CYCLE, seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: every document as often as it is taken, with the columns of docs."""
    kept = with_copies(docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), max_rate, cycle, seed)
    return kept.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS level FROM w),
f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS fair
      FROM l WINDOW p AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, round(weight * coalesce(first_value(CASE WHEN fair < level THEN fair END IGNORE NULLS) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'Infinity'::DOUBLE), 6)) AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
