"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. A source's weight at time t lies on a line from its first to its last
weight; the integral over time is its share of the mix. Targets start at those shares of the budget, and
what exceeds `most` times a source's size is shared out again by weight. A source's texts follow each other
in the order of a hash of doc_id and are read over and over until the target is met. The word that comes
after c others of its source is needed when the integral of the weight reaches c / target of the whole, which
inverted gives a training position; documents are range-sorted by the position of their first word.

Running totals come from the sums of (source, bucket) groups of a bounded number of rows, so a source that
holds most rows is split over many tasks. The sources' sizes, one row per source, go to the driver.

Null text: size 0. Null source: a source of its own, the last. Empty or very long texts: by size. Repeated
rows: each takes part. A source without words: target 0. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandspark.llm.common import blocks, broadcast_up_to, read_table, stored

#: First and last weight of the first, second, third, fourth ... source; their means are 3, 1, 2.
SCHEDULES = ((4.0, 2.0), (0.5, 1.5), (2.0, 2.0))
BUDGET, MOST, GROUP_ROWS, MAX_BUCKETS = 1.5, 2, 256, 1 << 20
#: Rows of positions that are broadcast at most (32 MB).
SENT = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, body, offsets in blocks(batches, "text"):
        inside = ~_SPACE[body]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        begins[first] = inside[first]
        total = np.append(0, np.cumsum(begins))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "doc_id", "source")), pa.array(total[offsets[1:]] - total[offsets[:-1]])], names=["id", "doc_id", "source", "size"])


def targets(sizes: dict[str | None, int], schedules=SCHEDULES, budget: float = BUDGET, most: float = MOST) -> dict[str | None, tuple[float, float, float]]:
    """Each source's target, first weight and last weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    line = {s: schedules[i % len(schedules)] for i, s in enumerate(order)}
    weight = {s: (a + b) / 2 for s, (a, b) in line.items()}
    rest, free, out = budget * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] / total > most * sizes[s]]
        if not full or rest <= 0:
            out |= {s: max(0.0, rest * weight[s] / total) for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        rest -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return {s: (out[s], *line[s]) for s in order}


def _position(c: Column) -> Column:
    """The time at which the integral of the weight reaches c / target of the whole."""
    a, b = F.col("first_weight"), F.col("last_weight")
    share = c / F.col("target") * (a + b) / 2
    return F.abs(F.when(a == b, share / a).otherwise((F.sqrt(F.greatest(a * a + 2 * (b - a) * share, F.lit(0.0))) - a) / (b - a)))


def _placed(sized: DataFrame, schedules, budget: float, most: int) -> DataFrame:
    """sized (id, doc_id, source, size) with source_size, target, taken and positions: where each reading of the
    document starts in training time."""
    spark = sized.sparkSession
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    goal = targets({r.source: r["size"] for r in per_source}, schedules, budget, most)
    buckets = min(MAX_BUCKETS, max(1, math.ceil(sum(r.n for r in per_source) / GROUP_ROWS)))
    rows = [(r.source, r["size"], *goal[r.source]) for r in per_source]
    table = spark.createDataFrame(rows, "source string, source_size long, target double, first_weight double, last_weight double")
    keyed = sized.withColumn("order", F.xxhash64("doc_id", "size", F.when(F.col("doc_id").isNull(), F.col("id")))).withColumn("bucket", F.shiftrightunsigned("order", 40).cast("long") % buckets)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("start", F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    # the offsets have one row per group; null sources meet by the null-safe comparison
    placed = local.join(offsets, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("bucket"))).select("id", "doc_id", "source", "size", (F.col("before") + F.col("start")).alias("start"))
    small = F.broadcast(table) if len(rows) <= 10_000 else table
    known = placed.withColumnRenamed("source", "s").join(small, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    whole = F.round("target").cast("long")
    part = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), whole - (F.lit(k) * F.col("source_size") + F.col("start"))))
    reads = F.array(*(F.when(F.lit(k) * F.col("source_size") + F.col("start") < whole, _position(F.lit(k) * F.col("source_size") + F.col("start"))) for k in range(most)))
    return known.select("id", "doc_id", "source", "size", "source_size", "target", sum((part(k) for k in range(1, most)), part(0)).cast("long").alias("taken"), F.filter(reads, lambda x: x.isNotNull()).alias("positions"))


def _sized(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return stored(rows.mapInArrow(_sizes, "id long, doc_id long, source string, size long"), "sizes")


def mix_sources(docs: DataFrame, schedules=SCHEDULES, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """One row per row of docs (doc_id, source, text), range-sorted by position: what the mix takes of it."""
    out = _placed(_sized(docs), schedules, budget, most).drop("id")
    return out.orderBy(F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)), "doc_id")


def take_mix(docs: DataFrame, schedules=SCHEDULES, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """docs, all columns, once for each reading that the mix begins, range-sorted by training position."""
    # rows get their numbers once: a second scan may be split differently
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = stored(docs.select(F.monotonically_increasing_id().alias("id"), *(F.col(c).alias(x) for c, x in own.items())), "rows")
    sized = rows.select("id", *(F.col(own[c]).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("text", "string")))).mapInArrow(_sizes, "id long, doc_id long, source string, size long")
    placed = stored(_placed(stored(sized, "sizes"), schedules, budget, most).select("id", "positions").filter(F.size("positions") > 0), "positions")
    # texts move once, with a position; those that are read again are multiplied within the sort
    out = rows.join(broadcast_up_to(placed, SENT), "id").select(F.explode("positions").alias("position"), *own.values())
    return out.orderBy("position").select(*(F.col(x).alias(c) for c, x in own.items()))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
