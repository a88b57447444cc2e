"""Count tables: probes by rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.functions.alphabet import chained


def round_columns(df: DataFrame) -> list[str]:
    found = [c for c in df.columns if c[:1] == "c" and c[1:].isdigit()]
    return sorted(found, key=lambda c: int(c[1:]))


def build(reads: list[DataFrame], seq: str = "seq", max_reads: int | None = None, seed: int = 0) -> DataFrame:
    """One row per different sequence of any round, one column of counts per round (c0, c1, ...).
    max_reads: only so many reads of each round, drawn uniformly and reproducibly."""
    parts = [(sample_reads(r, max_reads, seed, seq) if max_reads is not None else r).select(F.col(seq).alias("seq"), F.lit(i).alias("round")) for i, r in enumerate(reads)]
    return pivot_rounds(reduce(DataFrame.unionByName, parts), list(range(len(reads))))


def pivot_rounds(reads: DataFrame, rounds: list, seq: str = "seq", round_: str = "round", weight: Column | None = None) -> DataFrame:
    """Reads (seq, round) as a count table. Conditional sums in one aggregation: partial before the one shuffle."""
    one = F.lit(1) if weight is None else weight
    counts = (F.sum(F.when(F.col(round_) == r, one).otherwise(0)).cast("bigint").alias(f"c{i}") for i, r in enumerate(rounds))
    return reads.groupBy(F.col(seq).alias("seq")).agg(*counts)


def join_rounds(tables: list[DataFrame], seq: str = "seq", count: str = "n") -> DataFrame:
    """Counts of single rounds (seq, n) side by side; a sequence that a round lacks has 0 there."""
    parts = [t.select(F.col(seq).alias("seq"), F.lit(i).alias("round"), F.col(count).alias("n")) for i, t in enumerate(tables)]
    return pivot_rounds(reduce(DataFrame.unionByName, parts), list(range(len(tables))), weight=F.col("n"))


def sample_reads(df: DataFrame, n: int, seed: int = 0, seq: str = "seq") -> DataFrame:
    """n rows, the same for any partitioning of rows that are told apart by read_id, or else by their content."""
    ident = "read_id" if "read_id" in df.columns else seq
    order = F.xxhash64(F.lit(seed), F.col(ident).cast("string"))
    return df.orderBy(order, ident).limit(max(0, n))


def batch_of_reads(table: DataFrame, n: int, seed: int = 0, rounds: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """A mini-batch: n reads drawn without replacement from a count table, as a count table."""
    rounds = rounds or round_columns(table)
    reads = table.select(seq, F.explode(F.array(*(F.struct(F.lit(i).alias("round"), F.col(c).cast("int").alias("n")) for i, c in enumerate(rounds)))).alias("x"))
    each = reads.select(seq, "x.round", F.explode(F.when(F.col("x.n") > 0, F.sequence(F.lit(1), F.col("x.n")))).alias("copy"))
    drawn = each.withColumn("read_id", F.concat_ws("-", F.col(seq), "round", "copy"))
    return pivot_rounds(sample_reads(drawn, n, seed, seq), list(range(len(rounds))), seq)


def modeled_columns(table: DataFrame, columns: list[int], seq: str = "seq") -> DataFrame:
    """Only the listed rounds, renumbered; [-1]: all."""
    have = round_columns(table)
    if columns == [-1]:
        return table
    return table.select(seq, *(F.col(have[c]).alias(f"c{i}") for i, c in enumerate(columns)))


def transliterate(table: DataFrame, changes: dict[str, list[str]], seq: str = "seq", keep: str = "original") -> DataFrame:
    """Regular expressions replaced one after another in the sequence; the original stays in a column of its own."""
    return table.withColumn(keep, F.col(seq)).withColumn(seq, chained(F.col(seq), list(zip(changes["in"], changes["out"], strict=True))))


def totals(table: DataFrame) -> DataFrame:
    """Counts per round."""
    return table.agg(*(F.sum(c).cast("bigint").alias(c) for c in round_columns(table)))


def require_uniform(df: DataFrame, seq: str = "seq") -> DataFrame:
    """df; fails while running where sequences have different lengths."""
    size = df.agg(F.min(F.length(seq)).alias("__least"), F.max(F.length(seq)).alias("__most"))
    checked = F.assert_true(F.col("__least") == F.col("__most"), "sequences of different lengths")
    return df.crossJoin(F.broadcast(size)).filter(checked.isNull()).drop("__least", "__most")  # one row
