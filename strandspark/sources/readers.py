"""Readers: sequence files, count tables, and tables with values, as DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandspark.functions.alphabet import Alphabet, normalise_u
from strandspark.operators import counttable


def numbered(df: DataFrame, name: str = "seq_id") -> DataFrame:
    """df with a column that orders its rows as in the files; not consecutive."""
    return df.withColumn(name, F.monotonically_increasing_id())


def normalised(df: DataFrame, alphabet: Alphabet, normalize_u: bool = True) -> DataFrame:
    return df.withColumn("seq", normalise_u(F.col("seq"), alphabet)) if normalize_u else df


def text_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): one sequence per line; .gz files are unpacked."""
    return numbered(spark.read.text(path).filter(F.col("value") != "")).select("seq_id", F.col("value").alias("seq"))


def table_sequences(spark: SparkSession, path: str, string_column: int = 0, width: int | None = None) -> DataFrame:
    """(seq_id, seq, vals): tab-separated, one column of sequences, all others numbers. Every row has as many columns as the
    first; a row that hasn't, or a value that isn't a number, fails."""
    lines = spark.read.text(path).filter(F.col("value") != "")
    if width is None:
        first = lines.head()
        width = len(first.value.split("\t")) if first else 2
    if width < 2 or not 0 <= string_column < width:
        raise ValueError(f"{path}: {width} columns, and the sequence in column {string_column}")
    parts = F.split("value", "\t", -1)
    checked = numbered(lines).select("seq_id", F.when(F.size(parts) == width, parts).otherwise(F.raise_error(F.concat(F.lit(f"{width} columns expected: "), F.col("value")))).alias("p"))
    values = F.array(*(F.col("p")[i].cast("double") for i in range(width) if i != string_column))
    return checked.select("seq_id", F.col("p")[string_column].alias("seq"), values.alias("vals"))


def value_columns(df: DataFrame, n: int) -> DataFrame:
    """vals as columns v0, v1, ..."""
    return df.select("*", *(F.col("vals")[i].alias(f"v{i}") for i in range(n))).drop("vals")


def fastq_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): the second line of every record of four."""
    # lines are numbered by their place in each task, plus the counts of earlier tasks: one row per task
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"))
    marked = lines.withColumn("part", F.shiftright("id", 33)).withColumn("nth", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = marked.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("nth").alias("low"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    index = F.col("before") + F.col("nth") - F.col("low")
    return marked.join(starts, ["file", "part"]).filter(index % 4 == 1).select(F.col("id").alias("seq_id"), F.col("value").alias("seq"))


def fasta_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): records that begin with '>', their lines joined."""
    records = numbered(spark.read.option("lineSep", ">").text(path).filter(F.col("value").contains("\n")))
    body = F.regexp_replace(F.expr("substring(value, locate('\n', value) + 1)"), r"\s", "")
    return records.select("seq_id", body.alias("seq")).filter("seq <> ''")


def count_table(spark: SparkSession, path: str) -> DataFrame:
    """(seq, c0, c1, ...) from tab-separated sequences and integers, quotes allowed; all rows of the first one's width."""
    lines = spark.read.text(path).filter(F.col("value") != "")
    first = lines.head()
    if first is None:
        raise ValueError(f"{path} is empty")
    width = len(first.value.split("\t"))
    parts = F.split(F.regexp_replace("value", '"', ""), "\t", -1)
    checked = lines.select(F.when(F.size(parts) == width, parts).otherwise(F.raise_error(F.concat(F.lit(f"{width} columns expected: "), F.col("value")))).alias("p"))
    return checked.select(F.col("p")[0].alias("seq"), *(F.col("p")[i + 1].cast("int").alias(f"c{i}") for i in range(width - 1)))


def fastq_counts(spark: SparkSession, path: str, left: str = "", right: str = "") -> DataFrame:
    """(seq, n): the letters between two flanks in a FASTQ file's sequence lines, counted."""
    found = fastq_sequences(spark, path).select(F.regexp_extract("seq", f"{left}([a-zA-Z]+){right}", 1).alias("seq"))
    return found.filter("seq <> ''").groupBy("seq").agg(F.count("*").alias("n"))


_END = (1 << 63) - 1


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            seqs, counts = [], []
            for code, size, n in struct.iter_unpack(">qii", content.as_buffer().to_pybytes()[: len(content.as_buffer()) // 16 * 16]):
                if code == _END:
                    break
                seqs.append("".join("ACGT"[(code >> 2 * (size - 1 - i)) & 3] for i in range(size)))
                counts.append(n)
                if len(seqs) == 65536:
                    yield pa.RecordBatch.from_arrays([pa.array(seqs), pa.array(counts, pa.int32())], names=["seq", "n"])
                    seqs, counts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array(counts, pa.int32())], names=["seq", "n"])


def dat_counts(spark: SparkSession, path: str) -> DataFrame:
    """(seq, n) from binary records of 16 bytes: two bits per letter (at most 32), length and count, big-endian."""
    packed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unpack, "seq string, n int")
    return packed.groupBy("seq").agg(F.sum("n").alias("n"))


def read_counts(spark: SparkSession, paths: str, kind: str = "tsv", columns: int | None = None, left: str = "", right: str = "") -> DataFrame:
    """A count table by file type: tsv, tsv.gz, fastq or dat; for the last two, one comma-separated path per round."""
    if kind in ("tsv", "tsv.gz"):
        out = count_table(spark, paths)
    elif kind in ("fastq", "dat"):
        one = (lambda p: fastq_counts(spark, p, left, right)) if kind == "fastq" else (lambda p: dat_counts(spark, p))
        out = counttable.join_rounds([one(p.strip()) for p in paths.split(",")])
    else:
        raise ValueError(f"unknown file type {kind!r}")
    found = len(counttable.round_columns(out))
    if columns is not None and found != columns:
        raise ValueError(f"{paths}: {found} columns of counts, {columns} expected")
    return out


def rounds_table(spark: SparkSession, paths: list[str], max_reads: int | None = None, seed: int = 0) -> DataFrame:
    """A count table of the different lines of one file per round."""
    reads = [numbered(spark.read.text(p).select(F.col("value").alias("seq")), "read_id") for p in paths]
    return counttable.build(reads, max_reads=max_reads, seed=seed)


COUNTS = T.StructType([T.StructField("seq", T.StringType()), T.StructField("n", T.LongType())])
