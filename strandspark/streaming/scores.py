"""Streams of sequences: scoring is stateless, counts per event-time window have a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandspark.functions.alphabet import DNA, Alphabet
from strandspark.operators.kmers import windows
from strandspark.operators.scoring import affinity_sum, binding_mode_scores
from strandspark.plans.model import Model


def sequence_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """(seq): new files of one sequence per line in a folder."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).filter("value <> ''").select(F.col("value").alias("seq"))


def scored_stream(stream: DataFrame, model: Model, how: str | None = None) -> DataFrame:
    """The stream's rows with a model's affinities, or with its modes' scores reduced by `how`."""
    return affinity_sum(stream, model) if how is None else binding_mode_scores(stream, model, how)


def windowed_kmer_counts(stream: DataFrame, k: int, time: str, every: str = "5 minutes", late: str = "10 minutes", alphabet: Alphabet = DNA) -> DataFrame:
    """Counts of k-mers per event-time window; rows later than the watermark are left out."""
    cut = windows(stream.withWatermark(time, late), k, alphabet, keep=[time])
    return cut.groupBy(F.window(time, every).alias("window"), "kmer").agg(F.count("*").alias("n"))


def running_round_totals(stream: DataFrame, round_: str = "round") -> DataFrame:
    return stream.groupBy(round_).agg(F.count("*").alias("n"))


def to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what has arrived as Parquet, exactly once, and stops."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
