"""k-mer and positional tabulations.

Windows never become rows where all k-mers are written out: a vectorised Arrow kernel sums them per k-mer within each
task, adds the other strand to these sums, and only the sums are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandspark.functions.alphabet import DNA, Alphabet
from strandspark.functions.words import Words

#: Largest universe of k-mers that is written out with its zeros.
MAX_UNIVERSE = 1 << 21
#: Bins of a k-mer's histogram for its median, and cells of all histograms.
MEDIAN_BINS, MEDIAN_CELLS = 1 << 12, 1 << 18


def kmer_universe(spark: SparkSession, k: int, alphabet: Alphabet = DNA) -> DataFrame:
    """(kmer_id, kmer, revcomp): all k-mers in the alphabet's order."""
    n = len(alphabet.order)
    if n**k > MAX_UNIVERSE:
        raise ValueError(f"{n}^{k} k-mers are too many; use sparse=True")
    digit = lambda i: F.expr(f"substring('{alphabet.order}', cast(floor(id / {n ** (k - 1 - i)}) % {n} as int) + 1, 1)")
    out = spark.range(n**k).select(F.col("id").alias("kmer_id"), F.concat(*(digit(i) for i in range(k))).alias("kmer"))
    return out.withColumn("revcomp", alphabet.revcomp(F.col("kmer")))


def windows(df: DataFrame, k: int, alphabet: Alphabet = DNA, seq: str = "seq", keep: list[str] | None = None) -> DataFrame:
    """One row per k-letter window of known letters: kept columns and kmer."""
    keep = keep or []
    # a look-ahead finds overlapping windows in one pass, also over long sequences
    letters = "".join(rf"\x{{{ord(x):x}}}" for x in alphabet.order)
    return df.select(*keep, F.explode(F.regexp_extract_all(F.col(seq), F.lit(f"(?=([{letters}]{{{k}}}))"), F.lit(1))).alias("kmer"))


def kmer_list(seq: Column, k: int) -> Column:
    """All windows of a sequence as an array."""
    return F.when(F.length(seq) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substr(seq, i, F.lit(k))))


def _both_strands(sums: DataFrame, alphabet: Alphabet, forward_only: bool) -> DataFrame:
    """Adds every k-mer's sums to its reverse complement, too: a palindrome counts twice."""
    if forward_only:
        return sums
    rest = [c for c in sums.columns if c != "kmer"]
    turned = sums.select(alphabet.revcomp(F.col("kmer")).alias("kmer"), *rest)
    return sums.unionByName(turned).groupBy("kmer").agg(*(F.sum(c).alias(c) for c in rest))


def _sums(df: DataFrame, k: int, alphabet: Alphabet, seq: str, forward_only: bool, values: list[str]) -> DataFrame:
    """(kmer_id, __n, sums of the value columns) of the k-mers that occur; a sum of no value is 0."""
    given = df.select(F.col(seq).cast("string").alias("seq"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    kinds = [t for _, t in given.dtypes[1:]]
    if not set(kinds) <= {"tinyint", "smallint", "int", "bigint", "float", "double"}:
        # decimals and others are summed by Spark, window by window
        sums = windows(given, k, alphabet, "seq", given.columns[1:]).groupBy("kmer").agg(F.count("*").alias("__n"), *(F.sum(f"v{i}").alias(v) for i, v in enumerate(values)))
        sums = _both_strands(sums, alphabet, forward_only)
        return kmer_universe(df.sparkSession, k, alphabet).join(sums, "kmer").select("kmer_id", "__n", *values)
    real = [t in ("float", "double") for t in kinds]
    given = given.select("seq", *(F.col(f"v{i}").cast("double" if r else "bigint").alias(f"v{i}") for i, r in enumerate(real)))
    # an integer's upper and lower 32 bits are summed apart, as doubles hold only 53
    columns = [c for i, r in enumerate(real) for c in ([f"v{i}"] if r else [f"h{i}", f"l{i}"])]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(k, alphabet)
        n = np.zeros(words.count, np.int64)
        sums = {c: np.zeros(words.count, np.float64 if c[0] == "v" else np.int64) for c in columns}
        for batch in batches:
            weights = {}
            for i, r in enumerate(real):
                x = pc.fill_null(batch.column(i + 1), 0).to_numpy(zero_copy_only=False)
                weights |= {f"v{i}": x} if r else {f"h{i}": x >> 32, f"l{i}": x & 0xFFFFFFFF}
            for ids, rows in words.windows(batch.column(0)):
                n += np.bincount(ids, minlength=words.count)
                for c, x in weights.items():
                    if c[0] == "v" or x.any():
                        sums[c] += np.bincount(ids, x[rows], words.count).astype(sums[c].dtype)
        if not forward_only:  # a palindrome counts twice
            turned = words.turned()
            n, sums = n + n[turned], {c: x + x[turned] for c, x in sums.items()}
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found, n[found], *(sums[c][found] for c in columns))], ["kmer_id", "__n", *columns])

    each = given.mapInArrow(tally, ", ".join(["kmer_id bigint", "__n bigint", *(f"{c} {'double' if c[0] == 'v' else 'bigint'}" for c in columns)]))
    total = each.groupBy("kmer_id").agg(*(F.sum(c).alias(c) for c in ["__n", *columns]))
    whole = lambda i: (F.col(f"h{i}").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(f"l{i}")).cast("bigint")
    return total.select("kmer_id", "__n", *((F.col(f"v{i}") if r else whole(i)).alias(v) for i, (v, r) in enumerate(zip(values, real, strict=True))))


def kmer_count(df: DataFrame, k: int = 8, forward_only: bool = False, alphabet: Alphabet = DNA, seq: str = "seq", values: list[str] | None = None, sparse: bool = False) -> DataFrame:
    """How often each k-mer occurs (column n), or the sums of the value columns over its occurrences.
    Without sparse, all k-mers are rows, zeros included."""
    if sparse:
        found = windows(df, k, alphabet, seq, values).groupBy("kmer")
        sums = found.agg(*(F.sum(v).alias(v) for v in values)) if values else found.agg(F.count("*").alias("n"))
        return _both_strands(sums, alphabet, forward_only)
    every = kmer_universe(df.sparkSession, k, alphabet).select("kmer_id", "kmer")
    sums = _sums(df, k, alphabet, seq, forward_only, values or [])
    sums = sums.drop("__n") if values else sums.withColumnRenamed("__n", "n")
    return every.join(sums, "kmer_id", "left").select("kmer", *(F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in sums.dtypes if c != "kmer_id"))


def kmer_average(df: DataFrame, k: int = 8, forward_only: bool = False, pseudocount: float = 0.0, alphabet: Alphabet = DNA, seq: str = "seq", values: list[str] | None = None) -> DataFrame:
    """Mean of each value column over a k-mer's occurrences, drawn to the overall mean by the pseudocount; NaN without any."""
    values = values or []
    every = kmer_universe(df.sparkSession, k, alphabet).select("kmer_id", "kmer").join(_sums(df, k, alphabet, seq, forward_only, values), "kmer_id", "left")
    # the overall sums come from the same rows, so that the sequences are read once
    overall = Window.partitionBy()
    every = every.withColumns({"__total": F.sum("__n").over(overall)} | {f"__all_{v}": F.sum(v).over(overall) for v in values})
    n = F.coalesce("__n", F.lit(0)) + F.lit(float(pseudocount))
    mean = lambda v: F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.coalesce(v, F.lit(0.0)) + F.lit(float(pseudocount)) * F.try_divide(F.col(f"__all_{v}"), F.col("__total")), n))
    return every.select("kmer", *(F.coalesce(mean(v), F.lit(float("nan"))).alias(v) for v in values))


def kmer_median(df: DataFrame, k: int = 8, alphabet: Alphabet = DNA, seq: str = "seq", value: str = "value", forward_only: bool = False) -> DataFrame:
    """Exact median of a value over a k-mer's occurrences on both strands; null without any. Null values are left out.

    A histogram per k-mer finds the bins of the two middle values; only occurrences in those bins become rows. The
    histograms' counts, no more than MEDIAN_CELLS and twice the k-mers, come to the driver, so that they are made once."""
    spark = df.sparkSession
    every = kmer_universe(spark, k, alphabet).select("kmer_id", "kmer")
    given = df.filter(F.col(value).isNotNull()).select(F.col(seq).cast("string").alias("seq"), F.col(value).cast("double").alias("__v"))
    finite = F.when(F.abs("__v") < float("inf"), F.col("__v"))
    ends = given.agg(F.min(finite).alias("a"), F.max(finite).alias("b")).first()
    low, high = ends.a or 0.0, ends.b or 0.0
    bins = max(1, min(MEDIAN_BINS, MEDIAN_CELLS // len(alphabet.order) ** k))
    share = F.coalesce(F.try_divide(F.col("__v") / bins - low / bins, F.lit(high / bins - low / bins)), F.lit(0.0))
    binned = F.when(F.col("__v") >= high, bins).when(F.col("__v") <= low, 0).otherwise(F.floor(share * bins)).cast("int")  # NaN is largest
    given = given.withColumn("__bin", binned)
    stride = bins + 1

    def cells(words: Words, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(k-mer, number of the row, bin) of the windows."""
        at = batch.column("__bin").to_numpy().astype(np.int64)
        for ids, rows in words.windows(batch.column("seq")):
            yield ids, rows, at[rows]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(k, alphabet)
        n = np.zeros(words.count * stride, np.int64)
        for batch in batches:
            for ids, _, at in cells(words, batch):
                n += np.bincount(ids * stride + at, minlength=len(n))
        if not forward_only:
            n = (n.reshape(-1, stride) + n.reshape(-1, stride)[words.turned()]).ravel()
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["cell", "n"])

    histogram = given.select("seq", "__bin").mapInArrow(tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    words = Words(k, alphabet)
    n = np.zeros(words.count * stride, np.int64)
    n[histogram["cell"].to_numpy()] = histogram["n"].to_numpy()
    upto = n.reshape(-1, stride).cumsum(1)
    seen = np.flatnonzero(upto[:, -1])
    lower, upper = (upto[seen, -1] - 1) // 2, upto[seen, -1] // 2
    bin_of = lambda rank: (upto[seen] <= rank[:, None]).sum(1)
    first_bin, last_bin = bin_of(lower), bin_of(upper)
    before = np.where(first_bin > 0, upto[seen, first_bin - 1], 0)
    wanted = np.zeros(len(n), bool)
    wanted[seen * stride + first_bin] = wanted[seen * stride + last_bin] = True
    ranks = spark.createDataFrame(pa.table({"kmer_id": seen, "__from": before, "__lo": lower, "__hi": upper}))
    packed = np.packbits(wanted)

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(k, alphabet)
        wanted = np.unpackbits(packed, count=words.count * stride).astype(bool)
        turned = words.turned()
        either = wanted if forward_only else (wanted.reshape(-1, stride) | wanted.reshape(-1, stride)[turned]).ravel()
        for batch in batches:
            values = batch.column("__v").to_numpy()
            for ids, rows, at in cells(words, batch):
                some = np.flatnonzero(either[ids * stride + at])
                ids, x, at = ids[some], values[rows[some]], at[some]
                if not forward_only:
                    ids, x, at = np.concatenate([ids, turned[ids]]), np.tile(x, 2), np.tile(at, 2)
                    some = wanted[ids * stride + at]
                    ids, x = ids[some], x[some]
                order = np.lexsort((x, ids))
                ids, x = ids[order], x[order]
                new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1])])[: len(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in (ids[new], x[new], np.diff(new, append=len(ids)))], ["kmer_id", "__v", "n"])

    counted = given.mapInArrow(middle, "kmer_id bigint, __v double, n bigint").groupBy("kmer_id", "__v").agg(F.sum("n").alias("n")).join(ranks, "kmer_id")
    reached = counted.withColumn("__to", F.col("__from") + F.sum("n").over(Window.partitionBy("kmer_id").orderBy("__v")))
    first = lambda rank: F.min(F.when(F.col("__to") > F.col(rank), F.col("__v")))
    medians = reached.groupBy("kmer_id").agg(first("__lo").alias("__a"), first("__hi").alias("__b"))
    median = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") / 2 + F.col("__b") / 2)
    return every.join(medians, "kmer_id", "left").select("kmer", median.alias("median"))


def position_letter_count(df: DataFrame, alphabet: Alphabet = DNA, seq: str = "seq", weight: str | None = None) -> DataFrame:
    """(position, letter, n): occurrences, or the weight's sum, of every letter at every position of equal-length sequences."""
    same = df.agg(F.min(F.length(seq)).alias("a"), F.max(F.length(seq)).alias("b")).first()
    if same.a != same.b:
        raise ValueError(f"sequences have lengths from {same.a} to {same.b}")
    value = F.sum(weight) if weight else F.count("*")
    # the sums of equal sequences first, then one row per letter of each different one
    once = df.groupBy(F.col(seq).alias("__seq")).agg(value.alias("__v"))
    letters = once.select("__v", F.posexplode(F.split("__seq", "")).alias("position", "letter")).filter("letter <> ''")
    sums = letters.groupBy("position", "letter").agg(F.sum("__v").alias("n"))
    spark = df.sparkSession
    every = spark.range(same.a or 0).select(F.col("id").cast("int").alias("position"), F.explode(F.array(*map(F.lit, alphabet.encounter_order))).alias("letter"))
    kind = dict(sums.dtypes)["n"]
    return every.join(sums, ["position", "letter"], "left").select("position", "letter", F.coalesce("n", F.lit(0)).cast(kind).alias("n"))


def position_letter_table(df: DataFrame, alphabet: Alphabet = DNA, seq: str = "seq", weight: str | None = None) -> DataFrame:
    """The same as one row per position and one column per letter."""
    return position_letter_count(df, alphabet, seq, weight).groupBy("position").pivot("letter", list(alphabet.encounter_order)).agg(F.first("n"))
