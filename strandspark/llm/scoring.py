"""LM scoring by cross-entropy difference: how much better a target model than a background model predicts a document.

Both are interpolated bigram models over one vocabulary of words and are matched: the same words, order and smoothing, and
background counts scaled to the target's number of words. The target is the documents labelled of high quality, the
background all documents; whole texts of all of them are counted. Every different word and bigram has counts of its own, under
64-bit hashes.

Bigrams are never joined with their words' counts. The occurrences of a bigram are sent, packed by column, to one part, which
counts them, takes the words' counts and returns one sum per text. The counts of frequent words (at least 1 of HEAVY, so
at most HEAVY of them, 24 MB) are broadcast. A bigram with a rare word is dealt by that word, so that the part sees
all its occurrences and counts it, too; only the few bigrams of two rare words are joined. A bigram that would fill
a part (there are at most total / PART) is counted beforehand, broadcast, and dealt by text. The sums of a part go back
to the blocks of texts that its bigrams came from, in some 5 bytes each. A text has at most one sum
in each part, so their number grows with the parts, until there is one for each of the text's different bigrams.

The score is the mean over a document's words of background loss less target loss, in nats; higher: nearer to the target.
Sums travel to the nearest 2^-33, at most one for each word, so scores are within 1e-10.
Null or empty text, or one without words: score 0. Very long texts: whole. Repeated rows: counted and scored each; texts
with the same 64-bit hash share a score. Null labels: no target. No target documents: all scores are 0. Empty table: no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.common import blocks, broadcast_up_to, mix, prefix_hash, read_table, span_hash, stored, words

BLEND, ADD = 0.6, 0.5
#: Words that make up at least this part of all are broadcast.
HEAVY = 1 << 20
#: Words that a task counts together, and those whose bigrams it packs together.
HELD, PACKED = 1 << 21, 1 << 19
#: Words whose bigrams meet in one part.
PART = 1 << 21
#: Sums travel to the nearest 2^-FINE.
FINE = 33
#: Target documents up to which their ids are broadcast; more are joined by a shuffle.
TARGETS = 1 << 20
_START = np.uint64(1)  # stands before the first word of a text
_FIRST, _RARE = np.uint64(1 << 62), np.uint64(1 << 63)  # code of _START; mark of a rare word's code


class Models(NamedTuple):
    """The two models of docs (key, text, target): the counts of frequent words and of bigrams that would fill a part, and a table of all words."""

    docs: DataFrame
    words: DataFrame
    total: tuple[int, int, int]  # words, of those in the target, different words
    frequent: tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted hashes, counts in all and in the target
    full: tuple[np.ndarray, np.ndarray, np.ndarray]  # the same of bigrams, by their codes' hash
    parts: int


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of the one before it, first word of each text)."""
    low, start, end, first = words(body, offsets)
    h = span_hash(prefix_hash(low), start, end)
    before = np.append(np.uint64(0), h[:-1]) if len(h) else h
    before[first[:-1][np.diff(first) > 0]] = _START
    return h, before, first


def codes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of each word with the one before it, first word of each text)."""
    word, before, first = _words(body, offsets)
    return word, _pairs(before, word), first


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each x in the sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def _coded(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A frequent word's place in the table, a rare word's marked hash."""
    at, found = _find(table, hashes)
    return np.where(found, at.astype(np.uint64), np.where(hashes == _START, _FIRST, hashes | _RARE))


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for i in range(0, n, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in columns.values()], names=list(columns))


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("target").to_numpy(zero_copy_only=False).astype(bool)


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash of each word, of the one before it, its text's place, keys, targets) of about that many words or one longer text."""
    held, n, texts = [], 0, 0

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for batch, body, offsets in blocks(batches, "text"):
        word, before, first = _words(body, offsets)
        held.append((word, before, np.repeat(np.arange(texts, texts + batch.num_rows), np.diff(first)), batch.column("key").to_numpy().view(np.uint64), _flags(batch)))
        n, texts = n + len(word), texts + batch.num_rows
        if n >= size:
            yield joined()
            held, n, texts = [], 0, 0
    if held:
        yield joined()


def _summed(names: tuple[str, str, str], choose):
    """Counts in all and in the target of the numbers that choose takes from the words, summed by task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, before, text, _, target in _held(batches, HELD):
            x, which = choose(word, before)
            found, of = np.unique(x, return_inverse=True)
            hit = target[text[which]]
            yield from _batches(dict(zip(names, (found.view(np.int64), np.bincount(of, minlength=len(found)), np.bincount(of[hit], minlength=len(found))), strict=True)))

    return apply


def _gain(n, t, wn, wt, bn, bt, total: tuple[int, int, int]) -> np.ndarray:
    """Background loss less target loss of bigrams by their counts, those of the word and those of the word before."""
    log = []
    for pair, single, seen, scale in ((n, wn, bn, total[1] / total[0]), (t, wt, bt, 1.0)):
        alone = (single * scale + ADD) / (total[1] + ADD * total[2])
        # a word whose context was never seen, or that begins a text, is predicted by its own frequency
        before = seen * scale
        follow = pair * scale / np.maximum(before, 1e-9)
        blend = np.where(before > 0, BLEND * before / (before + 1.0), 0.0)
        log.append(np.log(np.where(before > 0, blend * follow, 0.0) + (1 - blend) * alone))
    return log[1] - log[0]


def _sorted_counts(df: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = df.select(name, "n", "t").toArrow()
    x, n, t = (table.column(c).to_numpy() for c in (name, "n", "t"))
    order = np.argsort(x.view(np.uint64))
    return x.view(np.uint64)[order], n[order], t[order]


def train(docs: DataFrame, targets: DataFrame) -> Models | None:
    """The models of docs (doc_id, text), with the doc_ids of targets as target."""
    spark = docs.sparkSession
    chosen = broadcast_up_to(stored(targets.select("doc_id", F.lit(True).alias("target")).distinct(), "targets"), TARGETS)
    marked = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(chosen, "doc_id", "left").select("key", "text", F.coalesce("target", F.lit(False)).alias("target"))
    sums = [F.sum("n").alias("n"), F.sum("t").alias("t")]
    every = lambda word, before: (word, slice(None))
    single = stored(marked.mapInArrow(_summed(("word", "n", "t"), every), "word long, n long, t long").groupBy("word").agg(*sums), "words")
    total = single.agg(*sums, F.count("*").alias("size")).first()
    if not total.t:
        return None
    frequent = _sorted_counts(single.filter(F.col("n") * HEAVY >= total.n), "word")  # at most HEAVY rows
    wide = np.flatnonzero(frequent[1] >= PART).astype(np.uint64)
    none = np.zeros(0, np.int64)
    full = none.view(np.uint64), none, none
    if len(wide):
        held = spark.sparkContext.broadcast((frequent[0], wide))

        def both_wide(word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            table, most = held.value
            a, b = _coded(before, table), _coded(word, table)
            which = np.flatnonzero(np.isin(a, most) & np.isin(b, most))
            return _pairs(a[which], b[which]), which

        counted = marked.mapInArrow(_summed(("pair", "n", "t"), both_wide), "pair long, n long, t long").groupBy("pair").agg(*sums)
        full = _sorted_counts(counted.filter(F.col("n") >= PART), "pair")  # at most total / PART rows
    return Models(marked, single, (total.n, total.t, total["size"]), frequent, full, total.n // PART + 1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns compressed byte by byte of their numbers; the first is sorted, and its differences are stored."""
    columns = (np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:])
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in columns)
    return struct.pack("<q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _fixed(x: np.ndarray) -> bytes:
    """Sums to the nearest 2^-FINE, byte by byte of their numbers; huge ones as they are."""
    if np.abs(x).max() >= 1 << (62 - FINE):
        return b"d" + x.tobytes()
    whole = np.rint(x * (1 << FINE)).astype(np.int64)
    planes = ((whole << 1) ^ (whole >> 63)).view(np.uint8).reshape(len(x), 8).T
    return b"f" + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unfixed(blob: bytes, n: int) -> np.ndarray:
    if blob[:1] == b"d":
        return np.frombuffer(blob, "<f8", n, 1)
    planes = np.frombuffer(pa.decompress(blob[1:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    zig = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return ((zig >> np.uint64(1)).astype(np.int64) ^ -(zig & np.uint64(1)).astype(np.int64)) / (1 << FINE)


def _unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = pa.decompress(blob[8:], struct.unpack("<q", blob[:8])[0], "zstd", asbytes=True), 0, []
    for kind in kinds:
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).ravel())
        at += n * wide
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _deal(held, parts: int):
    """Occurrences of bigrams, packed by the part they go to: the codes of both words, the text's place, how often in this text.
    Each block of texts also sends a head, of part -1: the keys and numbers of words of its texts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, full = held.value
        task = TaskContext.get().partitionId()
        for number, (word, before, text, keys, target) in enumerate(_held(batches, PACKED)):
            # a block is told apart by its texts too: parts of two runs of a task whose rows came in another order never meet
            name = np.array([len(keys), task, number], np.uint64)
            block = int(mix(np.frombuffer(hashlib.blake2b(keys.tobytes() + name.tobytes(), digest_size=8).digest(), np.uint64)).view(np.int64)[0])
            a, b = _coded(before, table), _coded(word, table)
            way = np.where(b >= _RARE, b, np.where(a >= _RARE, a, _pairs(a, b)))
            if len(full):
                own = _find(full, _pairs(a, b))[1]
                way[own] = keys[text[own]]
            part = (mix(way ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((b, a, part))  # stable: a bigram's texts stay in order
            a, b, text, part = a[order], b[order], text[order], part[order]
            fresh = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (text[1:] != text[:-1]))) if len(a) else np.zeros(0, np.int64)
            times = np.diff(np.append(fresh, len(a))).astype(np.uint32)
            n_words = np.bincount(text, minlength=len(keys)).astype(np.uint32)
            a, b, text, part = a[fresh], b[fresh], text[fresh], part[fresh]
            edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
            rows = [(-1, block, 0, _pack(n_words), len(keys), keys.tobytes(), b"")]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                used, of = np.unique(text[i:j], return_inverse=True)
                rows.append((int(part[i]), block, int(j - i), _pack(a[i:j], b[i:j], of.astype(np.uint32), times[i:j]), len(used), _pack(used.astype(np.uint32)), target[used].tobytes()))
            yield from _rows(rows, _DEALT)

    return apply


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 256], strict=True), schema, strict=True)], schema=schema)


_DEALT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("entries", pa.binary()), ("n_texts", pa.int32()), ("texts", pa.binary()), ("targets", pa.binary())])
_SENT = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("texts", pa.binary()), ("sums", pa.binary())])


def _part_sums(rows: list[dict], frequent: tuple, full: tuple, total: tuple[int, int, int]) -> Iterator[np.ndarray]:
    """For each row the gains of its texts' bigrams in this part."""
    cut = [_unpack(r["entries"], r["n"], "<u8", "<u8", "<u4", "<u4") for r in rows]
    base = np.cumsum([0, *(r["n_texts"] for r in rows)])
    target = np.concatenate([np.frombuffer(r["targets"], bool) for r in rows])
    before, word = (np.concatenate([c[i] for c in cut]) for i in (0, 1))
    text = np.concatenate([c[2] + np.int64(at) for c, at in zip(cut, base, strict=False)])
    times = np.concatenate([c[3] for c in cut]).astype(np.int64)
    del cut
    pair = _pairs(before, word)
    order = np.argsort(pair, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(pair[order]) != 0))
    n, t = np.add.reduceat(times[order], begin), np.add.reduceat((times * target[text])[order], begin)
    size = np.diff(np.append(begin, len(order)))
    which = order[begin]
    a, b, p = before[which], word[which], pair[which]
    del before, word, which, pair
    at, found = _find(full[0], p)
    if found.any():
        n[found], t[found] = full[1][at[found]], full[2][at[found]]
    # a rare word of this part: all its occurrences are here
    rare = np.flatnonzero(b >= _RARE)
    names, of = np.unique(b[rare], return_inverse=True)
    own = tuple(np.bincount(of, x[rare], minlength=len(names)) for x in (n, t))

    def counts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = _find(names, code)
        common = code < _FIRST
        out = []
        for known, mine in zip(frequent[1:], own, strict=True):
            x = np.zeros(len(code))
            x[common] = known[code[common].astype(np.int64)]
            x[there] = mine[at[there]]
            out.append(x)
        return out[0], out[1]

    gain = _gain(n, t, *counts(b), *counts(a), total)
    gain[(a >= _RARE) & (b >= _RARE)] = 0.0  # these are joined
    spread = np.empty(len(order))
    spread[order] = np.repeat(gain, size)
    sums = np.bincount(text, spread * times, base[-1])
    return (sums[i:j] for i, j in zip(base[:-1], base[1:], strict=True))


def _sum_parts(held, total: tuple[int, int, int]):
    """The sums of each part on their way back to the blocks of texts; heads pass."""

    def sent(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        out = [(r["block"], r["part"], r["n_texts"], r["texts"], _fixed(gain)) for r, gain in zip(rows, _part_sums(rows, *held.value, total), strict=True)]
        yield from _rows(out, _SENT)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            heads = []
            for row in batch.to_pylist():
                if row["part"] < 0:
                    heads.append((row["block"], -1, row["n_texts"], row["texts"], row["entries"]))
                    continue
                if rows and rows[0]["part"] != row["part"]:
                    yield from sent(rows)
                    rows = []
                rows.append(row)
            yield from _rows(heads, _SENT)
        if rows:
            yield from sent(rows)

    return apply


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all parts by text, block by block; the head of a block comes first."""
    block, keys, n_words, gain = None, None, None, None

    def done() -> Iterator[pa.RecordBatch]:
        found, first = np.unique(keys, return_index=True)  # copies of a text have equal sums
        yield from _batches({"key": found.view(np.int64), "part": gain[first], "n_words": n_words[first].astype(np.int64)})

    for batch in batches:
        for row in zip(*(batch.column(name) for name in ("block", "part", "n", "texts", "sums")), strict=True):
            own, part, n, texts, sums = (x.as_py() for x in row)
            if part < 0:
                if block is not None:
                    yield from done()
                block, keys, (n_words,), gain = own, np.frombuffer(texts, "<u8"), _unpack(sums, n, "<u4"), np.zeros(n)
            elif own != block:
                raise RuntimeError("sums of a block of texts whose head is missing: its rows came in another order when a lost task ran again")
            else:
                gain[_unpack(texts, n, "<u4")[0]] += _unfixed(sums, n)
    if block is not None:
        yield from done()


def _both_rare(held):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value[0]
        for word, before, text, keys, target in _held(batches, PACKED):
            which = np.flatnonzero(~_find(table, word)[1] & ~_find(table, before)[1] & (before != _START))
            word, before, text = word[which], before[which], text[which]
            order = np.lexsort((word, before, text))
            word, before, text = word[order], before[order], text[order]
            fresh = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (before[1:] != before[:-1]) | (text[1:] != text[:-1]))) if len(word) else np.zeros(0, np.int64)
            times = np.diff(np.append(fresh, len(word)))
            yield from _batches({"before": before[fresh].view(np.int64), "word": word[fresh].view(np.int64), "key": keys[text[fresh]].view(np.int64), "times": times, "t": times * target[text[fresh]]})

    return apply


def _joined_gains(total: tuple[int, int, int]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "t", "wn", "wt", "bn", "bt")]
            yield pa.RecordBatch.from_arrays([batch.column("before"), batch.column("word"), pa.array(_gain(*x, total))], names=["before", "word", "gain"])

    return apply


def _rare_sums(models: Models, held) -> DataFrame:
    """By text: the gains of its bigrams of two rare words."""
    late = stored(models.docs.mapInArrow(_both_rare(held), "before long, word long, key long, times long, t long"), "rare")
    own = models.words.select("word", F.col("n").alias("wn"), F.col("t").alias("wt"))
    context = models.words.select(F.col("word").alias("before"), F.col("n").alias("bn"), F.col("t").alias("bt"))
    pairs = late.groupBy("before", "word").agg(F.sum("times").alias("n"), F.sum("t").alias("t")).join(own, "word").join(context, "before")
    gains = pairs.mapInArrow(_joined_gains(models.total), "before long, word long, gain double")
    once = late.groupBy("before", "word", "key").agg(F.min("times").alias("times"))
    return once.join(gains, ["before", "word"]).groupBy("key").agg(F.sum(F.col("times") * F.col("gain")).alias("part")).select("key", "part", F.lit(0).cast("long").alias("n_words"))


def score(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, n_words and the score of each row of docs (doc_id, text), which are among those that the models have counted."""
    if models is None:
        return docs.select("doc_id", "text").mapInArrow(_lengths, "doc_id long, n_words long").withColumn("score", F.lit(0.0))
    send = docs.sparkSession.sparkContext.broadcast
    ddl = "part int, block long, n int, entries binary, n_texts int, texts binary, targets binary"
    dealt = models.docs.mapInArrow(_deal(send((models.frequent[0], models.full[0])), models.parts), ddl)
    # heads are spread by their blocks
    dealt = dealt.repartition(models.parts, F.when(F.col("part") >= 0, F.col("part").cast("long")).otherwise(F.col("block"))).sortWithinPartitions("part")
    sums = dealt.mapInArrow(_sum_parts(send((models.frequent, models.full)), models.total), "block long, part int, n int, texts binary, sums binary")
    sums = sums.repartition(models.parts // 4 + 1, "block").sortWithinPartitions("block", "part").mapInArrow(_unite, "key long, part double, n_words long")
    late = _rare_sums(models, send((models.frequent[0],)))
    one = lambda c: F.when(F.col("n_words") > 0, F.col(c))
    rare = F.coalesce(F.sum(F.when(F.col("n_words") == 0, F.col("part"))), F.lit(0.0))
    sums = sums.filter("n_words > 0").unionByName(late).groupBy("key").agg((F.min(one("part")) + rare).alias("part"), F.max("n_words").alias("n_words"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False)).alias("some"))
    known = F.when(F.col("some") & F.col("n_words").isNull(), F.raise_error(F.lit("a document that the models have not counted")).cast("long")).otherwise(F.coalesce("n_words", F.lit(0)))
    out = rows.join(sums, "key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), known.alias("n_words"), "part")
    return out.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("part") / F.col("n_words")).otherwise(0.0).alias("score"))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, body, offsets in blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(words(body, offsets)[3]))], names=["doc_id", "n_words"])


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    good = read_table(spark, sf_dir, "labels").filter("quality = 1")
    return score(docs, train(docs, good))
