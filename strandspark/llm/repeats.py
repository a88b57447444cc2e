"""Removal of byte strings that repeat: every byte covered by a 400-byte string that also starts elsewhere goes.

Sorting all suffixes by a difference cover moves many times the text (see the README); this query
finds the same bytes from windows. Each 400-byte window has an anchor: the 64-byte string in it with the smallest hash, the
leftmost of equals. Equal windows have equal anchors at equal places, so only windows whose anchor's string occurs again can
repeat. Those are sent, as the bytes around their anchor, to one task per anchor, which hashes them, sorts the
hashes and compares neighbours. Anchors with many occurrences are split by the windows' hashes over many tasks
instead, with no limit on their number. Windows are compared by 64-bit hashes of their whole content, within one anchor.

Copies of a whole document are one text; where it has 400 bytes or more, all of it repeats. Null text: empty.
Texts under 400 bytes: nothing goes. Very long texts: whole. Repeated rows: copies. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.common import blocks, mix, prefix_hash, read_table, span_hash, stored

LENGTH, GRAM = 400, 64
#: Occurrences of an anchor beyond which its windows are split over PARTS keys (twice as many for each doubling beyond WIDE).
SPLIT_OVER, PARTS, WIDE = 128, 16, 1 << 15
#: Windows that a task sorts together, unless one key has more.
AT_ONCE = 1 << 21
_PLACE = np.uint64((1 << 28) - 1)


def sliding_argmin(ranked: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = len(ranked)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = ranked
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, first window, last window, hash) of each anchor; places and windows count from the text's start."""
    none = np.zeros(0, np.int64)
    if len(body) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    prefix = prefix_hash(body)
    at = np.arange(len(body) - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    ranked = (mix(gram ^ np.uint64(0xA0761D6478BD642F)) & ~_PLACE) | at.astype(np.uint64)
    least = (sliding_argmin(ranked, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    valid = np.arange(len(least)) + LENGTH <= offsets[doc + 1]
    window = np.flatnonzero(valid)
    if not len(window):
        return none, none, none, none, none.astype(np.uint64)
    place, of = least[window], doc[window]
    fresh = np.append(True, (place[1:] != place[:-1]) | (of[1:] != of[:-1]))
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:] - 1, len(window) - 1)
    of, spot = of[begin], place[begin]
    return of, spot - offsets[of], window[begin] - offsets[of], window[last] - offsets[of], gram[spot]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, body, offsets in blocks(batches, "text"):
        of, place, low, high, gram = anchors(body, offsets)
        cuts = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]))
        found = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], fields=list(kind.value_type))
        texts = [bytes(body[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
        sums = [hashlib.sha256(t) for t in texts]
        ident = [np.array([int.from_bytes(s.digest()[k : k + 8], "little", signed=True) for s in sums], np.int64) for k in (0, 8)]
        lists = pa.ListArray.from_arrays(cuts, found)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), *map(pa.array, ident), pa.array([s.hexdigest() for s in sums]), lists], names=["row", "doc_id", "n_bytes", "x", "y", "sha", "anchors"])


_SENT = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("low", pa.int32()), ("hashed", pa.bool_()), ("payload", pa.binary())])


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text and each of its repeated anchors, the bytes of the anchor's windows, or its windows' hashes."""
    for batch in batches:
        out: list[tuple] = []
        for row, text, found in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            raw = text.encode()
            prefix = None
            for a in found:
                low, high, n = a["low"], a["high"], a["n"]
                if n <= SPLIT_OVER:
                    out.append((a["hash"], row, low, False, raw[low : high + LENGTH]))
                    continue
                if prefix is None:
                    prefix = prefix_hash(np.frombuffer(raw, np.uint8))
                start = np.arange(low, high + 1)
                h = span_hash(prefix, start, start + LENGTH)
                parts = PARTS << max(0, int(n // WIDE).bit_length())
                part = (h % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
                for i, j in zip(edges, np.append(edges[1:], len(order)), strict=True):
                    own = order[i:j]
                    key = int(mix(np.array([a["hash"]], np.int64).view(np.uint64) + np.uint64(part[own[0]] + 1)).view(np.int64)[0])
                    out.append((key, row, low, True, own.astype("<u2").tobytes() + h[own].tobytes()))
            if len(out) >= 4096:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SENT, strict=True)], schema=_SENT)


def _repeated(rows: list[tuple]) -> pa.RecordBatch | None:
    """Windows of these rows (row, low, hashed, payload) whose hash occurs twice or more, as runs [first, last, ...] per row."""
    plain = [i for i, r in enumerate(rows) if not r[2]]
    of, start, hashes = [], [], []
    if plain:
        body = np.frombuffer(b"".join([rows[i][3] for i in plain]), np.uint8)
        size = np.array([len(rows[i][3]) for i in plain])
        offsets = np.append(0, np.cumsum(size))
        count = size - LENGTH + 1
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(offsets[:-1], count) + within
        hashes.append(span_hash(prefix_hash(body), at, at + LENGTH))
        of.append(np.repeat(np.array(plain), count))
        start.append(within)
    for i, r in enumerate(rows):
        if r[2]:
            n = len(r[3]) // 10
            start.append(np.frombuffer(r[3], "<u2", n).astype(np.int64))
            hashes.append(np.frombuffer(r[3], np.uint64, n, 2 * n) if (2 * n) % 8 == 0 else np.frombuffer(r[3][2 * n :], np.uint64))
            of.append(np.full(n, i))
    of, start, hashes = np.concatenate(of), np.concatenate(start), np.concatenate(hashes)
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    of, start = of[twice], start[twice]
    if not len(of):
        return None
    order = np.lexsort((start, of))
    of, start = of[order], start[order]
    fresh = np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:] - 1, len(of) - 1)
    low = np.array([r[1] for r in rows], np.int64)
    owner = of[first]
    runs = np.stack([start[first] + low[owner], start[last] + low[owner]], 1).ravel()
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    lists = pa.ListArray.from_arrays(pa.array((2 * np.append(cut, len(owner))).astype(np.int32)), pa.array(runs.astype(np.int32)))
    ids = np.array([r[0] for r in rows], np.int64)[owner[cut]]
    return pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["row", "runs"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key: compares the windows of each key, several keys together."""
    held: list[tuple] = []
    windows, last = 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for key, *row in zip(*(part.column(c).to_pylist() for c in ("key", "row", "low", "hashed", "payload")), strict=True):
                if key != last and windows >= AT_ONCE:
                    if (out := _repeated(held)) is not None:
                        yield out
                    held, windows = [], 0
                last = key
                held.append(tuple(row))
                windows += len(row[3]) // 10 if row[2] else len(row[3]) - LENGTH + 1
    if held and (out := _repeated(held)) is not None:
        yield out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, text, runs in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            pairs = np.concatenate([np.array(r, np.int64).reshape(-1, 2) for r in runs])
            depth = np.zeros(len(raw) + 1, np.int64)
            np.add.at(depth, pairs[:, 0], 1)
            np.add.at(depth, pairs[:, 1] + LENGTH, -1)
            gone = np.cumsum(depth)[:-1] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((row, int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["row", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): how many bytes go, in how many runs, and the digest of what is kept."""
    # rows get their numbers once: a second scan may be split differently
    placed = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    every = stored(placed.mapInArrow(_find, "row long, doc_id long, n_bytes long, x long, y long, sha string, anchors array<struct<hash:long,low:int,high:int>>"), "anchors")
    texts = stored(every.groupBy("x", "y").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "texts")
    found = every.select("row", "anchors").join(texts.select("row"), "row").select("row", F.inline("anchors"))
    often = found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    again = found.join(often, "hash").groupBy("row").agg(F.collect_list(F.struct("hash", "low", "high", "n")).alias("found"))
    held = stored(placed.select("row", "text").join(again, "row"), "candidates")
    sent = held.mapInArrow(_send, "key long, row long, low int, hashed boolean, payload binary").repartition("key").sortWithinPartitions("key")
    runs = sent.mapInArrow(_compare, "row long, runs array<int>").groupBy("row").agg(F.collect_list("runs").alias("runs"))
    cut = stored(held.select("row", "text").join(runs, "row").mapInArrow(_cut, "row long, n_removed long, n_spans long, kept_sha256 string"), "cut")
    named = every.select("row", "doc_id", "n_bytes", "x", "y", "sha").join(texts.select("x", "y", F.col("row").alias("text_row"), "copies"), ["x", "y"])
    out = named.join(cut.withColumnRenamed("row", "text_row"), "text_row", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    pick = lambda if_all, c, other: F.when(whole, if_all).otherwise(F.coalesce(c, other))
    return out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read_table(spark, sf_dir, "documents"))
