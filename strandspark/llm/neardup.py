"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document is the sequence of its lower-cased words. Each of its five-word shingles carries the number of
its earlier occurrences. Each of TUPLES hash functions picks the two labelled shingles with the smallest hashes and
keeps their text order; one 64-bit hash of that ordered pair is a bucket, so documents meet where their shingles agree
in content and in order, as under few edits. Pairs in a bucket (see graph.bucket_links) are verified by their edit
similarity over words, 1 - distance / length of the longer one, of 0.8 or more. Bit maps of the words, and then the words that
they share, bound it from above; an alignment through shingles that occur once in either bounds it from below; what these leave
open is decided exactly by an alignment in a band that widens until it holds the distance.

Documents of equal words are one text, so copies make no pairs. Documents without words: one class of their own kind
(equal texts). Null text: as empty. Fewer than five words: one shingle. Very long texts: whole. Repeated rows and null doc_ids:
rows of their own. Empty table: no rows. Other columns pass through unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.common import blocks, broadcast_up_to, drop_stored, mix, prefix_hash, read_table, span_hash, stored, words
from strandspark.llm.graph import bucket_links

#: At a similarity of 0.8 by scattered changes a third of the shingles stay, and an ordered pair agrees in about 0.04: a bucket in common with 0.98.
SHINGLE, CHOSEN, TUPLES, SIMILARITY = 5, 2, 100, 0.8
#: Longs of a bit map of words.
MAP = 16
#: Ids that are broadcast at most (8 MB).
SENT = 1 << 20
#: Cells of alignment that are computed together.
CELLS = 1 << 22
#: Pairs a text from which on texts are dealt in blocks instead of once for each pair; texts and bytes of one side of a block, pairs of a task.
DENSE, SIDE, SIDE_BYTES, TASK_PAIRS = 16, 128, 1 << 23, 1 << 11


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text)."""
    low, start, end, first = words(body, offsets)
    return span_hash(prefix_hash(low), start, end), first


def labelled_shingles(h: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle with its occurrence number, first shingle of each text)."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    begin = np.append(0, np.cumsum(count))
    doc = np.repeat(np.arange(len(n)), count)
    at = first[:-1][doc] + np.arange(begin[-1]) - begin[:-1][doc]
    last = first[1:][doc]
    key = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = at + k < last
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(at + k, max(0, len(h) - 1))], np.uint64(k + 1)))
    return labelled(key, doc), begin


def labelled(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The keys with the number of their earlier occurrences in the text mixed in."""
    if not len(key):
        return key
    order = np.lexsort((key, doc))  # runs of equal (text, key) in a stable order
    k, d = key[order], doc[order]
    fresh = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
    place = np.arange(len(k))
    nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
    out = key.copy()
    if nth.any():
        out[order] = np.where(nth > 0, mix(k + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), k)
    return out


def word_maps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """texts x MAP: bit maps of each text's words, the second occurrence of a word as a word of its own."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bit = (mix(labelled(h, doc) + np.uint64(1)) >> np.uint64(32)).astype(np.int64) % (64 * MAP)
    flags = np.zeros((len(first) - 1, 64 * MAP), bool)
    flags[doc, bit] = True
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def may_hold(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether lengths and bit maps leave the similarity possible: each bit that only one text has costs an edit at least."""
    only = np.maximum(np.bitwise_count(a & ~b).sum(1, dtype=np.int64), np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
    return np.maximum(only, np.abs(na - nb)) <= (1 - similarity) * np.maximum(na, nb) + 1e-9


def order_minhash(key: np.ndarray, begin: np.ndarray, tuples: int = TUPLES, chosen: int = CHOSEN) -> np.ndarray:
    """texts x tuples: hashes of the ordered smallest shingles under each hash function; texts without shingles: 0."""
    n = np.diff(begin)
    has = np.flatnonzero(n > 0)
    out = np.zeros((len(n), tuples), np.uint64)
    if not len(has):
        return out
    starts = begin[:-1][has]
    # the low bits tell the place in the text, as many as the longest text needs; the high bits order the shingles
    low = np.uint64((1 << int(n.max()).bit_length()) - 1)
    place = (np.arange(len(key)) - np.repeat(starts, n[has])).astype(np.uint64)
    for t in range(tuples):
        odd = np.uint64((0xD6E8FEB86659FD93 * (2 * t + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        ranked = ((key ^ np.uint64((0xA0761D6478BD642F * (t + 1)) & 0xFFFFFFFFFFFFFFFF)) * odd & ~low) | place
        picked = []
        for c in range(chosen):
            least = np.minimum.reduceat(ranked, starts)
            picked.append(np.where(least == np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0), (least & low) + np.uint64(1)).astype(np.int64))
            if c + 1 < chosen:
                real = picked[-1] > 0
                ranked[starts[real] + picked[-1][real] - 1] = np.uint64(0xFFFFFFFFFFFFFFFF)
        spots = np.sort(np.stack(picked, 1), axis=1)
        total = np.full(len(has), t + 1, np.uint64)
        for c in range(chosen):
            real = spots[:, c] > 0
            total = np.where(real, mix(total * np.uint64(31) + key[starts + np.maximum(spots[:, c] - 1, 0)]), total)
        out[has, t] = total
    return out


def _within(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray, band: int) -> np.ndarray:
    """Edit distances of pairs, exact where at most `band`, else band + 1. Dynamic programming on the
    diagonals -band .. band of all pairs together."""
    pairs, width = len(a), 2 * band + 1
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    longest = int(max(n.max(initial=0), m.max(initial=0)))
    kind = np.int16 if longest + 4 * band < 1 << 13 else np.int32
    pad = np.zeros((pairs, max(1, int(n.max(initial=0)))), np.uint32)
    other = np.full((pairs, int(m.max(initial=0)) + 2 * band + 2 + pad.shape[1]), np.uint32(1))  # 1 stands for nothing
    # words as numbers of their own pair: exact, and half the size of their hashes
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        codes = np.unique(np.concatenate([x, y]), return_inverse=True)[1].astype(np.uint32) + np.uint32(2)
        pad[i, : len(x)] = codes[: len(x)]
        other[i, band + 1 : band + 1 + len(y)] = codes[len(x) :]
    far, shift = kind(1 << 14 if kind is np.int16 else 1 << 28), np.arange(width, dtype=kind)
    column = shift - band  # at row 0: j = column
    row = np.where((column >= 0) & (column[None, :] <= m[:, None]), column, far).astype(kind)
    result = np.full(pairs, band + 1, np.int64)
    end = m - n + band
    inside = (end >= 0) & (end < width)
    zero = inside & (n == 0)
    result[zero] = row[zero, end[zero]]
    for i in range(1, pad.shape[1] + 1):
        window = other[:, i : i + width]  # b[j - 1] for j = i + column
        new = row + (window != pad[:, i - 1 : i])
        np.minimum(new[:, :-1], row[:, 1:] + kind(1), out=new[:, :-1])
        j = i + column
        new[:, j < 0] = far
        new = np.minimum.accumulate(new - shift, axis=1) + shift
        new[:, j < 0] = far
        row = np.minimum(new, far).astype(kind, copy=False)
        done = inside & (n == i)
        if done.any():
            result[done] = row[done, end[done]]
    return np.minimum(result, band + 1)


def _grams(h: np.ndarray) -> np.ndarray:
    key = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(key)]
    return key


def most_edits(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the edit distance: the cost of an alignment through shingles that occur once in either text."""
    if len(a) == len(b) and (d := int((a != b).sum())) * 5 <= len(a):
        return d
    x, y = _grams(a), _grams(b)
    ux, ix, cx = np.unique(x, return_index=True, return_counts=True)
    uy, iy, cy = np.unique(y, return_index=True, return_counts=True)
    _, px, py = np.intersect1d(ux[cx == 1], uy[cy == 1], assume_unique=True, return_indices=True)
    i, j = ix[cx == 1][px], iy[cy == 1][py]
    order = np.argsort(i)
    i, j = i[order], j[order]
    rising = j > np.append(-1, np.maximum.accumulate(j)[:-1]) if len(j) else np.zeros(0, bool)
    # anchors: equal words at (i, j); what lies between two of them costs its differing words, or else all of the longer side
    i, j = np.append(i[rising], len(a)), np.append(j[rising], len(b))
    at_i, at_j = np.append(0, i[:-1]), np.append(0, j[:-1])
    n, m = i - at_i, j - at_j
    cost = np.maximum(n, m)
    same = n == m
    if same.any():
        spot = np.repeat(at_i[same] - np.cumsum(n[same]) + n[same], n[same]) + np.arange(n[same].sum())
        other = spot + np.repeat((at_j - at_i)[same], n[same])
        differ = np.append(0, np.cumsum(a[spot] != b[other]))
        ends = np.cumsum(n[same])
        cost[same] = differ[ends] - differ[ends - n[same]]
    return int(cost.sum())


def edit_similar(a: list[np.ndarray], b: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs of word sequences have a similarity of 1 - distance / longer length of at least `similarity`."""
    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    most = np.floor((1 - similarity) * longer + 1e-9).astype(np.int64)
    out = longer == 0
    open_ = []
    for i in np.flatnonzero(~out):
        x, cx = np.unique(a[i], return_counts=True)
        y, cy = np.unique(b[i], return_counts=True)
        _, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if longer[i] - np.minimum(cx[ix], cy[iy]).sum() <= most[i]:
            if most_edits(a[i], b[i]) <= most[i]:
                out[i] = True
                continue
            short = min(len(a[i]), len(b[i]))
            diff = np.flatnonzero(a[i][:short] != b[i][:short])
            p = int(diff[0]) if len(diff) else short
            u, v = a[i][p:], b[i][p:]
            short = min(len(u), len(v))
            diff = np.flatnonzero(u[::-1][:short] != v[::-1][:short])
            q = int(diff[0]) if len(diff) else short
            open_.append((i, u[: len(u) - q], v[: len(v) - q]))
    band = 8
    while open_:
        open_.sort(key=lambda x: len(x[1]))
        later, at = [], 0
        while at < len(open_):
            rows = len(open_[-1][1])
            take = 1
            while at + take < len(open_) and (take + 1) * (len(open_[at + take][1]) + 1) * (2 * band + 1) <= CELLS and take < 512:
                take += 1
            group = open_[at : at + take]
            at += take
            index = np.array([g[0] for g in group])
            reach = np.minimum(band, most[index])
            d = _within([g[1] for g in group], [g[2] for g in group], most[index], int(reach.max()))
            out[index] = d <= most[index]
            out[index[(d > reach) & (reach < most[index])]] = False
            later += [g for g, x, r in zip(group, d, reach, strict=True) if x > r and r < most[g[0]]]
        open_, band = later, band * 4
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, body, offsets in blocks(batches, "text"):
        h, first = word_hashes(body, offsets)
        key, begin = labelled_shingles(h, first)
        sketch = order_minhash(key, begin)
        both = np.zeros((2, batch.num_rows), np.uint64)
        place = (np.arange(len(h)) - np.repeat(first[:-1], np.diff(first)) + 1).astype(np.uint64)
        has = np.flatnonzero(np.diff(first) > 0)
        none = np.flatnonzero(np.diff(first) == 0)
        for k, factor in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
            if len(has):
                both[k, has] = np.add.reduceat(mix(h * np.uint64(2 * k + 1) + place * np.uint64(factor)), first[:-1][has])
            if len(none):  # no words: the bytes themselves
                raw = span_hash(prefix_hash(body), offsets[:-1][none], offsets[1:][none])
                both[k, none] = mix(raw + np.uint64(factor))
        maps = pa.array([x.tobytes() for x in word_maps(h, first)], pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, TUPLES * (batch.num_rows + 1), TUPLES, dtype=np.int32)), pa.array(sketch.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), pa.array(np.diff(first)), lists, maps], names=["row", "doc_id", "x", "y", "n_words", "buckets", "map"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sides = []
            for c in ("ta", "tb"):
                seen: list[np.ndarray] = []
                for _, body, offsets in blocks([part], c):
                    h, first = word_hashes(body, offsets)
                    seen += [h[first[i] : first[i + 1]] for i in range(len(first) - 1)]
                sides.append(seen)
            yield part.select(["a", "b"]).filter(pa.array(edit_similar(*sides)))


def _align_block(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """_align for the pairs of a block, whose texts are hashed once each."""
    of: dict[int, np.ndarray] = {}
    for part, body, offsets in blocks(iter(texts.combine_chunks().to_batches()), "text"):
        h, first = word_hashes(body, offsets)
        of |= {row: h[first[i] : first[i + 1]] for i, row in enumerate(part.column("row").to_pylist())}
    a, b = ([of[x] for x in pairs.column(c).to_pylist()] for c in ("a", "b"))
    keep = [edit_similar(a[at : at + 256], b[at : at + 256]) for at in range(0, len(a), 256)]
    return pairs.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))


def _dealt(may: DataFrame, known: DataFrame, sides: int) -> tuple[DataFrame, DataFrame]:
    """(texts (block, row, text), pairs (at, a, b), at a block): all pairs (a, b), and each text once for each block that has pairs of it, so at most 2 * sides times."""
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    pairs = may.select((side("a") * sides + side("b")).alias("block"), "a", "b")
    return pairs.select("block", F.explode(F.array("a", "b")).alias("row")).distinct().join(known, "row").select("block", "row", "text"), pairs.toDF("at", "a", "b")


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            maps = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, MAP) for c in ("ma", "mb")]
            yield batch.select(["a", "b"]).filter(pa.array(may_hold(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), *maps)))


def _longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            maps = np.frombuffer(b"".join(batch.column("map").to_pylist()), np.int64).reshape(-1, MAP)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_words"), *(pa.array(maps[:, k]) for k in range(MAP))], names=["id", "n", *(f"m{k}" for k in range(MAP))])


def _may_hold(x: str, y: str) -> Column:
    """may_hold in columns, x and y prefixes of n, m0 ..."""
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}m{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}m{k}")))) for k in range(1, MAP)), F.bit_count(F.col(f"{x}m0").bitwiseAND(F.bitwise_not(F.col(f"{y}m0")))))
    most = (1 - SIMILARITY) * F.greatest(f"{x}n", f"{y}n") + 1e-9
    return (only(x, y) <= most) & (only(y, x) <= most) & (F.abs(F.col(f"{x}n") - F.col(f"{y}n")) <= most)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs as a stored table: row, and its columns as c0, c1, ...; rows get their numbers once, as a second scan may be split differently."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns))), "rows")


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): row (its place in the table), doc_id, class_id (the smallest doc_id of
    its class), links (the links of its text to other texts that the search verified), size (of the class) and first (whether it is the one to keep)."""
    return _classes(_numbered(docs.select("doc_id", "text")).toDF("row", "doc_id", "text"))


def _classes(placed: DataFrame) -> DataFrame:
    """placed: (row, doc_id, text), a stored table."""
    every = stored(placed.mapInArrow(_sketch, "row long, doc_id long, x long, y long, n_words long, buckets array<long>, map binary"), "sketches")
    texts = every.groupBy("x", "y").agg(F.min("row").alias("row"))  # one row for each different text
    unique = stored(texts, "texts")
    members = every.filter("n_words > 0").select("row", "n_words", "buckets").join(unique.select("row"), "row").select(F.col("row").alias("id"), F.col("n_words").cast("int").alias("size"), F.explode(F.array_distinct("buckets")).alias("bucket"))

    def prepare(ids: DataFrame):
        sent = broadcast_up_to(ids.select(F.col("id").alias("row")), SENT)
        known = stored(placed.select("row", "text").join(sent, "row"), "known")
        maps = stored(every.select("row", "n_words", "map").join(sent, "row"), "maps")
        of = lambda side: maps.select(F.col("row").alias(side), F.col("n_words").alias(f"n{side}"), F.col("map").alias(f"m{side}"))
        text = lambda side: known.select(F.col("row").alias(side), F.col("text").alias(f"t{side}"))

        def verify(pairs: DataFrame) -> DataFrame:
            return exact(stored(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_prune, "a long, b long"), "candidates"))

        def exact(may: DataFrame) -> DataFrame:
            n, ends = may.count(), may.select(F.explode(F.array("a", "b")).alias("row")).distinct()
            if n and n >= DENSE * ends.count():
                # many pairs of few texts
                number, size = ends.join(known, "row").agg(F.count("*"), F.sum(F.octet_length("text"))).first()
                sides = max(1, -(-number // SIDE), -(-size // SIDE_BYTES))
                parts = max(1, min(sides * sides, n // TASK_PAIRS))  # few bytes, but much work: a number that isn't reduced by size
                texts, pairs = _dealt(may, known, sides)
                return texts.repartition(parts, "block").groupBy("block").cogroup(pairs.repartition(parts, "at").groupBy("at")).applyInArrow(_align_block, "a long, b long")
            return may.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_align, "a long, b long")

        verify.traits = stored(maps.select("row", "n_words", "map").mapInArrow(_longs, "id long, n long, " + ", ".join(f"m{k} long" for k in range(MAP))), "traits")
        verify.may_hold, verify.exact = _may_hold, exact
        return verify

    links, of = bucket_links(members, SIMILARITY, prepare)
    ends = links.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count("*").alias("links"))
    of = of.select(F.col("id").alias("row"), "component")
    named = unique.join(of, "row", "left").join(ends, "row", "left").select("x", "y", F.coalesce("component", "row").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = stored(every.select("row", "doc_id", "x", "y").join(named, ["x", "y"]).drop("x", "y"), "classes")
    drop_stored(every)
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"), F.count("*").alias("size"))
    return rows.join(best, "component").select("row", "doc_id", F.col("best.doc_id").alias("class_id"), "links", "size", (F.col("best.row") == F.col("row")).alias("first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each class of near duplicates: that of the smallest doc_id."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = _numbered(docs)
    placed = rows.select("row", F.col(own["doc_id"]).cast("long").alias("doc_id"), F.col(own["text"]).alias("text"))
    gone = stored(_classes(placed).filter(~F.col("first")).select("row"), "gone")
    return rows.join(broadcast_up_to(gone, 8 * SENT), "row", "left_anti").select(*(F.col(x).alias(c) for c, x in own.items()))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents")).drop("row")
