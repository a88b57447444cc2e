"""Best-fit packing: pattern packing by non-negative least squares.

Every text becomes token ids and an end id; what is longer than a sequence is cut into pieces. Lengths of
pieces form a histogram of at most `capacity` rows, which alone goes to the driver. There, few-document
patterns over coarse length classes get repeat counts by non-negative least squares, rounded down;
the rest goes, longest first, where it leaves the least room. The plan maps (length, rank among that
length) to (sequence, offset): its size depends on the number of lengths, not on that of documents.

Null or empty text: one piece with the end id alone. Very long texts: as many pieces as needed. Repeated
rows: packed once each. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandspark.llm.common import read_table, stored

TOKENIZER, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1
#: Words whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 1_200_000
_caches: dict[str, dict[str, bytes]] = {}
_loaded: dict[str, tuple] = {}
#: White space for Python, but not for the tokenizer, or the other way round: such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85᠎​﻿]")
#: In text of these characters alone, this is how the tokenizer cuts words after lower-casing.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ \\n\\t\\r]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str) -> tuple:
    """The tokenizer, and which ids end a word."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        ends = np.zeros(made.get_vocab_size(with_added_tokens=True), bool)
        for word, i in made.get_vocab(with_added_tokens=False).items():
            ends[i] = word.endswith("</w>")
        _loaded[path] = made, ends
    return _loaded[path]


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers. Words are encoded once each and remembered;
    texts of other than plain characters go by the chunks between white space, which no word crosses."""
    known = _caches.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    tokenizer, ends = _tokenizer(path)
    whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    plain = lambda text: _PLAIN.fullmatch(text) and "<|" not in text
    split: list[list[str]] = []
    new: set[str] = set()
    for text in texts:
        if not text:
            split.append([])
        elif plain(text):
            found = _WORDS.findall(text.lower())
            split.append(found)
            new.update(found)
        elif _ODD.search(text):
            known[text] = whole(text)
            split.append([text])
        else:
            found = []
            for chunk in text.split():
                if plain(chunk):
                    cut = _WORDS.findall(chunk.lower())
                    new.update(cut)
                    found += cut
                else:
                    if chunk not in known:
                        known[chunk] = whole(chunk)
                    found.append(chunk)
            split.append(found)
    todo = [w for w in new if w not in known]
    for at in range(0, len(todo), 5000):
        part = todo[at : at + 5000]
        ids = np.array(tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
        last = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(last) != len(part):
            raise ValueError("the tokenizer's words are not as expected")
        raw, i = ids.tobytes(), 0
        for w, j in zip(part, last, strict=True):
            known[w] = raw[i:j]
            i = j
    return [b"".join([known[w] for w in ws]) for ws in split]


def _pieces(batches: Iterator[pa.RecordBatch], name: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    path, last, chunk = tokenizer_path(name), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
    seen: dict[int, int] = defaultdict(int)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist(), path), strict=True):
                ids += last
                for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[i : i + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc, k, i // 4, n, zlib.crc32(piece), chunk, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"])


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least |a x - b| (Lawson and Hanson's active sets)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if slope.max(initial=-np.inf) <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[slope.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if z[active].min() > 0:
                x = z
                break
            low = active & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = np.maximum(0, x + step * (z - x))
            active &= x > 1e-12 * max(1.0, x.max(initial=0))
            x[~active] = 0
            if not active.any():
                break
    return x


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = 32, parts: int = 3) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): pieces of this length with ranks from the first
    on go to consecutive sequences, at this offset."""
    left, plan, groups, made = dict(histogram), [], defaultdict(list), 0  # groups: free room -> (first sequence, number)
    used: dict[int, int] = defaultdict(int)
    rooms: list[int] = []

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups or not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    def place(length: int, first: int, n: int, offset: int) -> None:
        plan.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    unit = capacity // classes or 1
    of = lambda n: -(-n // unit)  # noqa: E731  a length's class: its length rounded up, in units
    top = capacity // unit
    long = range(max(2, top // (parts + 1)), top + 1)
    patterns = [p for k in range(1, parts + 1) for p in combinations_with_replacement(long, k) if top - 1 <= sum(p) <= top]
    by_class: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        by_class[of(n)].append(n)
    demand = np.array([sum(left[n] for n in by_class[c]) for c in long], float)
    if patterns and demand.any():
        a = np.zeros((len(long), len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                a[c - long[0], j] += 1
        repeats = np.floor(nnls(a, demand) + 1e-9).astype(int)
        for j in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[j])
            while todo > 0:  # every turn gives the pattern's next lengths to as many sequences as have them
                take: list[int] = []
                for c in patterns[j]:
                    n = next((n for n in by_class[c] if left[n] > take.count(n)), None)
                    if n is None:
                        break
                    take.append(n)
                if len(take) < len(patterns[j]):
                    break
                k = min(todo, *(left[n] // take.count(n) for n in take))
                offset = 0
                for n in take:
                    place(n, made, k, offset)
                    offset += n
                free(capacity - offset, made, k)
                made, todo = made + k, todo - k
    for n in sorted(left, reverse=True):
        while left[n] > 0:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, have = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
                k = min(have, left[n])
                free(room, first + k, have - k)
            else:
                room, first, k = capacity, made, -(-left[n] // (capacity // n))
                made += k
            place(n, first, k, capacity - room)
            free(room - n, first, k)
    return plan


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): its ids' place in the text and in a sequence."""
    cut = docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long")
    pieces = stored(cut, "pieces")
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = sorted(plan_packing(histogram, capacity))
    keys = np.array([(n << 44) + rank for n, rank, *_ in plan], np.int64)
    ranks, firsts, offsets = (np.array([p[k] for p in plan], np.int64) for k in (1, 3, 4))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("length", "chunk", "before"), ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, (b.column("length").to_numpy() << 44) + rank, side="right") - 1
            places = [pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *places], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
