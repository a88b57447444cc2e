"""Ids of k-letter windows over Arrow batches of texts, in numpy. No Spark here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandspark.functions.alphabet import Alphabet

#: Places that are looked at together; sums of as many 32-bit numbers are exact in doubles.
PLACES = 1 << 19


class Words:
    """Windows of known letters as numbers: the letters' places in the alphabet are the digits."""

    def __init__(self, k: int, alphabet: Alphabet) -> None:
        self.k, self.letters, self.count = k, len(alphabet.order), len(alphabet.order) ** k
        self.ascii = alphabet.order.isascii()
        self.codes = np.full(256 if self.ascii else 0x110000, -1, np.int64)
        self.codes[[ord(x) for x in alphabet.order]] = np.arange(self.letters)
        self.partner = alphabet.permutation()

    def turned(self) -> np.ndarray:
        """The id of each id's reverse complement."""
        left, out = np.arange(self.count), np.zeros(self.count, np.int64)
        for _ in range(self.k):
            out = out * self.letters + self.partner[left % self.letters]
            left //= self.letters
        return out

    def _points(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' letters in one array, and where each text starts and the last one ends. Bytes will do for ASCII, as others aren't letters."""
        texts = pc.fill_null(texts, "")
        if self.ascii:
            kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            _, starts, data = texts.buffers()
            starts = np.frombuffer(starts, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            points = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
            return points, starts - starts[0]
        read = [x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()]
        points = np.frombuffer("".join(read).encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(x) for x in read], dtype=np.int64)])

    def windows(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(id, number of the text) of every window, some places at a time, however long a text is."""
        if not len(texts):
            return
        points, starts = self._points(texts)
        for a in range(0, len(points) - self.k + 1, PLACES):
            b = min(a + PLACES, len(points) - self.k + 1)
            codes = self.codes[points[a : b + self.k - 1]]
            rows = np.repeat(np.arange(len(texts)), np.diff(np.clip(starts, a, b)))
            whole = starts[1:][rows] - np.arange(a, b) >= self.k
            unknown = codes < 0
            if unknown.any():
                seen = np.concatenate([[0], np.cumsum(unknown)])
                whole &= seen[self.k :] == seen[: -self.k]
            ids = codes[: b - a].copy()
            for i in range(1, self.k):
                ids *= self.letters
                ids += codes[i : i + b - a]
            yield ids[whole], rows[whole]
