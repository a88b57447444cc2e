"""Alphabets: letter order, complements, and sequence columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complement_pairs(definition: str) -> dict[str, str]:
    """ "C-G,A-T" as a map in both directions."""
    out: dict[str, str] = {}
    for pair in definition.split(","):
        a, sign, b = pair.strip().partition("-")
        if not sign or len(a) != 1 or len(b) != 1:
            raise ValueError(f"bad complement {pair!r} in {definition!r}")
        for x, y in ((a, b), (b, a)):
            if out.setdefault(x, y) != y:
                raise ValueError(f"two complements of {x!r} in {definition!r}")
    return out


@dataclass(frozen=True)
class Alphabet:
    """Letters in coefficient order and each one's complement."""

    order: str = "ACGT"
    complement: str = "C-G,A-T"

    def __post_init__(self) -> None:
        if set(self.order) != set(complement_pairs(self.complement)) or len(set(self.order)) != len(self.order):
            raise ValueError(f"letters {self.order!r} and complements {self.complement!r} disagree")

    @classmethod
    def of(cls, complement: str, order: str | None = None) -> Alphabet:
        return cls(order or "".join(sorted(complement_pairs(complement))), complement)

    @classmethod
    def letters(cls, order: str, complement: str | None = None) -> Alphabet:
        """Explicit letters; without complements, each is its own."""
        return cls(order, complement or ",".join(f"{x}-{x}" for x in order))

    @property
    def partners(self) -> str:
        pairs = complement_pairs(self.complement)
        return "".join(pairs[x] for x in self.order)

    @property
    def encounter_order(self) -> str:
        """Letters in the order in which the definition names them."""
        return "".join(dict.fromkeys(x for pair in self.complement.split(",") for x in pair.strip().split("-")))

    def permutation(self) -> np.ndarray:
        return np.array([self.order.index(x) for x in self.partners])

    def encode(self, seqs: list[str]) -> np.ndarray:
        """Equal-length sequences as rows of letter indices; ValueError for another letter."""
        width = len(seqs[0]) if seqs else 0
        table = np.full(0x110000 if not all(map(str.isascii, [self.order, *seqs])) else 128, 255, np.uint8)
        table[[ord(x) for x in self.order]] = np.arange(len(self.order))
        points = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32).reshape(len(seqs), width)
        out = table[points]
        if (out == 255).any():
            raise ValueError(f"Invalid char {chr(points[out == 255][0])!r} for the alphabet {self.order!r}")
        return out

    def revcomp(self, seq: Column) -> Column:
        return F.reverse(F.translate(seq, self.order, self.partners))

    def is_valid(self, seq: Column) -> Column:
        """Whether all letters are known."""
        return F.translate(seq, self.order, "") == ""


DNA = Alphabet()


def normalise_u(seq: Column, alphabet: Alphabet) -> Column:
    """U to T where T is a letter and U isn't, T to U the other way round."""
    if "T" in alphabet.order and "U" not in alphabet.order:
        return F.translate(seq, "U", "T")
    if "U" in alphabet.order and "T" not in alphabet.order:
        return F.translate(seq, "T", "U")
    return seq


def distinct_letters(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.select(F.explode(F.array_distinct(F.split(seq, ""))).alias("letter")).filter("letter <> ''").distinct()


def guess_alphabet(df: DataFrame, seq: str = "seq", most: int = 4096) -> Alphabet:
    """The letters that occur, each its own complement; exactly A, C, G and T: DNA. At most `most` letters come to the driver."""
    found = sorted(r.letter for r in distinct_letters(df, seq).limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} different letters")
    return DNA if found == list("ACGT") else Alphabet.letters("".join(found))


def chained(seq: Column, changes: list[tuple[str, str]]) -> Column:
    """Regular expressions replaced one after another."""
    return reduce(lambda c, x: F.regexp_replace(c, x[0], x[1]), changes, seq)
