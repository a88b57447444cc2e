"""Window scores of models over encoded sequences, in numpy. No Spark here."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Motif:
    """Effective coefficients of one binding mode in one experiment."""

    mono: np.ndarray  # size x letters
    di: tuple[np.ndarray, ...] = ()  # at distance d: (size - d) x letters x letters
    single_strand: bool = False
    flank: int = 0
    position_bias: np.ndarray | None = None  # strands x frames, logarithms
    included: bool = True

    @property
    def size(self) -> int:
        return len(self.mono)


def energies(codes: np.ndarray, motif: Motif) -> np.ndarray:
    """Sums of coefficients: sequences x windows."""
    frames = codes.shape[1] - motif.size + 1
    if frames <= 0 or motif.size == 0:
        return np.zeros((len(codes), max(0, frames) if motif.size else 0))
    total = np.zeros((len(codes), frames))
    for x in range(motif.size):
        total += motif.mono[x][codes[:, x : x + frames]]
    for d, table in enumerate(motif.di, 1):
        if table.any():
            for x in range(motif.size - d):
                total += table[x][codes[:, x : x + frames], codes[:, x + d : x + d + frames]]
    return total


def both_strands(codes: np.ndarray, motif: Motif, permutation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the energies on the sequences and on their reverse complements (offsets of the latter)."""
    forward = np.exp(energies(codes, motif))
    if motif.single_strand:
        return forward, np.zeros_like(forward)
    return forward, np.exp(energies(permutation[codes[:, ::-1]], motif))


def reduce_windows(forward: np.ndarray, reverse: np.ndarray, how: str, single_strand: bool) -> np.ndarray:
    """sum, max or mean over windows and strands."""
    if not forward.shape[1]:
        return np.zeros(len(forward))
    if how == "sum":
        return forward.sum(1) + (0 if single_strand else reverse.sum(1))
    if how == "max":
        return forward.max(1) if single_strand else np.maximum(forward.max(1), reverse.max(1))
    if how == "mean":
        return forward.mean(1) if single_strand else (forward.mean(1) + reverse.mean(1)) / 2
    raise ValueError(f"unknown reduction {how!r}")


def mode_alpha(forward: np.ndarray, reverse: np.ndarray, motif: Motif) -> np.ndarray:
    """A mode's affinity for each sequence."""
    if not motif.included:
        return np.zeros(len(forward))
    if motif.size == 0:
        return np.ones(len(forward))
    if motif.position_bias is None:
        return forward.sum(1) + reverse.sum(1)
    bias = np.exp(motif.position_bias)
    return forward @ bias[0] + reverse @ bias[1]


@dataclass(frozen=True)
class Interaction:
    """Weights of pairs of windows of two modes: strands x strands x frames x frames, logarithms; None: zeros."""

    modes: tuple[int, int]
    max_overlap: int = 0
    max_spacing: int = -1
    matrix: np.ndarray | None = None
    activity: tuple[float, ...] = (0.0,)
    cache: dict = field(default_factory=dict, compare=False, repr=False)

    def weights(self, frames: tuple[int, int], sizes: tuple[int, int], flanks: tuple[int, int]) -> np.ndarray:
        """exp of the matrix, 0 where windows overlap too much or are too far apart."""
        out = np.ones((2, 2, *frames)) if self.matrix is None else np.exp(self.matrix)
        for s0 in (0, 1):
            for s1 in (0, 1):
                start0, start1 = (
                    (np.arange(f) if s == 0 else f - 1 - np.arange(f)) - flank for s, f, flank in ((s0, frames[0], flanks[0]), (s1, frames[1], flanks[1]))
                )
                spacing = np.maximum(start1[None, :] - (start0 + sizes[0])[:, None], start0[:, None] - (start1 + sizes[1])[None, :])
                bad = -spacing > self.max_overlap
                if self.max_spacing != -1:
                    bad |= spacing > self.max_spacing
                out[s0, s1][bad] = 0.0
        return out

    def alpha(self, strands: list[tuple[np.ndarray, np.ndarray]], motifs: list[Motif]) -> np.ndarray:
        a, b = self.modes
        (w0, w1) = strands[a], strands[b]
        frames = (w0[0].shape[1], w1[0].shape[1])
        table = self.weights(frames, (motifs[a].size, motifs[b].size), (motifs[a].flank, motifs[b].flank))
        return sum(np.einsum("ni,ij,nj->n", w0[s], table[s, t], w1[t]) for s in (0, 1) for t in (0, 1))


def by_length(seqs: list[str]):
    """(length, indices) of the sequences of each length."""
    sizes = np.array([len(s) for s in seqs])
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)
