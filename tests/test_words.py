"""Windows as numbers, and the tabulations that rest on them, against loops."""

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from strandspark.functions import words
from strandspark.functions.alphabet import DNA, Alphabet
from strandspark.operators import kmers

GREEK = Alphabet.of("α-ω,b-𝛃", "αbω𝛃")


def _seen(rows, k: int, alphabet: Alphabet, forward_only: bool) -> dict:
    """The values of each k-mer's occurrences."""
    turn, out = str.maketrans(alphabet.order, alphabet.partners), {}
    for seq, *values in rows:
        for i in range(len(seq or "") - k + 1):
            word = seq[i : i + k]
            if set(word) <= set(alphabet.order):
                for w in [word] if forward_only else [word, word[::-1].translate(turn)]:
                    out.setdefault(w, []).append(values)
    return out


def _rows(alphabet: Alphabet, n: int = 80) -> list:
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice([*alphabet.order, "N", "é"], int(rng.integers(0, 14)), p=[*[0.9 / len(alphabet.order)] * len(alphabet.order), 0.05, 0.05])) for _ in range(n)]
    return [(t, float(v), int(w)) for t, v, w in zip(texts, rng.normal(size=n), rng.integers(-(2**55), 2**55, n), strict=True)] + [(None, 1.0, 1), (alphabet.order, None, None), ("", 2.0, 2)]


@pytest.mark.parametrize("alphabet", [DNA, GREEK])
def test_windows_are_cut_anywhere(monkeypatch, alphabet):
    texts = [r[0] for r in _rows(alphabet)]
    want = sorted((int("".join(str(alphabet.order.index(c)) for c in t[i : i + 3]), 4), j) for j, t in enumerate(texts) for i in range(len(t or "") - 2) if set(t[i : i + 3]) <= set(alphabet.order))
    for places in (1, 7, words.PLACES):
        monkeypatch.setattr(words, "PLACES", places)
        for array, skip in ((pa.array(texts), 0), (pa.array(["ACGT", *texts], pa.large_string())[1:], 0), (pa.array(texts)[9:], 9)):
            found = [x for ids, rows in words.Words(3, alphabet).windows(array) for x in zip(ids.tolist(), (rows + skip).tolist(), strict=True)]
            assert sorted(found) == [x for x in want if x[1] >= skip]
    assert not [*words.Words(3, alphabet).windows(pa.array([None, ""], pa.string()))][1:]


@pytest.mark.parametrize("alphabet", [DNA, GREEK])
@pytest.mark.parametrize("forward_only", [True, False])
def test_sums_brute(spark, alphabet, forward_only):
    rows = _rows(alphabet)
    df, seen = spark.createDataFrame(rows, "seq string, v double, w bigint").repartition(5), _seen(rows, 2, alphabet, forward_only)
    counts = {r.kmer: r.n for r in kmers.kmer_count(df, 2, forward_only, alphabet).collect()}
    assert len(counts) == 16 and {w: n for w, n in counts.items() if n} == {w: len(x) for w, x in seen.items()}
    # integers over 2^53 stay exact
    sums = {r.kmer: (r.v, r.w) for r in kmers.kmer_count(df, 2, forward_only, alphabet, values=["v", "w"]).collect()}
    exact = kmers.kmer_count(df.withColumn("w", df.w.cast("decimal(20,0)")), 2, forward_only, alphabet, values=["w"])
    assert {r.kmer: r.w for r in exact.collect()} == {w: Decimal(x[1]) for w, x in sums.items()}
    means = {r.kmer: r.v for r in kmers.kmer_average(df, 2, forward_only, 3.0, alphabet, values=["v"]).collect()}
    overall = sum(x[0] or 0 for v in seen.values() for x in v) / sum(map(len, seen.values()))
    for w, (v, i) in sums.items():
        got = seen.get(w, [])
        assert i == sum(x[1] or 0 for x in got) and v == pytest.approx(sum(x[0] or 0 for x in got))
        assert means[w] == pytest.approx((sum(x[0] or 0 for x in got) + 3 * overall) / (len(got) + 3))
    none = kmers.kmer_average(df.limit(0), 2, forward_only, 0.0, alphabet, values=["v"]).collect()
    assert len(none) == 16 and all(math.isnan(r.v) for r in none)


def test_windows_make_no_rows(spark):
    df = spark.range(3000).selectExpr("translate(md5(cast(id as string)), '0123456789abcdef', 'ACGTACGTACGTACGT') seq", "double(id) value")
    for out in (kmers.kmer_count(df, 3), kmers.kmer_average(df, 3, values=["value"]), kmers.kmer_median(df, 3)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and plan.count("MapInArrow") == 1  # nor are the sequences read twice for it
