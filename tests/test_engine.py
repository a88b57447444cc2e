"""Hand cases, readers, writers, transforms, pipelines and streams."""

import gzip
import json
import math
import struct

import numpy as np
import pytest

from strandspark.operators import kmers, scoring
from strandspark.plans import transforms
from strandspark.plans.model import Model
from strandspark.plans.pipeline import Pipeline
from strandspark.sources import readers, writers
from strandspark.streaming import scores

TREE = {
    "modelSettings": {"letterComplement": "C-G,A-T", "letterOrder": "ACGT", "bindingModes": [{"size": 2, "flankLength": 0, "dinucleotideDistance": 1}]},
    "coefficients": {"bindingModes": [{"mononucleotide": [0, -1, -2, -3, -3, 0, -1, -2], "dinucleotide": [[0, 0.5, 0, 0, *[0] * 12]], "activity": [[0]]}]},
}


def _seqs(spark, *seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


@pytest.mark.parametrize(
    ("seq", "total", "most", "mean"),
    [("ACGT", 3.60474439, 1.64872127, 0.60079073), ("AACG", 1.99423249, 1.64872127, 0.33237208)],
)
def test_hand_scores(spark, seq, total, most, mean):
    for how, want in (("sum", total), ("max", most), ("mean", mean)):
        got = scoring.binding_mode_scores(_seqs(spark, seq), Model(TREE), how).first()["score_0"]
        assert got == pytest.approx(want, abs=1e-7)


def test_kmers_skip_unknown_letters(spark):
    rows = kmers.kmer_count(_seqs(spark, "ACGT", "AANC"), 2, True).filter("n > 0").collect()
    assert {r.kmer: r.n for r in rows} == {"AA": 1, "AC": 1, "CG": 1, "GT": 1}
    rows = kmers.kmer_count(_seqs(spark, "ACGT", "AANC"), 2).filter("n > 0").collect()
    assert {r.kmer: r.n for r in rows} == {"AA": 1, "AC": 2, "CG": 2, "GT": 2, "TT": 1}


def test_kmers_of_nothing(spark):
    assert kmers.kmer_count(_seqs(spark, "A", ""), 2, True).filter("n > 0").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ACGT\nAACG")
    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("ACGT\nAACG\n")
    for name in ("a.txt", "a.txt.gz"):
        assert sorted(r.seq for r in readers.text_sequences(spark, str(tmp_path / name)).collect()) == ["AACG", "ACGT"]
    (tmp_path / "a.fq").write_text("@r1\nACGT\n+\n@III\n@r2\nAACG\n+\n#III\n")
    assert sorted(r.seq for r in readers.fastq_sequences(spark, str(tmp_path / "a.fq")).collect()) == ["AACG", "ACGT"]
    (tmp_path / "a.fa").write_text(">x\nAC\nGT\n\n>y\nAACG\n")
    assert sorted(r.seq for r in readers.fasta_sequences(spark, str(tmp_path / "a.fa")).collect()) == ["AACG", "ACGT"]
    (tmp_path / "c.tsv").write_text("ACGT\t1\t2\nAACG\t0\t5\n")
    rows = readers.count_table(spark, str(tmp_path / "c.tsv")).collect()
    assert {tuple(r) for r in rows} == {("ACGT", 1, 2), ("AACG", 0, 5)}


def test_binary_counts(spark, tmp_path):
    code = 0
    for letter in "ACGT":
        code = code * 4 + "ACGT".index(letter)
    body = struct.pack(">qii", code, 4, 3)
    (tmp_path / "a.dat").write_bytes(body + struct.pack(">q", (1 << 63) - 1))
    rows = readers.dat_counts(spark, str(tmp_path / "a.dat")).collect()
    assert [(r.seq, r.n) for r in rows] == [("ACGT", 3)]


def test_count_table_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("ACGT", 1, 2), ("AACG", 0, 5)], "seq string, c0 int, c1 int")
    writers.write_count_table(table, str(tmp_path / "out"))
    back = readers.count_table(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def test_gauge_keeps_ratios(spark):
    model = Model(TREE)
    a = [r.score_0 for r in scoring.binding_mode_scores(_seqs(spark, "ACGTT", "TTACG"), model).collect()]
    b = [r.score_0 for r in scoring.binding_mode_scores(_seqs(spark, "ACGTT", "TTACG"), transforms.set_mismatch_gauge(model)).collect()]
    assert a[0] / a[1] == pytest.approx(b[0] / b[1])


def test_wildcards_are_means(spark):
    model = transforms.add_n_scoring(Model({**TREE, "coefficients": {"bindingModes": [{**TREE["coefficients"]["bindingModes"][0], "dinucleotide": [[0] * 16]}]}}))
    order = model.alphabet.order
    m = model.motif(0).mono
    n = order.index("N")
    others = [i for i in range(len(order)) if i != n]
    assert m[0, n] - m[0, others].max() == pytest.approx(math.log(np.exp(m[0, others] - m[0, others].max()).mean()), abs=1e-6)


def test_remove_mode():
    two = json.loads(json.dumps(TREE))
    two["modelSettings"]["bindingModes"] *= 2
    two["coefficients"]["bindingModes"] *= 2
    assert transforms.remove_binding_mode(Model(two), 0).modes == 1
    with pytest.raises((ValueError, IndexError)):
        transforms.remove_binding_mode(Model(two), 5)


def test_command_pipeline(spark, tmp_path):
    (tmp_path / "in.txt").write_text("ACGT\nAACG\n")
    (tmp_path / "m.json").write_text(json.dumps(TREE))
    Pipeline(spark).run(f"loadScoringModel({tmp_path}/m.json).inputTXT({tmp_path}/in.txt).bindingModeScores({tmp_path}/out.tsv)")
    text = "".join(p.read_text() for p in sorted(tmp_path.glob("out.tsv/part-*")))
    values = sorted(float(x.split("\t")[-1]) for x in text.splitlines() if x)
    assert values == pytest.approx([1.99423249, 3.60474439], rel=1e-4)


def test_stream_scores_as_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ACGT\nAACG\n")
    out = scores.scored_stream(scores.sequence_stream(spark, str(tmp_path / "in")), Model(TREE), "sum")
    scores.to_files(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.seq: r.score_0 for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["ACGT"] == pytest.approx(3.60474439, abs=1e-7) and got["AACG"] == pytest.approx(1.99423249, abs=1e-7)


@pytest.mark.parametrize("forward_only", [True, False])
def test_median_brute(spark, monkeypatch, forward_only):
    rng = np.random.default_rng(3)
    rows = [("".join(rng.choice(list("ACGTN"), 9)), float(v)) for v in [*rng.normal(size=60), *[2.5] * 20, 1e300, -1e300, math.inf, -math.inf]] + [("ACGTACGT", None)]
    seen = {}
    for seq, value in rows:
        for i in range(len(seq) - 1):
            word = seq[i : i + 2]
            if "N" not in word and value is not None:
                turned = word[::-1].translate(str.maketrans("ACGT", "TGCA"))
                for w in [word] if forward_only else [word, turned]:
                    seen.setdefault(w, []).append(value)
    for bins in (1, 3, 4096):
        monkeypatch.setattr(kmers, "MEDIAN_BINS", bins)
        got = kmers.kmer_median(spark.createDataFrame(rows, "seq string, value double"), 2, forward_only=forward_only).collect()
        assert len(got) == 16
        for r in got:
            assert r.median == pytest.approx(np.median(seen[r.kmer])) if r.kmer in seen else r.median is None
    empty = spark.createDataFrame([], "seq string, value double")
    assert {r.median for r in kmers.kmer_median(empty, 2).collect()} == {None}
