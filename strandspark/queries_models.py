"""Queries of model transforms, of models' less common parts and of files, and their SQL for DuckDB.

The SQL starts from the numbers that the models are made of, not from the models' own views."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions.alphabet import DNA
from strandspark.operators import kmers, scoring
from strandspark.plans import transforms
from strandspark.plans.model import Model
from strandspark.queries import _COUNTS_SQL, MONO, MONO_DI, PAIRED, ROUND_PROBE, ROUNDS, SEVERAL, _coefficients, _counts, _empirical, _lineitem, _mode, _model, _rounded, _sum_sql, _windows_sql
from strandspark.sources import readers, writers
from strandspark.sources.scratch import scratch

PART_PROBE = "translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_PARTS = f"p AS (SELECT {PART_PROBE} AS seq FROM part)"
SIZE = 32


def _part(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").selectExpr(f"{PART_PROBE} AS seq", *more)


# -- SQL of coefficients: from the flat lists of the model's values


def _lists(*modes: tuple[dict, dict]) -> str:
    """A relation of the coefficients of modes as _mode makes them: mode, d, x, l1, l2, beta."""
    parts = []
    for i, (_, own) in enumerate(modes):
        for d, values in enumerate([own["mononucleotide"], *own["dinucleotide"]]):
            letters = "i // 4, substr('ACGT', i % 4 + 1, 1), ''" if d == 0 else "i // 16, substr('ACGT', i // 4 % 4 + 1, 1), substr('ACGT', i % 4 + 1, 1)"
            parts.append(f"SELECT {i}, {d}, {letters}, v FROM (SELECT CAST(unnest(range({len(values)})) AS INTEGER) i, unnest({[float(x) for x in values]}::DOUBLE[]) v)")
    return "k(mode, d, x, l1, l2, beta) AS (" + " UNION ALL ".join(parts) + ")"


_ALL = "SELECT CAST(mode AS INTEGER) AS mode, CAST(d AS INTEGER) AS d, CAST(x AS INTEGER) AS x, l1, l2, beta FROM k"


def _texts_sql(model: Model, i: int, name: str) -> str:
    """A relation of every text of the mode's size and its energy."""
    n = range(model.settings["bindingModes"][i]["size"])
    return f"{name} AS (SELECT k, {_sum_sql(model, i, 'k')} e FROM (SELECT {' || '.join(f'l{x}.c' for x in n)} k FROM {', '.join(f'l l{x}' for x in n)}))"


_LETTERS = "l(c) AS (VALUES ('A'), ('C'), ('G'), ('T'))"


def _affinities(model: Model, experiment: int = 0):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return scoring.with_alphas(_part(spark, d), model, experiment, 1).select("seq", F.round(F.col("alpha")[0], 6).alias("affinity"))

    return run


def _affinities_sql(*modes: tuple[dict, dict]) -> str:
    """Sums over modes of affinity times activity."""
    plain, parts, sums = _model(*modes), [_PARTS], []
    for i, (setting, own) in enumerate(modes):
        a = math.exp(own["activity"][0][0])
        if setting["size"]:
            parts += [_windows_sql(plain, i, "p", f"w{i}_"), f"a{i} AS (SELECT seq, sum(alpha) a FROM w{i}_ GROUP BY seq)"]
            sums.append(f"{a!r} * a{i}.a")
        else:
            sums.append(repr(a))
    joins = " ".join(f"JOIN a{i} USING (seq)" for i, m in enumerate(modes) if m[0]["size"])
    return f"WITH {', '.join(parts)} SELECT seq, round({' + '.join(sums)}, 6) AS affinity FROM p {joins}"


# -- models and the modes that they are made of

_NONE, _FOUR, _SIX = lambda: _mode(0, 0, activity=[[-2.0]]), lambda: _mode(4, 3, activity=[[0.5]]), lambda: _mode(6, 1, 1, activity=[[-0.5]])
FAR = _model(_mode(6, 1, 3))
SELECTED = _model(_FOUR(), _SIX(), settings={"enrichmentModel": [{"modelType": "SELEX", "bindingModes": [1]}]})
EXCLUDED = Model(_model(_FOUR(), _SIX()).tree | {"metadata": {"bindingMode": [{"includeComponent": False}, {"includeComponent": True}]}})
_MONO_SHIFT, _DI_SHIFT = [0.25, -0.5, 0.75, 0.125, -0.25], [0.5, -0.25, 0.125, 0.75, -0.5, 0.25, -0.125, 0.375]
CHANGED = _model(
    _mode(5, 2, 1, modifications=[{"name": "methyl", "mononucleotide": ["C"], "dinucleotide": [["CG", "GC"]]}], shifts=[{"mononucleotide": _MONO_SHIFT, "dinucleotide": [_DI_SHIFT]}]),
    settings={"enrichmentModel": [{"modelType": "SELEX", "modifications": ["methyl"]}]},
)


def _changed_mode() -> tuple[dict, dict]:
    setting, own = _mode(5, 2, 1)
    for x, shift in enumerate(_MONO_SHIFT):
        own["mononucleotide"][4 * x + 1] += shift
    for x in range(4):
        own["dinucleotide"][0][16 * x + 4 * 1 + 2] += _DI_SHIFT[2 * x]  # CG
        own["dinucleotide"][0][16 * x + 4 * 2 + 1] += _DI_SHIFT[2 * x + 1]  # GC
    return setting, own


_SPACED = {"bindingModes": [0, 1], "maxOverlap": 1, "maxSpacing": 4}
_WEIGHT = [[[[((3 * s + 5 * t + 7 * i + 11 * j) % 13 - 6) / 8 for j in range(SIZE - 3)] for i in range(SIZE - 2)] for t in (0, 1)] for s in (0, 1)]
MATRIX = _model(
    _mode(3, 4), _mode(4, 3),
    settings={"bindingModeInteractions": [_SPACED]},
    values={"bindingModeInteractions": [{"activity": [[0.25]], "positionMatrix": [_WEIGHT]}]},
)
SAID = _model(_FOUR(), _SIX(), settings={"bindingModeInteractions": [dict(_SPACED)]}, values={"bindingModeInteractions": [{"activity": [[0.25]], "positionMatrix": []}]})
FLANKED = _model(_mode(5, 2, flankLength=2))


def _spacing(a: str, b: str) -> str:
    """Letters between windows of 3 at a and of 4 at b."""
    return f"greatest({b} - {a} - 3, {a} - {b} - 4)"


def _matrix_sql() -> str:
    at = lambda w, k: f"(CASE WHEN {w}.s = 0 THEN {w}.x ELSE {SIZE - k} - {w}.x END)"
    gap = _spacing(at("u", 3), at("v", 4))
    return (
        f"WITH {_PARTS}, {_windows_sql(MATRIX, 0, 'p', 'u')}, {_windows_sql(MATRIX, 1, 'p', 'v')},"
        f" i AS (SELECT u.seq, sum(u.alpha * v.alpha * exp(((3 * u.s + 5 * v.s + 7 * u.x + 11 * v.x) % 13 - 6) / 8.0::DOUBLE)) a FROM u JOIN v ON u.seq = v.seq WHERE -({gap}) <= 1 AND {gap} <= 4 GROUP BY u.seq),"
        " a AS (SELECT seq, sum(alpha) a FROM u GROUP BY seq), b AS (SELECT seq, sum(alpha) a FROM v GROUP BY seq)"
        f" SELECT seq, round(a.a + b.a + {math.exp(0.25)!r} * i.a, 6) AS affinity FROM a JOIN b USING (seq) JOIN i USING (seq)"
    )


_MEANS = ", z AS (SELECT mode, d, x, avg(exp(beta)) a FROM k GROUP BY ALL), e AS (SELECT mode, product(a) a FROM z GROUP BY mode), t(a0, a1, a2) AS (SELECT max(CASE WHEN mode = 0 THEN a END), max(CASE WHEN mode = 1 THEN a END), max(CASE WHEN mode = 2 THEN a END) FROM e)"


def _expected_sql() -> str:
    """Expected affinities of random probes of 32 letters: of several modes, and of two that interact."""
    several = f"WITH {_lists(_NONE(), _FOUR(), _SIX())}{_MEANS} SELECT exp(-2.0) + 2 * {SIZE - 3} * a1 * exp(0.5) + 2 * {SIZE - 5} * a2 * exp(-0.5) z FROM t"
    pairs = f"(SELECT 4 * count(*) FROM range({SIZE - 2}) a(i), range({SIZE - 3}) b(j) WHERE -({_spacing('i', 'j')}) <= 1 AND {_spacing('i', 'j')} <= 4)"
    paired = f"WITH {_lists(_mode(3, 4), _mode(4, 3))}{_MEANS} SELECT 2 * {SIZE - 2} * a0 + 2 * {SIZE - 3} * a1 + {pairs} * a0 * a1 * exp(0.25) z FROM t"
    return f"SELECT 'several' AS model, round(z, 6) AS z FROM ({several}) UNION ALL SELECT 'paired', round(z, 6) FROM ({paired})"


def _expected(spark: SparkSession, d: str) -> DataFrame:
    rows = [(name, float(transforms.expected_partition_function(m, 0, SIZE)[0])) for name, m in (("several", SEVERAL), ("paired", PAIRED))]
    return _rounded(spark.createDataFrame(rows, "model string, z double"), "z")


def _activities(spark: SparkSession, model: Model) -> DataFrame:
    return _rounded(spark.createDataFrame([(i, float(model.activity(i)[0])) for i in range(model.modes)], "mode int, activity double"), "activity")


def _standard_sql() -> str:
    z = f"(WITH {_lists(_NONE(), _FOUR(), _SIX())}{_MEANS} SELECT exp(-2.0) + 2 * {SIZE - 3} * a1 * exp(0.5) + 2 * {SIZE - 5} * a2 * exp(-0.5) z FROM t)"
    return f"SELECT CAST(i AS INTEGER) AS mode, round(a - ln(z), 6) AS activity FROM (VALUES (0, -2.0::DOUBLE), (1, 0.5), (2, -0.5)) v(i, a), {z}"


def _consensus_sql() -> str:
    tops = f"WITH {_LETTERS}, {_texts_sql(SEVERAL, 1, 'f')}, {_texts_sql(SEVERAL, 2, 's')}, a(mode, a) AS (SELECT 0, -2.0::DOUBLE UNION ALL SELECT 1, 0.5 + (SELECT max(e) FROM f) UNION ALL SELECT 2, -0.5 + (SELECT max(e) FROM s))"
    return f"{tops} SELECT CAST(mode AS INTEGER) AS mode, round(a - (SELECT max(a) FROM a), 6) AS activity FROM a"


def _empirical_sql() -> str:
    rounds = " UNION ALL ".join(f"SELECT {r} AS n, sum(c{r} * f) / sum(c{r}) f, sum(c{r} * r) / sum(c{r}) r FROM c JOIN q USING (seq)" for r in range(3))
    return (
        f"WITH {_COUNTS_SQL}, {_windows_sql(MONO_DI, 0, 'c')}, q AS (SELECT seq, sum(CASE WHEN s = 0 THEN alpha ELSE 0 END) f, sum(CASE WHEN s = 1 THEN alpha ELSE 0 END) r, max(alpha) b FROM w GROUP BY seq), m AS ({rounds})"
        ' SELECT CAST(n AS INTEGER) AS "round", round(f, 6) AS forward, round(r, 6) AS reverse, (SELECT round(max(b), 6) FROM q) AS largest, round(ln(f / r), 6) AS log_strand_ratio, (SELECT round(regr_slope(ln(f + r), n::DOUBLE), 6) FROM m) AS slope FROM m'
    )


def _grown_mode() -> tuple[dict, dict]:
    """One position of zeros before, two after."""
    setting, own = _mode(6, 1, 1)
    own["mononucleotide"] = [0.0] * 4 + own["mononucleotide"] + [0.0] * 8
    own["dinucleotide"] = [[0.0] * 16 + own["dinucleotide"][0] + [0.0] * 32]
    return setting | {"size": 9}, own


def _doubled(spark: SparkSession, d: str) -> DataFrame:
    tree = MONO_DI.tree
    tree["coefficients"] = transforms.combine(MONO_DI.values, transforms.mapped(MONO_DI.values, lambda x: -3 * x), lambda a, b: a - b)
    return _coefficients(spark, Model(tree))


def _symmetric_sql() -> str:
    mono = "SELECT a.x, a.l1, a.l2, a.d, (a.beta + b.beta) / 2 beta FROM k a JOIN k b ON a.d = 0 AND b.d = 0 AND b.x = 5 - a.x AND b.l1 = translate(a.l1, 'ACGT', 'TGCA')"
    di = "SELECT a.x, a.l1, a.l2, a.d, (a.beta + b.beta) / 2 FROM k a JOIN k b ON a.d = 1 AND b.d = 1 AND b.x = 4 - a.x AND b.l1 = translate(a.l2, 'ACGT', 'TGCA') AND b.l2 = translate(a.l1, 'ACGT', 'TGCA')"
    return f"WITH {_lists(_mode(6, 1, 1))}, m AS ({mono} UNION ALL {di}) SELECT CAST(0 AS INTEGER) AS mode, CAST(d AS INTEGER) AS d, CAST(x AS INTEGER) AS x, l1, l2, beta FROM m"


_SEED = "RYNCGW"
_ALLOWED = "CASE c WHEN 'R' THEN 'AG' WHEN 'Y' THEN 'CT' WHEN 'N' THEN 'ACGT' WHEN 'W' THEN 'AT' ELSE c END"


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    model = transforms.seeded(Model({"modelSettings": {"bindingModes": [{"size": 6}]}, "modelSeeding": {"bindingModes": [{"mononucleotideIUPAC": _SEED, "seedScale": 2.0}]}}))
    return _coefficients(spark, model).select("x", "l1", "beta")


def _top_sql() -> str:
    return f"WITH {_LETTERS}, {_texts_sql(MONO_DI, 0, 't')} SELECT k AS seq, round(e, 6) AS energy FROM t ORDER BY e DESC, k LIMIT 1"


def _top(spark: SparkSession, d: str) -> DataFrame:
    motif = MONO_DI.motif(0)
    best = transforms.top_sequence(motif)
    return spark.createDataFrame([("".join("ACGT"[a] for a in best), round(transforms.energy(motif, best), 6))], "seq string, energy double")


_MEAN_POSITION = f"WITH {_lists(_mode(5, 2))}, z AS (SELECT x, sum(exp(beta)) z FROM k GROUP BY x), i AS (SELECT x, 2 + sum(exp(beta) / z * log2(exp(beta) / z)) w FROM k JOIN z USING (x) GROUP BY x) SELECT round(sum(w * x) / sum(w), 6) AS position FROM i"

# -- files, written to the shared folder and read back


def _written(df: DataFrame, name: str) -> str:
    """Texts of a column of lines or records as files."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").text(path)
    return path


def _text_file(spark: SparkSession, d: str) -> DataFrame:
    return readers.text_sequences(spark, _written(_part(spark, d), "text")).select("seq")


def _table_file(spark: SparkSession, d: str) -> DataFrame:
    path = _written(_part(spark, d, "p_size", "p_partkey").select(F.concat_ws("\t", F.col("p_size").cast("string"), "seq", F.col("p_partkey").cast("string"))), "table")
    return readers.value_columns(readers.table_sequences(spark, path, 1), 2).drop("seq_id")


def _fastq_file(spark: SparkSession, d: str) -> DataFrame:
    path = _written(_part(spark, d, "p_partkey").select(F.format_string("@r%d\n%s\n+\n%s", F.col("p_partkey").cast("long"), "seq", F.repeat(F.lit("@"), SIZE))), "fastq")
    return readers.fastq_sequences(spark, path).select("seq")


def _fasta_file(spark: SparkSession, d: str) -> DataFrame:
    path = _written(_part(spark, d, "p_partkey").select(F.format_string(">r%d\n%s\n%s", F.col("p_partkey").cast("long"), F.substring("seq", 1, 20), F.substring("seq", 21, 12))), "fasta")
    return readers.fasta_sequences(spark, path).select("seq")


def _fastq_counted(spark: SparkSession, d: str) -> DataFrame:
    reads = _lineitem(spark, d).selectExpr(f"concat('@r\nGATTA', {ROUND_PROBE}, 'CAGT\n+\n', repeat('I', 41))")
    return readers.fastq_counts(spark, _written(reads, "counted"), "GATTA", "CAGT")


def _counts_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "counts")
    writers.write_count_table(_counts(spark, d), path, compressed=True)
    return readers.read_counts(spark, path, "tsv.gz", 3)


def _rounds_file(spark: SparkSession, d: str) -> DataFrame:
    reads = _lineitem(spark, d)
    return readers.rounds_table(spark, [_written(reads.filter(F.col("l_returnflag") == r).selectExpr(ROUND_PROBE), f"round-{r}") for r in ROUNDS])


def _kmers_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "kmers")
    writers.write_kmers(kmers.kmer_count(_part(spark, d), 2, True), path)
    return spark.read.csv(path, sep="\t", schema="kmer string, n bigint")


def _u_letters(spark: SparkSession, d: str) -> DataFrame:
    return readers.normalised(_part(spark, d).select(F.translate("seq", "T", "U").alias("seq")), DNA)


def _formatted(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size").cast("double") / 8).alias("v"))
    forms = [writers.formatted(prices, form).select("p_partkey", F.lit(kind).alias("kind"), "v") for kind, form in writers.FORMATS.items()]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


_FITS = [(3, 12.5), (1, 7.25), (2, 9.0)]


def _fits(spark: SparkSession) -> str:
    """A file of three fits, the second of them the best."""
    lines = [json.dumps(_model(_mode(4, seed)).tree | {"metadata": {"logLikelihood": loss}}) for seed, loss in _FITS]
    return _written(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), "fits")


QUERIES = {
    "score_distance_3": lambda s, d: scoring.binding_mode_scores(_part(s, d), FAR).select("seq", F.round("score_0", 6).alias("score")),
    "mode_selection": _affinities(SELECTED),
    "include_component": _affinities(EXCLUDED),
    "modified_dinucleotides": _affinities(CHANGED),
    "interaction_matrix": _affinities(MATRIX),
    "remove_binding_mode": _affinities(transforms.remove_binding_mode(SEVERAL, 1)),
    "select_binding_mode": _affinities(transforms.select_binding_mode(SEVERAL, 2)),
    "select_and_clean": _affinities(transforms.select_and_clean(SEVERAL, 2)),
    "remove_interaction": _affinities(transforms.remove_interaction(SAID, 0)),
    "clean": lambda s, d: scoring.binding_mode_scores(_part(s, d), transforms.clean(FLANKED)).select("seq", F.round("score_0", 6).alias("score")),
    "expected_partition_function": _expected,
    "standard_activities": lambda s, d: _activities(s, transforms.standardise_activities(SEVERAL, 0, SIZE)),
    "coefficients": lambda s, d: _coefficients(s, MONO_DI),
    "consensus": lambda s, d: _activities(s, transforms.build_consensus(SEVERAL)),
    "empirical_activity": _empirical,
    "modify_motif": lambda s, d: _coefficients(s, transforms.modify_motif(MONO_DI, 0, 1, 2)),
    "symmetric": lambda s, d: _coefficients(s, transforms.symmetric(MONO_DI, 0)),
    "seeded": _seeded,
    "packed": lambda s, d: _coefficients(s, transforms.unpacked(MONO_DI, 2 * transforms.packed(MONO_DI))),
    "tree_algebra": _doubled,
    "top_sequence": _top,
    "mean_position": lambda s, d: s.createDataFrame([(round(transforms.mean_position(MONO.motif(0)), 6),)], "position double"),
    "best_fit": lambda s, d: _coefficients(s, Model.load_fit(s, _fits(s))),
    "fit_line": lambda s, d: _coefficients(s, Model.load_fit(s, _fits(s), 2)),
    "text_file": _text_file,
    "table_file": _table_file,
    "fastq_file": _fastq_file,
    "fasta_file": _fasta_file,
    "fastq_counts": _fastq_counted,
    "count_table_file": _counts_file,
    "rounds_file": _rounds_file,
    "kmer_file": _kmers_file,
    "normalise_u": _u_letters,
    "number_formats": _formatted,
}

_PART_SEQS = f"WITH {_PARTS} SELECT seq FROM p"
_ROUND_COUNTS = f"WITH {_COUNTS_SQL} SELECT seq, c0, c1, c2 FROM c"

SQL = {
    "score_distance_3": f"WITH {_PARTS}, {_windows_sql(FAR, 0, 'p')} SELECT seq, round(sum(alpha), 6) AS score FROM w GROUP BY seq",
    "mode_selection": _affinities_sql(_SIX()),
    "include_component": _affinities_sql(_SIX()),
    "modified_dinucleotides": _affinities_sql(_changed_mode()),
    "interaction_matrix": _matrix_sql(),
    "remove_binding_mode": _affinities_sql(_NONE(), _SIX()),
    "select_binding_mode": _affinities_sql(_SIX()),
    "select_and_clean": _affinities_sql(_mode(6, 1, 1)),
    "remove_interaction": _affinities_sql(_FOUR(), _SIX()),
    "clean": f"WITH {_PARTS}, {_windows_sql(_model(_mode(5, 2)), 0, 'p')} SELECT seq, round(sum(alpha), 6) AS score FROM w GROUP BY seq",
    "expected_partition_function": _expected_sql(),
    "standard_activities": _standard_sql(),
    "coefficients": f"WITH {_lists(_mode(6, 1, 1))} {_ALL}",
    "consensus": _consensus_sql(),
    "empirical_activity": _empirical_sql(),
    "modify_motif": f"WITH {_lists(_grown_mode())} {_ALL}",
    "symmetric": _symmetric_sql(),
    "seeded": f"SELECT CAST(x AS INTEGER) AS x, l AS l1, CASE WHEN contains({_ALLOWED}, l) THEN 0.0 ELSE -2.0 END::DOUBLE AS beta FROM (SELECT unnest(range({len(_SEED)})) x, unnest(string_split('{_SEED}', '')) c), (VALUES ('A'), ('C'), ('G'), ('T')) v(l)",
    "packed": f"WITH {_lists(_mode(6, 1, 1))} {_ALL.replace('beta', '2 * beta AS beta')}",
    "tree_algebra": f"WITH {_lists(_mode(6, 1, 1))} {_ALL.replace('beta', '4 * beta AS beta')}",
    "top_sequence": _top_sql(),
    "mean_position": _MEAN_POSITION,
    "best_fit": f"WITH {_lists(_mode(4, 1))} {_ALL}",
    "fit_line": f"WITH {_lists(_mode(4, 2))} {_ALL}",
    "text_file": _PART_SEQS,
    "table_file": f"SELECT {PART_PROBE} AS seq, CAST(p_size AS DOUBLE) AS v0, CAST(p_partkey AS DOUBLE) AS v1 FROM part",
    "fastq_file": _PART_SEQS,
    "fasta_file": _PART_SEQS,
    "fastq_counts": f"SELECT {ROUND_PROBE} AS seq, count(*) AS n FROM lineitem GROUP BY 1",
    "count_table_file": f"WITH {_COUNTS_SQL} SELECT seq, CAST(c0 AS INTEGER) AS c0, CAST(c1 AS INTEGER) AS c1, CAST(c2 AS INTEGER) AS c2 FROM c",
    "rounds_file": _ROUND_COUNTS,
    "kmer_file": f"WITH {_PARTS}, {_LETTERS}, f AS (SELECT substr(seq, i + 1, 2) kmer FROM (SELECT seq, unnest(range(length(seq) - 1)) i FROM p)) SELECT a.c || b.c AS kmer, (SELECT count(*) FROM f WHERE f.kmer = a.c || b.c) AS n FROM l a, l b",
    "normalise_u": _PART_SEQS,
    "number_formats": "SELECT p_partkey, kind, CASE kind WHEN 'affinity' THEN printf('%.8f', v) WHEN 'modes' THEN printf('%.5e', v) ELSE printf('%.10e', v) END AS v FROM (SELECT p_partkey, p_size::DOUBLE / 8 v FROM part), (VALUES ('affinity'), ('modes'), ('counts')) k(kind)",
}
