"""Queries over the test tables, one per operator, and their SQL for DuckDB.

The tables hold no sequences, so probes are derived from keys by expressions that both engines read alike."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions.alphabet import DNA, Alphabet, distinct_letters
from strandspark.operators import counttable, kmers, scoring
from strandspark.plans import transforms
from strandspark.plans.model import Model

PROBE = "translate(md5(concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT')"
ROUND_PROBE = "translate(md5(CAST(l_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
WILD_PROBE = "translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGN')"
ROUNDS = ["A", "N", "R"]


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def _probes(spark: SparkSession, d: str, *values: str) -> DataFrame:
    return _lineitem(spark, d).selectExpr(f"{PROBE} AS seq", *values)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return counttable.pivot_rounds(_lineitem(spark, d).selectExpr(f"{ROUND_PROBE} AS seq", "l_returnflag AS round"), ROUNDS)


# -- models: numbers with few digits, so that both engines hold the same doubles


def _numbers(n: int, seed: int) -> list[float]:
    return [((i * 7 + seed * 13) % 11 - 7) / 4 for i in range(n)]


def _mode(size: int, seed: int, reach: int = 0, **more) -> tuple[dict, dict]:
    values = {"mononucleotide": _numbers(4 * size, seed), "dinucleotide": [[x / 4 for x in _numbers(16 * (size - d), seed + d)] for d in range(1, reach + 1)], "activity": more.pop("activity", [[0.0]])}
    for key in ("positionBias",):
        if key in more:
            values[key] = more[key]
            more[key] = True
    shifts = more.pop("shifts", None)
    if shifts:
        values["modifications"] = shifts
    return {"size": size, "dinucleotideDistance": reach} | more, values


def _model(*modes: tuple[dict, dict], **more) -> Model:
    tree = {"modelSettings": {"bindingModes": [m[0] for m in modes]} | more.get("settings", {}), "coefficients": {"bindingModes": [m[1] for m in modes]} | more.get("values", {})}
    return Model(tree)


MONO_DI = _model(_mode(6, 1, 1))
MONO = _model(_mode(5, 2))
SINGLE = _model(_mode(6, 1, 1, singleStrand=True))
FLANKED = _model(_mode(5, 2, flankLength=2))
MODIFIED = _model(_mode(5, 2, modifications=[{"name": "methyl", "mononucleotide": ["C"], "dinucleotide": []}], shifts=[{"mononucleotide": [0.25, -0.5, 0.75, 0.125, -0.25], "dinucleotide": []}]))
BIAS = [[[((i * 5) % 7 - 3) / 8 for i in range(28)], [((i * 3) % 5 - 2) / 8 for i in range(28)]]]
BIASED = _model(_mode(5, 2, positionBias=BIAS))
SEVERAL = _model(_mode(0, 0, activity=[[-2.0]]), _mode(4, 3, activity=[[0.5]]), _mode(6, 1, 1, activity=[[-0.5]]))
PAIRED = _model(
    _mode(3, 4), _mode(4, 3),
    settings={"bindingModeInteractions": [{"bindingModes": [0, 1], "maxOverlap": 1, "maxSpacing": 4}]},
    values={"bindingModeInteractions": [{"activity": [[0.25]], "positionMatrix": []}]},
)


def _enriched(kind: str, **more) -> Model:
    setting = {"modelType": kind, "concentration": 0.01} | {k: v for k, v in more.items() if k in ("bindingSaturation", "cumulativeEnrichment")}
    return _model(
        _mode(4, 3, activity=[[0.0, 0.25, 0.5]]),
        settings={"enrichmentModel": [setting]},
        values={"enrichmentModel": [{k: v for k, v in more.items() if k in ("rho", "gamma", "delta")}], "countTable": [{"h": [0.0, 0.125, -0.25]}]},
    )


# -- SQL of scores: coefficients as tables of values, windows unnested


def _sum_sql(model: Model, i: int, window: str) -> str:
    """Energy of the window text `window`, as sums of literal lookups."""
    m, letters = model.motif(i, bias=False), model.alphabet.order
    terms = []
    for x in range(m.size):
        cases = " ".join(f"WHEN '{a}' THEN {float(v)!r}" for a, v in zip(letters, m.mono[x], strict=True))
        terms.append(f"CASE substr({window}, {x + 1}, 1) {cases} END")
    for d, table in enumerate(m.di, 1):
        for x in range(m.size - d):
            cases = " ".join(f"WHEN '{letters[a]}{letters[b]}' THEN {float(table[x, a, b])!r}" for a, b in np.argwhere(table[x]))
            if cases:
                terms.append(f"CASE substr({window}, {x + 1}, 1) || substr({window}, {x + 1 + d}, 1) {cases} ELSE 0 END")
    return " + ".join(terms)


def _windows_sql(model: Model, i: int, source: str, name: str = "w", left: str = "", right: str = "") -> str:
    """A relation of alpha by seq, strand s and offset x (of that strand)."""
    m = model.motif(i, bias=False)
    n = model.settings["bindingModes"][i]["flankLength"]
    whole = f"('{left[len(left) - n :]}' || seq || '{right[:n]}')" if n else "seq"
    strands = f"SELECT seq, 0 s, {whole} t FROM {source}" + ("" if m.single_strand else f" UNION ALL SELECT seq, 1 s, reverse(translate({whole}, 'ACGT', 'TGCA')) t FROM {source}")
    return (
        f"{name}0 AS ({strands}), {name}1 AS (SELECT seq, s, x, substr(t, x + 1, {m.size}) k FROM (SELECT seq, s, t, unnest(range(length(t) - {m.size} + 1)) x FROM {name}0)),"
        f" {name} AS (SELECT seq, s, x, exp({_sum_sql(model, i, 'k')}) alpha FROM {name}1)"
    )


_DISTINCT = f"p AS (SELECT DISTINCT {PROBE} AS seq FROM lineitem)"


def _each(probe: str, select: str) -> str:
    """A selection by different probes, as one row per row of lineitem."""
    head, _, tail = select.rpartition(" SELECT seq, ")
    return f"{head}, r AS (SELECT seq, {tail}) SELECT r.* FROM (SELECT {probe} AS seq FROM lineitem) e JOIN r USING (seq)"


_COUNTS_SQL = "c AS (SELECT " + ROUND_PROBE + " AS seq, " + ", ".join(f"CAST(sum(CASE WHEN l_returnflag = '{r}' THEN 1 ELSE 0 END) AS BIGINT) AS c{i}" for i, r in enumerate(ROUNDS)) + " FROM lineitem GROUP BY 1)"


def _score_query(model: Model, how: str = "sum", **more):
    def run(spark: SparkSession, d: str) -> DataFrame:
        seqs = _probes(spark, d)
        return scoring.binding_mode_scores(seqs, model, how, **more).select("seq", F.round("score_0", 6).alias("score"))

    return run


def _score_sql(model: Model, how: str = "sum", left: str = "", right: str = "") -> str:
    value = {"sum": "sum(alpha)", "max": "max(alpha)", "mean": "avg(alpha)"}[how]
    return _each(PROBE, f"WITH {_DISTINCT}, {_windows_sql(model, 0, 'p', left=left, right=right)} SELECT seq, round({value}, 6) AS score FROM w GROUP BY seq")


def _affinity_query(model: Model):
    def run(spark: SparkSession, d: str) -> DataFrame:
        seqs = _probes(spark, d)
        return scoring.affinity_sum(seqs, model, strict=False).select("seq", F.round("affinity_sum", 6).alias("affinity"))

    return run


def _affinity_sql(model: Model) -> str:
    parts, sums = [], []
    for i in range(model.modes):
        a = float(math.exp(model.activity(i)[0]))
        if model.settings["bindingModes"][i]["size"] == 0:
            sums.append(repr(a))
        else:
            parts.append(_windows_sql(model, i, "p", f"w{i}_"))
            parts.append(f"a{i} AS (SELECT seq, sum(alpha) a FROM w{i}_ GROUP BY seq)")
            sums.append(f"{a!r} * a{i}.a")
    joins = " ".join(f"JOIN a{i} USING (seq)" for i in range(model.modes) if model.settings["bindingModes"][i]["size"])
    return _each(PROBE, f"WITH {_DISTINCT}, {', '.join(parts)} SELECT seq, round({' + '.join(sums)}, 6) AS affinity FROM p {joins}")


def _biased_sql() -> str:
    bias = ", ".join(f"({s}, {x}, {v!r})" for s, row in enumerate(BIAS[0]) for x, v in enumerate(row))
    return _each(PROBE, f"WITH {_DISTINCT}, {_windows_sql(BIASED, 0, 'p')}, b(s, x, v) AS (VALUES {bias}) SELECT seq, round(sum(alpha * exp(b.v)), 6) AS affinity FROM w JOIN b USING (s, x) GROUP BY seq")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    seqs = spark.read.parquet(f"{d}/part.parquet").selectExpr("translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq")
    return scoring.profile_rows(seqs, MONO_DI).select("seq", "strand", "x", F.round("alpha", 6).alias("alpha"))


def _profile_sql() -> str:
    source = "p AS (SELECT translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part)"
    return f"WITH {source}, {_windows_sql(MONO_DI, 0, 'p')} SELECT seq, CAST(s AS INTEGER) AS strand, CAST(CASE WHEN s = 0 THEN x ELSE length(seq) - 6 - x END AS INTEGER) AS x, round(alpha, 6) AS alpha FROM w"


def _interactions(spark: SparkSession, d: str) -> DataFrame:
    seqs = _lineitem(spark, d).selectExpr(f"{ROUND_PROBE} AS seq")
    return scoring.with_alphas(seqs, PAIRED, 0, 1).select("seq", F.round(F.col("alpha")[0], 6).alias("alpha"))


def _interactions_sql() -> str:
    k0, k1, n = 3, 4, 32
    own = PAIRED.interaction(0)
    at = lambda s, x, k: f"(CASE WHEN {s} = 0 THEN {x} ELSE {n - k} - {x} END)"
    s0, s1 = at("u.s", "u.x", k0), at("v.s", "v.x", k1)
    spacing = f"greatest({s1} - {s0} - {k0}, {s0} - {s1} - {k1})"
    return _each(
        ROUND_PROBE,
        f"WITH p AS (SELECT DISTINCT {ROUND_PROBE} AS seq FROM lineitem), {_windows_sql(PAIRED, 0, 'p', 'u')}, {_windows_sql(PAIRED, 1, 'p', 'v')},"
        f" i AS (SELECT u.seq, sum(u.alpha * v.alpha) a FROM u JOIN v ON u.seq = v.seq WHERE -({spacing}) <= {own.max_overlap} AND {spacing} <= {own.max_spacing} GROUP BY u.seq),"
        " a AS (SELECT seq, sum(alpha) a FROM u GROUP BY seq), b AS (SELECT seq, sum(alpha) a FROM v GROUP BY seq)"
        f" SELECT seq, round(a.a + b.a + {math.exp(0.25)!r} * coalesce(i.a, 0), 6) AS alpha FROM a JOIN b USING (seq) LEFT JOIN i USING (seq)",
    )


ENRICHED = {
    "predict_selex": _enriched("SELEX"),
    "predict_selex_saturated": _enriched("SELEX", bindingSaturation=True),
    "predict_selex_noncumulative": _enriched("SELEX", cumulativeEnrichment=False),
    "predict_rhogamma": _enriched("RhoGamma", rho=[0, 1, 2], gamma=[-1, -1, -1]),
    "predict_exponential": _enriched("Exponential"),
    "predict_expkinetics": _enriched("ExponentialKinetics", delta=[0, 1, 2]),
}


def _predicted(model: Model):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = scoring.predict_count_table(_counts(spark, d), model)
        return out.select("seq", *(F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")))

    return run


def _predicted_sql(model: Model) -> str:
    setting = model.enrichment()
    kind = setting["modelType"]
    alpha = [f"(0.01 * a * {math.exp(x)!r})" for x in model.activity(0)]
    factor = []
    for r, a in enumerate(alpha):
        if kind == "SELEX":
            own = f"({a} / (1 + {a}))" if setting["bindingSaturation"] else a
        elif kind == "RhoGamma":
            own = f"(pow({a}, {float(setting['rho'][r])}) * pow(1 + {a}, {float(setting['gamma'][r])}))"
        elif kind == "Exponential":
            own = f"exp({a})"
        else:
            first = 1 / (1 + math.exp(-setting["delta"][r]))
            own = f"({first!r} * exp(-{a}) + {1 - first!r} * (1 - exp(-{a})))"
        factor.append(f"({own} * {factor[-1]})" if setting["cumulativeEnrichment"] and factor else own)
    weight = [f"({math.exp(h)!r} * {f})" for h, f in zip([0.0, 0.125, -0.25], factor, strict=True)]
    shares = ", ".join(f"round((c0 + c1 + c2) * {w} / ({' + '.join(weight)}), 6) AS c{i}" for i, w in enumerate(weight))
    return f"WITH {_COUNTS_SQL}, {_windows_sql(model, 0, 'c')}, s AS (SELECT seq, sum(alpha) a FROM w GROUP BY seq) SELECT seq, {shares} FROM c JOIN s USING (seq)"


# -- k-mers


_ONE_COPY = f"p AS (SELECT {PROBE} AS seq, l_quantity, l_extendedprice FROM lineitem)"


def _kmers_sql(k: int, both: bool, value: str) -> str:
    fwd = f"f AS (SELECT substr(seq, i + 1, {k}) kmer, l_quantity, l_extendedprice FROM (SELECT *, unnest(range(length(seq) - {k} + 1)) i FROM p))"
    every = f"g AS (SELECT * FROM f{' UNION ALL SELECT reverse(translate(kmer, ' + chr(39) + 'ACGT' + chr(39) + ', ' + chr(39) + 'TGCA' + chr(39) + ')), l_quantity, l_extendedprice FROM f' if both else ''})"
    letters = "l(c) AS (VALUES ('A'), ('C'), ('G'), ('T'))"
    names = [f"l{i}" for i in range(k)]
    universe = f"u AS (SELECT {' || '.join(f'{n}.c' for n in names)} AS kmer FROM {', '.join(f'l {n}' for n in names)})"
    return f"WITH {_ONE_COPY}, {fwd}, {every}, {letters}, {universe} {value}"


def _positions(weighted: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _probes(spark, d, "CAST(l_quantity AS BIGINT) AS q")
        return kmers.position_letter_count(df, weight="q" if weighted else None).select("position", "letter", F.col("n").cast("bigint").alias("n"))

    return run


def _positions_sql(weighted: bool) -> str:
    value = "sum(CAST(l_quantity AS BIGINT))" if weighted else "count(*)"
    return f"WITH {_ONE_COPY}, e AS (SELECT CAST(i AS INTEGER) AS position, substr(seq, i + 1, 1) letter, l_quantity FROM (SELECT *, unnest(range(length(seq))) i FROM p)) SELECT position, letter, CAST({value} AS BIGINT) AS n FROM e GROUP BY ALL"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _text_letters(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.upper("text").alias("seq"))
    return kmers.kmer_count(docs, 2, True, Alphabet.letters("ABCDE"))


def _join_tables(spark: SparkSession, d: str) -> DataFrame:
    reads = _lineitem(spark, d).selectExpr(f"{ROUND_PROBE} AS seq", "l_returnflag AS round")
    one = [reads.filter(F.col("round") == r).groupBy("seq").agg(F.count("*").alias("n")) for r in ROUNDS]
    return counttable.join_rounds(one)


def _coefficients(spark: SparkSession, model: Model) -> DataFrame:
    """A model's coefficients in long form."""
    letters, rows = model.alphabet.order, []
    for i in range(model.modes):
        m = model.motif(i, bias=False)
        rows += [(i, 0, x, letters[a], "", float(m.mono[x, a])) for x, a in itertools.product(range(m.size), range(len(letters)))]
        for d, t in enumerate(m.di, 1):
            rows += [(i, d, x, letters[a], letters[b], float(t[x, a, b])) for x, a, b in itertools.product(*map(range, t.shape))]
    return spark.createDataFrame(rows, "mode int, d int, x int, l1 string, l2 string, beta double")


def _mono_table(model: Model) -> str:
    m = model.motif(0, bias=False).mono
    return "m(x, l, v) AS (VALUES " + ", ".join(f"({x}, '{'ACGT'[a]}', {float(m[x, a])!r}::DOUBLE)" for x, a in itertools.product(*map(range, m.shape))) + ")"


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    reads = _lineitem(spark, d).selectExpr(f"{ROUND_PROBE} AS seq", "l_returnflag AS round", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS read_id")
    parts = [reads.filter(F.col("round") == r).drop("round") for r in ROUNDS]
    return counttable.build(parts, max_reads=500, seed=7)


def _empirical(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.empirical_activity(_counts(spark, d), MONO_DI)
    return _rounded(out, "forward", "reverse", "largest", "log_strand_ratio", "slope")


QUERIES = {
    "probe_scan": lambda s, d: _probes(s, d),
    "revcomp": lambda s, d: _probes(s, d).select("seq", DNA.revcomp(F.col("seq")).alias("rc")),
    "kmer_count_fwd": lambda s, d: kmers.kmer_count(_probes(s, d), 4, True),
    "kmer_count_both": lambda s, d: kmers.kmer_count(_probes(s, d), 4),
    "kmer_count_weighted": lambda s, d: kmers.kmer_count(_probes(s, d, "CAST(l_quantity AS BIGINT) AS q"), 4, values=["q"]),
    "kmer_average": lambda s, d: _rounded(kmers.kmer_average(_probes(s, d, "l_quantity AS q", "l_extendedprice AS e"), 3, values=["q", "e"]), "q", "e"),
    "kmer_average_pseudo": lambda s, d: _rounded(kmers.kmer_average(_probes(s, d, "l_quantity AS q", "l_extendedprice AS e"), 3, True, 5.0, values=["q", "e"]), "q", "e"),
    "kmer_median": lambda s, d: _rounded(kmers.kmer_median(_probes(s, d, "l_extendedprice AS value"), 3), "median"),
    "kmer_text_alphabet": _text_letters,
    "kmer_unknown_letters": lambda s, d: kmers.kmer_count(s.read.parquet(f"{d}/part.parquet").selectExpr(f"{WILD_PROBE} AS seq"), 3, True),
    "position_base_count": _positions(False),
    "position_base_count_weighted": _positions(True),
    "guess_alphabet": lambda s, d: distinct_letters(s.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("seq"))),
    "count_table": _counts,
    "count_table_join": _join_tables,
    "count_table_totals": lambda s, d: counttable.totals(_counts(s, d)),
    "modeled_columns": lambda s, d: counttable.modeled_columns(_counts(s, d), [2, 0]),
    "transliterate": lambda s, d: counttable.transliterate(_counts(s, d), {"in": ["AC+", "G.T"], "out": ["X", "TT"]}),
    "score_sum": _score_query(MONO_DI),
    "score_max": _score_query(MONO_DI, "max"),
    "score_mean": _score_query(MONO_DI, "mean"),
    "score_profile": _profile,
    "score_singlestrand": _score_query(SINGLE),
    "score_flanks": _score_query(FLANKED, left_flank="GATTA", right_flank="CAGT"),
    "score_modified": _score_query(MODIFIED, modifications=("methyl",)),
    "score_position_bias": _affinity_query(BIASED),
    "affinity_sum": _affinity_query(SEVERAL),
    "interaction_sum": _interactions,
    "mono_information": lambda s, d: s.createDataFrame([(i, round(x, 6)) for i, x in enumerate(transforms.mono_information(MONO))], "mode int, bits double"),
    "expected_alpha": lambda s, d: s.createDataFrame([(round(transforms.expected_alpha(MONO.motif(0)), 6),)], "alpha double"),
    "mismatch_gauge": lambda s, d: _rounded(_coefficients(s, transforms.set_mismatch_gauge(MONO)).select("x", "l1", "beta"), "beta"),
    "add_n": lambda s, d: _rounded(_coefficients(s, transforms.add_n_scoring(MONO)).filter("l1 = 'N'").select("x", "beta"), "beta"),
    "reservoir_sample": _sampled,
} | {name: _predicted(model) for name, model in ENRICHED.items()}


_KMER_N = "SELECT u.kmer, CAST(count(g.kmer) AS BIGINT) AS n FROM u LEFT JOIN g USING (kmer) GROUP BY 1"
_AVERAGE = (
    ", s AS (SELECT u.kmer, count(g.kmer) n, coalesce(sum(l_quantity), 0) q, coalesce(sum(l_extendedprice), 0) e FROM u LEFT JOIN g USING (kmer) GROUP BY 1), t AS (SELECT sum(n) n, sum(q) q, sum(e) e FROM s)"
    " SELECT kmer, round((s.q + {pc} * (t.q / t.n)) / (s.n + {pc}), 6) AS q, round((s.e + {pc} * (t.e / t.n)) / (s.n + {pc}), 6) AS e FROM s, t"
)
_MONO_TOP = ", t AS (SELECT x, max(v) top FROM m GROUP BY x)"


def _oracle() -> dict[str, str]:
    lower = {
        "probe_scan": f"SELECT {PROBE} AS seq FROM lineitem",
        "revcomp": f"WITH p AS (SELECT {PROBE} AS seq FROM lineitem) SELECT seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM p",
        "kmer_count_fwd": _kmers_sql(4, False, _KMER_N),
        "kmer_count_both": _kmers_sql(4, True, _KMER_N),
        "kmer_count_weighted": _kmers_sql(4, True, "SELECT u.kmer, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS q FROM u LEFT JOIN g USING (kmer) GROUP BY 1"),
        "kmer_average": _kmers_sql(3, True, _AVERAGE.format(pc="0.0")),
        "kmer_average_pseudo": _kmers_sql(3, False, _AVERAGE.format(pc="5.0")),
        "kmer_median": _kmers_sql(3, True, "SELECT u.kmer, round(median(l_extendedprice), 6) AS median FROM u LEFT JOIN g USING (kmer) GROUP BY 1"),
        "kmer_text_alphabet": "WITH d AS (SELECT upper(text) t FROM documents), f AS (SELECT substr(t, i + 1, 2) kmer FROM (SELECT t, unnest(range(length(t) - 1)) i FROM d)), l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), u AS (SELECT a.c || b.c kmer FROM l a, l b) SELECT u.kmer, CAST(count(f.kmer) AS BIGINT) AS n FROM u LEFT JOIN f USING (kmer) GROUP BY 1",
        "kmer_unknown_letters": f"WITH p AS (SELECT {WILD_PROBE} AS seq FROM part), f AS (SELECT substr(seq, i + 1, 3) kmer FROM (SELECT seq, unnest(range(length(seq) - 2)) i FROM p)), l(c) AS (VALUES ('A'), ('C'), ('G'), ('T')), u AS (SELECT a.c || b.c || e.c kmer FROM l a, l b, l e) SELECT u.kmer, CAST(count(f.kmer) AS BIGINT) AS n FROM u LEFT JOIN f USING (kmer) GROUP BY 1",
        "position_base_count": _positions_sql(False),
        "position_base_count_weighted": _positions_sql(True),
        "guess_alphabet": "SELECT DISTINCT unnest(string_split(p_type, '')) AS letter FROM part",
        "count_table": f"WITH {_COUNTS_SQL} SELECT * FROM c",
        "count_table_join": f"WITH {_COUNTS_SQL} SELECT * FROM c",
        "count_table_totals": f"WITH {_COUNTS_SQL} SELECT CAST(sum(c0) AS BIGINT) AS c0, CAST(sum(c1) AS BIGINT) AS c1, CAST(sum(c2) AS BIGINT) AS c2 FROM c",
        "modeled_columns": f"WITH {_COUNTS_SQL} SELECT seq, c2 AS c0, c0 AS c1 FROM c",
        "transliterate": f"WITH {_COUNTS_SQL} SELECT regexp_replace(regexp_replace(seq, 'AC+', 'X', 'g'), 'G.T', 'TT', 'g') AS seq, c0, c1, c2, seq AS original FROM c",
        "score_sum": _score_sql(MONO_DI),
        "score_max": _score_sql(MONO_DI, "max"),
        "score_mean": _score_sql(MONO_DI, "mean"),
        "score_profile": _profile_sql(),
        "score_singlestrand": _score_sql(SINGLE),
        "score_flanks": _score_sql(FLANKED, left="GATTA", right="CAGT"),
        "score_modified": _score_sql(_effective(MODIFIED)),
        "score_position_bias": _biased_sql(),
        "affinity_sum": _affinity_sql(SEVERAL),
        "interaction_sum": _interactions_sql(),
        "mono_information": f"WITH {_mono_table(MONO)}, z AS (SELECT x, sum(exp(v)) z FROM m GROUP BY x) SELECT CAST(0 AS INTEGER) AS mode, round(sum(exp(v) / z * log2(exp(v) / z)) + 2 * count(DISTINCT x), 6) AS bits FROM m JOIN z USING (x)",
        "expected_alpha": f"WITH {_mono_table(MONO)}, z AS (SELECT x, avg(exp(v)) z FROM m GROUP BY x) SELECT round(product(z), 6) AS alpha FROM z",
        "mismatch_gauge": f"WITH {_mono_table(MONO)}{_MONO_TOP} SELECT CAST(x AS INTEGER) AS x, l AS l1, round(v - top, 6) AS beta FROM m JOIN t USING (x)",
        "add_n": f"WITH {_mono_table(MONO)}{_MONO_TOP} SELECT CAST(x AS INTEGER) AS x, round(ln(avg(exp(v - top))) + (SELECT sum(top) FROM t) / 5, 6) AS beta FROM m JOIN t USING (x) GROUP BY x",
    }
    return lower | {name: _predicted_sql(model) for name, model in ENRICHED.items()}


def _effective(model: Model) -> Model:
    """The model with its modifications applied for good."""
    tree = model.tree
    names = tuple(c["name"] for c in model.settings["bindingModes"][0]["modifications"])
    tree["coefficients"]["bindingModes"][0]["mononucleotide"] = model.motif(0, modifications=names).mono.ravel().tolist()
    return Model(tree)


SQL = _oracle()
