"""Scoring sequences with models. The window kernel runs on Arrow batches; everything else is column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.functions import kernel
from strandspark.functions.kernel import by_length
from strandspark.operators.counttable import modeled_columns, round_columns
from strandspark.operators.enrichment import round_shares
from strandspark.plans.model import Model, ModelError


def _flanks(model: Model, i: int, left: str, right: str) -> tuple[str, str]:
    """The parts of the constant flanks that a mode reads."""
    n = model.settings["bindingModes"][i]["flankLength"]
    if n and (len(left) < n or len(right) < n):
        raise ModelError(f"binding mode {i} reads {n} flanking letters; give left_flank and right_flank")
    return (left[len(left) - n :], right[:n]) if n else ("", "")


def strand_scores(model: Model, i: int, seqs: list[str], left: str = "", right: str = "", modifications: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A mode's window scores of equal-length sequences on both strands."""
    a, b = _flanks(model, i, left, right)
    codes = model.alphabet.encode([a + s + b for s in seqs])
    return kernel.both_strands(codes, model.motif(i, modifications=modifications), model.alphabet.permutation())


def _scored(seq: Column, each, kind: str) -> Column:
    """each: equal-length sequences -> one value (an array, for array types) per sequence."""

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            seqs, out = batch.tolist(), [None] * len(batch)
            known = [i for i, s in enumerate(seqs) if s is not None]
            for _, index in by_length([seqs[i] for i in known]):
                for i, v in zip(index, each([seqs[known[j]] for j in index]), strict=True):
                    out[known[i]] = v
            yield pd.Series(out, dtype=object if kind.startswith(("array", "struct")) else float)

    return apply(seq)


def binding_mode_scores(df: DataFrame, model: Model, how: str = "sum", modifications: tuple[str, ...] = (), seq: str = "seq", left_flank: str = "", right_flank: str = "") -> DataFrame:
    """df with one column per mode of size over 0: score_i, or with how='profile' the arrays forward_i and reverse_i,
    both along the forward strand. Modes are scored in one pass over the sequences."""
    modes = [i for i in range(model.modes) if model.settings["bindingModes"][i]["size"] > 0]

    def each(seqs: list[str]) -> list:
        columns = []
        for i in modes:
            fwd, rev = strand_scores(model, i, seqs, left_flank, right_flank, modifications)
            if how == "profile":
                columns += [fwd, rev[:, ::-1]]
            else:
                columns.append(kernel.reduce_windows(fwd, rev, how, model.settings["bindingModes"][i]["singleStrand"]))
        return [[c[j].tolist() if how == "profile" else float(c[j]) for c in columns] for j in range(len(seqs))]

    kind = "array<array<double>>" if how == "profile" else "array<double>"
    scored = df.withColumn("__scores", _scored(F.col(seq), each, kind))
    names = [f"{s}_{i}" for i in modes for s in (("forward", "reverse") if how == "profile" else ("score",))]
    return scored.select("*", *(F.col("__scores")[j].alias(n) for j, n in enumerate(names))).drop("__scores")


def profile_rows(df: DataFrame, model: Model, seq: str = "seq", **more) -> DataFrame:
    """Profiles in long form: seq, mode, strand (0, 1), x and alpha."""
    wide = binding_mode_scores(df.select(seq), model, "profile", seq=seq, **more)
    parts = [F.struct(F.lit(int(c.split("_")[1])).alias("mode"), F.lit(int(c[0] == "r")).alias("strand"), F.col(c).alias("a")) for c in wide.columns if c != seq]
    long = wide.select(seq, F.explode(F.array(*parts)).alias("p"))
    return long.select(seq, "p.mode", "p.strand", F.posexplode("p.a").alias("x", "alpha"))


def require_consensus(model: Model) -> None:
    """Scoring needs a model of one activity per mode, without position bias, interactions, or tables."""
    values, settings = model.values, model.settings
    for i, own in enumerate(values["bindingModes"]):
        if len(own["activity"]) != 1 or len(own["activity"][0]) != 1:
            raise ModelError(f"binding mode {i} has several activities; build a consensus model first")
        if settings["bindingModes"][i]["positionBias"] or own["positionBias"]:
            raise ModelError(f"binding mode {i} has a position bias; build a consensus model first")
    if any(own["positionMatrix"] for own in values["bindingModeInteractions"]):
        raise ModelError("the model has interactions; build a consensus model first")
    if settings.get("enrichmentModel") or settings.get("countTable"):
        raise ModelError("the model has count tables or enrichment models; build a consensus model first")


def round_alphas(model: Model, seqs: list[str], experiment: int = 0, rounds: int | None = None, left: str = "", right: str = "", interactions: bool = True) -> np.ndarray:
    """Affinity of each sequence in each round: modes and interactions by activity, times the concentration."""
    setting = model.enrichment(experiment)
    changes, modes = tuple(setting["modifications"]), model.chosen(experiment)
    pairs = model.chosen(experiment, "bindingModeInteractions") if interactions else []
    if rounds is None:
        rounds = max([len(model.activity(i, experiment)) for i in modes] or [1])
    total = np.zeros((len(seqs), rounds))
    if not modes and not pairs:
        return np.ones_like(total) * setting["concentration"]
    needed = {b for p in pairs for b in model.settings["bindingModeInteractions"][p]["bindingModes"]}
    strands, motifs = {}, {}
    stretch = lambda a: np.exp(np.resize(a, rounds) if len(a) > 1 else np.full(rounds, a[0]))
    for i in sorted({*modes, *needed}):
        a, b = _flanks(model, i, left, right)
        motif = motifs[i] = model.motif(i, experiment, changes)
        if motif.size:
            codes = model.alphabet.encode([a + s + b for s in seqs])
            strands[i] = kernel.both_strands(codes, motif, model.alphabet.permutation())
        else:
            strands[i] = (np.zeros((len(seqs), 0)),) * 2
        if i in modes:
            total += kernel.mode_alpha(*strands[i], motif)[:, None] * stretch(model.activity(i, experiment))[None, :]
    for p in pairs:
        if model.includes("bindingModeInteractions", p):
            own = model.interaction(p, experiment)
            total += own.alpha(strands, motifs)[:, None] * stretch(np.array(own.activity))[None, :]
    return total * setting["concentration"]


def affinity_sum(df: DataFrame, model: Model, modifications: tuple[str, ...] = (), seq: str = "seq", left_flank: str = "", right_flank: str = "", strict: bool = True, name: str = "affinity_sum") -> DataFrame:
    """df with the sum over modes of affinity times activity. strict: only consensus models. Interactions take no part."""
    if strict:
        require_consensus(model)
    tree = model.tree
    if modifications:
        tree["modelSettings"]["enrichmentModel"] = [{"modifications": list(modifications)}]
        model = Model(tree)
    return df.withColumn(name, _scored(F.col(seq), lambda seqs: round_alphas(model, seqs, 0, 1, left_flank, right_flank, False)[:, 0].tolist(), "double"))


def with_alphas(df: DataFrame, model: Model, experiment: int = 0, rounds: int | None = None, seq: str = "seq", left_flank: str = "", right_flank: str = "", name: str = "alpha") -> DataFrame:
    return df.withColumn(name, _scored(F.col(seq), lambda seqs: round_alphas(model, seqs, experiment, rounds, left_flank, right_flank).tolist(), "array<double>"))


def predict_count_table(table: DataFrame, model: Model, experiment: int = 0, seq: str = "seq") -> DataFrame:
    """A count table's expected counts: each probe's total over the modelled rounds, dealt by the model's shares."""
    tables = model.settings.get("countTable", [])
    own = tables[experiment] if experiment < len(tables) else {}
    if own.get("modeledColumns", [-1]) != [-1]:
        table = modeled_columns(table, own["modeledColumns"], seq)
    names = round_columns(table)
    setting = model.enrichment(experiment)
    h = model.values.get("countTable", [])
    changes = own.get("transliterate", {"in": [], "out": []})
    read = seq
    if changes["in"]:
        from strandspark.operators.counttable import transliterate

        table, read = transliterate(table, changes, seq, "__original"), seq
    scored = with_alphas(table, model, experiment, len(names), read, own.get("leftFlank", ""), own.get("rightFlank", ""), "__alpha")
    shares = round_shares(F.col("__alpha"), len(names), setting["modelType"], setting["cumulativeEnrichment"], setting["bindingSaturation"], h[experiment]["h"] if experiment < len(h) else None, setting.get("rho"), setting.get("gamma"), setting.get("delta"))
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    first = F.col("__original" if changes["in"] else seq).alias(seq)
    return scored.select(first, *((total * s).alias(c) for c, s in zip(names, shares, strict=True)))


def empirical_activity(table: DataFrame, model: Model, i: int = 0, seq: str = "seq", left_flank: str = "", right_flank: str = "") -> DataFrame:
    """Count-weighted affinity of a mode on each strand by round, its largest window, and the slope of the logarithm over rounds."""
    names = round_columns(table)

    def each(seqs: list[str]) -> list:
        fwd, rev = strand_scores(model, i, seqs, left_flank, right_flank)
        both = np.maximum(fwd.max(1, initial=0), rev.max(1, initial=0))
        return np.stack([fwd.sum(1), rev.sum(1), both], 1).tolist()

    scored = table.withColumn("__s", _scored(F.col(seq), each, "array<double>"))
    aggs = [f for r, c in enumerate(names) for f in (F.sum(F.col(c) * F.col("__s")[0]).alias(f"f{r}"), F.sum(F.col(c) * F.col("__s")[1]).alias(f"r{r}"), F.sum(c).alias(f"n{r}"))]
    one = scored.agg(*aggs, F.max(F.col("__s")[2]).alias("largest"))
    rows = one.select("largest", F.explode(F.array(*(F.struct(F.lit(r).alias("round"), (F.col(f"f{r}") / F.col(f"n{r}")).alias("forward"), (F.col(f"r{r}") / F.col(f"n{r}")).alias("reverse")) for r in range(len(names))))).alias("x"))
    out = rows.select("x.round", "x.forward", "x.reverse", "largest", F.log(F.col("x.forward") / F.col("x.reverse")).alias("log_strand_ratio"))
    slope = out.agg(F.regr_slope(F.log(F.col("forward") + F.col("reverse")), F.col("round").cast("double")).alias("slope"))
    return out.crossJoin(F.broadcast(slope))  # one row
