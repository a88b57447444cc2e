"""Command pipelines: the same steps as fluent calls or as one command string.

A pipeline is an immutable state of input, model and alphabet; commands that name an output write it (or, without a
path, return a DataFrame). Nothing runs before a sink."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions.alphabet import DNA, Alphabet, guess_alphabet
from strandspark.operators import kmers, scoring
from strandspark.plans import transforms
from strandspark.plans.model import Model
from strandspark.sources import readers, writers


def parse_commands(text: str) -> list[tuple[str, list[str]]]:
    """"a(1,'x y').b()" as names with arguments: quotes keep blanks, commas and parentheses; other blanks go."""
    out: list[tuple[str, list[str]]] = []
    i, n = 0, len(text)
    while i < n:
        while i < n and (text[i].isspace() or text[i] == "."):
            i += 1
        if i == n:
            break
        j = text.find("(", i)
        if j < 0:
            raise ValueError(f"'(' is missing after {text[i:]!r}")
        name, args, now, quote, any_ = text[i:j].strip(), [], "", "", False
        i = j + 1
        while True:
            if i == n:
                raise ValueError(f"')' is missing after {name}")
            c = text[i]
            i += 1
            if quote:
                if c == quote:
                    quote = ""
                else:
                    now += c
            elif c in "'\"":
                quote, any_ = c, True
            elif c in ",)":
                if now or any_ or c == ",":
                    args.append(now)
                now, any_ = "", False
                if c == ")":
                    break
            elif not c.isspace():
                now += c
        if not name.isidentifier():
            raise ValueError(f"bad command name {name!r}")
        out.append((name, args))
    return out


def _flag(x: Any) -> bool:
    return x if isinstance(x, bool) else str(x).lower() in ("true", "1", "yes")


def _names(x: Any) -> tuple[str, ...]:
    return tuple(y for y in (x.split(",") if isinstance(x, str) else x or ()) if y)


@dataclass(frozen=True)
class Pipeline:
    spark: SparkSession
    data: DataFrame | None = None
    values: int = 0
    model: Model | None = None
    alphabet: Alphabet = DNA
    normalize_u: bool = False
    results: tuple[DataFrame, ...] = ()

    # -- inputs

    def _with_data(self, df: DataFrame, values: int = 0) -> Pipeline:
        return replace(self, data=readers.normalised(df, self.alphabet, self.normalize_u), values=values)

    def inputTXT(self, path: str) -> Pipeline:  # noqa: N802
        return self._with_data(readers.text_sequences(self.spark, path))

    def inputTableTSV(self, path: str, column: int | str = 0) -> Pipeline:  # noqa: N802
        df = readers.table_sequences(self.spark, path, int(column))
        n = len(self.spark.read.text(path).filter(F.col("value") != "").head().value.split("\t")) - 1
        return self._with_data(readers.value_columns(df, n), n)

    def inputFastq(self, path: str) -> Pipeline:  # noqa: N802
        return self._with_data(readers.fastq_sequences(self.spark, path))

    def inputFasta(self, path: str) -> Pipeline:  # noqa: N802
        return self._with_data(readers.fasta_sequences(self.spark, path))

    def from_frame(self, df: DataFrame, values: int = 0) -> Pipeline:
        return self._with_data(df, values)

    # -- alphabets

    def setAlphabet(self, order: str, complement: str | None = None) -> Pipeline:  # noqa: N802
        return replace(self, alphabet=Alphabet.letters(order, complement or None))

    def guessAlphabet(self) -> Pipeline:  # noqa: N802
        return replace(self, alphabet=guess_alphabet(self._data()))

    # -- models

    def _use(self, model: Model) -> Pipeline:
        return replace(self, model=model, alphabet=model.alphabet)

    def loadScoringModel(self, path: str) -> Pipeline:  # noqa: N802
        return self._use(Model.load(path))

    def loadFitLine(self, path: str, line: int | str = -1) -> Pipeline:  # noqa: N802
        return self._use(Model.load_fit(self.spark, path, int(line)))

    def loadMotifCentralModel(self, fit_id: str, folder: str = "models") -> Pipeline:  # noqa: N802
        return self._use(Model.from_registry(fit_id, folder=folder))

    def writeModel(self, path: str) -> Pipeline:  # noqa: N802
        self._model().save(path)
        return self

    def setMismatchGauge(self) -> Pipeline:  # noqa: N802
        return self._use(transforms.set_mismatch_gauge(self._model()))

    def addNScoring(self) -> Pipeline:  # noqa: N802
        return self._use(transforms.add_n_scoring(self._model()))

    def buildConsensusModel(self) -> Pipeline:  # noqa: N802
        return self._use(transforms.build_consensus(self._model()))

    def removeBindingMode(self, i: int | str) -> Pipeline:  # noqa: N802
        return self._use(transforms.remove_binding_mode(self._model(), int(i)))

    def selectBindingMode(self, i: int | str) -> Pipeline:  # noqa: N802
        return self._use(transforms.select_binding_mode(self._model(), int(i)))

    def selectAndCleanBindingMode(self, i: int | str) -> Pipeline:  # noqa: N802
        return self._use(transforms.select_and_clean(self._model(), int(i)))

    def removeInteraction(self, i: int | str) -> Pipeline:  # noqa: N802
        return self._use(transforms.remove_interaction(self._model(), int(i)))

    def computeMonoInformation(self) -> Pipeline:  # noqa: N802
        bits = transforms.mono_information(self._model())
        for i, x in enumerate(bits):
            print(f"Binding mode {i}: {x:.6f} bits")
        return self._result(self.spark.createDataFrame(list(enumerate(bits)), "mode int, bits double"))

    # -- outputs: without a path, the result is kept in `results`

    def _result(self, df: DataFrame) -> Pipeline:
        return replace(self, results=(*self.results, df))

    def _out(self, df: DataFrame, path: str | None, write) -> Pipeline:
        if path:
            write(df, path)
            return self
        return self._result(df)

    def affinitySum(self, path: str | None = None, modifications: Any = "") -> Pipeline:  # noqa: N802
        df = scoring.affinity_sum(self._data().select("seq_id", "seq"), self._model(), _names(modifications))
        return self._out(df, path, lambda d, p: writers.write_scores(d, p, "affinity", "seq_id"))

    def bindingModeScores(self, path: str | None = None, form: str = "sum", modifications: Any = "") -> Pipeline:  # noqa: N802
        scoring.require_consensus(self._model())
        df = scoring.binding_mode_scores(self._data().select("seq_id", "seq"), self._model(), form or "sum", _names(modifications))
        return self._out(df, path, lambda d, p: writers.write_scores(d, p, "modes", "seq_id"))

    def predictCountTable(self, path: str | None = None, table: str | None = None, experiment: int | str = 0) -> Pipeline:  # noqa: N802
        model, e = self._model(), int(experiment)
        setting = model.settings.get("countTable", [])
        own = setting[e] if e < len(setting) else {}
        counts = readers.read_counts(self.spark, table or own["countTableFile"], own.get("inputFileType", "tsv"), own.get("nColumns"), own.get("leftFlank", ""), own.get("rightFlank", ""))
        df = scoring.predict_count_table(counts, model, e)
        return self._out(df, path, lambda d, p: writers.write_scores(d, p, "counts"))

    def kMerCount(self, path: str | None = None, k: int | str = 8, forward_only: Any = False) -> Pipeline:  # noqa: N802
        df = kmers.kmer_count(self._data(), int(k), _flag(forward_only), self.alphabet, values=self._values())
        return self._out(df, path, writers.write_kmers)

    def kMerAverage(self, path: str | None = None, k: int | str = 8, forward_only: Any = False, pseudocount: float | str = 0) -> Pipeline:  # noqa: N802
        df = kmers.kmer_average(self._data(), int(k), _flag(forward_only), float(pseudocount), self.alphabet, values=self._values())
        return self._out(df, path, writers.write_kmers)

    def kMerMedian(self, path: str | None = None, k: int | str = 8) -> Pipeline:  # noqa: N802
        df = kmers.kmer_median(self._data(), int(k), self.alphabet, value=self._values()[0])
        return self._out(df.withColumn("median", F.coalesce(F.col("median").cast("string"), F.lit("NA"))) if path else df, path, writers.write_kmers)

    def positionBaseCount(self, path: str | None = None) -> Pipeline:  # noqa: N802
        weights = self._values() or [None]
        df = kmers.position_letter_count(self._data(), self.alphabet, weight=weights[0])
        return self._out(df, path, lambda d, p: writers.write_table(d.orderBy("position", "letter"), p))

    # -- helpers

    def _data(self) -> DataFrame:
        if self.data is None:
            raise ValueError("no input yet: call inputTXT, inputTableTSV, inputFastq or inputFasta first")
        return self.data

    def _model(self) -> Model:
        if self.model is None:
            raise ValueError("no model yet: call loadScoringModel, loadFitLine or loadMotifCentralModel first")
        return self.model

    def _values(self) -> list[str]:
        return [f"v{i}" for i in range(self.values)]

    def run(self, commands: str) -> Pipeline:
        """The commands of a command string, one after another."""
        now = self
        for name, args in parse_commands(commands):
            if name not in COMMANDS:
                raise ValueError(f"Invalid function: {name}")
            now = getattr(now, name)(*args)
        return now


COMMANDS = (
    "inputTableTSV inputFastq inputTXT inputFasta loadScoringModel loadFitLine loadMotifCentralModel writeModel setMismatchGauge buildConsensusModel addNScoring setAlphabet"
    " guessAlphabet removeBindingMode selectBindingMode removeInteraction selectAndCleanBindingMode computeMonoInformation affinitySum bindingModeScores kMerCount kMerAverage kMerMedian"
    " predictCountTable positionBaseCount"
).split()


def main(args: list[str] | None = None) -> None:
    """python -m strandspark.plans.pipeline -c 'commands'"""
    args = sys.argv[1:] if args is None else args
    if len(args) != 2 or args[0] != "-c":
        sys.exit(f"{main.__doc__}\ncommands: {', '.join(COMMANDS)}")
    done = Pipeline(SparkSession.builder.getOrCreate()).run(args[1])
    for df in done.results:
        writers.print_rows(df)


def describe_state(p: Pipeline) -> str:
    return json.dumps({"values": p.values, "alphabet": p.alphabet.order, "model": p.model is not None, "results": len(p.results)})


if __name__ == "__main__":
    main()
