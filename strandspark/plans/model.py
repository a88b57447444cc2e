"""Binding models as JSON trees: defaults, validation, loading, saving and numerical views."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandspark.functions.alphabet import Alphabet
from strandspark.functions.kernel import Interaction, Motif

_MODE = {"flankLength": 0, "dinucleotideDistance": 0, "positionBias": False, "singleStrand": False, "fitLogActivity": True, "modifications": []}
_INTERACTION = {"positionBias": False, "maxOverlap": 0, "maxSpacing": -1, "fitLogActivity": True}
_ENRICHMENT = {"modelType": "SELEX", "modifications": [], "bindingModes": [-1], "bindingModeInteractions": [-1], "concentration": 1, "bindingSaturation": False, "cumulativeEnrichment": True}
_COUNTS = {"inputFileType": "tsv", "rightFlank": "", "leftFlank": "", "modeledColumns": [-1], "transliterate": {"in": [], "out": []}}
_MODE_VALUES = {"activity": [[0]], "dinucleotide": [], "positionBias": [], "modifications": []}
_INTERACTION_VALUES = {"activity": [[0]], "positionMatrix": [], "spacingVector": []}
_CHANGE = {"mononucleotide": [], "dinucleotide": []}
TYPES = ("SELEX", "RhoGamma", "Exponential", "ExponentialKinetics")


class ModelError(ValueError):
    pass


def _fill(own: dict, defaults: dict) -> None:
    for key, value in defaults.items():
        own.setdefault(key, copy.deepcopy(value))


class Model:
    """An immutable model; transforms return new ones. tree: the JSON as a dict, defaults filled in."""

    def __init__(self, tree: dict) -> None:
        tree = copy.deepcopy(tree)
        settings = tree.get("modelSettings")
        if not isinstance(settings, dict) or not isinstance(settings.get("bindingModes"), list):
            raise ModelError("modelSettings.bindingModes is missing")
        _fill(settings, {"letterComplement": "C-G,A-T", "bindingModeInteractions": []})
        settings.setdefault("letterOrder", Alphabet.of(settings["letterComplement"]).order)
        for key, defaults in (("bindingModes", _MODE), ("bindingModeInteractions", _INTERACTION), ("enrichmentModel", _ENRICHMENT), ("countTable", _COUNTS)):
            for own in settings.get(key, []):
                _fill(own, defaults)
        for mode in settings["bindingModes"]:
            for change in mode["modifications"]:
                _fill(change, _CHANGE)
        values = tree.get("coefficients")
        if values is not None:
            _fill(values, {"bindingModes": [], "bindingModeInteractions": []})
            for own in values["bindingModes"]:
                _fill(own, _MODE_VALUES)
                for change in own["modifications"]:
                    _fill(change, _CHANGE)
            for own in values["bindingModeInteractions"]:
                _fill(own, _INTERACTION_VALUES)
        self._tree = tree
        self.validate()

    # -- trees

    @property
    def tree(self) -> dict:
        return copy.deepcopy(self._tree)

    @property
    def settings(self) -> dict:
        return self._tree["modelSettings"]

    @property
    def values(self) -> dict:
        if "coefficients" not in self._tree:
            raise ModelError("the model has no coefficients")
        return self._tree["coefficients"]

    @property
    def alphabet(self) -> Alphabet:
        return Alphabet.of(self.settings["letterComplement"], self.settings["letterOrder"])

    @property
    def modes(self) -> int:
        return len(self.settings["bindingModes"])

    def validate(self) -> None:
        """Settings in range and coefficients of the right shapes; raises ModelError."""
        try:
            n = len(self.alphabet.order)
        except ValueError as e:
            raise ModelError(str(e)) from e
        s = self.settings
        for i, mode in enumerate(s["bindingModes"]):
            for key in ("size", "flankLength", "dinucleotideDistance"):
                if not isinstance(mode.get(key), int) or mode[key] < 0:
                    raise ModelError(f"binding mode {i}: {key} must be an integer of 0 or more")
        for i, own in enumerate(s["bindingModeInteractions"]):
            pair = own.get("bindingModes", [])
            if len(pair) != 2 or not all(0 <= b < self.modes for b in pair):
                raise ModelError(f"interaction {i}: bindingModes must name two modes")
            if own["maxOverlap"] < 0 or own["maxSpacing"] < -1:
                raise ModelError(f"interaction {i}: maxOverlap or maxSpacing is out of range")
        for i, own in enumerate(s.get("enrichmentModel", [])):
            if own["modelType"] == "SELEX_NRLB":
                raise NotImplementedError("SELEX_NRLB has no definition")
            if own["modelType"] not in TYPES:
                raise ModelError(f"enrichment model {i}: unknown type {own['modelType']!r}")
            for key, most in (("bindingModes", self.modes), ("bindingModeInteractions", len(s["bindingModeInteractions"]))):
                if own[key] != [-1] and not all(0 <= b < most for b in own[key]):
                    raise ModelError(f"enrichment model {i}: {key} out of range")
        if "coefficients" not in self._tree:
            return
        values = self.values
        if len(values["bindingModes"]) != self.modes:
            raise ModelError(f"{self.modes} binding modes, {len(values['bindingModes'])} sets of coefficients")
        for i, (mode, own) in enumerate(zip(s["bindingModes"], values["bindingModes"], strict=True)):
            k = mode["size"]
            if len(own["mononucleotide"]) != n * k:
                raise ModelError(f"binding mode {i}: {n * k} mononucleotide coefficients expected, {len(own['mononucleotide'])} found")
            for d, x in enumerate(own["dinucleotide"][: max(0, k - 1)], 1):
                if len(x) != n * n * (k - d):
                    raise ModelError(f"binding mode {i}: {n * n * (k - d)} dinucleotide coefficients expected at distance {d}, {len(x)} found")

    # -- files

    @classmethod
    def load(cls, path: str) -> Model:
        return cls(json.loads(Path(path).read_text()))

    @classmethod
    def load_fit(cls, spark: SparkSession, path: str, line: int = -1) -> Model:
        """A line of a fit file of one model per line: by number, or that with the smallest metadata.logLikelihood;
        a later line without one replaces the choice so far."""
        lines = spark.read.text(path, wholetext=False).withColumn("n", F.monotonically_increasing_id()).filter(F.trim("value") != "")
        if line >= 0:
            rows = lines.orderBy("n").offset(line).limit(1).collect()
            if not rows:
                raise ModelError(f"{path} has no line {line}")
            return cls(json.loads(rows[0].value))
        loss = F.get_json_object("value", "$.metadata.logLikelihood").cast("double")
        marked = lines.select("n", "value", loss.alias("loss"))
        last_without = marked.filter("loss is null").agg(F.max("n").alias("n")).first().n
        if last_without is not None:
            marked = marked.filter(F.col("n") > last_without) if marked.filter(F.col("n") > last_without).take(1) else marked.filter(F.col("n") == last_without)
        best = marked.agg(F.min_by("value", F.struct(F.coalesce("loss", F.lit(0.0)), "n")).alias("value")).first().value
        if best is None:
            raise ModelError(f"{path} is empty")
        return cls(json.loads(best))

    @classmethod
    def from_registry(cls, fit_id: int | str, fetch: Callable[[str], str] | None = None, folder: str = "models") -> Model:
        """A model by its id: from `fetch`, which takes the id and returns JSON, or from folder/id.json."""
        text = fetch(str(fit_id)) if fetch else (Path(folder) / f"{fit_id}.json").read_text()
        return cls(json.loads(text))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self._tree) + "\n")

    def describe(self) -> str:
        """Coefficients for reading, one block per mode."""
        out = []
        letters = self.alphabet.order
        for i in range(self.modes):
            m = self.motif(i)
            out.append(f"Binding mode {i}: size {m.size}, activity {self.values['bindingModes'][i]['activity']}")
            out += [f"  {x:3d} " + " ".join(f"{a}={v:+.4f}" for a, v in zip(letters, row, strict=True)) for x, row in enumerate(m.mono)]
            for d, table in enumerate(m.di, 1):
                out += [f"  di {d},{x} " + " ".join(f"{letters[a]}{letters[b]}={table[x, a, b]:+.4f}" for a, b in np.argwhere(table[x])) for x in range(len(table))]
        return "\n".join(out)

    # -- numerical views

    def motif(self, i: int, experiment: int = 0, modifications: tuple[str, ...] = (), bias: bool = True) -> Motif:
        """Effective coefficients of mode i: with the shifts of these modifications, and the experiment's position bias."""
        setting, own, letters = self.settings["bindingModes"][i], self.values["bindingModes"][i], self.alphabet.order
        k, n = setting["size"], len(letters)
        mono = np.array(own["mononucleotide"], float).reshape(k, n)
        reach = min(setting["dinucleotideDistance"], max(0, k - 1), len(own["dinucleotide"]))
        di = [np.array(own["dinucleotide"][d], float).reshape(k - d - 1, n, n) for d in range(reach)]
        for change, shift in zip(setting["modifications"], own["modifications"], strict=False):
            if change["name"] not in modifications:
                continue
            at = [letters.index(x[0]) for x in change["mononucleotide"]]
            if at and shift["mononucleotide"]:
                mono[:, at] += np.array(shift["mononucleotide"], float).reshape(k, len(at))
            for d, (pairs, extra) in enumerate(zip(change["dinucleotide"], shift["dinucleotide"], strict=False)):
                if pairs and d < reach:
                    a, b = zip(*((letters.index(p[0]), letters.index(p[1])) for p in pairs), strict=True)
                    di[d][:, list(a), list(b)] += np.array(extra, float).reshape(k - d - 1, len(pairs))
        weights = None
        if bias and setting["positionBias"] and own["positionBias"]:
            weights = np.array(own["positionBias"][experiment % len(own["positionBias"])], float)
        return Motif(mono, tuple(di), setting["singleStrand"], setting["flankLength"], weights, self.includes("bindingModes", i))

    def includes(self, kind: str, i: int) -> bool:
        """Components that metadata excludes contribute nothing."""
        marks = self._tree.get("metadata", {}).get({"bindingModes": "bindingMode"}.get(kind, kind), [])
        return not (i < len(marks) and isinstance(marks[i], dict) and marks[i].get("includeComponent") is False)

    def activity(self, i: int, experiment: int = 0, kind: str = "bindingModes") -> np.ndarray:
        """Logarithms of a component's activity in each round."""
        rows = self.values[kind][i]["activity"]
        return np.array(rows[experiment if experiment < len(rows) else 0], float)

    def interaction(self, i: int, experiment: int = 0) -> Interaction:
        setting, own = self.settings["bindingModeInteractions"][i], self.values["bindingModeInteractions"][i]
        matrix = np.array(own["positionMatrix"][experiment % len(own["positionMatrix"])], float) if own["positionMatrix"] else None
        return Interaction(tuple(setting["bindingModes"]), setting["maxOverlap"], setting["maxSpacing"], matrix, tuple(self.activity(i, experiment, "bindingModeInteractions")))

    def enrichment(self, experiment: int = 0) -> dict:
        models = self.settings.get("enrichmentModel", [])
        out = copy.deepcopy(models[experiment]) if experiment < len(models) else dict(copy.deepcopy(_ENRICHMENT))
        values = self._tree.get("coefficients", {}).get("enrichmentModel", [])
        return out | {k: v for k, v in (values[experiment] if experiment < len(values) else {}).items() if k in ("rho", "gamma", "delta")}

    def chosen(self, experiment: int = 0, kind: str = "bindingModes") -> list[int]:
        """Indices of the modes (or interactions) that take part in an experiment."""
        named, n = self.enrichment(experiment)[kind], len(self.settings[kind])
        return list(range(n)) if named == [-1] else list(named)
