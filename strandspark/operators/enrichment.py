"""Enrichment models: from a probe's affinities in each round to its expected shares, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("SELEX", "RhoGamma", "Exponential", "ExponentialKinetics")


def _value(values, i: int, default: float) -> Column:
    return F.lit(float(values[i])) if values is not None and i < len(values) else F.lit(default)


def enrichment_factor(kind: str, alpha: Column, i: int, rounds: int, saturated: bool = False, rho=None, gamma=None, delta=None) -> Column:
    """What round i multiplies a probe's abundance by."""
    if kind == "SELEX":
        return alpha / (1 + alpha) if saturated else alpha
    if kind == "RhoGamma":
        return F.pow(alpha, _value(rho, i, float(i))) * F.pow(1 + alpha, _value(gamma, i, 0.0))
    if kind == "Exponential":
        return F.exp(alpha)
    if kind == "ExponentialKinetics":
        first = 1 / (1 + F.exp(-_value(delta, i, 0.0)))
        return first * F.exp(-alpha) + (1 - first) * (1 - F.exp(-alpha))
    raise ValueError(f"unknown enrichment model {kind!r}")


def round_shares(alpha: Column, rounds: int, kind: str = "SELEX", cumulative: bool = True, saturated: bool = False, h=None, rho=None, gamma=None, delta=None, modeled: list[int] | None = None) -> list[Column]:
    """Expected share of each round in a probe's reads; 0 for rounds that aren't modelled.
    alpha: array of a probe's affinities by round."""
    modeled = list(range(rounds)) if modeled in (None, [-1]) else modeled
    factor: list[Column] = []
    for i in range(rounds):
        own = enrichment_factor(kind, alpha[i], i, rounds, saturated, rho, gamma, delta)
        factor.append(own * factor[-1] if cumulative and factor else own)
    weight = [F.exp(_value(h, i, 0.0)) * factor[i] for i in range(rounds)]
    total = sum((weight[i] for i in modeled[1:]), weight[modeled[0]])
    return [weight[i] / total if i in modeled else F.lit(0.0) for i in range(rounds)]
