"""Relevance of images and peers to the scope inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScopeParams:
    tau: float = 0.4
    gamma: float = 2.0
    alpha: float = 2.0
    delta: float = 0.15
    lambda_fwd: float = 0.05
    version: int = 0

    @classmethod
    def from_row(cls, row: dict | None) -> ScopeParams:
        """Stored parameters; one that is missing or zero takes its default."""
        row = row or {}
        base = cls()
        chosen = {name: float(row.get(name) or getattr(base, name)) for name in
                  ("tau", "gamma", "alpha", "delta", "lambda_fwd")}
        return cls(version=int(row.get("version") or 0), **chosen)


def relevance(s: Column, p: ScopeParams) -> Column:
    span = 1.0 - p.tau
    above = F.pow((s - p.tau) / span, F.lit(p.gamma)) if span > 0 else F.lit(1.0)
    return F.when(s > p.tau, above).otherwise(0.0)


def mix(r: Column, j: Column, p: ScopeParams) -> Column:
    below = r + p.alpha + p.delta * j
    return F.when(below > 0, F.try_divide(r, below)).otherwise(0.0)


def forward_score(mixed: Column, events: Column, p: ScopeParams) -> Column:
    return mixed + p.lambda_fwd * F.log1p(F.greatest(events, F.lit(0)).cast("double"))
