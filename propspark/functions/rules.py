"""Compile declarative score rules into ``when`` chains, so that scoring stays inside generated code."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Band:
    """A range of a number and the points it earns. ``None`` leaves an end open."""

    low: float | None
    high: float | None
    points: float
    low_closed: bool = True
    high_closed: bool = False

    def condition(self, value: Column) -> Column:
        parts = []
        if self.low is not None:
            parts.append(value >= self.low if self.low_closed else value > self.low)
        if self.high is not None:
            parts.append(value <= self.high if self.high_closed else value < self.high)
        return reduce(lambda a, b: a & b, parts) if parts else value.isNotNull()


def first_hit(branches: Iterable[tuple[Column, float]], default: float = 0.0) -> Column:
    """Points of the first branch whose condition is true."""
    chain = None
    for cond, points in branches:
        value = F.lit(float(points))
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return F.lit(float(default)) if chain is None else chain.otherwise(F.lit(float(default)))


def band_points(value: Column, bands: Iterable[Band], default: float = 0.0) -> Column:
    return first_hit([(b.condition(value), b.points) for b in bands], default)


def keyword_points(text: Column, points: dict[str, float], default: float = 0.0) -> Column:
    """Points of the first keyword contained in the lower-cased text."""
    low = F.lower(text)
    return first_hit([(low.contains(word.lower()), p) for word, p in points.items()], default)


def bonus(*terms: tuple[Column, float]) -> Column:
    """Sum of the points of every condition that holds."""
    return reduce(lambda a, b: a + b,
                  [F.when(cond, F.lit(float(p))).otherwise(F.lit(0.0)) for cond, p in terms])


def label(value: Column, steps: Iterable[tuple[float, str]], last: str) -> Column:
    """Text label of the first threshold reached, thresholds given in falling order."""
    chain = None
    for threshold, name in steps:
        chain = F.when(value >= threshold, name) if chain is None else chain.when(value >= threshold, name)
    return chain.otherwise(last)
