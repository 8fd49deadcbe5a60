"""Search for a model's parameters: a Parzen estimator over what trials have shown, trials side by side, scores over expanding folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """Values from low to high; log: their logarithms are alike; whole: integers, both ends included."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, x: float) -> float:
        """A value's place between 0 and 1."""
        a, b = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        x = math.log(x) if self.log else x
        return (x - a) / (b - a) if b > a else 0.5

    def outer(self, u: float) -> float:
        u = min(1.0, max(0.0, u))
        a, b = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        x = a + u * (b - a)
        x = math.exp(x) if self.log else x
        x = min(self.high, max(self.low, x))
        return int(round(x)) if self.whole else x


#: What is searched for boosted trees.
SPACE: Mapping[str, Range] = {
    "maxDepth": Range(2, 6, whole=True), "maxIter": Range(5, 30, whole=True), "stepSize": Range(0.05, 0.4, log=True),
    "subsamplingRate": Range(0.6, 1.0), "minInstancesPerNode": Range(1, 30, log=True, whole=True), "minInfoGain": Range(1e-6, 1e-2, log=True),
}


class Parzen:
    """Proposes values that good trials have made likely and bad ones haven't (Bergstra and others, 2011)."""

    def __init__(self, space: Mapping[str, Range], seed: int = 7, first: int = 3, share: float = 0.25, drawn: int = 24):
        self.space, self.first, self.share, self.drawn = space, first, share, drawn
        self.rng = np.random.default_rng(seed)
        self.seen: list[tuple[float, dict[str, float]]] = []

    def tell(self, values: Mapping[str, Any], score: float) -> None:
        self.seen.append((score, {k: r.inner(values[k]) for k, r in self.space.items()}))

    def ask(self) -> dict[str, Any]:
        """Values of the next trial: drawn evenly for the first ones."""
        known = sorted((s for s in self.seen if math.isfinite(s[0])), key=lambda s: s[0])
        if len(known) < self.first:
            return {k: r.outer(float(self.rng.random())) for k, r in self.space.items()}
        n = max(1, math.ceil(self.share * len(known)))
        good, bad = known[:n], known[n:]
        return {k: r.outer(self._best([v[k] for _, v in good], [v[k] for _, v in bad])) for k, r in self.space.items()}

    def _best(self, good: Sequence[float], bad: Sequence[float]) -> float:
        width = lambda xs: max(0.1, 1 / (1 + len(xs)))
        at = self.rng.integers(0, len(good) + 1, self.drawn)
        even = self.rng.random(self.drawn)
        near = self.rng.normal(0, width(good), self.drawn)
        drawn = np.where(at == len(good), even, np.append(good, 0.5)[at] + near)
        drawn = np.clip(drawn, 0, 1)

        def density(xs):
            if not len(xs):
                return np.ones(self.drawn)
            w = width(xs)
            bumps = np.exp(-((drawn[:, None] - np.array(xs)) ** 2) / (2 * w * w)) / (w * math.sqrt(2 * math.pi))
            return (bumps.sum(1) + 1) / (len(xs) + 1)

        return float(drawn[np.argmax(np.log(density(good)) - np.log(density(bad)))])


def search(objective: Callable[[Mapping[str, Any]], float], space: Mapping[str, Range] = SPACE, trials: int = 5, at_once: int = 1, seed: int = 7, first: int = 3) -> list[tuple[dict[str, Any], float]]:
    """Trials and their scores (less is better), in order; at_once of them run side by side, told before the next are asked for.

    The same seed and at_once give the same trials if the objective is
    deterministic. A trial that fails raises.
    """
    parzen, done = Parzen(space, seed, first), []
    with ThreadPool(at_once) as pool:
        while len(done) < trials:
            asked = [parzen.ask() for _ in range(min(at_once, trials - len(done)))]
            for values, score in zip(asked, pool.map(objective, asked), strict=True):
                parzen.tell(values, score)
                done.append((values, score))
    return done


def fold_error(rows: DataFrame, values: Mapping[str, Any], k: int, actual: str = "sold_price", fold: str = "fold", vector: str = "_x") -> float:
    """Mean over folds 1 to k of the mean absolute error, in the price's own unit, of trees fitted on the folds before; folds side by side."""

    def one(i: int) -> float:
        train = rows.where((F.col(fold) < i) & (F.col(actual) > 0)).select(vector, F.log1p(actual).alias("_y"))
        model = GBTRegressor(featuresCol=vector, labelCol="_y", predictionCol="_log", maxBins=64, seed=7, **values).fit(train)
        got = model.transform(rows.where(F.col(fold) == i)).agg(F.avg(F.abs(F.expm1("_log") - F.col(actual)))).first()[0]
        return math.inf if got is None else float(got)

    with ThreadPool(k) as pool:
        return float(np.mean(pool.map(inheritable_thread_target(rows.sparkSession)(one), range(1, k + 1))))


def tune(rows: DataFrame, k: int = 3, space: Mapping[str, Range] = SPACE, trials: int = 5, at_once: int = 2, seed: int = 7) -> tuple[dict[str, Any], float]:
    """The best values of some trials over a written table with a vector and folds, and their error."""
    return min(search(lambda values: fold_error(rows, values, k), space, trials, at_once, seed), key=lambda t: t[1])
