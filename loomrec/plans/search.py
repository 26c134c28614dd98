"""Validation and hyper-parameter search."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from dataclasses import replace as replaced

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.operators.metrics import mean_ap_at_k
from loomrec.operators.splits import random_holdout
from loomrec.scratch import stow
from loomrec.sources.triplets import Interactions


@dataclass
class SearchResult:
    params: dict
    score: float
    trials: list[tuple[dict, float]]


def as_score(value) -> float:
    """A metric's value: a number as it is, a per-user table by its mean (NaN if it is empty)."""
    if isinstance(value, DataFrame):
        mean = value.agg(F.avg("value")).first()[0]
        return float("nan") if mean is None else float(mean)
    return float(value)


def _scored(model_fn: Callable, matrix: Interactions, train: DataFrame, test: DataFrame, k: int, metric: Callable) -> float:
    part = replaced(matrix, x=train)
    model = model_fn().fit(part)
    return as_score(metric(model.recommend(part, k), test, matrix.users, k))


def cross_validate(model_fn: Callable, matrix: Interactions, *, n_folds: int = 5, k: int = 10, metric: Callable = mean_ap_at_k, seed: int = 0) -> dict:
    """``mean, std, scores`` of ``n_folds`` independent random hold-outs of a share 1 / n_folds each (they may overlap)."""
    if n_folds < 2:
        raise ValueError("n_folds must be at least 2")
    scores = []
    for fold in range(n_folds):
        train, test = (stow(x) for x in random_holdout(matrix.x, 1 / n_folds, seed + fold))
        scores.append(_scored(model_fn, matrix, train, test, k, metric))
    return {"mean": float(np.mean(scores)), "std": float(np.std(scores, ddof=1)), "scores": scores}


def _search(model_fn: Callable, matrix: Interactions, candidates: list[dict], test_fraction: float, k: int, metric: Callable, seed: int, threads: int) -> SearchResult:
    train, test = (stow(x) for x in random_holdout(matrix.x, test_fraction, seed))

    def trial(params: dict) -> float:
        try:
            score = _scored(lambda: model_fn(**params), matrix, train, test, k, metric)
            return -math.inf if math.isnan(score) else score
        except Exception:
            return -math.inf

    with ThreadPoolExecutor(threads) as pool:
        scores = list(pool.map(trial, candidates))
    best = max(range(len(scores)), key=lambda n: (scores[n], -n))
    return SearchResult(candidates[best], scores[best], list(zip(candidates, scores)))


def grid_search(model_fn: Callable, matrix: Interactions, grid: dict[str, list], *, test_fraction: float = 0.2, k: int = 10, metric: Callable = mean_ap_at_k, seed: int = 0, threads: int = 2) -> SearchResult:
    """All combinations of ``grid`` on one hold-out; a failed fit scores minus infinity, the first of equal scores wins."""
    names = list(grid)
    candidates = [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]
    return _search(model_fn, matrix, candidates, test_fraction, k, metric, seed, threads)


def random_search(model_fn: Callable, matrix: Interactions, samplers: dict[str, Callable], *, n_trials: int = 20, test_fraction: float = 0.2, k: int = 10, metric: Callable = mean_ap_at_k, seed: int = 0, threads: int = 2) -> SearchResult:
    """``n_trials`` draws of the samplers (each takes a numpy generator), judged as in :func:`grid_search`."""
    rng = np.random.default_rng(seed)
    candidates = [{n: f(rng) for n, f in samplers.items()} for _ in range(n_trials)]
    return _search(model_fn, matrix, candidates, test_fraction, k, metric, seed, threads)
