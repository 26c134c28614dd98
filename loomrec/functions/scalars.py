"""Scalar column expressions: stable sigmoid, links, soft threshold, vector products.  All stay inside the JVM."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Link(str, Enum):
    """Link families of the regression models."""

    BINOMIAL = "binomial"
    GAUSSIAN = "gaussian"
    POISSON = "poisson"


def sigmoid(x: Column) -> Column:
    """``1 / (1 + exp(-x))`` without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log1pexp(x: Column) -> Column:
    """``ln(1 + exp(x))``; beyond 33.3 it is x itself in double precision, below -33.3 it is exp(x)."""
    return F.when(x > 33.3, x).when(x < -33.3, F.exp(x)).otherwise(F.log1p(F.exp(x)))


def safe_inverse(x: Column, guard: float = 1e-12) -> Column:
    return 1 / (x + F.lit(guard))


def link(x: Column, family: Link | str) -> Column:
    """Mean of a linear predictor: sigmoid, identity or exp."""
    family = Link(family)
    return sigmoid(x) if family is Link.BINOMIAL else F.exp(x) if family is Link.POISSON else x


def soft_threshold(x: Column, amount: Column | float) -> Column:
    """``sign(x) * max(|x| - amount, 0)``."""
    amount = F.lit(amount) if isinstance(amount, int | float) else amount
    return F.signum(x) * F.greatest(F.abs(x) - amount, F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def is_finite(x: Column) -> Column:
    """True for neither null nor NaN nor infinite values."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
