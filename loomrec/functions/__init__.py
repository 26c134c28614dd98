"""Column expressions shared by all operators."""

from loomrec.functions.scalars import Link, dot, is_finite, link, log1pexp, norm, safe_inverse, sigmoid, soft_threshold

__all__ = ["Link", "dot", "is_finite", "link", "log1pexp", "norm", "safe_inverse", "sigmoid", "soft_threshold"]
