"""What all models share: parameters, registry, transactional fit, state for saving."""

from __future__ import annotations

import dataclasses
from typing import ClassVar


from loomrec.plans.callbacks import Run

#: Model types by name, for loading.
MODELS: dict[str, type] = {}


class SparseModel:
    """A model is a dataclass of parameters; fitting fills the attributes named in ``STATE``.

    ``fit`` builds everything aside and assigns it at the end, so a failed refit leaves the fitted model as it was.
    """

    STATE: ClassVar[tuple[str, ...]] = ()

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if not cls.__name__.startswith("_"):
            MODELS[cls.__name__] = cls

    @property
    def is_fitted(self) -> bool:
        return getattr(self, "_fitted", False)

    def require_fitted(self) -> None:
        if not self.is_fitted:
            raise RuntimeError(f"{type(self).__name__} is not fitted")

    def fit(self, data, *args, callbacks=None, **kwargs):
        """Fit and return the model.  ``callbacks`` run on the driver after each epoch."""
        tol, min_iter = getattr(self, "tol", -1.0), getattr(self, "min_iter", 1)
        before = {name: self.__dict__[name] for name in (*self.STATE, "_fitted") if name in self.__dict__}
        rates = {k: getattr(self, k) for k in ("lr", "lr_w") if hasattr(self, k)}
        run = Run(self, callbacks, tol, min_iter)
        try:
            state = self._fit(data, *args, run=run, **kwargs)
        except BaseException:
            for name in (*self.STATE, "_fitted"):
                self.__dict__.pop(name, None)
            self.__dict__.update(before)
            raise
        finally:
            for k, v in rates.items():
                setattr(self, k, v)
        self._assign(state)
        run.end()
        return self

    def _assign(self, state: dict) -> None:
        for name, value in state.items():
            setattr(self, name, value)
        self._fitted = True

    def _fit(self, data, *, run: Run) -> dict:
        raise NotImplementedError

    def to_state(self) -> tuple[dict, dict]:
        params = {f.name: getattr(self, f.name) for f in dataclasses.fields(self) if f.init}
        params = {k: v.value if hasattr(v, "value") else v for k, v in params.items()}
        return params, {k: getattr(self, k) for k in self.STATE if self.is_fitted and getattr(self, k, None) is not None}

    @classmethod
    def from_state(cls, params: dict, state: dict, fitted: bool):
        model = cls(**params)
        if fitted:
            model._assign(state)
        return model


class Recommender(SparseModel):
    """Can rank items for users."""


class MatrixFactorization(Recommender):
    """Factor tables ``id, factors`` of users and items."""


class ItemSimilarity(Recommender):
    """Item-item weights ``src, dst, weight``."""


class SparseRegression(SparseModel):
    """Predicts a target from sparse features."""


class ExplicitModel(SparseModel):
    """Predicts ratings; it has no ``recommend``."""


class SoftALS(ExplicitModel):
    """Low-rank completion by alternating SVD steps."""


