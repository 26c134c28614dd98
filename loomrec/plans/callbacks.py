"""What runs on the driver between iterations: convergence monitor and callbacks."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger("loomrec")

STOP = "stop"


class ConvergenceMonitor:
    """Relative change of the loss; a negative tolerance switches it off."""

    def __init__(self, tol: float, min_iter: int = 1):
        self.tol, self.min_iter, self.losses = tol, min_iter, []

    def record(self, loss: float) -> bool:
        """Keep ``loss``; true once at least ``min_iter`` are there and it changed by less than the tolerance."""
        before = self.losses[-1] if self.losses else None
        self.losses.append(loss)
        if before is None or self.tol < 0 or len(self.losses) < self.min_iter:
            return False
        return abs(before - loss) / (abs(before) + 1e-12) < self.tol


@dataclass
class CallbackInfo:
    epoch: int
    loss: float | None
    elapsed: float
    model: Any


class Callback:
    """Hooks of a fit; ``on_epoch_end`` may return ``STOP``."""

    def on_train_begin(self, model) -> None:
        """Before the first epoch."""

    def on_epoch_end(self, info: CallbackInfo) -> str | None:
        """After each epoch."""

    def on_train_end(self, model) -> None:
        """After the last epoch, also if a callback stopped the fit."""


@dataclass
class EarlyStopping(Callback):
    """Stop after ``patience`` epochs without a loss below the best one minus ``min_delta``."""

    patience: int = 5
    min_delta: float = 1e-4
    best: float = float("inf")
    waited: int = 0

    def on_train_begin(self, model) -> None:
        self.best, self.waited = float("inf"), 0

    def on_epoch_end(self, info: CallbackInfo) -> str | None:
        if info.loss is not None and info.loss < self.best - self.min_delta:
            self.best, self.waited = info.loss, 0
            return None
        self.waited += 1
        return STOP if self.waited >= self.patience else None


@dataclass
class LossHistory(Callback):
    losses: list = field(default_factory=list)

    def on_train_begin(self, model) -> None:
        self.losses.clear()

    def on_epoch_end(self, info: CallbackInfo) -> None:
        self.losses.append(info.loss)


@dataclass
class Checkpoint(Callback):
    """Save the model to ``path/model_epoch_N`` every so many epochs."""

    path: str
    every: int = 10

    def on_epoch_end(self, info: CallbackInfo) -> None:
        if info.epoch % self.every == 0:
            from loomrec.sources.models import save_model

            save_model(info.model, f"{self.path}/model_epoch_{info.epoch}")


@dataclass
class LearningRate(Callback):
    """Multiply the model's ``lr`` (or ``lr_w``) by ``decay`` after each epoch, down to ``min_lr``."""

    decay: float = 0.99
    min_lr: float = 1e-6

    def on_epoch_end(self, info: CallbackInfo) -> None:
        for name in ("lr", "lr_w"):
            if hasattr(info.model, name):
                setattr(info.model, name, max(getattr(info.model, name) * self.decay, self.min_lr))
                return


class Run:
    """The epochs of one fit: monitor, log and callbacks in order; the first that stops ends the round of callbacks."""

    def __init__(self, model, callbacks: list[Callback], tol: float = -1.0, min_iter: int = 1):
        self.model, self.callbacks = model, list(callbacks or [])
        self.monitor, self.began = ConvergenceMonitor(tol, min_iter), time.time()
        for c in self.callbacks:
            c.on_train_begin(model)

    @property
    def wants_loss(self) -> bool:
        return bool(self.callbacks) or self.monitor.tol >= 0

    def epoch(self, number: int, loss: float | None) -> bool:
        """True if the fit should stop."""
        elapsed = time.time() - self.began
        log.info("%s epoch %d loss %s (%.1f s)", type(self.model).__name__, number, loss, elapsed)
        converged = loss is not None and self.monitor.record(loss)
        for c in self.callbacks:
            if c.on_epoch_end(CallbackInfo(number, loss, elapsed, self.model)) == STOP:
                return True
        return converged

    def end(self) -> None:
        for c in self.callbacks:
            c.on_train_end(self.model)
