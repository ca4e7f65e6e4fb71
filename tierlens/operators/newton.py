"""Several penalised logistic models fitted together, one pass over the rows per iteration.

A pass evaluates every model at its trial coefficients: tasks add up loss, gradient and Hessian as block sums over Arrow
batches, Spark adds up the tasks, and the driver receives one number per entry of each model's sums.  A trial that does
not lower the penalised loss halves its step, so each pass is either an accepted Newton step or a shorter try.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PASSES, HALVINGS, PRECISION = 100, 30, 1e-10


@dataclass
class _Fit:
    """One model on its way: accepted coefficients (intercept first), and the trial the next pass evaluates."""

    inputs: list[str]
    label: str
    l2: float
    at: np.ndarray = field(init=False)
    loss: float = np.inf
    step: np.ndarray | None = None
    share: float = 1.0
    steps: int = 0
    halvings: int = 0
    done: bool = False
    converged: bool = False
    n: int = 0
    positives: int = 0

    def __post_init__(self):
        self.at = np.zeros(len(self.inputs) + 1)

    @property
    def trial(self) -> np.ndarray:
        return self.at if self.step is None else self.at + self.share * self.step

    def learn(self, sums: np.ndarray) -> None:
        """Take in (n, positives, loss, gradient, Hessian) at the trial and choose the next one."""
        size = len(self.at)
        self.n, self.positives = int(round(sums[0])), int(round(sums[1]))
        if self.n == 0:
            raise ValueError(f"no training rows for {self.label}")
        if self.positives in (0, self.n):
            self.done = self.converged = True  # one class: nothing to fit
            return
        penalty = np.r_[0.0, np.full(size - 1, self.l2)]
        at = self.trial
        loss = sums[2] + 0.5 * float(penalty @ (at * at))
        if self.step is not None and not loss <= self.loss + 1e-12 * abs(self.loss):
            self.halvings += 1
            self.share /= 2
            self.done = self.halvings >= HALVINGS  # no shorter step helps: not converged
            return
        moved = np.inf if self.step is None else float(np.abs(self.share * self.step).max())
        self.at, self.loss, self.share, self.halvings = at, loss, 1.0, 0
        self.steps += self.step is not None
        gradient = sums[3:3 + size] + penalty * at
        hessian = sums[3 + size:].reshape(size, size) + np.diag(penalty)
        if np.abs(gradient).max() <= PRECISION * self.n or moved <= PRECISION:
            self.done = self.converged = True
            return
        # a model whose intercept alone is not penalised can be flat along it for a while
        self.step = -np.linalg.solve(hessian + 1e-12 * np.trace(hessian) / size * np.eye(size), gradient)


def _sums(shared):
    """(model, place, value): the sums of every model that is still on its way."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = [(k, f) for k, f in enumerate(shared.value) if not f.done]
        totals = {k: np.zeros(3 + len(f.at) + len(f.at) ** 2) for k, f in fits}
        for batch in batches:
            read: dict[str, np.ndarray] = {}

            def column(name):
                if name not in read:
                    read[name] = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
                return read[name]

            for k, f in fits:
                known = ~np.isnan(column(f.label))  # a NULL label arrives as NaN
                y = column(f.label)[known]
                x = np.column_stack([np.ones(len(y)), *[column(c)[known] for c in f.inputs]])
                z = x @ f.trial
                p = 0.5 * (1 + np.tanh(0.5 * z))
                loss = np.logaddexp(0, z) - y * z
                totals[k] += np.concatenate([[len(y), y.sum(), loss.sum()], x.T @ (p - y), ((x.T * (p * (1 - p))) @ x).ravel()])
        model = np.concatenate([np.full(len(t), k) for k, t in totals.items()] or [np.zeros(0, np.int64)])
        place = np.concatenate([np.arange(len(t)) for t in totals.values()] or [np.zeros(0, np.int64)])
        value = np.concatenate([*totals.values()] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int64)), pa.array(place.astype(np.int64)), pa.array(value)], ["model", "place", "value"])

    return compute


def fit_together(rows: DataFrame, models: Sequence[tuple[Sequence[str], str, float]]) -> list[_Fit]:
    """Fits of (input columns, label column, l2) over the same rows; each uses the rows that have its label.

    Minimises the summed log-loss + l2/2 |w|^2, intercept free.  Inputs must be numbers without gaps.
    """
    if any(l2 <= 0 for *_, l2 in models):
        raise ValueError("l2 must be positive")
    fits = [_Fit(list(inputs), label, l2) for inputs, label, l2 in models]
    names = list(dict.fromkeys(c for f in fits for c in (*f.inputs, f.label)))
    narrow = rows.select(*[F.col(c).cast("double").alias(c) for c in names])
    for _ in range(MAX_PASSES):
        if all(f.done for f in fits):
            break
        shared = rows.sparkSession.sparkContext.broadcast(fits)
        added = narrow.mapInArrow(_sums(shared), "model long, place long, value double").groupBy("model", "place").agg(F.sum("value").alias("value"))
        sums: dict[int, dict[int, float]] = {}
        for r in added.collect():  # one row per entry of a model's sums
            sums.setdefault(r.model, {})[r.place] = r.value
        for k, f in enumerate(fits):
            if not f.done:
                size = 3 + len(f.at) + len(f.at) ** 2
                f.learn(np.array([sums.get(k, {}).get(place, 0.0) for place in range(size)]))
        shared.unpersist()
    return fits
