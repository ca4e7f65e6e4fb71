"""Statistics written in Python, aggregated by merging states of bounded size.

A statistic updates a state with arrays of values and weights, merges two states and turns the last one into a number.
Tasks keep one state per key they see; states are merged in two steps, first within salted parts of a key, then per key,
so a key that holds most of the rows is no more work for one task than 64 merges.  No group of rows is ever collected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEYS_AT_ONCE, _SALTS = 4096, 64


class Statistic(Protocol):
    """What a statistic must offer; states are pickled between tasks."""

    def start(self) -> Any: ...

    def update(self, state: Any, values: np.ndarray, weights: np.ndarray) -> Any: ...

    def merge(self, one: Any, other: Any) -> Any: ...

    def finish(self, state: Any) -> float | None: ...


class WeightedQuantile:
    """Smallest value at which the weights reach ``fraction`` of their sum (0.5: the lower median), exact.

    The state holds the weight of every distinct value; ``step`` rounds values to multiples first and so bounds it.
    """

    def __init__(self, fraction: float = 0.5, step: float | None = None):
        if not 0 <= fraction <= 1:
            raise ValueError("fraction must lie between 0 and 1")
        self.fraction, self.step = fraction, step

    def start(self):
        return np.zeros(0), np.zeros(0)

    def _packed(self, values, weights):
        distinct, place = np.unique(values, return_inverse=True)
        return distinct, np.bincount(place, weights, len(distinct))

    def update(self, state, values, weights):
        if self.step:
            values = np.round(values / self.step) * self.step
        return self.merge(state, self._packed(values, weights))

    def merge(self, one, other):
        return self._packed(np.concatenate([one[0], other[0]]), np.concatenate([one[1], other[1]]))

    def finish(self, state):
        values, weights = state
        upto = np.cumsum(weights)
        if not len(values) or upto[-1] <= 0:
            return None
        return float(values[np.searchsorted(upto, self.fraction * upto[-1])])


def _key_ends(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple]:
    return list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows


class _States:
    def __init__(self, statistic: Statistic, keys: Sequence[str], schema: pa.Schema, most_bytes: int):
        self.statistic, self.keys, self.schema, self.most_bytes = statistic, list(keys), schema, most_bytes
        self.held: dict[tuple, Any] = {}

    def batch(self) -> pa.RecordBatch:
        names = list(self.held)
        packed = [pickle.dumps(s) for s in self.held.values()]
        if packed and max(map(len, packed)) > self.most_bytes:
            raise ValueError(f"a state of {type(self.statistic).__name__} takes more than {self.most_bytes} bytes")
        self.held = {}
        columns = [pa.array([n[k] for n in names], self.schema.field(c).type) for k, c in enumerate(self.keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], [*self.keys, "state"])


def _updated(statistic: Statistic, keys: Sequence[str], most_bytes: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = None
        for batch in batches:
            if not batch.num_rows:
                continue
            states = states or _States(statistic, keys, batch.schema, most_bytes)
            names = _key_ends(batch, keys)
            numbers: dict[tuple, int] = {}
            group = np.fromiter((numbers.setdefault(n, len(numbers)) for n in names), np.int64, len(names))
            order = np.argsort(group, kind="stable")
            ends = np.cumsum(np.bincount(group, minlength=len(numbers)))
            values, weights = (batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("_value", "_weight"))
            for name, a, b in zip(numbers, [0, *ends[:-1]], ends):
                state = states.held.get(name)
                states.held[name] = statistic.update(statistic.start() if state is None else state, values[a:b], weights[a:b])
            if len(states.held) > _KEYS_AT_ONCE:
                yield states.batch()
        if states is not None and states.held:
            yield states.batch()

    return compute


def _merged(statistic: Statistic, keys: Sequence[str], most_bytes: int, last: bool):
    """Merges states sorted by key; at the last step they are finished."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, schema = None, None, None

        def done():
            columns = [pa.array([name[k]], schema.field(c).type) for k, c in enumerate(keys)]
            if last:
                return pa.RecordBatch.from_arrays([*columns, pa.array([statistic.finish(state)], pa.float64())], [*keys, "statistic"])
            states = _States(statistic, keys, schema, most_bytes)
            states.held = {name: state}
            return states.batch()

        for batch in batches:
            schema = schema or batch.schema
            for found, packed in zip(_key_ends(batch, keys), batch.column("state").to_pylist()):
                other = pickle.loads(packed)
                if name is not None and found == name:
                    state = statistic.merge(state, other)
                else:
                    if name is not None:
                        yield done()
                    name, state = found, other
        if name is not None:
            yield done()

    return compute


def aggregate_statistic(
    df: DataFrame, keys: Sequence[str], value, statistic: Statistic, weight=None, most_bytes: int = 1 << 24,
) -> DataFrame:
    """(keys, statistic): one row per key; rows without a value or weight are left out.

    The statistic is finished once per key, after its states have met; a state beyond ``most_bytes`` is an error.
    """
    keys = list(keys)
    own = F.col(value) if isinstance(value, str) else value
    by = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    rows = df.select(*keys, own.cast("double").alias("_value"), by.cast("double").alias("_weight")).where("_value is not null and _weight is not null")
    types = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    states = rows.mapInArrow(_updated(statistic, keys, most_bytes), f"{types}state binary")
    salt = F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("_salt")
    salted = states.select(*keys, "state", salt).repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt")
    parts = salted.select(*keys, "state").mapInArrow(_merged(statistic, keys, most_bytes, False), f"{types}state binary")
    together = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)
    return together.mapInArrow(_merged(statistic, keys, most_bytes, True), f"{types}statistic double")
