"""Sums of whole numbers of any size: made in tasks, added up by key, never rounded.

A vector of numbers travels as limbs: value = sum of limb j times 2**(32 j), all but the highest between 0 and 2**32. Limbs are added as
64-bit integers, which two billion vectors do not overflow, and put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BITS = 32
_LONG = (1 << 63) - 1


def limbs(values: np.ndarray) -> np.ndarray:
    """(number of limbs x number of values), of int64 or Python integers."""
    out = []
    while True:
        if values.dtype != object or all(-(1 << 62) < v < 1 << 62 for v in values):
            v = values.astype(np.int64)
            return np.array([*out, v & ((1 << _BITS) - 1), v >> _BITS], np.int64)
        out.append((values & ((1 << _BITS) - 1)).astype(np.int64))
        values = values >> _BITS


def total(limbs_: np.ndarray) -> list[int]:
    return [sum(x << (_BITS * j) for j, x in enumerate(column)) for column in limbs_.T.tolist()]


def opened(packed: bytes, n_limbs: int) -> np.ndarray:
    return np.frombuffer(packed, "<i8").reshape(n_limbs, -1)


def rows_of(keys: dict[str, list[int]], values: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each vector: its keys, the number of its limbs, the limbs."""
    cut = [limbs(v) for v in values]
    columns = [pa.array(k, pa.int32()) for k in keys.values()]
    return pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in cut], pa.int32()), pa.array([x.astype("<i8").tobytes() for x in cut], pa.binary())], names=[*keys, "limbs", "sums"])


def schema_of(keys: list[str]) -> str:
    return ", ".join([*(f"{k} int" for k in keys), "limbs int", "sums binary"])


def exact_sums(partial: DataFrame, keys: list[str]) -> DataFrame:
    """partial: rows of rows_of(), a few of each task. The same with a row a key. A task streams its rows, so it holds its keys' sums alone."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, n, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new, old = opened(packed, n), held.get(tuple(key))
                if old is None:
                    held[tuple(key)] = new.copy()
                else:
                    if len(old) < len(new):
                        old, new = new.copy(), old
                    old[: len(new)] += new
                    held[tuple(key)] = old
        for key, x in held.items():
            yield rows_of({k: [v] for k, v in zip(keys, key, strict=True)}, [np.array(total(x), object)])

    return partial.select(*keys, "limbs", "sums").repartition(*keys).mapInArrow(add, schema_of(keys))


def nearest_longs(values: np.ndarray) -> np.ndarray:
    """Whole numbers as int64, those that none holds as the nearest one."""
    return values if values.dtype == np.int64 else np.array([max(-_LONG - 1, min(_LONG, int(v))) for v in values], np.int64)
