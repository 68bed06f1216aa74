"""Element-wise sums of arrays that merge: tasks add up the arrays of a key where they are, and only sums and counts are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of all keys that a task holds before it sends its sums.
HELD = 1 << 22


class _Sums:
    """A sum and a count for each element; arrays of other lengths count where they have elements, nulls nowhere."""

    __slots__ = ("s", "n")

    def __init__(self) -> None:
        self.s, self.n = np.zeros(0), np.zeros(0, np.int64)

    def add(self, s: np.ndarray, n: np.ndarray | int) -> int:
        grown = len(s) - len(self.s)
        if grown > 0:
            self.s, self.n = np.r_[self.s, np.zeros(grown)], np.r_[self.n, np.zeros(grown, np.int64)]
        self.s[: len(s)] += s
        self.n[: len(s)] += n
        return max(0, grown)


def _rows(keys: list[tuple], sums: list[_Sums], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], f.type) for i, f in enumerate(fields)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([x.s for x in sums], pa.list_(pa.float64())), pa.array([x.n for x in sums], pa.list_(pa.int64()))], [*[f.name for f in fields], "_s", "_n"])


def _keys_of(batch: pa.RecordBatch, keys: list[str]) -> list[tuple]:
    return list(zip(*[batch[k].to_pylist() for k in keys], strict=True))


def _elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values (null as 0), where there is one, and where each row's values begin."""
    lengths = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    return values, there, np.r_[0, np.cumsum(lengths)]


def array_means(df: DataFrame, *, keys: list[str], column: str) -> DataFrame:
    """keys and the mean by position of the arrays of each key; null where no array has a value. Null arrays count nowhere, and give no row if a key has no others."""
    ids = keys or ["_all"]
    rows = df.where(F.col(column).isNotNull()).select(*keys, *([] if keys else [F.lit(0).alias("_all")]), F.col(column).cast("array<double>").alias("_v"))
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k != "_v") + ", _s array<double>, _n array<long>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Sums] = {}
        size, fields = 0, []
        for b in batches:
            fields = [b.schema.field(k) for k in ids]
            values, there, at = _elements(b["_v"])
            for key, lo, hi in zip(_keys_of(b, ids), at[:-1], at[1:], strict=True):
                size += held.setdefault(key, _Sums()).add(values[lo:hi], there[lo:hi])
            if size > HELD:
                yield _rows(list(held), list(held.values()), fields)
                held, size = {}, 0
        if held:
            yield _rows(list(held), list(held.values()), fields)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, fields = None, _Sums(), []
        for b in batches:
            fields = [b.schema.field(k) for k in ids]
            values, _, at = _elements(b["_s"])
            counts = b["_n"].flatten().to_numpy()
            done: list[tuple] = []
            for key, lo, hi in zip(_keys_of(b, ids), at[:-1], at[1:], strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, total))
                    now, total = key, _Sums()
                total.add(values[lo:hi], counts[lo:hi])
            if done:
                yield _rows([k for k, _ in done], [t for _, t in done], fields)
        if now is not None:
            yield _rows([now], [total], fields)

    sums = rows.mapInArrow(partial, schema).repartition(*ids).sortWithinPartitions(*ids).mapInArrow(merged, schema)
    mean = F.transform(F.arrays_zip("_s", "_n"), lambda x: F.when(x["_n"] > 0, x["_s"] / x["_n"]))
    return sums.select(*keys, mean.alias(column))
