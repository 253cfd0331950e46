"""Sufficient statistics: weighted sums, cross products and Gram matrices in one distributed pass.

Few columns are plain aggregate sums in generated code. More columns are packed into Arrow batches; each task adds
up one partial result in BLAS and returns it as arrays of ``BLOCK`` numbers, which a second stage adds up by block. So
neither rows nor more than one result per task and group leave an executor, and what is shuffled are blocks, not numbers.
``comoments`` holds what fits need about means, without the sums about 0 that lose it for columns far from 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many distinct sums are planned as one aggregate; beyond it generated code grows too large.
NATIVE_SUMS = 60
#: Entries of a matrix that may reach the driver (2 GB); larger ones are a caller's to split into blocks.
MOST_ENTRIES = 1 << 28
#: Numbers of a row that travels between the two stages; most tasks of the second one; numbers that the driver adds up.
BLOCK, MERGERS, DRIVER_SUMS = 4096, 16, 1 << 22


def sound(values: Sequence[Column], weight: Column) -> Column:
    """Whether a row may take part in a fit: a finite weight of at least 0 and, but at weight 0, finite values."""
    finite = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    checks = [finite(v) for v in values] or [F.lit(True)]
    while len(checks) > 1:  # a balanced tree: a chain of thousands is too deep for the planner
        checks = [a & b for a, b in zip(checks[::2], checks[1::2])] + checks[len(checks) // 2 * 2 :]  # noqa: B905
    return finite(weight) & (weight >= 0) & (checks[0] | (weight == 0))


def refuse(bad: int | None) -> None:
    if bad:
        raise ValueError(f"{int(bad)} rows hold null or non-finite values or weights below 0; drop them, or pass missing='drop'")


def salts(size: int) -> int:
    """Parts that a result of ``size`` numbers is added up in side by side; the driver adds up what they found."""
    return int(max(1, min(MERGERS, DRIVER_SUMS // max(size, 1))))


def by_position(df: DataFrame, size: int, partial: Callable[[list[np.ndarray]], np.ndarray], tasks: int | None = None) -> np.ndarray:
    """Sums over all batches of vectors of ``size`` that ``partial`` makes of a batch's columns: one vector a task.

    A caller who knows that ``df`` has few ``tasks`` (``DRIVER_SUMS`` numbers in all) spares the second stage."""
    if size > MOST_ENTRIES:
        raise ValueError(f"{size} numbers are too many for the driver; ask for blocks of columns")
    parts = salts(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += partial([b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)])
        own = TaskContext.get().partitionId() % parts
        at = [k for k in range(-(-size // BLOCK)) if total[k * BLOCK : (k + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([own] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([total[k * BLOCK : (k + 1) * BLOCK] for k in at], pa.list_(pa.float64()))], ["salt", "at", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("at").to_pylist(), b.column("v"), strict=True):
                v = v.values.to_numpy()
                found[k] = found[k] + v if k in found else v
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["at", "v"])

    found = df.mapInArrow(run, "salt int, at int, v array<double>")
    if tasks is None or tasks * size > DRIVER_SUMS:
        found = found.repartition(MERGERS, "salt", "at").mapInArrow(add, "at int, v array<double>")
    found, out = found.select("at", "v").toArrow(), np.zeros(size)
    for k, v in zip(found.column("at").to_pylist(), found.column("v"), strict=True):
        out[k * BLOCK : (k + 1) * BLOCK] += v.values.to_numpy()
    return out


def _cells(df: DataFrame, columns: Sequence[Column], weight: Column | None, strict: bool, *more: Column) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    cells = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(columns)]
    bad = F.when(sound(columns, w.cast("double")), 0.0).otherwise(1.0) if strict else F.lit(0.0)
    return df.select(*cells, F.coalesce(w.cast("double"), F.lit(0.0)).alias("w"), bad.alias("bad"), *more)


def cross(df: DataFrame, columns: Sequence[Column], weight: Column | None = None, strict: bool = False) -> np.ndarray:
    """C' diag(weight) C over all rows of the given double columns, as a dense matrix. Nulls count as 0, or with
    ``strict`` raise, as do other values that are not ``sound``."""
    return cross_by(df, columns, weight, F.lit(0), 1, strict)[0]


def cross_by(df: DataFrame, columns: Sequence[Column], weight: Column | None, group: Column, groups: int, strict: bool = False) -> np.ndarray:
    """``cross`` of each value 0 ... groups - 1 of ``group``, all in one pass: (groups, p, p)."""
    p = len(columns)
    i, j = np.triu_indices(p)
    base = _cells(df, columns, weight, strict, group.cast("int").alias("g"))
    if len(i) * groups <= NATIVE_SUMS:
        sums = [F.sum(F.when(F.col("g") == g, F.col(f"c{a}") * F.col(f"c{b}") * F.col("w")) if groups > 1 else F.col(f"c{a}") * F.col(f"c{b}") * F.col("w")).alias(f"s{g}_{k}") for g in range(groups) for k, (a, b) in enumerate(zip(i, j, strict=True))]
        row = base.agg(*sums, F.sum("bad").alias("bad")).first()
        flat = np.array([*(x or 0.0 for x in row[:-1]), row[-1] or 0.0])
    else:

        def partial(cols: list[np.ndarray]) -> np.ndarray:
            x, w, g, out = np.column_stack(cols[:p]), cols[p], cols[p + 2], np.zeros((groups, len(i)))
            for k in np.unique(g):
                own = g == k
                xs = x[own] if groups > 1 else x
                out[k] = (xs.T @ (xs * (w[own] if groups > 1 else w)[:, None]))[i, j]
            return np.append(out.ravel(), cols[p + 1].sum())

        flat = by_position(base, len(i) * groups + 1, partial)
    refuse(flat[-1])
    out = np.zeros((groups, p, p))
    out[:, i, j] = flat[:-1].reshape(groups, -1)
    out[:, j, i] = out[:, i, j]
    return out


def block(df: DataFrame, left: Sequence[Column], right: Sequence[Column], weight: Column | None = None) -> np.ndarray:
    """L' diag(weight) R over all rows, nulls as 0: one pass whatever the number of columns."""
    base, a, b = _cells(df, [*left, *right], weight, False), len(left), len(right)
    if a * b <= NATIVE_SUMS:
        row = base.agg(*(F.sum(F.col(f"c{i}") * F.col(f"c{a + j}") * F.col("w")).alias(f"s{i}_{j}") for i in range(a) for j in range(b))).first()
        return np.array([x or 0.0 for x in row]).reshape(a, b)
    return by_position(base, a * b, lambda cols: (np.column_stack(cols[:a]).T @ (np.column_stack(cols[a : a + b]) * cols[a + b][:, None])).ravel()).reshape(a, b)


def sums(df: DataFrame, columns: Sequence[Column], weight: Column, squares: bool = False) -> np.ndarray:
    """Sums of weight * column, or of weight * column^2, nulls as 0: one pass."""
    if not columns:
        return np.zeros(0)
    if len(columns) <= NATIVE_SUMS:
        row = df.agg(*(F.sum(weight * c.cast("double") * c.cast("double") if squares else c.cast("double") * weight).alias(f"s{k}") for k, c in enumerate(columns))).first()
        return np.array([x or 0.0 for x in row])
    p = len(columns)
    return by_position(_cells(df, columns, weight, False), p, lambda cols: cols[p] @ (np.column_stack(cols[:p]) ** (2 if squares else 1)))


def weighted_sums(df: DataFrame, columns: Sequence[Column], weight: Column) -> np.ndarray:
    """(sum of weights, rows that aren't ``sound``, weighted sums of the columns over the sound ones): one pass."""
    p = len(columns)

    def partial(cols: list[np.ndarray]) -> np.ndarray:
        x, w = np.column_stack(cols[:p]), cols[p]
        known, weighed = np.isfinite(x).all(axis=1), np.isfinite(w) & (w >= 0)
        bad = ~weighed | ~known & (w != 0)
        own = np.where(bad, 0.0, w)
        return np.array([own.sum(), bad.sum(), *(own[known] @ x[known])])

    return by_position(df.select(*(c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)), weight.cast("double").alias("w")), p + 2, partial)
