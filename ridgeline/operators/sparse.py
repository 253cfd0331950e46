"""Sparse rows: two arrays a row, the positions and values of what isn't 0, for matrices of millions of columns.

Products are grouped sums by position and no plan has a column for each; chosen columns are multiplied as small dense blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators.gram import by_position
from ridgeline.sources.storage import Stored


class SparseRows:
    """``df`` with arrays ``indices`` (0 ... p-1, each once a row at most) and ``values``."""

    def __init__(self, df: DataFrame, p: int, indices: str = "indices", values: str = "values"):
        self.df, self.p, self.indices, self.values = df, p, indices, values

    @classmethod
    def of(cls, long: DataFrame, p: int, row: str = "row_id", col: str = "col_id", value: str = "value", keep: DataFrame | None = None) -> SparseRows:
        """Rows of a long table; entries of one place add up. ``keep``, a table with a row per ``row``, gives further
        columns and the rows without any entry."""
        cells = long.groupBy(row, col).agg(F.sum(F.col(value).cast("double")).alias("x"))
        rows = cells.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(col).cast("int").alias("j"), "x"))).alias("cells"))
        if keep is not None:
            rows = keep.join(rows, row, "left")
        none = F.array().cast("array<struct<j:int,x:double>>")
        rows = rows.withColumn("cells", F.coalesce("cells", none))
        return cls(rows.withColumn("indices", F.col("cells.j")).withColumn("values", F.col("cells.x")).drop("cells"), p)

    def _cells(self, v: Column) -> DataFrame:
        zipped = F.arrays_zip(F.col(self.indices).alias("j"), F.col(self.values).alias("x"))
        return self.df.select(v.cast("double").alias("v"), F.inline(zipped).alias("j", "x"))

    def tmul(self, v: Column) -> DataFrame:
        """(j, value): X'v for the columns that have entries, summed before the shuffle."""
        return self._cells(v).groupBy("j").agg(F.sum(F.col("v") * F.col("x")).alias("value"))

    def sq_tmul(self, v: Column) -> DataFrame:
        """(j, value): sums of v times squares."""
        return self._cells(v).groupBy("j").agg(F.sum(F.col("v") * F.col("x") * F.col("x")).alias("value"))

    def mul(self, beta: np.ndarray, *keep: str, name: str = "eta") -> DataFrame:
        """(keep..., eta): X beta by row. Only coefficients that aren't 0 travel with the tasks."""
        at = np.flatnonzero(beta)
        b = np.asarray(beta, float)[at]
        base = self.df.select(*keep, F.col(self.indices).cast("array<int>").alias("__i"), F.col(self.values).cast("array<double>").alias("__x"))
        schema = T.StructType([*(base.schema[k] for k in keep), T.StructField(name, T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                eta = _products(batch.column("__i"), batch.column("__x"), at, b)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(eta)], [*keep, name])

        return base.mapInArrow(run, schema)

    def gram(self, left: Sequence[int], right: Sequence[int], weight: Column | None = None) -> np.ndarray:
        """X_l' diag(weight) X_r for chosen columns, at most some thousands."""
        names = np.array(sorted({*left, *right}))
        a, b = np.searchsorted(names, left), np.searchsorted(names, right)
        w = F.lit(1.0) if weight is None else weight.cast("double")
        base = self.df.select(F.col(self.indices).cast("array<int>").alias("i"), F.col(self.values).cast("array<double>").alias("x"), w.alias("w"))

        def partial(cols: list) -> np.ndarray:
            i, x, w = cols
            sizes = np.array([len(r) for r in i])
            flat = np.concatenate([*i, np.zeros(0, np.int32)]).astype(int)
            place = np.minimum(np.searchsorted(names, flat), len(names) - 1)
            own = names[place] == flat
            rows, place, value = np.repeat(np.arange(len(sizes)), sizes)[own], place[own], np.concatenate([*x, np.zeros(0)])[own]
            used, rows = np.unique(rows, return_inverse=True)
            dense = np.zeros((len(used), len(names)))
            dense[rows, place] = value
            return (dense[:, a].T @ (dense[:, b] * w[used, None])).ravel()

        return by_position(base, len(a) * len(b), partial).reshape(len(a), len(b))


def _products(i: pa.Array, x: pa.Array, at: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, sizes = np.zeros(len(i)), i.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    if len(at) and sizes.sum():
        flat, value = i.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(at, flat), len(at) - 1)
        np.add.at(out, np.repeat(np.arange(len(i)), sizes), np.where(at[place] == flat, b[place] * value, 0.0))
    return out


class SparseProblem:
    """A sparse matrix and a response for ``plans.screened.screened_path``."""

    def __init__(self, x: SparseRows, y: str, weight: str | None = None):
        self.x, self.p, self.names = x, x.p, [f"x_{j}" for j in range(x.p)]
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        own = x.df.select(F.col(x.indices).alias("indices"), F.col(x.values).alias("values"), F.col(y).cast("double").alias("y"), w.alias("w"))
        held, _ = Stored(x.df.sparkSession, "sparse").put(own)  # a fit reads the rows several times and computes them once
        row = held.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y")).first()
        self.total, self.mean = row["w"] or 1.0, (row["y"] or 0.0) / (row["w"] or 1.0)
        self.var = (held.agg(F.sum(F.col("w") * (F.col("y") - self.mean) ** 2)).first()[0] or 0.0) / self.total
        self.rows = SparseRows(held.withColumn("w", F.col("w") / self.total), x.p)

    def _vector(self, found: DataFrame) -> np.ndarray:
        got, out = found.toArrow(), np.zeros(self.p)
        out[got.column("j").to_numpy()] = got.column("value").to_numpy()
        return out

    def response(self) -> tuple[float, float, float]:
        return self.mean, self.var, self.var + self.mean**2

    def means(self) -> np.ndarray:
        return self._vector(self.rows.tmul(F.col("w")))

    def products(self, inter: float, beta: np.ndarray) -> np.ndarray:
        if not np.any(beta):
            return self._vector(self.rows.tmul(F.col("w") * (F.col("y") - inter)))
        with_eta = SparseRows(self.rows.mul(beta, "indices", "values", "y", "w"), self.p)
        return self._vector(with_eta.tmul(F.col("w") * (F.col("y") - inter - F.col("eta"))))

    def gram(self, left: list[int], right: list[int]) -> np.ndarray:
        return self.rows.gram(left, right, F.col("w"))
