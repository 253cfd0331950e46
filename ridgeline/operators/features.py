"""Feature frames: lazily composed feature matrices over a DataFrame.

A frame is a table plus an ordered list of named column expressions. Composition (concatenating, one-hot encoding,
interactions, standardising, subsetting ...) only rewrites expressions, so Catalyst collapses them into one
projection, prunes unused columns at the scan and keeps the arithmetic in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.comoments import Comoments
from ridgeline.operators.gram import block, cross, sums


@dataclass(frozen=True)
class Feature:
    """One column of a feature matrix. ``center``/``scale`` are the values that standardising should use instead of
    statistics (one-hot and genotype features report mean 0 and variance 1 by design)."""

    name: str
    expr: Column
    fixed_stats: bool = False


@dataclass(frozen=True)
class FeatureFrame:
    df: DataFrame
    features: tuple[Feature, ...]
    groups: tuple[int, ...] | None = None  # start of each group; None: every feature is its own

    @property
    def p(self) -> int:
        return len(self.features)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def columns(self) -> list[Column]:
        return [f.expr for f in self.features]

    def group_starts(self) -> list[int]:
        return list(range(self.p)) if self.groups is None else list(self.groups)

    def to_df(self, *keep: str) -> DataFrame:
        return self.df.select(*keep, *(f.expr.cast("double").alias(f.name) for f in self.features))

    # --- products: each is one pass over the table -------------------------------------------------
    def mul(self, v: Column, w: Column | None = None, at: Sequence[int] | None = None) -> np.ndarray:
        """X'(v * w) for all columns or those of ``at``."""
        w = F.lit(1.0) if w is None else w
        cols = [self.features[k].expr for k in (range(self.p) if at is None else at)]
        return sums(self.df, cols, v * w) if cols else np.zeros(0)

    def cmul(self, j: int, v: Column, w: Column | None = None) -> float:
        return float(self.mul(v, w, [j])[0])

    def bmul(self, j: int, q: int, v: Column, w: Column | None = None) -> np.ndarray:
        return self.mul(v, w, range(j, j + q))

    def ctmul(self, j: int, s: float, out: Column) -> Column:
        """out + s * X_j as an expression."""
        return out + F.lit(float(s)) * self.features[j].expr

    def btmul(self, j: int, v: Sequence[float], out: Column | None = None) -> Column:
        """out + X[:, j:j+q] v as an expression; zero coefficients leave their columns unread."""
        total = F.lit(0.0) if out is None else out
        for k, b in enumerate(v):
            if b:
                total = total + F.lit(float(b)) * self.features[j + k].expr
        return total

    def matvec(self, v: Sequence[float]) -> Column:
        return self.btmul(0, v)

    def cov(self, j: int, q: int, w: Column | None = None) -> np.ndarray:
        """X_b' diag(w) X_b for the block of columns j ... j+q-1."""
        return cross(self.df, self.columns[j : j + q], w)

    def sq_mul(self, w: Column) -> np.ndarray:
        return sums(self.df, self.columns, w, squares=True)

    def sp_tmul(self, betas: np.ndarray, *keep: str) -> DataFrame:
        """(keep..., eta_0 ... eta_{L-1}): products with each row of ``betas`` in one projection."""
        return self.df.select(*keep, *(self.matvec(b).alias(f"eta_{k}") for k, b in enumerate(np.atleast_2d(betas))))

    def mean(self, w: Column) -> np.ndarray:
        stats = self.mul(F.lit(1.0), w)
        return np.array([0.0 if f.fixed_stats else m for f, m in zip(self.features, stats, strict=True)])

    def var(self, centers: np.ndarray, w: Column) -> np.ndarray:
        found = sums(self.df, [c - float(m) for c, m in zip(self.columns, centers, strict=True)], w, squares=True)
        return np.array([1.0 if f.fixed_stats else x for f, x in zip(self.features, found, strict=True)])

    # --- selection ---------------------------------------------------------------------------------
    def subset_columns(self, indices: Sequence[int]) -> FeatureFrame:
        indices = [int(i) for i in indices]
        if len(set(indices)) != len(indices):
            raise ValueError("indices must be unique")
        return replace(self, features=tuple(self.features[i] for i in indices), groups=None)

    def subset_rows(self, rows: DataFrame | Column, key: str | None = None) -> FeatureFrame:
        """Rows by a condition, or by a semi-join with a table of keys."""
        df = self.df.where(rows) if isinstance(rows, Column) else self.df.join(rows, key, "left_semi")
        return replace(self, df=df)

    def __getitem__(self, at) -> FeatureFrame:
        """Columns by int, slice, list or boolean mask; (rows, columns) with rows a condition or ``:``."""
        rows, cols = at if isinstance(at, tuple) else (slice(None), at)
        out = self if isinstance(rows, slice) and rows == slice(None) else self.subset_rows(rows)
        if isinstance(cols, int | np.integer):
            cols = [int(cols)]
        elif isinstance(cols, slice):
            cols = list(range(self.p))[cols]
        else:
            cols = np.asarray(cols)
            cols = np.flatnonzero(cols) if cols.dtype == bool else cols.tolist()
        return out if list(cols) == list(range(self.p)) else out.subset_columns(cols)


def dense(df: DataFrame, columns: Sequence[str | tuple[str, Column]]) -> FeatureFrame:
    """A view of columns, by name or as (name, expression)."""
    return FeatureFrame(df, tuple(Feature(c, F.col(c)) if isinstance(c, str) else Feature(c[0], c[1]) for c in columns))


def sparse(df: DataFrame, p: int, row: str = "row_id", col: str = "col_id", value: str = "value") -> FeatureFrame:
    """A wide view of a long table (row, col, value); absent entries are 0. One grouped pass, no pivot discovery."""
    wide = df.groupBy(row).agg(*(F.sum(F.when(F.col(col) == j, F.col(value)).otherwise(0.0)).alias(f"x_{j}") for j in range(p)))
    return dense(wide, [f"x_{j}" for j in range(p)])


def concatenate(frames: Sequence[FeatureFrame], axis: int = 1, key: str | None = None) -> FeatureFrame:
    """Columns of frames over one table side by side (over several tables: joined by the unique ``key``), or, with
    axis 0, rows of frames with equal columns below one another."""
    first = frames[0]
    if axis == 0:
        if len({f.p for f in frames}) != 1:
            raise ValueError("frames must have equal columns")
        union = first.to_df()
        for f in frames[1:]:
            union = union.union(f.to_df())
        return dense(union, first.names)
    groups = None
    if any(f.groups is not None for f in frames):
        starts, at = [], 0
        for f in frames:
            starts += [at + g for g in f.group_starts()]
            at += f.p
        groups = tuple(starts)
    if all(f.df is first.df for f in frames):
        return FeatureFrame(first.df, tuple(x for f in frames for x in f.features), groups)
    if key is None:
        raise ValueError("frames over different tables need a key")
    joined, features, n = None, [], 0
    for f in frames:
        part = f.df.select(key, *(x.expr.alias(f"x_{n + k}") for k, x in enumerate(f.features)))
        features += [Feature(x.name, F.col(f"x_{n + k}"), x.fixed_stats) for k, x in enumerate(f.features)]
        n += f.p
        joined = part if joined is None else joined.join(part, key)
    return FeatureFrame(joined, tuple(features), groups)


def block_diag(frames: Sequence[FeatureFrame]) -> FeatureFrame:
    """Block diagonal: rows of each frame carry zeros in all other frames' columns."""
    names = [f"b{k}_{n}" for k, f in enumerate(frames) for n in f.names]
    union, at = None, 0
    for k, f in enumerate(frames):
        own = {f"b{k}_{x.name}": x.expr.cast("double") for x in f.features}
        part = f.df.select(*((own[n] if n in own else F.lit(0.0)).alias(n) for n in names))
        union = part if union is None else union.union(part)
        at += f.p
    return dense(union, names)


def codes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``<column>_code``: 0 ... levels-1 by sorted distinct value. The distinct values are one row per
    level; their join back is left to the planner, which broadcasts it if it is small."""
    from pyspark.sql.window import Window

    levels = df.select(column).distinct().where(F.col(column).isNotNull()).select(F.col(column).alias("__v"), (F.row_number().over(Window.orderBy(column)) - 1).alias(f"{column}_code"))
    return df.join(levels, F.col(column) == F.col("__v"), "left").drop("__v")


def one_hot(frame: FeatureFrame, levels: Sequence[int]) -> FeatureFrame:
    """Columns with ``levels`` above 0 become that many indicators (none dropped), others pass through; each source
    column is a group. Indicators report mean 0 and variance 1, so standardising leaves them alone."""
    if len(levels) != frame.p:
        raise ValueError("levels must name one number per column")
    out, groups = [], []
    for f, n in zip(frame.features, levels, strict=True):
        groups.append(len(out))
        out += [Feature(f"{f.name}={k}", F.when(f.expr == k, 1.0).otherwise(0.0), True) for k in range(n)] if n > 0 else [f]
    return FeatureFrame(frame.df, tuple(out), tuple(groups))


def interaction(frame: FeatureFrame, pairs: dict[int, Sequence[int] | None], levels: Sequence[int] | None = None) -> FeatureFrame:
    """Products of pairs of columns, each unordered pair once in lexicographic order; None pairs with all others.

    continuous x continuous: Zi, Zj, Zi Zj; with a discrete column: the other's indicators, or 1 and the continuous
    column, times its indicators, the left factor varying fastest. Each pair is a group."""
    levels = [0] * frame.p if levels is None else list(levels)
    wanted = set()
    for i, others in pairs.items():
        for j in range(frame.p) if others is None else others:
            if not 0 <= i < frame.p or not 0 <= j < frame.p:
                raise ValueError(f"pair ({i}, {j}) is out of range")
            if i != j:
                wanted.add((min(i, j), max(i, j)))

    def factor(j: int) -> list[tuple[str, Column]]:
        f = frame.features[j]
        if levels[j] <= 0:
            return [("1", F.lit(1.0)), (f.name, f.expr)]
        return [(f"{f.name}={k}", F.when(f.expr == k, 1.0).otherwise(0.0)) for k in range(levels[j])]

    out, groups = [], []
    for i, j in sorted(wanted):
        groups.append(len(out))
        if levels[i] <= 0 and levels[j] <= 0:
            a, b = frame.features[i], frame.features[j]
            out += [Feature(f"{a.name}|{a.name}:{b.name}", a.expr), Feature(f"{b.name}|{a.name}:{b.name}", b.expr), Feature(f"{a.name}:{b.name}", a.expr * b.expr)]
        else:
            out += [Feature(f"{na}:{nb}", a * b) for nb, b in factor(j) for na, a in factor(i)]
    return FeatureFrame(frame.df, tuple(out), tuple(groups))


def all_pairs(p: int) -> list[tuple[int, int]]:
    return list(combinations(range(p), 2))


def standardize(frame: FeatureFrame, weight: Column | None = None, centers: Sequence[float] | None = None, scales: Sequence[float] | None = None, ddof: int = 0) -> FeatureFrame:
    """(X - 1 c') diag(1/s), then literals. Centers come from one pass that also counts rows, scales from a second one
    around them: sums of squares about 0 would lose the variance of columns far from it."""
    w, v, n = F.lit(1.0) if weight is None else weight, None, None
    if centers is None or scales is None:
        total = sums(frame.df, [F.lit(1.0), *([] if centers is not None else frame.columns)], w)
        n = total[0] if weight is None else frame.df.count() if ddof else None
        share = F.lit(1.0 / max(total[0], 1.0)) if weight is None else weight
        if centers is None:
            centers = [0.0 if f.fixed_stats else x / (max(total[0], 1.0) if weight is None else 1.0) for f, x in zip(frame.features, total[1:], strict=True)]
        v = frame.var(centers, share) if scales is None else None
    c = np.asarray(centers, float)
    if scales is None:
        s = np.sqrt(v * (n / (n - ddof) if ddof else 1.0))
        s = np.array([1.0 if f.fixed_stats else x for f, x in zip(frame.features, s, strict=True)])
    else:
        s = np.asarray(scales, float)
    s = np.where(s > 0, s, 1.0)
    return replace(frame, features=tuple(Feature(f.name, (f.expr - float(a)) / float(b), True) for f, a, b in zip(frame.features, c, s, strict=True)))


def standardized_gram(m: Comoments, centers: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Gram of the standardised columns from comoments of the raw ones, without another pass."""
    d = m.mean - np.asarray(centers, float)
    return (m.about + m.weight * np.outer(d, d)) / np.outer(scales, scales)


def convex_relu(frame: FeatureFrame, masks: Sequence[Column], gated: bool = True) -> FeatureFrame:
    """[D_1 Z ... D_m Z] for masks D; not gated: the same columns and then their negatives."""
    out = [Feature(f"m{k}:{f.name}", F.when(m, f.expr).otherwise(0.0)) for k, m in enumerate(masks) for f in frame.features]
    if not gated:
        out += [Feature(f"-{f.name}", -f.expr) for f in out]
    return FeatureFrame(frame.df, tuple(out))


def kronecker_eye(frame: FeatureFrame, k: int, *keep: str) -> FeatureFrame:
    """X (x) I_K: each row becomes K rows with ``class_id``; column j*K+c is feature j where the class is c."""
    rows = frame.to_df(*keep).withColumn("class_id", F.explode(F.array(*(F.lit(c) for c in range(k)))))
    return FeatureFrame(rows, tuple(Feature(f"{n}@{c}", F.when(F.col("class_id") == c, F.col(n)).otherwise(0.0)) for n in frame.names for c in range(k)))


def eager_cov(frame: FeatureFrame, w: Column | None = None) -> np.ndarray:
    """X'X (with weights where given), in one pass."""
    return cross(frame.df, frame.columns, w)


class LazyCov:
    """Rows of X'X computed on first touch, a block of columns per pass, and kept on the driver."""

    def __init__(self, frame: FeatureFrame, w: Column | None = None):
        self.frame, self.w, self.rows = frame, w, {}

    def touch(self, indices: Sequence[int]) -> None:
        new = [i for i in indices if i not in self.rows]
        if new:
            x = self.frame.columns
            self.rows.update(zip(new, block(self.frame.df, [x[i] for i in new], x, self.w), strict=True))

    def mul(self, indices: Sequence[int], values: Sequence[float]) -> np.ndarray:
        self.touch(indices)
        return sum((v * self.rows[i] for i, v in zip(indices, values, strict=True)), np.zeros(self.frame.p))

    def bmul(self, subset: Sequence[int], indices: Sequence[int], values: Sequence[float]) -> np.ndarray:
        return self.mul(indices, values)[list(subset)]

    def to_dense(self, i: int, p: int) -> np.ndarray:
        self.touch(range(i, i + p))
        return np.array([self.rows[k][i : i + p] for k in range(i, i + p)])


class CovMatrix:
    """A covariance as a long table (i, j, a); products are equi-joins with a bounded sparse vector."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def of(cls, spark, a: np.ndarray) -> CovMatrix:
        i, j = np.nonzero(a)
        return cls(spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "i int, j int, a double"))

    def mul(self, indices: Sequence[int], values: Sequence[float]) -> DataFrame:
        """(j, v): v'A for a sparse v."""
        v = self.df.sparkSession.createDataFrame([(int(i), float(x)) for i, x in zip(indices, values, strict=True)], "i int, x double")
        return self.df.join(v, "i").groupBy("j").agg(F.sum(F.col("a") * F.col("x")).alias("v"))

    def bmul(self, subset: Sequence[int], indices: Sequence[int], values: Sequence[float]) -> DataFrame:
        return CovMatrix(self.df.where(F.col("j").isin([int(s) for s in subset]))).mul(indices, values)

    def to_dense(self, i: int, p: int) -> np.ndarray:
        out = np.zeros((p, p))
        for r in self.df.where((F.col("i") >= i) & (F.col("i") < i + p) & (F.col("j") >= i) & (F.col("j") < i + p)).collect():
            out[r["i"] - i, r["j"] - i] = r["a"]
        return out


class ConstraintMatrix:
    """A small dense or sparse constraint matrix on the driver (rows are constraints)."""

    def __init__(self, a: np.ndarray):
        self.a = np.asarray(a, float)

    def rmmul(self, j: int, q: np.ndarray) -> np.ndarray:
        return self.a[j] @ q

    def rvmul(self, j: int, v: np.ndarray) -> float:
        return float(self.a[j] @ v)

    def rvtmul(self, j: int, v: float, out: np.ndarray) -> np.ndarray:
        return out + v * self.a[j]

    def mul(self, v: np.ndarray) -> np.ndarray:
        return self.a.T @ v

    def tmul(self, v: np.ndarray) -> np.ndarray:
        return self.a @ v

    def cov(self, q: np.ndarray) -> np.ndarray:
        return self.a @ q @ self.a.T

    def sp_mul(self, indices: Sequence[int], values: Sequence[float]) -> np.ndarray:
        return self.a[list(indices)].T @ np.asarray(values, float)
