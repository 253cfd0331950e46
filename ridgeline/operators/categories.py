"""Gram matrices of categories by grouped counts, in place of a column for every level.

The indicators of a category meet those of another in as many rows as hold both levels, and a measure in the sum of its
values at the level. One pass counts and adds up by all levels and pairs of levels that occur; the result is a long
table of the entries that aren't 0, whatever the number of levels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.features import CovMatrix, FeatureFrame
from ridgeline.operators.gram import cross
from ridgeline.sources.storage import Stored


def places(levels: Sequence[int]) -> list[int]:
    """First column of each feature of ``one_hot``: a category takes as many as it has levels, a measure one."""
    return np.cumsum([0, *(max(n, 1) for n in levels)]).tolist()


#: Levels of a category whose number isn't known: every code of at least 0 that positions can hold.
ANY = (1 << 31) - 1


def category_gram(frame: FeatureFrame, levels: Sequence[int], weight: Column | None = None, at: Sequence[int] | None = None) -> DataFrame:
    """(i, j, a): the entries of the Gram of ``one_hot(frame, levels)`` that aren't 0, both triangles. Codes that are null
    or no level have no indicator; null measures and weights count as 0.

    ``at`` names each feature's first position in place of ``places``. A category of ``ANY`` levels may then reach into the
    positions of the features after it; entries of one position that stem from different features stay rows of their own."""
    if len(levels) != frame.p or at is not None and len(at) != frame.p:
        raise ValueError("levels and positions must name one number per column")
    at = places(levels) if at is None else list(at)
    cats, nums = [k for k, n in enumerate(levels) if n > 0], [k for k, n in enumerate(levels) if n <= 0]
    w = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    code = lambda k: F.when((frame.columns[k] >= 0) & (frame.columns[k] < levels[k]) & (frame.columns[k] == F.floor(frame.columns[k])), frame.columns[k].cast("int"))
    base = frame.df.select(*(code(k).alias(f"c{k}") for k in cats), *(F.coalesce(frame.columns[k].cast("double"), F.lit(0.0)).alias(f"m{k}") for k in nums), w.alias("w"))
    spark, out = frame.df.sparkSession, None
    if nums:
        g = cross(base, [F.col(f"m{k}") for k in nums], F.col("w"))
        out = spark.createDataFrame([(at[a], at[b], float(g[i, j])) for i, a in enumerate(nums) for j, b in enumerate(nums) if g[i, j]], "i int, j int, a double")
    if not cats:
        return out
    sets = [[f"c{k}"] for k in cats] + [[f"c{a}", f"c{b}"] for a, b in combinations(cats, 2)]
    sums = base.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(f"c{k}") for k in cats)).agg(F.grouping_id().alias("set"), F.sum("w").alias("n"), *(F.sum(F.col("w") * F.col(f"m{k}")).alias(f"s{k}") for k in nums))
    cell = lambda i, j, a: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), a.alias("a"))
    cases = None
    for own in sets:
        mask = sum(1 << (len(cats) - 1 - n) for n, k in enumerate(cats) if f"c{k}" not in own)  # bits of what is rolled up
        ks = [int(c[1:]) for c in own]
        p = [F.col(c) + at[k] for c, k in zip(own, ks, strict=True)]
        if len(own) == 2:
            cells = [cell(p[0], p[1], F.col("n")), cell(p[1], p[0], F.col("n"))]
        else:
            cells = [cell(p[0], p[0], F.col("n"))]
            for k in nums:
                cells += [cell(p[0], F.lit(at[k]), F.col(f"s{k}")), cell(F.lit(at[k]), p[0], F.col(f"s{k}"))]
        known = (F.col("set") == mask) & F.col(own[0]).isNotNull() & F.col(own[-1]).isNotNull()
        cases = F.when(known, F.array(*cells)) if cases is None else cases.when(known, F.array(*cells))
    counted = sums.select(F.inline(cases)).where("a <> 0")
    return counted if out is None else counted.union(out)


class CategoryProblem:
    """A response over categories and measures for ``plans.screened.screened_path``. The table of counts is stored once and
    answers all questions; rows are read for it only. Groups are ``places``, but for the last."""

    def __init__(self, frame: FeatureFrame, levels: Sequence[int], y: str, weight: Column | None = None):
        from ridgeline.operators.features import Feature

        whole = FeatureFrame(frame.df, (*frame.features, Feature("__y", F.col(y)), Feature("__one", F.lit(1.0))))
        at = places([*levels, 0, 0])
        self.p = at[frame.p]
        self.names = [f"{f.name}={k}" if n > 0 else f.name for f, n in zip(frame.features, levels, strict=True) for k in range(max(n, 1))]
        table, _ = Stored(frame.df.sparkSession, "categories").put(category_gram(whole, [*levels, 0, 0], weight))
        y_at, one = self.p, self.p + 1
        of_y, of_one = self._column(table, y_at), self._column(table, one)
        self.total = of_one[one] or 1.0
        self.xy, self.mean = of_y[: self.p] / self.total, of_one[: self.p] / self.total
        self.y, self.yy = of_y[one] / self.total, of_y[y_at] / self.total
        self.matrix = table.where((F.col("i") < self.p) & (F.col("j") < self.p))

    def _column(self, table: DataFrame, j: int) -> np.ndarray:
        got, out = table.where(F.col("j") == j).select("i", "a").toArrow(), np.zeros(self.p + 2)
        out[got.column("i").to_numpy()] = got.column("a").to_numpy()
        return out

    def response(self) -> tuple[float, float, float]:
        return self.y, self.yy - self.y**2, self.yy

    def means(self) -> np.ndarray:
        return self.mean

    def products(self, inter: float, beta: np.ndarray) -> np.ndarray:
        out = self.xy - inter * self.mean
        at = np.flatnonzero(beta)
        if len(at):
            got = CovMatrix(self.matrix).mul(at.tolist(), beta[at].tolist()).toArrow()
            out[got.column("j").to_numpy()] -= got.column("v").to_numpy() / self.total
        return out

    def gram(self, left: list[int], right: list[int]) -> np.ndarray:
        spark, out = self.matrix.sparkSession, np.zeros((len(left), len(right)))
        a = spark.createDataFrame([(int(j), k) for k, j in enumerate(left)], "i int, r int")
        b = spark.createDataFrame([(int(j), k) for k, j in enumerate(right)], "j int, c int")
        got = self.matrix.join(a, "i").join(b, "j").select("r", "c", "a").toArrow()
        out[got.column("r").to_numpy(), got.column("c").to_numpy()] = got.column("a").to_numpy()
        return out / self.total
