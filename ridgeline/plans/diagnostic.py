"""Predictions, objectives, gradients and optimality of a fitted path, as plans over the rows."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.glm import Cox, Response
from ridgeline.operators.features import FeatureFrame
from ridgeline.plans.path import GlmData, PathResult, group_norms, penalty_value


#: Products of a prediction up to which it is planned as one projection; more are taken batch by batch.
PROJECTED = 2000


def predict(frame: FeatureFrame, fit: PathResult, *keep: str, offsets: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., lmda_idx, class, eta): the linear predictor of every row for every value of the path. One projection
    and one generator, or one matrix product a batch where the path has many values or columns; no shuffle."""
    K, L = fit.classes, len(fit.lmdas)
    inters = fit.intercepts.reshape(L, -1)
    if int(np.count_nonzero(fit.betas)) <= PROJECTED:
        cells = []
        for i in range(L):
            own = fit.betas[i].reshape(frame.p, K)
            for k in range(K):
                base = F.lit(float(inters[i, k])) + (F.col(offsets[k]).cast("double") if offsets else F.lit(0.0))
                cells.append(F.struct(F.lit(i).alias("lmda_idx"), F.lit(k).alias("class"), frame.btmul(0, own[:, k], base).alias("eta")))
        return frame.df.select(*keep, F.inline(F.array(*cells)))
    xs = [x.cast("double").alias(f"x{j}") for j, x in enumerate(frame.columns)]
    os = [F.col(o).cast("double").alias(f"o{k}") for k, o in enumerate(offsets)]
    base = frame.df.select(*(F.col(c).alias(f"k{n}") for n, c in enumerate(keep)), *xs, *os)
    names, p = [f"k{n}" for n in range(len(keep))], frame.p
    betas = fit.betas.reshape(L, p, K).transpose(1, 0, 2).reshape(p, L * K)
    schema = T.StructType([*(base.schema[n] for n in names), T.StructField("lmda_idx", T.IntegerType()), T.StructField("class", T.IntegerType()), T.StructField("eta", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 4_000_000 // (L * K))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                n = b.num_rows
                x = np.column_stack([b.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(p)])
                eta = (x @ betas).reshape(n, L, K) + inters[None, :, :]
                if offsets:
                    eta += np.column_stack([b.column(f"o{k}").to_numpy(zero_copy_only=False) for k in range(K)])[:, None, :]
                row = pa.array(np.repeat(np.arange(n), L * K))
                cells = [np.tile(np.repeat(np.arange(L, dtype=np.int32), K), n), np.tile(np.arange(K, dtype=np.int32), n * L), eta.ravel()]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in names), *map(pa.array, cells)], [*names, "lmda_idx", "class", "eta"])

    return base.mapInArrow(run, schema).toDF(*keep, "lmda_idx", "class", "eta")


def objective(frame: FeatureFrame, response: Response, fit: PathResult, relative: bool = True, add_penalty: bool = True) -> np.ndarray:
    """Loss (over the saturated loss, if relative) plus penalty for each value of the path: one pass for all of them."""
    data = GlmData(frame, response)
    full = data.loss_full() if relative else 0.0
    pen = [lmda * penalty_value(b, fit.starts, fit.sizes, fit.penalty, fit.alpha) if add_penalty else 0.0 for lmda, b in zip(fit.lmdas, fit.betas, strict=True)]
    return data.along(fit.betas, fit.intercepts)[0] - full + np.array(pen)


def residuals(frame: FeatureFrame, response: Response, fit: PathResult, at: int) -> DataFrame:
    """The table of one value of the path with resid_0 ... (the negative gradient of each row)."""
    base, _, grads, _, _ = GlmData(frame, response).rows(fit.betas[at], np.atleast_1d(fit.intercepts[at]))
    return base.select("*", *(g.alias(f"resid_{k}") for k, g in enumerate(grads)))


def gradients(frame: FeatureFrame, response: Response, fit: PathResult) -> np.ndarray:
    """X' residuals for each value of the path, (path, p * K): one pass for all of them."""
    return GlmData(frame, response).along(fit.betas, fit.intercepts)[1]


def gradient_norms(grads: np.ndarray, fit: PathResult, constraints=None) -> np.ndarray:
    """Norm of each group's gradient less its ridge and constraint parts."""
    out = []
    for i, (g, b, lmda) in enumerate(zip(grads, fit.betas, fit.lmdas, strict=True)):
        left = g - lmda * (1 - fit.alpha) * np.repeat(fit.penalty, fit.sizes) * b
        for k, c in enumerate(constraints or []):
            if c is not None and i < len(fit.duals) and k in fit.duals[i]:
                at = slice(fit.starts[k], fit.starts[k] + fit.sizes[k])
                left[at] -= c.gradient(fit.duals[i][k])
        out.append(group_norms(left, fit.starts, fit.sizes))
    return np.array(out)


def gradient_scores(norms: np.ndarray, fit: PathResult) -> np.ndarray:
    """Norms over alpha * penalty; lambda where that is 0."""
    bound = fit.alpha * fit.penalty
    return np.where(bound > 0, norms / np.where(bound > 0, bound, 1.0), np.asarray(fit.lmdas)[:, None])


def coefficient(lmda: float, fit: PathResult) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts at any lambda, linear between neighbours, clamped with a warning outside."""
    lmdas = np.asarray(fit.lmdas)
    if len(lmdas) == 1 or not lmdas[-1] <= lmda <= lmdas[0]:
        if not lmdas[-1] <= lmda <= lmdas[0]:
            warnings.warn(f"{lmda} lies outside the path", stacklevel=2)
        at = 0 if lmda >= lmdas[0] else len(lmdas) - 1
        return fit.betas[at], fit.intercepts[at]
    hi = int(np.searchsorted(-lmdas, -lmda))
    if lmdas[hi] == lmda:
        return fit.betas[hi], fit.intercepts[hi]
    t = (lmdas[hi - 1] - lmda) / (lmdas[hi - 1] - lmdas[hi])
    return (1 - t) * fit.betas[hi - 1] + t * fit.betas[hi], (1 - t) * fit.intercepts[hi - 1] + t * fit.intercepts[hi]


class Diagnostic:
    """All diagnostics of a path; the ``*_table`` methods return what plots would show, as tidy tables."""

    def __init__(self, frame: FeatureFrame, response: Response, fit: PathResult, constraints=None):
        self.frame, self.response, self.fit = frame, response, fit
        self._score(gradients(frame, response, fit), constraints)

    def _score(self, grads: np.ndarray, constraints=None) -> None:
        self.gradients, fit = grads, self.fit
        self.gradient_norms = gradient_norms(self.gradients, fit, constraints)
        self.gradient_scores = gradient_scores(self.gradient_norms, fit)

    def linear_preds(self, *keep: str) -> DataFrame:
        return predict(self.frame, self.fit, *keep, offsets=self.response.offsets)

    def objective(self) -> np.ndarray:
        return objective(self.frame, self.response, self.fit)

    def coefficients_table(self, spark: SparkSession) -> DataFrame:
        return self.fit.tables(spark)["betas"]

    def devs_table(self, spark: SparkSession) -> DataFrame:
        return self.fit.tables(spark)["path"].select("lmda_idx", "lmda", "dev")

    def set_sizes_table(self, spark: SparkSession) -> DataFrame:
        return self.fit.tables(spark)["path"].select("lmda_idx", "lmda", "active_size", "screen_size")

    def benchmark_table(self, spark: SparkSession) -> DataFrame:
        return self.fit.tables(spark)["timings"]

    def kkt_table(self, spark: SparkSession) -> DataFrame:
        """(lmda_idx, group, score, lmda, active, ok): optimality of each group at each value."""
        rows = []
        for i, lmda in enumerate(self.fit.lmdas):
            norms = group_norms(self.fit.betas[i], self.fit.starts, self.fit.sizes)
            for g, s in enumerate(self.gradient_scores[i]):
                rows.append((i, g, float(s), float(lmda), bool(norms[g] > 0), bool(s <= lmda * (1 + 1e-4) + 1e-7)))
        return spark.createDataFrame(rows, "lmda_idx int, group int, score double, lmda double, active boolean, ok boolean")


class CovarianceDiagnostic(Diagnostic):
    """Diagnostics of a fit to 1/2 b'Ab - v'b: gradients are v - Ab, there are no rows."""

    def __init__(self, A: np.ndarray, v: np.ndarray, fit: PathResult, constraints=None):
        self.A, self.v, self.fit = np.asarray(A, float), np.asarray(v, float), fit
        self._score(self.v - fit.betas @ self.A, constraints)

    def linear_preds(self, *keep: str) -> DataFrame:
        raise TypeError("a covariance fit has no rows to predict")

    def objective(self) -> np.ndarray:
        pen = [lmda * penalty_value(b, self.fit.starts, self.fit.sizes, self.fit.penalty, self.fit.alpha) for lmda, b in zip(self.fit.lmdas, self.fit.betas, strict=True)]
        return np.array([0.5 * b @ self.A @ b - self.v @ b for b in self.fit.betas]) + np.array(pen)


def mean_response(frame: FeatureFrame, response: Response, fit: PathResult, at: int, *keep: str) -> DataFrame:
    """(keep..., mu_0 ...): inverse link of one value's predictors."""
    from ridgeline.functions.special import Columns

    K = fit.classes
    b, a = fit.betas[at].reshape(frame.p, K), np.atleast_1d(fit.intercepts[at])
    offsets = response.offsets or [None] * K
    etas = [frame.btmul(0, b[:, k], F.lit(float(a[k])) + (F.col(o).cast("double") if o else F.lit(0.0))) for k, o in enumerate(offsets)]  # no response is read
    mus = response.family.inv_link(etas if getattr(response.family, "multi", False) else etas[0], Columns)
    mus = mus if isinstance(mus, list) else [mus]
    assert not isinstance(response.family, Cox) or len(mus) == 1
    return frame.df.select(*keep, *(m.alias(f"mu_{k}") for k, m in enumerate(mus)))
