"""Column subset selection on a covariance matrix S."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.features import FeatureFrame
from ridgeline.operators.gram import cross

LOSSES = ("least_squares", "subset_factor", "min_det")
SMALL = 1e-10


def residual(S: np.ndarray, subset) -> np.ndarray:
    """Covariance of all columns after regression on those of ``subset``: rank-one downdates."""
    R = np.array(S, float)
    for j in subset:
        if R[j, j] > 0:
            R = R - np.outer(R[j], R[j]) / R[j, j]
    return R


def scores(R: np.ndarray, chosen: set[int], loss: str) -> np.ndarray:
    """What each column outside ``chosen`` would gain, on the residual covariance R."""
    d, out = np.diag(R), np.full(len(R), -np.inf)
    rest = [j for j in range(len(R)) if j not in chosen]
    for j in rest:
        if loss == "least_squares":
            out[j] = R[j] @ R[j] / d[j] if d[j] > SMALL else 0.0
        elif loss == "min_det":
            out[j] = -max(d[j], 0.0)
        else:
            left = np.array([d[i] - R[i, j] ** 2 / d[j] for i in rest if i != j]) if d[j] > 0 else np.zeros(1)
            out[j] = np.inf if d[j] <= 0 or (left <= SMALL).any() else -np.log(d[j]) - np.log(left).sum()
    return out


def loss_of(S: np.ndarray, subset, loss: str) -> float:
    """The loss itself: trace of the residual, log det S_T + sum log residuals, or det S_T."""
    subset = list(subset)
    R = residual(S, subset)
    rest = [i for i in range(len(S)) if i not in subset]
    if loss == "least_squares":
        return float(np.trace(R[np.ix_(rest, rest)]))
    sign, logdet = np.linalg.slogdet(np.asarray(S)[np.ix_(subset, subset)]) if subset else (1.0, 0.0)
    if loss == "min_det":
        return float(sign * np.exp(logdet))
    left = np.diag(R)[rest]
    return -np.inf if sign <= 0 or (left <= 0).any() else float(logdet + np.log(left).sum())


def css_cov(S: np.ndarray, subset_size: int | None = None, subset=None, method: str = "greedy", loss: str = "least_squares", max_cycles: int = 1000) -> list[int]:
    """``greedy`` adds the best column ``subset_size`` times; ``swapping`` replaces the members of ``subset`` in turn
    by the best column until a whole round keeps all of them."""
    S = np.asarray(S, float)
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}; one of {LOSSES}")
    if method == "greedy":
        chosen: list[int] = []
        R = S.copy()
        for _ in range(subset_size or 0):
            gain = scores(R, set(chosen), loss)
            best = int(np.argmax(gain))
            chosen.append(best)
            R = residual(R, [best])
        return chosen
    if method != "swapping":
        raise ValueError(f"unknown method {method!r}")
    chosen = list(range(subset_size)) if subset is None else [int(j) for j in subset]
    if not chosen:
        return chosen
    kept = 0
    for turn in range(max_cycles * len(chosen)):
        k = turn % len(chosen)
        others = chosen[:k] + chosen[k + 1 :]
        R = residual(S, others)
        gain = scores(R, set(others), loss)
        best = int(np.argmax(gain))
        if gain[chosen[k]] >= gain[best] - 1e-12 * max(1.0, abs(gain[best]) if np.isfinite(gain[best]) else 1.0) or gain[chosen[k]] == np.inf:
            kept += 1
        else:
            chosen[k], kept = best, 0
        if kept >= len(chosen):
            return chosen
    raise RuntimeError("max cycles reached")


#: Simulated values that one task draws.
BLOCK = 1000


def search(S: np.ndarray, seed: int, k: int, start: int) -> list[int]:
    """Best subset of ``k`` columns that swapping reaches from a random one, which ``seed``, ``k`` and ``start`` fix."""
    first = np.random.default_rng([seed, 0, k, start]).choice(len(S), k, replace=False).tolist()
    return css_cov(S, subset=first, method="swapping", loss="subset_factor")


def simulated(n: int, p: int, k: int, seed: int, block: int, size: int) -> np.ndarray:
    """``size`` values of the statistic under exact reconstruction from ``k`` columns, the ``block``-th ones.

    Columns left over are independent given the subset: residuals of one another by growing sets of regressors compare
    chi-square variables of j and n - k - j - 1 degrees of freedom (the mean takes one)."""
    rng = np.random.default_rng([seed, 1, k, block])
    stat = np.zeros(size)
    for j in range(1, p - k):
        inner = rng.chisquare(max(n - k - j - 1, 1), size)
        stat += np.log1p(rng.chisquare(j, size) / inner)
    return stat


@dataclass
class CSSModelSelection:
    """Smallest subset that a finite-sample test for Gaussian features doesn't reject.

    For k = 0, 1, ... the statistic of the best subset (swapping from ``n_inits`` random starts, subset-factor loss)
    is compared with the 1 - alpha quantile of its simulated law under exact reconstruction. ``fit`` takes second moments
    about 0, so columns should have mean 0. The first start that
    isn't rejected is taken. With a session, starts and blocks of simulated values are tasks that share the broadcast
    covariance, p x p numbers; draws are fixed by seed, k and number, so the choice is the same without one."""

    alpha: float
    n_inits: int = 1
    n_sims: int = 10_000
    seed: int | None = None
    subset_: list[int] | None = None

    def fit(self, frame: FeatureFrame) -> CSSModelSelection:
        full = cross(frame.df, [F.lit(1.0), *frame.columns])
        return self.fit_cov(full[1:, 1:] / full[0, 0], int(full[0, 0]), frame.df.sparkSession)

    def _blocks(self) -> list[int]:
        return [min(BLOCK, self.n_sims - at) for at in range(0, self.n_sims, BLOCK)]

    def _tasks(self, spark: SparkSession, S: np.ndarray, n: int, k: int, seed: int, starts: int) -> tuple[list[list[int]], np.ndarray]:
        """Subsets by start and simulated values, one task for each start and block."""
        shared, blocks, p = spark.sparkContext.broadcast(S), self._blocks(), len(S)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for job in (x for batch in batches for x in batch.column("id").to_pylist()):
                own = search(shared.value, seed, k, job) if job < starts else []
                drawn = [] if job < starts else simulated(n, p, k, seed, job - starts, blocks[job - starts])
                yield pa.RecordBatch.from_arrays([pa.array([job], pa.int64()), pa.array([own], pa.list_(pa.int32())), pa.array([list(drawn)], pa.list_(pa.float64()))], ["job", "subset", "drawn"])

        jobs = starts + len(blocks)
        rows = spark.range(0, jobs, 1, jobs).mapInArrow(run, "job long, subset array<int>, drawn array<double>").collect()
        shared.unpersist()
        rows.sort(key=lambda r: r["job"])
        return [list(r["subset"]) for r in rows[:starts]], np.concatenate([r["drawn"] for r in rows[starts:]])

    def fit_cov(self, S: np.ndarray, n: int, spark: SparkSession | None = None) -> CSSModelSelection:
        S = np.asarray(S, float)
        p = len(S)
        seed = int(np.random.default_rng().integers(1 << 62)) if self.seed is None else self.seed
        sign, logdet = np.linalg.slogdet(S)
        if sign <= 0:
            raise ValueError("S must be positive definite")
        for k in range(p):
            starts = 1 if k < 2 else self.n_inits
            if spark is None:
                found = (search(S, seed, k, i) for i in range(starts))
                drawn = np.concatenate([simulated(n, p, k, seed, b, size) for b, size in enumerate(self._blocks())])
            else:
                found, drawn = self._tasks(spark, S, n, k, seed, starts)
            limit, best = float(np.quantile(drawn, 1 - self.alpha)), (np.inf, [])
            for own in found:
                best = min(best, (loss_of(S, own, "subset_factor") - logdet, own))
                if best[0] <= limit:
                    break
            self.subset_ = best[1]
            if best[0] <= limit or k == p - 1:
                break
        return self

    def score(self, frame: FeatureFrame) -> float:
        """Minus the subset-factor loss of other rows."""
        full = cross(frame.df, [F.lit(1.0), *frame.columns])
        return -loss_of(full[1:, 1:] / full[0, 0], self.subset_, "subset_factor")
