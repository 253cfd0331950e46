"""Seeded simulated data sets: small ones with their matrices on the driver, and ``*_rows`` of any size, whose blocks of
``BLOCK`` rows are drawn on executors from streams that seed and block number fix, alike under any partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ridgeline.functions.glm import Response, family


#: Rows that one stream of random numbers makes.
BLOCK = 4096


def by_block(spark: SparkSession, n: int, seed: int, schema: str, draw: Callable[[np.ndarray, np.random.Generator], dict[str, np.ndarray]]) -> DataFrame:
    """``draw(row ids, generator)`` of each block of the rows 0 ... n - 1, as columns of ``schema``; no row gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in batch.column("id").to_pylist()):
            ids = np.arange(block * BLOCK, min(n, (block + 1) * BLOCK))
            yield pa.RecordBatch.from_pydict(draw(ids, np.random.Generator(np.random.Philox([seed, block]))))

    return spark.range(-(-n // BLOCK)).mapInArrow(run, schema)


def sample_response(eta: np.ndarray, name: str, snr: float, rng: np.random.Generator, variance: np.ndarray | float | None = None) -> dict[str, np.ndarray]:
    """Columns of a response of a family for linear predictors (n,) or (n, K). ``variance`` of the predictors sets the noise
    of Gaussian responses, that of ``eta`` if not given."""
    n = len(eta)
    if name in ("gaussian", "multigaussian"):
        noise = np.sqrt((np.var(eta, axis=0, keepdims=True) if variance is None else variance) / snr) if snr else 0.0
        y = eta + noise * rng.standard_normal(eta.shape)
        return {"y": y} if y.ndim == 1 else {f"y_{k}": y[:, k] for k in range(y.shape[1])}
    if name == "binomial":
        return {"y": (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)}
    if name == "poisson":
        return {"y": rng.poisson(np.exp(np.minimum(eta, 20))).astype(float)}
    if name == "multinomial":
        p = np.exp(eta - eta.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        at = (rng.random((n, 1)) > np.cumsum(p, axis=1)).sum(axis=1).clip(max=p.shape[1] - 1)
        return {f"y_{k}": (at == k).astype(float) for k in range(p.shape[1])}
    if name == "cox":
        stop = 1 + rng.integers(0, 20, n) + np.floor(rng.exponential(np.exp(-np.clip(eta, -5, 5))) * 5)
        return {"start": np.floor(stop * rng.random(n) * 0.5), "stop": stop, "status": rng.integers(0, 2, n).astype(float)}
    raise ValueError(f"unknown family {name!r}")


def _plan(p: int, G: int, K: int, equal_groups: bool, sparsity: float, zero_penalty: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first columns of groups, penalties, coefficients)."""
    starts = np.arange(G) * (p // G) if equal_groups else np.sort(np.concatenate([[0], rng.choice(np.arange(1, p), G - 1, replace=False)]))
    penalty = np.sqrt(np.diff([*starts, p])) * (rng.random(G) >= zero_penalty)
    return starts, penalty, rng.standard_normal((p, K)) * (rng.random((p, 1)) >= sparsity)


def _described(df: DataFrame, names: list[str], ys: list[str], glm: str, starts: np.ndarray, penalty: np.ndarray, beta: np.ndarray) -> dict:
    response = Response(family(glm), start="start", stop="stop", status="status") if glm == "cox" else Response(family(glm), tuple(ys))
    return {"df": df, "X": names, "beta": beta, "response": response, "groups": starts.tolist(), "group_sizes": np.diff([*starts, len(names)]).tolist(), "penalty": penalty}


def dense(spark: SparkSession, n: int, p: int, G: int, K: int = 1, glm: str = "gaussian", equal_groups: bool = False, rho: float = 0.0, sparsity: float = 0.95, zero_penalty: float = 0.0, snr: float = 1.0, seed: int = 0) -> dict:
    """Equi-correlated columns, random groups, sparse coefficients and a response; see the keys of the result."""
    rng = np.random.default_rng(seed)
    x = np.sqrt(rho) * rng.standard_normal((n, 1)) + np.sqrt(1 - rho) * rng.standard_normal((n, p))
    starts, penalty, beta = _plan(p, G, K, equal_groups, sparsity, zero_penalty, rng)
    eta = x @ beta
    y = sample_response(eta[:, 0] if K == 1 else eta, glm, snr, rng)
    names = [f"x_{j}" for j in range(p)]
    rows = [(i, *map(float, x[i]), *(float(v[i]) for v in y.values())) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(["row_id long", *(f"{c} double" for c in [*names, *y])]))
    return _described(df, names, list(y), glm, starts, penalty, beta) | {"x": x}


def dense_rows(spark: SparkSession, n: int, p: int, G: int, K: int = 1, glm: str = "gaussian", equal_groups: bool = False, rho: float = 0.0, sparsity: float = 0.95, zero_penalty: float = 0.0, snr: float = 1.0, seed: int = 0) -> dict:
    """As ``dense`` without ``x``: the driver draws p coefficients, executors the rows. The noise of Gaussian responses
    follows from the variance that the coefficients imply."""
    starts, penalty, beta = _plan(p, G, K, equal_groups, sparsity, zero_penalty, np.random.default_rng([seed, 1]))
    variance = (1 - rho) * (beta**2).sum(axis=0) + rho * beta.sum(axis=0) ** 2
    names = [f"x_{j}" for j in range(p)]

    def draw(ids: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        x = np.sqrt(rho) * rng.standard_normal((len(ids), 1)) + np.sqrt(1 - rho) * rng.standard_normal((len(ids), p))
        eta = x @ beta
        y = sample_response(eta[:, 0] if K == 1 else eta, glm, snr, rng, variance[0] if K == 1 else variance)
        return {"row_id": ids} | dict(zip(names, x.T, strict=True)) | y

    ys = list(sample_response(np.zeros(1) if K == 1 else np.zeros((1, K)), glm, snr, np.random.default_rng(0)))
    df = by_block(spark, n, seed, ", ".join(["row_id long", *(f"{c} double" for c in [*names, *ys])]), draw)
    return _described(df, names, ys, glm, starts, penalty, beta)


def snp_unphased(spark: SparkSession, n: int, p: int, one_ratio: float = 0.25, two_ratio: float = 0.05, missing_ratio: float = 0.1, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Long calls and the (n, p) matrix they come from, missing as -9."""
    rng = np.random.default_rng(seed)
    u = rng.random((n, p))
    x = np.where(u < two_ratio, 2, np.where(u < two_ratio + one_ratio, 1, 0)).astype(np.int8)
    x[rng.random((n, p)) < missing_ratio] = -9
    rows = [(i, j, None if x[i, j] < 0 else int(x[i, j])) for i in range(n) for j in range(p)]
    return spark.createDataFrame(rows, "row_id long, snp int, call int"), x


def snp_phased_ancestry(spark: SparkSession, n: int, s: int, A: int, one_ratio: float = 0.25, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Long haplotype calls with ancestries and the (n, 2s) arrays they come from."""
    rng = np.random.default_rng(seed)
    calls, anc = (rng.random((n, 2 * s)) < one_ratio).astype(np.int8), rng.integers(0, A, (n, 2 * s)).astype(np.int8)
    rows = [(i, j // 2, j % 2, int(calls[i, j]), int(anc[i, j])) for i in range(n) for j in range(2 * s)]
    return spark.createDataFrame(rows, "row_id long, snp int, hap int, call int, ancestry int"), calls, anc


def snp_unphased_rows(spark: SparkSession, n: int, p: int, one_ratio: float = 0.25, two_ratio: float = 0.05, missing_ratio: float = 0.1, seed: int = 0) -> DataFrame:
    """Long calls (row_id, snp, call) as of ``snp_unphased``, drawn on executors; missing calls are null."""

    def draw(ids: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        u, missing = rng.random(len(ids) * p), rng.random(len(ids) * p) < missing_ratio
        call = (u < two_ratio).astype(np.int32) + (u < two_ratio + one_ratio)
        return {"row_id": np.repeat(ids, p), "snp": np.tile(np.arange(p, dtype=np.int32), len(ids)), "call": pa.array(call.astype(np.int32), mask=missing)}

    return by_block(spark, n, seed, "row_id long, snp int, call int", draw)


def snp_phased_ancestry_rows(spark: SparkSession, n: int, s: int, A: int, one_ratio: float = 0.25, seed: int = 0) -> DataFrame:
    """Long haplotype calls with ancestries as of ``snp_phased_ancestry``, drawn on executors."""

    def draw(ids: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        at = np.tile(np.arange(2 * s, dtype=np.int32), len(ids))
        call, ancestry = (rng.random(len(at)) < one_ratio).astype(np.int32), rng.integers(0, A, len(at), dtype=np.int32)
        return {"row_id": np.repeat(ids, 2 * s), "snp": at // 2, "hap": at % 2, "call": call, "ancestry": ancestry}

    return by_block(spark, n, seed, "row_id long, snp int, hap int, call int, ancestry int", draw)
