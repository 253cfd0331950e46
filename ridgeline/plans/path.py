"""Regularisation paths: executors reduce rows to statistics, the driver descends on p-sized problems.

Gaussian fits need one pass over the rows (weighted means and comoments). Other families take one pass per reweighting
step (Cox fits two, over rows in order of time): each task computes gradient and curvature of its rows from the current
coefficients and sums their products with the columns. With many columns a step reads the screened ones only, and one more pass per value takes the gradient of
all, the optimality check. Columns are taken about their means, so that nothing cancels for those far from 0. Steps are
Newton's, so few are needed."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import cox
from ridgeline.functions.glm import Cox, Response
from ridgeline.functions.risksets import RiskSets, sums_of
from ridgeline.functions.special import Columns
from ridgeline.operators.features import FeatureFrame
from ridgeline.operators.comoments import Comoments, TiledComoments, comoments, tiles
from ridgeline.operators.gram import NATIVE_SUMS, by_position, cross, refuse, sound, weighted_sums
from ridgeline.plans import bcd
from ridgeline.plans.qp import search_pivot

LOG = logging.getLogger("ridgeline")


# --- building blocks ------------------------------------------------------------------------------------
def group_sizes(starts: Sequence[int], p: int) -> list[int]:
    return np.diff([*starts, p]).tolist()


def default_penalty(sizes: Sequence[int]) -> np.ndarray:
    return np.sqrt(np.asarray(sizes, float))


def lambda_max(norms: np.ndarray, penalty: np.ndarray, alpha: float) -> float:
    """Smallest value at which every penalised group is 0."""
    live = penalty > 0
    return float(np.max(norms[live] / penalty[live], initial=0.0) / (alpha if alpha > 0 else 1e-3))


def lambda_path(largest: float, min_ratio: float, size: int) -> np.ndarray:
    if size <= 1:
        return np.full(size, largest)
    return largest * np.exp(np.log(min_ratio) * np.arange(size) / (size - 1))


def group_norms(grad: np.ndarray, starts, sizes) -> np.ndarray:
    return np.array([np.linalg.norm(grad[b : b + s]) for b, s in zip(starts, sizes, strict=True)])


def penalty_value(beta, starts, sizes, penalty, alpha) -> float:
    norms = group_norms(np.asarray(beta), starts, sizes)
    return float(np.sum(penalty * norms * (alpha + 0.5 * (1 - alpha) * norms)))


def strong_rule(norms, penalty, alpha, lmda, lmda_next) -> np.ndarray:
    return norms > (2 * lmda_next - lmda) * alpha * penalty


def pivot_rule(norms, penalty, alpha, lmda, screened: set[int], n_new: int, ratio: float = 0.1, least: int = 1, slack: float = 1.25) -> list[int]:
    """Groups whose scores lie beyond the bend of the largest scores, and some more below it."""
    if not n_new:
        return []
    score = np.where(penalty > 0, np.minimum(norms / np.where(penalty > 0, penalty, 1.0), alpha * lmda), alpha * lmda)
    order = np.argsort(score, kind="stable")
    top = min(max(int(len(screened) * (1 + ratio)), least), len(order))
    at = len(order) - top + search_pivot(np.arange(top), score[order[len(order) - top :]])[0]
    out = [int(g) for g in order[at:][::-1] if int(g) not in screened]
    below = [int(g) for g in order[:at][::-1] if int(g) not in screened]
    return out + below[: int(np.ceil(slack * n_new))]


def kkt_violations(norms, penalty, alpha, lmda, screened: set[int]) -> list[int]:
    return [g for g in np.flatnonzero(norms > lmda * penalty * alpha).tolist() if g not in screened]


class Quadratic:
    """1/2 b'Ab - v'b + lambda sum_g w_g (alpha |b_g| + (1 - alpha)/2 |b_g|^2) under group constraints, by block
    descent in each group's eigenbasis; sweeps over active groups alternate with sweeps over all given ones."""

    def __init__(self, A, starts, sizes, penalty, alpha, constraints=None, newton_tol: float = 1e-12):
        self.A, self.starts, self.sizes, self.penalty, self.alpha = A, list(starts), list(sizes), np.asarray(penalty, float), alpha
        self.constraints = constraints or [None] * len(self.starts)
        self.eig: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def spectrum(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        if g not in self.eig:
            at = slice(self.starts[g], self.starts[g] + self.sizes[g])
            values, vectors = np.linalg.eigh(self.A[at, at])
            self.eig[g] = np.maximum(values, 0.0), vectors
        return self.eig[g]

    def solve(self, v, lmda: float, beta, duals: dict[int, np.ndarray], groups: Sequence[int], tol: float = 1e-14, max_iters: int = 100_000):
        """(beta, sweeps); duals are updated in place. Groups outside ``groups`` keep their values."""
        beta = beta.copy()
        grad = v - self.A @ beta

        def visit(g: int) -> float:
            at = slice(self.starts[g], self.starts[g] + self.sizes[g])
            values, vectors = self.spectrum(g)
            old = beta[at]
            l1, l2 = lmda * self.alpha * self.penalty[g], lmda * (1 - self.alpha) * self.penalty[g]
            linear = vectors.T @ grad[at] + values * (vectors.T @ old)
            if self.constraints[g] is None:
                if len(old) == 1:
                    d = values[0] + l2
                    x = np.array([np.sign(linear[0]) * max(abs(linear[0]) - l1, 0.0) / d if d > 0 else 0.0])
                elif l1 <= 0:
                    d = values + l2
                    x = np.where(d > 1e-12 * max(1.0, values[-1]), linear / np.where(d > 0, d, 1.0), 0.0)
                else:
                    # directions without curvature can't carry a gradient; round-off there would look unbounded
                    x = bcd.solve(values, np.where(values + l2 > 1e-12 * max(1e-300, values[-1] + l2), linear, 0.0), l1, l2)
            else:
                x, duals[g] = self.constraints[g].solve(values, linear, l1, l2, vectors)
            step = vectors @ x - old
            if np.max(np.abs(step), initial=0.0) <= 1e-15 * max(1.0, np.max(np.abs(old), initial=0.0)):
                return 0.0
            beta[at] += step
            moved = self.A[:, at] @ step
            grad[:] -= moved
            return float(step @ moved[at]) / len(old)

        n = 0
        while n < max_iters:
            n += 1
            if max((visit(g) for g in groups), default=0.0) <= tol:
                return beta, n
            active = [g for g in groups if np.any(beta[self.starts[g] : self.starts[g] + self.sizes[g]])]
            while n < max_iters:
                n += 1
                if max((visit(g) for g in active), default=0.0) <= tol:
                    break
        raise RuntimeError(f"no convergence within {max_iters} sweeps at lambda {lmda:.6g}")


@dataclass
class PathResult:
    """What a fit returns. ``betas`` is (path, p * K), feature j and class k at j * K + k; ``error`` tells why a path
    ended early, the values before it are valid."""

    lmdas: np.ndarray
    betas: np.ndarray
    intercepts: np.ndarray
    devs: np.ndarray
    names: list[str]
    starts: list[int]
    sizes: list[int]
    penalty: np.ndarray
    alpha: float
    classes: int = 1
    lmda_max: float = 0.0
    loss_null: float = 0.0
    loss_full: float = 0.0
    duals: list[dict[int, np.ndarray]] = field(default_factory=list)
    grads: np.ndarray | None = None
    screen_sizes: list[int] = field(default_factory=list)
    timings: list[dict] = field(default_factory=list)
    error: str = ""
    total_time: float = 0.0

    @property
    def active_sizes(self) -> list[int]:
        return [int(np.sum(group_norms(b, self.starts, self.sizes) > 0)) for b in self.betas]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """path, betas (non-zero), duals and timings as tables."""
        k = self.classes
        path = [(i, float(self.lmdas[i]), float(self.devs[i]), [float(x) for x in np.atleast_1d(self.intercepts[i])], a, s) for i, (a, s) in enumerate(zip(self.active_sizes, self.screen_sizes, strict=True))]
        betas = [(i, int(j // k), self.names[j // k], int(j % k), float(self.betas[i, j])) for i in range(len(self.lmdas)) for j in np.flatnonzero(self.betas[i])]
        duals = [(i, int(g), d, float(x)) for i, own in enumerate(self.duals) for g, mu in own.items() for d, x in enumerate(mu) if x]
        times = [(i, t["screen"], t["fit"], t["kkt"], t["valid"]) for i, t in enumerate(self.timings)]
        return {
            "path": spark.createDataFrame(path, "lmda_idx int, lmda double, dev double, intercept array<double>, active_size int, screen_size int"),
            "betas": spark.createDataFrame(betas, "lmda_idx int, feature_idx int, feature string, class int, beta double"),
            "duals": spark.createDataFrame(duals, "lmda_idx int, group int, dual_idx int, mu double"),
            "timings": spark.createDataFrame(times, "iter int, screen_s double, fit_s double, kkt_s double, valid boolean"),
        }

    def check(self, tol: float = 1e-6) -> None:
        """Invariants of a path; raises AssertionError."""
        assert len(self.lmdas) == len(self.betas) == len(self.devs) == len(self.intercepts)
        assert (np.diff(self.lmdas) <= 1e-12).all() and (np.diff(self.devs) >= -tol).all()
        assert sum(self.sizes) == self.betas.shape[1] if len(self.betas) else True
        if self.grads is not None:
            for b, g, lam, mu in zip(self.betas, self.grads, self.lmdas, self.duals, strict=True):
                for i, (at, s) in enumerate(zip(self.starts, self.sizes, strict=True)):
                    if i in mu:
                        continue
                    left = g[at : at + s] - lam * (1 - self.alpha) * self.penalty[i] * b[at : at + s]
                    norm, bound = np.linalg.norm(left), lam * self.alpha * self.penalty[i]
                    assert norm <= bound + tol, (i, norm, bound)
                    if np.any(b[at : at + s]):
                        assert abs(norm - bound) <= tol


#: Classes times curved columns up to which the curvature between classes is summed too; beyond it, a majoriser is.
NEWTON_MOST = 400
#: Running sums up to which a Cox step has the full curvature, as with 64 columns.
COX_MOST = 2200


@dataclass
class Options:
    """``lmda_path``: values, or what gives them from the largest one that matters. ``missing``: rows with null or non-finite values ``raise`` or are dropped. ``pivot_*``: how many of the largest
    scores the pivot rule looks at, and how many groups below the bend it adds. ``check_state`` checks the path's
    invariants at its end; ``progress`` is called with (index, lambda, deviance) after each value. ``newton_most`` and
    ``cox_most``: classes times curved columns, and sums per event time, up to which a step uses the full curvature; a
    larger problem takes more steps with its diagonal to the same optimum."""

    alpha: float = 1.0
    penalty: Sequence[float] | None = None
    lmda_path: Sequence[float] | Callable | None = None
    lmda_path_size: int = 100
    min_ratio: float = 1e-2
    intercept: bool = True
    early_exit: bool = True
    adev_tol: float = 0.9
    ddev_tol: float = 0.0
    tol: float = 1e-14
    irls_tol: float = 1e-10
    irls_max_iters: int = 100
    max_iters: int = 100_000
    max_active_size: int | None = None
    max_screen_size: int | None = None
    screen_rule: str = "pivot"
    exit_cond: Callable | None = None
    constraints: Sequence | None = None
    warm_start: PathResult | None = None
    missing: str = "raise"
    pivot_subset_ratio: float = 0.1
    pivot_subset_min: int = 1
    pivot_slack_ratio: float = 1.25
    check_state: bool = False
    progress: Callable | None = None
    newton_most: int = NEWTON_MOST
    cox_most: int = COX_MOST

    def __post_init__(self):
        if self.screen_rule not in ("pivot", "strong"):
            raise ValueError(f"unknown screen rule {self.screen_rule!r}")
        if self.missing not in ("raise", "drop"):
            raise ValueError(f"missing must be raise or drop, not {self.missing!r}")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must lie in [0, 1]")


def run_path(local: Callable, starts, sizes, names, classes: int, null_loss: float, full_loss: float, options: Options, start: np.ndarray | None = None) -> PathResult:
    """The path over values of lambda. ``local(beta, intercepts, lmda, groups, duals)`` fits one value over the given
    groups and returns (beta, intercepts, full gradient, deviance share, sweeps)."""
    began = time.time()
    p = sum(sizes)
    penalty = default_penalty(sizes) if options.penalty is None else np.asarray(options.penalty, float)
    if len(penalty) != len(sizes):
        raise ValueError("penalty must name one number per group")
    constraints = options.constraints or [None] * len(sizes)
    beta, inter, duals = np.zeros(p), np.zeros(classes), {}
    free = {g for g in range(len(sizes)) if penalty[g] <= 0}
    screened = set(free)
    out = PathResult(np.zeros(0), np.zeros((0, p)), np.zeros((0, classes)), np.zeros(0), list(names), list(starts), list(sizes), penalty, options.alpha, classes, loss_null=null_loss, loss_full=full_loss)
    kept = {"lmdas": [], "betas": [], "intercepts": [], "devs": [], "grads": []}

    def norms_of(grad, beta, lmda):
        left = grad.copy()
        for g in screened:
            at = slice(starts[g], starts[g] + sizes[g])
            left[at] -= lmda * (1 - options.alpha) * penalty[g] * beta[at]
            if constraints[g] is not None and g in duals:
                left[at] -= constraints[g].gradient(duals[g])
        norms = group_norms(left, starts, sizes)
        for g, c in enumerate(constraints):
            if c is not None and g not in screened:
                norms[g] = c.solve_zero(grad[starts[g] : starts[g] + sizes[g]])[0]
        return norms

    try:
        if options.warm_start is not None and len(options.warm_start.betas):
            beta, inter = options.warm_start.betas[-1].copy(), np.atleast_1d(options.warm_start.intercepts[-1]).astype(float).copy()
            screened |= {g for g in range(len(sizes)) if np.any(beta[starts[g] : starts[g] + sizes[g]])}
        # a fit at an all but infinite value leaves unpenalised groups only, and gives the largest value of the path
        huge = 1e30
        beta0, inter0, grad, _, _ = local(np.where(np.isin(np.repeat(np.arange(len(sizes)), sizes), list(free)), beta, 0.0), inter, huge, sorted(free), duals)
        norms = norms_of(grad, beta0, 0.0)
        out.lmda_max = lambda_max(norms, penalty, options.alpha)
        given = options.lmda_path(out.lmda_max) if callable(options.lmda_path) else options.lmda_path
        values = lambda_path(out.lmda_max, options.min_ratio, options.lmda_path_size) if given is None else np.sort(np.asarray(given, float))[::-1]
        if options.warm_start is None:
            beta, inter = beta0, inter0
        lmda, n_active = out.lmda_max, 0
        for value in values:
            t = {"screen": 0.0, "fit": 0.0, "kkt": 0.0, "valid": True}
            s = time.time()
            new = {g for g in np.flatnonzero(strong_rule(norms, penalty, options.alpha, max(lmda, value), value)).tolist()} if options.screen_rule == "strong" else set()
            if options.screen_rule == "pivot":
                active = sum(bool(np.any(beta[starts[g] : starts[g] + sizes[g]])) for g in screened)
                new = set(pivot_rule(norms, penalty, options.alpha, value, screened, max(active - n_active, int(not kept["lmdas"])), options.pivot_subset_ratio, options.pivot_subset_min, options.pivot_slack_ratio))
                n_active = active
            screened |= new
            t["screen"] = time.time() - s
            while True:
                if options.max_screen_size is not None and len(screened) > options.max_screen_size:
                    raise RuntimeError(f"{len(screened)} screened groups are more than the {options.max_screen_size} allowed")
                s = time.time()
                beta, inter, grad, dev, _ = local(beta, inter, float(value), sorted(screened), duals)
                t["fit"] += time.time() - s
                s = time.time()
                norms = norms_of(grad, beta, value)
                missed = kkt_violations(norms - 1e-12, penalty, options.alpha, value, screened)
                t["kkt"] += time.time() - s
                if not missed:
                    break
                screened |= set(missed)
            active = sum(bool(np.any(beta[b : b + s])) for b, s in zip(starts, sizes, strict=True))
            if options.max_active_size is not None and active > options.max_active_size:
                raise RuntimeError("max active size reached")
            for k, x in zip(kept, (value, beta.copy(), np.array(inter), dev, grad.copy()), strict=True):
                kept[k].append(x)
            out.duals.append({g: mu.copy() for g, mu in duals.items() if np.any(mu)})
            out.screen_sizes.append(len(screened))
            out.timings.append(t)
            lmda = value
            if options.progress is not None:
                options.progress(len(kept["lmdas"]) - 1, float(value), float(dev))
            if options.exit_cond is not None and options.exit_cond(kept):
                break
            if options.early_exit and (dev >= options.adev_tol or len(kept["devs"]) > 1 and abs(dev - kept["devs"][-2]) < options.ddev_tol):
                break
    except RuntimeError as e:  # a limit of ``options``; all other errors are the caller's
        if not kept["lmdas"]:
            raise
        out.error = str(e)
        LOG.warning("path ended early: %s", e)
    if kept["lmdas"]:
        out.lmdas, out.betas, out.intercepts, out.devs, out.grads = (np.array(kept[k]) for k in kept)
    out.total_time = time.time() - began
    if options.check_state:
        out.check(1e-5)
    return out


# --- gaussian -------------------------------------------------------------------------------------------
def _inputs(frame: FeatureFrame, response: Response) -> tuple[list[Column], Column]:
    """Every column that a fit reads, and the weight."""
    r = response
    names = [*r.y, *r.offsets, *(x for x in (r.start, r.stop, r.status) if x)]
    return [*frame.columns, *(F.col(x) for x in names)], F.lit(1.0) if r.weight is None else F.col(r.weight).cast("double")


def complete(frame: FeatureFrame, response: Response) -> FeatureFrame:
    """The frame without rows that are not ``sound``."""
    values, w = _inputs(frame, response)
    return replace(frame, df=frame.df.where(sound(values, w)))


def statistics_of(m: Comoments, p: int) -> dict:
    """What a gaussian fit needs, from comoments of p columns and the responses: means (``x``, ``y``), products about
    them (``cxx``, ``cxy``, ``cyy``) and about 0 (``xx``, ``xy``, ``yy``), all under weights that sum to 1."""
    about, raw = m.about / (m.weight or 1.0), m.raw() / (m.weight or 1.0)
    cut = {"xx": np.s_[:p, :p], "xy": np.s_[:p, p:], "yy": np.s_[p:, p:]}
    return {"x": m.mean[:p], "y": m.mean[p:]} | {k: raw[at] for k, at in cut.items()} | {"c" + k: about[at] for k, at in cut.items()}


def gaussian_columns(frame: FeatureFrame, response: Response) -> tuple[list[Column], Column]:
    """(columns, responses less offsets) and the weight."""
    offsets = response.offsets or [None] * len(response.y)
    ys = [F.col(y).cast("double") - (F.col(o).cast("double") if o else F.lit(0.0)) for y, o in zip(response.y, offsets, strict=True)]
    return [*frame.columns, *ys], _inputs(frame, response)[1]


def gaussian_statistics(frame: FeatureFrame, response: Response) -> dict:
    """Means and products of columns and responses, see ``statistics_of``: one pass."""
    columns, w = gaussian_columns(frame, response)
    return statistics_of(comoments(frame.df, columns, w, strict=True), frame.p)


def gaussian_from_statistics(stats: dict, names, starts=None, options: Options | None = None) -> PathResult:
    """A path from the statistics alone; several responses share groups of one feature's K coefficients. Statistics without
    products about the means get them from those about 0, which loses digits where means are large."""
    options = options or Options()
    if "cxx" not in stats:
        x, y = stats["x"], stats["y"]
        stats = stats | {"cxx": stats["xx"] - np.outer(x, x), "cxy": stats["xy"] - np.outer(x, y), "cyy": stats["yy"] - np.outer(y, y)}
    p, K = stats["xy"].shape
    starts = list(range(p)) if starts is None else list(starts)
    sizes = [s * K for s in group_sizes(starts, p)]
    starts = [b * K for b in starts]
    c = "c" if options.intercept else ""
    A1, v = stats[c + "xx"], (stats[c + "xy"] / K).ravel()
    A = np.kron(A1, np.eye(K)) / K if K > 1 else A1
    y_var = float(np.trace(stats[c + "yy"])) / K
    penalty = default_penalty(sizes) if options.penalty is None else np.asarray(options.penalty, float)
    quadratic = Quadratic(A, starts, sizes, penalty, options.alpha, options.constraints)

    def local(beta, inter, lmda, groups, duals):
        beta, n = quadratic.solve(v, lmda, beta, duals, groups, options.tol * max(y_var, 1e-300), options.max_iters)
        fitted = 2 * v @ beta - beta @ A @ beta
        inter = stats["y"] - stats["x"] @ beta.reshape(p, K) if options.intercept else np.zeros(K)
        return beta, inter, v - A @ beta, fitted / y_var if y_var > 0 else 0.0, n

    null = -0.5 * float(np.sum(stats["y"] ** 2)) / K if options.intercept else 0.0
    return run_path(local, starts, sizes, names, K, null, -0.5 * float(np.trace(stats["yy"])) / K, options)


#: Columns from which a gaussian fit leaves its matrix on the executors.
TILED = 4096


def gaussian_tiled(frame: FeatureFrame, response: Response, options: Options | None = None) -> PathResult:
    """A gaussian path whose matrix stays a stored table of tiles: one pass over the rows, then the driver asks for the
    columns of newly screened groups and holds no other part. Agrees with ``gaussian_from_statistics``."""
    options, p, K = options or Options(), frame.p, len(response.y)
    from ridgeline.sources.storage import Stored

    columns, w = gaussian_columns(frame, response)
    store = Stored(frame.df.sparkSession, "tiles")
    matrix = TiledComoments(store.put(tiles(frame.df, columns, w, strict=True))[0], p + K)
    weight, mean, var = matrix.head()
    weight = weight or 1.0
    about_y = matrix.columns(range(p, p + K)) / weight
    x, y, centred = mean[:p], mean[p:], options.intercept
    v = ((about_y[:p] if centred else about_y[:p] + np.outer(x, y)) / K).ravel()
    yy = about_y[p:] + np.outer(y, y)
    y_var = float(np.trace(about_y[p:] if centred else yy)) / K
    first = frame.group_starts()
    starts, sizes = [b * K for b in first], [s * K for s in group_sizes(first, p)]
    penalty = default_penalty(sizes) if options.penalty is None else np.asarray(options.penalty, float)
    kept: dict[int, np.ndarray] = {}

    def local(beta, inter, lmda, groups, duals):
        own = sorted({j // K for g in groups for j in range(starts[g], starts[g] + sizes[g])})
        new = [j for j in own if j not in kept]
        if new:
            found = matrix.columns(new)[:p] / weight
            kept.update((j, found[:, n] if centred else found[:, n] + x * x[j]) for n, j in enumerate(new))
        rows = np.column_stack([kept[j] for j in own]) if own else np.zeros((p, 0))
        A = np.kron(rows[own], np.eye(K)) / K
        flat = np.array([j * K + k for j in own for k in range(K)], int)
        sub_starts = [int(np.searchsorted(flat, starts[g])) for g in groups]
        cons = [options.constraints[g] for g in groups] if options.constraints else None
        quadratic = Quadratic(A, sub_starts, [sizes[g] for g in groups], penalty[groups], options.alpha, cons)
        sub = {i: duals[g] for i, g in enumerate(groups) if g in duals}
        b, n = quadratic.solve(v[flat], lmda, beta[flat], sub, range(len(groups)), options.tol * max(y_var, 1e-300), options.max_iters) if len(flat) else (beta[flat], 0)
        duals.update({groups[i]: mu for i, mu in sub.items()})
        beta = beta.copy()
        beta[flat] = b
        moved = (rows @ b.reshape(len(own), K)).ravel() / K
        fitted = float(2 * v @ beta - beta @ moved)
        inter = y - x @ beta.reshape(p, K) if options.intercept else np.zeros(K)
        return beta, inter, v - moved, fitted / y_var if y_var > 0 else 0.0, n

    null = -0.5 * float(np.sum(y**2)) / K if options.intercept else 0.0
    return run_path(local, starts, sizes, frame.names, K, null, -0.5 * float(np.trace(yy)) / K, options)


def gaussian_cov(A: np.ndarray, v: np.ndarray, starts=None, options: Options | None = None, rdev_tol: float = 1e-3) -> PathResult:
    """1/2 b'Ab - v'b + penalty without intercept; ends early when the fit gains less than a share ``rdev_tol``."""
    options = options or Options(intercept=False)
    p = len(v)
    starts = list(range(p)) if starts is None else list(starts)
    sizes = group_sizes(starts, p)
    penalty = default_penalty(sizes) if options.penalty is None else np.asarray(options.penalty, float)
    quadratic = Quadratic(np.asarray(A, float), starts, sizes, penalty, options.alpha, options.constraints)

    def local(beta, inter, lmda, groups, duals):
        beta, n = quadratic.solve(v, lmda, beta, duals, groups, options.tol, options.max_iters)
        return beta, inter, v - A @ beta, float(2 * v @ beta - beta @ A @ beta), n

    def stop(kept):
        d = kept["devs"]
        return options.early_exit and len(d) > 1 and d[-1] > 0 and (d[-1] - d[-2]) <= rdev_tol * d[-1]

    return run_path(local, starts, sizes, [f"x_{j}" for j in range(p)], 1, 0.0, 0.0, replace(options, early_exit=False, exit_cond=options.exit_cond or stop))


def pin_solve(A, v, lmdas, screen: Sequence[int], starts=None, penalty=None, alpha: float = 1.0, constraints=None, tol: float = 1e-14) -> np.ndarray:
    """Coefficients along ``lmdas`` over a fixed set of groups, warm from one value to the next."""
    p = len(v)
    starts = list(range(p)) if starts is None else list(starts)
    sizes = group_sizes(starts, p)
    q = Quadratic(np.asarray(A, float), starts, sizes, default_penalty(sizes) if penalty is None else penalty, alpha, constraints)
    beta, out = np.zeros(p), []
    for lmda in lmdas:
        beta, _ = q.solve(np.asarray(v, float), lmda, beta, {}, sorted(screen), tol)
        out.append(beta)
    return np.array(out)


# --- generalised linear models --------------------------------------------------------------------------
@dataclass
class Ask:
    """Coefficients at which derivatives are wanted: the gradient for ``columns``, which hold all that aren't 0, and the
    curvature for ``curved`` ones among them. Rows of ``fold`` don't count, all weights are times ``scale``."""

    beta: np.ndarray
    inter: np.ndarray
    columns: Sequence[int]
    curved: Sequence[int]
    fold: int | None = None
    scale: float = 1.0
    slopes: bool = True  # Cox only: without them, the loss alone


def moments(base: DataFrame, family, K: int, asks: Sequence[Ask], offsets: bool, most: int = NEWTON_MOST, tasks: int | None = None) -> list[dict]:
    """One pass over ``base(x..., y..., o..., w, fold...)`` for all ``asks``: per ask the sums of each class's gradient with
    1 (``g0``) and the columns (``g``), of the curvature between classes with 1 and the products of the curved columns
    (``H``), and of the ``loss``.

    Only columns that an ask names are read. Coefficients travel with the task and not in the plan, so steps over equal
    columns share one plan and its generated code."""
    multi, folds = getattr(family, "multi", False), any(a.fold is not None for a in asks)
    read = sorted({j for a in asks for j in a.columns})
    place = {j: k + 1 for k, j in enumerate(read)}
    work = []
    for a in asks:
        c = np.array([0, *(place[k] for k in a.curved)])
        newton = K * len(c) <= most
        pairs = [(k, m) for k in range(K) for m in range(k, K) if k == m or multi and newton and hasattr(family, "curvature")]
        at = np.array([0, *(place[k] for k in a.columns)])
        coefficients = np.vstack([a.inter, np.asarray(a.beta).reshape(-1, K)[list(a.columns)].reshape(-1, K)])
        work.append((at, c, pairs, coefficients, a.fold, a.scale))
    q, n_y = len(read), K if multi else 1

    def partial(cols: list[np.ndarray]) -> np.ndarray:
        n, out = len(cols[-1]), []
        X, ys = np.column_stack([np.ones(n), *cols[:q]]), cols[q : q + n_y]
        os, w0 = cols[q + n_y : q + n_y + K] if offsets else None, cols[-2 if folds else -1]
        for at, c, pairs, coefficients, fold, scale in work:
            w = w0 * scale if fold is None else np.where(cols[-1] == fold, 0.0, w0 * scale)
            x = X if len(at) == q + 1 else X[:, at]
            eta = x @ coefficients
            etas = [eta[:, k] + (os[k] if os else 0.0) for k in range(K)]
            args = (ys, etas, w) if multi else (ys[0], etas[0], w)
            with np.errstate(all="ignore"):
                g, h, loss = family.gradient(*args), family.hessian(*args), family.loss(*args)
                between = family.curvature(etas, w) if len(pairs) > K else None
            xc = X[:, c]
            weights = [between[i][j] if between else h[i] if multi else h for i, j in pairs]
            out += [(x.T @ (np.column_stack(g) if multi else g[:, None])).ravel(), *((xc.T @ (xc * v[:, None])).ravel() for v in weights), [loss.sum()]]
        return np.concatenate(out)

    sizes = [len(at) * K + len(pairs) * len(c) ** 2 + 1 for at, c, pairs, *_ in work]
    table = base.select(*(f"x{j}" for j in read), *(f"y{k}" for k in range(n_y)), *(f"o{k}" for k in range(K) if offsets), "w", *(["fold"] if folds else []))
    flat, found = by_position(table, sum(sizes), partial, tasks), []
    for own, (at, c, pairs, *_) in zip(np.split(flat, np.cumsum(sizes)[:-1]), work, strict=True):
        n_g = len(at) * K
        g, blocks = own[:n_g].reshape(len(at), K), own[n_g:-1].reshape(len(pairs), len(c), len(c))
        H = np.zeros((len(c), K, len(c), K))
        for (i, j), block in zip(pairs, blocks, strict=True):
            H[:, i, :, j] = block
            H[:, j, :, i] = block.T
        found.append({"g0": g[0], "g": g[1:], "H": H, "loss": float(own[-1])})
    return found


def path_moments(base: DataFrame, family, p: int, K: int, betas: np.ndarray, inters: np.ndarray, group: str | None = None, tasks: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(losses, gradients) of many coefficients in one pass over ``base(x..., y..., o..., w)``: betas is (L, p * K).

    With ``group``, a last column of ``base``, betas is (groups, L, p * K) and each row counts for the coefficients of
    its own group only: (groups, L) and (groups, L, p * K)."""
    multi, shape = getattr(family, "multi", False), betas.shape[:-1]
    G, L = (1, *shape) if group is None else shape
    B = betas.reshape(G, L, p, K)
    A = np.asarray(inters, float).reshape(G, L, K)

    def partial(cols: list[np.ndarray]) -> np.ndarray:
        g = cols[-1].astype(int) if group else np.zeros(len(cols[-1]), int)
        cols = cols[:-1] if group else cols
        X, out = np.column_stack([*cols[:p], np.zeros(len(g))])[:, :p], np.zeros((G, L, 1 + p * K))
        os, w = cols[p + K : -1], cols[-1]
        for i in np.unique(g):
            at = g == i
            x, ys = X[at], [c[at] for c in cols[p : p + K]]
            for k in range(L):
                eta = x @ B[i, k] + A[i, k]
                etas = [eta[:, m] + (os[m][at] if os else 0.0) for m in range(K)]
                args = (ys, etas, w[at]) if multi else (ys[0], etas[0], w[at])
                with np.errstate(all="ignore"):
                    grad, loss = family.gradient(*args), family.loss(*args)
                out[i, k, 0] = loss.sum()
                out[i, k, 1:] = (x.T @ (np.column_stack(grad) if multi else grad[:, None])).ravel()
        return out.ravel()

    flat = by_position(base, G * L * (1 + p * K), partial, tasks).reshape(G, L, 1 + p * K)
    flat = flat if group else flat[0]
    return flat[..., 0], flat[..., 1:]


#: Rows for each distinct one, about, from which equal ones are added up before the steps of a fit.
ALIKE = 8
#: Distinct rows, about, of one task of a step.
ROWS_A_TASK = 1 << 16


class GlmData:
    """Gradient, curvature and loss of a response at given coefficients, each a pass over the rows."""

    def __init__(self, frame: FeatureFrame, response: Response, options: Options | None = None, centred: bool = False, by: Sequence[str] | None = None):
        """``centred``: columns are taken about ``centers``, their weighted means, as where an intercept makes up for it.
        ``by``: rows may be added up that are equal in all that a fit reads and in these columns (None: they may not)."""
        self.alike = 0
        self.frame, self.response, self.family, self.options = frame, response, response.family, options or Options()
        self.K = len(response.y) if getattr(self.family, "multi", False) else 1
        self.more: tuple[str, ...] = ()
        self._sets: RiskSets | None = None
        values, w = _inputs(frame, response)
        if isinstance(self.family, Cox) and by is not None and len(values) <= NATIVE_SUMS:
            self._lay_out(values, w, tuple(by))
            return
        if len(values) <= NATIVE_SUMS:
            known = [F.when(w > 0, w * x.cast("double")).otherwise(0.0) for x in frame.columns] if centred else []
            counted = by is not None and not isinstance(self.family, Cox)
            shape = [F.count("*"), F.approx_count_distinct(F.xxhash64(*values, *map(F.col, by)))] if counted else [F.lit(0), F.lit(0)]
            row = frame.df.agg(*shape, F.sum(w), F.count_if(~sound(values, w)), *map(F.sum, known)).first()
            n, distinct, row = row[0], row[1], row[2:]
            self.alike = distinct if distinct * ALIKE <= n else 0
        else:
            row = weighted_sums(frame.df, values, w)[: 2 + (frame.p if centred else 0)]
        total, bad = row[0] or 0.0, row[1]
        refuse(bad)
        self.w, self.tasks = w / float(total or 1.0), None
        self.centers = np.array([x or 0.0 for x in row[2:]]) / total if centred and total else np.zeros(frame.p)
        if self.family.name == "multinomial" and self.K < 2:
            raise ValueError("multinomial needs at least 2 classes")
        self.table = self._table()

    def _lay_out(self, values: Sequence[Column], w: Column, by: tuple[str, ...]) -> None:
        """Entries of a Cox fit in one pass over the rows; weights, means and soundness are read off the entries."""
        p, names = self.frame.p, [f"x{k}" for k in range(self.frame.p)]
        self.centers, self.w, self.tasks = np.zeros(p), w, None
        self.more = (*by, "bad")
        bad = F.when(sound(values, w), 0).otherwise(1)
        self.frame, frame = replace(self.frame, df=self.frame.df.withColumn("bad", bad)), self.frame
        entries = RiskSets.entries(self._table(), names, "o0" if self.response.offsets else None, "fold" if "fold" in by else None).persist()
        self.frame, self.more = frame, by
        n, total, bad, *sums = entries.agg(F.count("*"), F.sum("rw"), F.sum("bad"), *(F.sum(F.col("rw") * F.col(x)) for x in names)).first()
        try:
            refuse(bad)
            self.w = w / float(total or 1.0)
            self.centers = np.array([x or 0.0 for x in sums]) / total if total else np.zeros(p)
            moved = [(F.col(x) - float(c) if c else F.col(x)).alias(x) for x, c in zip(names, self.centers, strict=True)]
            scaled = [(F.col(c) / float(total or 1.0)).alias(c) for c in ("sw", "ew", "rw")]
            self._sets = RiskSets.dealt(entries.select("strata", "at", *moved, "o", "fold", *scaled, "n"), p, self.family.tie, n)
            self._sets.table.count()
        finally:
            entries.unpersist()
        self.table = self._table()

    def fold_weights(self) -> dict[int, float]:
        """Weight of the rows of each fold."""
        table, w = (self.table, "w") if self._sets is None else (self._sets.table, "rw")
        return {r["fold"]: r["w"] for r in table.groupBy("fold").agg(F.sum(w).alias("w")).collect()}

    def _table(self) -> DataFrame:
        """The columns that a fit reads, under fixed names: x, then y (or the times and status), offsets and w. Rows of
        weight 0 may hold nulls, which then are 0."""
        known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        r, xs = self.response, [F.coalesce(x.cast("double") - float(c) if c else x.cast("double"), F.lit(0.0)).alias(f"x{k}") for k, (x, c) in enumerate(zip(self.frame.columns, self.centers, strict=True))]
        offsets = [known(o).alias(f"o{k}") for k, o in enumerate(r.offsets)]
        if isinstance(self.family, Cox):
            start = F.col(r.start).cast("double") if r.start else F.lit(float("-inf"))
            times = [start.alias("start"), F.col(r.stop).cast("double").alias("stop"), F.col(r.status).cast("int").alias("status"), (F.col(r.strata) if r.strata else F.lit(0)).alias("strata")]
            return self.frame.df.select(*xs, *times, *offsets, self.w.alias("w"), *self.more)
        return self.frame.df.select(*xs, *(known(y).alias(f"y{k}") for k, y in enumerate(r.y)), *offsets, self.w.alias("w"), *self.more)

    def with_column(self, name: str) -> DataFrame:
        """The table with one more column of the frame."""
        table = GlmData.__new__(GlmData)
        table.__dict__.update(self.__dict__, more=(name,))
        return table._table()

    def keep(self) -> None:
        """Holds the table in memory and on disk for the steps of a fit; lost parts are computed again. Where rows are alike,
        equal ones become one of their weights' sum, in which losses are linear: steps then cost what distinct rows cost.
        Cox steps read their own layout instead."""
        if isinstance(self.family, Cox):
            self.risk_sets()
            return
        if self.alike:
            same = [c for c in self.table.columns if c != "w"]
            self.table = self.table.groupBy(*same).agg(F.sum("w").alias("w")).select(*self.table.columns).coalesce(max(self.alike // ROWS_A_TASK, 1))
        self.table = self.table.persist()
        self.tasks = self.table.rdd.getNumPartitions()

    def shift(self, betas: np.ndarray, sign: int = 1) -> np.ndarray:
        """What centred columns take from the intercepts of ``betas`` (..., p * K); times ``sign``, (..., K)."""
        return sign * np.einsum("...pk,p->...k", np.asarray(betas, float).reshape(*np.shape(betas)[:-1], self.frame.p, self.K), self.centers)

    def risk_sets(self) -> RiskSets:
        """Rows of a Cox fit by time, laid out once."""
        if self._sets is None:
            self._sets = RiskSets.of(self.table, [f"x{k}" for k in range(self.frame.p)], self.family.tie, "o0" if self.response.offsets else None, "fold" if "fold" in self.more else None)
        return self._sets

    def cox_answer(self, asks: Sequence[Ask]) -> list[dict]:
        """Derivatives of a Cox fit for all ``asks``, in two jobs. Beyond ``cox_most`` sums the curvature is that of each
        row's own predictor: it is joined back, and rows are summed as in a Gram matrix."""
        many = [sums_of(len(a.columns), len(a.curved)) > self.options.cox_most for a in asks]
        found = self.risk_sets().answer([replace(a, curved=[]) if m else a for a, m in zip(asks, many, strict=True)])
        for k in np.flatnonzero(many):
            a, H = asks[k], np.zeros((len(asks[k].curved) + 1, 1, len(asks[k].curved) + 1, 1))
            if len(a.curved):
                w = F.col("w") * a.scale
                base = self._with_etas(a.beta, a.inter, "eta").withColumn("w", w if a.fold is None else F.when(F.col("fold") == a.fold, 0.0).otherwise(w))
                H[1:, 0, 1:, 0] = cross(cox.gradient(base, self.family.tie), [F.col(f"x{j}") for j in a.curved], F.col("hess"))
            found[k]["H"] = H
        return found

    def release(self) -> None:
        if self._sets is not None:
            self._sets.release()
            self._sets = None
        self.table.unpersist()

    def etas(self, beta: np.ndarray, inter: np.ndarray) -> list[Column]:
        b = beta.reshape(self.frame.p, self.K)
        offsets = self.response.offsets or [None] * self.K
        return [self.frame.btmul(0, b[:, k], F.lit(float(inter[k])) + (F.col(o).cast("double") if o else F.lit(0.0))) for k, o in zip(range(self.K), offsets, strict=True)]

    def _with_etas(self, beta: np.ndarray, inter: np.ndarray, name: str = "e{}") -> DataFrame:
        b, out = beta.reshape(self.frame.p, self.K), []
        for k in range(self.K):
            eta = F.lit(float(inter[k])) + (F.col(f"o{k}") if self.response.offsets else F.lit(0.0))
            for j in np.flatnonzero(b[:, k]):
                eta = eta + F.lit(float(b[j, k])) * F.col(f"x{j}")
            out.append(eta.alias(name.format(k)))
        return self.table.select("*", *out)

    def rows(self, beta: np.ndarray, inter: np.ndarray) -> tuple[DataFrame, list[Column], list[Column], list[Column], Column]:
        """(table, columns, gradients, curvatures, loss) as plans over each row."""
        xs = [F.col(f"x{k}") for k in range(self.frame.p)]
        if isinstance(self.family, Cox):
            return cox.gradient(self._with_etas(beta, inter, "eta"), self.family.tie), xs, [F.col("grad")], [F.col("hess")], F.lit(0.0)
        es, ys, w = [F.col(f"e{k}") for k in range(self.K)], [F.col(f"y{k}") for k in range(self.K)], F.col("w")
        base, f = self._with_etas(beta, inter), self.family
        if not getattr(f, "multi", False):
            return base, xs, [f.gradient(ys[0], es[0], w, Columns)], [f.hessian(ys[0], es[0], w, Columns)], f.loss(ys[0], es[0], w, Columns)
        return base, xs, f.gradient(ys, es, w, Columns), f.hessian(ys, es, w, Columns), f.loss(ys, es, w, Columns)

    def loss(self, beta: np.ndarray, inter: np.ndarray) -> float:
        if isinstance(self.family, Cox):
            return float(cox.loss(self._with_etas(beta, inter, "eta"), self.family.tie).first()[0])
        base, _, _, _, loss = self.rows(beta, inter)
        return float(base.agg(F.sum(loss)).first()[0] or 0.0)

    def loss_full(self) -> float:
        if self._sets is not None:
            return self._sets.answer([Ask(np.zeros(self.frame.p), np.zeros(1), [], [], slopes=False)])[0]["full"]
        if isinstance(self.family, Cox):
            return float(cox.loss_full(self.table, self.family.tie).first()[0])
        ys = [F.col(f"y{k}") for k in range(len(self.response.y))]
        y = ys if getattr(self.family, "multi", False) else ys[0]
        return float(self.table.agg(F.sum(self.family.loss_full(y, F.col("w"), Columns))).first()[0] or 0.0)

    def along(self, betas: np.ndarray, inters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(losses, gradients) of each value of a path: one pass, or two for Cox fits."""
        if not isinstance(self.family, Cox):
            return path_moments(self.table, self.family, self.frame.p, self.K, np.asarray(betas), np.asarray(inters))
        kept = self._sets is not None
        found = self.cox_answer([Ask(np.asarray(b), np.atleast_1d(a), range(self.frame.p), []) for b, a in zip(betas, inters, strict=True)])
        if not kept:
            self.release()
        return np.array([m["loss"] for m in found]), np.array([m["g"].ravel() for m in found])

    def moments(self, beta: np.ndarray, inter: np.ndarray, curved: Sequence[int], columns: Sequence[int] | None = None) -> dict:
        """g0, g (columns x K), H over (1, curved) x K each way, and the loss; ``columns`` (None: all) hold all ``curved``."""
        columns = range(self.frame.p) if columns is None else columns
        if not isinstance(self.family, Cox):
            return moments(self.table, self.family, self.K, [Ask(beta, inter, columns, curved)], bool(self.response.offsets), self.options.newton_most, self.tasks)[0]
        return self.cox_answer([Ask(beta, inter, columns, curved)])[0]


def glm_path(frame: FeatureFrame, response: Response, options: Options | None = None) -> PathResult:
    """A path of any family by iteratively reweighted quadratics; one pass over the kept columns per step. Columns are
    centred where that changes nothing but the intercepts."""
    options = options or Options()
    data = GlmData(frame, response, options, centred=options.intercept or isinstance(response.family, Cox), by=())
    data.keep()
    try:
        return _glm_path(data, options)
    finally:
        data.release()


#: Columns up to which a step takes all of them, curvature too, and thereby the optimality check and the next value's
#: first step; with more of them, steps read the screened columns and the check is a pass of its own.
WIDE = 64


def _glm_path(data: GlmData, options: Options) -> PathResult:
    frame, K, p = data.frame, data.K, data.frame.p
    first = frame.group_starts()
    starts, sizes = [b * K for b in first], [s * K for s in group_sizes(first, p)]
    penalty = default_penalty(sizes) if options.penalty is None else np.asarray(options.penalty, float)
    intercept = options.intercept and not isinstance(data.family, Cox)
    none, inter = np.zeros(p * K), np.zeros(K)
    wide = p > WIDE
    every = list(range(p)) if not wide and not isinstance(data.family, Cox) and K * (p + 1) <= options.newton_most else None
    m = data.moments(none, inter, [], [])
    if intercept:
        for _ in range(options.irls_max_iters):
            step = np.linalg.pinv(m["H"][0, :, 0, :], rcond=1e-10, hermitian=True) @ m["g0"]
            if float(np.sum(step * m["g0"])) <= 1e-16:
                break
            inter = inter + np.clip(step, -5, 5)
            m = data.moments(none, inter, [], [])
    null, full = m["loss"], data.loss_full()
    begin, last = inter.copy(), {}

    def at(beta, inter, curved):
        """Moments at these coefficients, those of the last pass if nothing changed; g and H of ``curved`` only."""
        asked = every if every is not None else curved
        key = (beta.tobytes(), inter.tobytes(), tuple(asked))
        if last.get("key") != key:
            last.update(key=key, m=data.moments(beta, inter, asked, asked if wide else None))
        m = dict(last["m"], all=None if wide else last["m"]["g"])
        if every is not None:
            own = [0, *(j + 1 for j in curved)]
            m["H"] = m["H"][own][:, :, own]
        if not wide:
            m["g"] = m["g"][curved]
        return m

    def local(beta, inter, lmda, groups, duals):
        inter = begin.copy() if not np.any(inter) and intercept else inter
        curved = sorted({(starts[g] + k) // K for g in groups for k in range(sizes[g])})
        flat = np.array([j * K + k for j in curved for k in range(K)], int)
        own = np.array([b for g in groups for b in range(starts[g], starts[g] + sizes[g])], int)
        order = np.searchsorted(flat, own)
        sub_sizes = [sizes[g] for g in groups]
        sub_starts = (np.cumsum(sub_sizes) - sub_sizes).tolist() if groups else []
        cons = [options.constraints[g] for g in groups] if options.constraints else None
        value = lambda b, m: m["loss"] + lmda * penalty_value(b, starts, sizes, penalty, options.alpha)
        m = at(beta, inter, curved)
        for _ in range(options.irls_max_iters):
            n = len(flat)
            H = m["H"].reshape(n + K, n + K)
            H00, Hx = H[:K, :K], H[K:, :K]
            # the intercepts of a quadratic follow from its coefficients; the classes' common shift has no curvature
            inverse = np.linalg.pinv(H00, rcond=1e-10, hermitian=True) if intercept else np.zeros((K, K))
            A = H[K:, K:] - Hx @ inverse @ Hx.T
            old = beta[flat]
            v = m["g"].ravel() - Hx @ inverse @ m["g0"] + A @ old
            step, sub = np.zeros(n), {i: duals[g] for i, g in enumerate(groups) if g in duals}
            if n:
                q = Quadratic(A[np.ix_(order, order)], sub_starts, sub_sizes, penalty[groups], options.alpha, cons)
                scale = max(float(np.trace(A)) / n, 1e-300)
                new, _ = q.solve(v[order], lmda, old[order], sub, range(len(groups)), options.tol * scale, options.max_iters)
                step[order] = new - old[order]
            duals.update({groups[i]: mu for i, mu in sub.items()})
            delta = inverse @ (m["g0"] - Hx.T @ step)
            change = float(step @ A @ step + delta @ H00 @ delta)
            share, before = 1.0, value(beta, m)
            while True:  # halved until the objective doesn't rise, beyond round-off
                next_beta, next_inter = beta.copy(), inter + share * delta
                next_beta[flat] = old + share * step
                next_m = at(next_beta, next_inter, curved)
                if value(next_beta, next_m) <= before + 1e-10 * max(1.0, abs(before)) or share < 1e-6:
                    break
                share /= 2
            beta, inter, m = next_beta, next_inter, next_m
            if change <= options.irls_tol:
                break
        else:
            raise RuntimeError("max reweighting steps reached")
        grad = m["all"] if m["all"] is not None else data.moments(beta, inter, [], None)["g"]
        return beta, inter, grad.ravel(), (null - m["loss"]) / (null - full) if null != full else 0.0, 0

    warm = options.warm_start
    if intercept and warm is not None and len(warm.betas):
        moved = replace(warm, intercepts=np.asarray(warm.intercepts, float).reshape(len(warm.betas), K) + data.shift(warm.betas))
        options = replace(options, warm_start=moved)
    out = run_path(local, starts, sizes, frame.names, K, null, full, options)
    if intercept and len(out.betas):
        out.intercepts = out.intercepts + data.shift(out.betas, -1)
    return out


def grpnet(frame: FeatureFrame, response: Response, options: Options | None = None) -> PathResult:
    """Group elastic net path of any family; gaussian ones with ``opt`` need a single pass over the rows, and leave their
    matrix on the executors from ``TILED`` columns on."""
    options = options or Options()
    if options.missing == "drop":
        frame = complete(frame, response)
    if response.family.name in ("gaussian", "multigaussian") and response.family.opt:
        if frame.p >= TILED:
            return gaussian_tiled(frame, response, options)
        return gaussian_from_statistics(gaussian_statistics(frame, response), frame.names, frame.group_starts(), options)
    return glm_path(frame, response, options)
