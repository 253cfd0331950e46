"""Gaussian paths over matrices that the driver never sees: screening decides which columns' products it asks for."""

from __future__ import annotations

from typing import Protocol

import numpy as np

from ridgeline.plans.path import Options, PathResult, Quadratic, default_penalty, group_sizes, run_path


class Screenable(Protocol):
    """What a path needs of a matrix X with p columns and a response y, under weights that sum to 1. Each method is a pass
    over the rows, of which only vectors of p numbers and products of chosen columns reach the driver."""

    p: int
    names: list[str]

    def response(self) -> tuple[float, float, float]:
        """(mean, variance, mean square) of y."""

    def products(self, inter: float, beta: np.ndarray) -> np.ndarray:
        """X' (y - inter - X beta)."""

    def means(self) -> np.ndarray: ...

    def gram(self, left: list[int], right: list[int]) -> np.ndarray: ...


#: Columns up to which all products are taken in one pass, from which every gradient follows without another.
WHOLE = 256


def screened_path(x: Screenable, options: Options | None = None, starts=None) -> PathResult:
    """The path of ``gaussian_from_statistics``. Per value of lambda one pass takes the gradient of all columns, the
    optimality check; products are asked for newly screened groups only, with those screened before. Up to ``WHOLE`` columns one pass
    takes the products of all, and no value of lambda takes a pass."""
    options, p = options or Options(), x.p
    starts = list(range(p)) if starts is None else list(starts)
    sizes = group_sizes(starts, p)
    penalty = default_penalty(sizes) if options.penalty is None else np.asarray(options.penalty, float)
    mean_y, var_y, square_y = x.response()
    mean = x.means() if options.intercept else np.zeros(p)
    shift, y_var = (mean_y, var_y) if options.intercept else (0.0, square_y)
    v = x.products(shift, np.zeros(p))
    own: list[int] = []
    place: dict[int, int] = {}
    kept = np.zeros((0, 0))

    def local(beta, inter, lmda, groups, duals):
        nonlocal own, kept
        at = [j for g in groups for j in range(starts[g], starts[g] + sizes[g])]
        new = [j for j in (range(p) if p <= WHOLE and at else at) if j not in place]
        if new:
            every = [*own, *new]
            cross = x.gram(new, every) - np.outer(mean[new], mean[every])
            grown = np.zeros((len(every), len(every)))
            grown[: len(own), : len(own)] = kept
            grown[len(own) :, :], grown[:, len(own) :] = cross, cross.T
            own, kept = every, grown
            place.update((j, k) for k, j in enumerate(own))
        held = [place[j] for j in at]
        A, beta, sweeps = kept[np.ix_(held, held)], beta.copy(), 0
        if groups:
            sub = np.cumsum([0, *(sizes[g] for g in groups)])[:-1]
            cons = [options.constraints[g] for g in groups] if options.constraints else None
            known = {k: duals[g] for k, g in enumerate(groups) if g in duals}
            q = Quadratic(A, sub, [sizes[g] for g in groups], penalty[list(groups)], options.alpha, cons)
            beta[at], sweeps = q.solve(v[at], lmda, beta[at], known, range(len(groups)), options.tol * max(y_var, 1e-300), options.max_iters)
            duals.update({groups[k]: mu for k, mu in known.items()})
        inter = np.array([mean_y - mean @ beta]) if options.intercept else np.zeros(1)
        if not np.any(beta):
            grad = v
        elif p <= WHOLE:  # ``own`` holds all columns, in their order; products less the means' share are about the means
            grad = v - kept @ beta
        else:
            grad = x.products(float(inter[0]), beta)
        b = beta[at]
        return beta, inter, grad, float(2 * v[at] @ b - b @ A @ b) / y_var if y_var else 0.0, sweeps

    null = -0.5 * mean_y**2 if options.intercept else 0.0
    return run_path(local, starts, sizes, x.names, 1, null, -0.5 * square_y, options)
