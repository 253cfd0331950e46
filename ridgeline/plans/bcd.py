"""The one-group problem: min 1/2 x' diag(L) x - v' x + l1 |x|_2 + l2/2 |x|^2, L >= 0."""

from __future__ import annotations

import numpy as np

SOLVERS = ("brent", "newton", "newton_brent", "newton_abs", "newton_abs_debug", "ista", "fista", "fista_adares")


def objective(x, quad, linear, l1: float, l2: float) -> float:
    x = np.asarray(x, float)
    return float(0.5 * x @ (np.asarray(quad) * x) - np.asarray(linear) @ x + l1 * np.linalg.norm(x) + 0.5 * l2 * (x @ x))


def root_function(h: float, quad, linear, l1: float) -> float:
    """|v / (D h + l1)|^2 - 1, decreasing in h; its root is the norm of the solution (D: quad plus l2)."""
    return float(np.sum((np.asarray(linear) / (np.asarray(quad) * h + l1)) ** 2) - 1)


def root_lower_bound(quad, linear, l1: float) -> float:
    """max over nothing less than 0 of a bound by Cauchy's inequality on the norm of D h + l1."""
    quad, linear = np.asarray(quad, float), np.abs(np.asarray(linear, float))
    weight = linear @ linear
    norm, slope = np.sqrt(weight), 0.0
    if norm <= l1 or not weight:
        return 0.0
    slope = (quad * linear**2).sum() / weight  # by convexity of 1/x^2 the root lies at or beyond (|v| - l1) / slope
    return float(max(0.0, (norm - l1) / slope)) if slope > 0 else 0.0


def root_upper_bound(quad, linear, l1: float, zero_tol: float = 1e-10) -> float:
    """A value at or beyond the root: the norm of v / D if that is finite, else with the least positive D."""
    quad, linear = np.asarray(quad, float), np.asarray(linear, float)
    live = quad > zero_tol
    flat = np.linalg.norm(linear[~live]) if (~live).any() else 0.0
    if flat == 0:
        return float(np.linalg.norm(linear[live] / quad[live])) if live.any() else 0.0
    if flat >= l1:
        return float("inf")
    return float(np.linalg.norm(linear[live] / quad[live]) / np.sqrt(1 - (flat / l1) ** 2))


def root(quad, linear, l1: float, tol: float = 1e-14, max_iters: int = 500, trace: list[float] | None = None) -> float | None:
    """Norm of the solution, None where there is no positive root (|v| <= l1) or no finite one: Newton steps from the
    lower bound, kept inside the bracket. ``trace`` takes every value that is tried."""
    quad, linear = np.asarray(quad, float), np.asarray(linear, float)
    if np.linalg.norm(linear) <= l1 or l1 <= 0:
        return None
    low, high = root_lower_bound(quad, linear, l1), root_upper_bound(quad, linear, l1)
    if not np.isfinite(high):
        return None
    h = low
    for _ in range(max_iters):  # Newton from the left of a convex decreasing function can't overshoot
        d = quad * h + l1
        r = linear / d
        f = r @ r - 1
        if trace is not None:
            trace.append(float(h))
        if abs(f) <= tol:
            break
        slope = -2 * (r * r * quad / d).sum()
        step = h - f / slope if slope else h
        if not low <= step <= high * (1 + 1e-12):
            step = (low + high) / 2
        if f > 0:
            low = max(low, h)
        else:
            high = min(high, h)
        if step == h:
            break
        h = step
    return float(h)


def _plain_newton(quad, linear, l1: float, tol: float, max_iters: int) -> float:
    """Newton steps from 0, without bounds: each lies left of the root, as the function is convex and falls."""
    h = 0.0
    for _ in range(max_iters):
        d = quad * h + l1
        r = linear / d
        step = (r @ r - 1) / (2 * (r * r * quad / d).sum())
        if not step > tol * max(1.0, h):
            break
        h += step
    return float(h)


def _newton_brent(quad, linear, l1: float, max_steps: int = 3) -> float:
    """A few Newton steps raise the lower end of the bracket; Brent's method ends in it."""
    from ridgeline.plans.qp import brent

    low, high = max(root_lower_bound(quad, linear, l1), _plain_newton(quad, linear, l1, 0.0, max_steps)), root_upper_bound(quad, linear, l1)
    f = lambda h: root_function(h, quad, linear, l1)
    return low if f(low) <= 0 else brent(f, low, max(high, low) * (1 + 1e-12), tol=1e-15)


def _proximal(quad, linear, l1, l2, tol, max_iters, fast: bool, restart: bool):
    d, step = np.asarray(quad, float) + l2, 1.0 / max(float(np.max(quad) + l2), 1e-300)
    x = z = np.zeros(len(d))
    t = 1.0
    for _ in range(max_iters):
        g = z - step * (d * z - linear)
        norm = np.linalg.norm(g)
        new = g * max(0.0, 1 - step * l1 / norm) if norm else g
        if restart and (z - new) @ (new - x) > 0:
            t, z = 1.0, x
            restart_now = True
        else:
            restart_now = False
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z_new = new + ((t - 1) / s) * (new - x) if fast and not restart_now else new
        done = np.max(np.abs(new - x), initial=0.0) <= tol * max(1.0, np.max(np.abs(new), initial=0.0)) and not restart_now
        x, z, t = new, z_new, s
        if done:
            break
    return x


def solve(quad, linear, l1: float, l2: float = 0.0, solver: str = "newton_abs", tol: float = 1e-14, max_iters: int = 100_000, trace: list[float] | None = None) -> np.ndarray:
    """The minimiser. |v| <= l1 gives 0 and l1 <= 0 the ridge solution; solvers differ in how they find the norm:
    ``brent`` between both bounds, ``newton`` from 0, ``newton_brent`` Newton steps and then Brent, ``newton_abs``
    Newton steps from the lower bound inside the bracket (``newton_abs_debug`` the same with every value in ``trace``);
    ``ista``, ``fista`` and ``fista_adares`` (restarted) are proximal gradient steps on x itself."""
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}; one of {SOLVERS}")
    quad, linear = np.asarray(quad, float), np.asarray(linear, float)
    d = quad + l2
    if np.linalg.norm(linear) <= l1:
        return np.zeros(len(linear))
    if l1 <= 0:
        return linear / np.where(d > 0, d, 1e-24)
    if solver in ("ista", "fista", "fista_adares"):
        return _proximal(quad, linear, l1, l2, tol, max_iters, solver != "ista", solver == "fista_adares")
    if not np.isfinite(root_upper_bound(d, linear, l1)):
        raise ValueError("the problem is unbounded: flat directions outweigh l1")
    if solver == "brent":
        from ridgeline.plans.qp import brent

        low, high = root_lower_bound(d, linear, l1), root_upper_bound(d, linear, l1) * (1 + 1e-12)
        f = lambda x: root_function(x, d, linear, l1)
        h = low if f(low) <= 0 else brent(f, low, high, tol=1e-15)
    elif solver == "newton":
        h = _plain_newton(d, linear, l1, min(tol, 1e-15), max_iters)
    elif solver == "newton_brent":
        h = _newton_brent(d, linear, l1)
    else:
        h = root(d, linear, l1, tol=min(tol, 1e-14), trace=trace if solver == "newton_abs_debug" else None)
    return linear * h / (d * h + l1)
