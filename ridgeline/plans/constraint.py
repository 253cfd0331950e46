"""Constraints on the coefficients of one group.

``solve`` minimises 1/2 x' diag(quad) x - linear' x + l1 |x| + l2/2 |x|^2 with Qx in the set, x in the rotated basis
of the group's Gram; it returns x and the dual ``mu``, for which stationarity in the original basis holds with
``gradient(mu)`` added. Duals are returned, never kept inside the object."""

from __future__ import annotations

import numpy as np

from ridgeline.plans import bcd, qp

LARGEST = 1e100


def proximal_newton(quad, linear, l1: float, l2: float, B: np.ndarray, lower: np.ndarray, upper: np.ndarray, tol: float = 1e-13, max_iters: int = 500) -> tuple[np.ndarray, np.ndarray] | None:
    """(x, dual) of the one-group problem with lower <= B x <= upper, by Newton steps on its dual; None if they don't
    settle. The smooth part of the dual is curved by dx/dv of the unconstrained solution x(v); with the bounds as a
    pinball penalty each step is a small pinball program, and steps are halved until the dual falls."""
    quad, linear, mu = np.asarray(quad, float), np.asarray(linear, float), np.zeros(len(B))
    d = quad + l2

    def at(mu):
        x = bcd.solve(quad, linear - B.T @ mu, l1, l2)
        return x, 0.5 * x @ (d * x) + upper @ np.maximum(mu, 0) + lower @ np.minimum(mu, 0)

    x, value = at(mu)
    for _ in range(max_iters):
        norm = np.linalg.norm(x)
        J = np.linalg.pinv(np.diag(d + l1 / norm) - l1 * np.outer(x, x) / norm**3, hermitian=True) if norm > 0 else np.zeros((len(x), len(x)))
        H = B @ J @ B.T
        H = H + 1e-10 * max(float(np.trace(H)) / len(H), 1e-6) * np.eye(len(H))
        try:
            step = qp.pinball_full(H, H @ mu + B @ x, -lower, upper, x0=mu, tol=1e-24) - mu
        except RuntimeError:
            return None
        share = 1.0
        while True:
            new, (new_x, new_value) = mu + share * step, at(mu + share * step)
            if new_value <= value + 1e-14 * max(1.0, abs(value)) or share < 1e-10:
                break
            share /= 2
        if share < 1e-10:
            return None
        done = np.max(np.abs(new - mu), initial=0.0) <= tol * max(1.0, np.max(np.abs(new), initial=0.0))
        mu, x, value = new, new_x, new_value
        if done:
            return x, mu
    return None


class Constraint:
    """Base of the built-in sets and of user constraints: give ``project`` (and ``m``), or override ``solve``.

    ``method`` is ``proximal_newton`` for sets that state themselves as ``bounds`` (ADMM where its steps don't settle),
    or ``admm``."""

    m = 0  # number of duals

    def __init__(self, tol: float = 1e-11, max_iters: int = 50_000, rho: float = 1.0, method: str = "proximal_newton"):
        if method not in ("proximal_newton", "admm"):
            raise ValueError(f"unknown method {method!r}")
        self.tol, self.max_iters, self.rho, self.method = tol, max_iters, rho, method

    def bounds(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(A, lower, upper) of lower <= A x <= upper, None for other sets."""
        return None

    def project(self, z: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def gradient(self, mu: np.ndarray) -> np.ndarray:
        return mu

    def solve(self, quad, linear, l1: float, l2: float, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the constraint's method; ADMM alternates between the group penalty in the rotated and the set in the
        original basis."""
        quad, linear = np.asarray(quad, float), np.asarray(linear, float)
        own = self.bounds(len(linear)) if self.method == "proximal_newton" else None
        if own is not None:
            A, low, high = own
            left, mu = self.solve_zero(Q @ linear)
            if left <= l1:
                return np.zeros(len(linear)), mu
            found = proximal_newton(quad, linear, l1, l2, A @ Q, low, high)
            if found is not None:
                return found[0], self.dual_from(found[1])
        rho = self.rho * max(float(np.mean(quad)) + l2, 1e-8)
        z = u = np.zeros(len(linear))
        x = z
        for k in range(self.max_iters):
            x = bcd.solve(quad + rho, linear + rho * (Q.T @ (z - u)), l1, l2)
            y = Q @ x
            new = self.project(y + u)
            u = u + y - new
            primal, dual = np.max(np.abs(y - new), initial=0.0), rho * np.max(np.abs(new - z), initial=0.0)
            z = new
            scale = max(1.0, np.max(np.abs(z), initial=0.0))
            if primal <= self.tol * scale and dual <= self.tol * scale:
                break
            if k % 50 == 49 and k < 2000:
                if primal > 10 * dual:
                    rho, u = rho * 2, u / 2
                elif dual > 10 * primal:
                    rho, u = rho / 2, u * 2
        return Q.T @ z, self.dual_of(rho * u)

    def dual_of(self, force: np.ndarray) -> np.ndarray:
        return force

    def dual_from(self, nu: np.ndarray) -> np.ndarray:
        """This set's dual from those of its ``bounds``."""
        return nu

    def solve_zero(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        """Norm of what is left of the gradient v at 0 after the best dual, and that dual."""
        raise NotImplementedError


class Box(Constraint):
    """lower <= x <= upper, 0 inside."""

    def __init__(self, lower, upper, **options):
        super().__init__(**options)
        self.lower, self.upper = np.maximum(np.asarray(lower, float), -LARGEST), np.minimum(np.asarray(upper, float), LARGEST)
        if (self.lower > 0).any() or (self.upper < 0).any():
            raise ValueError("bounds must lie on either side of 0")
        self.m = len(self.lower)

    def project(self, z):
        return np.clip(z, self.lower, self.upper)

    def bounds(self, d):
        return np.eye(d), self.lower, self.upper

    def solve(self, quad, linear, l1, l2, Q):
        if len(linear) == 1:  # closed form: clip the unconstrained minimiser
            d = quad[0] + l2
            free = np.sign(linear[0]) * max(abs(linear[0]) - l1, 0.0) / d if d > 0 else 0.0
            z = float(self.project(Q[0, 0] * free)[0])
            x = z / Q[0, 0]
            force = linear[0] - d * x - l1 * np.sign(x) if x else np.sign(linear[0]) * max(abs(linear[0]) - l1, 0.0)
            mu = Q[0, 0] * force if free != x else 0.0
            return np.array([x]), np.array([mu])
        return super().solve(quad, linear, l1, l2, Q)

    def solve_zero(self, v):
        mu = np.where(self.upper <= 0, np.maximum(v, 0.0), 0.0) + np.where(self.lower >= 0, np.minimum(v, 0.0), 0.0)
        return float(np.linalg.norm(v - mu)), mu


class OneSided(Constraint):
    """D x <= b with signs D and b >= 0."""

    def __init__(self, D, b, method: str = "proximal_newton", **options):
        super().__init__(method=method, **options)
        self.D, self.b = np.asarray(D, float), np.minimum(np.asarray(b, float), LARGEST)
        if not np.isin(self.D, (-1, 1)).all():
            raise ValueError("D must be signs")
        if (self.b < 0).any():
            raise ValueError("b must not be negative")
        self.box = Box(np.where(self.D < 0, -self.b, -LARGEST), np.where(self.D > 0, self.b, LARGEST), method=method, **options)
        self.m = len(self.b)

    def project(self, z):
        return self.box.project(z)

    def gradient(self, mu):
        return self.D * mu

    def dual_of(self, force):
        return np.maximum(self.D * force, 0.0)

    def solve(self, quad, linear, l1, l2, Q):
        x, mu = self.box.solve(quad, linear, l1, l2, Q)
        return x, self.dual_of(mu)

    def solve_zero(self, v):
        norm, mu = self.box.solve_zero(v)
        return norm, self.dual_of(mu)


def lower(b, **options) -> OneSided:
    """x >= b for b <= 0."""
    b = np.asarray(b, float)
    return OneSided(-np.ones(len(b)), -b, **options)


def upper(b, **options) -> OneSided:
    """x <= b for b >= 0."""
    b = np.asarray(b, float)
    return OneSided(np.ones(len(b)), b, **options)


class Linear(Constraint):
    """lower <= A x <= upper, 0 inside."""

    def __init__(self, A, lower, upper, **options):
        super().__init__(**options)
        self.A = np.asarray(A, float)
        self.lower, self.upper = np.maximum(np.asarray(lower, float), -LARGEST), np.minimum(np.asarray(upper, float), LARGEST)
        if (self.lower > 0).any() or (self.upper < 0).any():
            raise ValueError("bounds must lie on either side of 0")
        self.m = len(self.A)

    def project(self, z):
        """Nearest point of the set, by the dual pinball program in A A'."""
        a = self.A @ z
        if (a <= self.upper).all() and (a >= self.lower).all():
            return z
        # dual: min 1/2 |A'mu|^2 - (Az)'mu + upper'mu_+ - lower'mu_-
        mu = qp.pinball_full(self.A @ self.A.T + 1e-15 * np.eye(self.m), a, -self.lower, self.upper, tol=1e-26)
        return z - self.A.T @ mu

    def bounds(self, d):
        return self.A, self.lower, self.upper

    def gradient(self, mu):
        return self.A.T @ mu

    def dual_of(self, force):
        return np.linalg.lstsq(self.A.T, force, rcond=None)[0]

    def solve_zero(self, v):
        """Least squares of v by rows whose bounds touch 0, in the directions they block."""
        pos = np.where(self.upper <= 0, np.inf, 0.0)
        neg = np.where(self.lower >= 0, np.inf, 0.0)
        mu = qp.box_qp(self.A @ self.A.T + 1e-15 * np.eye(self.m), self.A @ v, -neg, pos)
        return float(np.linalg.norm(v - self.A.T @ mu)), mu


class Zero(Constraint):
    """x = 0: the smallest user constraint."""

    def __init__(self, d: int, **options):
        super().__init__(**options)
        self.m = d

    def project(self, z):
        return np.zeros_like(z)

    def solve(self, quad, linear, l1, l2, Q):
        return np.zeros(len(linear)), Q @ np.asarray(linear, float)

    def solve_zero(self, v):
        return 0.0, v
