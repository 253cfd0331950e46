"""Bounded least squares and pinball least squares."""

from __future__ import annotations

import numpy as np

from ridgeline.functions.glm import Gaussian, Response
from ridgeline.operators.features import FeatureFrame
from ridgeline.plans import qp
from ridgeline.plans.path import gaussian_statistics

pinball = qp.pinball


def bvls(frame: FeatureFrame, y: str, lower, upper, weight: str | None = None, max_iters: int = 100_000, tol: float = 1e-20) -> np.ndarray:
    """min 1/2 sum w (y - Xb)^2 with lower <= b <= upper, without intercept: one statistics pass, then coordinate
    descent from the point of the box nearest 0."""
    stats = gaussian_statistics(frame, Response(Gaussian(), (y,), weight))
    return qp.box_qp(stats["xx"], stats["xy"][:, 0], lower, upper, max_iters=max_iters, tol=tol)
