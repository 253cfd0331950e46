"""GLM families, each one set of formulas for NumPy arrays and Spark columns.

``gradient`` is the negative gradient of the loss, w (y - mean); ``hessian`` a diagonal (or majorising) vector;
``loss`` leaves out terms of y alone and ``loss_full`` is the saturated loss, both as per-row terms to be summed.
Weights are shares of 1, so losses are weighted means. Rows of weight 0 contribute 0."""

from __future__ import annotations

from dataclasses import dataclass

from ridgeline.functions.special import Arrays, normal_cdf, normal_pdf

LARGEST = 1e100
HESSIAN_MIN = 1e-24


def _xlogy(x, y, xp):
    return xp.where(x > 0, x * xp.log(xp.where(y > 0, y, 1.0)), 0.0)


@dataclass(frozen=True)
class Family:
    """A single-response family; user families subclass it and give the same five methods."""

    name: str = "user"
    multi = False

    def gradient(self, y, eta, w, xp=Arrays):
        raise NotImplementedError

    def hessian(self, y, eta, w, xp=Arrays):
        raise NotImplementedError

    def loss(self, y, eta, w, xp=Arrays):
        raise NotImplementedError

    def loss_full(self, y, w, xp=Arrays):
        raise NotImplementedError

    def inv_link(self, eta, xp=Arrays):
        raise NotImplementedError

    def inv_hessian_gradient(self, y, eta, w, xp=Arrays):
        h, g = self.hessian(y, eta, w, xp), self.gradient(y, eta, w, xp)
        return g / (xp.where(h > 0, h, 0.0) + xp.where(h <= 0, HESSIAN_MIN, 0.0))

    def null_mean(self, mean):
        """Link of a constant mean, where an intercept-only fit has a closed form; else None."""
        return None


@dataclass(frozen=True)
class Gaussian(Family):
    name: str = "gaussian"
    opt: bool = True

    def gradient(self, y, eta, w, xp=Arrays):
        return w * (y - eta)

    def hessian(self, y, eta, w, xp=Arrays):
        return w + 0.0 * eta

    def loss(self, y, eta, w, xp=Arrays):
        return w * (0.5 * eta * eta - y * eta)

    def loss_full(self, y, w, xp=Arrays):
        return -0.5 * w * y * y

    def inv_link(self, eta, xp=Arrays):
        return eta


def sigmoid(eta, xp=Arrays):
    e = xp.exp(-1.0 * xp.abs(eta))
    return xp.where(eta >= 0, 1.0, e) / (1.0 + e)


@dataclass(frozen=True)
class Binomial(Family):
    name: str = "binomial"
    link: str = "logit"

    def __post_init__(self):
        if self.link not in ("logit", "probit"):
            raise ValueError(f"unknown link {self.link!r}")

    def _tails(self, eta, xp):
        """P(eta) and its complement, kept off 0 so that quotients stay finite."""
        return xp.maximum(normal_cdf(eta, xp), 1e-12), xp.maximum(normal_cdf(-1.0 * eta, xp), 1e-12)

    def gradient(self, y, eta, w, xp=Arrays):
        if self.link == "logit":
            return w * (y - sigmoid(eta, xp))
        p, q = self._tails(eta, xp)
        return w * normal_pdf(eta, xp) * (y / p - (1.0 - y) / q)

    def hessian(self, y, eta, w, xp=Arrays):
        if self.link == "logit":
            p = sigmoid(eta, xp)
            return w * p * (1.0 - p)
        p, q = self._tails(eta, xp)
        d = normal_pdf(eta, xp)
        return w * d * (y * (d + eta * p) / (p * p) + (1.0 - y) * (d - eta * q) / (q * q))

    def loss(self, y, eta, w, xp=Arrays):
        if self.link == "logit":
            return w * ((xp.where(eta > 0, 1.0, 0.0) - y) * eta + xp.log1p(xp.exp(-1.0 * xp.abs(eta))))
        p, q = self._tails(eta, xp)
        return -1.0 * w * (y * xp.log(p) + (1.0 - y) * xp.log(q))

    def loss_full(self, y, w, xp=Arrays):
        return -1.0 * w * (_xlogy(y, y, xp) + _xlogy(1.0 - y, 1.0 - y, xp))

    def inv_link(self, eta, xp=Arrays):
        return sigmoid(eta, xp) if self.link == "logit" else normal_cdf(eta, xp)


@dataclass(frozen=True)
class Poisson(Family):
    name: str = "poisson"

    def _mean(self, eta, xp):
        return xp.minimum(xp.exp(xp.minimum(eta, 230.0)), LARGEST)

    def gradient(self, y, eta, w, xp=Arrays):
        return w * (y - self._mean(eta, xp))

    def hessian(self, y, eta, w, xp=Arrays):
        return w * self._mean(eta, xp)

    def loss(self, y, eta, w, xp=Arrays):
        return w * (self._mean(eta, xp) - y * eta)

    def loss_full(self, y, w, xp=Arrays):
        return w * (y - _xlogy(y, y, xp))

    def inv_link(self, eta, xp=Arrays):
        return self._mean(eta, xp)


class MultiFamily:
    """K responses: y, eta and results are lists of K arrays or columns; every loss is divided by K where stated."""

    multi = True


@dataclass(frozen=True)
class MultiGaussian(MultiFamily):
    name: str = "multigaussian"
    opt: bool = True

    def gradient(self, ys, etas, w, xp=Arrays):
        return [w * (y - e) / len(ys) for y, e in zip(ys, etas, strict=True)]

    def hessian(self, ys, etas, w, xp=Arrays):
        return [w / len(ys) + 0.0 * e for e in etas]

    def loss(self, ys, etas, w, xp=Arrays):
        return w * sum(0.5 * e * e - y * e for y, e in zip(ys, etas, strict=True)) / len(ys)

    def loss_full(self, ys, w, xp=Arrays):
        return -0.5 * w * sum(y * y for y in ys) / len(ys)

    def inv_link(self, etas, xp=Arrays):
        return list(etas)


@dataclass(frozen=True)
class Multinomial(MultiFamily):
    name: str = "multinomial"

    def inv_link(self, etas, xp=Arrays):
        top = etas[0]
        for e in etas[1:]:
            top = xp.maximum(top, e)
        parts = [xp.exp(e - top) for e in etas]
        total = sum(parts)
        return [x / total for x in parts]

    def gradient(self, ys, etas, w, xp=Arrays):
        return [w * (y - p) / len(ys) for y, p in zip(ys, self.inv_link(etas, xp), strict=True)]

    def hessian(self, ys, etas, w, xp=Arrays):
        """Twice the diagonal: a majoriser of the full matrix."""
        return [2.0 * w * p * (1.0 - p) / len(ys) for p in self.inv_link(etas, xp)]

    def curvature(self, etas, w, xp=Arrays):
        """The full matrix of second derivatives between classes, as K lists of K."""
        ps = self.inv_link(etas, xp)
        return [[w * p * ((1.0 if k == m else 0.0) - q) / len(etas) for m, q in enumerate(ps)] for k, p in enumerate(ps)]

    def loss(self, ys, etas, w, xp=Arrays):
        top = etas[0]
        for e in etas[1:]:
            top = xp.maximum(top, e)
        total = sum(xp.exp(e - top) for e in etas)
        return w * (top + xp.log(total) - sum(y * e for y, e in zip(ys, etas, strict=True))) / len(ys)

    def loss_full(self, ys, w, xp=Arrays):
        return -1.0 * w * sum(_xlogy(y, y, xp) for y in ys) / len(ys)


@dataclass(frozen=True)
class Cox:
    """Proportional hazards on (start, stop] with strata; see ``ridgeline.functions.cox`` for its windows."""

    name: str = "cox"
    tie: str = "efron"
    multi = False

    def __post_init__(self):
        if self.tie not in ("efron", "breslow"):
            raise ValueError(f"unknown tie method {self.tie!r}")

    def inv_link(self, eta, xp=Arrays):
        return xp.exp(eta)


FAMILIES = {"gaussian": Gaussian, "binomial": Binomial, "poisson": Poisson, "cox": Cox, "multigaussian": MultiGaussian, "multinomial": Multinomial}


def family(name: str, **options):
    if name not in FAMILIES:
        raise ValueError(f"unknown family {name!r}; one of {sorted(FAMILIES)}")
    return FAMILIES[name](**options)


@dataclass(frozen=True)
class Response:
    """Which columns of a table are the response of a fit.

    ``y`` holds one column (K columns for multi-response families), ``weight`` a non-negative column or None for
    equal weights (they are scaled to sum to 1 in each fit), ``offsets`` columns added to the linear predictor.
    Cox fits name start, stop, status and strata instead of y."""

    family: object
    y: tuple[str, ...] = ()
    weight: str | None = None
    offsets: tuple[str, ...] = ()
    start: str | None = None
    stop: str | None = None
    status: str | None = None
    strata: str | None = None

    def reweight(self, weight: str | None) -> Response:
        """The same response under other weights; the family keeps all its options, its link too."""
        from dataclasses import replace

        return replace(self, weight=weight)
