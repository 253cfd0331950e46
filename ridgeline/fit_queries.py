"""Registered queries of fits, solvers, cross-validation and diagnostics, and their SQL.

The SQL solves the same problems by other means: the statistics are aggregates, and a recursive query descends on
them, one block of coefficients a step, from 0 to far beyond the digits that are compared."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import cox
from ridgeline.functions.glm import Binomial, Family, Gaussian, MultiGaussian, Response, family
from ridgeline.operators import features as X
from ridgeline.operators.gram import cross
from ridgeline.plans import bcd, bounded, constraint, css, diagnostic, path, qp
from ridgeline.plans.cv import cv_grpnet
from ridgeline.plans.estimators import GroupElasticNet
from ridgeline.queries import BIN_SQL, CALLS, COX_SQL, HAPS, L_SQL, calls, flags, lineitem, measures, query, r6, survival, vector
from ridgeline.sources import genotypes
from ridgeline.sources.storage import Stored

# --- SQL of descents ----------------------------------------------------------------------------------------


def statistics(xs: list[str], ys: list[str], w: str = "1e0", source: str = "lin", by: str = "0", centre: bool = True) -> str:
    """CTEs ``mean`` (f, mx, my) and ``st`` (f, G, V, yy) of weighted columns per ``by``, centred or not."""
    total = f"sum({w})"
    avg = lambda e: f"sum({w} * ({e})) / {total}"
    at = (lambda e, k, m: f"({e} - {m}[{k + 1}])") if centre else (lambda e, k, m: f"({e})")
    cx, cy = [at(e, k, "mx") for k, e in enumerate(xs)], [at(e, k, "my") for k, e in enumerate(ys)]
    lists = lambda rows: "[" + ", ".join("[" + ", ".join(r) + "]" for r in rows) + "]"
    return f"""mean AS (SELECT {by} AS f, [{", ".join(map(avg, xs))}] AS mx, [{", ".join(map(avg, ys))}] AS my FROM {source} GROUP BY 1),
st AS (SELECT mean.f, {lists([[avg(f"{a} * {b}") for b in cx] for a in cx])} AS G, {lists([[avg(f"{a} * {b}") for b in cy] for a in cx])} AS V, {" + ".join(avg(f"{b} * {b}") for b in cy)} AS yy
 FROM {source} JOIN mean ON mean.f = {by} GROUP BY mean.f)"""


def kronecker(p: int, K: int) -> str:
    """CTE ``gv`` (f, G, v, yy): statistics of p columns and K responses, coefficients of a column side by side."""
    n = range(p * K)
    G = "[" + ", ".join("[" + ", ".join(f"G[{i // K + 1}][{j // K + 1}] / {K}e0" if i % K == j % K else "0e0" for j in n) + "]" for i in n) + "]"
    return f"gv AS (SELECT f, {G} AS G, [{', '.join(f'V[{i // K + 1}][{i % K + 1}] / {K}e0' for i in n)}] AS v, yy / {K}e0 AS yy FROM st)"


def lambdas(starts: list[int], sizes: list[int], n: int, ratio: float, alpha: float = 1.0) -> str:
    """CTE ``lam`` (f, i, lam): the default path of each f, from its largest value."""
    norms = [f"sqrt({' + '.join(f'v[{j + 1}] * v[{j + 1}]' for j in range(a, a + s))}) / sqrt({s}e0)" for a, s in zip(starts, sizes, strict=True)]
    return f"lam AS (SELECT f, i, greatest({', '.join(norms)}) / {alpha}e0 * exp(ln({ratio}e0) * i / {max(n - 1, 1)}e0) AS lam FROM gv, range({n}) t(i))"


def descent(p: int, starts: list[int], sizes: list[int], sweeps: int, alpha: float = 1.0, bounds: dict[int, tuple[str, str]] | None = None) -> str:
    """CTE ``fit`` (f, i, lam, b): coefficients for each row of ``lam`` on the statistics ``gv`` of its f. A step takes one
    group: a proximal step of the length that its block of G allows, exact for one column, then clipped to bounds."""
    m, bounds = len(starts), bounds or {}
    case = lambda parts: "CASE k % " + str(m) + " " + " ".join(f"WHEN {g} THEN {e}" for g, e in enumerate(parts)) + " END"
    spans = [range(a, a + s) for a, s in zip(starts, sizes, strict=True)]
    length = [f"greatest({', '.join(' + '.join(f'abs(G[{i + 1}][{j + 1}])' for j in at) for i in at)}, 1e-300)" for at in spans]
    z = ["[" + ", ".join(f"len_ * b[{i + 1}] + v[{i + 1}] - list_dot_product(G[{i + 1}], b)" for i in at) + "]" for at in spans]
    shrunk = [f"greatest(1 - lam * {alpha}e0 * sqrt({s}e0) / greatest(norm_, 1e-300), 0) / (len_ + lam * {1 - alpha}e0 * sqrt({s}e0))" for s in sizes]
    new = []
    for g, at in enumerate(spans):
        value = "list_transform(z_, lambda t: t * share_)"
        if g in bounds:
            value = f"list_transform({value}, lambda t: least(greatest(t, {bounds[g][0]}), {bounds[g][1]}))"
        new.append(f"list_concat(list_concat(b[1:{at[0]}], {value}), b[{at[-1] + 2}:])" if at[0] else f"list_concat({value}, b[{at[-1] + 2}:])")
    return f"""run AS (SELECT 0 AS k, f, i, lam, [{", ".join(["0e0"] * p)}] AS b FROM lam
 UNION ALL SELECT k + 1, f, i, lam, {case(new)} FROM (SELECT *, {case(shrunk)} AS share_ FROM (SELECT *, sqrt(list_sum(list_transform(z_, lambda t: t * t))) AS norm_
 FROM (SELECT *, {case(z)} AS z_ FROM (SELECT run.*, G, v, {case(length)} AS len_ FROM run JOIN gv USING (f) WHERE k < {sweeps * m})))) q),
fit AS (SELECT f, i, lam, b FROM run WHERE k = {sweeps * m})"""


def solved(prefix: str, *ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join([prefix, *ctes])} {select}"


FLAG_X = ["x0", "x1", "x2", *(f"(CASE WHEN rf = '{v}' THEN 1e0 ELSE 0e0 END)" for v in "ANR"), *(f"(CASE WHEN ls = '{v}' THEN 1e0 ELSE 0e0 END)" for v in "FO")]
FLAG_STARTS, FLAG_SIZES = [0, 1, 2, 3, 6], [1, 1, 1, 3, 2]


def betas_sql(p: int, digits: int = 5) -> str:
    return f"SELECT i::INT AS lmda_idx, (j - 1)::INT AS feature_idx, round(b[j], {digits}) + 0e0 AS beta FROM fit, range(1, {p + 1}) t(j)"


def betas_of(spark, betas: np.ndarray, digits: int = 5) -> DataFrame:
    """(lmda_idx, feature_idx, beta) of all coefficients, zeros included."""
    rows = [(i, j, round(float(x), digits) + 0.0) for i, b in enumerate(betas) for j, x in enumerate(b)]
    return spark.createDataFrame(rows, "lmda_idx int, feature_idx int, beta double")


def named_rows(spark, rows: list[tuple[str, list]], digits: int = 6) -> DataFrame:
    """(name, j, v) of named vectors."""
    return spark.createDataFrame([(n, j, round(float(x), digits) + 0.0) for n, values in rows for j, x in enumerate(np.atleast_1d(values))], "name string, j int, v double")


def named_sql(rows: list[tuple[str, list[str]]], source: str, digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, {j}::INT AS j, round(({e})::DOUBLE, {digits}) + 0e0 AS v FROM {source}" for n, values in rows for j, e in enumerate(values))


# --- paths --------------------------------------------------------------------------------------------------
def lasso_frame(spark, sf_dir) -> X.FeatureFrame:
    return X.one_hot(flags(spark, sf_dir), [0, 0, 0, 3, 2])


@query(solved(L_SQL, statistics(FLAG_X, ["y"]), kronecker(8, 1), lambdas(FLAG_STARTS, FLAG_SIZES, 20, 0.01), descent(8, FLAG_STARTS, FLAG_SIZES, 400), select=betas_sql(8)))
def gaussian_path(spark, sf_dir):
    fit = path.grpnet(lasso_frame(spark, sf_dir), Response(Gaussian(), ("y",)), path.Options(lmda_path_size=20, early_exit=False))
    return betas_of(spark, fit.betas)


@query(
    solved(
        L_SQL, statistics(FLAG_X, ["y"], "q"), kronecker(8, 1), lambdas(FLAG_STARTS, FLAG_SIZES, 20, 0.01, 0.5), descent(8, FLAG_STARTS, FLAG_SIZES, 400, 0.5),
        select="SELECT i::INT AS lmda_idx, round(lam, 8) AS lmda, round((2 * list_dot_product(v, b) - list_dot_product(b, list_transform(G, lambda g: list_dot_product(g, b)))) / yy, 6) + 0e0 AS dev, round(my[1] - list_dot_product(mx, b), 5) AS intercept FROM fit JOIN gv USING (f) JOIN mean USING (f)",
    )
)
def weighted_elastic_net_path(spark, sf_dir):
    fit = path.grpnet(lasso_frame(spark, sf_dir), Response(Gaussian(), ("y",), "q"), path.Options(alpha=0.5, lmda_path_size=20, early_exit=False))
    rows = [(i, round(float(x), 8), round(float(d), 6) + 0.0, round(float(np.atleast_1d(a)[0]), 5)) for i, (x, d, a) in enumerate(zip(fit.lmdas, fit.devs, fit.intercepts, strict=True))]
    return spark.createDataFrame(rows, "lmda_idx int, lmda double, dev double, intercept double")


ONES = [0, 1, 2], [1, 1, 1]
M_SQL = [statistics(["x0", "x1", "x2"], ["y"]), kronecker(3, 1)]
FORCE = [f"v[{j}] - list_dot_product(G[{j}], b)" for j in (1, 2, 3)]


@query(
    solved(
        L_SQL, *M_SQL, lambdas(*ONES, 10, 0.01), descent(3, *ONES, 300, bounds={0: ("-0.2e0", "0.2e0"), 1: ("-0.5e0", "1e100")}),
        select=f"""SELECT i::INT AS lmda_idx, j::INT AS feature_idx, round(beta, 5) + 0e0 AS beta, round(CASE WHEN j = 0 AND abs(beta) >= 0.2e0 THEN force - lam * sign(beta) WHEN j = 1 AND beta <= -0.5e0 THEN -(force + lam) ELSE 0e0 END, 5) + 0e0 AS mu
 FROM (SELECT i, lam, j, b[j + 1] AS beta, CASE j WHEN 0 THEN {FORCE[0]} WHEN 1 THEN {FORCE[1]} ELSE {FORCE[2]} END AS force FROM fit JOIN gv USING (f), range(3) t(j)) q""",
    )
)
def constrained_path(spark, sf_dir):
    frame, response = measures(spark, sf_dir)
    cons = [constraint.Box([-0.2], [0.2]), constraint.lower([-0.5]), None]
    fit = path.grpnet(frame, response, path.Options(lmda_path_size=10, early_exit=False, constraints=cons))
    rows = [(i, j, round(float(x), 5) + 0.0, round(float(fit.duals[i][j][0]) if j in fit.duals[i] else 0.0, 5) + 0.0) for i, b in enumerate(fit.betas) for j, x in enumerate(b)]
    return spark.createDataFrame(rows, "lmda_idx int, feature_idx int, beta double, mu double")


@query(solved(L_SQL, statistics(["x0", "x1", "x2"], ["y", "x3"]), kronecker(3, 2), lambdas([0, 2, 4], [2, 2, 2], 20, 0.01), descent(6, [0, 2, 4], [2, 2, 2], 300), select=betas_sql(6)))
def multigaussian_path(spark, sf_dir):
    frame, _ = measures(spark, sf_dir)
    return betas_of(spark, path.grpnet(frame, Response(MultiGaussian(), ("y", "x3")), path.Options(lmda_path_size=20, early_exit=False)).betas)


@query(solved(L_SQL, *M_SQL, lambdas(*ONES, 20, 0.01), descent(3, *ONES, 300), "late AS (SELECT * FROM fit WHERE i >= 15)", select="SELECT (i - 15)::INT AS lmda_idx, (j - 1)::INT AS feature_idx, round(b[j], 5) + 0e0 AS beta FROM late, range(1, 4) t(j)"))
def warm_started_path(spark, sf_dir):
    frame, response = measures(spark, sf_dir)
    first = path.grpnet(frame, response, path.Options(lmda_path_size=20, early_exit=False))
    late = path.grpnet(frame, response, path.Options(lmda_path=first.lmdas[15:], early_exit=False, warm_start=path.grpnet(frame, response, path.Options(lmda_path=first.lmdas[:15], early_exit=False))))
    return betas_of(spark, late.betas)


def centred_cov(spark, sf_dir) -> tuple[np.ndarray, np.ndarray]:
    s = path.gaussian_statistics(*measures(spark, sf_dir))
    return s["cxx"], s["cxy"][:, 0]


@query(solved(L_SQL, *M_SQL, lambdas(*ONES, 12, 0.01, 0.7), descent(3, *ONES, 300, 0.7), select=betas_sql(3)))
def covariance_path(spark, sf_dir):
    A, v = centred_cov(spark, sf_dir)
    return betas_of(spark, path.gaussian_cov(A, v, options=path.Options(alpha=0.7, lmda_path_size=12, intercept=False, early_exit=False)).betas)


@query(solved(L_SQL, statistics(["x0", "x1"], ["y"]), kronecker(2, 1), "lam AS (SELECT f, i, 0.05e0 / (i + 1) AS lam FROM gv, range(5) t(i))", descent(2, [0, 1], [1, 1], 300), select="SELECT i::INT AS lmda_idx, (j - 1)::INT AS feature_idx, CASE WHEN j = 3 THEN 0e0 ELSE round(b[j], 5) + 0e0 END AS beta FROM fit, range(1, 4) t(j)"))
def pinned_path(spark, sf_dir):
    A, v = centred_cov(spark, sf_dir)
    return betas_of(spark, path.pin_solve(A, v, [0.05 / (i + 1) for i in range(5)], [0, 1]))


@query(solved(L_SQL, statistics(["x0", "x1", "x2"], ["y"], "q", centre=False), kronecker(3, 1), "lam AS (SELECT f, 0 AS i, 0e0 AS lam FROM gv)", descent(3, *ONES, 2000, bounds={0: ("-0.1e0", "0.5e0"), 1: ("-0.3e0", "0e0"), 2: ("0e0", "3e-1")}), select="SELECT (j - 1)::INT AS j, round(b[j], 6) + 0e0 AS beta FROM fit, range(1, 4) t(j)"))
def bvls_box(spark, sf_dir):
    frame, _ = measures(spark, sf_dir)
    return vector(spark, bounded.bvls(frame, "y", [-0.1, -0.3, 0.0], [0.5, 0.0, 0.3], weight="q") + 0.0, "beta", 6)


@query(solved(L_SQL, *M_SQL, lambdas(*ONES, 30, 0.001), descent(3, *ONES, 300), "devs AS (SELECT i, (2 * list_dot_product(v, b) - list_dot_product(b, list_transform(G, lambda g: list_dot_product(g, b)))) / yy AS dev FROM fit JOIN gv USING (f))", select="SELECT min(i) FILTER (dev >= 0.1e0)::INT + 1 AS values_kept, round(min(dev) FILTER (dev >= 0.1e0), 6) AS last_dev FROM devs"))
def early_exit(spark, sf_dir):
    fit = path.grpnet(*measures(spark, sf_dir), path.Options(lmda_path_size=30, min_ratio=1e-3, adev_tol=0.1))
    return spark.createDataFrame([(len(fit.lmdas), round(float(fit.devs[-1]), 6))], "values_kept int, last_dev double")


# --- other families: one coordinate a step on rows that are summed by distinct columns ----------------------
GLM_X = ("x0", "x1", "x2")


def glm_sql(y: str, mean: str, variance: str, start: str, n: int, ratio: float, sweeps: int, by: str = "0", source: str = "lin", xs: tuple[str, ...] = GLM_X, scale: str = "1e0") -> str:
    """CTEs up to ``fit`` (f, i, lam, a, b0, b1 ...): Newton steps of one coordinate, soft-thresholded, for a path of ``n``
    values; ``mean`` and ``variance`` of a response at ``eta``."""
    p = len(xs)
    eta = "(a" + "".join(f" + b{j} * {x}" for j, x in enumerate(xs)) + ")"
    at = lambda e: e.replace("eta", eta)
    xj = f"CASE k % {p + 1} WHEN 0 THEN 1e0 " + " ".join(f"WHEN {j + 1} THEN {x}" for j, x in enumerate(xs)) + " END"
    zero = ", ".join(f"0e0 AS b{j}" for j in range(p))
    grads = ", ".join(f"abs(sum({x} * (sy - n * ym)) / sum(n)) * {scale}" for x in xs)
    moved = ", ".join(f"CASE WHEN k % {p + 1} = {j + 1} THEN sign(h * b{j} + g) * greatest(abs(h * b{j} + g) - lam, 0) / h ELSE b{j} END" for j in range(p))
    return f"""agg AS (SELECT {by} AS f, {", ".join(xs)}, count(*)::DOUBLE AS n, sum({y}) AS sy FROM {source} GROUP BY ALL),
zero AS (SELECT f, sum(sy) / sum(n) AS ym FROM agg GROUP BY f),
lam AS (SELECT f, i, top * exp(ln({ratio}e0) * i / {max(n - 1, 1)}e0) AS lam, a FROM (SELECT f, greatest({grads}) AS top, any_value({start}) AS a FROM agg JOIN zero USING (f) GROUP BY f), range({n}) t(i)),
run AS (SELECT 0 AS k, f, i, lam, a, {zero} FROM lam UNION ALL
 SELECT k + 1, f, i, lam, CASE WHEN k % {p + 1} = 0 THEN a + g / h ELSE a END, {moved} FROM (
 SELECT k, f, i, lam, a, {", ".join(f"b{j}" for j in range(p))}, sum({xj} * (sy - n * {at(mean)})) / sum(n) * {scale} AS g, sum(({xj}) * ({xj}) * n * {at(variance)}) / sum(n) * {scale} AS h
 FROM run JOIN agg USING (f) WHERE k < {sweeps * (p + 1)} GROUP BY k, f, i, lam, a, {", ".join(f"b{j}" for j in range(p))}) q),
fit AS (SELECT f, i, lam, a, {", ".join(f"b{j}" for j in range(p))} FROM run WHERE k = {sweeps * (p + 1)})"""


GLM_SELECT = " UNION ALL ".join(f"SELECT i::INT AS lmda_idx, {j}::INT AS feature_idx, round(b{j}, 4) + 0e0 AS beta FROM fit" for j in range(3))
SIGMOID = "(1e0 / (1e0 + exp(-eta)))"


def _glm(spark, sf_dir, response: Response, y: dict[str, Column], size: int = 20) -> path.PathResult:
    frame = X.dense(lineitem(spark, sf_dir).withColumns(y), GLM_X)
    return path.grpnet(frame, response, path.Options(lmda_path_size=size, min_ratio=0.05, early_exit=False))


LOGIT_Y = "(CASE WHEN y > 1.5e0 THEN 1e0 ELSE 0e0 END)"


def logit_y() -> dict[str, Column]:
    return {"b": F.when(F.col("y") > 1.5, 1.0).otherwise(0.0)}


@query(solved(L_SQL, glm_sql(LOGIT_Y, SIGMOID, f"{SIGMOID} * (1e0 - {SIGMOID})", "ln(ym / (1e0 - ym))", 20, 0.05, 300), select=GLM_SELECT))
def logit_path(spark, sf_dir):
    return betas_of(spark, _glm(spark, sf_dir, Response(family("binomial"), ("b",)), logit_y()).betas, 4)


@query(solved(L_SQL, glm_sql("floor(greatest(0e0, y))", "exp(eta)", "exp(eta)", "ln(ym)", 20, 0.05, 300), select=GLM_SELECT))
def poisson_path(spark, sf_dir):
    return betas_of(spark, _glm(spark, sf_dir, Response(family("poisson"), ("c",)), {"c": F.floor(F.greatest(F.lit(0.0), F.col("y"))).cast("double")}).betas, 4)


class Twice(Family):
    """A user family: twice the squared loss, by the methods that any family gives."""

    def gradient(self, y, eta, w, xp=None):
        return 2.0 * w * (y - eta)

    def hessian(self, y, eta, w, xp=None):
        return 2.0 * w + 0.0 * eta

    def loss(self, y, eta, w, xp=None):
        return w * (eta * eta - 2.0 * y * eta)

    def loss_full(self, y, w, xp=None):
        return -1.0 * w * y * y

    def inv_link(self, eta, xp=None):
        return eta


@query(solved(L_SQL, glm_sql("y", "eta", "1e0", "ym", 8, 0.05, 200, scale="2e0"), select=GLM_SELECT))
def user_family_path(spark, sf_dir):
    return betas_of(spark, _glm(spark, sf_dir, Response(Twice(), ("y",)), {}, 8).betas, 4)


def multinomial_sql(n: int, ratio: float, sweeps: int) -> str:
    """CTEs up to ``fit`` (i, a, b) of three classes and two columns, a list of 3 and one of 6 (column by class): a step
    takes the intercepts or one column's three coefficients, under a bound of one half on the classes' curvature."""
    score = lambda c: f"(a[{c}] + b[{c}] * x1 + b[{c + 3}] * x2)"
    den = f"({' + '.join(f'exp({score(c)})' for c in (1, 2, 3))})"
    grad = lambda x, c: f"sum({x} * (s{c} - n * exp({score(c)}) / {den})) / sum(n) / 3e0"
    x = "CASE k % 3 WHEN 0 THEN 1e0 WHEN 1 THEN x1 ELSE x2 END"
    return f"""agg AS (SELECT x1, x2, count(*)::DOUBLE AS n, sum(CASE WHEN y < 1 THEN 1e0 ELSE 0e0 END) AS s1, sum(CASE WHEN y >= 1 AND y < 2 THEN 1e0 ELSE 0e0 END) AS s2, sum(CASE WHEN y >= 2 THEN 1e0 ELSE 0e0 END) AS s3 FROM lin GROUP BY x1, x2),
zero AS (SELECT sum(s1) / sum(n) AS p1, sum(s2) / sum(n) AS p2, sum(s3) / sum(n) AS p3 FROM agg),
top AS (SELECT greatest({", ".join(f"sqrt({' + '.join(f'pow(sum({x_} * (s{c} - n * p{c})) / sum(n) / 3e0, 2)' for c in (1, 2, 3))})" for x_ in ("x1", "x2"))}) / sqrt(3e0) AS top, any_value([ln(p1), ln(p2), ln(p3)]) AS a FROM agg, zero),
run AS (SELECT 0 AS k, i, top * exp(ln({ratio}e0) * i / {n - 1}e0) AS lam, a, [0e0, 0e0, 0e0, 0e0, 0e0, 0e0] AS b FROM top, range({n}) t(i) UNION ALL
 SELECT k + 1, i, lam, CASE WHEN k % 3 = 0 THEN [a[1] + z[1] / h, a[2] + z[2] / h, a[3] + z[3] / h] ELSE a END,
 CASE k % 3 WHEN 0 THEN b WHEN 1 THEN [z[1] * t, z[2] * t, z[3] * t, b[4], b[5], b[6]] ELSE [b[1], b[2], b[3], z[1] * t, z[2] * t, z[3] * t] END
 FROM (SELECT *, greatest(1 - lam * sqrt(3e0) / greatest(sqrt(z[1] * z[1] + z[2] * z[2] + z[3] * z[3]), 1e-300), 0) / h AS t
 FROM (SELECT k, i, lam, a, b, h, CASE k % 3 WHEN 0 THEN g WHEN 1 THEN [g[1] + h * b[1], g[2] + h * b[2], g[3] + h * b[3]] ELSE [g[1] + h * b[4], g[2] + h * b[5], g[3] + h * b[6]] END AS z
 FROM (SELECT k, i, lam, a, b, sum(({x}) * ({x}) * n) / sum(n) / 6e0 AS h, [{grad(x, 1)}, {grad(x, 2)}, {grad(x, 3)}] AS g FROM run, agg WHERE k < {sweeps * 3} GROUP BY k, i, lam, a, b) q1) q2) q3),
fit AS (SELECT i, a, b FROM run WHERE k = {sweeps * 3})"""


@query(solved(L_SQL, multinomial_sql(20, 0.05, 700), select="SELECT i::INT AS lmda_idx, (j - 1)::INT AS feature_idx, round(b[j], 4) + 0e0 AS beta FROM fit, range(1, 7) t(j)"))
def multinomial_path(spark, sf_dir):
    y = F.col("y")
    ys = {"k0": F.when(y < 1, 1.0).otherwise(0.0), "k1": F.when((y >= 1) & (y < 2), 1.0).otherwise(0.0), "k2": F.when(y >= 2, 1.0).otherwise(0.0)}
    frame = X.dense(lineitem(spark, sf_dir).withColumns(ys), ["x1", "x2"])
    fit = path.grpnet(frame, Response(family("multinomial"), tuple(ys)), path.Options(lmda_path_size=20, min_ratio=0.05, early_exit=False, irls_tol=1e-12))
    return betas_of(spark, fit.betas, 4)


COX_BASE = COX_SQL.split(",\nrk AS")[0].replace("0.2e0 * l_quantity / 50e0 - 1e0 * l_discount AS eta", "l_discount * 10e0 AS x0, CASE WHEN l_quantity > 25 THEN 1e0 ELSE 0e0 END AS x1")


def cox_path_sql(n: int, ratio: float, sweeps: int) -> str:
    """CTEs up to ``fit`` (i, lam, b0, b1) of a Breslow fit: sums by (strata, time) from the last time on."""
    xj = "CASE k % 2 WHEN 0 THEN x0 ELSE x1 END"
    back = "OVER (PARTITION BY i, strata ORDER BY tm DESC)"
    terms = lambda keys, x, e, source: f"SELECT {keys}, strata, tm, sum(sw * exp({e})) AS r0, sum(sw * exp({e}) * {x}) AS r1, sum(sw * exp({e}) * {x} * {x}) AS r2, sum(ew) AS ew, sum(ew * {x}) AS ex FROM {source} GROUP BY ALL"
    totals = lambda keys, inner: f"SELECT {keys}, sum(ex - CASE WHEN ew > 0 THEN ew * c1 / c0 ELSE 0e0 END) AS g, sum(CASE WHEN ew > 0 THEN ew * (c2 / c0 - (c1 / c0) * (c1 / c0)) ELSE 0e0 END) AS h FROM (SELECT *, sum(r0) {back} AS c0, sum(r1) {back} AS c1, sum(r2) {back} AS c2 FROM ({inner}) q) q2 GROUP BY ALL"
    zero = [totals("i", terms("0 AS i", x, "0e0", "ev")) for x in ("x0", "x1")]
    return f"""tot AS (SELECT count(*)::DOUBLE AS n FROM surv),
ev AS (SELECT strata, tm, x0, x1, sum(sw) / any_value(n) AS sw, sum(ew) / any_value(n) AS ew FROM (SELECT strata, stop AS tm, x0, x1, 1e0 AS sw, status::DOUBLE AS ew FROM surv UNION ALL SELECT strata, begin, x0, x1, -1e0, 0e0 FROM surv) q, tot GROUP BY ALL),
top AS (SELECT greatest(abs((SELECT g FROM ({zero[0]}) z0)), abs((SELECT g FROM ({zero[1]}) z1))) AS top),
run AS (SELECT 0 AS k, i, top * exp(ln({ratio}e0) * i / {n - 1}e0) AS lam, 0e0 AS b0, 0e0 AS b1 FROM top, range({n}) t(i) UNION ALL
 SELECT k + 1, i, lam, {", ".join(f"CASE WHEN k % 2 = {j} THEN sign(h * b{j} + g) * greatest(abs(h * b{j} + g) - lam, 0) / h ELSE b{j} END" for j in (0, 1))}
 FROM ({totals("k, i, lam, b0, b1", terms("k, i, lam, b0, b1", xj, "b0 * x0 + b1 * x1", f"run, ev WHERE k < {sweeps * 2}"))}) q3),
fit AS (SELECT i, lam, b0, b1 FROM run WHERE k = {sweeps * 2})"""


@query(solved(COX_BASE, cox_path_sql(10, 0.1, 25), select=" UNION ALL ".join(f"SELECT i::INT AS lmda_idx, {j}::INT AS feature_idx, round(b{j}, 4) + 0e0 AS beta FROM fit" for j in (0, 1))))
def cox_path(spark, sf_dir):
    response = Response(family("cox", tie="breslow"), weight="w", start="start", stop="stop", status="status", strata="strata")
    df = survival(spark, sf_dir).select("start", "stop", "status", "strata", "w", F.col("x1").alias("x0"), F.when(F.col("x0") > 0.5, 1.0).otherwise(0.0).alias("x1"))
    fit = path.grpnet(X.dense(df, ["x0", "x1"]), response, path.Options(lmda_path_size=10, min_ratio=0.1, early_exit=False))
    return betas_of(spark, fit.betas, 4)


@query("WITH " + L_SQL + ", g AS (SELECT sum(q * x0) / sum(q) AS m, sum(q * y) / sum(q) AS my FROM lin), s AS (SELECT sum(q * (x0 - m) * (x0 - m)) / sum(q) AS v, sum(q * (x0 - m) * (y - my)) / sum(q) AS c FROM lin, g) SELECT i::INT AS lmda_idx, 0::INT AS feature_idx, round(sign(c) * greatest(abs(c) - 0.02e0 / (i + 1), 0) / v, 5) AS beta FROM s, range(3) t(i)")
def reweighted_fit(spark, sf_dir):
    frame, response = measures(spark, sf_dir)
    return betas_of(spark, path.grpnet(frame[:, [0]], response.reweight("q"), path.Options(lmda_path=[0.02 / (i + 1) for i in range(3)], early_exit=False)).betas)


# --- cross-validation ---------------------------------------------------------------------------------------
def orders_frame(spark, sf_dir) -> X.FeatureFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("part"), (F.col("o_totalprice") / 1e5).alias("a"), (F.col("o_custkey") % 7 / 7.0).alias("b"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("c"),
        (F.col("o_orderkey") % 13 / 13.0).alias("noise"),
    )
    o = o.withColumn("y", 0.5 * F.col("a") - F.col("b") + F.col("noise"))
    return X.dense(o.withColumn("up", F.when(F.col("y") > 0.5, 1.0).otherwise(0.0)), ["a", "b", "c"])


ORD_SQL = """ord AS (SELECT *, CASE WHEN y > 0.5e0 THEN 1e0 ELSE 0e0 END AS up FROM (SELECT *, 0.5e0 * a - b + noise AS y FROM (SELECT o_orderkey, o_orderkey % 4 AS part, o_totalprice / 1e5 AS a, (o_custkey % 7) / 7e0 AS b,
 CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS c, (o_orderkey % 13) / 13e0 AS noise FROM orders) q) q2),
folds AS (SELECT ord.*, f FROM ord JOIN (SELECT unnest(range(5)) AS f) t ON f = 4 OR f <> part)"""
#: Fold 4 holds all rows: its path gives the grid.
ORD_X = ["a", "b", "c"]
CV_CTES = [ORD_SQL, statistics(ORD_X, ["y"], source="folds", by="folds.f"), kronecker(3, 1), lambdas(*ONES, 15, 0.01).replace("FROM gv,", "FROM (SELECT 4 AS g, * FROM gv WHERE f = 4) w,").replace("SELECT f, i,", "SELECT i,").replace("lam AS (", "grid AS (") + ", lam AS (SELECT f, i, lam FROM grid, gv)", descent(3, *ONES, 300)]
CV_ETA = "(my[1] - list_dot_product(mx, fit.b) + fit.b[1] * o.a + fit.b[2] * o.b + fit.b[3] * o.c)"
CV_LOSS = f"loss AS (SELECT f, i, lam, avg(0.5e0 * {CV_ETA} * {CV_ETA} - o.y * {CV_ETA}) AS loss FROM fit JOIN mean USING (f) JOIN ord o ON o.part = f GROUP BY ALL)"


def _cv(spark, sf_dir):
    return cv_grpnet(orders_frame(spark, sf_dir), Response(Gaussian(), ("y",)), n_folds=4, options=path.Options(lmda_path_size=15, min_ratio=0.01, early_exit=False), folds="part")


@query(solved(*CV_CTES, CV_LOSS, select="SELECT f::INT AS fold, i::INT AS lmda_idx, round(lam, 8) AS lmda, round(loss, 6) AS loss FROM loss"))
def cv_gaussian(spark, sf_dir):
    out = _cv(spark, sf_dir).loss_table(spark)
    return out.select("fold", "lmda_idx", r6(F.col("lmda"), "lmda"), r6(F.col("loss"), "loss", 6))


@query(solved(*CV_CTES, CV_LOSS, "best AS (SELECT i FROM (SELECT i, avg(loss) AS l FROM loss GROUP BY i) q ORDER BY l, i LIMIT 1)", select="SELECT best.i::INT AS best_idx, (j - 1)::INT AS feature_idx, round(b[j], 5) + 0e0 AS beta FROM fit JOIN best USING (i), range(1, 4) t(j) WHERE f = 4"))
def cv_refit(spark, sf_dir):
    result = _cv(spark, sf_dir)
    fit = result.fit(8)
    return spark.createDataFrame([(result.best_idx, j, round(float(x), 5) + 0.0) for j, x in enumerate(fit.betas[-1])], "best_idx int, feature_idx int, beta double")


CVL_X = ("b", "c")
CVL_ETA = "(fit.a + b0 * o.b + b1 * o.c)"


def _cv_logit_sql() -> str:
    text = glm_sql("up", SIGMOID, f"{SIGMOID} * (1e0 - {SIGMOID})", "ln(ym / (1e0 - ym))", 6, 0.05, 60, by="f", source="folds", xs=CVL_X)
    head, tail = text.split("lam AS (", 1)
    body, rest = tail.split("\nrun AS", 1)
    grid = f"own AS ({body.rstrip(',')}, lam AS (SELECT o.f, g.i, g.lam, o.a FROM (SELECT f, any_value(a) AS a FROM own GROUP BY f) o, own g WHERE g.f = 4),"
    return head + grid + "\nrun AS" + rest


@query(solved(ORD_SQL, _cv_logit_sql(), select=f"SELECT f::INT AS fold, i::INT AS lmda_idx, round(lam, 7) AS lmda, round(avg(ln(1e0 + exp({CVL_ETA})) - o.up * {CVL_ETA}), 5) AS loss FROM fit JOIN ord o ON o.part = f GROUP BY f, i, lam"))
def cv_logit(spark, sf_dir):
    frame = orders_frame(spark, sf_dir)[:, [1, 2]]
    result = cv_grpnet(frame, Response(Binomial(), ("up",)), n_folds=4, options=path.Options(lmda_path_size=6, min_ratio=0.05, early_exit=False), folds="part")
    out = result.loss_table(spark)
    return out.select("fold", "lmda_idx", r6(F.col("lmda"), "lmda", 7), r6(F.col("loss"), "loss", 5))


def cv_cox_sql(n: int, ratio: float, sweeps: int) -> str:
    """CTEs up to ``loss`` (fold, i, lam, loss): Breslow fits of three folds' training rows on the grid of all (f = 3)."""
    xj = "CASE k % 2 WHEN 0 THEN x0 ELSE x1 END"
    back = "OVER (PARTITION BY f, i, strata ORDER BY tm DESC)"
    terms = lambda keys, x, e, source: f"SELECT {keys}, strata, tm, sum(sw * exp({e})) AS r0, sum(sw * exp({e}) * {x}) AS r1, sum(sw * exp({e}) * {x} * {x}) AS r2, sum(ew) AS ew, sum(ew * {x}) AS ex FROM {source} GROUP BY ALL"
    totals = lambda keys, inner: f"SELECT {keys}, sum(ex - CASE WHEN ew > 0 THEN ew * c1 / c0 ELSE 0e0 END) AS g, sum(CASE WHEN ew > 0 THEN ew * (c2 / c0 - (c1 / c0) * (c1 / c0)) ELSE 0e0 END) AS h FROM (SELECT *, sum(r0) {back} AS c0, sum(r1) {back} AS c1, sum(r2) {back} AS c2 FROM ({inner}) q) q2 GROUP BY ALL"
    zero = [totals("f, i", terms("f, 0 AS i", x, "0e0", "ev WHERE f = 3")) for x in ("x0", "x1")]
    eta = "(b0 * x0 + b1 * x1)"
    return f"""tot AS (SELECT f, count(*)::DOUBLE AS n FROM surv, range(4) t(f) WHERE f = 3 OR part <> f GROUP BY f),
ev AS (SELECT f, strata, tm, x0, x1, sum(sw) / any_value(n) AS sw, sum(ew) / any_value(n) AS ew FROM (SELECT part, strata, stop AS tm, x0, x1, 1e0 AS sw, status::DOUBLE AS ew FROM surv UNION ALL SELECT part, strata, begin, x0, x1, -1e0, 0e0 FROM surv) q JOIN tot ON f = 3 OR part <> f GROUP BY f, strata, tm, x0, x1),
top AS (SELECT greatest(abs((SELECT g FROM ({zero[0]}) z0)), abs((SELECT g FROM ({zero[1]}) z1))) AS top),
run AS (SELECT 0 AS k, f, i, top * exp(ln({ratio}e0) * i / {n - 1}e0) AS lam, 0e0 AS b0, 0e0 AS b1 FROM top, range(3) u(f), range({n}) t(i) UNION ALL
 SELECT k + 1, f, i, lam, {", ".join(f"CASE WHEN k % 2 = {j} THEN sign(h * b{j} + g) * greatest(abs(h * b{j} + g) - lam, 0) / h ELSE b{j} END" for j in (0, 1))}
 FROM ({totals("k, f, i, lam, b0, b1", terms("k, run.f, i, lam, b0, b1", xj, "b0 * x0 + b1 * x1", f"run JOIN ev USING (f) WHERE k < {sweeps * 2}"))}) q3),
fit AS (SELECT f, i, lam, b0, b1 FROM run WHERE k = {sweeps * 2}),
own AS (SELECT f, i, lam, s, sum(CASE WHEN ew > 0 THEN ew * ln(c0) ELSE 0e0 END - said) AS loss FROM (SELECT *, sum(r0) OVER (PARTITION BY f, i, s, strata ORDER BY tm DESC) AS c0
 FROM (SELECT fit.f, i, lam, ev.f AS s, strata, tm, sum(sw * exp{eta}) AS r0, sum(ew) AS ew, sum(ew * {eta}) AS said FROM fit JOIN ev ON ev.f = 3 OR ev.f = fit.f GROUP BY ALL) q4) q5 GROUP BY ALL),
loss AS (SELECT a.f AS fold, a.i, a.lam, (a.loss - tf.n / t3.n * b.loss) / (1e0 - tf.n / t3.n) AS loss FROM own a JOIN own b ON a.s = 3 AND b.s = a.f AND b.f = a.f AND a.i = b.i JOIN tot tf ON tf.f = a.f JOIN tot t3 ON t3.f = 3)"""


@query(solved(COX_BASE.replace("AS strata,", "AS strata, (l_orderkey % 3)::INT AS part,", 1), cv_cox_sql(4, 0.2, 25), select="SELECT fold::INT AS fold, i::INT AS lmda_idx, round(lam, 7) AS lmda, round(loss, 5) AS loss FROM loss"))
def cv_cox(spark, sf_dir):
    df = survival(spark, sf_dir).select("start", "stop", "status", "strata", "w", F.col("x1").alias("x0"), F.when(F.col("x0") > 0.5, 1.0).otherwise(0.0).alias("x1"), (F.col("start") % 3).cast("int").alias("part"))
    response = Response(family("cox", tie="breslow"), weight="w", start="start", stop="stop", status="status", strata="strata")
    result = cv_grpnet(X.dense(df, ["x0", "x1"]), response, n_folds=3, options=path.Options(lmda_path_size=4, min_ratio=0.2, early_exit=False), folds="part")
    out = result.loss_table(spark)
    return out.select("fold", "lmda_idx", r6(F.col("lmda"), "lmda", 7), r6(F.col("loss"), "loss", 5))


# --- diagnostics of a path that is given, not fitted ----------------------------------------------------------
GIVEN_LMDAS, GIVEN_BETAS, GIVEN_INTER = (0.4, 0.2, 0.1), ((0.0, 0.0, 0.0), (0.25, 0.0, -0.5), (0.5, -0.25, -0.75)), (0.3, 0.2, 0.1)


def given_path(penalty=(1.0, 2.0, 1.0), starts=(0, 1, 2), sizes=(1, 1, 1), alpha: float = 0.5) -> path.PathResult:
    return path.PathResult(np.array(GIVEN_LMDAS), np.array(GIVEN_BETAS), np.array(GIVEN_INTER)[:, None], np.array([0.0, 0.2, 0.3]), ["a", "b", "c"], list(starts), list(sizes), np.array(penalty), alpha, duals=[{}, {}, {}], screen_sizes=[0, 2, 3], timings=[{"screen": 0.0, "fit": 0.0, "kkt": 0.0, "valid": True}] * 3)


GIVEN_SQL = ORD_SQL + ", given(i, lam, a0, b0, b1, b2) AS (VALUES " + ", ".join(f"({i}, {lm}e0, {a}e0, {', '.join(f'{x}e0' for x in b)})" for i, (lm, a, b) in enumerate(zip(GIVEN_LMDAS, GIVEN_INTER, GIVEN_BETAS, strict=True))) + ")"
GIVEN_ETA = "(a0 + b0 * a + b1 * b + b2 * c)"
GIVEN_G = f"gr AS (SELECT i, lam, b0, b1, b2, avg(a * (y - {GIVEN_ETA})) AS g0, avg(b * (y - {GIVEN_ETA})) AS g1, avg(c * (y - {GIVEN_ETA})) AS g2 FROM ord, given GROUP BY ALL)"
RIDGE = [f"(g{j} - lam * 0.5e0 * {w}e0 * b{j})" for j, w in enumerate((1, 2, 1))]


@query(f"WITH {GIVEN_SQL} SELECT o_orderkey, i::INT AS lmda_idx, round({GIVEN_ETA}, 10) AS eta FROM ord, given")
def predicted_rows(spark, sf_dir):
    out = diagnostic.predict(orders_frame(spark, sf_dir), given_path(), "o_orderkey")
    return out.select("o_orderkey", "lmda_idx", r6(F.col("eta"), "eta", 10))


@query(f"WITH {GIVEN_SQL} SELECT i::INT AS lmda_idx, round(avg(0.5e0 * {GIVEN_ETA} * {GIVEN_ETA} - y * {GIVEN_ETA}) + avg(0.5e0 * y * y) + any_value(lam * ({' + '.join(f'{w}e0 * abs(b{j}) * (0.5e0 + 0.25e0 * abs(b{j}))' for j, w in enumerate((1, 2, 1)))})), 7) AS value FROM ord, given GROUP BY i")
def objective_values(spark, sf_dir):
    values = diagnostic.objective(orders_frame(spark, sf_dir), Response(Gaussian(), ("y",)), given_path())
    return spark.createDataFrame([(i, round(float(x), 7)) for i, x in enumerate(values)], "lmda_idx int, value double")


@query(f"WITH {GIVEN_SQL}, n AS (SELECT count(*) AS n FROM ord) SELECT o_orderkey, round((y - {GIVEN_ETA}) / n * 1e4, 6) + 0e0 AS resid FROM ord, given, n WHERE i = 1")
def residual_rows(spark, sf_dir):
    frame = orders_frame(spark, sf_dir)
    out = diagnostic.residuals(X.dense(frame.df, [*zip(frame.names, frame.columns, strict=True), ("key", F.col("o_orderkey"))]), Response(Gaussian(), ("y",)), path.PathResult(np.array([0.2]), np.array([[*GIVEN_BETAS[1], 0.0]]), np.array([[GIVEN_INTER[1]]]), np.zeros(1), [*frame.names, "key"], [0, 1, 2, 3], [1] * 4, np.ones(4), 1.0), 0)
    return out.select(F.col("x3").cast("long").alias("o_orderkey"), (F.round(F.col("resid_0") * 1e4, 6) + 0.0).alias("resid"))


@query(f"WITH {GIVEN_SQL}, {GIVEN_G} " + " UNION ALL ".join(f"SELECT i::INT AS lmda_idx, {j}::INT AS grp, round(g{j}, 7) AS grad, round(abs({RIDGE[j]}), 7) AS norm, round(abs({RIDGE[j]}) / {0.5 * w}e0, 7) AS score FROM gr" for j, w in enumerate((1, 2, 1))))
def gradient_table(spark, sf_dir):
    d = diagnostic.Diagnostic(orders_frame(spark, sf_dir), Response(Gaussian(), ("y",)), given_path())
    rows = [(i, g, *(round(float(m[i, g]), 7) for m in (d.gradients, d.gradient_norms, d.gradient_scores))) for i in range(3) for g in range(3)]
    return spark.createDataFrame(rows, "lmda_idx int, grp int, grad double, norm double, score double")


@query(f"WITH {GIVEN_SQL}, {GIVEN_G} " + " UNION ALL ".join(f"SELECT i::INT AS lmda_idx, {j}::INT AS grp, round(abs({RIDGE[j]}) / {0.5 * w}e0, 7) AS score, lam AS lmda, b{j} <> 0 AS active, abs({RIDGE[j]}) / {0.5 * w}e0 <= lam * (1 + 1e-4) + 1e-7 AS ok FROM gr" for j, w in enumerate((1, 2, 1))))
def kkt_report(spark, sf_dir):
    out = diagnostic.Diagnostic(orders_frame(spark, sf_dir), Response(Gaussian(), ("y",)), given_path()).kkt_table(spark)
    return out.withColumnRenamed("group", "grp").withColumn("score", F.round("score", 7))


@query("WITH g(i, lam, b0, b1, b2) AS (VALUES " + ", ".join(f"({i}, {lm}e0, {', '.join(f'{x}e0' for x in b)})" for i, (lm, b) in enumerate(zip(GIVEN_LMDAS, GIVEN_BETAS, strict=True))) + "), want AS (SELECT n_nationkey AS k, 0.1e0 + 0.3e0 * n_nationkey / 24e0 AS lam FROM nation), near AS (SELECT k, want.lam, (SELECT min(g.lam) FROM g WHERE g.lam >= want.lam - 1e-15) AS hi, (SELECT max(g.lam) FROM g WHERE g.lam <= want.lam + 1e-15) AS lo FROM want) SELECT k::INT AS k, " + ", ".join(f"round(CASE WHEN hi = lo THEN h.b{j} ELSE (lam_ - lo) / (hi - lo) * h.b{j} + (hi - lam_) / (hi - lo) * l.b{j} END, 8) + 0e0 AS b{j}" for j in range(3)) + " FROM (SELECT k, lam AS lam_, hi, lo FROM near) n JOIN g h ON h.lam = hi JOIN g l ON l.lam = lo")
def interpolated_coefficients(spark, sf_dir):
    fit, rows = given_path(), []
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect():
        b, _ = diagnostic.coefficient(min(0.1 + 0.3 * r[0] / 24.0, 0.4), fit)
        rows.append((int(r[0]), *(round(float(x), 8) + 0.0 for x in b)))
    return spark.createDataFrame(rows, "k int, b0 double, b1 double, b2 double")


#: One column's lasso path in closed form: coefficient ``b``, explained share ``dev`` at six values down to a tenth of the largest.
ONE_SQL = f"""{ORD_SQL}, m AS (SELECT avg(a) AS ma, avg(y) AS my FROM ord), s AS (SELECT avg((a - ma) * (y - my)) AS c, avg((a - ma) * (a - ma)) AS v, avg((y - my) * (y - my)) AS yy FROM ord, m),
lam AS (SELECT i, abs(c) * exp(ln(0.1e0) * i / 5e0) AS lam FROM s, range(6) t(i)), one AS (SELECT i, lam, sign(c) * (abs(c) - lam) / v AS b, (c * c - lam * lam) / (v * yy) AS dev FROM lam, s)"""


def one_column_fit(spark, sf_dir) -> tuple[X.FeatureFrame, Response, path.PathResult]:
    frame, response = X.dense(orders_frame(spark, sf_dir).df, ["a"]), Response(Gaussian(), ("y",))
    return frame, response, path.grpnet(frame, response, path.Options(lmda_path_size=6, min_ratio=0.1, early_exit=False))


@query(f"WITH {ONE_SQL} SELECT i::INT AS lmda_idx, round(lam, 9) AS lmda, round(dev, 8) + 0e0 AS dev, (i > 0)::INT AS active_size, round(abs(b), 8) + 0e0 AS total FROM one")
def plot_tables(spark, sf_dir):
    """What the plots of a fitted path show."""
    d = diagnostic.Diagnostic(*one_column_fit(spark, sf_dir))
    beta = d.coefficients_table(spark).groupBy("lmda_idx").agg(F.sum(F.abs("beta")).alias("total"))
    both = d.devs_table(spark).join(d.set_sizes_table(spark).drop("lmda"), "lmda_idx").join(beta, "lmda_idx", "left")
    return both.select("lmda_idx", F.round("lmda", 9).alias("lmda"), (F.round("dev", 8) + 0.0).alias("dev"), "active_size", r6(F.coalesce("total", F.lit(0.0)), "total"))


@query(f"WITH {ONE_SQL} SELECT p.i::INT AS k, round((p.b + 3 * q.b) / 4, 8) + 0e0 AS b, round(my - ma * (p.b + 3 * q.b) / 4, 7) + 0e0 AS intercept FROM one p JOIN one q ON q.i = p.i + 1, m")
def coefficients_between(spark, sf_dir):
    """Coefficients three quarters of the way from each value of lambda to the next one."""
    fit, rows = one_column_fit(spark, sf_dir)[2], []
    for k in range(5):
        b, a = diagnostic.coefficient(0.25 * float(fit.lmdas[k]) + 0.75 * float(fit.lmdas[k + 1]), fit)
        rows.append((k, round(float(b[0]), 8) + 0.0, round(float(np.ravel(a)[0]), 7) + 0.0))
    return spark.createDataFrame(rows, "k int, b double, intercept double")


@query(f"WITH {ORD_SQL}, m AS (SELECT avg(a) AS ma, avg(y) AS my FROM ord), s AS (SELECT avg((a - ma) * (y - my)) / (avg((a - ma) * (a - ma)) + 0.1e0) AS b FROM ord, m) SELECT o_orderkey, round(my + s.b * (a - ma), 6) AS prediction FROM ord, m, s")
def estimator_predictions(spark, sf_dir):
    df = orders_frame(spark, sf_dir).df
    model = GroupElasticNet(["a"], "y", options=path.Options(alpha=0.0, lmda_path=[0.1])).fit(df)
    return model.transform(df.drop("y")).select("o_orderkey", r6(F.col("prediction"), "prediction", 6))


# --- small problems of the driver ---------------------------------------------------------------------------
P3 = [L_SQL, *M_SQL]
SMALL = descent(3, *ONES, 600)


def _cd(update: list[str], sweeps: int, name: str) -> str:
    """CTE of coordinate descent on ``gv``: ``update`` gives each coordinate from u (its linear term) and q."""
    parts = " ".join(f"WHEN {j} THEN {e}" for j, e in enumerate(update))
    u = " ".join(f"WHEN {j} THEN v[{j + 1}] - list_dot_product(G[{j + 1}], b) + G[{j + 1}][{j + 1}] * b[{j + 1}]" for j in range(3))
    q = " ".join(f"WHEN {j} THEN G[{j + 1}][{j + 1}]" for j in range(3))
    return f"""{name}_run AS (SELECT 0 AS k, [0e0, 0e0, 0e0] AS b UNION ALL SELECT k + 1, CASE k % 3 WHEN 0 THEN [x, b[2], b[3]] WHEN 1 THEN [b[1], x, b[3]] ELSE [b[1], b[2], x] END
 FROM (SELECT k, b, CASE k % 3 {parts} END AS x FROM (SELECT k, b, CASE k % 3 {u} END AS u, CASE k % 3 {q} END AS q FROM {name}_run, gv WHERE k < {sweeps * 3}) q1) q2),
{name} AS (SELECT b FROM {name}_run WHERE k = {sweeps * 3})"""


PIN = "CASE WHEN u > {p} THEN (u - {p}) / q WHEN u < -{n} THEN (u + {n}) / q ELSE 0e0 END"
QP_CTES = [
    _cd([f"sign(u) * greatest(abs(u) - {p}e0, 0) / q" for p in (0.01, 0.02, 0.005)], 600, "lasso"),
    _cd(["greatest(u / q, 0)", "least(u / q, 0)", "greatest(u / q, 0)"], 600, "nnqp"),
    _cd([PIN.format(p="0.01e0", n="0.02e0"), PIN.format(p="0.005e0", n="0.001e0"), PIN.format(p="0e0", n="0.01e0")], 600, "pinball"),
    _cd(["least(greatest(u / q, -0.3e0), 0.2e0)", "least(greatest(u / q, -0.4e0), 0.2e0)", "least(greatest(u / q, -0.3e0), 0.2e0)"], 600, "linqp"),
]


@query(solved(*P3, *QP_CTES, select=" UNION ALL ".join(f"SELECT '{n}' AS name, (j - 1)::INT AS j, round(b[j], 5) + 0e0 AS v FROM {n}, range(1, 4) t(j)" for n in ("lasso", "nnqp", "pinball", "linqp"))))
def quadratic_programs(spark, sf_dir):
    A, v = centred_cov(spark, sf_dir)
    lo, hi = np.array([-0.3, -0.4, -0.3]), 0.2
    return named_rows(spark, [
        ("lasso", qp.lasso_full(A, v, [0.01, 0.02, 0.005])), ("nnqp", qp.nnqp_full(A, v, sign=[1, -1, 1])), ("pinball", qp.pinball_full(A, v, [0.02, 0.001, 0.01], [0.01, 0.005, 0.0])),
        ("linqp", qp.linqp_full(A, v, np.eye(3), lo, hi)),
    ], 5)


NNLS_X = ["n_nationkey::DOUBLE", "n_regionkey * 2e0", "(n_nationkey * 7 % 5)::DOUBLE"]


@query(solved(
    "lin AS (SELECT * FROM nation)", statistics(NNLS_X, ["(n_nationkey * 3 % 11)::DOUBLE"], source="lin", centre=False), kronecker(3, 1), _cd(["greatest(u / q, 0)"] * 3, 2000, "nnls"),
    _cd([PIN.format(p="0.5e0", n="0.2e0")] * 3, 2000, "pinball"), select=" UNION ALL ".join(f"SELECT '{n}' AS name, (j - 1)::INT AS j, round(b[j], 5) + 0e0 AS v FROM {n}, range(1, 4) t(j)" for n in ("nnls", "pinball")),
))
def least_squares_programs(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()]
    M = np.array([[k, 2.0 * r, k * 7 % 5] for k, r in rows], float)
    y = np.array([k * 3 % 11 for k, _ in rows], float)
    S, v = M.T @ M / len(M), M.T @ y / len(M)
    return named_rows(spark, [("nnls", qp.nnls(M, y)), ("pinball", qp.pinball(np.eye(3), S, v, 0.2, 0.5))], 5)


SEQ = "seq AS (SELECT (row_number() OVER (ORDER BY s) - 1)::DOUBLE AS x, s AS y FROM (SELECT least(sum(o_totalprice) / 1e7, 0.3e0 + c_nationkey * 0e0 + sum(o_totalprice) / 1e9) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) q)"


def bent_sequence(spark, sf_dir) -> np.ndarray:
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    total = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("s"))
    return np.array(sorted(r[0] for r in total.select(F.least(F.col("s") / 1e7, 0.3 + F.col("s") / 1e9)).collect()))


@query(f"""WITH {SEQ}, t AS (SELECT p.x AS i, q.x, q.y, CASE WHEN q.x <= p.x THEN p.x - q.x ELSE 0e0 END AS t FROM seq p, seq q WHERE p.x > 0),
m AS (SELECT i, avg(t) AS mt, avg(y) AS my FROM t GROUP BY i) SELECT t.i::INT AS i, round(-pow(sum((t - mt) * (y - my)), 2) / sum((t - mt) * (t - mt)), 8) AS gain, t.i = (SELECT i FROM (SELECT t.i, pow(sum((t - mt) * (y - my)), 2) / sum((t - mt) * (t - mt)) AS s FROM t JOIN m USING (i) GROUP BY t.i) z ORDER BY s DESC LIMIT 1) AS best FROM t JOIN m USING (i) GROUP BY t.i""")
def pivot_search(spark, sf_dir):
    y = bent_sequence(spark, sf_dir)
    at, gains = qp.search_pivot(np.arange(len(y)), y)
    return spark.createDataFrame([(i, round(float(g), 8), i == at) for i, g in enumerate(gains) if i], "i int, gain double, best boolean")


@query(f"""WITH RECURSIVE {SEQ}, a(alpha) AS (VALUES (0e0), (0.3e0), (0.7e0), (1e0)), cut AS (SELECT 0 AS k, alpha, min(y) - 1 AS lo, max(y) + 1 AS hi FROM seq, a GROUP BY alpha UNION ALL
SELECT k + 1, alpha, CASE WHEN s < 0 THEN mid ELSE lo END, CASE WHEN s < 0 THEN hi ELSE mid END FROM (SELECT k, alpha, lo, hi, (lo + hi) / 2 AS mid, sum(alpha * sign((lo + hi) / 2 - y) + (1 - alpha) * ((lo + hi) / 2 - y)) AS s FROM cut, seq WHERE k < 60 GROUP BY k, alpha, lo, hi) q)
SELECT alpha, round((lo + hi) / 2, 7) AS t FROM cut WHERE k = 60""")
def penalty_centres(spark, sf_dir):
    y = bent_sequence(spark, sf_dir)
    return spark.createDataFrame([(a, round(qp.symmetric_penalty(y, a), 7)) for a in (0.0, 0.3, 0.7, 1.0)], "alpha double, t double")


@query("SELECT n_nationkey::INT AS k, round(cbrt(n_nationkey + 2e0), 8) AS brent, round(sqrt(n_nationkey + 2e0), 8) AS newton FROM nation")
def roots(spark, sf_dir):
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect()]
    return spark.createDataFrame([(int(k), round(qp.brent(lambda x, k=k: x**3 - k - 2, 0, 10), 8), round(qp.newton_root_find(lambda x, k=k: (x * x - k - 2, 2 * x), 3.0), 8)) for k in keys], "k int, brent double, newton double")


NORM_V = "sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3])"
BCD_SQL = f"""d AS (SELECT [G[1][1] + 0.1e0, G[2][2] + 0.1e0, G[3][3] + 0.1e0] AS d, v, 0.3e0 * {NORM_V} AS l1, {NORM_V} AS nv FROM gv),
low AS (SELECT *, (nv - l1) / ((d[1] * v[1] * v[1] + d[2] * v[2] * v[2] + d[3] * v[3] * v[3]) / (nv * nv)) AS lo, sqrt(pow(v[1] / d[1], 2) + pow(v[2] / d[2], 2) + pow(v[3] / d[3], 2)) AS hi FROM d),
cut AS (SELECT 0 AS k, lo AS a, hi AS b FROM low UNION ALL SELECT k + 1, CASE WHEN f > 0 THEN m ELSE a END, CASE WHEN f > 0 THEN b ELSE m END FROM (SELECT k, a, b, (a + b) / 2 AS m, {" + ".join(f"pow(v[{j}] / (d[{j}] * (a + b) / 2 + l1), 2)" for j in (1, 2, 3))} - 1 AS f FROM cut, low WHERE k < 100) q),
h AS (SELECT (a + b) / 2 AS h FROM cut WHERE k = 100), x AS (SELECT low.*, h, {", ".join(f"v[{j}] * h / (d[{j}] * h + l1) AS x{j}" for j in (1, 2, 3))} FROM low, h)"""


@query(
    solved(
        *P3, BCD_SQL,
        select=named_sql([(s, ["x1", "x2", "x3"]) for s in bcd.SOLVERS], "x") + " UNION ALL "
        + named_sql([
            ("root", ["h"]), ("lower", ["lo"]), ("upper", ["hi"]), ("function", [f"{' + '.join(f'pow(v[{j}] / (d[{j}] * 0.1e0 + l1), 2)' for j in (1, 2, 3))} - 1"]),
            ("objective", [f"{' + '.join(f'(0.5e0 * d[{j}] * x{j} * x{j} - v[{j}] * x{j})' for j in (1, 2, 3))} + l1 * h"]), ("ridge", [f"v[{j}] / d[{j}]" for j in (1, 2, 3)]), ("zero", ["0e0", "0e0", "0e0"]),
        ], "x"),
    )
)
def group_problem(spark, sf_dir):
    A, v = centred_cov(spark, sf_dir)
    quad, l1, l2 = np.diag(A), 0.3 * np.linalg.norm(v), 0.1
    x = bcd.solve(quad, v, l1, l2)
    return named_rows(spark, [
        *((s, bcd.solve(quad, v, l1, l2, s)) for s in bcd.SOLVERS), ("root", bcd.root(quad + l2, v, l1)), ("lower", bcd.root_lower_bound(quad + l2, v, l1)), ("upper", bcd.root_upper_bound(quad + l2, v, l1)),
        ("function", bcd.root_function(0.1, quad + l2, v, l1)), ("objective", bcd.objective(x, quad, v, l1, l2)), ("ridge", bcd.solve(quad, v, 0.0, l2)), ("zero", bcd.solve(quad, v, 2 * np.linalg.norm(v), l2)),
    ])


class Halfspace(constraint.Constraint):
    """A user set: x_1 + x_2 <= 0.1, by its projection alone (so it is solved by ADMM)."""

    def project(self, z):
        return z - max(z[0] + z[1] - 0.1, 0.0) / 2 * np.array([1.0, 1.0, 0.0])

    def solve_zero(self, v):
        return float(np.linalg.norm(v)), np.zeros(3)


FREE = [f"v[{j}] / 2e0" for j in (1, 2, 3)]
CLIP = lambda lo, hi: [f"least(greatest({e}, {lo}), {hi})" for e in FREE]
SLAB = f"greatest({FREE[0]} + {FREE[1]} - 0.1e0, 0) / 2e0"


@query(
    solved(
        "st1 AS (SELECT [avg(n_regionkey), -avg(n_nationkey) / 10e0, 0.5e0] AS v FROM nation)",
        select=named_sql([
            ("box", CLIP("-0.2e0", "0.3e0")), ("box_dual", [f"v[{j}] - 2e0 * ({e})" for j, e in zip((1, 2, 3), CLIP("-0.2e0", "0.3e0"), strict=True)]), ("newton", CLIP("-1e100", "0.1e0")), ("newton_dual", [f"greatest(v[{j}] - 0.2e0, 0)" for j in (1, 2, 3)]), ("admm", CLIP("-1e100", "0.1e0")),
            ("lower", CLIP("-0.3e0", "1e100")), ("upper", CLIP("-1e100", "0.2e0")), ("linear", [f"{FREE[0]} - {SLAB}", f"{FREE[1]} - {SLAB}", FREE[2]]), ("linear_dual", [f"2e0 * {SLAB}"]), ("user", [f"{FREE[0]} - {SLAB}", f"{FREE[1]} - {SLAB}", FREE[2]]),
            ("zero", ["0e0"] * 3), ("at_zero", ["sqrt(pow(least(v[1], 0), 2) + pow(least(v[2], 0), 2) + pow(least(v[3], 0), 2))"]), ("project", [f"least(greatest(v[{j}], -0.2e0), 0.3e0)" for j in (1, 2, 3)]),
        ], "st1"),
    )
)
def constrained_groups(spark, sf_dir):
    row = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.avg("n_regionkey"), F.avg("n_nationkey")).first()
    v = np.array([row[0], -row[1] / 10.0, 0.5])
    quad, l2, Q = np.full(3, 1.5), 0.5, np.linalg.qr(np.array([[1.0, 2, 0], [0, 1, 1], [1, 0, 3]]))[0]
    solve = lambda c: (lambda x, mu: (Q @ x, mu))(*c.solve(quad, Q.T @ v, 0.0, l2, Q))
    box = constraint.Box(-0.2 * np.ones(3), 0.3 * np.ones(3))
    one, admm = (constraint.OneSided(np.ones(3), 0.1 * np.ones(3), method=m) for m in ("proximal_newton", "admm"))
    linear = constraint.Linear(np.array([[1.0, 1.0, 0.0]]), [-5.0], [0.1])
    return named_rows(spark, [
        ("box", solve(box)[0]), ("box_dual", solve(box)[1]), ("newton", solve(one)[0]), ("newton_dual", solve(one)[1]), ("admm", solve(admm)[0]), ("lower", solve(constraint.lower(-0.3 * np.ones(3)))[0]), ("upper", solve(constraint.upper(0.2 * np.ones(3)))[0]),
        ("linear", solve(linear)[0]), ("linear_dual", solve(linear)[1]), ("user", solve(Halfspace())[0]), ("zero", solve(constraint.Zero(3))[0]), ("at_zero", constraint.upper(np.zeros(3)).solve_zero(v)[0]), ("project", box.project(v)),
    ])


@query("SELECT event_id, round(greatest(-1e0, least(2e0, value / 50e0)), 8) AS box, round(least(1e0, value / 50e0), 8) AS upper FROM events")
def projections(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("value") / 50.0).alias("v"))
    box, up = constraint.Box([-1.0], [2.0]), constraint.upper([1.0])

    def run(batches):
        for b in batches:
            v = b["v"].to_numpy()[:, None]
            yield b[["event_id"]].assign(box=box.project(v)[:, 0].round(8), upper=up.project(v)[:, 0].round(8))

    kind = e.schema["event_id"].dataType.simpleString()
    return e.mapInPandas(run, f"event_id {kind}, box double, upper double")


# --- screening blocks ---------------------------------------------------------------------------------------
@query(solved(L_SQL, *M_SQL, select="SELECT round((G[1][1] + G[2][2]) / 2 - sqrt(pow((G[1][1] - G[2][2]) / 2, 2) + pow(G[1][2], 2)), 8) AS small, round((G[1][1] + G[2][2]) / 2 + sqrt(pow((G[1][1] - G[2][2]) / 2, 2) + pow(G[1][2], 2)), 8) AS large FROM gv"))
def group_spectrum(spark, sf_dir):
    A, _ = centred_cov(spark, sf_dir)
    values, _ = path.Quadratic(A, [0, 2], [2, 1], [1.0, 1.0], 1.0).spectrum(0)
    return spark.createDataFrame([tuple(round(float(x), 8) for x in values)], "small double, large double")


FLAG_NORMS = ", ".join(f"({g}, sqrt({' + '.join(f'v[{j + 1}] * v[{j + 1}]' for j in range(a, a + n))}) / sqrt({n}e0))" for g, (a, n) in enumerate(zip(FLAG_STARTS, FLAG_SIZES, strict=True)))


@query(solved(
    L_SQL, statistics(FLAG_X, ["y"]), kronecker(8, 1), f"sc AS (SELECT grp_, s, row_number() OVER (ORDER BY s, grp_) - 1 AS r FROM gv, LATERAL (VALUES {FLAG_NORMS}) t(grp_, s))",
    "top AS (SELECT max(s) FILTER (r = 2) AS y0, max(s) FILTER (r = 3) AS y1, max(s) FILTER (r = 4) AS y2 FROM sc)", "bend AS (SELECT CASE WHEN pow(2 * y0 / 3 - (y1 + y2) / 3, 2) * 1.5e0 >= pow(y0 - y2, 2) / 2 THEN 1 ELSE 2 END AS b FROM top)",
    select="SELECT (4 - r)::INT AS place, grp_::INT AS grp FROM sc, bend WHERE r >= b",
))
def pivot_screening(spark, sf_dir):
    s = path.gaussian_statistics(lasso_frame(spark, sf_dir), Response(Gaussian(), ("y",)))
    norms = path.group_norms(s["cxy"][:, 0], FLAG_STARTS, FLAG_SIZES)
    found = path.pivot_rule(norms, path.default_penalty(FLAG_SIZES), 1.0, 1e9, set(), 1, least=3)
    return spark.createDataFrame(list(enumerate(found)), "place int, grp int")


# --- column subsets -----------------------------------------------------------------------------------------
EMB = 64


def emb_cov(spark, sf_dir) -> np.ndarray:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    full = cross(e, [F.lit(1.0), *(F.get("embedding", F.lit(k)).cast("double") for k in range(EMB))])
    return full[1:, 1:] / full[0, 0]


#: R0 is the covariance by loss; a step scores its columns, takes the best and regresses on it.
CSS_SCORE = """SELECT loss, j, s FROM (SELECT r.loss, r.i AS j, CASE r.loss WHEN 'least_squares' THEN sum(r.v * r.v) / any_value(d.v) WHEN 'min_det' THEN -any_value(d.v) ELSE -ln(any_value(d.v)) - sum(CASE WHEN r.j <> r.i THEN ln(e.v - r.v * r.v / d.v) ELSE 0e0 END) END AS s
 FROM {R} r JOIN {R} d ON d.loss = r.loss AND d.i = r.i AND d.j = r.i JOIN {R} e ON e.loss = r.loss AND e.i = r.j AND e.j = r.j {live} GROUP BY r.loss, r.i) q"""


def css_ctes(steps: int) -> list[str]:
    out = [f"R0 AS (SELECT loss, i, j, v FROM (SELECT a.i, b.j, avg(embedding[a.i + 1]::DOUBLE * embedding[b.j + 1]::DOUBLE) AS v FROM embeddings, range({EMB}) a(i), range({EMB}) b(j) GROUP BY ALL) s, (VALUES ('least_squares'), ('subset_factor'), ('min_det')) l(loss))"]
    for k in range(steps):
        out.append(f"B{k} AS (SELECT loss, j, s FROM ({CSS_SCORE.format(R=f'R{k}', live='')}) z QUALIFY row_number() OVER (PARTITION BY loss ORDER BY s DESC, j) = 1)")
        out.append(f"R{k + 1} AS (SELECT r.loss, r.i, r.j, r.v - x.v * y.v / d.v AS v FROM R{k} r JOIN B{k} b USING (loss) JOIN R{k} x ON x.loss = r.loss AND x.i = r.i AND x.j = b.j JOIN R{k} y ON y.loss = r.loss AND y.i = r.j AND y.j = b.j JOIN R{k} d ON d.loss = r.loss AND d.i = b.j AND d.j = b.j WHERE r.i <> b.j AND r.j <> b.j)")
    return out


@query(solved(*css_ctes(0), select=f"SELECT loss, j::INT AS j, round(s, 7) AS score FROM ({CSS_SCORE.format(R='R0', live='')}) z"))
def css_first_scores(spark, sf_dir):
    S = emb_cov(spark, sf_dir)
    rows = [(loss, j, round(float(x), 7)) for loss in css.LOSSES for j, x in enumerate(css.scores(S, set(), loss))]
    return spark.createDataFrame(rows, "loss string, j int, score double")


@query(solved(*css_ctes(3), select=" UNION ALL ".join(f"SELECT loss, {k}::INT AS step, j::INT AS feature FROM B{k}" for k in range(3))))
def css_greedy(spark, sf_dir):
    S = emb_cov(spark, sf_dir)
    rows = [(loss, k, j) for loss in css.LOSSES for k, j in enumerate(css.css_cov(S, 3, loss=loss))]
    return spark.createDataFrame(rows, "loss string, step int, feature int")


@query(solved("m AS (SELECT a.i, b.j, avg(embedding[a.i + 1]::DOUBLE * embedding[b.j + 1]::DOUBLE) AS v FROM embeddings, range(64) a(i), range(64) b(j) GROUP BY ALL)", select="SELECT 'min_det' AS loss, d.i::INT AS feature, round(d.v, 8) AS value FROM m d WHERE d.i = d.j QUALIFY row_number() OVER (ORDER BY d.v, d.i) = 1 UNION ALL SELECT 'least_squares', i::INT, round((SELECT sum(v) FROM m WHERE i = j) - s, 8) FROM (SELECT r.i, sum(r.v * r.v) / any_value(d.v) AS s FROM m r JOIN m d ON d.i = r.i AND d.j = r.i GROUP BY r.i) q QUALIFY row_number() OVER (ORDER BY s DESC, i) = 1"))
def css_swapped(spark, sf_dir):
    S, rows = emb_cov(spark, sf_dir), []
    for loss in ("min_det", "least_squares"):
        got = css.css_cov(S, subset=[7], method="swapping", loss=loss)
        rows.append((loss, got[0], round(css.loss_of(S, got, loss), 8)))
    return spark.createDataFrame(rows, "loss string, feature int, value double")


def _minor(R: str, keys: str, by: str) -> str:
    """Residual of ``R`` on its column ``by``, which must come after those it is already a residual of."""
    same = " AND ".join(f"{{0}}.{k} = r.{k}" for k in keys)
    on = lambda t: (same.format(t) + " AND ") if keys else ""
    chosen = "".join(f"r.{k}, " for k in keys)
    after = f" AND d.a > r.{keys[-1]}" if keys else ""
    return f"SELECT {chosen}d.a AS {by}, r.a, r.b, r.v - x.v * y.v / d.v AS v, d.v AS pivot FROM {R} r JOIN {R} d ON {on('d')}d.a = d.b{after} JOIN {R} x ON {on('x')}x.a = r.a AND x.b = d.a JOIN {R} y ON {on('y')}y.a = r.b AND y.b = d.a"


@query(solved(
    "r0 AS (SELECT i.i AS a, j.j AS b, avg(embedding[i.i + 1]::DOUBLE * embedding[j.j + 1]::DOUBLE) AS v FROM embeddings, range(12) i(i), range(12) j(j) GROUP BY ALL)",
    f"r1 AS ({_minor('r0', '', 'i')})", f"r2 AS ({_minor('r1', 'i', 'j')})", f"r3 AS ({_minor('r2', 'ij', 'k')})",
    """t AS (SELECT r.i, r.j, r.k, any_value(p.pivot) * any_value(q.pivot) * any_value(r.pivot) AS det, sum(r.v) AS trace, sum(CASE WHEN r.a IN (r.i, r.j, r.k) THEN 0e0 ELSE ln(r.v) END) AS logs
 FROM r3 r JOIN r2 q ON q.i = r.i AND q.j = r.j AND q.a = r.a AND q.b = r.a JOIN r1 p ON p.i = r.i AND p.a = r.a AND p.b = r.a WHERE r.a = r.b GROUP BY r.i, r.j, r.k)""",
    "u AS (SELECT i, j, k, 'least_squares' AS loss, trace AS value FROM t UNION ALL SELECT i, j, k, 'min_det', det FROM t UNION ALL SELECT i, j, k, 'subset_factor', ln(det) + logs FROM t)",
    select="SELECT loss, i || ',' || j || ',' || k AS members, round(value, 8) AS value FROM u QUALIFY row_number() OVER (PARTITION BY loss ORDER BY value, i, j, k) = 1",
))
def css_swapped_triples(spark, sf_dir):
    """The best three of twelve components: swapping from twelve starts against all 220 triples in SQL."""
    S, rows = emb_cov(spark, sf_dir)[:12, :12], []
    for loss in css.LOSSES:
        found = [css.css_cov(S, subset=[k, (k + 1) % 12, (k + 5) % 12], method="swapping", loss=loss) for k in range(12)]
        value, own = min((css.loss_of(S, sorted(own), loss), sorted(own)) for own in found)
        rows.append((loss, ",".join(map(str, own)), round(value, 8)))
    return spark.createDataFrame(rows, "loss string, members string, value double")


MODEL_X = ("l_quantity + 100 * l_discount", "l_quantity - 100 * l_tax", "l_quantity", "2 * l_quantity + l_linenumber")


@query(f"""WITH x AS (SELECT [{', '.join(f'({x})::DOUBLE' for x in MODEL_X)}] AS x FROM lineitem), s AS (SELECT i, j, covar_pop(x[i + 1], x[j + 1]) AS v FROM x, range(4) a(i), range(4) b(j) GROUP BY ALL),
q AS (SELECT d.i, ln(any_value(d.v)) + sum(CASE WHEN c.j = d.i THEN 0e0 ELSE ln(o.v - c.v * c.v / d.v) END) AS loss FROM s d JOIN s c ON c.i = d.i JOIN s o ON o.i = c.j AND o.j = c.j WHERE d.i = d.j GROUP BY d.i)
SELECT 1::INT AS size, i::INT AS member, round(loss, 6) AS loss FROM q QUALIFY row_number() OVER (ORDER BY loss, i) = 1""")
def css_model(spark, sf_dir):
    """Four centred columns that share the quantity and nothing else: the test must stop at one member, the quantity."""
    lines, columns = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), [F.expr(f"CAST({x} AS DOUBLE)") for x in MODEL_X]
    means = lines.agg(*(F.avg(x).alias(f"m{k}") for k, x in enumerate(columns))).first()
    frame = X.dense(lines, [(f"x{k}", x - float(m)) for k, (x, m) in enumerate(zip(columns, means, strict=True))])
    model = css.CSSModelSelection(1e-4, n_inits=3, n_sims=20_000, seed=4).fit(frame)
    rows = [(len(model.subset_), j, round(-model.score(frame), 6)) for j in model.subset_]
    return spark.createDataFrame(rows, "size int, member int, loss double")


# --- products -----------------------------------------------------------------------------------------------
@query("WITH " + L_SQL + " SELECT 0::INT AS j, round(avg(x2 * y), 8) AS v FROM lin UNION ALL SELECT 1::INT, round(avg(x0 * (y + 2e0 * x1)), 8) FROM lin")
def column_products(spark, sf_dir):
    frame = X.dense(lineitem(spark, sf_dir), ["x0", "x1", "x2"])
    n = frame.df.count()
    return vector(spark, [frame.cmul(2, F.col("y")) / n, frame.cmul(0, frame.ctmul(1, 2.0, F.col("y"))) / n])


@query("WITH " + L_SQL + " SELECT 'mul' AS name, j::INT AS j, round(CASE j WHEN 0 THEN avg(x0 * (2 * x1 - x3)) WHEN 1 THEN avg(x1 * (2 * x1 - x3)) WHEN 2 THEN avg(x2 * (2 * x1 - x3)) ELSE avg(x3 * (2 * x1 - x3)) END, 9) AS v FROM lin, range(4) t(j) GROUP BY j UNION ALL SELECT 'bmul', 0::INT, round(avg(x2 * (2 * x1 - x3)), 9) FROM lin UNION ALL SELECT 'dense', j::INT, round(CASE j WHEN 0 THEN avg(x0 * x0) WHEN 3 THEN avg(x1 * x1) ELSE avg(x0 * x1) END, 9) FROM lin, range(4) t(j) GROUP BY j")
def lazy_covariance(spark, sf_dir):
    frame = X.dense(lineitem(spark, sf_dir), ["x0", "x1", "x2", "x3"])
    n, lazy = frame.df.count(), X.LazyCov(frame)
    return named_rows(spark, [("mul", lazy.mul([1, 3], [2.0, -1.0]) / n), ("bmul", lazy.bmul([2], [1, 3], [2.0, -1.0]) / n), ("dense", lazy.to_dense(0, 2).ravel() / n)], 9)


@query("WITH c(i, j, a) AS (SELECT n_nationkey, n_regionkey, (n_nationkey * 5 + n_regionkey) / 10e0 FROM nation) SELECT 'bmul' AS name, j::INT AS j, round(sum(a * (i + 1)), 6) AS v FROM c WHERE i IN (1, 4, 9) AND j = 1 GROUP BY j UNION ALL SELECT 'dense', (p * 3 + q)::INT, coalesce(round(any_value(a), 6), 0e0) FROM range(3) x(p), range(3) y(q) LEFT JOIN c ON c.i = p AND c.j = q GROUP BY p, q")
def covariance_blocks(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    a = X.CovMatrix(n.select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), ((F.col("n_nationkey") * 5 + F.col("n_regionkey")) / 10.0).alias("a")))
    got = a.bmul([1], [1, 4, 9], [2.0, 5.0, 10.0]).select(F.lit("bmul").alias("name"), F.col("j").cast("int").alias("j"), r6(F.col("v"), "v", 6))
    return got.union(named_rows(spark, [("dense", a.to_dense(0, 3).ravel())]))


CON_SQL = "a AS (SELECT [[1e0, 2e0, 0e0], [0e0, -1e0, 3e0]] AS A, [avg(n_regionkey), avg(n_nationkey) / 10e0, 0.5e0] AS x FROM nation)"
CON_ROW = lambda k: f"list_dot_product(A[{k}], x)"


@query(solved(CON_SQL, select=named_sql([
    ("rmmul", [f"x[{j}] * A[1][{j}]" for j in (1, 2, 3)]), ("rvmul", [CON_ROW(2)]), ("rvtmul", [f"x[{j}] + 2e0 * A[2][{j}]" for j in (1, 2, 3)]), ("tmul", [CON_ROW(1), CON_ROW(2)]), ("mul", [f"x[1] * A[1][{j}] + x[2] * A[2][{j}]" for j in (1, 2, 3)]),
    ("cov", [f"{' + '.join(f'A[{r}][{j}] * A[{s}][{j}] * x[{j}]' for j in (1, 2, 3))}" for r in (1, 2) for s in (1, 2)]), ("sp_mul", [f"x[3] * A[2][{j}]" for j in (1, 2, 3)]),
], "a")))
def constraint_matrix(spark, sf_dir):
    row = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.avg("n_regionkey"), F.avg("n_nationkey")).first()
    x, a = np.array([row[0], row[1] / 10.0, 0.5]), X.ConstraintMatrix(np.array([[1.0, 2, 0], [0, -1, 3]]))
    return named_rows(spark, [("rmmul", a.rmmul(0, np.diag(x))), ("rvmul", a.rvmul(1, x)), ("rvtmul", a.rvtmul(1, 2.0, x)), ("tmul", a.tmul(x)), ("mul", a.mul(x[:2])), ("cov", a.cov(np.diag(x)).ravel()), ("sp_mul", a.sp_mul([1], [x[2]]))])


LONG_SQL = "(SELECT o_custkey AS row_id, (o_orderkey % 3)::INT AS col_id, sum(o_totalprice) / 1e5 AS value FROM orders GROUP BY ALL)"


@query("SELECT row_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (col_id = {j}), 0e0), 8) AS x_{j}" for j in range(3)) + f" FROM {LONG_SQL} l GROUP BY row_id")
def sparse_frame(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("row_id"), (F.col("o_orderkey") % 3).cast("int").alias("col_id")).agg((F.sum("o_totalprice") / 1e5).alias("value"))
    return X.sparse(o, 3).to_df("row_id").select("row_id", *(r6(F.col(f"x_{j}"), f"x_{j}") for j in range(3)))


def powers(frame: X.FeatureFrame, degree: int) -> X.FeatureFrame:
    """A user matrix: powers of each column, by the features that any frame gives."""
    return X.FeatureFrame(frame.df, tuple(X.Feature(f"{f.name}^{k}", F.pow(f.expr, float(k))) for f in frame.features for k in range(1, degree + 1)))


@query("WITH " + L_SQL + " " + " UNION ALL ".join(f"SELECT {2 * j + k - 1}::INT AS j, round(avg(pow(x{j}, {k}) * y), 8) AS v FROM lin" for j in range(2) for k in (1, 2)))
def user_matrix(spark, sf_dir):
    frame = powers(X.dense(lineitem(spark, sf_dir), ["x0", "x1"]), 2)
    return vector(spark, frame.mul(F.col("y")) / frame.df.count())


# --- event times --------------------------------------------------------------------------------------------
@query("WITH " + COX_SQL.split(",\nrk AS")[0] + ", b AS (SELECT strata, stop AS tm, sum(w) AS v FROM surv GROUP BY ALL) SELECT strata, tm, round(sum(v) OVER (PARTITION BY strata ORDER BY tm DESC RANGE UNBOUNDED PRECEDING), 8) AS v FROM b")
def cox_partial_sum_back(spark, sf_dir):
    s = survival(spark, sf_dir).select("strata", F.col("stop").alias("at"), F.col("w").alias("v"))
    return cox.partial_sum(s, s.select("strata", "at").distinct(), forward=False).select("strata", F.col("at").alias("tm"), r6(F.col("v"), "v"))


@query(f"""WITH {COX_SQL}, h AS (SELECT strata, tm, sum(mean / (risk - k / n::DOUBLE * tied)) AS a1, sum(mean / pow(risk - k / n::DOUBLE * tied, 2)) AS a2, sum(mean * (k / n::DOUBLE) / (risk - k / n::DOUBLE * tied)) AS t1,
 sum(mean * (k / n::DOUBLE) * (2 - k / n::DOUBLE) / pow(risk - k / n::DOUBLE * tied, 2)) AS t2 FROM haz GROUP BY ALL),
marks AS (SELECT strata, stop AS tm FROM surv UNION SELECT strata, begin FROM surv), run AS (SELECT strata, tm, t1, t2, sum(coalesce(a1, 0)) OVER o AS c1, sum(coalesce(a2, 0)) OVER o AS c2 FROM marks LEFT JOIN h USING (strata, tm) WINDOW o AS (PARTITION BY strata ORDER BY tm RANGE UNBOUNDED PRECEDING)),
g AS (SELECT s.strata, s.begin, s.stop, s.status, s.eta, s.w, s.w * exp(s.eta) AS mass, b.c1 - a.c1 - CASE WHEN s.status = 1 THEN b.t1 ELSE 0 END AS f, b.c2 - a.c2 - CASE WHEN s.status = 1 THEN b.t2 ELSE 0 END AS q FROM surv s JOIN run a ON a.strata = s.strata AND a.tm = s.begin JOIN run b ON b.strata = s.strata AND b.tm = s.stop)
SELECT strata, begin AS start, stop, status, round(eta, 8) AS eta, round(1e6 * (CASE WHEN status = 1 THEN w ELSE 0 END - mass * f), 4) + 0e0 AS grad, round(1e6 * (mass * f - mass * mass * q), 4) + 0e0 AS hess FROM g""")
def cox_rows(spark, sf_dir):
    out = cox.gradient(survival(spark, sf_dir))
    return out.select("strata", "start", "stop", "status", r6(F.col("eta"), "eta"), (F.round(F.col("grad") * 1e6, 4) + 0.0).alias("grad"), (F.round(F.col("hess") * 1e6, 4) + 0.0).alias("hess"))


# --- genotype tables ----------------------------------------------------------------------------------------
@query("SELECT row_id, " + ", ".join(f"max(CASE WHEN snp = {k} THEN coalesce(call, -9) END)::INT AS snp_{k}" for k in range(4)) + f" FROM {CALLS} c GROUP BY row_id")
def snp_dense(spark, sf_dir):
    where = Stored(spark, "calls").new()
    genotypes.write_unphased(calls(spark, sf_dir), where)
    out = genotypes.Unphased(spark, where).to_dense()
    return out.select("row_id", *(F.col(f"snp_{k}").cast("int").alias(f"snp_{k}") for k in range(4)))


@query(f"WITH n AS (SELECT count(*) AS n FROM orders) SELECT snp, any_value(n) - count(*) FILTER (call IS NULL) AS nnm, count(*) FILTER (call IS NULL OR call <> 0) AS nnz, round(sum(coalesce(call, 0)) / (any_value(n) - count(*) FILTER (call IS NULL))::DOUBLE, 8) AS impute FROM {CALLS} c, n WHERE call IS NULL OR call <> 0 GROUP BY snp")
def snp_sparse_stats(spark, sf_dir):
    known = calls(spark, sf_dir).where("call is null or call <> 0")
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return genotypes.column_stats(known, n).select("snp", "nnm", "nnz", r6(F.col("impute"), "impute"))


@query("SELECT row_id, " + ", ".join(f"coalesce(sum(call) FILTER (snp * 3 + ancestry = {j}), 0)::DOUBLE AS x_{j}" for j in range(9)) + f" FROM {HAPS} h GROUP BY row_id")
def phased_dense(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(6)))))
    haps = o.select(F.col("o_orderkey").alias("row_id"), F.floor(F.col("k") / 2).cast("int").alias("snp"), (F.col("k") % 2).alias("hap"), ((F.col("o_orderkey") * 3 + F.col("k")) % 5 % 2).cast("int").alias("call"), ((F.col("o_orderkey") + F.col("k")) % 3).cast("int").alias("ancestry"))
    where = Stored(spark, "haplotypes").new()
    genotypes.write_phased_ancestry(haps, where, 3)
    return genotypes.phased_frame(spark, where, 3, 3).to_df("row_id")
