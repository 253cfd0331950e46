"""Feature frames, fits and genotype tables on Spark against NumPy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import queries
from ridgeline.functions import cox, risksets
from ridgeline.functions.glm import Gaussian, Response, family
from ridgeline.operators import features as X
from ridgeline.operators.gram import cross
from ridgeline.plans import bounded, cv, diagnostic, path
from ridgeline.plans.css import CSSModelSelection
from ridgeline.plans.estimators import GroupElasticNet
from ridgeline.sources import generators, genotypes


@pytest.fixture(scope="module")
def data(spark):
    d = generators.dense(spark, 80, 5, 3, seed=3, sparsity=0.3)
    d["df"] = d["df"].cache()
    return d


def matrix(frame, *order):
    rows = frame.to_df("row_id").orderBy("row_id", *order).collect()
    return np.array([r[1:] for r in rows], float)


def test_products_equal_numpy(data):
    x, frame = data["x"], X.dense(data["df"], data["X"])
    y = np.array([r[0] for r in data["df"].orderBy("row_id").select("y").collect()])
    w = F.lit(1.0 / 80)
    assert np.allclose(frame.mul(F.col("y"), w), x.T @ y / 80)
    assert frame.cmul(2, F.col("y")) == pytest.approx(x[:, 2] @ y)
    assert np.allclose(frame.bmul(1, 3, F.col("y")), x[:, 1:4].T @ y)
    assert np.allclose(frame.cov(1, 3, w), x[:, 1:4].T @ x[:, 1:4] / 80)
    assert np.allclose(frame.sq_mul(w), (x**2).mean(axis=0))
    m = frame.mean(w)
    assert np.allclose(m, x.mean(axis=0)) and np.allclose(frame.var(m, w), x.var(axis=0))
    many = cross(data["df"], [*frame.columns, *frame.columns, *frame.columns])
    assert np.allclose(many, np.tile(x.T @ x, (3, 3)))
    lazy = X.LazyCov(frame)
    assert np.allclose(lazy.mul([1, 3], [2.0, -1.0]), 2 * (x.T @ x)[1] - (x.T @ x)[3]) and np.allclose(lazy.to_dense(0, 2), (x.T @ x)[:2, :2])
    z = X.standardize(frame)
    assert np.allclose(matrix(z), (x - x.mean(0)) / x.std(0)) and np.allclose(z.mean(w), 0)
    assert np.allclose(matrix(frame[:, [3, 0]]), x[:, [3, 0]]) and np.allclose(matrix(X.concatenate([frame, z])), np.hstack([x, (x - x.mean(0)) / x.std(0)]))
    with pytest.raises(ValueError):
        frame.subset_columns([1, 1])
    relu = X.convex_relu(frame, [F.col("x_0") > 0], gated=False)
    g = x * (x[:, :1] > 0)
    assert np.allclose(matrix(relu), np.hstack([g, -g]))
    k = X.kronecker_eye(frame, 2, "row_id")
    assert np.allclose(matrix(k, "class_id"), np.kron(x, np.eye(2)))


def test_interactions_and_sparse(spark):
    rng = np.random.default_rng(1)
    d = np.column_stack([rng.standard_normal(30), rng.integers(0, 3, 30), rng.integers(0, 2, 30)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(d)], "row_id long, a double, b double, c double")
    frame = X.dense(df, ["a", "b", "c"])
    hot = lambda j, n: np.stack([(d[:, j] == k).astype(float) for k in range(n)])
    got = matrix(X.interaction(frame, {0: [1], 1: [2]}, [0, 3, 2]))
    left = np.stack([np.ones(30), d[:, 0]])
    want = [a * b for b in hot(1, 3) for a in left] + [a * b for b in hot(2, 2) for a in hot(1, 3)]
    assert np.allclose(got, np.array(want).T)
    assert np.allclose(matrix(X.one_hot(frame, [0, 3, 2])), np.column_stack([d[:, 0], *hot(1, 3), *hot(2, 2)]))
    long = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "row_id long, col_id int, value double")
    assert np.allclose(matrix(X.sparse(long, 2)), [[0, 2], [3, 0]])


def test_gaussian_fit_diagnostics_and_cv(spark, data):
    frame = X.FeatureFrame(data["df"], X.dense(data["df"], data["X"]).features, tuple(data["groups"]))
    response = data["response"]
    fit = path.grpnet(frame, response, path.Options(lmda_path_size=8, early_exit=False))
    fit.check(1e-7)
    slow = path.grpnet(frame, Response(Gaussian(opt=False), ("y",)), path.Options(lmda_path=fit.lmdas[:3], early_exit=False))
    assert np.allclose(slow.betas, fit.betas[:3], atol=1e-4)
    d = diagnostic.Diagnostic(frame, response, fit)
    assert d.kkt_table(spark).where("not ok").count() == 0
    eta = np.array([r[0] for r in d.linear_preds("row_id").where("lmda_idx = 7").orderBy("row_id").select("eta").collect()])
    assert np.allclose(eta, data["x"] @ fit.betas[7] + fit.intercepts[7][0])
    assert (np.diff(d.objective()) <= 1e-9).all()
    b, _ = diagnostic.coefficient((fit.lmdas[2] + fit.lmdas[3]) / 2, fit)
    assert np.allclose(b, (fit.betas[2] + fit.betas[3]) / 2)
    assert {t: n.count() > 0 for t, n in fit.tables(spark).items() if t != "duals"} == {"path": True, "betas": True, "timings": True}
    folds = cv.assign_folds(data["df"], "row_id", 7)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sum(sizes) == 80 and max(sizes) - min(sizes) <= 1
    result = cv.cv_grpnet(frame, response, "row_id", 4, path.Options(lmda_path_size=5, early_exit=False))
    assert result.losses.shape == (4, 5) and result.best_idx == int(np.argmin(result.avg_losses)) and len(result.fit(3).lmdas) in (1, 3)
    assert np.allclose(bounded.bvls(frame, "y", -10.0, 10.0), np.linalg.lstsq(data["x"], np.array([r[0] for r in data["df"].orderBy("row_id").select("y").collect()]), rcond=None)[0], atol=1e-6)
    assert CSSModelSelection(0.05, n_sims=200, seed=0).fit(frame).subset_ is not None


@pytest.mark.parametrize("name", ["binomial", "poisson", "multinomial"])
def test_glm_fit_is_optimal(spark, name):
    K = 3 if name == "multinomial" else 1
    d = generators.dense(spark, 60, 3, 3, K=K, glm=name, seed=1, sparsity=0.2)
    frame = X.dense(d["df"].cache(), d["X"])
    fit = path.grpnet(frame, d["response"], path.Options(lmda_path_size=2, min_ratio=0.3, irls_tol=1e-12))
    assert not fit.error
    fit.check(1e-4)
    model = GroupElasticNet(d["X"], list(d["response"].y), family_name=name, options=path.Options(lmda_path=[fit.lmdas[-1]])).fit(d["df"])
    assert np.allclose(model.coef_, fit.betas[-1], atol=1e-3) and 0 <= model.score(d["df"]) <= 1
    assert model.transform(d["df"]).columns[-1] == "prediction"


@pytest.mark.parametrize("tie", ["efron", "breslow"])
def test_cox_against_definition(spark, tie):
    rng = np.random.default_rng(2)
    n = 40
    start = rng.integers(0, 10, n).astype(float)
    stop, status, strata, w, eta = start + 1 + rng.integers(0, 6, n), rng.integers(0, 2, n), rng.integers(0, 2, n), rng.random(n) * (rng.random(n) > 0.2), rng.standard_normal(n)
    df = spark.createDataFrame([(i, float(start[i]), float(stop[i]), int(status[i]), int(strata[i]), float(w[i]), float(eta[i])) for i in range(n)], "i int, start double, stop double, status int, strata int, w double, eta double")

    def loss(e):
        total = -np.sum(w * status * e)
        for s in (0, 1):
            for t in np.unique(stop[(strata == s) & (status == 1) & (w > 0)]):
                tied = (strata == s) & (status == 1) & (w > 0) & (stop == t)
                risk = np.sum((w * np.exp(e))[(strata == s) & (start < t) & (stop >= t)])
                m = tied.sum()
                for k in range(m):
                    share = k / m if tie == "efron" else 0.0
                    total += w[tied].mean() * np.log(risk - share * np.sum((w * np.exp(e))[tied]))
        return total

    assert cox.loss(df, tie).first()[0] == pytest.approx(loss(eta))
    rows = cox.gradient(df, tie).orderBy("i").collect()
    h = 1e-5
    for i in range(n):
        up, down = eta.copy(), eta.copy()
        up[i] += h
        down[i] -= h
        assert rows[i]["grad"] == pytest.approx(-(loss(up) - loss(down)) / (2 * h), abs=1e-5)
        assert rows[i]["hess"] == pytest.approx((loss(up) + loss(down) - 2 * loss(eta)) / h**2, abs=1e-3)
    assert cox.loss_full(df, tie).first()[0] <= loss(eta) + 1e-9
    x = rng.standard_normal((n, 3))
    wide = df.join(spark.createDataFrame([(i, *map(float, x[i])) for i in range(n)], "i int, x0 double, x1 double, x2 double"), "i")

    def derivatives(df, p, curved):
        sets = risksets.RiskSets.of(df, [f"x{k}" for k in range(p)], tie, "eta")
        found = sets.answer([path.Ask(np.zeros(p), np.zeros(1), range(p), curved)])[0]
        sets.release()
        return found["g"][:, 0], found["H"][1:, 0, 1:, 0], found["loss"]

    g, H, value = derivatives(wide, 3, [0, 2])
    at = lambda b: loss(eta + x @ b)
    e = 1e-4 * np.eye(3)
    assert value == pytest.approx(loss(eta))
    assert np.allclose(g, [-(at(v) - at(-v)) / 2e-4 for v in e], atol=1e-5)
    second = [[(at(e[i] + e[j]) - at(e[i] - e[j]) - at(e[j] - e[i]) + at(-e[i] - e[j])) / 4e-8 for j in (0, 2)] for i in (0, 2)]
    assert np.allclose(H, second, atol=1e-4)
    empty = df.limit(0)
    assert cox.loss(empty, tie).first()[0] == 0.0
    g, H, value = derivatives(wide.limit(0), 1, [0])
    assert not g.any() and not H.any() and value == 0.0


def test_cox_path_is_optimal_by_either_curvature(spark):
    d = generators.dense(spark, 60, 3, 3, glm="cox", seed=4, sparsity=0.2)
    frame = X.dense(d["df"].cache(), d["X"])
    options = path.Options(lmda_path_size=2, min_ratio=0.4, irls_tol=1e-12)
    fit = path.grpnet(frame, d["response"], options)
    assert not fit.error and np.any(fit.betas[-1])
    fit.check(1e-5)
    other = path.grpnet(frame, d["response"], replace(options, cox_most=0))  # as with many columns
    assert not other.error and np.allclose(other.betas, fit.betas, atol=1e-4) and np.allclose(other.devs, fit.devs, atol=1e-6)


def test_majoriser_and_newton_agree(spark):
    d = generators.dense(spark, 60, 3, 3, K=3, glm="multinomial", seed=1, sparsity=0.2)
    frame, options = X.dense(d["df"].cache(), d["X"]), path.Options(lmda_path_size=2, min_ratio=0.4, irls_tol=1e-12)
    newton = path.grpnet(frame, d["response"], options)
    other = path.grpnet(frame, d["response"], replace(options, newton_most=0))
    assert not newton.error and np.allclose(other.betas, newton.betas, atol=1e-4)


def test_folds_are_even_and_do_not_depend_on_partitions(spark):
    df = spark.range(1003)
    one, other = (cv.assign_folds(df.repartition(k), "id", 7, seed=5) for k in (1, 6))
    assert sorted(r["count"] for r in one.groupBy("fold").count().collect()) == [143] * 5 + [144] * 2
    assert one.exceptAll(other).isEmpty() and one.count() == 1003
    assert cv.assign_folds(df.limit(0), "id", 7).isEmpty()


def test_genotypes(spark, tmp_path):
    calls, x = generators.snp_unphased(spark, 30, 4, seed=1)
    genotypes.write_unphased(calls, str(tmp_path / "g"))
    g = genotypes.Unphased(spark, str(tmp_path / "g"))
    got = np.array([r[1:] for r in g.to_dense().orderBy("row_id").collect()])
    assert (got == x).all()
    for r in g.stats.collect():
        c = x[:, r["snp"]]
        assert r["nnm"] == (c >= 0).sum() and r["nnz"] == (c != 0).sum() and r["impute"] == pytest.approx(c[c >= 0].mean())
    with pytest.raises(ValueError):
        genotypes.write_unphased(calls.withColumn("call", F.lit(3)), str(tmp_path / "bad"))
    haps, c, a = generators.snp_phased_ancestry(spark, 20, 3, 2, seed=2)
    genotypes.write_phased_ancestry(haps, str(tmp_path / "p"), 2)
    want = np.zeros((20, 6))
    for i in range(20):
        for j in range(6):
            want[i, j // 2 * 2 + a[i, j]] += c[i, j]
    assert np.allclose(matrix(genotypes.phased_frame(spark, str(tmp_path / "p"), 3, 2)), want)


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert family("cox").tie == "efron"
    assert queries.QUERIES["lambda_max"](spark, sf).first()[0] > 0
