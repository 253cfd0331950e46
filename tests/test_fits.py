"""Fits, folds, diagnostics and estimators on Spark against NumPy; registered queries against their SQL."""

import math
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import fit_queries, queries, scale_queries  # noqa: F401 (registers its queries)
from ridgeline.functions import cox, risksets
from ridgeline.functions.glm import Binomial, Gaussian, Poisson, Response, family
from ridgeline.operators import features as X
from ridgeline.operators import gram
from ridgeline.plans import bcd, constraint, cv, diagnostic, path
from ridgeline.plans.estimators import GroupElasticNet, GroupElasticNetModel
from ridgeline.sources import generators, genotypes
from ridgeline.sources.storage import Stored, shared_dir

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SLOW = {"logit_path", "poisson_path", "multinomial_path", "cox_path", "cv_cox", "cv_logit", "cox_rows", "cox_gradient", "null_models"}
QUICK = sorted(set(queries.ORACLE_SQL) - SLOW)


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, sf, duck, name):
    found = queries.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) and fit_queries.gaussian_path.__name__ in queries.QUERIES


def table(spark, rows):
    return spark.createDataFrame(rows, "x double, y double, w double")


BAD = [(1.0, None, 1.0), (float("nan"), 1.0, 1.0), (None, 1.0, 1.0), (1.0, 1.0, None), (1.0, float("inf"), 1.0), (1.0, 1.0, -1.0)]


@pytest.mark.parametrize(("f", "bad"), [*((Gaussian(), b) for b in BAD), *((f, b) for f in (Gaussian(opt=False), Binomial(), Poisson()) for b in BAD[:2])])
def test_unsound_rows_raise_or_are_dropped(spark, f, bad):
    rows = [(float(k % 7), float(k % 3 == 0), 1.0 + k % 2) for k in range(40)]
    response, options = Response(f, ("y",), "w"), path.Options(lmda_path=[0.01, 0.001], early_exit=False)
    with pytest.raises(ValueError, match="1 rows"):
        path.grpnet(X.dense(table(spark, [*rows, bad]), ["x"]), response, options)
    kept = path.grpnet(X.dense(table(spark, [*rows, bad]), ["x"]), response, replace(options, missing="drop"))
    want = path.grpnet(X.dense(table(spark, [*rows, (None, None, 0.0)]), ["x"]), response, options)  # weight 0: any value
    assert np.allclose(kept.betas, want.betas, atol=1e-8) and np.allclose(kept.intercepts, want.intercepts, atol=1e-8)


def test_products_of_many_columns(spark):
    rng = np.random.default_rng(0)
    x, w = rng.standard_normal((50, 70)), rng.random(50)
    df = spark.createDataFrame([(*map(float, r), float(v), int(k % 3)) for k, (r, v) in enumerate(zip(x, w, strict=True))], ", ".join(f"c{j} double" for j in range(70)) + ", w double, g int").repartition(3)
    cols = [F.col(f"c{j}") for j in range(70)]
    assert np.allclose(gram.cross(df, cols, F.col("w")), x.T @ (x * w[:, None]))
    assert np.allclose(gram.block(df, cols[:9], cols, F.col("w")), x[:, :9].T @ (x * w[:, None]))
    assert np.allclose(gram.sums(df, cols, F.col("w")), w @ x) and np.allclose(gram.sums(df, cols, F.col("w"), squares=True), w @ x**2)
    for n in (2, 70):
        got = gram.cross_by(df, cols[:n], F.col("w"), F.col("g"), 3)
        for g in range(3):
            own = np.arange(50) % 3 == g
            assert np.allclose(got[g], x[own, :n].T @ (x[own, :n] * w[own, None]))
    with pytest.raises(ValueError, match="blocks"):
        gram.by_position(df, gram.MOST_ENTRIES + 1, lambda cols: np.zeros(1))
    frame = X.dense(df, [f"c{j}" for j in range(70)])
    fit = path.PathResult(np.ones(40), np.tile(rng.standard_normal(70), (40, 1)), np.zeros((40, 1)), np.zeros(40), frame.names, list(range(70)), [1] * 70, np.ones(70), 1.0)
    got = diagnostic.predict(frame, fit, "w").where("lmda_idx = 39").collect()  # beyond one projection
    assert np.allclose(sorted(r["eta"] for r in got), sorted(x @ fit.betas[39])) and len(got) == 50


@pytest.mark.parametrize("name", ["gaussian", "binomial", "cox"])
def test_folds_equal_fits_of_masked_weights(spark, name):
    d = generators.dense(spark, 60, 3, 3, glm=name if name != "gaussian" else "gaussian", seed=4, sparsity=0.2)
    df = d["df"].withColumn("part", (F.col("row_id") % 3).cast("int")).cache()
    frame, response = X.dense(df, d["X"]), replace(d["response"], family=Gaussian(opt=False)) if name == "gaussian" else d["response"]
    size = 2 if name == "cox" else 3
    options = path.Options(lmda_path_size=size, min_ratio=0.3, early_exit=False, irls_tol=1e-12)
    found = cv.cv_grpnet(frame, response, n_folds=3, options=options, folds="part")
    for f in range(3):
        masked = replace(frame, df=df.withColumn("m", F.when(F.col("part") == f, 0.0).otherwise(1.0)))
        fit = path.grpnet(masked, response.reweight("m"), replace(options, lmda_path=found.lmdas))
        full, train = path.GlmData(frame, response), path.GlmData(masked, response.reweight("m"))
        for i in range(size):
            b, a = diagnostic.coefficient(float(found.lmdas[i]), fit)
            want = (full.loss(b, np.atleast_1d(a)) - 2 / 3 * train.loss(b, np.atleast_1d(a))) / (1 / 3)
            assert found.losses[f, i] == pytest.approx(want, abs=2e-5), (f, i)
    assert found.best_idx == int(np.argmin(found.avg_losses))
    df.unpersist()


def jobs_of(spark, work) -> int:
    tracker, name = spark.sparkContext.statusTracker(), f"jobs-{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(name, name)
    work()
    n = len(tracker.getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("other", "other")
    return n


def test_gaussian_folds_and_path_scores_take_one_pass(spark):
    d = generators.dense(spark, 80, 3, 3, seed=3, sparsity=0.3)
    frame = X.dense(d["df"].cache(), d["X"])
    jobs = [jobs_of(spark, lambda n=n, size=size: cv.cv_grpnet(frame, d["response"], "row_id", n, path.Options(lmda_path_size=size, early_exit=False))) for n, size in ((2, 2), (9, 30))]
    assert abs(jobs[0] - jobs[1]) <= 2  # few sums are planned as columns, many as one batch map
    fits = [path.grpnet(frame, d["response"], path.Options(lmda_path_size=size, early_exit=False)) for size in (2, 25)]
    jobs = [jobs_of(spark, lambda fit=fit: diagnostic.objective(frame, d["response"], fit)) for fit in fits]
    assert jobs[0] == jobs[1]


def test_folds_keep_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None if k % 4 == 0 else k // 2, float(k)) for k in range(100)] + [(None, 0.0)] * 10, "key long, v double")
    dealt = cv.assign_folds(df.repartition(3), "key", 4)
    assert dealt.count() == 110 and sorted(r["count"] for r in dealt.groupBy("fold").count().collect()) == [27, 27, 28, 28]


def test_limits_raise_where_nothing_was_fitted(spark):
    d = generators.dense(spark, 60, 3, 3, seed=3, sparsity=0.0)
    frame = X.dense(d["df"], d["X"])
    with pytest.raises(RuntimeError):
        path.grpnet(frame, d["response"], path.Options(lmda_path=[1e-3], max_iters=1, tol=0.0, early_exit=False))
    seen = []
    fit = path.grpnet(frame, d["response"], path.Options(lmda_path_size=4, early_exit=False, check_state=True, progress=lambda *x: seen.append(x)))
    assert [s[0] for s in seen] == [0, 1, 2, 3] and [s[1] for s in seen] == list(fit.lmdas)


def test_covariance_diagnostics():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 4))
    A, v = x.T @ x / 50, rng.standard_normal(4)
    fit = path.gaussian_cov(A, v, options=path.Options(intercept=False, early_exit=False, lmda_path_size=6))
    d = diagnostic.CovarianceDiagnostic(A, v, fit)
    assert (d.gradient_scores <= fit.lmdas[:, None] + 1e-7).all() and (np.diff(d.objective()) <= 1e-9).all()
    assert np.allclose(d.gradients, v - fit.betas @ A)


def test_running_sums_spread_one_stratum(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(1).alias("strata"), (F.col("id") * 0.5).alias("at"), (F.col("id") % 7).cast("double").alias("v"))
    for back in (False, True):
        rows = np.array([(r["at"], r["run_v"]) for r in cox.running(df, ["v"], back).collect()])
        rows = rows[np.argsort(rows[:, 0])]
        v = np.arange(n) % 7.0
        assert np.allclose(rows[:, 1], np.cumsum(v[::-1])[::-1] if back else np.cumsum(v))
    cuts = cox.edges_of(df).first()[0]
    share = np.diff(np.searchsorted(cuts, np.arange(n) * 0.5, side="left"), prepend=-1)
    assert len(cuts) == cox.PARTS - 1 and (share > 0).sum() >= 200  # parts that hold rows
    assert cox.running(df.limit(0), ["v"]).isEmpty()


def test_sums_over_a_tie_in_closed_form(spark):
    from fractions import Fraction as Q

    cases = [(n, r, t) for n in (1, 2, 16, 17, 95, 1000) for r, t in ((3.0, 3.0), (3.0, 2.0), (3.0, 0.031), (3.0, 0.029), (1e9, 1e-3), (2.0, 0.0))]
    names = ("inverse", "share", "inverse2", "share2", "squares2", "log")
    df = spark.createDataFrame(cases, "n long, r double, t double")
    for tie in ("efron", "breslow"):
        sums = cox.Ties("n", tie, "r", "t")
        got = df.select("n", "r", "t", *(F.expr(getattr(sums, x)()).alias(x) for x in names)).collect()
        assert len(got) == len(cases)
        for row in got:
            shares = [Q(k, row["n"]) if tie == "efron" else Q(0) for k in range(row["n"])]
            left = [Q(row["r"]) - s * Q(row["t"]) for s in shares]
            want = {
                "inverse": sum(1 / x for x in map(float, left)), "share": sum(float(s / x) for s, x in zip(shares, left, strict=True)), "inverse2": sum(1 / float(x) ** 2 for x in left),
                "share2": sum(float(s / x / x) for s, x in zip(shares, left, strict=True)), "squares2": sum(float(s * s / x / x) for s, x in zip(shares, left, strict=True)), "log": sum(math.log(x) for x in map(float, left)),
            }
            for x in names:
                assert row[x] == pytest.approx(want[x], rel=1e-10, abs=1e-300), (tie, row, x)


def test_tie_sums_of_arrays_equal_those_of_columns(spark):
    cases = [(n, r, t) for n in (1, 2, 16, 17, 95, 1000, 10**8) for r, t in ((3.0, 3.0), (3.0, 2.0), (3.0, 0.031), (3.0, 0.029), (1e9, 1e-3), (2.0, 0.0))]
    df = spark.createDataFrame(cases, "n long, r double, t double")
    names = ("inverse", "share", "inverse2", "share2", "squares2", "log")
    for tie in ("efron", "breslow"):
        sums = cox.Ties("n", tie, "r", "t")
        for row in df.select("n", "r", "t", *(F.expr(getattr(sums, x)()).alias(x) for x in names)).collect():
            got = risksets.step_sums(*(np.array([float(row[c])]) for c in "nrt"), tie)
            assert got[:, 0] == pytest.approx([row[x] for x in names], rel=1e-11, abs=1e-300), (tie, row)


@pytest.mark.parametrize("tie", ["efron", "breslow"])
def test_risk_sets_of_any_number_of_tasks(spark, monkeypatch, tie):
    """A tie of a third of all rows, a stratum of most of them, single-row strata and a null one, cut anywhere."""
    rng, n = np.random.default_rng(5), 400
    x = rng.standard_normal((n, 3)).round(1)
    strata = ["hot" if k < 300 else None if k < 350 else f"s{k}" for k in range(n)]
    stop = np.where(np.arange(n) < 140, 5.0, rng.integers(2, 9, n).astype(float))
    start = np.where(np.arange(n) % 3 == 0, stop - 1 - np.arange(n) % 2, float("-inf"))
    rows = [(strata[k], float(start[k]), float(stop[k]), int(k % 5 > 0), *map(float, x[k]), 0.1 * (k % 3), 0.5 + k % 2, k % 3) for k in range(n)]
    df = spark.createDataFrame(rows, "strata string, start double, stop double, status int, x0 double, x1 double, x2 double, o double, w double, fold int").cache()
    beta = np.array([0.3, 0.0, -0.4])
    asks = [path.Ask(beta, np.zeros(1), [0, 1, 2], [0, 2]), path.Ask(beta, np.zeros(1), [0, 2], [2], 1, 1.5), path.Ask(beta, np.zeros(1), [0, 2], [], 2, 1.25, slopes=False)]
    found = {}
    for tasks, cells, numbers in ((1, 1 << 21, 1 << 24), (3, 1, 1 << 24), (29, 1, 1), (90, 1 << 21, 1 << 24)):
        monkeypatch.setattr(risksets, "LEAST_ROWS", n)
        monkeypatch.setattr(risksets, "MOST_ROWS", n // tasks)
        monkeypatch.setattr(risksets, "CELLS", cells)
        monkeypatch.setattr(risksets, "DRIVER_NUMBERS", numbers)  # 1: each ask in passes of its own
        sets = risksets.RiskSets.of(df, ["x0", "x1", "x2"], tie, "o", "fold")
        assert sets.tasks >= tasks
        found[tasks] = sets.answer(asks)
        parts = {r["part"] for r in sets.table.where("strata = 'hot' and at = 5").select("part").collect()}
        assert len(parts) >= min(tasks, 2) and (tasks < 29 or len(parts) >= 6)  # the tie is spread
        sets.release()
    for got in found.values():
        for a, b in zip(got, found[1], strict=True):
            for name in ("g", "H", "loss", "full"):
                assert np.allclose(a[name], b[name], rtol=1e-9, atol=1e-9), name
    for ask, got in zip(asks, found[1], strict=True):  # against the plan of columns
        w = F.col("w") * ask.scale
        eta = 0.3 * F.col("x0") - 0.4 * F.col("x2") + F.col("o")
        masked = df.withColumn("eta", eta).withColumn("w", w if ask.fold is None else F.when(F.col("fold") == ask.fold, 0.0).otherwise(w))
        assert got["loss"] == pytest.approx(cox.loss(masked.withColumn("strata", F.coalesce("strata", F.lit("none"))), tie).first()[0])
        assert got["full"] == pytest.approx(cox.loss_full(masked, tie).first()[0])
    df.unpersist()


def test_cox_folds_take_passes_that_do_not_grow_with_folds(spark):
    d = generators.dense(spark, 60, 3, 3, glm="cox", seed=4, sparsity=0.2)
    df = d["df"].withColumn("part", (F.col("row_id") % 6).cast("int")).cache()
    options = path.Options(lmda_path_size=2, min_ratio=0.5, early_exit=False)
    jobs = [jobs_of(spark, lambda n=n: cv.cv_grpnet(X.dense(df.withColumn("fold", F.col("part") % n), d["X"]), d["response"], n_folds=n, options=options, folds="fold")) for n in (2, 6)]
    assert jobs[1] <= 1.5 * jobs[0], jobs
    df.unpersist()


def test_a_tie_of_any_size_costs_the_same(spark):
    n = 100_000_000
    sums = cox.Ties("n", "efron", "r", "t")
    began = time.monotonic()
    row = spark.createDataFrame([(n, 2.0 * n, 1.0 * n)], "n long, r double, t double").select(F.expr(sums.inverse()).alias("a"), F.expr(sums.log()).alias("l")).first()
    assert time.monotonic() - began < 10
    assert row["a"] == pytest.approx(math.log(2), rel=1e-7)  # the integral of 1 / (2 - s)
    assert row["l"] / n == pytest.approx(math.log(n) + 2 * math.log(2) - 1, rel=1e-7)


def test_estimator_params_copies_and_files(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    d = generators.dense(spark, 60, 3, 3, seed=3, sparsity=0.3)
    df = d["df"].cache()
    est = GroupElasticNet(d["X"], "y", options=path.Options(lmda_path_size=5, early_exit=False))
    other = est.copy({est.alpha: 0.5, est.lmda_path_size: 3})
    assert est.getOrDefault("alpha") == 1.0 and len(other.fit(df).path.lmdas) == 3 and other.fit(df).path.alpha == 0.5
    est.save(str(tmp_path / "est"))
    assert np.allclose(GroupElasticNet.load(str(tmp_path / "est")).fit(df).coef_, est.fit(df).coef_)
    model = est.fit(df)
    model.save(str(tmp_path / "model"))
    again = GroupElasticNetModel.load(str(tmp_path / "model"))
    assert np.allclose(again.coef_, model.coef_) and again.uid == model.uid
    want = sorted(r["prediction"] for r in model.transform(df).collect())
    assert np.allclose(sorted(r["prediction"] for r in again.transform(df.drop("y")).collect()), want)  # no response is read
    Pipeline(stages=[est]).fit(df).save(str(tmp_path / "pipe"))
    assert np.allclose(sorted(r["prediction"] for r in PipelineModel.load(str(tmp_path / "pipe")).transform(df).collect()), want)
    expr = GroupElasticNet([("a", F.col(d["X"][0]) * 2)], "y", solver="cv_grpnet", key="row_id", n_folds=3, options=path.Options(lmda_path_size=4, early_exit=False)).fit(df)
    assert expr.transform(df).count() == 60 and 0 <= expr.score(df) <= 1
    with pytest.raises(ValueError):
        expr.save(str(tmp_path / "no"))


@pytest.mark.parametrize("d", [1, 2, 4])
def test_proximal_newton_equals_admm(d):
    rng = np.random.default_rng(d)
    for _ in range(6):
        quad, v, Q = rng.random(d) + 0.2, 2 * rng.standard_normal(d), np.linalg.qr(rng.standard_normal((d, d)))[0]
        A, lo, hi = rng.standard_normal((d + 1, d)), -0.1 * rng.random(d + 1) - 0.01, 0.1 * rng.random(d + 1) + 0.01
        pairs = [[make(m) for m in ("proximal_newton", "admm")] for make in (
            lambda m: constraint.Box(-0.1 * np.ones(d), 0.2 * np.ones(d), method=m), lambda m: constraint.OneSided(np.ones(d), 0.1 * np.ones(d), method=m),
            lambda m: constraint.Linear(A, lo, hi, method=m),  # noqa: B023
        )]
        for newton, admm in pairs:
            for l1 in (0.0, 0.05):
                (x, mu), (z, _) = newton.solve(quad, v, l1, 0.1, Q), admm.solve(quad, v, l1, 0.1, Q)
                assert np.allclose(x, z, atol=2e-5)
                left = v - quad * x - 0.1 * x - Q.T @ newton.gradient(mu)
                assert np.linalg.norm(left) <= l1 + 1e-5 if not np.any(np.abs(x) > 1e-9) else np.allclose(left, l1 * x / np.linalg.norm(x), atol=1e-5)


def test_solvers_differ_in_what_they_try():
    trace: list[float] = []
    x = bcd.solve([0.5, 2.0], [1.0, -2.0], 0.3, 0.1, "newton_abs_debug", trace=trace)
    assert len(trace) > 1 and trace == sorted(trace) and np.linalg.norm(x) == pytest.approx(trace[-1])
    with pytest.raises(ValueError):
        bcd.solve([0.0], [2.0], 1.0)


def test_matrix_rows_without_calls_and_binary_genotypes(spark, tmp_path):
    rng = np.random.default_rng(3)
    calls = rng.integers(-1, 3, (11, 5))
    codes = np.array([3, 2, 0, 1])[calls]  # of 0, 1, 2 copies and missing
    raw = bytearray(b"\x6c\x1b\x01")
    for k in range(5):
        for at in range(0, 11, 4):
            raw.append(sum(int(c) << 2 * n for n, c in enumerate(codes[at : at + 4, k])))
    (tmp_path / "x.bed").write_bytes(bytes(raw))
    got = np.full((11, 5), -5)
    for r in genotypes.read_bed(spark, str(tmp_path / "x.bed"), 11, 5, block=2).collect():
        got[r["row_id"], r["snp"]] = -1 if r["call"] is None else r["call"]
    assert (got == calls).all()
    (tmp_path / "x.bim").write_text("1\trs1\t0\t100\tA\tG\n2\trs2\t0.5\t200\tC\tT\n")
    (tmp_path / "x.fam").write_text("f1 p1 0 0 1 -9\nf1 p2 0 0 2 1.5\n")
    assert [(r["snp"], r["bp"], r["a2"]) for r in genotypes.read_variants(spark, str(tmp_path / "x.bim")).orderBy("bp").collect()] == [("rs1", 100, "G"), ("rs2", 200, "T")]
    assert [(r["person"], r["sex"], r["phenotype"]) for r in genotypes.read_samples(spark, str(tmp_path / "x.fam")).orderBy("person").collect()] == [("p1", 1, "-9"), ("p2", 2, "1.5")]
    with pytest.raises(Exception, match="no genotypes"):
        genotypes.read_bed(spark, str(tmp_path / "x.fam"), 11, 5).collect()


def test_stored_tables_are_dropped(spark):
    import os

    store = Stored(spark, "test")
    one, path_of = store.put(spark.range(3))
    assert one.count() == 3 and path_of.startswith(shared_dir(spark))
    store.drop(path_of)
    assert not os.path.exists(path_of.removeprefix("file:"))


def test_families_by_name():
    assert family("binomial", link="probit").link == "probit"
    with pytest.raises(ValueError):
        family("nope")


def test_equal_rows_are_added_up_before_the_steps(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), float(y), float(w), int(f)) for a, b, y, w, f in zip(rng.integers(0, 3, 900), rng.integers(0, 2, 900), rng.integers(0, 2, 900), rng.random(900), rng.integers(0, 2, 900), strict=True)]
    frame = X.dense(spark.createDataFrame(rows, "a double, b double, y double, w double, part int"), ["a", "b"])
    response, options = Response(family("binomial"), ("y",), "w"), path.Options(lmda_path_size=3, early_exit=False)
    data = path.GlmData(frame, response, options, centred=True, by=())
    data.keep()
    assert data.table.count() == 12 and data.tasks == 1
    data.release()
    added = path.grpnet(frame, response, options), cv.cv_grpnet(frame, response, n_folds=2, options=options, folds="part")
    monkeypatch.setattr(path, "ALIKE", 1000)
    each = path.grpnet(frame, response, options), cv.cv_grpnet(frame, response, n_folds=2, options=options, folds="part")
    assert np.allclose(added[0].betas, each[0].betas, atol=1e-8) and np.allclose(added[0].devs, each[0].devs)
    assert np.allclose(added[1].losses, each[1].losses)


def test_cox_fits_and_gradients_read_rows_a_bounded_number_of_times(spark):
    rng = np.random.default_rng(9)
    rows = [(float(s), float(s + d), int(e), float(x), 1.0, 0.1) for s, d, e, x in zip(rng.integers(0, 4, 200), rng.integers(1, 9, 200), rng.integers(0, 2, 200), rng.integers(0, 3, 200), strict=True)]
    df = spark.createDataFrame(rows, "start double, stop double, status int, x double, w double, eta double").withColumn("strata", F.lit("a"))
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    counted = df.mapInArrow(seen, df.schema)
    response = Response(family("cox", tie="breslow"), weight="w", start="start", stop="stop", status="status", strata="strata")
    fit = path.grpnet(X.dense(counted, ["x"]), response, path.Options(lmda_path_size=3, early_exit=False))
    assert len(fit.lmdas) == 3 and ran.value == 200
    found = cox.gradient(counted).select("grad", "hess").collect()
    assert len(found) == 200 and ran.value == 600
    assert abs(sum(r["grad"] for r in found)) < 1e-9
    with pytest.raises(ValueError, match="non-finite"):
        path.grpnet(X.dense(df.withColumn("x", F.when(F.col("x") < 2, F.col("x"))), ["x"]), response)


#: Rows that are equal more often than ``path.ALIKE``, which diagnostics must not add up, and a given fit of them.
SAME = [(float(k % 3), float(k % 2), float(k % 6 == 1), 1.0 + k % 2) for k in range(96)]


def given_fit(spark):
    frame = X.dense(spark.createDataFrame(SAME, "a double, b double, y double, w double").repartition(3), ["a", "b"])
    fit = path.PathResult(np.array([0.2, 0.1]), np.array([[0.0, 0.0], [0.25, -0.5]]), np.array([[0.3], [0.1]]), np.zeros(2), ["a", "b"], [0, 1], [1, 1], np.array([1.0, 2.0]), 0.5, duals=[{}, {}])
    return frame, Response(Binomial(), ("y",), "w"), fit


def by_hand(fit):
    """(rows, weights that sum to 1, etas and residuals by value) of ``SAME``."""
    rows = np.array(SAME)
    w = rows[:, 3] / rows[:, 3].sum()
    etas = rows[:, :2] @ fit.betas.T + fit.intercepts.ravel()
    return rows, w, etas, w[:, None] * (rows[:, 2:3] - 1 / (1 + np.exp(-etas)))


def test_gradients_of_a_given_fit_over_equal_rows(spark):
    frame, response, fit = given_fit(spark)
    rows, _, _, resid = by_hand(fit)
    d = diagnostic.Diagnostic(frame, response, fit)
    want = resid.T @ rows[:, :2]
    ridge = fit.lmdas[:, None] * 0.5 * fit.penalty * fit.betas
    assert np.allclose(d.gradients, want, atol=1e-12) and np.allclose(d.gradient_norms, np.abs(want - ridge), atol=1e-12)
    assert np.allclose(d.gradient_scores, np.abs(want - ridge) / (0.5 * fit.penalty), atol=1e-12)


def test_kkt_table_tells_a_fit_from_one_that_is_moved(spark):
    frame, response, _ = given_fit(spark)
    fit = path.grpnet(frame, response, path.Options(lmda_path=[0.05, 0.01], early_exit=False, irls_tol=1e-12))
    report = diagnostic.Diagnostic(frame, response, fit).kkt_table(spark).collect()
    assert len(report) == 4 and all(r["ok"] for r in report) and any(r["active"] for r in report)
    moved = diagnostic.Diagnostic(frame, response, replace(fit, intercepts=fit.intercepts + 1.0)).kkt_table(spark)
    assert not all(r["ok"] for r in moved.collect())


def test_objective_of_a_given_fit_over_equal_rows(spark):
    frame, response, fit = given_fit(spark)
    rows, w, etas, _ = by_hand(fit)
    loss = w @ (np.logaddexp(0, etas) - rows[:, 2:3] * etas)
    penalty = np.array([lmda * np.sum(fit.penalty * (0.5 * np.abs(b) + 0.25 * b**2)) for lmda, b in zip(fit.lmdas, fit.betas, strict=True)])
    assert np.allclose(diagnostic.objective(frame, response, fit), loss + penalty, atol=1e-12)  # the saturated loss of 0s and 1s is 0
    assert np.allclose(diagnostic.objective(frame, response, fit, add_penalty=False), loss, atol=1e-12)


def test_plot_tables_of_a_fitted_path(spark):
    frame, response, _ = given_fit(spark)
    response = replace(response, family=Gaussian())
    fit = path.grpnet(frame, response, path.Options(lmda_path=[1.0, 0.02, 0.01], early_exit=False))
    d = diagnostic.Diagnostic(frame, response, fit)
    devs, sizes = (sorted(t.collect()) for t in (d.devs_table(spark), d.set_sizes_table(spark)))
    assert [r["lmda_idx"] for r in devs] == [0, 1, 2] and np.allclose([r["dev"] for r in devs], fit.devs)
    assert [r["active_size"] for r in sizes] == [int(np.count_nonzero(b)) for b in fit.betas] and sizes[0]["active_size"] == 0
    betas = {(r["lmda_idx"], r["feature"]): r["beta"] for r in d.coefficients_table(spark).collect()}
    assert all(betas.get((i, n), 0.0) == pytest.approx(fit.betas[i][j]) for i in range(3) for j, n in enumerate("ab"))


@pytest.mark.parametrize("name", ["gaussian", "binomial", "cox"])
def test_residuals_give_every_row_though_rows_are_equal(spark, name):
    frame, response, fit = given_fit(spark)
    rows, w, etas, resid = by_hand(fit)
    if name == "cox":  # all weight falls at one time: each event less its share of the risk
        frame = replace(frame, df=frame.df.withColumn("t", F.lit(1.0)).withColumn("e", F.col("y").cast("int")))
        risk = w * np.exp(etas[:, 1])
        want = w * rows[:, 2] - risk / risk.sum() * (w @ rows[:, 2])
        response = Response(family("cox", tie="breslow"), weight="w", stop="t", status="e")
    else:
        want = resid[:, 1] if name == "binomial" else w * (rows[:, 2] - etas[:, 1])
        response = replace(response, family=Binomial() if name == "binomial" else Gaussian())
    found = [(r["x0"], r["x1"], r["resid_0"]) for r in diagnostic.residuals(frame, response, fit, 1).collect()]
    assert len(found) == len(SAME)
    assert np.allclose(sorted(r for *_, r in found), sorted(want), atol=1e-12)
