"""Data sets drawn on executors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators.comoments import comoments
from ridgeline.sources import generators

FAMILIES = ["gaussian", "multigaussian", "binomial", "poisson", "multinomial", "cox"]


@pytest.mark.parametrize("glm", FAMILIES)
def test_rows_do_not_depend_on_partitions(spark, glm, monkeypatch):
    monkeypatch.setattr(generators, "BLOCK", 64)
    K = 3 if glm.startswith("multi") else 1
    d = generators.dense_rows(spark, 150, 4, 2, K, glm, rho=0.3, sparsity=0.2, seed=5)
    small = generators.dense(spark, 20, 4, 2, K, glm, seed=5)
    assert d["df"].schema == small["df"].schema and d["response"].y == small["response"].y and len(d["groups"]) == 2
    rows = d["df"].collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        again = generators.dense_rows(spark, 150, 4, 2, K, glm, rho=0.3, sparsity=0.2, seed=5)["df"].collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert sorted(rows) == sorted(again) and sorted(r["row_id"] for r in rows) == list(range(150))
    assert len({r["x_0"] for r in rows}) == 150
    other = generators.dense_rows(spark, 150, 4, 2, K, glm, seed=6)["df"].collect()
    assert not {r["x_0"] for r in rows} & {r["x_0"] for r in other}
    assert generators.dense_rows(spark, 0, 4, 2, K, glm)["df"].count() == 0


def test_rows_follow_their_laws(spark):
    d = generators.dense_rows(spark, 200_000, 3, 3, rho=0.4, sparsity=0.0, snr=2.0, seed=1)
    m = comoments(d["df"], [F.col(c) for c in [*d["X"], "y"]])
    cov, b = m.about / m.weight, d["beta"][:, 0]
    want = 0.6 * np.eye(3) + 0.4
    assert m.weight == 200_000 and np.allclose(cov[:3, :3], want, atol=0.02) and np.allclose(np.linalg.solve(cov[:3, :3], cov[:3, 3]), b, atol=0.03)
    assert cov[3, 3] == pytest.approx(1.5 * (b @ want @ b), rel=0.03)


def test_calls_follow_their_laws(spark):
    calls = generators.snp_unphased_rows(spark, 10_000, 7, seed=2)
    got = calls.agg(F.count("*").alias("n"), F.avg(F.col("call").isNull().cast("int")).alias("missing"), *(F.avg((F.col("call") == k).cast("int")).alias(f"c{k}") for k in range(3))).first()
    assert got["n"] == 70_000 and calls.select("row_id", "snp").distinct().count() == 70_000
    assert [got[c] for c in ("missing", "c0", "c1", "c2")] == pytest.approx([0.1, 0.7, 0.25, 0.05], abs=0.01)
    phased = generators.snp_phased_ancestry_rows(spark, 5000, 3, 4, seed=2)
    got = phased.agg(F.count("*").alias("n"), F.avg("call").alias("ones"), F.min("ancestry").alias("low"), F.max("ancestry").alias("high"), F.countDistinct("snp", "hap").alias("places")).first()
    assert (got["n"], got["low"], got["high"], got["places"]) == (30_000, 0, 3, 6) and got["ones"] == pytest.approx(0.25, abs=0.02)
    small, _, _ = generators.snp_phased_ancestry(spark, 3, 2, 2)
    assert small.schema == phased.schema and generators.snp_unphased(spark, 3, 2)[0].schema == calls.schema
