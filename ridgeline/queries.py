"""Registered queries over the driver's tables, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import cox
from ridgeline.functions.glm import Binomial, Gaussian, Multinomial, MultiGaussian, Poisson, Response, family
from ridgeline.functions.special import Columns, erfc_sql
from ridgeline.operators import features as X
from ridgeline.operators.comoments import comoments
from ridgeline.plans import bounded, constraint, css, diagnostic, path
from ridgeline.plans.cv import assign_folds, cv_grpnet
from ridgeline.sources import genotypes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column, name: str, digits: int = 8) -> Column:
    return F.round(c.cast("double"), digits).alias(name)


# --- shared inputs: a deterministic response over near-independent columns ---------------------------------
def y_syn() -> Column:
    return 0.05 * F.col("l_quantity") - 8.0 * F.col("l_discount") + F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0) + (F.col("l_extendedprice") - 50000.0) / 50000.0


L_SQL = """lin AS (SELECT l_quantity / 50e0 AS x0, l_discount * 10e0 AS x1, l_tax * 10e0 AS x2, (l_extendedprice - 5e4) / 5e4 AS x3, l_quantity AS q, l_returnflag AS rf, l_linestatus AS ls,
 0.05e0 * l_quantity - 8e0 * l_discount + CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END + (l_extendedprice - 5e4) / 5e4 AS y FROM lineitem)"""
NAMES = ("x0", "x1", "x2", "x3")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select(
        (F.col("l_quantity") / 50.0).alias("x0"), (F.col("l_discount") * 10.0).alias("x1"), (F.col("l_tax") * 10.0).alias("x2"), ((F.col("l_extendedprice") - 5e4) / 5e4).alias("x3"),
        F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), y_syn().alias("y"),
    )


def flags(spark, sf_dir) -> X.FeatureFrame:
    """Three measures, the codes of a three-level and a two-level flag."""
    code = F.when(F.col("rf") == "A", 0).when(F.col("rf") == "N", 1).otherwise(2)
    status = F.when(F.col("ls") == "F", 0).otherwise(1)
    return X.dense(lineitem(spark, sf_dir), ["x0", "x1", "x2", ("rf", code), ("ls", status)])


def vector(spark: SparkSession, values, name: str = "v", digits: int = 8) -> DataFrame:
    return spark.createDataFrame([(i, round(float(x), digits) + 0.0) for i, x in enumerate(values)], f"j int, {name} double")


def listing(expressions: list[str], source: str, prefix: str = L_SQL, name: str = "v", digits: int = 8) -> str:
    """SQL of one row (j, v) per aggregate expression."""
    rows = " UNION ALL ".join(f"SELECT {i}::INT AS j, round(({e})::DOUBLE, {digits}) + 0e0 AS {name} FROM {source}" for i, e in enumerate(expressions))
    return f"WITH {prefix} {rows}" if prefix else rows


# --- statistics ---------------------------------------------------------------------------------------------
@query("WITH " + L_SQL + " " + " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, round(avg(x{i} * x{j}), 8) AS v FROM lin" for i in range(4) for j in range(4)))
def gram_lineitem(spark, sf_dir):
    from ridgeline.operators.gram import cross

    full = cross(lineitem(spark, sf_dir), [F.lit(1.0), *X.dense(lineitem(spark, sf_dir), NAMES).columns])  # rows are counted in the same pass
    g = full[1:, 1:] / full[0, 0]
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 8)) for i in range(4) for j in range(4)], "i int, j int, v double")


@query(listing([f"sum(x{j} * y * q) / sum(q)" for j in range(4)], "lin"))
def xtv_weighted(spark, sf_dir):
    frame = X.dense(lineitem(spark, sf_dir), NAMES)
    total = frame.df.agg(F.sum("q")).first()[0]
    return vector(spark, frame.mul(F.col("y"), F.col("q") / total))


@query(listing([f"sum(x{j} * x{j} * q) / sum(q)" for j in range(4)], "lin"))
def sq_mul(spark, sf_dir):
    frame = X.dense(lineitem(spark, sf_dir), NAMES)
    total = frame.df.agg(F.sum("q")).first()[0]
    return vector(spark, frame.sq_mul(F.col("q") / total))


@query("WITH " + L_SQL + " " + " UNION ALL ".join(f"SELECT {j}::INT AS j, round(avg(x{j}), 8) AS mean, round(var_pop(x{j}), 8) AS var FROM lin" for j in range(4)))
def col_mean_var(spark, sf_dir):
    frame = X.dense(lineitem(spark, sf_dir), NAMES)
    w = F.lit(1.0 / frame.df.count())
    m = frame.mean(w)
    v = frame.var(m, w)
    return spark.createDataFrame([(j, round(float(m[j]), 8), round(float(v[j]), 8)) for j in range(4)], "j int, mean double, var double")


@query(listing(["avg(x1 * y)", "avg(x2 * y)"], "lin"))
def block_product(spark, sf_dir):
    frame = X.dense(lineitem(spark, sf_dir), NAMES)
    return vector(spark, frame.bmul(1, 2, F.col("y")) / frame.df.count())


@query("SELECT o_orderkey, round(o_totalprice / 1e5 * 0.5e0 + 1e0, 8) AS eta_0, round(o_totalprice / 1e5 * 2e0 + (o_custkey % 7) * -0.25e0, 8) AS eta_1 FROM orders")
def predict_path(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    frame = X.dense(df, [("price", F.col("o_totalprice") / 1e5), ("cust", (F.col("o_custkey") % 7).cast("double")), ("one", F.lit(1.0))])
    out = frame.sp_tmul(np.array([[0.5, 0.0, 1.0], [2.0, -0.25, 0.0]]), "o_orderkey")
    return out.select("o_orderkey", r6(F.col("eta_0"), "eta_0"), r6(F.col("eta_1"), "eta_1"))


@query("WITH c(i, j, a) AS (SELECT n_nationkey, n_regionkey, (n_nationkey * 5 + n_regionkey) / 10e0 FROM nation) SELECT j::INT AS j, round(sum(a * (i + 1)), 8) AS v FROM c WHERE i IN (1, 4, 9) GROUP BY j")
def cov_product(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    a = X.CovMatrix(n.select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), ((F.col("n_nationkey") * 5 + F.col("n_regionkey")) / 10.0).alias("a")))
    return a.mul([1, 4, 9], [2.0, 5.0, 10.0]).select(F.col("j").cast("int"), r6(F.col("v"), "v"))


# --- derived columns ----------------------------------------------------------------------------------------
PART = "(SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice / 1e3 AS r FROM part)"


def part(spark, sf_dir) -> X.FeatureFrame:
    return X.dense(spark.read.parquet(f"{sf_dir}/part.parquet"), [("s", F.col("p_size").cast("double")), ("r", F.col("p_retailprice") / 1e3)])


@query(f"SELECT p_partkey, round((s - ms) / ss, 8) AS s, round((r - mr) / sr, 8) AS r FROM {PART} p, (SELECT avg(s) ms, stddev_pop(s) ss, avg(r) mr, stddev_pop(r) sr FROM {PART} p2)")
def standardize_cols(spark, sf_dir):
    out = X.standardize(part(spark, sf_dir)).to_df("p_partkey")
    return out.select("p_partkey", r6(F.col("s"), "s"), r6(F.col("r"), "r"))


@query("WITH " + L_SQL + ", st AS (SELECT " + ", ".join(f"avg(x{j}) m{j}, stddev_pop(x{j}) s{j}" for j in range(4)) + " FROM lin) " + " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, round(avg((x{i} - m{i}) / s{i} * (x{j} - m{j}) / s{j}), 8) + 0e0 AS v FROM lin, st" for i in range(4) for j in range(i, 4)))
def standardized_gram(spark, sf_dir):
    frame = X.dense(lineitem(spark, sf_dir), NAMES)
    m = comoments(frame.df, frame.columns)
    z = X.standardized_gram(m, m.mean, np.sqrt(np.diag(m.about) / m.weight)) / m.weight
    return spark.createDataFrame([(i, j, round(float(z[i, j]), 8) + 0.0) for i in range(4) for j in range(i, 4)], "i int, j int, v double")


@query(listing([*(f"avg(x{j})" for j in range(3)), *(f"avg(CASE WHEN rf = '{v}' THEN 1e0 ELSE 0e0 END)" for v in "ANR"), *(f"avg(CASE WHEN ls = '{v}' THEN 1e0 ELSE 0e0 END)" for v in "FO")], "lin"))
def one_hot_flags(spark, sf_dir):
    frame = X.one_hot(flags(spark, sf_dir), [0, 0, 0, 3, 2])
    return vector(spark, frame.mul(F.lit(1.0)) / frame.df.count())


@query("WITH " + L_SQL + ", k AS (SELECT CASE rf WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS i, 3 + CASE ls WHEN 'F' THEN 0 ELSE 1 END AS j FROM lin) SELECT i::INT AS i, j::INT AS j, count(*)::DOUBLE AS v FROM k GROUP BY ALL UNION ALL SELECT i::INT, i::INT, count(*)::DOUBLE FROM k GROUP BY i UNION ALL SELECT j::INT, j::INT, count(*)::DOUBLE FROM k GROUP BY j")
def one_hot_gram(spark, sf_dir):
    g = X.eager_cov(X.one_hot(flags(spark, sf_dir).subset_columns([3, 4]), [3, 2]))
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(5) for j in range(i, 5) if g[i, j]], "i int, j int, v double")


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders")
def category_codes(spark, sf_dir):
    return X.codes(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority").select("o_orderkey", F.col("o_orderpriority_code").alias("code"))


@query(listing(["avg(x0)", "avg(x1)", "avg(x0 * x1)"], "lin"))
def interaction_cont_cont(spark, sf_dir):
    frame = X.interaction(flags(spark, sf_dir), {0: [1]}, [0, 0, 0, 3, 2])
    return vector(spark, frame.mul(F.lit(1.0)) / frame.df.count())


@query(listing([f"avg(CASE WHEN rf = '{v}' THEN {x} ELSE 0e0 END)" for v in "ANR" for x in ("1e0", "x0")], "lin"))
def interaction_cont_disc(spark, sf_dir):
    frame = X.interaction(flags(spark, sf_dir), {0: [3]}, [0, 0, 0, 3, 2])
    return vector(spark, frame.mul(F.lit(1.0)) / frame.df.count())


@query(listing([f"avg(CASE WHEN rf = '{a}' AND ls = '{b}' THEN 1e0 ELSE 0e0 END)" for b in "FO" for a in "ANR"], "lin"))
def interaction_disc_disc(spark, sf_dir):
    frame = X.interaction(flags(spark, sf_dir), {3: None}, [0, 0, 0, 3, 2])
    return vector(spark, frame.subset_columns(range(frame.p - 6, frame.p)).mul(F.lit(1.0)) / frame.df.count())


@query("SELECT o_orderkey, round(o_totalprice / 1e5, 8) AS price, round(c_acctbal / 1e3, 8) AS bal FROM orders JOIN customer ON o_custkey = c_custkey")
def concat_cols(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("k", F.col("o_orderkey"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    joined = o.select("k", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("k", "c_acctbal")
    frame = X.concatenate([X.dense(o, [("price", F.col("o_totalprice") / 1e5)]), X.dense(joined, [("bal", F.col("c_acctbal") / 1e3)])], key="k")
    return frame.to_df("k").select(F.col("k").alias("o_orderkey"), r6(F.col("price"), "price"), r6(F.col("bal"), "bal"))


@query("SELECT round(c_acctbal / 1e3, 8) AS bal FROM customer UNION ALL SELECT round(s_acctbal / 1e3, 8) FROM supplier")
def concat_rows(spark, sf_dir):
    frames = [X.dense(spark.read.parquet(f"{sf_dir}/{t}.parquet"), [("bal", F.col(c) / 1e3)]) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))]
    return X.concatenate(frames, axis=0).to_df().select(r6(F.col("bal"), "bal"))


@query("SELECT round(c_acctbal / 1e3, 8) AS b0_bal, 0e0 AS b1_bal FROM customer UNION ALL SELECT 0e0, round(s_acctbal / 1e3, 8) FROM supplier")
def block_diag(spark, sf_dir):
    frames = [X.dense(spark.read.parquet(f"{sf_dir}/{t}.parquet"), [("bal", F.col(c) / 1e3)]) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))]
    return X.block_diag(frames).to_df().select(r6(F.col("b0_bal"), "b0_bal"), r6(F.col("b1_bal"), "b1_bal"))


@query(f"SELECT p_partkey, round(r, 8) AS r FROM {PART} p WHERE s > 25")
def row_and_column_subset(spark, sf_dir):
    return part(spark, sf_dir)[F.col("p_size") > 25, [1]].to_df("p_partkey").select("p_partkey", r6(F.col("r"), "r"))


@query("SELECT o_orderkey, round(o_totalprice / 1e5, 8) AS price FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_subset(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return X.dense(o, [("price", F.col("o_totalprice") / 1e5)]).subset_rows(c, "o_custkey").to_df("o_orderkey").select("o_orderkey", r6(F.col("price"), "price"))


RELU = [f"avg(CASE WHEN {m} THEN {c} ELSE 0e0 END)" for m in ("s > 25", "r > 1.5e0") for c in ("s", "r")]


@query(listing(RELU, f"{PART} p", ""))
def gated_relu(spark, sf_dir):
    frame = X.convex_relu(part(spark, sf_dir), [F.col("p_size") > 25, F.col("p_retailprice") / 1e3 > 1.5])
    return vector(spark, frame.mul(F.lit(1.0)) / frame.df.count())


@query(listing([*RELU, *(f"-({x})" for x in RELU)], f"{PART} p", ""))
def convex_relu(spark, sf_dir):
    frame = X.convex_relu(part(spark, sf_dir), [F.col("p_size") > 25, F.col("p_retailprice") / 1e3 > 1.5], gated=False)
    return vector(spark, frame.mul(F.lit(1.0)) / frame.df.count())


@query(listing([f"avg(x{j} * CASE WHEN rf = '{v}' THEN 1e0 ELSE 0e0 END)" for j in range(2) for v in "ANR"], "lin"))
def kron_class_grad(spark, sf_dir):
    base = lineitem(spark, sf_dir)
    frame = X.kronecker_eye(X.dense(base, ["x0", "x1"]), 3, "rf")
    label = F.when(F.col("rf") == "A", 0).when(F.col("rf") == "N", 1).otherwise(2)
    return vector(spark, frame.mul(F.when(label == F.col("class_id"), 1.0).otherwise(0.0)) / base.count())


# --- families -----------------------------------------------------------------------------------------------
def eta() -> Column:
    return 0.3 * F.col("x0") - 0.4 * F.col("x1") + 0.2


ETA_SQL = "(0.3e0 * x0 - 0.4e0 * x1 + 0.2e0)"
BIN_SQL = "(CASE WHEN rf = 'R' THEN 1e0 ELSE 0e0 END)"


def sums(spark, df: DataFrame, terms: list[Column]) -> DataFrame:
    row = df.agg(*(F.avg(t).alias(f"s{k}") for k, t in enumerate(terms))).first()
    return vector(spark, row)


@query(listing([f"avg(y - {ETA_SQL})", "avg(1e0)", f"avg(0.5e0 * {ETA_SQL} * {ETA_SQL} - y * {ETA_SQL})", "avg(-0.5e0 * y * y)"], "lin"))
def gaussian_family(spark, sf_dir):
    y, one = F.col("y"), F.lit(1.0)
    f = Gaussian()
    return sums(spark, lineitem(spark, sf_dir), [f.gradient(y, eta(), one, Columns), f.hessian(y, eta(), one, Columns), f.loss(y, eta(), one, Columns), f.loss_full(y, one, Columns)])


SIG = f"(1e0 / (1e0 + exp(-{ETA_SQL})))"


@query(listing([f"avg({BIN_SQL} - {SIG})", f"avg({SIG} * (1e0 - {SIG}))", f"avg(ln(1e0 + exp({ETA_SQL})) - {BIN_SQL} * {ETA_SQL})", "avg(0e0)", f"avg({SIG})"], "lin"))
def logit_family(spark, sf_dir):
    y, one, f = F.when(F.col("rf") == "R", 1.0).otherwise(0.0), F.lit(1.0), Binomial()
    return sums(spark, lineitem(spark, sf_dir), [f.gradient(y, eta(), one, Columns), f.hessian(y, eta(), one, Columns), f.loss(y, eta(), one, Columns), f.loss_full(y, one, Columns), f.inv_link(eta(), Columns)])


PHI, PHIC = f"(0.5e0 * {erfc_sql(f'(-{ETA_SQL} / sqrt(2e0))')})", f"(0.5e0 * {erfc_sql(f'({ETA_SQL} / sqrt(2e0))')})"


PDF = f"(exp(-0.5e0 * {ETA_SQL} * {ETA_SQL}) / sqrt(2e0 * pi()))"


@query(listing([f"avg({PHI})", f"avg(-({BIN_SQL} * ln({PHI}) + (1e0 - {BIN_SQL}) * ln({PHIC})))", f"avg(exp(-0.5e0 * {ETA_SQL} * {ETA_SQL}) / sqrt(2e0 * pi()) * ({BIN_SQL} / {PHI} - (1e0 - {BIN_SQL}) / {PHIC}))",
    f"avg({PDF} * ({BIN_SQL} * ({PDF} + {ETA_SQL} * {PHI}) / ({PHI} * {PHI}) + (1e0 - {BIN_SQL}) * ({PDF} - {ETA_SQL} * {PHIC}) / ({PHIC} * {PHIC})))"], "lin"))
def probit_family(spark, sf_dir):
    y, one, f = F.when(F.col("rf") == "R", 1.0).otherwise(0.0), F.lit(1.0), Binomial(link="probit")
    return sums(spark, lineitem(spark, sf_dir), [f.inv_link(eta(), Columns), f.loss(y, eta(), one, Columns), f.gradient(y, eta(), one, Columns), f.hessian(y, eta(), one, Columns)])


CNT_SQL = "floor(q / 10e0)"


@query(listing([f"avg({CNT_SQL} - exp({ETA_SQL}))", f"avg(exp({ETA_SQL}))", f"avg(exp({ETA_SQL}) - {CNT_SQL} * {ETA_SQL})", f"avg({CNT_SQL} - CASE WHEN {CNT_SQL} > 0 THEN {CNT_SQL} * ln({CNT_SQL}) ELSE 0e0 END)"], "lin"))
def poisson_family(spark, sf_dir):
    y, one, f = F.floor(F.col("q") / 10.0).cast("double"), F.lit(1.0), Poisson()
    return sums(spark, lineitem(spark, sf_dir), [f.gradient(y, eta(), one, Columns), f.hessian(y, eta(), one, Columns), f.loss(y, eta(), one, Columns), f.loss_full(y, one, Columns)])


@query(listing(["avg((y - x0) / 2e0)", "avg((x3 - x1) / 2e0)", "avg((0.5e0 * x0 * x0 - y * x0 + 0.5e0 * x1 * x1 - x3 * x1) / 2e0)"], "lin"))
def multigaussian_family(spark, sf_dir):
    ys, es, one, f = [F.col("y"), F.col("x3")], [F.col("x0"), F.col("x1")], F.lit(1.0), MultiGaussian()
    return sums(spark, lineitem(spark, sf_dir), [*f.gradient(ys, es, one, Columns), f.loss(ys, es, one, Columns)])


DEN = "(exp(x0) + exp(x1) + exp(0.5e0))"


@query(listing([*(f"avg((CASE WHEN rf = '{v}' THEN 1e0 ELSE 0e0 END - exp({e}) / {DEN}) / 3e0)" for v, e in zip("ANR", ("x0", "x1", "0.5e0"), strict=True)), f"avg((ln({DEN}) - CASE rf WHEN 'A' THEN x0 WHEN 'N' THEN x1 ELSE 0.5e0 END) / 3e0)", f"avg(2e0 * exp(x0) / {DEN} * (1e0 - exp(x0) / {DEN}) / 3e0)"], "lin"))
def multinomial_family(spark, sf_dir):
    ys, es, one, f = [F.when(F.col("rf") == v, 1.0).otherwise(0.0) for v in "ANR"], [F.col("x0"), F.col("x1"), F.lit(0.5)], F.lit(1.0), Multinomial()
    return sums(spark, lineitem(spark, sf_dir), [*f.gradient(ys, es, one, Columns), f.loss(ys, es, one, Columns), f.hessian(ys, es, one, Columns)[0]])


# --- cox ----------------------------------------------------------------------------------------------------
COX_SQL = """surv AS (SELECT (l_orderkey % 30)::DOUBLE AS begin, date_diff('day', o_orderdate, l_shipdate)::DOUBLE AS stop, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS status,
 o_orderpriority AS strata, 1e0 / 1000 AS w, 0.2e0 * l_quantity / 50e0 - 1e0 * l_discount AS eta FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 WHERE date_diff('day', o_orderdate, l_shipdate) > l_orderkey % 30),
rk AS (SELECT strata, stop AS tm, 1 AS ev, w * exp(eta) AS v, 0e0 AS s FROM surv UNION ALL SELECT strata, begin, 0, 0e0, w * exp(eta) FROM surv),
rs AS (SELECT strata, tm, max(ev) AS ev, sum(v) AS v, sum(s) AS s FROM rk GROUP BY ALL),
risk AS (SELECT strata, tm, ev, sum(v) OVER b - sum(s) OVER b AS risk FROM rs WINDOW b AS (PARTITION BY strata ORDER BY tm RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
tie AS (SELECT strata, stop AS tm, count(*) AS n, avg(w) AS mean, sum(w) AS weight, sum(w * exp(eta)) AS tied FROM surv WHERE status = 1 GROUP BY ALL),
haz AS (SELECT t.*, r.risk, k.k FROM tie t JOIN risk r USING (strata, tm), LATERAL (SELECT unnest(range(t.n)) AS k) k)"""


def survival(spark, sf_dir) -> DataFrame:
    li, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    days = F.datediff("l_shipdate", "o_orderdate")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(days > F.col("l_orderkey") % 30)
    return joined.select(
        (F.col("l_orderkey") % 30).cast("double").alias("start"), days.cast("double").alias("stop"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("status"), F.col("o_orderpriority").alias("strata"),
        F.lit(1e-3).alias("w"), (0.2 * F.col("l_quantity") / 50.0 - F.col("l_discount")).alias("eta"), (F.col("l_quantity") / 50.0).alias("x0"), (F.col("l_discount") * 10.0).alias("x1"), (F.col("l_tax") * 10.0).alias("x2"),
    )


@query(f"WITH {COX_SQL} SELECT strata, tm, round(risk, 8) AS risk FROM risk WHERE ev = 1")
def cox_risk_sum(spark, sf_dir):
    return cox.at_risk(survival(spark, sf_dir), F.col("w") * F.exp("eta")).select("strata", F.col("at").alias("tm"), r6(F.col("risk"), "risk"))


@query(f"WITH {COX_SQL} SELECT strata, tm, n, round(mean, 8) AS mean, round(tied, 8) AS tied FROM tie")
def cox_ties(spark, sf_dir):
    return cox.ties(survival(spark, sf_dir)).select("strata", F.col("at").alias("tm"), "n", r6(F.col("mean"), "mean"), r6(F.col("tied"), "tied"))


@query("WITH " + COX_SQL.split(",\nrk AS")[0] + ", b AS (SELECT strata, stop AS tm, sum(w) AS v FROM surv GROUP BY ALL) SELECT strata, tm, round(sum(v) OVER (PARTITION BY strata ORDER BY tm RANGE UNBOUNDED PRECEDING), 8) AS v FROM b")
def cox_partial_sum(spark, sf_dir):
    s = survival(spark, sf_dir).select("strata", F.col("stop").alias("at"), F.col("w").alias("v"))
    return cox.partial_sum(s, s.select("strata", "at").distinct()).select("strata", F.col("at").alias("tm"), r6(F.col("v"), "v"))


def _cox_loss_sql(share: str) -> str:
    return f"WITH {COX_SQL} SELECT round((SELECT sum(mean * ln(risk - ({share}) * tied)) FROM haz) - (SELECT sum(w * eta) FROM surv WHERE status = 1), 5) AS loss"


@query(_cox_loss_sql("0e0"))
def cox_loss_breslow(spark, sf_dir):
    return cox.loss(survival(spark, sf_dir), "breslow").select(r6(F.col("loss"), "loss", 5))


@query(_cox_loss_sql("k / n::DOUBLE"))
def cox_loss_efron(spark, sf_dir):
    return cox.loss(survival(spark, sf_dir), "efron").select(r6(F.col("loss"), "loss", 5))


@query(f"""WITH {COX_SQL}, h AS (SELECT strata, tm, sum(mean / (risk - k / n::DOUBLE * tied)) AS a1, sum(mean * (k / n::DOUBLE) / (risk - k / n::DOUBLE * tied)) AS t1 FROM haz GROUP BY ALL),
g AS (SELECT s.strata, s.status, s.w, s.eta, (SELECT coalesce(sum(a1), 0) FROM h WHERE h.strata = s.strata AND h.tm > s.begin AND h.tm <= s.stop) - CASE WHEN s.status = 1 THEN (SELECT t1 FROM h WHERE h.strata = s.strata AND h.tm = s.stop) ELSE 0 END AS c FROM surv s)
SELECT strata, round(sum(abs(CASE WHEN status = 1 THEN w ELSE 0 END - w * exp(eta) * c)), 5) AS grad_size FROM g GROUP BY strata""")
def cox_gradient(spark, sf_dir):
    return cox.gradient(survival(spark, sf_dir)).groupBy("strata").agg(r6(F.sum(F.abs("grad")), "grad_size", 5))


# --- paths and their blocks ---------------------------------------------------------------------------------
def measures(spark, sf_dir) -> tuple[X.FeatureFrame, Response]:
    return X.dense(lineitem(spark, sf_dir), ["x0", "x1", "x2"]), Response(Gaussian(), ("y",))


CENTRED = "WITH " + L_SQL + ", m AS (SELECT avg(x0) a0, avg(x1) a1, avg(x2) a2, avg(y) ay FROM lin), g AS (SELECT avg((x0 - a0) * (y - ay)) g0, avg((x1 - a1) * (y - ay)) g1, avg((x2 - a2) * (y - ay)) g2, avg((x0 - a0) * (x0 - a0)) v0 FROM lin, m)"


def null_gradient(spark, sf_dir) -> np.ndarray:
    frame, response = measures(spark, sf_dir)
    s = path.gaussian_statistics(frame, response)
    return s["cxy"][:, 0]


@query(CENTRED + " SELECT round(greatest(abs(g0), abs(g1), abs(g2)), 8) AS lmda_max FROM g")
def lambda_max(spark, sf_dir):
    g = null_gradient(spark, sf_dir)
    return spark.createDataFrame([(round(path.lambda_max(np.abs(g), np.ones(3), 1.0), 8),)], "lmda_max double")


@query(CENTRED + " SELECT i::INT AS j, round(greatest(abs(g0), abs(g1), abs(g2)) * exp(ln(0.01e0) * i / 9e0), 8) AS lmda FROM g, range(10) t(i)")
def lambda_path(spark, sf_dir):
    g = null_gradient(spark, sf_dir)
    return vector(spark, path.lambda_path(path.lambda_max(np.abs(g), np.ones(3), 1.0), 1e-2, 10), "lmda")


@query(CENTRED + ", n AS (SELECT 0 AS grp, sqrt(g0 * g0 + g1 * g1) AS norm, sqrt(2e0) AS w FROM g UNION ALL SELECT 1, abs(g2), 1e0 FROM g), x AS (SELECT max(norm / w) AS lm FROM n) SELECT grp::INT AS grp, round(norm, 8) AS norm, round(norm / w, 8) AS score, norm > (2 * 0.8e0 * lm - lm) * w AS strong, norm > 0.5e0 * lm * w AS violates FROM n, x")
def group_screening(spark, sf_dir):
    g = null_gradient(spark, sf_dir)
    norms, w = path.group_norms(g, [0, 2], [2, 1]), path.default_penalty([2, 1])
    top = path.lambda_max(norms, w, 1.0)
    strong = path.strong_rule(norms, w, 1.0, top, 0.8 * top)
    bad = set(path.kkt_violations(norms, w, 1.0, 0.5 * top, set()))
    return spark.createDataFrame([(i, round(float(n), 8), round(float(n / w[i]), 8), bool(strong[i]), i in bad) for i, n in enumerate(norms)], "grp int, norm double, score double, strong boolean, violates boolean")


@query(CENTRED + " SELECT i::INT AS j, round(sign(g0) * greatest(abs(g0) * (1 - exp(ln(0.01e0) * i / 9e0)), 0e0) / v0, 5) AS beta FROM g, range(10) t(i)")
def lasso_1d(spark, sf_dir):
    frame, response = measures(spark, sf_dir)
    fit = path.grpnet(frame[:, [0]], response, path.Options(lmda_path_size=10, early_exit=False))
    return vector(spark, fit.betas[:, 0] + 0.0, "beta", 5)


@query(CENTRED + " SELECT i::INT AS j, round(g0 / (v0 + (i + 1) * 0.1e0), 5) AS beta FROM g, range(5) t(i)")
def ridge_1d(spark, sf_dir):
    frame, response = measures(spark, sf_dir)
    fit = path.grpnet(frame[:, [0]], response, path.Options(alpha=0.0, lmda_path=[0.1 * (i + 1) for i in range(5)], early_exit=False))
    return vector(spark, fit.betas[::-1, 0], "beta", 5)


@query("WITH " + L_SQL + " SELECT round(greatest(-0.1e0, least(0.5e0, sum(x0 * y) / sum(x0 * x0))), 8) AS beta FROM lin")
def bvls_1d(spark, sf_dir):
    frame, _ = measures(spark, sf_dir)
    return spark.createDataFrame([(round(float(bounded.bvls(frame[:, [0]], "y", [-0.1], [0.5])[0]), 8),)], "beta double")


@query("WITH " + L_SQL + f", m AS (SELECT avg({BIN_SQL}) AS p, avg({CNT_SQL}) AS c FROM lin) SELECT round(ln(p / (1 - p)), 5) AS logit, round(ln(c), 5) AS poisson FROM m")
def null_models(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("b", F.when(F.col("rf") == "R", 1.0).otherwise(0.0)).withColumn("c", F.floor(F.col("q") / 10.0).cast("double"))
    out = []
    for name, y in (("binomial", "b"), ("poisson", "c")):
        fit = path.grpnet(X.dense(df, ["x1"]), Response(family(name), (y,)), path.Options(lmda_path=[1e3]))
        out.append(round(float(fit.intercepts[0, 0]), 5))
    return spark.createDataFrame([tuple(out)], "logit double, poisson double")


@query("SELECT fold::INT AS fold, count(*) AS n FROM (SELECT ntile(7) OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders) GROUP BY fold")
def cv_fold_sizes(spark, sf_dir):
    return assign_folds(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 7).groupBy("fold").agg(F.count("*").alias("n"))


CALLS = "(SELECT o_orderkey AS row_id, (k)::INT AS snp, CASE WHEN (o_orderkey * 7 + k * 13) % 11 = 0 THEN NULL ELSE ((o_orderkey * 5 + k * 3) % 7) % 3 END::INT AS call FROM orders, range(4) t(k))"


def calls(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("snp", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    call = F.when((F.col("o_orderkey") * 7 + F.col("snp") * 13) % 11 == 0, None).otherwise(((F.col("o_orderkey") * 5 + F.col("snp") * 3) % 7) % 3).cast("int")
    return o.select(F.col("o_orderkey").alias("row_id"), "snp", call.alias("call"))


@query(f"SELECT snp, count(call) AS nnm, count(*) FILTER (call IS NULL OR call <> 0) AS nnz, round(sum(coalesce(call, 0)) / count(call)::DOUBLE, 8) AS impute FROM {CALLS} c GROUP BY snp")
def snp_impute_stats(spark, sf_dir):
    return genotypes.column_stats(calls(spark, sf_dir)).select("snp", "nnm", "nnz", r6(F.col("impute"), "impute"))


@query(f"WITH c AS (SELECT * FROM {CALLS} x), s AS (SELECT snp, sum(coalesce(call, 0)) / count(call)::DOUBLE AS impute FROM c GROUP BY snp) SELECT row_id, c.snp, round(coalesce(call, impute), 8) AS value FROM c JOIN s USING (snp)")
def snp_imputed(spark, sf_dir):
    return genotypes.unphased_long(calls(spark, sf_dir)).select("row_id", "snp", r6(F.col("value"), "value"))


HAPS = "(SELECT o_orderkey AS row_id, (k // 2)::INT AS snp, (k % 2)::INT AS hap, ((o_orderkey * 3 + k) % 5 % 2)::INT AS call, ((o_orderkey + k) % 3)::INT AS ancestry FROM orders, range(6) t(k))"


@query(f"SELECT row_id, (snp * 3 + ancestry)::INT AS col_id, sum(call)::DOUBLE AS value FROM {HAPS} h WHERE call <> 0 GROUP BY ALL")
def phased_ancestry(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(6)))))
    haps = o.select(F.col("o_orderkey").alias("row_id"), F.floor(F.col("k") / 2).cast("int").alias("snp"), (F.col("k") % 2).alias("hap"), ((F.col("o_orderkey") * 3 + F.col("k")) % 5 % 2).cast("int").alias("call"), ((F.col("o_orderkey") + F.col("k")) % 3).cast("int").alias("ancestry"))
    return genotypes.phased_ancestry(haps, 3)
