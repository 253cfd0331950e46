"""Cox sub-operators as running sums over pre-aggregated event times.

Rows are first summed by (strata, time): the running sums then see one row per distinct time of a stratum, never
one row per subject, and are joined back by equality. A stratum's times are dealt out in parts of the time axis,
whose totals are summed first, so that no task holds a whole stratum; the steps of a tie are summed in closed form, so a
tie of any number of events costs the same."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.sources.storage import Stored

#: Parts that the time axis is cut into.
PARTS = 256
#: Last steps of a tie that are added one by one, the part of the risk mass up to which a power series is used, its terms.
FEW, LITTLE, TERMS = 16, 0.01, 9
#: Coefficients (1 - 2^(1-2i)) B_2i / 2i of the midpoint rule for 1/x, and B_2i / (2i)! of power sums (B: Bernoulli numbers).
MIDPOINT = (1 / 24, -7 / 960, 31 / 8064, -127 / 30720, 511 / 67584)
CLOSED = (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600)


def edges_of(df: DataFrame, at: str = "at") -> DataFrame:
    """One row: times that cut the rows into about equal parts. Any cut gives the same sums; equal ones spread them."""
    return df.agg(F.percentile_approx(at, [k / PARTS for k in range(1, PARTS)], 10 * PARTS).alias("edges"))


def running(df: DataFrame, names: Sequence[str], back: bool = False, keys: Sequence[str] = ("strata",)) -> DataFrame:
    """``df``, which has one row for each (keys, at), with ``run_<name>``: sums over the rows of its keys at times up to
    its own, or with ``back`` from its own on."""
    cuts = edges_of(df).scalar()
    parted = df.withColumn("__cuts", cuts).withColumn("__part", F.coalesce(F.size(F.filter("__cuts", lambda e: e < F.col("at"))), F.lit(0))).drop("__cuts")
    turn = (lambda c: F.col(c).desc()) if back else (lambda c: F.col(c).asc())
    totals = parted.groupBy(*keys, "__part").agg(*(F.sum(c).alias(f"t_{c}") for c in names))
    earlier = Window.partitionBy(*keys).orderBy(turn("__part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0.0)).alias(f"b_{c}") for c in names))
    own = Window.partitionBy(*keys, "__part").orderBy(turn("at")).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    summed = parted.select("*", *(F.sum(c).over(own).alias(f"o_{c}") for c in names)).join(totals, same)
    return summed.select(*df.columns, *((F.col(f"o_{c}") + F.col(f"b_{c}")).alias(f"run_{c}") for c in names))


def partial_sum(values: DataFrame, times: DataFrame, forward: bool = True, keys: tuple[str, ...] = ("strata",)) -> DataFrame:
    """For each distinct (keys, at) of ``times``: the sum of ``v`` over rows of ``values(keys, at, v)`` with a time of
    at most (forward) or at least (backward) ``at``. Times without values give 0; both tables may be empty."""
    marks = times.select(*keys, "at", F.lit(0.0).alias("v"), F.lit(1).alias("asked"))
    events = values.select(*keys, "at", F.col("v").cast("double"), F.lit(0).alias("asked")).union(marks)
    summed = events.groupBy(*keys, "at").agg(F.sum("v").alias("v"), F.max("asked").alias("asked"))
    return running(summed, ["v"], not forward, keys).where("asked = 1").select(*keys, "at", F.col("run_v").alias("v"))


def at_risk(df: DataFrame, value: Column, start: str = "start", stop: str = "stop", strata: str = "strata") -> DataFrame:
    """(strata, at, risk): for each distinct stop time, the sum of ``value`` over rows with start < at <= stop."""
    plus = df.select(F.col(strata).alias("strata"), F.col(stop).alias("at"), value.alias("v"), F.lit(0.0).alias("s"), F.lit(1).alias("asked"))
    minus = df.select(F.col(strata).alias("strata"), F.col(start).alias("at"), F.lit(0.0).alias("v"), value.alias("s"), F.lit(0).alias("asked"))
    summed = plus.union(minus).groupBy("strata", "at").agg(F.sum("v").alias("v"), F.sum("s").alias("s"), F.max("asked").alias("asked"))
    # start >= at is outside (start, at]; stop >= at is inside
    return running(summed, ["v", "s"], back=True).where("asked = 1").select("strata", "at", (F.col("run_v") - F.col("run_s")).alias("risk"))


class Ties:
    """Sums over the n steps of a tie as SQL text over columns: step k has share s = k / n and ``left`` = risk - s * tied;
    Breslow takes s = 0 n times. ``inverse``, ``share``, ``inverse2``, ``share2``, ``squares2`` and ``log`` are the sums of
    1 / left, s / left, 1 / left^2, s / left^2, s^2 / left^2 and log(left).

    A tie of any size costs the same. The ``FEW`` last steps, where ``left`` is small, are added one by one; the
    others by the midpoint rule with its correction terms, in units of tied / n. Where the tie holds little of the risk
    mass, a power series of that part takes over, whose power sums of k / n have closed forms: no large terms cancel."""

    def __init__(self, n: str, tie: str, risk: str, tied: str):
        self.n, self.efron, self.risk, self.tied = f"CAST({n} AS DOUBLE)", tie == "efron", risk, tied

    def power_sum(self, m: int) -> str:
        """Sum of (k / n)^m."""
        terms = [f"{self.n} / {m + 1}", "0D" if m == 0 else "-0.5D"]
        for i, c in enumerate(CLOSED):
            falling = math.prod(range(m, m - 2 * i - 1, -1))
            if m > 2 * i + 1:
                terms.append(f"({c * falling!r}D) / power({self.n}, {2 * i + 1})")
        return "(" + " + ".join(terms) + ")"

    def _sum(self, step: str, series: list[str], smooth: str, breslow: str) -> str:
        if not self.efron:
            return f"({breslow})"
        last = f"aggregate(sequence(CAST(greatest({self.n} - {FEW}, 0) AS BIGINT), CAST({self.n} - 1 AS BIGINT)), 0D, (a, k) -> a + {step})"
        return f"CASE WHEN {self.n} > {FEW} AND {self.tied} <= {LITTLE}D * {self.risk} THEN {' + '.join(series)} WHEN {self.n} > {FEW} THEN {last} + {smooth} ELSE {last} END"

    @property
    def _ends(self) -> tuple[str, str, str]:
        """Number of steps before the last ``FEW``, and the lower and upper end of their range in units of tied / n."""
        z = f"({self.n} * {self.risk} / {self.tied})"
        return f"({self.n} - {FEW})", f"({z} - {self.n} + {FEW + 0.5}D)", f"({z} + 0.5D)"

    @property
    def _left(self) -> str:
        return f"({self.risk} - k / {self.n} * {self.tied})"

    def _series(self, power: int, first: int) -> list[str]:
        """Terms of sum s^first / left^power."""
        q = f"({self.tied} / {self.risk})"
        return [f"{j + 1 if power == 2 else 1} * power({q}, {j}) * {self.power_sum(j + first)} / power({self.risk}, {power})" for j in range(TERMS)]

    def _inverse(self) -> str:
        m, lo, hi = self._ends
        return f"{self.n} / {self.tied} * (log1p({m} / {lo}) + " + " + ".join(f"({c!r}D) * (power({hi}, {-2 * i}) - power({lo}, {-2 * i}))" for i, c in enumerate(MIDPOINT, 1)) + ")"

    def _inverse2(self) -> str:
        m, lo, hi = self._ends
        return f"power({self.n} / {self.tied}, 2) * ({m} / ({lo} * {hi}) + " + " + ".join(f"({2 * i * c!r}D) * (power({hi}, {-2 * i - 1}) - power({lo}, {-2 * i - 1}))" for i, c in enumerate(MIDPOINT, 1)) + ")"

    def inverse(self) -> str:
        return self._sum(f"1 / {self._left}", self._series(1, 0), self._inverse(), f"{self.n} / {self.risk}")

    def share(self) -> str:
        smooth = f"({self.risk} * {self._inverse()} - {self._ends[0]}) / {self.tied}"
        return self._sum(f"k / {self.n} / {self._left}", self._series(1, 1), smooth, "0D")

    def inverse2(self) -> str:
        return self._sum(f"1 / ({self._left} * {self._left})", self._series(2, 0), self._inverse2(), f"{self.n} / ({self.risk} * {self.risk})")

    def share2(self) -> str:
        smooth = f"({self.risk} * {self._inverse2()} - {self._inverse()}) / {self.tied}"
        return self._sum(f"k / {self.n} / ({self._left} * {self._left})", self._series(2, 1), smooth, "0D")

    def squares2(self) -> str:
        smooth = f"({self.risk} * {self.risk} * {self._inverse2()} - 2 * {self.risk} * {self._inverse()} + {self._ends[0]}) / ({self.tied} * {self.tied})"
        return self._sum(f"k / {self.n} * k / {self.n} / ({self._left} * {self._left})", self._series(2, 2), smooth, "0D")

    def log(self) -> str:
        m, lo, hi = self._ends
        smooth = f"({m} * ln({self.tied} / {self.n}) + {lo} * log1p({m} / {lo}) + {m} * ln({hi}) - {m} + " + " + ".join(f"({c / (1 - 2 * i)!r}D) * (power({hi}, {1 - 2 * i}) - power({lo}, {1 - 2 * i}))" for i, c in enumerate(MIDPOINT, 1)) + ")"
        q = f"({self.tied} / {self.risk})"
        series = [f"{self.n} * ln({self.risk})", *(f"(-power({q}, {j}) * {self.power_sum(j)} / {j})" for j in range(1, TERMS))]
        return self._sum(f"ln({self._left})", series, smooth, f"{self.n} * ln({self.risk})")


def ties(df: DataFrame, stop: str = "stop", status: str = "status", strata: str = "strata", weight: str = "w", eta: str = "eta") -> DataFrame:
    """(strata, at, n, weight, mean, risk): weighted events of each event time, their number, total and mean weight
    and the risk mass exp(eta) * w that they hold themselves."""
    events = df.where((F.col(status) == 1) & (F.col(weight) > 0))
    return events.groupBy(F.col(strata).alias("strata"), F.col(stop).alias("at")).agg(
        F.count("*").alias("n"), F.sum(weight).alias("weight"), F.avg(weight).alias("mean"), F.sum(F.col(weight) * F.exp(eta)).alias("tied")
    )


def hazards(df: DataFrame, tie: str = "efron", **columns: str) -> DataFrame:
    """Per event time: n, mean, tied, risk and the sums over the tie's steps k = 0 ... n-1 with share s = k / n
    (Breslow: s = 0): a1 = sum mean / (risk - s tied), a2 = sum mean / (..)^2, and the same times s and s (2 - s)."""
    names = {"start": "start", "stop": "stop", "status": "status", "strata": "strata", "weight": "w", "eta": "eta"} | columns
    table = ties(df, names["stop"], names["status"], names["strata"], names["weight"], names["eta"])
    risk = at_risk(df, F.col(names["weight"]) * F.exp(names["eta"]), names["start"], names["stop"], names["strata"])
    return _steps(table.join(risk, ["strata", "at"]), tie)


def _steps(table: DataFrame, tie: str) -> DataFrame:
    """``table``, event times with n, mean, tied and risk, with the sums of ``hazards``."""
    sums, add = Ties("n", tie, "risk", "tied"), lambda x: F.expr(f"mean * ({x})")
    return table.select(
        "*",
        add(sums.inverse()).alias("a1"),
        add(sums.inverse2()).alias("a2"),
        add(sums.share()).alias("t1"),
        add(f"2 * ({sums.share2()}) - ({sums.squares2()})").alias("t2"),
        add(sums.log()).alias("loglik"),
    )


def _times(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """(strata, at, mass, gone, n, mean, tied), a row for each stop or start time: the risk mass of rows that stop and that
    start there, the number of weighted events, their mean weight and own mass. One pass, summed before the shuffle."""
    w = F.col(names["weight"]).cast("double")
    event, mass, zero = (F.col(names["status"]) == 1) & (F.col(names["weight"]) > 0), w * F.exp(names["eta"]), F.lit(0.0)
    entry = lambda at, *v: F.struct(F.col(at).cast("double").alias("at"), *(x.alias(k) for k, x in zip(("mass", "gone", "n", "ew", "tied"), v, strict=True)))
    own = [F.when(event, x).otherwise(0) for x in (F.lit(1).cast("long"), w, mass)]
    cells = F.array(entry(names["stop"], mass, zero, *own), entry(names["start"], zero, mass, F.lit(0).cast("long"), zero, zero))
    summed = df.select(F.col(names["strata"]).alias("strata"), F.inline(cells)).groupBy("strata", "at").agg(*(F.sum(c).alias(c) for c in ("mass", "gone", "n", "ew", "tied")))
    return summed.select("strata", "at", "mass", "gone", "n", F.when(F.col("n") > 0, F.col("ew") / F.col("n")).alias("mean"), "tied")


def losses(df: DataFrame, tie: str, *groups: Column, **columns: str) -> DataFrame:
    """(k0, k1, ..., loss): ``loss`` by ``groups``, expressions over ``strata`` alone."""
    names = {"status": "status", "weight": "w", "eta": "eta", "strata": "strata"} | columns
    by = [g.alias(f"k{i}") for i, g in enumerate(groups)]
    own = df.withColumn("strata", F.col(names["strata"])).select(*by, F.when(F.col(names["status"]) == 1, -F.col(names["weight"]) * F.col(names["eta"])).otherwise(0.0).alias("v"))
    return own.union(hazards(df, tie, **columns).select(*by, "loglik")).groupBy(*(f"k{i}" for i in range(len(by)))).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("loss"))


def loss(df: DataFrame, tie: str = "efron", **columns: str) -> DataFrame:
    """One row ``loss``: minus the weighted partial log-likelihood, ties by ``tie``."""
    return losses(df, tie, **columns)


def loss_full(df: DataFrame, tie: str = "efron", stop: str = "stop", status: str = "status", strata: str = "strata", weight: str = "w") -> DataFrame:
    """One row ``loss_full``: the limit in which each event's risk set is its tie alone, equal in risk."""
    table = ties(df.withColumn("__eta", F.lit(0.0)), stop, status, strata, weight, "__eta")
    return table.agg(F.expr(f"coalesce(sum(mean * ({Ties('n', tie, 'weight', 'weight').log()})), 0D)").alias("loss_full"))


def gradient(df: DataFrame, tie: str = "efron", **columns: str) -> DataFrame:
    """``df`` with ``grad`` (negative gradient) and ``hess`` (diagonal) per row, by running sums over event times."""
    names = {"start": "start", "stop": "stop", "status": "status", "strata": "strata", "weight": "w", "eta": "eta"} | columns
    # one pass sums the rows by time; what follows reads these sums, until the rows are read again for their own results
    times = Stored(df.sparkSession, "times").put(_times(df, names))[0]
    risk = running(times, ["mass", "gone"], back=True)
    sums = _steps(risk.where("n > 0").withColumn("risk", F.col("run_mass") - F.col("run_gone")), tie)
    both = sums.select("strata", "at", "a1", "a2", "t1", "t2").union(times.where("n = 0").select("strata", "at", *(F.lit(0.0) for _ in range(4))))
    table = Stored(df.sparkSession, "times").put(running(both, ["a1", "a2"]).select("strata", "at", "t1", "t2", F.col("run_a1").alias("c1"), F.col("run_a2").alias("c2")))[0]
    stops = table.select(F.col("strata").alias("__ks"), F.col("at").alias("__ts"), F.col("c1").alias("__s1"), F.col("c2").alias("__s2"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    starts = table.select(F.col("strata").alias("__kb"), F.col("at").alias("__tb"), F.col("c1").alias("__b1"), F.col("c2").alias("__b2"))
    joined = df.join(stops, (F.col(names["strata"]) == F.col("__ks")) & (F.col(names["stop"]) == F.col("__ts"))).join(starts, (F.col(names["strata"]) == F.col("__kb")) & (F.col(names["start"]) == F.col("__tb")))
    w, event = F.col(names["weight"]), (F.col(names["status"]) == 1) & (F.col(names["weight"]) > 0)
    mass = w * F.exp(names["eta"])
    first = F.col("__s1") - F.col("__b1") - F.when(event, F.col("__t1")).otherwise(0.0)
    second = F.col("__s2") - F.col("__b2") - F.when(event, F.col("__t2")).otherwise(0.0)
    grad = F.when(event, w).otherwise(0.0) - mass * first
    hess = mass * first - mass * mass * second
    return joined.select(*(df[c] for c in df.columns), grad.alias("grad"), hess.alias("hess"))
