"""Derivatives of Cox fits at many coefficients, from rows that are laid out by time once a fit.

A row adds its risk mass at its stop time and takes it away at its start time. These entries are summed where time and
columns are equal, sorted by stratum and falling time, and dealt out by ranges, so that a tie or a stratum of any size is
spread over tasks. A step reads them twice and shuffles nothing: the first pass finds what each task's last stratum holds
and its outer ties, which give the others' starting sums; the second adds running sums up into derivatives. Ties that
lie in several tasks are a few numbers each, which the driver completes. Coefficients travel with the tasks, not in the plan."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, StringType

from ridgeline.functions.cox import CLOSED, FEW, LITTLE, MIDPOINT, TERMS

#: Entries that a task holds at least, where there are enough of them, and about at most; tasks at most.
LEAST_ROWS, MOST_ROWS, MOST_TASKS = 1 << 13, 1 << 20, 4096
#: Numbers that the tasks of a pass hand to the driver at most (128 MB); more questions take more passes.
DRIVER_NUMBERS = 1 << 24
#: Numbers that a task works on at once.
CELLS = 1 << 21


def sums_of(p: int, curved: int) -> int:
    """Number of running sums: the mass, the columns and the products of the curved ones."""
    return 1 + p + curved * (curved + 1) // 2


def step_sums(n: np.ndarray, risk: np.ndarray, tied: np.ndarray, tie: str) -> np.ndarray:
    """The six sums of ``cox.Ties`` over the steps of each tie, by the same rules: inverse, share, inverse2, share2,
    squares2 and log as rows."""
    if tie != "efron":
        zero = np.zeros(len(n))
        return np.array([n / risk, zero, n / risk**2, zero, zero, n * np.log(risk)])
    out, many = np.zeros((6, len(n))), n > FEW
    little = many & (tied <= LITTLE * risk)
    for k in range(FEW):
        at = np.flatnonzero(~little & (n > k))
        s = (n[at] - 1 - k) / n[at]
        left = risk[at] - s * tied[at]
        out[:, at] += [1 / left, s / left, 1 / left**2, s / left**2, (s / left) ** 2, np.log(left)]
    at = np.flatnonzero(many & ~little)
    if len(at):
        unit, r, t = tied[at] / n[at], risk[at], tied[at]
        lo, hi, m = n[at] * r / t - n[at] + FEW + 0.5, n[at] * r / t + 0.5, n[at] - FEW
        rule = lambda f: sum(f(i, c) for i, c in enumerate(MIDPOINT, 1))
        log = np.log1p(m / lo)
        one = (log + rule(lambda i, c: c * (hi ** (-2 * i) - lo ** (-2 * i)))) / unit
        two = (m / (lo * hi) + rule(lambda i, c: 2 * i * c * (hi ** (-2 * i - 1) - lo ** (-2 * i - 1)))) / unit**2
        logs = m * np.log(unit) + lo * log + m * np.log(hi) - m + rule(lambda i, c: c / (1 - 2 * i) * (hi ** (1 - 2 * i) - lo ** (1 - 2 * i)))
        out[:, at] += [one, (r * one - m) / t, two, (r * two - one) / t, (r * r * two - 2 * r * one + m) / t**2, logs]
    at = np.flatnonzero(little)
    if len(at):
        n0, r, q = n[at], risk[at], tied[at] / risk[at]

        def power(m: int) -> np.ndarray:
            """Sum of (k / n)^m over the steps."""
            own = n0 / (m + 1) - (0.5 if m else 0.0)
            return own + sum(c * math.prod(range(m, m - 2 * i - 1, -1)) / n0 ** (2 * i + 1) for i, c in enumerate(CLOSED) if m > 2 * i + 1)

        series = lambda first, factor: sum(factor(j) * q**j * power(j + first) for j in range(TERMS))
        once, more = (lambda j: 1), (lambda j: j + 1)
        logs = n0 * np.log(r) - sum(q**j * power(j) / j for j in range(1, TERMS))
        out[:, at] = [series(0, once) / r, series(1, once) / r, series(0, more) / r**2, series(1, more) / r**2, series(2, more) / r**2, logs]
    return out


class Step:
    """One question's arithmetic: rows to vectors, which add up, and vectors of event times to derivatives.

    A vector holds the risk sums r (1, columns, products of curved columns), the same of the events' own mass t, the
    events' weighted columns e, and their number, weight and weighted predictor."""

    def __init__(self, ask, place: dict[int, int], tie: str):
        self.at = np.array([place[j] for j in ask.columns], int)
        self.curved = np.array([list(ask.columns).index(j) for j in ask.curved], int)
        self.left, self.right = np.triu_indices(len(self.curved))  # pairs of curved columns
        self.beta = np.asarray(ask.beta, float).ravel()[list(ask.columns)]
        self.fold, self.scale, self.tie = ask.fold, ask.scale, tie
        self.slopes = getattr(ask, "slopes", True)  # without them, the loss alone
        self.p = len(self.at) if self.slopes else 0
        self.m = sums_of(self.p, len(self.curved)) if self.slopes else 1
        self.size = 2 * self.m + self.p + 3
        self.found = self.p + len(self.curved) ** 2 + 2

    def vectors(self, x: np.ndarray, rest: dict[str, np.ndarray]) -> np.ndarray:
        sw, ew, n = rest["sw"] * self.scale, rest["ew"] * self.scale, rest["n"]
        if self.fold is not None:
            keep = rest["fold"] != self.fold
            sw, ew, n = sw * keep, ew * keep, n * keep
        own = x[:, self.at]
        eta = own @ self.beta + rest["o"]
        mass = np.exp(eta)
        one = np.ones((len(x), 1))
        if self.slopes:
            c = own[:, self.curved]
            one = np.concatenate([one, own, c[:, self.left] * c[:, self.right]], axis=1)
        said = np.column_stack([n, ew, ew * eta])
        return np.concatenate([one * (sw * mass)[:, None], one * (ew * mass)[:, None], own[:, : self.p] * ew[:, None], said], axis=1)

    def derivatives(self, vectors: np.ndarray, risk: np.ndarray) -> np.ndarray:
        """Gradient, curvature, loss and the loss of a full model, added up over event times with running sums ``risk``."""
        m, p = self.m, self.p
        at = vectors[:, 2 * m + p] > 0
        v, r = vectors[at], risk[at]
        t, e, (n, weight, said) = v[:, m : 2 * m], v[:, 2 * m : 2 * m + p], v[:, 2 * m + p :].T
        with np.errstate(all="ignore"):
            a, b, c, d, f, log = step_sums(n, r[:, 0], t[:, 0], self.tie) * (weight / n)
            full = step_sums(n, weight, weight, self.tie)[5] * (weight / n)
            k = 1 + self.curved
            rc, tc = r[:, k] if p else r[:, :0], t[:, k] if p else t[:, :0]
            both = (rc * d[:, None]).T @ tc
            H = -(rc.T @ (rc * c[:, None])) + both + both.T - tc.T @ (tc * f[:, None])
            if p:
                pairs = a @ r[:, 1 + p :] - b @ t[:, 1 + p :]
                H[self.left, self.right] += pairs
                H[self.right, self.left] = H[self.left, self.right]
            g = e.sum(axis=0) - a @ r[:, 1 : 1 + p] + b @ t[:, 1 : 1 + p]
        return np.concatenate([g, H.ravel(), [log.sum() - said.sum(), full.sum()]])


@dataclass
class RiskSets:
    """Entries of a fit, sorted and dealt out by ``of``; ``columns`` are their numbered x columns."""

    table: DataFrame
    tasks: int
    tie: str

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str], tie: str, offset: str | None = None, fold: str | None = None) -> RiskSets:
        """``df`` holds strata, start, stop, status, w and the columns, which become x0, x1, ... in their order. Rows of
        weight 0 have no part. Null is a stratum. Kept in memory and on disk until ``release``."""
        rows_in = df.count()
        return cls.dealt(cls.entries(df, columns, offset, fold), len(columns), tie, rows_in)

    @staticmethod
    def entries(df: DataFrame, columns: Sequence[str], offset: str | None = None, fold: str | None = None) -> DataFrame:
        """Entries of ``df`` as ``of`` takes it, summed where stratum, time, columns, offset and fold are equal: one pass over
        its rows. ``rw`` is the weight of the rows that stop there, ``bad`` the number of those that a column ``bad`` marks."""
        kind = df.schema["strata"].dataType
        strata = F.when(F.col("strata") == 0, 0.0).otherwise(F.col("strata")) if isinstance(kind, FractionalType) else F.col("strata")
        strata = strata if isinstance(kind, StringType) else F.to_json(F.struct(strata.alias("s")))
        event = (F.col("status") == 1) & (F.col("w") > 0)
        own = [*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("o"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold")]
        bad = F.col("bad") if "bad" in df.columns else F.lit(0)
        w, zero = F.col("w").cast("double"), F.lit(0.0)
        names = ("at", "sw", "ew", "n", "rw", "bad")
        entry = lambda *v: F.struct(*(x.cast("double").alias(k) for k, x in zip(names, v, strict=True)))
        stop = entry(F.col("stop"), w, F.when(event, w).otherwise(0.0), F.when(event, 1.0).otherwise(0.0), w, bad)
        start = entry(F.col("start"), -w, zero, zero, zero, zero)
        cells = F.when(F.col("start") > float("-inf"), F.array(stop, start)).otherwise(F.array(stop))
        same = ["strata", "at", *(f"x{k}" for k in range(len(columns))), "o", "fold"]
        return df.where((F.col("w") > 0) | (bad > 0)).select(strata.alias("strata"), *own, F.inline(cells)).groupBy(*same).agg(*(F.sum(c).alias(c) for c in names[1:]))

    @classmethod
    def dealt(cls, entries: DataFrame, p: int, tie: str, rows_in: int) -> RiskSets:
        """Entries of p columns dealt out to tasks by what number of rows or entries is given."""
        same = ["strata", "at", *(f"x{k}" for k in range(p)), "o", "fold"]
        cores = entries.sparkSession.sparkContext.defaultParallelism
        tasks = int(min(max(min(rows_in // LEAST_ROWS, cores), rows_in // MOST_ROWS, 1), MOST_TASKS))
        # entries of a tie differ in a column, the offset or the fold, so hashes of these part it
        dealt = entries.withColumn("salt", F.xxhash64(*same[2:])).repartitionByRange(tasks, "strata", F.desc("at"), "salt").sortWithinPartitions("strata", F.desc("at"))
        return cls(dealt.drop("salt").withColumn("part", F.spark_partition_id()).persist(), tasks, tie)

    def release(self) -> None:
        self.table.unpersist()

    def answer(self, asks: Sequence) -> list[dict]:
        """Per ask: ``g`` for its columns (x 1), ``H`` over (1, curved) each way, ``loss`` and ``full``. Two jobs for as many
        asks as the driver may hold numbers for; an empty table gives zeros."""
        found, own, numbers = [], [], 0
        for a in asks:
            more = self.tasks * Step(a, {j: k for k, j in enumerate(a.columns)}, self.tie).size * 3
            if own and numbers + more > DRIVER_NUMBERS:
                found += self._answer(own)
                own, numbers = [], 0
            own, numbers = [*own, a], numbers + more
        return found + (self._answer(own) if own else [])

    def _answer(self, asks: Sequence) -> list[dict]:
        read = sorted({j for a in asks for j in a.columns})
        place = {j: k for k, j in enumerate(read)}
        steps = [Step(a, place, self.tie) for a in asks]
        table = self.table.select("strata", "at", *(f"x{j}" for j in read), "o", "fold", "sw", "ew", "n", "part")
        most = max(CELLS // max(s.size for s in steps), 64)
        begins = np.cumsum([0, *(s.size for s in steps)])
        r_at = np.concatenate([np.arange(b, b + s.m) for b, s in zip(begins, steps, strict=False)])  # places of the risk sums
        r_ends = np.cumsum([0, *(s.m for s in steps)])

        def blocks(batches: Iterator[pa.RecordBatch]):
            """(part, strata, times, begin of each time's rows, their vectors added up) of bounded slices."""
            for batch in batches:
                for low in range(0, batch.num_rows, most):
                    b = batch.slice(low, most)
                    if not b.num_rows:
                        continue
                    get = lambda c, b=b: b.column(c).to_numpy(zero_copy_only=False)
                    s, t = np.array(b.column("strata").to_pylist(), object), get("at")
                    x = np.column_stack([*(get(f"x{j}") for j in read), np.zeros(len(t))])[:, : len(read)]
                    rest = {c: get(c) for c in ("o", "fold", "sw", "ew", "n")}
                    cut = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])]))
                    yield int(b.column("part")[0].as_py()), s[cut], t[cut], np.concatenate([np.add.reduceat(step.vectors(x, rest), cut, axis=0) for step in steps], axis=1)

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The task's first and last time with their vectors, and what its last stratum holds in it."""
            first = last = None
            head = tail = mass = 0.0
            for part, s, t, v in blocks(batches):
                if first is None:
                    first = (s[0], t[0])
                if (s[0], t[0]) == first:
                    head = head + v[0]
                tail = v[-1] + (tail if (s[-1], t[-1]) == last else 0.0)
                before = mass if last is not None and s[0] == s[-1] == last[0] else 0.0
                mass, last = v[s == s[-1]][:, r_at].sum(axis=0) + before, (s[-1], t[-1])
            if first is not None:
                cells = [[part], [first[0]], [first[1]], [last[0]], [last[1]], [np.concatenate([head, tail, mass]).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, OUTER, strict=True)], NAMES)

        known, totals = {}, [np.zeros(s.found) for s in steps]
        tasks = sorted(table.mapInArrow(outer, "part int, s1 string, t1 double, s2 string, t2 double, v binary").collect(), key=lambda r: r["part"])
        total = int(begins[-1])
        through = tie = None
        for k, row in enumerate(tasks):
            head, tail, mass = np.split(np.frombuffer(row["v"]), [total, 2 * total])
            first, last = (row["s1"], row["t1"]), (row["s2"], row["t2"])
            before = tasks[k - 1] if k else None
            after = tasks[k + 1] if k + 1 < len(tasks) else None
            carry = through if before and before["s2"] == row["s1"] else np.zeros(len(r_at))
            joins, goes = bool(before and (before["s2"], before["t2"]) == first), bool(after and (after["s1"], after["t1"]) == last)
            known[row["part"]] = (carry, joins, goes)
            if joins:
                tie = tie + head
                if not (goes and first == last):
                    _add(totals, steps, begins, r_ends, tie[None], (carry + head[r_at])[None])
            if goes and not (joins and first == last):
                tie = tail
            through = mass + (carry if row["s1"] == row["s2"] else 0.0)

        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Derivatives of the times that lie in this task alone."""
            found, held = [np.zeros(s.found) for s in steps], None
            carry = stratum = goes = None
            skip = False

            def work(s: np.ndarray, v: np.ndarray, count: np.ndarray) -> None:
                nonlocal carry, stratum
                turn = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
                risk = v[:, r_at]
                risk = pd.DataFrame(risk).groupby(turn).cumsum().to_numpy() if turn[-1] else np.cumsum(risk, axis=0)
                if s[0] == stratum:
                    risk[turn == 0] += carry
                carry, stratum = risk[-1].copy(), s[-1]
                _add(found, steps, begins, r_ends, v[count], risk[count])

            for part, s, t, v in blocks(batches):
                if carry is None:
                    carry, skip, goes = known[part]
                    stratum = s[0]
                if held is not None:
                    if held[:2] == (s[0], t[0]):
                        v[0] += held[2]
                    else:
                        s, t, v = np.concatenate([np.array([held[0]], object), s]), np.concatenate([[held[1]], t]), np.concatenate([held[2][None], v])
                held = (s[-1], t[-1], v[-1])
                if len(s) > 1:
                    count = np.ones(len(s) - 1, bool)
                    count[0], skip = not skip, False
                    work(s[:-1], v[:-1], count)
            if held is not None:
                work(np.array([held[0]], object), held[2][None], np.array([not skip and not goes]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.concatenate(found).tobytes()], pa.binary())], ["part", "v"])

        if known:
            rows = sorted(table.mapInArrow(inner, "part int, v binary").collect(), key=lambda r: r["part"])
            ends = np.cumsum([s.found for s in steps])[:-1]
            totals = [a + b for a, b in zip(totals, np.split(sum(np.frombuffer(r["v"]) for r in rows), ends), strict=True)]
        out = []
        for step, flat in zip(steps, totals, strict=True):
            c = len(step.curved)
            H = np.zeros((c + 1, 1, c + 1, 1))
            H[1:, 0, 1:, 0] = flat[step.p : step.p + c * c].reshape(c, c)
            out.append({"g0": np.zeros(1), "g": flat[: step.p, None], "H": H, "loss": float(flat[-2]), "full": float(flat[-1])})
        return out


#: Columns of what a task says of its outer times.
NAMES, OUTER = ["part", "s1", "t1", "s2", "t2", "v"], [pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.binary()]


def _add(totals: list[np.ndarray], steps: list[Step], begins: np.ndarray, r_ends: np.ndarray, vectors: np.ndarray, risk: np.ndarray) -> None:
    """Adds to each step's total the derivatives of these times."""
    for k, step in enumerate(steps):
        totals[k] += step.derivatives(vectors[:, begins[k] : begins[k + 1]], risk[:, r_ends[k] : r_ends[k + 1]])
