"""Weights, means and comoments of columns: what least squares needs, exact for columns far from 0 too.

Each task keeps count, mean and sums of products about its own mean and merges batch after batch; tasks are merged the
same way, tile by tile of the matrix, so no sum about 0 is ever formed. Tiles travel as arrays, are merged in two
stages and may stay a table: the driver then asks for a few columns of the matrix or for its product with a vector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.gram import MERGERS, MOST_ENTRIES, refuse, salts

#: Columns of a tile each way: 32 KB of numbers, so that an Arrow batch of 10,000 tiles fits in memory.
TILE = 64
#: Numbers that a task accumulates (256 MB); a larger matrix takes a pass per strip of its rows.
MOST_LOCAL = 1 << 25


@dataclass
class Comoments:
    """Sum of weights, weighted means, and weighted sums of products about the means (``about``)."""

    weight: float
    mean: np.ndarray
    about: np.ndarray

    @classmethod
    def none(cls, p: int) -> Comoments:
        return cls(0.0, np.zeros(p), np.zeros((p, p)))

    def __add__(self, other: Comoments) -> Comoments:
        w = self.weight + other.weight
        if not w:
            return self
        d = other.mean - self.mean
        return Comoments(w, self.mean + d * (other.weight / w), self.about + other.about + np.outer(d, d) * (self.weight * other.weight / w))

    def raw(self) -> np.ndarray:
        """Weighted sums of products about 0."""
        return self.about + self.weight * np.outer(self.mean, self.mean)


SCHEMA = "salt int, g int, i int, j int, bad double, weight double, left array<double>, right array<double>, about array<double>"


class _Part:
    """One group's running comoments of rows ``a`` ... ``b`` of the matrix against columns from ``a`` on."""

    def __init__(self, p: int, a: int, b: int):
        self.a, self.b, self.weight, self.mean, self.about, self.bad = a, b, 0.0, np.zeros(p), np.zeros((b - a, p - a)), 0.0

    def add(self, x: np.ndarray, w: np.ndarray) -> None:
        total = w.sum()
        if total <= 0:
            return
        mean = w @ x / total
        x = x - mean
        left = w @ x / total  # what rounding left of the mean
        mean, x = mean + left, x - left
        d, both = mean - self.mean, self.weight + total
        self.about += (x[:, self.a : self.b] * w[:, None]).T @ x[:, self.a :]
        self.about += np.outer(d[self.a : self.b], d[self.a :]) * (self.weight * total / both)
        self.mean += d * (total / both)
        self.weight = both


def _values(batch: pa.RecordBatch, p: int, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(columns, weights, whether a row is refused, groups). Nulls are 0; with ``strict`` a row must be ``sound``: then rows
    of weight 0 may hold anything, and others of null or non-finite values are refused."""
    cols = [batch.column(k) for k in range(p + 1)]
    cols = [(c if strict or not c.null_count else c.fill_null(0.0)).to_numpy(zero_copy_only=False) for c in cols]
    x, w, bad = np.column_stack(cols[:p]), cols[p], np.zeros(batch.num_rows, bool)
    if strict:
        known, weighed = np.isfinite(x).all(axis=1), np.isfinite(w) & (w >= 0)
        bad = ~weighed | ~known & (w != 0)
        if not known.all():
            x[~known] = 0.0
        w = np.where(bad, 0.0, w)
    return x, w, bad, batch.column(p + 1).to_numpy(zero_copy_only=False)


def _tiles(base: DataFrame, p: int, groups: int, a: int, b: int, parts: int, strict: bool) -> DataFrame:
    """The tiles of one task after another, of matrix rows ``a`` ... ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, _Part] = {}
        for batch in batches:
            x, w, bad, g = _values(batch, p, strict)
            for k in np.unique(g).tolist():
                own, part = g == k, found.setdefault(k, _Part(p, a, b))
                part.bad += bad[own].sum()
                part.add(x[own] if groups > 1 else x, w[own] if groups > 1 else w)
        salt = TaskContext.get().partitionId() % parts
        for k, part in found.items():
            rows = []
            for i in range(a, b, TILE):
                for j in range(i, p, TILE):
                    tile = part.about[i - a : min(i + TILE, b) - a, j - a : j - a + TILE]
                    rows.append((salt, k, i, j, part.bad if i == j == 0 else 0.0, part.weight, part.mean[i : min(i + TILE, b)], part.mean[j : j + TILE], tile.ravel()))
                yield _batch(rows)
                rows = []

    return base.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    numbers, types = list(zip(*rows, strict=True)), [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.list_(pa.float64())] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(numbers, types, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[int, int, int], list] = {}
    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("g", "i", "j", "bad", "weight")]
        arrays = [batch.column(c) for c in ("left", "right", "about")]
        for n, (g, i, j, bad, weight) in enumerate(zip(*keys, strict=True)):
            left, right, about = (c[n].values.to_numpy() for c in arrays)
            if (have := found.get((g, i, j))) is None:
                found[g, i, j] = [bad, weight, left, right, about]
                continue
            have[0] += bad
            both = have[1] + weight
            if both:
                dl, dr = left - have[2], right - have[3]
                have[4] = have[4] + about + np.outer(dl, dr).ravel() * (have[1] * weight / both)
                have[2], have[3], have[1] = have[2] + dl * (weight / both), have[3] + dr * (weight / both), both
    for key, have in found.items():
        yield _batch([(0, *key, *have)])


def tiles(df: DataFrame, columns: Sequence[Column], weight: Column | None = None, group: Column | None = None, groups: int = 1, strict: bool = False, whole: bool = True) -> DataFrame:
    """(g, i, j, bad, weight, left, right, about): the upper tiles of each group's comoments, i and j their first row and
    column, left and right the means there. One pass, or one for each strip of rows where a task can't hold all of them.
    Not ``whole``: up to ``MERGERS`` rows a tile are left to be merged."""
    p = len(columns)
    cells = [c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)]
    base = df.select(*cells, (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), (F.lit(0) if group is None else group.cast("int")).alias("g"))
    strip = max(TILE, MOST_LOCAL // (p * groups) // TILE * TILE)
    parts = MERGERS if whole else salts(p * p * groups)
    found = None
    for a in range(0, p, strip):
        own = _tiles(base, p, groups, a, min(a + strip, p), parts, strict)
        found = own if found is None else found.union(own)
    found = found.repartition(MERGERS if p <= TILE else MERGERS * 4, "salt", "g", "i", "j").mapInArrow(_merge, SCHEMA)
    if whole and parts > 1:
        found = found.repartition(MERGERS if p <= TILE else MERGERS * 4, "g", "i", "j").mapInArrow(_merge, SCHEMA)
    return found.drop("salt")


def comoments(df: DataFrame, columns: Sequence[Column], weight: Column | None = None, strict: bool = False) -> Comoments:
    """Of all rows; nulls count as 0, or with ``strict`` raise, as do other values that are not ``sound``."""
    return comoments_by(df, columns, weight, None, 1, strict)[0]


def comoments_by(df: DataFrame, columns: Sequence[Column], weight: Column | None, group: Column | None, groups: int, strict: bool = False) -> list[Comoments]:
    """``comoments`` of each value 0 ... groups - 1 of ``group``, all in one pass."""
    p = len(columns)
    if p * p * groups > MOST_ENTRIES:
        raise ValueError(f"{p * p * groups} numbers are too many for the driver; keep them as tiles")
    found, bad = tiles(df, columns, weight, group, groups, strict, whole=False).toArrow(), 0.0
    parts: dict[int, dict[tuple[int, int], list]] = {g: {} for g in range(groups)}
    for batch in found.to_batches():
        for merged in _merge(iter([batch])) if batch.num_rows else ():
            g, i, j, own, w = (merged.column(c)[0].as_py() for c in ("g", "i", "j", "bad", "weight"))
            left, right, about = (merged.column(c)[0].values.to_numpy() for c in ("left", "right", "about"))
            bad += own
            if g in parts:
                parts[g].setdefault((i, j), []).append((w, left, right, about.reshape(len(left), len(right))))
    refuse(bad)
    out = []
    for g in range(groups):
        m = Comoments.none(p)
        for (i, j), each in parts[g].items():
            w, left, right, about = each[0]
            for w2, l2, r2, a2 in each[1:]:
                if both := w + w2:
                    about = about + a2 + np.outer(l2 - left, r2 - right) * (w * w2 / both)
                    left, right, w = left + (l2 - left) * (w2 / both), right + (r2 - right) * (w2 / both), both
            m.weight = w
            m.mean[i : i + len(left)], m.mean[j : j + len(right)] = left, right
            m.about[i : i + len(left), j : j + len(right)] = about
            m.about[j : j + len(right), i : i + len(left)] = about.T
        out.append(m)
    return out


class TiledComoments:
    """Comoments of p columns as a table of tiles, whatever p: the driver holds vectors of p and the columns it asked for."""

    def __init__(self, table: DataFrame, p: int):
        """``table`` as ``tiles`` gives it; stored or persisted, as each question reads it."""
        self.table, self.p, self._head = table, p, None

    def head(self) -> tuple[float, np.ndarray, np.ndarray]:
        """(sum of weights, means, variances times it) of all columns."""
        if self._head is None:
            side = F.size("left")
            diagonal = F.transform(F.sequence(F.lit(0), side - 1), lambda k: F.element_at("about", k * side + k + 1))
            weight, mean, var, bad = 0.0, np.zeros(self.p), np.zeros(self.p), 0.0
            for r in self.table.where("i = j").select("i", "weight", "bad", "left", diagonal.alias("d")).toLocalIterator():
                weight, bad = r["weight"], bad + r["bad"]
                mean[r["i"] : r["i"] + len(r["left"])], var[r["i"] : r["i"] + len(r["left"])] = r["left"], r["d"]
            refuse(bad)
            self._head = weight, mean, var
        return self._head

    def columns(self, at: Sequence[int]) -> np.ndarray:
        """(p, len(at)): those columns of ``about``; only their tiles are read."""
        at = list(at)
        if self.p * len(at) > MOST_ENTRIES:
            raise ValueError(f"{self.p * len(at)} numbers are too many for the driver; ask for fewer columns")
        starts, place, out = sorted({k // TILE * TILE for k in at}), {k: n for n, k in enumerate(at)}, np.zeros((self.p, len(at)))
        for r in self.table.where(F.col("i").isin(starts) | F.col("j").isin(starts)).select("i", "j", F.size("left").alias("n"), "about").toLocalIterator():
            a, i, j = np.array(r["about"]).reshape(r["n"], -1), r["i"], r["j"]
            for k in range(j, j + a.shape[1]):
                if k in place:
                    out[i : i + a.shape[0], place[k]] = a[:, k - j]
            for k in range(i, i + a.shape[0]):
                if k in place:
                    out[j : j + a.shape[1], place[k]] = a[k - i]
        return out

    def times(self, v: Sequence[float]) -> np.ndarray:
        """``about`` times a vector: tiles multiply where they are, p numbers come back."""
        v, p = np.asarray(v, float), self.p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p)
            for b in batches:
                for i, j, n, a in zip(b.column("i").to_pylist(), b.column("j").to_pylist(), b.column("n").to_pylist(), b.column("about"), strict=True):
                    a = a.values.to_numpy().reshape(n, -1)
                    total[i : i + n] += a @ v[j : j + a.shape[1]]
                    if i != j:
                        total[j : j + a.shape[1]] += a.T @ v[i : i + n]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

        found = self.table.select("i", "j", F.size("left").alias("n"), "about").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(p)
        out[found.column("at").to_numpy()] = found.column("v").to_numpy()
        return out
