"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, then exact cosine checks.

Tables carry no vectors but short sketches of them: members of a bucket whose sketches are near form families, over
all tables. A vector moves once, to its family, whose pairs are checked exactly; a family too large for one task is
checked bucket by bucket instead."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import Stored, pick
from ridgeline.llm.components import connected_components

WIDTH, SEED = 2.0, 20_240_229
#: Members of a bucket that hashes aim at for unrelated vectors, and the chance that a pair at the bound meets nowhere.
AIM, MISS = 1024, 2e-4
#: Sketch bits, the width of their cells, and standard deviations by which a pair at the bound may differ in more of them
#: than it should.
BITS, CELL, SLACK = 256, 1.5, 4.5
#: Members of a bucket or family compared in one task; larger ones are dealt out as pairs of blocks.
BLOCK = 4096
#: Copies of one vector beyond which it is joined back by broadcast.
HOT = 1_000_000


#: Columns of a sketch.
SKETCH = [f"s{k}" for k in range(BITS // 64)]


def meeting(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection puts two vectors of this distance into one cell."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def distance(cosine: float) -> float:
    return math.sqrt(max(2 - 2 * cosine, 0.0))


def plan(n: int, cosine: float, mean_cosine: float = 0.0) -> tuple[int, int]:
    """(tables, hashes of each) for ``n`` vectors: hashes grow with log n, so that buckets of unrelated vectors, whose
    cosines average ``mean_cosine``, keep about ``AIM`` members, and tables with n^rho, so that a pair at ``cosine`` still
    meets with 1 - MISS; rho = log p(near) / log p(far), at 0.95 0.19 for a mean of 0 and 0.27 for 0.5. Sketch comparisons
    are n^(1 + rho) in all, not n^2. Unrelated vectors are taken to lie at least twice as far apart as a pair at the bound."""
    near_by = max(distance(cosine), 1e-3)
    near, far = meeting(near_by), meeting(max(distance(max(mean_cosine, 0.0)), 2 * near_by))
    hashes = max(2, math.ceil(math.log(max(n / AIM, 1.0)) / -math.log(far)))
    return max(1, math.ceil(math.log(MISS) / math.log1p(-(near**hashes)))), hashes


def differing(apart: float) -> float:
    """Chance that a sketch bit differs for two vectors of this distance: the cells of a projection are even or odd."""
    odd = range(1, 40, 2)
    return 0.5 - 4 / math.pi**2 * sum(math.exp(-((k * math.pi * apart / CELL) ** 2) / 2) / k**2 for k in odd)


def most_bits(cosine: float) -> int:
    """Sketch bits in which a pair at ``cosine`` may differ."""
    share = differing(distance(cosine))
    return min(BITS, math.ceil(BITS * share + SLACK * math.sqrt(BITS * share * (1 - share))))


@lru_cache(maxsize=4)
def projections(dim: int, tables: int, hashes: int) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng([SEED, dim])
    sketch, shift = rng.standard_normal((dim, BITS)), rng.uniform(0, 2 * CELL, BITS)
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes), rng.integers(1, 1 << 61, (tables, hashes + 1)) | 1, sketch, shift


def bucket_keys(unit: np.ndarray, tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """((rows, tables) bucket keys, (rows, BITS / 64) sketches): a key mixes the table, the vector's length and
    floor((a.v + b) / w) of its projections to 64 bits; a sketch is the parities of such floors of other projections.
    Both depend on distances alone, so vectors that share a mean lose nothing."""
    a, b, mix, sketch, shift = projections(unit.shape[1], tables, hashes)
    cell = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), tables, hashes)
    with np.errstate(over="ignore"):
        mixed = (cell * mix[:, :hashes]).sum(axis=2) + mix[:, hashes] * np.int64(unit.shape[1])
        mixed = (mixed ^ mixed >> 29) * np.int64(-7046029254386353131)
    return mixed ^ mixed >> 32, np.packbits(np.floor((unit @ sketch + shift) / CELL).astype(np.int64) & 1 == 1, axis=1).view(np.int64)


def unit_length(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def stacked(batches: Iterator[pa.RecordBatch], column: str = "embedding") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows of one length, their vectors in double precision), some hundred rows at once."""
    for batch in batches:
        vectors = batch.column(column)
        sizes = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy().astype(np.float64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for some in np.array_split(rows, len(rows) // 512 + 1):
                if len(some):
                    yield batch, some, np.stack([values[at[i] : at[i + 1]] for i in some])


def sketches(tables: int, hashes: int):
    """One row per vector and table: the bucket, the vector's number and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some, v in stacked(batches):
            keys, bits = bucket_keys(unit_length(v), tables, hashes)
            ids = batch.column("id").to_numpy()[some]
            for t in range(tables):  # a table at once, so that a batch doesn't grow with their number
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), pa.array(ids), *(pa.array(bits[:, k]) for k in range(len(SKETCH)))], ["bucket", "id", *SKETCH])

    return run


def spread(kind: str, tables: int, hashes: int):
    """One row per vector and table: the bucket and the vector in its own precision ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some, v in stacked(batches):
            keys, _ = bucket_keys(unit_length(v), tables, hashes)
            ids, times = batch.column("id").to_numpy()[some], batch.column("times").to_numpy()[some]
            raw = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t, np.int32)), pa.array(keys[:, t]), pa.array(ids), pa.array(times), raw], ["tab", "bucket", "id", "times", "vector"])

    return run


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, n, at, total): of each length that a task meets, the number of unit vectors and their sum by component."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for _, some, v in stacked(batches):
        n, total = held.get(v.shape[1], (0, 0.0))
        held[v.shape[1]] = n + len(some), total + unit_length(v).sum(axis=0)
    for dim, (n, total) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim), pa.array([n] * dim), pa.array(range(dim), pa.int64()), pa.array(total)], ["dim", "n", "at", "total"])


def mean_cosine(nodes: DataFrame) -> float:
    """Mean cosine over all pairs of vectors of one length, from the sums of their unit vectors: two numbers reach the driver."""
    by = nodes.select("embedding").mapInArrow(sums, "dim long, n long, at long, total double").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    pairs = F.when(F.col("at") == 0, F.col("n").cast("double") * F.col("n"))
    row = by.agg(F.sum(F.col("total") * F.col("total") - F.when(F.col("at") == 0, F.col("n")).otherwise(0)).alias("cosines"), F.sum(pairs - F.col("n")).alias("pairs")).first()
    return row["cosines"] / row["pairs"] if row["pairs"] else 0.0


def packed(kind: str):
    """(id, times, vector): vectors as bytes of their own precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some, v in stacked(batches):
            yield pa.RecordBatch.from_arrays([*(pa.array(batch.column(c).to_numpy()[some]) for c in ("id", "times")), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())], ["id", "times", "vector"])

    return run


def dealt(rows: DataFrame, store: Stored, *keys: str) -> DataFrame:
    """``rows`` with the pair of blocks (i, j) in which each meets others of its ``keys`` and whether it is of block j
    alone (side 1), sorted so that those that meet are runs. Keys of over ``BLOCK`` rows are dealt out: each row gets
    a block by its hash, and each pair of blocks, a block with itself included, is a run of its own. The table of
    large keys is stored: it is broadcast only below Spark's threshold, else both sides are shuffled."""
    large, _ = store.put(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    met = rows.join(large, list(keys), "left").withColumn("own", own).withColumn("meet", F.explode(meet))
    met = met.select(*keys, F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), (F.col("own") != F.col("meet.i")).cast("int").alias("side"), *(c for c in rows.columns if c not in keys))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """(keys, rows) of each run of equal keys, of two blocks of rows at most."""
    held, now = [], None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            key = tuple(int(c[lo]) for c in columns)
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held).combine_chunks()
                held, now = [], key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def kin(most: int):
    """Links that span what near sketches connect in each run, fewer than its members."""

    def near(bits: np.ndarray, one: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(bits[one][:, None] ^ bits[others][None, :]).sum(axis=2, dtype=np.int64) <= most

    def spanning(bits: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Members without any near one are left out first; the others are walked breadth-first."""
        same = left is right
        some_l, some_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for at in range(0, len(left), 256):
            close = near(bits, left[at : at + 256], right)
            if same:
                close[np.arange(len(close)), np.arange(at, at + len(close))] = False
            some_l[at : at + 256] = close.any(axis=1)
            some_r |= close.any(axis=0)
        rest = [left[some_l], left[some_l] if same else right[some_r]]
        links: list[tuple[int, int]] = []
        while len(rest[0]) and len(rest[1]):
            queue, rest[0] = [(0, rest[0][0])], rest[0][1:]
            if same:
                rest[1] = rest[0]
            while queue:
                side, k = queue.pop()
                other = 1 if same else 1 - side
                if not len(rest[other]):
                    continue
                close = near(bits, np.array([k]), rest[other])[0]
                if close.any():
                    found = rest[other][close]
                    links += [(int(k), int(x)) for x in found]
                    queue += [(other, x) for x in found]
                    rest[other] = rest[other][~close]
                    if same:
                        rest[0] = rest[1]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for (_, i, j), rows in runs(batches, "bucket", "i", "j"):
            ids, side = rows.column("id").to_numpy(), rows.column("side").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if i == j:
                right = left
            if len(left) and len(right) and len(ids) > 1:
                found = np.array(spanning(np.stack([rows.column(c).to_numpy().view(np.uint64) for c in SKETCH], axis=1), left, right), np.int64).reshape(-1, 2)
                a.append(ids[found[:, 0]])
                b.append(ids[found[:, 1]])
            if len(a) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def compared(ids: np.ndarray, times: np.ndarray, units: np.ndarray, keys: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, cosine: float):
    """Links between rows ``left`` and ``right`` of one bucket: (weights for ids, spanning links). A pair counts in
    the first table in which it meets."""
    weight = np.zeros(len(ids), np.int64)
    near = np.zeros((len(left), len(right)), bool)
    same = left is right
    for at in range(0, len(left), 512):
        some = left[at : at + 512]
        close = units[some] @ units[right].T >= cosine
        if same:
            close[np.arange(len(some)), np.arange(at, at + len(some))] = False
        near[at : at + len(some)] = close
        i, j = np.nonzero(close)
        a, b = some[i], right[j]
        for t in range(table):
            if not len(a):
                break
            new = keys[a, t] != keys[b, t]
            a, b = a[new], b[new]
        weight += np.bincount(a, times[b], len(ids)).astype(np.int64)
        if not same:
            weight += np.bincount(b, times[a], len(ids)).astype(np.int64)
    edges: list[tuple[int, int]] = []
    waiting_l, waiting_r = near.any(axis=1), near.any(axis=0)
    while waiting_l.any():  # breadth-first over the links of this block
        first = int(np.flatnonzero(waiting_l)[0])
        waiting_l[first] = False
        if same:
            waiting_r[first] = False
        queue = [(0, first)]
        while queue:
            side, k = queue.pop()
            found = np.flatnonzero(near[k] & waiting_r) if side == 0 else np.flatnonzero(near[:, k] & waiting_l)
            here, there = (left[k], right[found]) if side == 0 else (right[k], left[found])
            edges += [(int(ids[here]), int(ids[x])) for x in there]
            (waiting_r if side == 0 else waiting_l)[found] = False
            if same:
                waiting_l[found] = False
            queue += [(0 if same else 1 - side, int(f)) for f in found]
    return weight, edges


def checked(cosine: float, kind: str, tables: int, hashes: int):
    """Exact links of each run of a bucket: rows with ``links`` for ids, and spanning links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (table, _, i, j), rows in runs(batches, "tab", "bucket", "i", "j"):
            ids, times, side = (rows.column(c).to_numpy() for c in ("id", "times", "side"))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            right = left if i == j else right
            if len(ids) < 2 or not len(left) or not len(right):
                continue
            units = unit_length(np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
            weight, edges = compared(ids, times, units, bucket_keys(units, tables, hashes)[0], table, left, right, cosine)
            at = np.flatnonzero(weight)
            a, b = [x for x, _ in edges], [x for _, x in edges]
            # rows with a weight carry links of their id; rows without one are spanning links
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[at], np.array(a, np.int64)])), pa.array([None] * len(at) + b, pa.int64()), pa.array(np.concatenate([weight[at], np.zeros(len(a), np.int64)]))], ["a", "b", "links"])

    return run


def verified(cosine: float, kind: str):
    """(a, component, links) of each member of a family: all its pairs are compared, and its links stay inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "family"):
            ids, times, n = rows.column("id").to_numpy(), rows.column("times").to_numpy(), rows.num_rows
            units = unit_length(np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(n, -1).astype(np.float64))
            every = np.arange(n)
            weight, edges = compared(ids, times, units, np.zeros((n, 1), np.int64), 0, every, every, cosine)
            root = {int(i): int(i) for i in ids}

            def top(x: int, root: dict[int, int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in edges:
                a, b = sorted((top(a), top(b)))
                root[b] = a
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([top(int(i)) for i in ids], pa.int64()), pa.array(weight)], ["a", "component", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row, linking vectors of cosine >= ``cosine`` in double precision.

    Null, empty and zero vectors and vectors with null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors are one node with a multiplicity, so copies never meet as pairs; they link with
    one another. Ids are integers; repeated ids count as vectors of their own. An empty table gives an empty table.

    Candidates share a bucket in one of the tables that ``plan`` gives for their number and mean cosine, which is measured
    over all: a pair at the bound is found with probability 1 - MISS, closer ones more surely. Buckets hold numbers and
    sketches, about 50 bytes a vector and table; those of
    near sketches are spanned by links, and what these connect is a family. Each vector then moves once, to its family,
    and all pairs there are checked. Families of over ``BLOCK`` vectors are checked bucket by bucket instead, where
    each pair counts in the first table it shares. Buckets over ``BLOCK`` members are dealt out as pairs of blocks, so
    a task never holds more than two blocks and returns fewer links than members, never all pairs."""
    spark = vectors.sparkSession
    store = Stored(spark, "vectors")
    base = pick(vectors, id=id_col, embedding=vector_col)
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"  # either holds the components exactly
    keyed = base.where(sound).select("id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    distinct = keyed.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("id").alias("first"), F.count("*").alias("times"))
    # ids may repeat or be null, so nodes carry a number of their own, fixed by the stored table
    nodes, _ = store.put(distinct.withColumn("node", F.monotonically_increasing_id()))
    tables, hashes = plan(nodes.count(), cosine, mean_cosine(nodes))
    own = nodes.select(F.col("node").alias("id"), "times", "embedding").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = dealt(own.mapInArrow(sketches(tables, hashes), "bucket long, id long, " + ", ".join(f"{c} long" for c in SKETCH)), store, "bucket")
    family, _ = store.put(connected_components(near.mapInArrow(kin(most_bits(cosine)), "a long, b long"), store).withColumnRenamed("component", "family"))
    sizes = family.groupBy("family").agg(F.count("*").alias("n"))
    members, _ = store.put(family.join(sizes, "family").withColumnRenamed("node", "id"))
    raw = own.mapInArrow(packed(kind), "id long, times long, vector binary")
    small = raw.join(members.where(F.col("n") <= BLOCK).select("id", "family"), "id").repartition("family").sortWithinPartitions("family")
    inside, _ = store.put(small.mapInArrow(verified(cosine, kind), "a long, component long, links long"))
    large = own.join(members.where(F.col("n") > BLOCK).select("id"), "id", "left_semi").mapInArrow(spread(kind, tables, hashes), "tab int, bucket long, id long, times long, vector binary")
    found, _ = store.put(dealt(large, store, "tab", "bucket").mapInArrow(checked(cosine, kind, tables, hashes), "a long, b long, links long"))
    labels = connected_components(found.where("b is not null").select("a", "b"), store)
    labels = inside.select(F.col("a").alias("node"), "component").union(labels)
    counts = inside.select("a", "links").union(found.where("b is null").select("a", "links")).groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    labelled = nodes.join(counts, "node", "left").join(labels, "node", "left").select("h1", "h2", "first", "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named, _ = store.put(labelled.join(smallest, "component").select("h1", "h2", "times", "n_links", "component_id"))
    # vectors of over HOT copies, rows / HOT of them at most, are broadcast: no task joins one vector's rows alone
    cold, hot = named.where(F.col("times") <= HOT).drop("times"), F.broadcast(named.where(F.col("times") > HOT).drop("times"))
    rows = keyed.drop("embedding")
    linked = rows.join(hot, ["h1", "h2"]).union(rows.join(hot, ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"])).select("id", "n_links", "component_id")
    alone = base.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
