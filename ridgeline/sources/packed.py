"""Genotype matrices of real width: two bits a call in blocks of rows and variants, products on the blocks.

A matrix of n rows and p variants is a table of about n/4096 * p/256 blocks of up to 256 KB each. Products decode a block at a
time in NumPy, so no plan names a variant and no name of one reaches the driver; missing calls take their variant's impute
value as they are multiplied. Long calls are packed by a shuffle to their block, binary genotype files without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.sources.storage import Stored

#: Rows and variants of a block. Code 3 is a missing call.
ROWS, VARIANTS, ABSENT = 4096, 256, 3
#: Calls of a row that share a long.
WORD = 32
BLOCKS = "rb int, vb int, n int, codes binary"
_DECODED = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int8)


def encode(calls: np.ndarray) -> bytes:
    """Codes 0 ... 3 (variants x rows), four to a byte, each variant from a byte of its own."""
    rows = calls.shape[1]
    wide = np.zeros((calls.shape[0], -(-rows // 4) * 4), np.uint8)
    wide[:, :rows] = calls
    return (wide[:, 0::4] | wide[:, 1::4] << 2 | wide[:, 2::4] << 4 | wide[:, 3::4] << 6).tobytes()


def decode(codes: bytes, rows: int) -> np.ndarray:
    width = -(-rows // 4)
    return _DECODED[np.frombuffer(codes, np.uint8).reshape(-1, width)].reshape(-1, 4 * width)[:, :rows]


def ranked(ids: DataFrame, name: str, store: Stored) -> DataFrame:
    """(name, at): each distinct value's place in their order. Ranges of values number themselves; their totals, a row a
    range, are summed in one task and broadcast. The ranges are stored, so a repeated task finds the same."""
    parts, _ = store.put(ids.select(name).distinct().repartitionByRange(name).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select(name, (F.col("place") + F.col("before")).cast("long").alias("at"))


def pack(calls: DataFrame, path: str) -> None:
    """Packs long calls (row_id, snp, call), each pair once at most; a null or negative call is missing, an absent pair 0, a
    call over 2 raises. Rows and variants keep their order."""
    spark, store = calls.sparkSession, Stored(calls.sparkSession, "packing")
    known, _ = store.put(calls.groupBy("snp").agg(F.max("call").alias("top")))
    if not known.where("top > 2").isEmpty():
        raise ValueError("calls must be at most 2")
    ranked(known, "snp", store).write.mode("overwrite").parquet(f"{path}/variants")
    variants = spark.read.parquet(f"{path}/variants")
    p = variants.count()
    # a row's calls meet as bits of words before anything is shuffled; words number their rows as ``ranked`` does
    code = F.when(F.col("call") >= 0, F.col("call")).otherwise(ABSENT).cast("long")
    placed = calls.select("row_id", "snp", code.alias("code")).join(variants.withColumnRenamed("at", "v"), "snp")
    place = (F.col("v") % VARIANTS).cast("int")
    words = placed.groupBy("row_id", (F.col("v") / VARIANTS).cast("int").alias("vb"), (place / WORD).cast("int").alias("wd")).agg(F.bit_or(F.call_function("shiftleft", F.col("code"), 2 * (place % WORD))).alias("bits"))
    parts, dealt = store.put(words.repartitionByRange("row_id").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy("row_id", "vb", "wd")
    first = F.coalesce(~F.col("row_id").eqNullSafe(F.lag("row_id").over(own)), F.lit(True)) | (F.row_number().over(own) == 1)
    turned, numbered = store.put(parts.withColumn("first", first).withColumn("place", F.sum(F.col("first").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    totals = turned.groupBy("part").agg((F.max("place") + 1).alias("n"))
    before = F.broadcast(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    cells = turned.join(before, "part").withColumn("at", F.col("place") + F.col("before"))
    cells.where("first").select("row_id", "at").write.mode("overwrite").parquet(f"{path}/rows")
    n = spark.read.parquet(f"{path}/rows").count()
    cells = cells.select((F.col("at") / ROWS).cast("int").alias("rb"), "vb", (F.col("at") % ROWS).cast("int").alias("r"), "wd", "bits")

    def block(table: pa.Table) -> pa.Table:
        rb, vb = table.column("rb")[0].as_py(), table.column("vb")[0].as_py()
        size = min(ROWS, n - rb * ROWS)
        out = np.zeros((min(VARIANTS, p - vb * VARIANTS), size), np.uint8)
        r, wd, bits = (table.column(c).to_numpy() for c in ("r", "wd", "bits"))
        for w in np.unique(wd):
            at = wd == w
            for k, v in enumerate(range(w * WORD, min((w + 1) * WORD, len(out)))):
                out[v, r[at]] = bits[at] >> 2 * k & 3
        return pa.table({"rb": pa.array([rb], pa.int32()), "vb": pa.array([vb], pa.int32()), "n": pa.array([size], pa.int32()), "codes": pa.array([encode(out)], pa.binary())})

    # every block has a row, so that rows whose calls there are all 0 are known
    across, down = -(-p // VARIANTS), -(-n // ROWS)
    every = spark.range(across * down).select((F.col("id") / across).cast("int").alias("rb"), (F.col("id") % across).cast("int").alias("vb"))
    found = cells.groupBy("rb", "vb").applyInArrow(block, BLOCKS)
    size = F.least(F.lit(ROWS), F.lit(n) - F.col("rb") * ROWS).cast("int")
    whole = every.join(found, ["rb", "vb"], "left").select("rb", "vb", size.alias("n"), "codes")
    _write_blocks(whole, path)
    for table in (dealt, numbered):
        store.drop(table)
    _write_stats(Packed(spark, path, stats=False), path)


def pack_bed(spark: SparkSession, file: str, path: str, samples: int, variants: int) -> None:
    """Packs a binary genotype file, two bits a call, variant by variant; rows and variants are their places in it. A task
    reads ``VARIANTS`` variants, whose bits it deals to the blocks of rows; nothing is shuffled."""
    width, steps = -(-samples // 4), -(-variants // VARIANTS)
    code = np.array([2, ABSENT, 1, 0], np.uint8)  # fixed values: 00 two copies, 01 missing, 10 one, 11 none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(file if "://" in file else f"file://{file}")
        for batch in batches:
            for vb in batch.column("id").to_pylist():
                with system.open_input_file(at) as f:
                    if f.read_at(3, 0) != b"\x6c\x1b\x01":
                        raise ValueError(f"{file} holds no genotypes by variant")
                    n = min(VARIANTS, variants - vb * VARIANTS)
                    raw = f.read_at(n * width, 3 + vb * VARIANTS * width)
                calls = code[decode(raw, samples)]
                for rb in range(-(-samples // ROWS)):
                    part = calls[:, rb * ROWS : (rb + 1) * ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([rb], pa.int32()), pa.array([vb], pa.int32()), pa.array([part.shape[1]], pa.int32()), pa.array([encode(part)], pa.binary())], ["rb", "vb", "n", "codes"])

    _write_blocks(spark.range(0, steps, 1, max(1, min(steps, 10_000))).mapInArrow(run, BLOCKS), path)
    for name, column, n in (("rows", "row_id", samples), ("variants", "snp", variants)):
        spark.range(n).select(F.col("id").alias(column), F.col("id").alias("at")).write.mode("overwrite").parquet(f"{path}/{name}")
    _write_stats(Packed(spark, path, stats=False), path)


def _write_blocks(blocks: DataFrame, path: str) -> None:
    """In row groups of some 100 blocks: a reader takes up to 4,096 rows of a group at once, which would be 1 GB of blocks."""
    blocks.write.mode("overwrite").option("parquet.block.size", 1 << 24).option("parquet.enable.dictionary", "false").parquet(f"{path}/blocks")


def _write_stats(packed: Packed, path: str) -> None:
    """(vb, place, nnm, nnz, total) by variant: known calls, calls that aren't 0 (missing ones included), sum of known ones."""

    def of(d: np.ndarray, _) -> np.ndarray:
        absent = d == ABSENT
        return np.column_stack([(~absent).sum(axis=1), (d != 0).sum(axis=1), np.where(absent, 0, d).sum(axis=1)])

    found = packed._by_variant(packed.blocks, of, 3).toDF("vb", "place", "nnm", "nnz", "total")
    stats = found.select("vb", "place", F.col("nnm").cast("long").alias("nnm"), F.col("nnz").cast("long").alias("nnz"), (F.col("total") / F.greatest("nnm", F.lit(1))).alias("impute"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")


class Packed:
    """A packed genotype matrix; missing calls count as their variant's mean call."""

    def __init__(self, spark: SparkSession, path: str, stats: bool = True):
        self.spark = spark
        self.blocks, self.rows, self.variants = (spark.read.parquet(f"{path}/{x}") for x in ("blocks", "rows", "variants"))
        self.n, self.p = self.rows.count(), self.variants.count()
        self.stats = spark.read.parquet(f"{path}/stats") if stats else None

    # --- kernels over blocks ---------------------------------------------------------------------------
    def _by_variant(self, blocks: DataFrame, of: Callable, width: int) -> DataFrame:
        """(vb, place, s0 ...): sums over row blocks of ``of(codes, row of the block's other columns)``, variants x width.
        A task adds up its own blocks of a variant block before anything is shuffled."""
        p = self.p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}

            def flush() -> Iterator[pa.RecordBatch]:
                for vb, s in sums.items():
                    at = np.arange(len(s), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), vb, np.int32)), pa.array(at), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(width))], ["vb", "place", *(f"s{k}" for k in range(width))])
                sums.clear()

            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "v"}
                    row["v"] = batch.column("v")[k].values.to_numpy() if "v" in batch.schema.names else None
                    size = min(VARIANTS, p - row["vb"] * VARIANTS)
                    d = decode(row["codes"], row["n"])[:size] if row["codes"] is not None else np.zeros((size, row["n"]), np.int8)
                    found = np.asarray(of(d, row["v"]), float)
                    sums[row["vb"]] = sums[row["vb"]] + found if row["vb"] in sums else found
                    if len(sums) * width > 20_000:
                        yield from flush()
            yield from flush()

        found = blocks.mapInArrow(run, "vb int, place int, " + ", ".join(f"s{k} double" for k in range(width)))
        return found.groupBy("vb", "place").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(width)))

    def by_rows(self, table: DataFrame, value: str = "v") -> DataFrame:
        """(rb, v): a value per row_id as one array a row block; rows that ``table`` lacks count as 0."""
        placed = self.rows.join(table.select("row_id", F.col(value).cast("double").alias("x")), "row_id", "left")
        cell = F.struct((F.col("at") % ROWS).alias("r"), F.coalesce("x", F.lit(0.0)).alias("x"))
        return placed.groupBy((F.col("at") / ROWS).cast("int").alias("rb")).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["x"]).alias("v"))

    def tmul(self, v: DataFrame) -> DataFrame:
        """(snp, value): X'v for (rb, v) as ``by_rows`` gives it. Missing calls of a variant add its mean times their v."""

        def of(d: np.ndarray, v: np.ndarray) -> np.ndarray:
            absent = d == ABSENT
            return np.column_stack([np.where(absent, 0, d) @ v, absent @ v])

        found = self._by_variant(self.blocks.join(v, "rb"), of, 2).join(self.stats.select("vb", "place", "impute"), ["vb", "place"])
        at = (F.col("vb").cast("long") * VARIANTS + F.col("place")).alias("at")
        return found.select(at, (F.col("s0") + F.col("impute") * F.col("s1")).alias("value")).join(self.variants, "at").select("snp", "value")

    def mul(self, beta: DataFrame) -> DataFrame:
        """(rb, v): X b for a table (snp, beta) of the coefficients that aren't 0; only their variant blocks are read."""
        own = beta.join(self.variants, "snp").select((F.col("at") / VARIANTS).cast("int").alias("vb"), (F.col("at") % VARIANTS).cast("int").alias("place"), F.col("beta").cast("double"))
        own = own.join(self.stats.select("vb", "place", "impute"), ["vb", "place"]).groupBy("vb").agg(F.collect_list(F.struct("place", "beta", "impute")).alias("b"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}

            def flush() -> Iterator[pa.RecordBatch]:
                for rb, s in sums.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), rb, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["rb", "r", "s"])
                sums.clear()

            for batch in batches:
                for k in range(batch.num_rows):
                    rb, n, codes, b = (batch.column(c)[k].as_py() for c in ("rb", "n", "codes", "b"))
                    at = [x["place"] for x in b]
                    d = decode(codes, n)[at] if codes is not None else np.zeros((len(at), n), np.int8)
                    x = np.where(d == ABSENT, np.array([x["impute"] for x in b])[:, None], d)
                    found = np.array([x["beta"] for x in b]) @ x
                    sums[rb] = sums[rb] + found if rb in sums else found
                    if len(sums) > 64:
                        yield from flush()
            yield from flush()

        added = self.blocks.join(own, "vb").mapInArrow(run, "rb int, r int, s double").groupBy("rb", "r").agg(F.sum("s").alias("s"))
        return added.groupBy("rb").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda c: c["s"]).alias("v"))

    def gram(self, left: Sequence, right: Sequence) -> np.ndarray:
        """X_l' X_r for variants by name, at most some thousands: row blocks bring their chosen variants together."""
        names = list(dict.fromkeys([*left, *right]))
        chosen = self.spark.createDataFrame([(s, k) for k, s in enumerate(names)], "snp long, k int").join(self.variants, "snp")
        chosen = chosen.select("k", (F.col("at") / VARIANTS).cast("int").alias("vb"), (F.col("at") % VARIANTS).cast("int").alias("place")).join(self.stats.select("vb", "place", "impute"), ["vb", "place"])
        own = F.broadcast(chosen.groupBy("vb").agg(F.collect_list(F.struct("k", "place", "impute")).alias("b")))
        place = {s: k for k, s in enumerate(names)}
        a, b = [place[s] for s in left], [place[s] for s in right]

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The chosen variants of each block, bits still packed."""
            for batch in batches:
                for k in range(batch.num_rows):
                    rb, n, codes, b = (batch.column(c)[k].as_py() for c in ("rb", "n", "codes", "b"))
                    width = -(-n // 4)
                    parts = [codes[x["place"] * width : (x["place"] + 1) * width] if codes is not None else bytes(width) for x in b]
                    cells = [pa.array([rb] * len(b), pa.int32()), pa.array([n] * len(b), pa.int32()), pa.array([x["k"] for x in b], pa.int32()), pa.array([x["impute"] for x in b], pa.float64()), pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, ["rb", "n", "k", "impute", "codes"])

        def multiply(table: pa.Table) -> pa.Table:
            n = table.column("n")[0].as_py()
            x = np.zeros((len(names), n))
            for k, impute, codes in zip(table.column("k").to_pylist(), table.column("impute").to_pylist(), table.column("codes").to_pylist(), strict=True):
                d = decode(codes, n)[0]
                x[k] = np.where(d == ABSENT, impute, d)
            g = x[a] @ x[b].T
            i, j = np.indices(g.shape).reshape(2, -1)
            return pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "g": pa.array(g.ravel())})

        picked = self.blocks.join(own, "vb").mapInArrow(pick, "rb int, n int, k int, impute double, codes binary")
        found = picked.groupBy("rb").applyInArrow(multiply, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
        out = np.zeros((len(left), len(right)))
        out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("g").to_numpy()
        return out

    def per_row(self, v: DataFrame) -> DataFrame:
        """(row_id, v) of a table (rb, v)."""
        long = v.select("rb", F.posexplode("v").alias("r", "v")).select((F.col("rb").cast("long") * ROWS + F.col("r")).alias("at"), "v")
        return long.join(self.rows, "at").select("row_id", "v")


class PackedProblem:
    """A packed matrix and a response (row_id, y) for ``plans.screened.screened_path``; variants are its columns."""

    def __init__(self, packed: Packed, response: DataFrame):
        self.packed, self.p = packed, packed.p
        self.snps = packed.variants.orderBy("at").select("snp").toArrow().column("snp").to_numpy()
        self.names = [f"snp_{s}" for s in self.snps]
        store = Stored(packed.spark, "packed")
        held, path = store.put(response.select("row_id", F.col("y").cast("double").alias("y")))  # read twice, computed once
        self.y, _ = store.put(packed.by_rows(held, "y"))
        self.row = held.agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"), F.avg(F.col("y") * F.col("y")).alias("s")).first()
        store.drop(path)

    def _vector(self, v: DataFrame) -> np.ndarray:
        got, out = self.packed.tmul(v).toArrow(), np.zeros(self.p)
        out[np.searchsorted(self.snps, got.column("snp").to_numpy())] = got.column("value").to_numpy()
        return out / self.packed.n

    def response(self) -> tuple[float, float, float]:
        return self.row["m"], self.row["v"], self.row["s"]

    def means(self) -> np.ndarray:
        """Missing calls count as their variant's mean, so that is the mean of all."""
        got, out = self.packed.stats.select((F.col("vb").cast("long") * VARIANTS + F.col("place")).alias("at"), "impute").toArrow(), np.zeros(self.p)
        out[got.column("at").to_numpy()] = got.column("impute").to_numpy()
        return out

    def products(self, inter: float, beta: np.ndarray) -> np.ndarray:
        if not np.any(beta):
            return self._vector(self.y.select("rb", F.transform("v", lambda c: c - inter).alias("v")))
        rows = [(int(self.snps[g]), float(beta[g])) for g in np.flatnonzero(beta)]
        eta = self.packed.mul(self.packed.spark.createDataFrame(rows, "snp long, beta double")).withColumnRenamed("v", "eta")
        return self._vector(self.y.join(eta, "rb").select("rb", F.zip_with("v", "eta", lambda a, b: a - b - inter).alias("v")))

    def gram(self, left: list[int], right: list[int]) -> np.ndarray:
        return self.packed.gram([int(self.snps[j]) for j in left], [int(self.snps[j]) for j in right]) / self.packed.n


def packed_path(packed: Packed, response: DataFrame, options=None):
    """A gaussian path over all variants for (row_id, y), variants being groups of one: see ``plans.screened``."""
    from ridgeline.plans.screened import screened_path

    return screened_path(PackedProblem(packed, response), options)
