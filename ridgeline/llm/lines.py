"""Line dedup over levelled sorted runs of line hashes.

Each batch of documents becomes a sorted run: its line hashes and in how many of its documents each is. Runs are bucketed
and sorted by hash, so they are merged without a shuffle. A new batch is merge-anti-joined with the runs of hashes that
already are in enough documents, which need no more counting, and adds what is left as a run of its own. As many runs
of a level as its fan are compacted to one of the next; the hashes that reach the limit by then move to the settled runs."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import Stored, slices

#: Different hashes that a task counts before it passes the counts on.
COUNTED = 200_000
#: A hash with more than this share of a batch's (document, line) pairs is heavy. Shares add up to 1, so a batch has
#: fewer than 2,000 such hashes: they travel with the tasks, and no other one can make a join's partition stand out.
HEAVY = 1 / 2000


def keys_of(text: bytes) -> list[bytes]:
    """A key per line: A-Z lower-cased (bytes know no other letters), ``[\\x20\\x09-\\x0D]`` stripped at both ends."""
    return [line.strip() for line in text.lower().split(b"\n")]


def hashed(keys: list[bytes], least: int) -> list[bytes | None]:
    """128-bit hashes of keys; None for those of fewer than ``least`` code points, which never are repeated lines."""
    digest = xxhash.xxh3_128_digest
    if least <= 1:
        return [digest(k) if len(k) >= least else None for k in keys]
    return [digest(k) if len(k) >= least and len(k.decode(errors="replace")) >= least else None for k in keys]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, row): null texts as empty ones; ``row`` spreads rows and finds them again. Rows that share one by chance
    only learn of each other's repeated lines, so nothing rests on it."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("id"), text.cast("binary").alias("text"), F.xxhash64(docs[id_col].cast("string"), text).alias("row"))


class LineIndex:
    """In how many documents each line is, as levelled sorted runs in the shared folder.

    ``buckets`` is the number of parts that each run's hashes are dealt to (the session's shuffle partitions), ``fan``
    the number of runs of a level that are compacted."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fan: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.min_chars, self.fan = spark, min_docs, min_chars, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.store = Stored(spark, "lines")
        self.levels: list[list[DataFrame]] = []  # runs (key, n) of hashes that aren't settled, youngest level first
        self.settled: list[DataFrame] = []  # runs (key) of hashes in at least ``min_docs`` documents
        self.heavy: set[bytes] = set()
        self.names: list[str] = []
        self.paths: list[str] = []
        self._repeated: DataFrame | None = None

    def _run(self, df: DataFrame, *parts: str) -> DataFrame:
        """``df`` as a stored run, bucketed and sorted by key. Plans look a partitioned table up in the catalog, so it stays
        there until ``close``; others are opened once and leave it."""
        name, path = f"ridgeline_run_{uuid.uuid4().hex}", self.store.new()
        df.write.partitionBy(*parts).bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name, format="parquet")
        run = self.spark.table(name)
        self.paths.append(path)
        if parts:
            self.names.append(name)
        else:
            self.spark.sql(f"DROP TABLE {name}")
        return run

    def close(self) -> None:
        """Ends the index: deletes all runs but that of ``repeated``, which tables of ``strip`` go on to read."""
        self.repeated()
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths[:-1]:
            self.store.drop(path)
        self.names, self.paths, self.levels, self.settled = [], self.paths[-1:], [], []

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs as one (key, n). Two are merged in the order that they have; each further one costs a shuffle."""
        both = lambda a, b: a.join(b.select("key", F.col("n").alias("m")), "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return reduce(both, (r.select("key", "n") for r in runs))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> None:
        """Enters documents, each row one of its own, in one pass over their texts. ``batches``: how many runs they come
        as; rows are dealt to them by hash."""
        base = _texts(docs, id_col, text_col).select("text", F.pmod("row", F.lit(batches)).cast("int").alias("batch"))
        least = self.min_chars

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = [Counter() for _ in range(batches)]

            def flush() -> Iterator[pa.RecordBatch]:
                for b, own in enumerate(counts):
                    if own:
                        cells = [pa.array([b] * len(own), pa.int32()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())]
                        yield pa.RecordBatch.from_arrays(cells, ["batch", "key", "n"])
                        own.clear()

            for batch in parts:
                for part in slices(batch):
                    for text, b in zip(part.column("text").to_pylist(), part.column("batch").to_pylist(), strict=True):
                        counts[b].update({h for h in hashed(keys_of(text), least) if h})
                    if sum(map(len, counts)) > COUNTED:
                        yield from flush()
            yield from flush()

        found = base.mapInArrow(run, "batch int, key binary, n long").repartition(self.buckets, "key").groupBy("batch", "key").agg(F.sum("n").alias("n"))
        runs = self._run(found, "batch")
        for b in range(batches):
            self._enter(runs.where(F.col("batch") == b).select("key", "n"))

    def _enter(self, own: DataFrame) -> None:
        total = own.agg(F.sum("n")).first()[0]
        if not total:
            return
        self._repeated = None
        self.heavy |= {bytes(r["key"]) for r in own.where(F.col("n") > total * HEAVY).select("key").collect()}
        if self.settled:
            for known in self.settled:
                own = own.join(known, "key", "left_anti")
            own = self._run(own)
        self.levels = self.levels or [[]]
        self.levels[0].append(own)
        level = 0
        while len(self.levels[level]) >= self.fan:
            merged = self._run(self._merged(self.levels[level]).withColumn("done", F.col("n") >= self.min_docs), "done")
            self.settled.append(merged.where("done").select("key"))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged.where("NOT done").select("key", "n"))
        if len(self.settled) > self.fan:
            self.settled = [self._run(self._keys(self.settled))]

    def _keys(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.join(b, "key", "full"), runs)

    def repeated(self) -> DataFrame:
        """(key) of all lines in at least ``min_docs`` documents so far, as a run. Counts that older runs hold of settled
        hashes don't matter, nor do those that new batches left out."""
        if self._repeated is None:
            runs = [r for level in self.levels for r in level]
            found = [*self.settled, *([self._merged(runs).where(F.col("n") >= self.min_docs).select("key")] if runs else [])]
            self._repeated = self._run(self._keys(found) if found else self.spark.createDataFrame([], "key binary"))
        return self._repeated

    def strip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_lines, n_dropped, kept): every text without its repeated lines, the others joined by line feeds.

        Heavy hashes are known to every task. Of the others, a row's hashes are joined with the repeated ones, and those
        found travel back to the row, in place of a table of repeated lines that every task would have to hold."""
        repeated, least = self.repeated(), self.min_chars
        candidates = self.spark.createDataFrame([(h,) for h in self.heavy], "key binary")
        heavy = frozenset(bytes(r["key"]) for r in repeated.join(F.broadcast(candidates), "key", "left_semi").collect())
        base = _texts(docs, id_col, text_col)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    rows, keys = [], []
                    for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                        own = {h for h in hashed(keys_of(text), least) if h} - heavy
                        rows += [row] * len(own)
                        keys += own
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary())], ["row", "key"])

        pairs = base.select("row", "text").mapInArrow(emit, "row long, key binary")
        hits = pairs.join(repeated, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("keys"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    n_lines, n_dropped, kept = [], [], []
                    for text, keys in zip(part.column("text").to_pylist(), part.column("keys").to_pylist(), strict=True):
                        own, lines = heavy.union(keys) if keys else heavy, text.split(b"\n")
                        stay = [line for line, h in zip(lines, hashed(keys_of(text), least), strict=True) if h not in own] if own else lines
                        n_lines.append(len(lines))
                        n_dropped.append(len(lines) - len(stay))
                        kept.append(b"\n".join(stay))
                    made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())]
                    yield pa.RecordBatch.from_arrays([part.column("id"), *made], ["id", "n_lines", "n_dropped", "kept"])

        joined = base.join(hits.hint("shuffle_hash"), "row", "left").select("id", "text", "keys")
        found = joined.mapInArrow(cut, f"id {base.schema['id'].dataType.simpleString()}, n_lines long, n_dropped long, kept binary")
        return found.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))


def without_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row, without the lines whose key is in at least ``min_docs`` rows.

    A null or empty text is one empty line, whose key is too short to be a repeated one. A line counts once per row
    however often the row has it; repeated rows are rows of their own, null and repeated ids too. An empty table gives
    an empty table; other columns of any name are left alone."""
    index = LineIndex(docs.sparkSession, min_docs, min_chars)
    index.add(docs, id_col, text_col, batches)
    found = index.strip(docs, id_col, text_col)
    index.close()
    return found
