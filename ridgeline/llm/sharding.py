"""Contiguous balanced shards: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Stored

#: Bytes that each document costs besides its text.
OVERHEAD = 16


def shard_of(middle: np.ndarray, total: int, shards: int) -> np.ndarray:
    """Shard on whose part of a line of ``total``, cut into ``shards`` equal parts, each middle lies."""
    width, rest = divmod(total, shards)  # the first `rest` parts are one longer, in whole numbers at any size
    long = rest * (width + 1)
    return np.where(middle < long, middle // (width + 1), rest + (middle - long) // max(width, 1)).clip(max=shards - 1)


def byte_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, shards contiguous in order of id.

    size is the text's UTF-8 bytes plus 16 (null texts: 16, crc32 of nothing: 0); a row goes where its middle byte falls, so a
    shard's bytes differ from an equal share by half a row at either end at most. slot numbers the rows of a shard from 0 without gaps. Ties and repeated rows
    are ordered by crc32, size and input position, null ids come first, and each row is placed on its own. Fewer
    rows than shards leave shards empty; an empty table gives an empty table. ``law`` is ``bytes``; grown_shard
    belongs to another law and is null.

    Texts don't move: only (id, size, crc32, position) is range-partitioned, written once to the shared folder
    and sorted within partitions. Per-partition totals (two numbers each) and rows per partition and shard are all
    that reaches the driver; the last pass adds each partition's offsets to local sums."""
    session = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(docs[id_col].alias("id"), (F.length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"), F.monotonically_increasing_id().alias("at"))
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "id", "crc", "size", "at").withColumn("part", F.spark_partition_id())
    # The partition number is stored with the rows, so a lost executor can't move range bounds between passes.
    stored, _ = Stored(session, "shards").put(ordered)
    totals = {r["part"]: (r["bytes"], r["n"]) for r in stored.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    start, at = {}, 0
    for part in sorted(totals):
        start[part], at = at, at + totals[part][0]
    total = at
    by_part = stored.repartition(parts, "part").sortWithinPartitions("part", "id", "crc", "size", "at")

    def placed(batches: Iterator[pa.RecordBatch], slots: dict[tuple[int, int], int] | None) -> Iterator[pa.RecordBatch]:
        now, before, seen = None, 0, {}
        for batch in batches:
            part, size = batch.column("part").to_numpy(), batch.column("size").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if part[lo] != now:
                    now, before, seen = int(part[lo]), start[int(part[lo])], {}
                sums = before + np.concatenate([[0], np.cumsum(size[lo:hi])])
                shard, before = shard_of(sums[:-1] + sums[1:], 2 * total, shards), int(sums[-1])
                firsts = np.flatnonzero(np.diff(shard, prepend=-1))
                slot = np.empty(hi - lo, np.int64)
                for a, b in zip(firsts, [*firsts[1:], hi - lo], strict=True):
                    s = int(shard[a])
                    first = seen.get(s, slots.get((now, s), 0) if slots else 0)
                    slot[a:b] = first + np.arange(b - a)
                    seen[s] = first + int(b - a)
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("part"), own.column("size"), own.column("crc"), pa.array(shard.astype(np.int32)), pa.array(slot)], ["id", "part", "size", "crc", "shard", "slot"])

    kind = stored.schema["id"].dataType.simpleString()
    schema = f"id {kind}, part int, size long, crc long, shard int, slot long"
    counted = by_part.mapInArrow(lambda b: placed(b, None), schema).groupBy("part", "shard").agg(F.count("*").alias("n")).collect()
    slots, rows = {}, {}
    for r in sorted(counted, key=lambda r: (r["part"], r["shard"])):
        slots[r["part"], r["shard"]] = rows.get(r["shard"], 0)
        rows[r["shard"]] = rows.get(r["shard"], 0) + r["n"]
    return by_part.mapInArrow(lambda b: placed(b, slots), schema).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
