"""Helpers shared by the text operators: column selection, Arrow batches, bounded tables of workers."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.sources.storage import Stored, shared_dir  # noqa: F401

#: A word: a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes of text that a Python worker handles at once (one longer text makes a slice of its own).
SLICE_BYTES = 2_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` is a nested lambda."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names: extra columns of any name can't clash later."""
    return df.select(*(df[source].alias(name) for name, source in columns.items()))


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with null texts as empty texts."""
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch cut so that no slice holds more than about ``most`` bytes of its column ``text``."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _fields(outputs: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs])


def _arrow(fields: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def map_texts(df: DataFrame, outputs: list[tuple[str, str]], work: Callable[[], Callable[[list[str]], list]], id_col: str, text_col: str) -> DataFrame:
    """One row (id, *outputs) per row of ``df``. ``work()`` is called once per task and returns a function from
    a list of texts to one list or array per output. Runs as one Arrow-batched map without a shuffle."""
    base, fields = texts_of(df, id_col, text_col), _fields(outputs)
    schema = T.StructType([T.StructField(id_col, base.schema["id"].dataType), *fields])
    arrow = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part in slices(batch):
                columns = each(part.column("text").to_pylist())
                made = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *made], [id_col, *arrow.names])

    return base.mapInArrow(run, schema)


def positions(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 ... by position, so that no name of theirs can clash or needs quoting."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def hashable(cell: Column, kind: T.DataType) -> Column:
    """The cell as something that hashes: maps as entries in order of their keys, at any depth; variants as JSON."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(hashable(e["key"], kind.keyType).alias("key"), hashable(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(cell), entry))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.AtomicType):
        return F.transform(cell, lambda x: hashable(x, kind.elementType))
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(cell.isNotNull(), F.struct(*(hashable(cell.getField(f.name), f.dataType).alias(f"f{k}") for k, f in enumerate(kind.fields))))
    return F.to_json(cell) if isinstance(kind, T.VariantType) else cell


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns of a row, nulls told from all values: what a row is known by."""
    cells = [df[f"`{c.replace('`', '``')}`"] for c in df.columns]
    values = [*(hashable(c, f.dataType) for c, f in zip(cells, df.schema, strict=True)), *(c.isNull() for c in cells)]
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def named(df: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns c0, c1 ... of ``df`` under ``names`` again, those in ``instead`` computed anew."""
    return df.select(*(instead.get(f"c{k}", F.col(f"c{k}")).alias(n) for k, n in enumerate(names)))


def map_rows(df: DataFrame, text_col: str, outputs: list[tuple[str, str]], work: Callable[[], Callable[[list[str]], list]], text: bool = True) -> DataFrame:
    """All rows of ``df``, columns as ``positions`` names them, with ``outputs`` of their texts (null: empty); see
    ``map_texts``. Each text goes to the worker once, and comes back only with ``text``."""
    base, at = positions(df), df.columns.index(text_col)
    base = base.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    kept = [f.name for k, f in enumerate(base.schema) if text or k != at]
    fields = _fields(outputs)
    schema, arrow = T.StructType([*(base.schema[c] for c in kept), *fields]), _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part in slices(batch, text=f"c{at}"):
                columns = each([t or "" for t in part.column(f"c{at}").to_pylist()])
                made = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], [*kept, *arrow.names])

    return base.mapInArrow(run, schema)


class Remembered(dict):
    """What a worker keeps about strings: at most about ``most`` bytes, in two generations. When the young one holds
    half of them it becomes the old one, whose entries come back as they are asked for ``again``; the rest goes. Nothing
    is kept about strings of over ``LONG`` characters (unspaced scripts, encoded files), which hardly recur."""

    LONG, ENTRY = 256, 150

    def __init__(self, most: int):
        super().__init__()
        self.most, self.used, self.old = most, 0, {}

    def again(self, key: str):
        """The old generation's value, young from now on, or None."""
        found = self.old.get(key)
        return None if found is None else self.keep(key, found, self.size_of(found))

    def size_of(self, value) -> int:
        """Bytes of a value besides its entry."""
        return 0

    def keep(self, key: str, value, size: int = 0):
        """``value``, remembered as ``size`` bytes besides the key and the entry itself."""
        if len(key) <= self.LONG:
            cost = self.ENTRY + sys.getsizeof(key) + size
            if self.used + cost > self.most // 2:
                self.old = dict(self)
                self.clear()
                self.used = 0
            self.used += cost
            self[key] = value
        return value
