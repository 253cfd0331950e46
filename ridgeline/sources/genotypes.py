"""Genotype tables: long calls in Parquet with column statistics, and their matrix views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.features import Feature, FeatureFrame

MISSING = -9


def column_stats(calls: DataFrame, rows: int | None = None) -> DataFrame:
    """(snp, nnm, nnz, impute): non-missing calls, calls that aren't 0 (missing ones included) and the mean of the
    non-missing. ``calls(row_id, snp, call)``; a null or negative call is missing. With ``rows``, the number of rows of
    the matrix, rows that a variant has no call for count as 0; without it the calls must be complete."""
    known = F.col("call").isNotNull() & (F.col("call") >= 0)
    nnm = F.count_if(known) if rows is None else F.lit(rows) - F.count_if(~known)
    return calls.groupBy("snp").agg(
        nnm.alias("nnm"),
        F.count_if(~known | (F.col("call") != 0)).alias("nnz"),
        (F.sum(F.when(known, F.col("call")).otherwise(0)) / F.greatest(nnm, F.lit(1))).alias("impute"),
    )


def write_unphased(calls: DataFrame, path: str, impute_method: str | DataFrame = "mean") -> dict[str, float]:
    """Writes calls (non-zero and missing ones) and statistics; a call over 2 raises. ``impute_method`` is "mean" or
    a table (snp, impute) with a value for every variant of the calls; others raise. Returns seconds by step."""
    import time

    if not calls.where("call > 2").isEmpty():
        raise ValueError("calls must be at most 2")
    t0 = time.time()
    stats = column_stats(calls, calls.select("row_id").distinct().count())
    if not isinstance(impute_method, str):
        given = impute_method.select("snp", F.col("impute").cast("double").alias("impute"))
        if not given.groupBy("snp").count().where("count > 1").isEmpty():
            raise ValueError("the impute table names a variant more than once")
        stats = stats.drop("impute").join(given, "snp", "left")
        lost = stats.where(F.col("impute").isNull()).count()
        if lost:
            raise ValueError(f"the impute table lacks a value for {lost} variants")
    elif impute_method != "mean":
        raise ValueError(f"unknown impute method {impute_method!r}")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    t1 = time.time()
    coded = calls.select("row_id", "snp", F.when(F.col("call") >= 0, F.col("call")).cast("byte").alias("call"))
    coded.where("call is null or call <> 0").sortWithinPartitions("snp", "row_id").write.mode("overwrite").parquet(f"{path}/calls")
    calls.select("row_id").distinct().write.mode("overwrite").parquet(f"{path}/rows")
    return {"stats": t1 - t0, "calls": time.time() - t1}


class Unphased:
    """A written table of unphased calls."""

    def __init__(self, spark: SparkSession, path: str):
        self.calls, self.stats, self.rows = (spark.read.parquet(f"{path}/{x}") for x in ("calls", "stats", "rows"))

    def snps(self) -> list[int]:
        return [r[0] for r in self.stats.select("snp").orderBy("snp").collect()]

    def to_dense(self) -> DataFrame:
        """(row_id, snp_<k> ...): one column per variant, missing as -9, absent as 0. A row's calls meet as one map,
        which its columns look up, so plans don't grow by an aggregate a variant."""
        snps = self.snps()
        of_row = F.map_from_entries(F.collect_set(F.struct("snp", F.coalesce("call", F.lit(MISSING)).alias("call"))))
        wide = self.calls.groupBy("row_id").agg(of_row.alias("m")).select("row_id", *(F.col("m")[s].alias(f"snp_{s}") for s in snps))
        return self.rows.join(wide, "row_id", "left").select("row_id", *(F.coalesce(f"snp_{s}", F.lit(0)).cast("byte").alias(f"snp_{s}") for s in snps))

    def frame(self) -> FeatureFrame:
        """Matrix view: missing calls take their variant's impute value; means and variances report 0 and 1."""
        impute = {r["snp"]: float(r["impute"]) for r in self.stats.collect()}
        return FeatureFrame(self.to_dense(), tuple(Feature(f"snp_{s}", F.when(F.col(f"snp_{s}") < 0, impute[s]).otherwise(F.col(f"snp_{s}").cast("double")), True) for s in self.snps()))


def unphased_long(calls: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(row_id, snp, value): imputed values of a long table; statistics (one row per variant) are joined."""
    stats = column_stats(calls) if stats is None else stats
    value = F.when(F.col("call").isNull() | (F.col("call") < 0), F.col("impute")).otherwise(F.col("call").cast("double"))
    return calls.join(stats.select("snp", "impute"), "snp").select("row_id", "snp", value.alias("value"))


def phased_ancestry(calls: DataFrame, ancestries: int) -> DataFrame:
    """(row_id, col_id, value): sum over both haplotypes of call where the ancestry is a, at column snp * A + a.
    ``calls(row_id, snp, hap, call, ancestry)``."""
    return calls.where("call <> 0").groupBy("row_id", (F.col("snp") * ancestries + F.col("ancestry")).alias("col_id")).agg(F.sum("call").cast("double").alias("value"))


def write_phased_ancestry(calls: DataFrame, path: str, ancestries: int) -> None:
    """Checks calls (0, 1, none missing) and ancestries (0 ... A-1) and writes the non-zero calls with counts."""
    if not calls.where(f"call is null or call not in (0, 1) or ancestry is null or ancestry < 0 or ancestry >= {int(ancestries)}").isEmpty():
        raise ValueError("calls must be 0 or 1 and ancestries lie in [0, A)")
    calls.where("call <> 0").sortWithinPartitions("snp", "row_id").write.mode("overwrite").parquet(f"{path}/calls")
    calls.groupBy("snp", "ancestry").agg(F.count_if((F.col("hap") == 0) & (F.col("call") != 0)).alias("nnz0"), F.count_if((F.col("hap") == 1) & (F.col("call") != 0)).alias("nnz1")).write.mode("overwrite").parquet(f"{path}/stats")
    calls.select("row_id").distinct().write.mode("overwrite").parquet(f"{path}/rows")


def read_phased_ancestry(spark: SparkSession, path: str, ancestries: int) -> DataFrame:
    return phased_ancestry(spark.read.parquet(f"{path}/calls"), ancestries)


def phased_frame(spark: SparkSession, path: str, snps: int, ancestries: int) -> FeatureFrame:
    """Dense matrix view with A columns per variant; rows without any call are zeros."""
    long = read_phased_ancestry(spark, path, ancestries)
    p = snps * ancestries
    wide = long.groupBy("row_id").agg(*(F.sum(F.when(F.col("col_id") == j, F.col("value")).otherwise(0.0)).alias(f"x_{j}") for j in range(p)))
    rows = spark.read.parquet(f"{path}/rows").join(wide, "row_id", "left")
    return FeatureFrame(rows, tuple(Feature(f"x_{j}", F.coalesce(f"x_{j}", F.lit(0.0)), True) for j in range(p)))


def read_bed(spark: SparkSession, path: str, samples: int, variants: int, block: int = 256) -> DataFrame:
    """(row_id, snp, call) of a binary genotype table, two bits a call, variant by variant: copies of the first allele
    of the variant list, null where missing. Tasks read ``block`` variants each, by their place in the file; ``path``
    must be readable on each executor."""
    width = -(-samples // 4)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for batch in batches:
            for first in batch.column("id").to_pylist():
                with system.open_input_file(at) as f:
                    if f.read_at(3, 0) != b"\x6c\x1b\x01":
                        raise ValueError(f"{path} holds no genotypes by variant")
                    n = min(block, variants - first)
                    raw = np.frombuffer(f.read_at(n * width, 3 + first * width), np.uint8).reshape(n, width)
                codes = (raw[:, :, None] >> np.array([0, 2, 4, 6]) & 3).reshape(n, -1)[:, :samples]
                calls = np.array([2, -1, 1, 0], np.int8)[codes]  # fixed values: 00 two copies, 01 missing, 10 one, 11 none
                for k in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), pa.array(np.full(samples, first + k, np.int32)), pa.array(calls[k], mask=calls[k] < 0)], ["row_id", "snp", "call"])

    return spark.range(0, variants, block, max(1, min(-(-variants // block), 10_000))).mapInArrow(run, "row_id long, snp int, call byte")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated variant list: chrom, name, position in morgans and bases, both alleles."""
    return spark.read.csv(path, sep="\t", schema="chrom string, snp string, cm double, bp long, a1 string, a2 string")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated sample list: family, person, parents, sex, phenotype."""
    return spark.read.csv(path, sep=" ", schema="family string, person string, father string, mother string, sex int, phenotype string")
