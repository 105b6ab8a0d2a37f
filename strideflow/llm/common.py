"""Helpers shared by the corpus operators: tables, shared staging, distributed ranks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged as staged


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 4096) -> None:
    """Texts reach Python in batches of fewer rows than Spark's default, unless the session has set a number itself: a worker holds a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give memory that is free, but held by this process, back to the system; where the C library cannot, only Arrow's."""
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return
    trim(0)


def lean(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``f`` for mapInPandas; at the end of a task its worker, which stays for later tasks and stages, keeps no more than it holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def group_rows(total: int, spark: SparkSession, most: int = 50_000) -> int:
    """Rows that one window group should hold: an eighth of an even partition, within bounds."""
    return max(64, min(most, total // (8 * partitions(spark)) + 1))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unit_hash(*cols: Column | str) -> Column:
    """A double in [0, 1) that depends on the given values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def within_rank(df: DataFrame, key: str, salt: Column, order: list[Column], out: str, rows: int) -> DataFrame:
    """Add ``out``: the gapless rank from 0 of each row within its ``key``.

    A key may hold any share of the rows, so the rank is made in two levels. ``salt``, a
    double in [0, 1), deals the rows of a key to as many pieces as its count needs
    (``rows`` a piece); ranks come from a window over one piece, and a piece's first rank
    from the counts of the pieces before it, again in two levels.
    """
    spark = df.sparkSession
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    pieces = sizes.select(F.col(key).alias("__key"), F.ceil(F.col("__n") / F.lit(rows)).cast("long").alias("__pieces"))
    dealt = (
        df.join(pieces, df[key].eqNullSafe(F.col("__key")), "left")
        .withColumn("__piece", F.floor(salt * F.col("__pieces")).cast("long"))
        .drop("__key", "__pieces")
    )
    counts = dealt.groupBy(key, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    block = F.floor(F.col("__piece") / F.lit(4096))
    blocks = counts.groupBy(key, block.alias("__block")).agg(F.sum("__n").alias("__n"))
    before_block = blocks.select(
        F.col(key).alias("__bkey"), F.col("__block").alias("__bblock"),
        F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first_block"),
    )
    in_block = Window.partitionBy(key, "__block").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("__block", block).withColumn("__before", F.coalesce(F.sum("__n").over(in_block), F.lit(0)))
    first = first.join(before_block, first[key].eqNullSafe(F.col("__bkey")) & (F.col("__block") == F.col("__bblock"))).select(
        F.col(key).alias("__fkey"), F.col("__piece").alias("__fpiece"), (F.col("__before") + F.col("__first_block")).alias("__first"),
    )
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy(key, "__piece").orderBy(*order)) - 1)
    return (
        ranked.join(first, ranked[key].eqNullSafe(F.col("__fkey")) & (F.col("__piece") == F.col("__fpiece")))
        .withColumn(out, (F.col("__rank") + F.col("__first")).cast("long"))
        .drop("__rank", "__first", "__fkey", "__fpiece", "__piece")
    )
