"""Places of rows within keys, without one task that holds a whole key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallytree.session import settled


def ranked(df: DataFrame, keys: list[str], order: list[str], store: Callable[[DataFrame, str], DataFrame] = settled) -> DataFrame:
    """df with ``rank`` (long, from 0, by ``order`` within ``keys``, nulls first) and ``n``, the rows of the key.

    Rows are dealt out by ranges of keys and order, so a key that holds a third of all rows lies in
    many partitions; a row's rank is its place there plus the rows of its key in earlier ones.
    Equal rows get different ranks in any order. The ordered rows are written, which fixes
    the places; what is summed is a row for each key and partition that meet.
    """
    at = [F.col(f"`{c}`") for c in (*keys, *order)]
    placed = store(df.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(parts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "n")
