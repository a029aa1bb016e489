"""Columns of doubles packed into arrays, and sums of their products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many cells a table is broadcast; beyond, it is joined with salted keys.
MOST_BROADCAST = 4_000_000
SALTS = 16


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def packed(rows: DataFrame, keys: list[str], order: str, **values: Column) -> DataFrame:
    """keys and an array for each of the values, in the order of a column; one row for each key."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), *(v.alias(k) for k, v in values.items()))))
    return rows.groupBy(*keys).agg(cells.alias("_cells")).select(*keys, *(F.col(f"_cells.{k}").alias(k) for k in values))


def gram(rows: DataFrame, key: str | None, a: Column, b: Column) -> DataFrame:
    """(key, i, j, x): for each key sums over its rows of a[i] * b[j]; all arrays of a key have one length.

    Every task adds up its rows as matrices, and hands on a row for each key and i.
    """
    name = key or "_key"
    told = rows.select((F.col(key) if key else F.lit("")).alias(name), a.alias("a"), b.alias("b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for k in dict.fromkeys(keys.tolist()):
                of = batch.filter(pa.array(keys == k))
                x, y = (of.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1) for c in (1, 2))
                sums[k] = sums[k] + x.T @ y if k in sums else x.T @ y
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(m)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], names=[name, "i", "row"])

    parts = told.mapInArrow(work, f"`{name}` string, i int, row array<double>")
    cells = parts.select(name, "i", F.posexplode("row").alias("j", "x")).groupBy(name, "i", "j").agg(F.sum("x").alias("x"))
    return cells if key else cells.drop(name)


def with_few(rows: DataFrame, few: DataFrame, on: list[str], n_cells: int) -> DataFrame:
    """rows joined with a table whose keys are few, so that each stands for a large share of the rows.

    Tables of at most MOST_BROADCAST cells are broadcast. Larger ones are copied SALTS times, and the
    rows are dealt out among the copies.
    """
    if n_cells <= MOST_BROADCAST:
        return rows.join(F.broadcast(few), on)
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("unique_id"), F.lit(SALTS)).cast("int")).join(copies, [*on, "_salt"]).drop("_salt")
