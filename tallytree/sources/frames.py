"""Frames from and to files and memory, and hierarchies kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallytree.hierarchy import NODES, Hierarchy


def from_memory(spark: SparkSession, data: object, schema: StructType | str | None = None) -> DataFrame:
    """A DataFrame from a pandas frame, an Arrow table, or a dict of columns."""
    if isinstance(data, dict):
        import pandas as pd

        data = pd.DataFrame(data)
    return spark.createDataFrame(data, schema=schema) if schema else spark.createDataFrame(data)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    return spark.read.schema(schema).options(header="true", **options).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def save_hierarchy(h: Hierarchy, path: str) -> None:
    """Nodes and summing rows as Parquet below a folder."""
    h.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    h.summing.write.mode("overwrite").parquet(f"{path}/summing")


def load_hierarchy(spark: SparkSession, path: str) -> Hierarchy:
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
    levels = tuple(r[0] for r in nodes.select("level", "level_ord").distinct().orderBy("level_ord").collect())
    return Hierarchy(nodes, spark.read.schema("unique_id string, bottom_id string, weight double").parquet(f"{path}/summing"), levels)
