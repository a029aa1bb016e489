"""Session settings that the plans assume."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Where tables go instead of the cluster's folder: inside ``scratch``, or where no folder is named.
FOLDER = "spark.tallytree.folder"


def local_session(cores: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    conf = {**SETTINGS, "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **more}
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where Spark runs in this process."""
    folder = spark.conf.get(FOLDER, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        folder = f"file://{tempfile.mkdtemp(prefix='tallytree-')}"
        spark.conf.set(FOLDER, folder)
    return folder.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder below the shared one for all tables that plans write inside the block; it is deleted with them at its end.

    Results must be written elsewhere or collected before that. Blocks may be nested.
    """
    before = spark.conf.get(FOLDER, None)
    inner = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    spark.conf.set(FOLDER, inner)
    try:
        yield inner
    finally:
        spark.conf.unset(FOLDER) if before is None else spark.conf.set(FOLDER, before)
        _deleted(spark, inner)


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that driver and executors share and read again: a short plan that survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, object]]:
    """``settled``, and sums or extremes of all rows that the write itself has gathered."""
    told = Observation()
    table = settled(df.observe(told, *(m.alias(k) for k, m in metrics.items())), name)
    return table, told.get


def dropped(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _deleted(df.sparkSession, file.rsplit("/", 1)[0])
