"""What the corpus operators share: reading, words, and tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallytree.session import dropped, shared_folder

#: Words are maximal runs without these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Cells of the tables that are looked up by hash; their size does not depend on the input.
CELLS = 1 << 20
#: Spark's setting that removes an execution's shuffle files when it ends.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def line_words(line: Column) -> Column:
    """Words of a line; the common case, single spaces between words, needs no regular expression."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ") | (line == "")
    for c in "\t\n\v\f\r":
        odd = odd | line.contains(c)
    return F.when(odd, F.array_remove(F.split(line, SPACE), "")).otherwise(F.split(line, " "))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one struct _all, so that no name of theirs clashes."""
    rest = [c for c in docs.columns if c not in used]
    packed = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None).cast("string")
    return docs.select(*used, packed.alias("_all"))


def put_back(df: DataFrame, columns: list[str], used: tuple[str, ...]) -> DataFrame:
    """The columns that set_aside was given, in their order."""
    return df.select(*(F.col(c) if c in used else F.col("_all").getField(c).alias(c) for c in columns))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts its lineage.

    Nothing needs the shuffle files of the write after it, so they go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)
    return spark.read.schema(df.schema).parquet(path)


def cell(h: Column) -> Column:
    return F.pmod(h, F.lit(CELLS)).cast("int")


def table(cells: DataFrame) -> Column:
    """A scalar: one byte for each of CELLS cells, from rows (cell, level); 0 where there is none."""
    every = cells.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    dense = every.join(cells, "cell", "left").select("cell", F.char(F.coalesce("level", F.lit(0))).alias("c"))
    # In blocks of 1024 cells first; the one row at the end has the same size for any input.
    block = dense.groupBy(F.shiftright("cell", 10).alias("block")).agg(F.array_sort(F.collect_list(F.struct("cell", "c"))).alias("all"))
    block = block.select("block", F.array_join(F.transform("all", lambda x: x["c"]), "").alias("text"))
    joined = block.agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("all"))
    return joined.select(F.array_join(F.transform("all", lambda x: x["text"]), "").cast("binary").alias("bytes")).scalar()


def looked_up(bytes_: Column, h: Column) -> Column:
    """The byte of a hash's cell."""
    return F.coalesce(F.ascii(F.substr(bytes_, cell(h) + 1, F.lit(1)).cast("string")), F.lit(0))


def level_table(cells: DataFrame) -> Column:
    """A scalar: an array of one byte for each of CELLS cells, from rows (cell, level) of different cells; 0 where there is none."""
    every = cells.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell"), F.lit(0).cast("tinyint").alias("level"))
    rows = every.union(cells.select("cell", F.col("level").cast("tinyint")))
    # In blocks of 1024 cells first; the one row at the end has the same size for any input.
    block = rows.groupBy("cell").agg(F.max("level").alias("level")).groupBy(F.shiftright("cell", 10).alias("block"))
    block = block.agg(F.sort_array(F.collect_list(F.struct("cell", "level"))).alias("all")).select("block", F.col("all.level").alias("levels"))
    joined = block.agg(F.sort_array(F.collect_list(F.struct("block", "levels"))).alias("all"))
    return joined.select(F.flatten("all.levels").alias("levels")).scalar()


def level_of(levels: Column, h: Column) -> Column:
    """The byte of a hash's cell."""
    return F.get(levels, cell(h))


#: Bit tables: BLOCKS binaries of 32768 bits each.
BLOCKS = 256


def _bit(h: Column) -> tuple[Column, Column]:
    return F.pmod(h, F.lit(BLOCKS)).cast("int"), F.pmod(F.shiftright(h, 8), F.lit(32768))


def bit_table(hashes: DataFrame) -> Column:
    """A scalar: bits of fixed number that are set for all hashes (a column h), and by chance for others."""
    block, bit = _bit(F.col("h"))
    every = hashes.sparkSession.range(BLOCKS).select(F.col("id").cast("int").alias("block"), F.lit(None).cast("long").alias("bit"))
    blocks = hashes.select(block.alias("block"), bit.alias("bit")).union(every).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return blocks.agg(F.sort_array(F.collect_list(F.struct("block", "bits"))).alias("all")).select(F.col("all.bits").alias("bits")).scalar()


def may_hold(bits: Column, h: Column) -> Column:
    block, bit = _bit(h)
    byte = F.conv(F.hex(F.substr(F.get(bits, block), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")) % 2 == 1
