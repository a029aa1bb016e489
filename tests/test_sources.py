"""Frames from memory and files, saved hierarchies, numbering, and the timer."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallytree.hierarchy import from_tags, numbered
from tallytree.plans.plots import HierarchicalPlot
from tallytree.plans.reconciliation import CodeTimer
from tallytree.session import dropped, observed, scratch, settled, shared_folder
from tallytree.sources import frames

COLUMNS = {"unique_id": ["a", "b", "é,\"x\""], "y": [1.5, -2.25, 0.1]}


def test_frames_from_memory(spark):
    want = sorted(zip(*COLUMNS.values(), strict=True))
    for data in (COLUMNS, pd.DataFrame(COLUMNS), pa.table(COLUMNS)):
        assert sorted(map(tuple, frames.from_memory(spark, data).collect())) == want
    assert frames.from_memory(spark, {"k": [1]}, "k short").dtypes == [("k", "smallint")]


def test_files(spark, tmp_path):
    df = frames.from_memory(spark, COLUMNS)
    frames.write_csv(df, f"file://{tmp_path}/csv")
    assert sorted(frames.read_csv(spark, f"file://{tmp_path}/csv", df.schema).collect()) == sorted(df.collect())
    frames.write_parquet(df, f"file://{tmp_path}/parts", ["unique_id"])
    back = frames.read_parquet(spark, f"file://{tmp_path}/parts")
    assert sorted(map(tuple, back.select("unique_id", "y").collect())) == sorted(map(tuple, df.collect()))


def hierarchy(spark):
    wide = spark.createDataFrame([("t", 1, 1, 1), ("g", 1, 1, 0), ("h", 0, 0, 1), ("x", 1, 0, 0), ("y", 0, 1, 0), ("z", 0, 0, 1)], "unique_id string, x int, y int, z int")
    return from_tags(spark, wide, {"all": ["t"], "group": ["g", "h"], "one": ["x", "y", "z"]})


def test_saved_hierarchies(spark, tmp_path):
    h = hierarchy(spark)
    frames.save_hierarchy(h, f"file://{tmp_path}/h")
    again = frames.load_hierarchy(spark, f"file://{tmp_path}/h")
    assert again.levels == h.levels and again.tags() == h.tags() and (again.to_numpy() == h.to_numpy()).all()
    assert again.is_strict and again.top() == "t" and again.chain is again
    assert {r.unique_id: r.place for r in again.places.collect()} == {"t": 0, "g": 1, "h": 2, "x": 3, "y": 4, "z": 5}
    cells = {(r.row, r.column) for r in HierarchicalPlot(again).summing_matrix().collect()}
    assert cells == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 3), (4, 1), (5, 2), (6, 3)}


def test_levels_are_numbered_by_id(spark):
    ids = [f"n{k:05d}" for k in range(500)]
    nodes = spark.createDataFrame([(i, 1) for i in reversed(ids)] + [("t", 0)], "unique_id string, level_ord int").repartition(7)
    got = {r.unique_id: r.pos for r in numbered(nodes).collect()}
    assert got == {"t": 1, **{i: k + 1 for k, i in enumerate(ids)}}


def test_written_tables(spark):
    df = spark.range(10).withColumn("x", F.col("id") % 3)
    table, told = observed(df, "numbers", n=F.count_if(F.col("x") == 0), most=F.max("id"))
    assert told == {"n": 4, "most": 9} and table.count() == 10
    kept = settled(df, "more")
    dropped(table)
    assert kept.count() == 10 and shared_folder(spark).startswith("file://")
    with pytest.raises(Exception, match="(?i)not|exist|failed"):
        table.count()


def test_scratch_tables_go_with_their_block(spark):
    before = shared_folder(spark)
    with scratch(spark) as folder:
        assert shared_folder(spark) == folder and folder.startswith(before)
        table = settled(spark.range(5), "five")
        with scratch(spark) as inner:
            assert settled(spark.range(3), "three").count() == 3 and inner.startswith(folder)
        assert shared_folder(spark) == folder and table.count() == 5
    assert shared_folder(spark) == before
    with pytest.raises(Exception, match="(?i)not|exist|failed"):
        table.count()


def test_the_timer_tells(capsys):
    with CodeTimer("block") as t:
        pass
    assert t.took >= 0 and "block" in capsys.readouterr().out
    with CodeTimer(verbose=False):
        pass
    assert capsys.readouterr().out == ""
