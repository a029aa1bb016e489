import datetime as dt

import pytest

from tallytree.hierarchy import from_tags
from tallytree.operators import aggregate as A


@pytest.fixture(scope="module")
def simple(spark):
    rows = [("a", "1", 10, "2020-01-01"), ("a", "2", 20, "2020-02-01"), ("a", "3", 30, "2020-03-01"), ("b", "2", 40, "2020-02-01")]
    return spark.createDataFrame([("COUNTRY", *r) for r in rows], "country string, cat1 string, cat2 string, y long, ds string")


SPEC = [["country"], ["country", "cat1"], ["country", "cat1", "cat2"]]


def test_levels_sums_and_summing_rows(simple):
    panel, h = A.aggregate(simple, SPEC)
    rows = {(r.unique_id, r.ds): r.y for r in panel.collect()}
    assert len(rows) == 11
    assert [rows["COUNTRY", d] for d in ("2020-01-01", "2020-02-01", "2020-03-01")] == [10, 60, 30]
    assert dict(panel.dtypes)["y"] == "bigint"
    assert h.tags() == {"country": ["COUNTRY"], "country/cat1": ["COUNTRY/a", "COUNTRY/b"], "country/cat1/cat2": ["COUNTRY/a/1", "COUNTRY/a/2", "COUNTRY/a/3", "COUNTRY/b/2"]}
    s = h.to_numpy()
    assert s.shape == (7, 4) and s[0].sum() == 4 and (s[3:] == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]).all()
    assert h.is_strict and h.check_bottom_identity()


def test_crossed_is_not_strict(simple):
    h = A.hierarchy_of(simple, [["country"], ["country", "cat1"], ["country", "cat2"], ["country", "cat1", "cat2"]])
    assert not h.is_strict


def test_exogenous_and_errors(spark, simple):
    df = spark.createDataFrame([("a", "1", 4, 7, 10, "x"), ("a", "2", 5, 6, 20, "x"), ("c", "3", 6, 5, 30, "x")], "cat1 string, cat2 string, e1 long, e2 long, y long, ds string")
    panel, _ = A.aggregate(df, [["cat1"], ["cat1", "cat2"]], exog_vars={"e1": "mean", "e2": ["sum", "max"]})
    row = panel.where("unique_id = 'a'").first()
    assert (row.y, row.e1_mean, row.e2_sum, row.e2_max) == (30, 4.5, 13, 7)
    with pytest.raises(ValueError, match="null"):
        A.aggregate(spark.createDataFrame([("a", None, "x")], "c string, y long, ds string"), [["c"]])
    with pytest.raises(ValueError, match="last level"):
        A.aggregate(simple, [["country", "cat1"], ["country"]])
    with pytest.raises(ValueError, match="not in the frame"):
        A.aggregate(simple, [["nowhere"]])
    with pytest.raises(ValueError, match="exogenous"):
        A.aggregate(simple, SPEC, exog_vars={"zz": "mean"})
    with pytest.raises(ValueError, match="Unknown aggregate"):
        A.aggregate(simple, SPEC, exog_vars={"y": "no"})


def test_slashes_in_values(spark):
    df = spark.createDataFrame([("x/y", "1", 1, "t"), ("x", "y/1", 2, "t")], "a string, b string, y long, ds string")
    _, h = A.aggregate(df, [["a"], ["a", "b"]])
    parents = {(r.unique_id, r.bottom_id) for r in h.summing.collect()}
    assert ("x/y", "x/y/1") in parents and ("x", "x/y/1") in parents


def test_temporal_future_and_cross(spark):
    q = [dt.date(2020 + k // 4, 1 + 3 * (k % 4), 1) for k in range(8)]
    rows = [("A", d, 10 * (k + 1)) for k, d in enumerate(q)] + [("B", d, 100 + 10 * k) for k, d in enumerate(q[2:])]
    df = spark.createDataFrame(rows, "unique_id string, ds date, y long")
    spec = {"quarter": 1, "year": 4, "semiannual": 2}
    local, h = A.aggregate_temporal(df, spec)
    got = {(r.unique_id, r.temporal_id): (r.y, r.ds) for r in local.collect()}
    assert got["A", "year-1"] == (100, q[3]) and got["A", "year-2"] == (260, q[7])
    assert got["B", "year-2"] == (140 + 150, q[7])
    assert h.tags()["year"] == ["year-1", "year-2"] and h.to_numpy().shape == (14, 8)
    everywhere, _ = A.aggregate_temporal(df, spec, aggregation_type="global")
    assert {(r.unique_id, r.temporal_id): r.y for r in everywhere.collect()}["B", "year-1"] == 210
    keys, _ = A.aggregate_temporal(df.drop("y"), spec)
    assert "y" not in keys.columns and keys.count() == local.count()
    for bad in ({"year": 4}, {"a": 1, "b": 1}):
        with pytest.raises(ValueError):
            A.aggregate_temporal(df, bad)
    future = A.make_future_dataframe(df, "3M", 2).where("unique_id = 'A'").orderBy("ds").collect()
    assert [r.ds for r in future] == [dt.date(2022, 1, 1), dt.date(2022, 4, 1)]
    ints = A.make_future_dataframe(spark.createDataFrame([("A", 5)], "unique_id string, ds long"), 2, 3)
    assert [r.ds for r in ints.collect()] == [7, 9, 11]
    _, sections = A.aggregate(df.withColumnRenamed("unique_id", "c"), [["c"]])
    tagged, both = A.cross_temporal(local, sections, h)
    assert tagged.where("cross_temporal_id = 'A//year-1'").count() == 1 and both.count() == 2 * 14
    train, test = A.split_tail(df, 2)
    assert test.count() == 4 and train.count() == 10


def test_hierarchy_from_wide_frame_and_bad_identity(spark):
    wide = spark.createDataFrame([("t", 1.0, 1.0), ("a", 1.0, 0.0), ("b", 0.0, 1.0)], "unique_id string, a double, b double")
    h = from_tags(spark, wide, {"top": ["t"], "bottom": ["a", "b"]})
    assert h.check_bottom_identity() and h.to_wide().count() == 3
    bad = spark.createDataFrame([("t", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 0.0, 1.0)], "unique_id string, a double, b double")
    assert not from_tags(spark, bad, {"top": ["t"], "bottom": ["a", "b"]}).check_bottom_identity()
