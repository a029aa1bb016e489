"""Ranks within keys against a sort in Python."""

from tallytree.functions.ordering import ranked


def test_ranks_are_places_in_the_sorted_key(spark):
    rows = [("a", k % 7, k) for k in range(50)] + [(None, 1, 0), (None, None, 1), ("b", 3, 0)]
    got = ranked(spark.createDataFrame(rows, "k string, v int, id int").repartition(5), ["k"], ["v", "id"]).collect()
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        own = sorted((r for r in got if r.k == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(want))) and {r.n for r in own} == {len(want)}
        assert [(r.k, r.v, r.id) for r in own] == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert ranked(empty, ["k"], ["v"]).columns == ["k", "v", "rank", "n"] and ranked(empty, ["k"], ["v"]).isEmpty()
