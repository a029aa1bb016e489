"""A hierarchy as tables: its nodes, which bottom series each node sums, and the tree's edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallytree.functions.ordering import ranked
from tallytree.session import settled

NODES = "unique_id string, level string, level_ord int, pos long, is_bottom boolean"


@dataclass(frozen=True)
class Hierarchy:
    """nodes: unique_id, level, level_ord (0: coarsest), pos (from 1 in its level), is_bottom.
    summing: unique_id, bottom_id, weight; the rows that are not zero of the summing matrix."""

    nodes: DataFrame
    summing: DataFrame
    levels: tuple[str, ...]

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @cached_property
    def edges(self) -> DataFrame:
        """parent_id, child_id between neighbouring levels that share a bottom series."""
        at = self.summing.join(self.nodes.select("unique_id", "level_ord"), "unique_id")
        parent = at.select(F.col("unique_id").alias("parent_id"), "bottom_id", (F.col("level_ord") + 1).alias("_at"))
        child = at.select(F.col("unique_id").alias("child_id"), "bottom_id", F.col("level_ord").alias("_at"))
        return parent.join(child, ["bottom_id", "_at"]).select("parent_id", "child_id").distinct()

    @cached_property
    def parents(self) -> DataFrame:
        """unique_id, level_ord, parent_id; for strict hierarchies a row for each node."""
        up = self.edges.select("parent_id", F.col("child_id").alias("unique_id"))
        return self.nodes.select("unique_id", "level_ord").join(up, "unique_id", "left")

    def top(self) -> str:
        """The series that sums most; of several the first by id."""
        sums = self.summing.groupBy("unique_id").agg(F.sum("weight").alias("n"))
        return sums.agg(F.min(F.struct((-F.col("n")).alias("n"), "unique_id"))["unique_id"]).first()[0]

    @property
    def places(self) -> DataFrame:
        """(unique_id, place): places from 0 in level order, from the sizes of the levels."""
        counts = {r.level_ord: r["count"] for r in self.nodes.groupBy("level_ord").count().collect()}  # a row for each level
        starts = F.create_map(*(F.lit(v) for k in counts for v in (k, sum(c for o, c in counts.items() if o < k))))
        return self.nodes.select("unique_id", (F.element_at(starts, F.col("level_ord")) + F.col("pos") - 1).cast("int").alias("place"))

    @cached_property
    def chain(self) -> Hierarchy:
        """The levels that form a tree down to the bottom series, taken from fine to coarse, as a hierarchy of their own."""
        at = self.summing.join(self.nodes.select("unique_id", "level_ord"), "unique_id")
        fine = at.select("bottom_id", F.col("level_ord").alias("_fine"), F.col("unique_id").alias("_id"))
        pairs = at.join(fine, "bottom_id").where("level_ord < _fine").groupBy("level_ord", "_fine", "_id").agg(F.count_distinct("unique_id").alias("n"), F.count("unique_id").alias("rows"))
        nested = pairs.groupBy("level_ord", "_fine").agg(F.max("n").alias("n"), F.sum("rows").alias("rows"))
        covered = at.groupBy("level_ord").agg(F.count(F.lit(1)).alias("rows"))
        told = {(r.level_ord, r["_fine"]): (r.n, r.rows) for r in nested.collect()}  # a row for each pair of levels
        rows = {r.level_ord: r.rows for r in covered.collect()}
        last = len(self.levels) - 1
        kept = [last]
        for k in range(last - 1, -1, -1):
            if told.get((k, kept[0])) == (1, rows[last]) and rows.get(k) == rows[last]:
                kept.insert(0, k)
        if len(kept) == len(self.levels):
            return self
        place = F.create_map(*(F.lit(x) for new, old in enumerate(kept) for x in (old, new)))
        nodes = self.nodes.where(F.col("level_ord").isin(kept)).withColumn("level_ord", F.element_at(place, F.col("level_ord")))
        found = Hierarchy(nodes, self.summing.join(nodes.select("unique_id"), "unique_id", "left_semi"), tuple(self.levels[k] for k in kept)).settle()
        found.__dict__["is_strict"] = True
        return found

    @cached_property
    def is_strict(self) -> bool:
        """Whether every node has at most one parent and every level covers all bottom series once."""
        parents = self.edges.groupBy("child_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n")
        at = self.summing.join(self.nodes.select("unique_id", "level_ord"), "unique_id")
        several = at.groupBy("bottom_id", "level_ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n")
        covered = at.groupBy("bottom_id").agg(F.count_distinct("level_ord").alias("n")).where(F.col("n") < len(self.levels)).select("n")
        return parents.union(several).union(covered).isEmpty()

    def check_bottom_identity(self) -> bool:
        """Whether each bottom series is made of itself alone, once."""
        bottom = self.nodes.where("is_bottom").select("unique_id")
        rows = self.summing.join(bottom, "unique_id")
        wrong = rows.where("NOT unique_id <=> bottom_id OR weight <> 1").select("unique_id")
        counts = rows.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n"))
        missing = bottom.join(counts.where("n = 1"), "unique_id", "left_anti")
        outside = self.summing.join(bottom.withColumnRenamed("unique_id", "bottom_id"), "bottom_id", "left_anti").select("unique_id")
        return wrong.union(missing).union(outside).isEmpty()

    @property
    def shape(self) -> tuple[int, int]:
        return self.nodes.count(), self.nodes.where("is_bottom").count()

    def tags(self) -> dict[str, list[str]]:
        """Ids by level; for hierarchies that fit on the driver."""
        found: dict[str, list[str]] = {x: [] for x in self.levels}
        for r in self.nodes.orderBy("level_ord", "pos").select("level", "unique_id").toLocalIterator():
            found[r[0]].append(r[1])
        return found

    def to_numpy(self, most: int = 25_000_000) -> np.ndarray:
        """The summing matrix as a dense array of at most ``most`` cells."""
        n, b = self.shape
        if n * b > most:
            raise ValueError(f"A dense {n} x {b} matrix has more than {most} cells; use the rows of ``summing``.")
        ids = [r[0] for r in self.nodes.orderBy("level_ord", "pos").select("unique_id").collect()]
        row = {x: k for k, x in enumerate(ids)}
        s = np.zeros((n, b))
        for r in self.summing.collect():
            s[row[r.unique_id], row[r.bottom_id] - (n - b)] = r.weight
        return s

    def to_wide(self) -> DataFrame:
        """One row per node, one column per bottom series; for exports of small hierarchies."""
        bottom = [r[0] for r in self.nodes.where("is_bottom").orderBy("pos").select("unique_id").collect()]
        wide = self.summing.groupBy("unique_id").pivot("bottom_id", bottom).agg(F.first("weight"))
        return self.nodes.select("unique_id", "level_ord", "pos").join(wide.na.fill(0.0), "unique_id").orderBy("level_ord", "pos").drop("level_ord", "pos")

    def cache(self) -> Hierarchy:
        self.nodes.cache()
        self.summing.cache()
        return self

    def settle(self) -> Hierarchy:
        """The same hierarchy as written tables, so that the plans over it stay short."""
        h = Hierarchy(settled(self.nodes, "nodes"), settled(self.summing, "summing"), self.levels)
        h.__dict__["edges"] = settled(Hierarchy.edges.func(h), "edges")
        h.__dict__["parents"] = settled(Hierarchy.parents.func(h), "parents")
        return h

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.summing.unpersist()


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes with pos: 1, 2, ... by id in each level; a level may lie in any number of tasks."""
    return ranked(nodes, ["level_ord"], ["unique_id"]).withColumn("pos", F.col("rank") + 1).drop("rank", "n")


def from_tags(spark: SparkSession, wide: DataFrame, tags: dict[str, list[str]], id_col: str = "unique_id") -> Hierarchy:
    """A hierarchy from a wide 0/1 frame (a column per bottom series) and the ids of each level, coarse to fine."""
    bottom = [c for c in wide.columns if c != id_col]
    long = wide.unpivot([id_col], [f"`{c}`" for c in bottom], "bottom_id", "weight").where("weight <> 0")
    levels = list(tags)
    rows = [(i, x, k, p + 1, k == len(levels) - 1) for k, x in enumerate(levels) for p, i in enumerate(tags[x])]
    nodes = spark.createDataFrame(rows, NODES)
    return Hierarchy(nodes, long.select(F.col(id_col).alias("unique_id"), "bottom_id", F.col("weight").cast("double").alias("weight")), tuple(levels))
