"""Building hierarchies: many group-bys in one pass, temporal buckets, future rows, combined tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallytree.functions.aggregates import exogenous
from tallytree.functions.naming import tick
from tallytree.hierarchy import Hierarchy, numbered


def check_no_nulls(df: DataFrame, columns: list[str]) -> None:
    """Raises ValueError if any of the columns holds a null (or, in doubles, NaN); one pass."""
    kinds = dict(df.dtypes)

    def bad(c: str) -> Column:
        null = F.col(tick(c)).isNull()
        return null | F.isnan(tick(c)) if kinds[c] in ("double", "float") else null

    counts = df.agg(*(F.count_if(bad(c)).alias(f"c{k}") for k, c in enumerate(columns))).first()
    wrong = [c for k, c in enumerate(columns) if counts[k]]
    if wrong:
        raise ValueError(f"There are null values in {wrong}.")


def _checked_spec(df: DataFrame, spec: list[list[str]], needed: list[str]) -> list[list[str]]:
    if not spec:
        raise ValueError("The specification has no levels.")
    used = {c for level in spec for c in level}
    if set(spec[-1]) != used:
        raise ValueError("The last level of the specification must contain every column that is used.")
    missing = [c for c in [*used, *needed] if c not in df.columns]
    if missing:
        raise ValueError(f"Columns {sorted(missing)} are not in the frame.")
    return sorted(spec, key=len)


def aggregate(
    df: DataFrame,
    spec: list[list[str]],
    exog_vars: dict[str, str | list[str]] | None = None,
    id_col: str = "unique_id",
    time_col: str = "ds",
    target_cols: tuple[str, ...] = ("y",),
    check: bool = True,
) -> tuple[DataFrame, Hierarchy]:
    """The series of all levels of a specification, and their hierarchy.

    spec: for each level the columns whose values, joined by a slash, name its series. All
    levels come from one pass with grouping sets; rows exist for observed (series, time) pairs
    only. Integer targets stay integers. Nulls in any column raise ValueError.
    """
    targets = list(target_cols)
    levels = _checked_spec(df, spec, [time_col, *targets])
    bottom = levels[-1]
    extra = exogenous(exog_vars, df.columns)
    if check:
        check_no_nulls(df, [*bottom, time_col, *targets, *(exog_vars or {})])
    keys = [F.col(tick(c)) for c in bottom]
    sets = [[*(F.col(tick(c)) for c in level), F.col(tick(time_col))] for level in levels]
    sums = [F.sum(tick(t)).alias(t) for t in targets]
    bits = [F.grouping(tick(c)).alias(f"_g{k}") for k, c in enumerate(bottom)]
    grouped = df.groupingSets(sets, *keys, F.col(tick(time_col))).agg(*sums, *extra, *bits)
    series, order = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, level in enumerate(levels):
        # A level is told by its grouping bits, never by nulls.
        here = F.lit(True)
        for g, c in enumerate(bottom):
            here = here & (F.col(f"_g{g}") == (0 if c in level else 1))
        series = F.when(here, F.concat_ws("/", *(F.col(tick(c)).cast("string") for c in level))).otherwise(series)
        order = F.when(here, F.lit(k)).otherwise(order)
    panel = grouped.select(series.alias(id_col), F.col(tick(time_col)), *(tick(t) for t in targets), *(tick(c) for c in grouped.columns if c not in {*bottom, time_col, *targets} and not re.fullmatch(r"_g\d+", c)), order.alias("level_ord"))
    return panel, hierarchy_of(df, levels)


def hierarchy_of(df: DataFrame, levels: list[list[str]]) -> Hierarchy:
    """The hierarchy of the values of the levels' columns; the last level is the bottom."""
    names = ["/".join(level) for level in levels]
    tuples = df.select(*(F.col(tick(c)).cast("string").alias(c) for c in levels[-1])).distinct()
    bottom = F.concat_ws("/", *(F.col(tick(c)) for c in levels[-1]))
    ancestors = F.array(*(F.struct(F.lit(k).alias("level_ord"), F.lit(names[k]).alias("level"), F.concat_ws("/", *(F.col(tick(c)) for c in level)).alias("unique_id")) for k, level in enumerate(levels)))
    each = tuples.select(bottom.alias("bottom_id"), F.explode(ancestors).alias("a"))
    summing = each.select("a.unique_id", "bottom_id", F.lit(1.0).alias("weight"))
    nodes = each.select("a.unique_id", "a.level", "a.level_ord").distinct()
    nodes = numbered(nodes).withColumn("is_bottom", F.col("level_ord") == len(levels) - 1)
    return Hierarchy(nodes.select("unique_id", "level", "level_ord", "pos", "is_bottom"), summing, tuple(names))


def aggregate_temporal(
    df: DataFrame,
    spec: dict[str, int],
    exog_vars: dict[str, str | list[str]] | None = None,
    id_col: str = "unique_id",
    time_col: str = "ds",
    id_time_col: str = "temporal_id",
    target_cols: tuple[str, ...] = ("y",),
    aggregation_type: str = "local",
) -> tuple[DataFrame, Hierarchy]:
    """Series at coarser time steps, and the hierarchy of their buckets.

    spec: for each level how many observations make a bucket; one level must have 1. A bucket
    is named ``<level>-<number>``, its time is its last observation's, and a last bucket that
    is not full stays. ``local`` counts the observations of each series, ``global`` the times of
    all series. Without target columns only keys and times come out.
    """
    sizes = list(spec.values())
    if 1 not in sizes:
        raise ValueError("One level of the temporal specification must have the size 1.")
    if len(set(sizes)) != len(sizes):
        raise ValueError("The sizes of the temporal specification must differ.")
    if aggregation_type not in ("local", "global"):
        raise ValueError(f"Unknown aggregation type: {aggregation_type}")
    order = sorted(spec.items(), key=lambda x: -x[1])
    targets = [t for t in target_cols if t in df.columns]
    if aggregation_type == "local":
        placed = df.withColumn("_ordinal", F.row_number().over(Window.partitionBy(tick(id_col)).orderBy(tick(time_col))))
    else:
        # One row per time; times are few beside rows.
        times = df.select(tick(time_col)).distinct().withColumn("_ordinal", F.row_number().over(Window.orderBy(tick(time_col))))
        placed = df.join(times, time_col)
    buckets = [F.struct(F.lit(k).alias("level_ord"), F.lit(name).alias("level"), (F.expr(f"(_ordinal - 1) div {m}") + 1).alias("bucket")) for k, (name, m) in enumerate(order)]
    each = placed.withColumn("_b", F.explode(F.array(*buckets)))
    bucket = F.concat(F.col("_b.level"), F.lit("-"), F.col("_b.bucket").cast("string"))
    each = each.withColumn(id_time_col, bucket).withColumn("level_ord", F.col("_b.level_ord"))
    found = each.groupBy(tick(id_col), tick(id_time_col), "level_ord").agg(F.max(tick(time_col)).alias(time_col), *(F.sum(tick(t)).alias(t) for t in targets), *exogenous(exog_vars, df.columns))
    longest = placed.agg(F.max("_ordinal")).first()[0] or 0
    return found, temporal_hierarchy(df, dict(order), longest)


def temporal_hierarchy(df: DataFrame, spec: dict[str, int], length: int) -> Hierarchy:
    """Buckets of ``length`` ordinals: bottom k belongs to bucket ceil(k / m) of each level."""
    order = sorted(spec.items(), key=lambda x: -x[1])
    k = df.sparkSession.range(1, length + 1).select(F.col("id").alias("k"))
    rows = F.array(*(F.struct(F.lit(o).alias("level_ord"), F.lit(name).alias("level"), F.expr(f"(k - 1) div {m} + 1").alias("pos")) for o, (name, m) in enumerate(order)))
    each = k.select("k", F.explode(rows).alias("a"))
    node = F.concat(F.col("a.level"), F.lit("-"), F.col("a.pos").cast("string"))
    bottom = F.concat(F.lit(f"{order[-1][0]}-"), F.col("k").cast("string"))
    summing = each.select(node.alias("unique_id"), bottom.alias("bottom_id"), F.lit(1.0).alias("weight"))
    nodes = each.select(node.alias("unique_id"), F.col("a.level").alias("level"), F.col("a.level_ord").alias("level_ord"), F.col("a.pos").alias("pos")).distinct()
    return Hierarchy(nodes.withColumn("is_bottom", F.col("level_ord") == len(order) - 1), summing, tuple(n for n, _ in order))


STEP = re.compile(r"(\d*)(s|min|h|d|w|m|q|y)(s|e)?", re.IGNORECASE)
UNITS = {"s": "SECOND", "min": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "m": "MONTH", "q": "QUARTER", "y": "YEAR"}


def interval(freq: str) -> str:
    """A step such as ``3M``, ``QS`` or ``D`` as a SQL interval of months or days."""
    m = STEP.fullmatch(freq)
    if not m:
        raise ValueError(f"Unknown frequency: {freq}")
    n, unit = int(m[1] or 1), UNITS[m[2].lower()]
    n, unit = {"QUARTER": (3 * n, "MONTH"), "WEEK": (7 * n, "DAY")}.get(unit, (n, unit))
    return f"INTERVAL {n} {unit}"


def make_future_dataframe(df: DataFrame, freq: str | int, h: int, id_col: str = "unique_id", time_col: str = "ds") -> DataFrame:
    """The h time steps after each series' last one. Month ends stay month ends."""
    last = df.groupBy(tick(id_col)).agg(F.max(tick(time_col)).alias("_last"))
    if isinstance(freq, int):
        steps = F.sequence(F.col("_last") + freq, F.col("_last") + freq * h, F.lit(freq))
        return last.select(tick(id_col), F.explode(steps).alias(time_col)).withColumn(time_col, F.col(tick(time_col)).cast(df.schema[time_col].dataType))
    step = interval(freq)
    k = last.select(tick(id_col), "_last", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("_k"))
    n, unit = step.split()[1:]
    amount = F.expr(f"make_interval({'0, _k * ' + n if unit == 'MONTH' else '_k * ' + n + ', 0' if unit == 'YEAR' else '0, 0, 0, ' + {'DAY': f'_k * {n}', 'HOUR': f'0, _k * {n}', 'MINUTE': f'0, 0, _k * {n}', 'SECOND': f'0, 0, 0, _k * {n}'}[unit]})")
    moved = F.col("_last") + amount
    if freq.upper().endswith("E") and unit in ("MONTH", "YEAR"):
        moved = F.last_day(moved)
    return k.select(tick(id_col), moved.cast(df.schema[time_col].dataType).alias(time_col))


def cross_temporal(df: DataFrame, sections: Hierarchy, times: Hierarchy, sep: str = "//", id_col: str = "unique_id", id_time_col: str = "temporal_id", cross_temporal_id_col: str = "cross_temporal_id") -> tuple[DataFrame, DataFrame]:
    """df with the combined id, and the combined level table (level, unique_id): every section at every time."""
    tagged = df.withColumn(cross_temporal_id_col, F.concat_ws(sep, tick(id_col), tick(id_time_col)))
    a = sections.nodes.select(F.col("level").alias("_l"), F.col("unique_id").alias("_u"))
    b = times.nodes.select(F.col("level").alias("_m"), F.col("unique_id").alias("_v"))
    # The result is every combination by definition; the smaller table is the one that is repeated.
    both = a.crossJoin(b)
    return tagged, both.select(F.concat_ws(sep, "_l", "_m").alias("level"), F.concat_ws(sep, "_u", "_v").alias("unique_id"))


def split_tail(df: DataFrame, h: int, id_col: str = "unique_id", time_col: str = "ds") -> tuple[DataFrame, DataFrame]:
    """Each series without its last h rows, and those rows."""
    ranked = df.withColumn("_back", F.row_number().over(Window.partitionBy(tick(id_col)).orderBy(F.desc(tick(time_col)))))
    return ranked.where(F.col("_back") > h).drop("_back"), ranked.where(F.col("_back") <= h).drop("_back")
