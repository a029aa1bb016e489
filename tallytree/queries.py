"""Registered queries over the sample tables, and the same results in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallytree.functions import metrics as M
from tallytree.operators import aggregate as A
from tallytree.operators import covariance as C
from tallytree.operators import evaluate as E
from tallytree.operators import intervals as I
from tallytree.operators import reconcilers as K
from tallytree.operators.reconcile import coherence_residual
from tallytree.plans import demo
from tallytree.plans.plots import HierarchicalPlot
from tallytree.plans.reconciliation import HierarchicalReconciliation
from tallytree.session import shared_folder
from tallytree.sources import frames

BY = ["ds", "model"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def million(c: str) -> Column:
    """Cents as millions, rounded off the grid of cents, so that the order of sums does not show."""
    return F.round(F.col(c) / 1e6 + 3.7e-9, 4)


def result(df: DataFrame, value: str = "yhat") -> DataFrame:
    return df.select("unique_id", *BY, million(value).alias("value"))


# SQL that the oracles share -------------------------------------------------------------------

ORDERS = """rows_ AS (
 SELECT 'total' AS total, r_name AS region, n_name AS nation, c_mktsegment AS segment, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ds,
  CAST(round(o_totalprice * 100) AS BIGINT) AS y, o_custkey
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
GEO = f"""{ORDERS}, keys AS (SELECT DISTINCT region, nation FROM rows_), times AS (SELECT DISTINCT ds FROM rows_),
bottom AS (SELECT k.region, k.nation, t.ds, CAST(COALESCE(SUM(r.y), 0) AS BIGINT) AS y
 FROM keys k CROSS JOIN times t LEFT JOIN rows_ r ON r.region = k.region AND r.nation = k.nation AND r.ds = t.ds GROUP BY 1, 2, 3),
panel AS (SELECT 'total' AS unique_id, ds, CAST(SUM(y) AS BIGINT) AS y, 0 AS level_ord FROM bottom GROUP BY ds
 UNION ALL SELECT 'total/' || region, ds, CAST(SUM(y) AS BIGINT), 1 FROM bottom GROUP BY region, ds
 UNION ALL SELECT 'total/' || region || '/' || nation, ds, y, 2 FROM bottom),
nodes AS (SELECT DISTINCT unique_id, level_ord, CASE level_ord WHEN 0 THEN 'total' WHEN 1 THEN 'total/region' ELSE 'total/region/nation' END AS level FROM panel),
summing AS (SELECT 'total' AS unique_id, 'total/' || region || '/' || nation AS bottom_id FROM keys
 UNION ALL SELECT 'total/' || region, 'total/' || region || '/' || nation FROM keys
 UNION ALL SELECT 'total/' || region || '/' || nation, 'total/' || region || '/' || nation FROM keys),
edges AS (SELECT DISTINCT 'total' AS parent_id, 'total/' || region AS child_id FROM keys
 UNION ALL SELECT 'total/' || region, 'total/' || region || '/' || nation FROM keys)"""
EVENTS = """rows_ AS (SELECT event_type AS kind, CAST(ts AS DATE) AS ds, CAST(round(value * 100) AS BIGINT) AS y FROM events),
keys AS (SELECT DISTINCT kind FROM rows_), times AS (SELECT DISTINCT ds FROM rows_),
bottom AS (SELECT k.kind, t.ds, CAST(COALESCE(SUM(r.y), 0) AS BIGINT) AS y FROM keys k CROSS JOIN times t LEFT JOIN rows_ r ON r.kind = k.kind AND r.ds = t.ds GROUP BY 1, 2),
panel AS (SELECT 'total' AS unique_id, ds, CAST(SUM(y) AS BIGINT) AS y, 0 AS level_ord FROM bottom GROUP BY ds UNION ALL SELECT 'total/' || kind, ds, y, 1 FROM bottom),
nodes AS (SELECT DISTINCT unique_id, level_ord, CASE level_ord WHEN 0 THEN 'total' ELSE 'total/kind' END AS level FROM panel),
summing AS (SELECT 'total' AS unique_id, 'total/' || kind AS bottom_id FROM keys UNION ALL SELECT 'total/' || kind, 'total/' || kind FROM keys),
edges AS (SELECT 'total' AS parent_id, 'total/' || kind AS child_id FROM keys)"""


def forecasts(panel: str, season: int) -> str:
    return f"""{panel},
back_ AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM panel),
train AS (SELECT * FROM back_ WHERE back > {season}), test AS (SELECT * FROM back_ WHERE back <= {season}),
last_ AS (SELECT unique_id, arg_max(y, ds) AS y FROM train GROUP BY unique_id),
fc AS (SELECT t.unique_id, t.ds, 'naive' AS model, l.y * (1 + 0.05 * t.level_ord)::DOUBLE AS yhat, t.level_ord FROM test t JOIN last_ l ON l.unique_id = t.unique_id
 UNION ALL SELECT t.unique_id, t.ds, 'snaive', b.y * (1 + 0.03 * t.level_ord)::DOUBLE, t.level_ord FROM test t JOIN train b ON b.unique_id = t.unique_id AND b.back = t.back + {season}),
lags AS (SELECT *, lag(y, 1) OVER (PARTITION BY unique_id ORDER BY ds) AS n1, lag(y, {season}) OVER (PARTITION BY unique_id ORDER BY ds) AS n2 FROM train),
fit AS (SELECT unique_id, ds, 'naive' AS model, y::DOUBLE AS y, n1 * (1 + 0.05 * level_ord)::DOUBLE AS yhat, level_ord FROM lags WHERE n2 IS NOT NULL
 UNION ALL SELECT unique_id, ds, 'snaive', y::DOUBLE, n2 * (1 + 0.03 * level_ord)::DOUBLE, level_ord FROM lags WHERE n2 IS NOT NULL),
err AS (SELECT unique_id, ds, model, y - yhat AS e, level_ord FROM fit),
bu AS (SELECT s.unique_id, f.ds, f.model, SUM(f.yhat) AS yhat FROM fc f JOIN summing s ON s.bottom_id = f.unique_id GROUP BY 1, 2, 3),
bufit AS (SELECT s.unique_id, f.ds, f.model, SUM(f.yhat) AS yhat FROM fit f JOIN summing s ON s.bottom_id = f.unique_id GROUP BY 1, 2, 3)"""


CROSSED = f"""{ORDERS}, keys AS (SELECT DISTINCT region, segment FROM rows_), times AS (SELECT DISTINCT ds FROM rows_),
bottom AS (SELECT k.region, k.segment, t.ds, CAST(COALESCE(SUM(r.y), 0) AS BIGINT) AS y
 FROM keys k CROSS JOIN times t LEFT JOIN rows_ r ON r.region = k.region AND r.segment = k.segment AND r.ds = t.ds GROUP BY 1, 2, 3),
panel AS (SELECT 'total' AS unique_id, ds, CAST(SUM(y) AS BIGINT) AS y, 0 AS level_ord FROM bottom GROUP BY ds
 UNION ALL SELECT 'total/' || region, ds, CAST(SUM(y) AS BIGINT), 1 FROM bottom GROUP BY region, ds
 UNION ALL SELECT 'total/' || segment, ds, CAST(SUM(y) AS BIGINT), 2 FROM bottom GROUP BY segment, ds
 UNION ALL SELECT 'total/' || region || '/' || segment, ds, y, 3 FROM bottom),
summing AS (SELECT 'total' AS unique_id, 'total/' || region || '/' || segment AS bottom_id FROM keys
 UNION ALL SELECT 'total/' || region, 'total/' || region || '/' || segment FROM keys
 UNION ALL SELECT 'total/' || segment, 'total/' || region || '/' || segment FROM keys
 UNION ALL SELECT 'total/' || region || '/' || segment, 'total/' || region || '/' || segment FROM keys)"""
FGEO, FEVENTS = forecasts(GEO, 4), forecasts(EVENTS, 7)
OUT = "SELECT unique_id, ds, model, round(yhat / 1000000.0 + 3.7e-9, 4) AS value FROM"


def tree_sql(weights: str) -> str:
    """weights: a query of model, unique_id, w."""
    return f"""WITH {FGEO}, w AS ({weights}),
b AS (SELECT f.*, w.w FROM fc f JOIN w ON w.unique_id = f.unique_id AND w.model = f.model),
s1 AS (SELECT e.parent_id, b.ds, b.model, SUM(b.yhat) AS sm, SUM(b.w) AS sv FROM b JOIN edges e ON e.child_id = b.unique_id WHERE b.level_ord = 2 GROUP BY 1, 2, 3),
u1 AS (SELECT b.unique_id, b.ds, b.model, (b.yhat * sv + sm * w) / (w + sv) AS m, w * sv / (w + sv) AS v FROM b JOIN s1 ON s1.parent_id = b.unique_id AND s1.ds = b.ds AND s1.model = b.model WHERE b.level_ord = 1),
s0 AS (SELECT ds, model, SUM(m) AS sm, SUM(v) AS sv FROM u1 GROUP BY 1, 2),
r0 AS (SELECT b.unique_id, b.ds, b.model, (b.yhat * sv + sm * w) / (w + sv) AS yhat FROM b JOIN s0 ON s0.ds = b.ds AND s0.model = b.model WHERE b.level_ord = 0),
r1 AS (SELECT u.unique_id, u.ds, u.model, u.m + u.v / s0.sv * (r0.yhat - s0.sm) AS yhat FROM u1 u JOIN s0 ON s0.ds = u.ds AND s0.model = u.model JOIN r0 ON r0.ds = u.ds AND r0.model = u.model),
r2 AS (SELECT b.unique_id, b.ds, b.model, b.yhat + b.w / s1.sv * (r1.yhat - s1.sm) AS yhat FROM b JOIN edges e ON e.child_id = b.unique_id
 JOIN s1 ON s1.parent_id = e.parent_id AND s1.ds = b.ds AND s1.model = b.model JOIN r1 ON r1.unique_id = e.parent_id AND r1.ds = b.ds AND r1.model = b.model WHERE b.level_ord = 2)
{OUT} (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)"""


def two_level_sql(wu: str, more: str = "") -> str:
    """wu: a query of model, unique_id, wu: the covariance times (1 for the total, -1 for the others)."""
    return f"""WITH {FEVENTS}{more}, wu AS ({wu}),
k AS (SELECT w.model, SUM(CASE WHEN n.level_ord = 0 THEN w.wu ELSE -w.wu END) AS k FROM wu w JOIN nodes n ON n.unique_id = w.unique_id GROUP BY 1),
r AS (SELECT ds, model, SUM(CASE WHEN level_ord = 0 THEN yhat ELSE -yhat END) AS r FROM fc GROUP BY 1, 2)
{OUT} (SELECT f.unique_id, f.ds, f.model, f.yhat - w.wu * r.r / k.k AS yhat FROM fc f JOIN wu w ON w.unique_id = f.unique_id AND w.model = f.model JOIN k ON k.model = f.model JOIN r ON r.ds = f.ds AND r.model = f.model)"""


COV = """SELECT a.model, a.unique_id AS id1, b.unique_id AS id2, covar_samp(a.e, b.e) AS cov FROM err a JOIN err b ON a.ds = b.ds AND a.model = b.model GROUP BY 1, 2, 3"""
LAM = """x AS (SELECT e.model, e.unique_id, e.ds, (e.e - s.m) / (s.d + 2e-8) AS x FROM err e JOIN (SELECT model, unique_id, AVG(e) AS m, stddev_pop(e) AS d FROM err GROUP BY 1, 2) s ON s.model = e.model AND s.unique_id = e.unique_id),
p AS (SELECT a.model, a.unique_id AS i, b.unique_id AS j, COUNT(*) AS t, AVG(a.x * b.x) AS w, SUM(a.x * a.x * b.x * b.x) AS q FROM x a JOIN x b ON a.model = b.model AND a.ds = b.ds AND a.unique_id < b.unique_id GROUP BY 1, 2, 3),
lam AS (SELECT model, LEAST(GREATEST(SUM((q - t * w * w) / (t * (t - 1))) / (SUM(w * w) + 2e-8), 0.0), 1.0) AS lam FROM p GROUP BY 1)"""

# Hierarchies ---------------------------------------------------------------------------------


@query(f"""WITH {ORDERS} SELECT CASE WHEN GROUPING(region) = 1 THEN 'total' WHEN GROUPING(nation) = 1 THEN 'total/' || region ELSE 'total/' || region || '/' || nation END AS unique_id, ds, CAST(SUM(y) AS BIGINT) AS y
FROM rows_ GROUP BY GROUPING SETS ((ds), (region, ds), (region, nation, ds))""")
def agg_total_region_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, _ = A.aggregate(demo.order_rows(spark, sf_dir), demo.GEO)
    return panel.select("unique_id", "ds", "y")


@query(f"""WITH {ORDERS} SELECT 'total' || COALESCE('/' || region, '') || COALESCE('/' || segment, '') AS unique_id, ds, CAST(SUM(y) AS BIGINT) AS y
FROM rows_ GROUP BY GROUPING SETS ((ds), (region, ds), (segment, ds), (region, segment, ds))""")
def agg_grouped_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, _ = A.aggregate(demo.order_rows(spark, sf_dir), demo.CROSSED)
    return panel.select("unique_id", "ds", "y")


@query(f"""WITH {ORDERS}, g AS (SELECT 'total' || COALESCE('/' || region, '') || COALESCE('/' || nation, '') AS unique_id, ds, CAST(SUM(y) AS BIGINT) AS y, AVG(y) AS m, stddev_samp(y) AS s, MIN(y) AS lo, MAX(y) AS hi, COUNT(DISTINCT o_custkey) AS n
FROM rows_ GROUP BY GROUPING SETS ((ds), (region, ds), (region, nation, ds)))
SELECT unique_id, ds, y, round(m / 1000000.0 + 3.7e-9, 4) AS price_mean, round(s / 1000000.0 + 3.7e-9, 4) AS price_std, lo AS price_min, hi AS price_max, n AS o_custkey_n_unique FROM g""")
def agg_exog_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.order_rows(spark, sf_dir).withColumn("price", F.col("y"))
    panel, _ = A.aggregate(rows, demo.GEO, exog_vars={"price": ["mean", "std", "min", "max"], "o_custkey": "n_unique"}, check=False)
    return panel.select("unique_id", "ds", "y", million("price_mean").alias("price_mean"), million("price_std").alias("price_std"), "price_min", "price_max", "o_custkey_n_unique")


@query(f"WITH {GEO} SELECT unique_id, bottom_id, 1.0::DOUBLE AS weight FROM summing")
def s_matrix_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hierarchy_of(demo.order_rows(spark, sf_dir), demo.GEO).summing


@query(f"""WITH {GEO} SELECT unique_id, level, CAST(level_ord AS INTEGER) AS level_ord, row_number() OVER (PARTITION BY level_ord ORDER BY unique_id) AS pos, level_ord = 2 AS is_bottom FROM nodes""")
def tags_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hierarchy_of(demo.order_rows(spark, sf_dir), demo.GEO).nodes


@query(f"""WITH {GEO}, n AS (SELECT unique_id, COUNT(*) AS n FROM summing GROUP BY 1), t AS (SELECT unique_id FROM n ORDER BY n DESC, unique_id LIMIT 1) SELECT p.ds, p.y FROM panel p JOIN t ON t.unique_id = p.unique_id""")
def top_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the series that sums most."""
    panel, h = A.aggregate(demo.dense(demo.order_rows(spark, sf_dir), demo.GEO[-1]), demo.GEO, check=False)
    return panel.where(F.col("unique_id") == h.top()).select("ds", "y")


@query(f"WITH {GEO} SELECT parent_id, child_id FROM edges")
def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hierarchy_of(demo.order_rows(spark, sf_dir), demo.GEO).edges


@query(f"""WITH {ORDERS}, a AS (SELECT COUNT(DISTINCT region) AS n FROM rows_ GROUP BY nation), b AS (SELECT COUNT(DISTINCT region) AS n FROM rows_ GROUP BY segment)
SELECT 'geo' AS name, (SELECT MAX(n) FROM a) = 1 AS is_strict UNION ALL SELECT 'crossed', (SELECT MAX(n) FROM b) = 1""")
def strict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.order_rows(spark, sf_dir)
    told = [(name, A.hierarchy_of(rows, spec).is_strict) for name, spec in (("geo", demo.GEO), ("crossed", demo.CROSSED))]
    return spark.createDataFrame(told, "name string, is_strict boolean")


def temporal_sql(ordinal: str) -> str:
    return f"""WITH {ORDERS}, q AS (SELECT nation AS unique_id, ds, CAST(SUM(y) AS BIGINT) AS y FROM rows_ GROUP BY 1, 2),
t AS (SELECT ds, row_number() OVER (ORDER BY ds) AS g FROM (SELECT DISTINCT ds FROM q)),
o AS (SELECT q.*, {ordinal} AS k FROM q JOIN t ON t.ds = q.ds), l AS (SELECT * FROM (VALUES ('year', 4), ('semiannual', 2), ('quarter', 1)) v(level, m))
SELECT unique_id, level || '-' || CAST((k - 1) // m + 1 AS VARCHAR) AS temporal_id, MAX(ds) AS ds, CAST(SUM(y) AS BIGINT) AS y FROM o CROSS JOIN l GROUP BY 1, 2"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.order_rows(spark, sf_dir).groupBy(F.col("nation").alias("unique_id"), "ds").agg(F.sum("y").alias("y"))


SPEC = {"year": 4, "semiannual": 2, "quarter": 1}


@query(temporal_sql("row_number() OVER (PARTITION BY q.unique_id ORDER BY q.ds)"))
def temporal_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.aggregate_temporal(quarters(spark, sf_dir), SPEC)[0].select("unique_id", "temporal_id", "ds", "y")


@query(temporal_sql("t.g"))
def temporal_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.aggregate_temporal(quarters(spark, sf_dir), SPEC, aggregation_type="global")[0].select("unique_id", "temporal_id", "ds", "y")


@query(f"""WITH {ORDERS}, q AS (SELECT nation AS unique_id, MAX(ds) AS ds FROM rows_ GROUP BY 1)
SELECT unique_id, CAST(ds + to_months(CAST(3 * k AS INTEGER)) AS DATE) AS ds FROM q CROSS JOIN (SELECT unnest(range(1, 5)) AS k)""")
def future_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.make_future_dataframe(quarters(spark, sf_dir), "QS", 4)


@query(f"""WITH {GEO}, b AS (SELECT level, CAST(m AS INTEGER) AS m FROM (VALUES ('year', 4), ('semiannual', 2), ('quarter', 1)) v(level, m)),
t AS (SELECT DISTINCT b.level, b.level || '-' || CAST((k - 1) // m + 1 AS VARCHAR) AS id FROM b CROSS JOIN (SELECT unnest(range(1, 5)) AS k))
SELECT n.level || '//' || t.level AS level, n.unique_id || '//' || t.id AS unique_id FROM nodes n CROSS JOIN t""")
def cross_temporal_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.order_rows(spark, sf_dir)
    h, t = A.hierarchy_of(rows, demo.GEO), A.temporal_hierarchy(rows, SPEC, 4)
    frame = h.nodes.select("unique_id").withColumn("temporal_id", F.lit("year-1"))
    return A.cross_temporal(frame, h, t)[1]


@query(f"""WITH {FGEO} SELECT unique_id, ds, y, 'test' AS part FROM test UNION ALL SELECT unique_id, ds, y, 'train' FROM train""")
def split_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, _ = A.aggregate(demo.dense(demo.order_rows(spark, sf_dir), demo.GEO[-1]), demo.GEO, check=False)
    train, test = A.split_tail(panel.select("unique_id", "ds", "y"), 4)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# Point reconciliation ------------------------------------------------------------------------


def by_method(spark: SparkSession, sf_dir: str, method: K.Method, panel=demo.geo) -> DataFrame:
    p = panel(spark, sf_dir)
    return result(method.mean(p.h, p.fcst, p.fitted, BY))


@query(f"WITH {FGEO} {OUT} bu")
def bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.BottomUp())


def share_sql(p: str, root: str) -> str:
    """p: a query of model-free shares by bottom_id and root_id; root: level_ord of the roots."""
    return f"""WITH {FGEO}, anc AS (SELECT s.bottom_id, s.unique_id AS root_id FROM summing s JOIN nodes n ON n.unique_id = s.unique_id WHERE n.level_ord = {root}),
v AS (SELECT DISTINCT unique_id, ds, y FROM fit), sh AS ({p}),
bt AS (SELECT sh.bottom_id, f.ds, f.model, sh.p * f.yhat AS yhat FROM sh JOIN fc f ON f.unique_id = sh.root_id),
td AS (SELECT s.unique_id, b.ds, b.model, SUM(b.yhat) AS yhat FROM bt b JOIN summing s ON s.bottom_id = b.bottom_id GROUP BY 1, 2, 3)"""


AVERAGE = "SELECT a.bottom_id, a.root_id, AVG(o.y / NULLIF(t.y, 0)) AS p FROM anc a JOIN v o ON o.unique_id = a.bottom_id JOIN v t ON t.unique_id = a.root_id AND t.ds = o.ds GROUP BY 1, 2"
OF_AVERAGES = "SELECT a.bottom_id, a.root_id, AVG(o.y) / AVG(t.y) AS p FROM anc a JOIN v o ON o.unique_id = a.bottom_id JOIN v t ON t.unique_id = a.root_id AND t.ds = o.ds GROUP BY 1, 2"


@query(f"{share_sql(AVERAGE, '0')} {OUT} td")
def top_down_avg_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.TopDown("average_proportions"))


@query(f"{share_sql(OF_AVERAGES, '0')} {OUT} td")
def top_down_prop_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.TopDown("proportion_averages"))


DOWN = """c AS (SELECT e.parent_id, f.unique_id, f.ds, f.model, f.level_ord, f.yhat / SUM(f.yhat) OVER (PARTITION BY e.parent_id, f.ds, f.model) AS share FROM fc f JOIN edges e ON e.child_id = f.unique_id)"""


@query(f"""WITH {FGEO}, {DOWN}, r0 AS (SELECT unique_id, ds, model, yhat FROM fc WHERE level_ord = 0),
r1 AS (SELECT c.unique_id, c.ds, c.model, c.share * r.yhat AS yhat FROM c JOIN r0 r ON r.unique_id = c.parent_id AND r.ds = c.ds AND r.model = c.model WHERE c.level_ord = 1),
r2 AS (SELECT c.unique_id, c.ds, c.model, c.share * r.yhat AS yhat FROM c JOIN r1 r ON r.unique_id = c.parent_id AND r.ds = c.ds AND r.model = c.model WHERE c.level_ord = 2)
{OUT} (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)""")
def top_down_fcst_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.TopDown("forecast_proportions"))


@query(f"""WITH {FGEO}, {DOWN}, r1 AS (SELECT unique_id, ds, model, yhat FROM fc WHERE level_ord = 1),
r0 AS (SELECT 'total' AS unique_id, ds, model, SUM(yhat) AS yhat FROM r1 GROUP BY 2, 3),
r2 AS (SELECT c.unique_id, c.ds, c.model, c.share * r.yhat AS yhat FROM c JOIN r1 r ON r.unique_id = c.parent_id AND r.ds = c.ds AND r.model = c.model WHERE c.level_ord = 2)
{OUT} (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)""")
def middle_out_fcst_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MiddleOut("total/region", "forecast_proportions"))


@query(f"""{share_sql(AVERAGE, '1')}, m AS (SELECT 'total' AS unique_id, ds, model, SUM(yhat) AS yhat FROM fc WHERE level_ord = 1 GROUP BY 2, 3 UNION ALL SELECT unique_id, ds, model, yhat FROM fc WHERE level_ord = 1
 UNION ALL SELECT t.unique_id, t.ds, t.model, t.yhat FROM td t JOIN nodes n ON n.unique_id = t.unique_id WHERE n.level_ord = 2) {OUT} m""")
def middle_out_avg_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MiddleOut("total/region", "average_proportions"))


@query(tree_sql("SELECT DISTINCT model, unique_id, 1.0::DOUBLE AS w FROM fc"))
def mint_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTrace("ols"))


@query(tree_sql("SELECT f.model, s.unique_id, COUNT(*)::DOUBLE AS w FROM summing s CROSS JOIN (SELECT DISTINCT model FROM fc) f GROUP BY 1, 2"))
def mint_wls_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTrace("wls_struct"))


@query(tree_sql("SELECT model, unique_id, SUM(e * e) / COUNT(*) + 2e-8 AS w FROM err GROUP BY 1, 2"))
def mint_wls_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTrace("wls_var"))


@query(tree_sql("SELECT model, unique_id, var_samp(e) AS w FROM err GROUP BY 1, 2"))
def mint_sparse_wls_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTraceSparse("wls_var"))


SIGNED = "SELECT c.model, c.id1 AS unique_id, SUM(CASE WHEN n.level_ord = 0 THEN {0} ELSE -({0}) END) AS wu FROM cov c JOIN nodes n ON n.unique_id = c.id2{1} GROUP BY 1, 2"


@query(two_level_sql(SIGNED.format("c.cov", ""), f", cov AS ({COV})"))
def mint_cov_2lvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTrace("mint_cov"), demo.events)


@query(two_level_sql(SIGNED.format("CASE WHEN c.id1 = c.id2 THEN GREATEST(c.cov, 2e-8) ELSE (1 - l.lam) * c.cov END", " JOIN lam l ON l.model = c.model"), f", cov AS ({COV}), {LAM}"))
def mint_shrink_2lvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTrace("mint_shrink"), demo.events)


@query(f"""WITH {FEVENTS}, r AS (SELECT ds, model, SUM(CASE WHEN level_ord = 0 THEN yhat ELSE -yhat END) AS r FROM fc GROUP BY 1, 2), n AS (SELECT COUNT(*) AS b FROM keys),
low AS (SELECT f.unique_id, f.ds, f.model, GREATEST(f.yhat + r.r / (n.b + 1) - 4000000, 0) AS yhat FROM fc f JOIN r ON r.ds = f.ds AND r.model = f.model CROSS JOIN n WHERE f.level_ord = 1)
{OUT} (SELECT s.unique_id, l.ds, l.model, SUM(l.yhat) AS yhat FROM low l JOIN summing s ON s.bottom_id = l.unique_id GROUP BY 1, 2, 3)""")
def mint_sparse_nonneg_clip_2lvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.events(spark, sf_dir)
    # Shifted, so that some bottom values fall below zero.
    shift = p.h.summing.groupBy("unique_id").agg((-4000000.0 * F.sum("weight")).alias("_s"))
    low = p.fcst.join(shift, "unique_id").select("unique_id", *BY, (F.col("yhat") + F.col("_s")).alias("yhat"))
    return result(K.MinTraceSparse("ols", nonnegative=True, qp=False).mean(p.h, low, None, BY))


#: Two crossed keys of five values each, with every pair: effects of rows and columns are apart, so the system is three numbers and means.
@query(f"""WITH {forecasts(CROSSED, 4)}, res AS (SELECT f.unique_id, f.level_ord, f.ds, f.model, f.yhat - b.yhat AS r FROM fc f JOIN bu b ON b.unique_id = f.unique_id AND b.ds = f.ds AND b.model = f.model WHERE f.level_ord < 3),
m AS (SELECT ds, model, MAX(CASE WHEN level_ord = 0 THEN r END) AS rt, AVG(CASE WHEN level_ord = 1 THEN r END) AS mr, AVG(CASE WHEN level_ord = 2 THEN r END) AS ms FROM res GROUP BY 1, 2),
l AS (SELECT ds, model, mr, ms, (rt - (5 * (mr + ms) - rt) / 2) / 50 AS a, ((5 * (mr + ms) - rt) / 50 + (mr - ms) / 5) / 2 AS lr, ((5 * (mr + ms) - rt) / 50 - (mr - ms) / 5) / 2 AS lc FROM m),
lam AS (SELECT r.unique_id, r.ds, r.model, CASE r.level_ord WHEN 0 THEN a WHEN 1 THEN lr + (r - mr) / 10 ELSE lc + (r - ms) / 10 END AS lam, CASE r.level_ord WHEN 0 THEN 25 ELSE 5 END AS w FROM res r JOIN l ON l.ds = r.ds AND l.model = r.model)
{OUT} (SELECT f.unique_id, f.ds, f.model, f.yhat - x.w * x.lam AS yhat FROM fc f JOIN lam x ON x.unique_id = f.unique_id AND x.ds = f.ds AND x.model = f.model
 UNION ALL SELECT f.unique_id, f.ds, f.model, f.yhat + SUM(x.lam) FROM fc f JOIN summing s ON s.bottom_id = f.unique_id JOIN lam x ON x.unique_id = s.unique_id AND x.ds = f.ds AND x.model = f.model GROUP BY f.unique_id, f.ds, f.model, f.yhat)""")
def mint_crossed_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTrace("wls_struct"), demo.crossed)


@query()
def mint_shrink_3lvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTrace("mint_shrink"))


@query()
def mint_nonneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTrace("ols", nonnegative=True))


@query()
def mint_emint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MinTrace("emint"))


@query()
def erm_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.ERM("closed"))


#: The default strength leaves no coefficients beside bottom-up's.
@query(f"WITH {FEVENTS} {OUT} bu")
def erm_reg_bu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.ERM("reg_bu", lambda_reg=None), demo.events)


@query(f"WITH {FGEO} {OUT} bu")
def bottom_up_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.BottomUpSparse())


@query(f"{share_sql(OF_AVERAGES, '0')} {OUT} td")
def top_down_sparse_prop_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.TopDownSparse("proportion_averages"))


@query(f"""{share_sql(AVERAGE, '1')}, m AS (SELECT 'total' AS unique_id, ds, model, SUM(yhat) AS yhat FROM fc WHERE level_ord = 1 GROUP BY 2, 3 UNION ALL SELECT unique_id, ds, model, yhat FROM fc WHERE level_ord = 1
 UNION ALL SELECT t.unique_id, t.ds, t.model, t.yhat FROM td t JOIN nodes n ON n.unique_id = t.unique_id WHERE n.level_ord = 2) {OUT} m""")
def middle_out_sparse_avg_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.MiddleOutSparse("total/region", "average_proportions"))


@query(tree_sql("SELECT DISTINCT model, unique_id, 1.0::DOUBLE AS w FROM fc"))
def optimal_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(spark, sf_dir, K.OptimalCombination("ols"))


#: A total far below its parts: the free ones among them are a prefix by what it takes to make them zero.
@query(f"""WITH {FEVENTS}, w AS (SELECT model, unique_id, SUM(e * e) / COUNT(*) + 2e-8 AS w FROM err GROUP BY 1, 2),
f AS (SELECT f.unique_id, f.ds, f.model, f.level_ord, GREATEST(f.yhat * CASE WHEN f.level_ord = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 0) AS y, w.w FROM fc f JOIN w ON w.unique_id = f.unique_id AND w.model = f.model),
c AS (SELECT *, -y / w AS t FROM f WHERE level_ord = 1),
p AS (SELECT *, SUM(y) OVER o AS sy, SUM(w) OVER o AS sw, LEAD(t) OVER o AS nt FROM c WINDOW o AS (PARTITION BY ds, model ORDER BY t, unique_id)),
l AS (SELECT p.ds, p.model, MAX((f.y - p.sy) / (f.w + p.sw)) AS l FROM p JOIN f ON f.ds = p.ds AND f.model = p.model AND f.level_ord = 0
 WHERE p.t < (f.y - p.sy) / (f.w + p.sw) AND (p.nt IS NULL OR (f.y - p.sy) / (f.w + p.sw) <= p.nt) GROUP BY 1, 2),
b AS (SELECT c.unique_id, c.ds, c.model, GREATEST(c.y + c.w * l.l, 0) AS yhat FROM c JOIN l ON l.ds = c.ds AND l.model = c.model)
{OUT} (SELECT s.unique_id, b.ds, b.model, SUM(b.yhat) AS yhat FROM b JOIN summing s ON s.bottom_id = b.unique_id GROUP BY 1, 2, 3)""")
def mint_nonneg_2lvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.events(spark, sf_dir)
    low = p.fcst.withColumn("yhat", F.when(F.col("unique_id") == "total", F.col("yhat") * 0.3).otherwise(F.col("yhat")))
    return result(K.MinTrace("wls_var", nonnegative=True).mean(p.h, low, p.fitted, BY))


@query()
def mint_nonneg_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    low = p.fcst.withColumn("yhat", F.when(F.col("unique_id") == "total", F.col("yhat") * 0.3).otherwise(F.col("yhat")))
    return result(K.MinTrace("mint_shrink", nonnegative=True).mean(p.h, low, p.fitted, BY))


# Covariances and intervals -------------------------------------------------------------------


@query(f"WITH {FEVENTS}, c AS ({COV}) SELECT model, id1, id2, round(cov / 1e12, 4) AS cov FROM c WHERE id1 <= id2")
def ma_cov_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.masked_covariance(C.errors(demo.events(spark, sf_dir).fitted)).select("model", "id1", "id2", F.round(F.col("cov") / 1e12, 4).alias("cov"))


@query(f"WITH {FEVENTS}, {LAM} SELECT model, round(lam, 6) AS lam FROM lam")
def shrink_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.shrinkage(C.centred(C.errors(demo.events(spark, sf_dir).fitted))).select("model", F.round("lam", 6).alias("lam"))


Z80, Z95 = repr(I.z_of(0.9)), repr(I.z_of(0.975))
SIGMA = f"""bands AS (SELECT *, yhat - 0.10 * abs(yhat) AS lo80, yhat + 0.10 * abs(yhat) AS hi80, yhat - 0.15 * abs(yhat) AS lo95, yhat + 0.15 * abs(yhat) AS hi95 FROM fc),
sg AS (SELECT unique_id, ds, model, GREATEST(((hi80 - lo80) / (2 * {Z80}) + (hi95 - lo95) / (2 * {Z95})) / 2, 0) AS sigma FROM bands)"""


def sigmas(p: demo.Panel) -> DataFrame:
    y, a = F.col("yhat"), F.abs("yhat")
    return p.fcst.select("unique_id", *BY, I.sigma_from_bounds([(80, y - 0.10 * a, y + 0.10 * a), (95, y - 0.15 * a, y + 0.15 * a)]).alias("sigma"))


@query(f"WITH {FGEO}, {SIGMA} SELECT unique_id, ds, model, round(sigma / 1000000.0 + 3.7e-9, 4) AS value FROM sg")
def sigma_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(sigmas(demo.geo(spark, sf_dir)), "sigma")


@query(f"""WITH {FGEO}, {SIGMA}, v AS (SELECT s.unique_id, g.ds, g.model, sqrt(SUM(g.sigma * g.sigma)) AS sd FROM sg g JOIN summing s ON s.bottom_id = g.unique_id GROUP BY 1, 2, 3)
SELECT b.unique_id, b.ds, b.model, round((b.yhat - {Z80} * v.sd) / 1000000.0 + 3.7e-9, 4) AS lo, round((b.yhat + {Z80} * v.sd) / 1000000.0 + 3.7e-9, 4) AS hi FROM bu b JOIN v ON v.unique_id = b.unique_id AND v.ds = b.ds AND v.model = b.model""")
def normality_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    m = K.BottomUp()
    rec = I.normal_quantiles(I.normality(p.h, m, m.mean(p.h, p.fcst, None, BY), sigmas(p), None), I.interval_quantiles([80]))
    return rec.select("unique_id", *BY, F.round(F.col("q")[0] / 1e6 + 3.7e-9, 4).alias("lo"), F.round(F.col("q")[1] / 1e6 + 3.7e-9, 4).alias("hi"))


#: Blocks that the generator draws for 19 (23 less 4) times are fixed by the seed; the panel has 27 quarters, 23 of them in sample.
def starts_sql(n_times: int, horizon: int, n: int, seed: int) -> str:
    return ", ".join(f"({k}, {s})" for k, s in enumerate(I.drawn_starts(n_times, horizon, n, seed)))


TIMES = 19


@query(f"""WITH {FGEO}, o AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS k FROM (SELECT DISTINCT ds FROM err)), hh AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS h FROM (SELECT DISTINCT ds FROM fc)),
st AS (SELECT * FROM (VALUES {starts_sql(TIMES, 4, 50, 0)}) v(sample_id, st)),
sm AS (SELECT f.unique_id, f.ds, f.model, st.sample_id, f.yhat + e.e AS yhat FROM fc f JOIN hh ON hh.ds = f.ds CROSS JOIN st JOIN o ON o.k = st.st + hh.h JOIN err e ON e.ds = o.ds AND e.unique_id = f.unique_id AND e.model = f.model),
rec AS (SELECT s.unique_id, m.ds, m.model, m.sample_id, SUM(m.yhat) AS yhat FROM sm m JOIN summing s ON s.bottom_id = m.unique_id GROUP BY 1, 2, 3, 4)
SELECT unique_id, ds, model, round(quantile_cont(yhat, 0.1) / 1000000.0 + 3.7e-9, 4) AS lo, round(quantile_cont(yhat, 0.9) / 1000000.0 + 3.7e-9, 4) AS hi FROM rec GROUP BY 1, 2, 3""")
def bootstrap_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    q = I.quantiles_of(I.bootstrap_samples(p.h, K.BottomUp(), p.fcst, p.fitted, 50, 0), [0.1, 0.9])
    return q.select("unique_id", *BY, F.round(F.col("q")[0] / 1e6 + 3.7e-9, 4).alias("lo"), F.round(F.col("q")[1] / 1e6 + 3.7e-9, 4).alias("hi"))


@query(f"""WITH {FGEO}, o AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS k FROM (SELECT DISTINCT ds FROM err)), hh AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS h FROM (SELECT DISTINCT ds FROM fc)),
st AS (SELECT * FROM (VALUES {starts_sql(TIMES, 4, 50, 0)}) v(sample_id, st)),
sm AS (SELECT f.unique_id, f.ds, f.model, st.sample_id, f.level_ord, f.yhat + e.e AS yhat FROM fc f JOIN hh ON hh.ds = f.ds CROSS JOIN st JOIN o ON o.k = st.st + hh.h JOIN err e ON e.ds = o.ds AND e.unique_id = f.unique_id AND e.model = f.model),
c AS (SELECT e.parent_id, m.*, m.yhat / SUM(m.yhat) OVER (PARTITION BY e.parent_id, m.ds, m.model, m.sample_id) AS share FROM sm m JOIN edges e ON e.child_id = m.unique_id),
r0 AS (SELECT unique_id, ds, model, sample_id, yhat FROM sm WHERE level_ord = 0),
r1 AS (SELECT c.unique_id, c.ds, c.model, c.sample_id, c.share * r.yhat AS yhat FROM c JOIN r0 r ON r.unique_id = c.parent_id AND r.ds = c.ds AND r.model = c.model AND r.sample_id = c.sample_id WHERE c.level_ord = 1),
r2 AS (SELECT c.unique_id, c.ds, c.model, c.sample_id, c.share * r.yhat AS yhat FROM c JOIN r1 r ON r.unique_id = c.parent_id AND r.ds = c.ds AND r.model = c.model AND r.sample_id = c.sample_id WHERE c.level_ord = 2)
SELECT unique_id, ds, model, round(quantile_cont(yhat, 0.1) / 1000000.0 + 3.7e-9, 4) AS lo, round(quantile_cont(yhat, 0.9) / 1000000.0 + 3.7e-9, 4) AS hi FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1, 2, 3""")
def bootstrap_top_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    q = I.quantiles_of(I.bootstrap_samples(p.h, K.TopDown("forecast_proportions"), p.fcst, p.fitted, 50, 0), [0.1, 0.9])
    return q.select("unique_id", *BY, F.round(F.col("q")[0] / 1e6 + 3.7e-9, 4).alias("lo"), F.round(F.col("q")[1] / 1e6 + 3.7e-9, 4).alias("hi"))


SCORES = "sc AS (SELECT f.unique_id, f.model, f.ds, f.y - b.yhat AS score FROM fit f JOIN bufit b ON b.unique_id = f.unique_id AND b.ds = f.ds AND b.model = f.model)"


@query(f"""WITH {FGEO}, {SCORES}, q AS (SELECT unique_id, model, quantile_cont(score, 0.1) AS a, quantile_cont(score, 0.9) AS b FROM sc GROUP BY 1, 2)
SELECT u.unique_id, u.ds, u.model, round((u.yhat + q.a) / 1000000.0 + 3.7e-9, 4) AS lo, round((u.yhat + q.b) / 1000000.0 + 3.7e-9, 4) AS hi FROM bu u JOIN q ON q.unique_id = u.unique_id AND q.model = u.model""")
def conformal_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    m = K.BottomUp()
    rec = I.conformal(p.h, m, m.mean(p.h, p.fcst, None, BY), p.fitted, [0.1, 0.9])
    return rec.select("unique_id", *BY, F.round(F.col("q")[0] / 1e6 + 3.7e-9, 4).alias("lo"), F.round(F.col("q")[1] / 1e6 + 3.7e-9, 4).alias("hi"))


@query(f"""WITH {FGEO}, {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id, model ORDER BY score) - 1 AS k, COUNT(*) OVER (PARTITION BY unique_id, model) AS n FROM sc),
q AS (SELECT unique_id, model, MAX(CASE WHEN k = LEAST(GREATEST(floor((n + 1) * ((1 - 80 / 100.0::DOUBLE) / 2)), 0), n - 1) THEN score END) AS a, MAX(CASE WHEN k = LEAST(GREATEST(ceil((n + 1) * (1 - (1 - 80 / 100.0::DOUBLE) / 2)) - 1, 0), n - 1) THEN score END) AS b FROM r GROUP BY 1, 2)
SELECT u.unique_id, u.ds, u.model, round((u.yhat + q.a) / 1000000.0 + 3.7e-9, 4) AS lo, round((u.yhat + q.b) / 1000000.0 + 3.7e-9, 4) AS hi FROM bu u JOIN q ON q.unique_id = u.unique_id AND q.model = u.model""")
def conformal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    m = K.BottomUp()
    rec = I.conformal_levels(I.conformal_scores(p.h, m, p.fitted), m.mean(p.h, p.fcst, None, BY), 80)
    return rec.select("unique_id", *BY, million("lo").alias("lo"), million("hi").alias("hi"))


@query(f"""WITH {ORDERS}, s AS (SELECT nation AS unique_id, ds, y FROM rows_)
SELECT unique_id, ds, round(AVG(y) / 1000000.0 + 3.7e-9, 4) AS m, round(quantile_cont(y, 0.5) / 1000000.0 + 3.7e-9, 4) AS "m-median", round(quantile_cont(y, 0.1) / 1000000.0 + 3.7e-9, 4) AS "m-lo-80", round(quantile_cont(y, 0.9) / 1000000.0 + 3.7e-9, 4) AS "m-hi-80" FROM s GROUP BY 1, 2""")
def samples_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.order_rows(spark, sf_dir).select(F.col("nation").alias("unique_id"), "ds", F.lit(0).alias("sample_id"), F.col("y").cast("double").alias("yhat"))
    wide = I.samples_to_quantiles(rows, level=[80], model="m")
    return wide.select("unique_id", "ds", *(F.round(F.col(f"`{c}`") / 1e6 + 3.7e-9, 4).alias(c) for c in wide.columns[2:]))


@query()
def permbu_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    m = K.BottomUp()
    rec = m.mean(p.h, p.fcst, None, BY)
    q = I.quantiles_of(I.permbu_samples(p.h, rec, sigmas(p), p.fitted, 100), [0.1, 0.9])
    return q.select("unique_id", *BY, F.round(F.col("q")[0] / 1e6 + 3.7e-9, 4).alias("lo"), F.round(F.col("q")[1] / 1e6 + 3.7e-9, 4).alias("hi"))


SHRUNK = f"""cov AS ({COV}), {LAM}, ww AS (SELECT c.model, c.id1, c.id2, CASE WHEN c.id1 = c.id2 THEN GREATEST(c.cov, 2e-8) ELSE (1 - l.lam) * c.cov END AS w FROM cov c JOIN lam l ON l.model = c.model),
cr AS (SELECT a.model, a.id1, a.id2, CASE WHEN a.id1 = a.id2 THEN 1.0 ELSE a.w / sqrt(x.w * y.w) END AS r FROM ww a JOIN ww x ON x.model = a.model AND x.id1 = a.id1 AND x.id2 = a.id1 JOIN ww y ON y.model = a.model AND y.id1 = a.id2 AND y.id2 = a.id2)"""
BANDS = f"round((yhat - {Z80} * sd) / 1000000.0 + 3.7e-9, 4) AS lo, round((yhat + {Z80} * sd) / 1000000.0 + 3.7e-9, 4) AS hi"


def banded(p: demo.Panel, method: K.Method, correlation: str | None = None) -> DataFrame:
    made = method.fit(p.h, p.fcst, p.fitted)
    rec = I.normal_quantiles(I.normality(p.h, made, made.predict(p.fcst), sigmas(p), p.fitted, correlation), I.interval_quantiles([80]))
    return rec.select("unique_id", *BY, F.round(F.col("q")[0] / 1e6 + 3.7e-9, 4).alias("lo"), F.round(F.col("q")[1] / 1e6 + 3.7e-9, 4).alias("hi"))


@query(f"WITH {FEVENTS}, {SHRUNK} SELECT model, id1, id2, round(r, 6) AS r FROM cr WHERE id1 <= id2")
def correlation_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.correlations(demo.events(spark, sf_dir).fitted, "shrink").select("model", "id1", "id2", F.round("r", 6).alias("r"))


@query(f"""WITH {FEVENTS}, {SHRUNK}, {SIGMA}, u AS (SELECT unique_id, CASE WHEN level_ord = 0 THEN 1 ELSE -1 END AS u FROM nodes),
wu AS (SELECT w.model, w.id1 AS unique_id, SUM(w.w * u.u) AS wu FROM ww w JOIN u ON u.unique_id = w.id2 GROUP BY 1, 2), k AS (SELECT wu.model, SUM(wu.wu * u.u) AS k FROM wu JOIN u ON u.unique_id = wu.unique_id GROUP BY 1),
r AS (SELECT f.ds, f.model, SUM(f.yhat * u.u) AS r FROM fc f JOIN u ON u.unique_id = f.unique_id GROUP BY 1, 2),
cu AS (SELECT a.unique_id, a.ds, a.model, SUM(c.r * a.sigma * b.sigma * u.u) AS cu FROM sg a JOIN cr c ON c.model = a.model AND c.id1 = a.unique_id JOIN sg b ON b.unique_id = c.id2 AND b.ds = a.ds AND b.model = a.model JOIN u ON u.unique_id = c.id2 GROUP BY 1, 2, 3),
uu AS (SELECT cu.ds, cu.model, SUM(cu.cu * u.u) AS uu FROM cu JOIN u ON u.unique_id = cu.unique_id GROUP BY 1, 2),
o AS (SELECT f.unique_id, f.ds, f.model, f.yhat - wu.wu / k.k * r.r AS yhat, sqrt(s.sigma * s.sigma - 2 * wu.wu / k.k * cu.cu + (wu.wu / k.k) ** 2 * uu.uu) AS sd FROM fc f JOIN wu ON wu.unique_id = f.unique_id AND wu.model = f.model JOIN k ON k.model = f.model
 JOIN r ON r.ds = f.ds AND r.model = f.model JOIN sg s ON s.unique_id = f.unique_id AND s.ds = f.ds AND s.model = f.model JOIN cu ON cu.unique_id = f.unique_id AND cu.ds = f.ds AND cu.model = f.model JOIN uu ON uu.ds = f.ds AND uu.model = f.model)
SELECT unique_id, ds, model, {BANDS} FROM o""")
def normality_mint_shrink_2lvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(demo.events(spark, sf_dir), K.MinTrace("mint_shrink"), "shrink")


@query(f"""WITH {FEVENTS}, {SIGMA}, n AS (SELECT COUNT(*) AS b FROM keys), r AS (SELECT f.ds, f.model, SUM(CASE WHEN f.level_ord = 0 THEN f.yhat ELSE -f.yhat END) AS r, SUM(s.sigma * s.sigma) AS v FROM fc f JOIN sg s ON s.unique_id = f.unique_id AND s.ds = f.ds AND s.model = f.model GROUP BY 1, 2),
o AS (SELECT f.unique_id, f.ds, f.model, f.yhat - CASE WHEN f.level_ord = 0 THEN 1 ELSE -1 END * r.r / (n.b + 1) AS yhat, sqrt(s.sigma * s.sigma * (1 - 2.0::DOUBLE / (n.b + 1)) + r.v / ((n.b + 1) * (n.b + 1))) AS sd
 FROM fc f JOIN sg s ON s.unique_id = f.unique_id AND s.ds = f.ds AND s.model = f.model JOIN r ON r.ds = f.ds AND r.model = f.model CROSS JOIN n)
SELECT unique_id, ds, model, {BANDS} FROM o""")
def normality_ols_2lvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(demo.events(spark, sf_dir), K.MinTrace("ols"))


@query(f"""{share_sql(AVERAGE, '0')}, {SIGMA}, ts AS (SELECT s.unique_id, g.ds, g.model, SUM(sh.p) * g.sigma AS sd FROM sh JOIN summing s ON s.bottom_id = sh.bottom_id JOIN sg g ON g.unique_id = sh.root_id GROUP BY s.unique_id, g.ds, g.model, g.sigma)
SELECT t.unique_id, t.ds, t.model, {BANDS} FROM td t JOIN ts ON ts.unique_id = t.unique_id AND ts.ds = t.ds AND ts.model = t.model""")
def normality_top_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(demo.geo(spark, sf_dir), K.TopDown("average_proportions"))


@query()
def normality_mint_shrink_3lvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(demo.geo(spark, sf_dir), K.MinTrace("mint_shrink"), "shrink")


@query(f"""WITH {FGEO}, o AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS ordinal FROM (SELECT DISTINCT ds FROM err))
SELECT model, unique_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(row_number() OVER (PARTITION BY model, unique_id ORDER BY e, ordinal) - 1 AS INTEGER) AS rank FROM err JOIN o USING (ds)""")
def residual_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.residual_rows(demo.geo(spark, sf_dir).fitted)
    return I.ranks_of(rows, ["model", "unique_id"], "ordinal").select("model", "unique_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("rank").cast("int").alias("rank"))


# Evaluation ----------------------------------------------------------------------------------


@query(f"WITH {FGEO} {OUT} (SELECT f.unique_id, f.ds, f.model, f.yhat - b.yhat AS yhat FROM fc f JOIN bu b ON b.unique_id = f.unique_id AND b.ds = f.ds AND b.model = f.model)")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    return result(coherence_residual(p.h, p.fcst, BY), "residual")


@query(f"""WITH {FGEO}, lv AS (SELECT level, unique_id FROM nodes UNION ALL SELECT 'Overall', unique_id FROM nodes),
x AS (SELECT lv.level, f.model, f.yhat AS y0, b.yhat AS y1, f.yhat - b.yhat AS r0 FROM fc f JOIN bu b ON b.unique_id = f.unique_id AND b.ds = f.ds AND b.model = f.model JOIN lv ON lv.unique_id = f.unique_id),
g AS (SELECT level, model, AVG(abs(r0)) AS a1, sqrt(AVG(r0 * r0)) AS a2, AVG(abs(y1 - y0)) AS a3, sqrt(AVG((y1 - y0) ** 2)) AS a4, MAX(abs(y1 - y0)) AS a5, AVG(y1 - y0) AS a6 FROM x GROUP BY 1, 2)
SELECT level, model, metric, round(v / 1000000.0 + 3.7e-9, 4) AS value FROM (
 SELECT level, model, 'coherence_residual_mae_before' AS metric, a1 AS v FROM g UNION ALL SELECT level, model, 'coherence_residual_rmse_before', a2 FROM g UNION ALL SELECT level, model, 'adjustment_mae', a3 FROM g
 UNION ALL SELECT level, model, 'adjustment_rmse', a4 FROM g UNION ALL SELECT level, model, 'adjustment_max', a5 FROM g UNION ALL SELECT level, model, 'adjustment_mean', a6 FROM g
 UNION ALL SELECT level, model, m, 0 FROM g CROSS JOIN (SELECT unnest(['coherence_residual_mae_after', 'coherence_residual_rmse_after', 'negative_count_before', 'negative_count_after', 'negative_introduced', 'negative_removed']) AS m)
 UNION ALL SELECT level, model, 'is_coherent', 1000000 FROM g WHERE level = 'Overall' UNION ALL SELECT level, model, 'coherence_max_violation', 0 FROM g WHERE level = 'Overall')""")
def diagnostics_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    told = E.diagnostics(p.h, p.fcst, K.BottomUp().mean(p.h, p.fcst, None, BY), atol=1e-2)
    value = F.when(F.col("metric") == "is_coherent", F.col("value") * 1e6).otherwise(F.col("value"))
    return told.select("level", "model", "metric", F.round(value / 1e6 + 3.7e-9, 4).alias("value"))


def scored_frame(p: demo.Panel) -> DataFrame:
    return p.fcst.join(p.test.select("unique_id", "ds", F.col("y").cast("double").alias("y")), ["unique_id", "ds"])


LEVELS = "lv AS (SELECT level, unique_id FROM nodes UNION ALL SELECT 'Overall', unique_id FROM nodes), ev AS (SELECT f.unique_id, f.ds, f.model, f.yhat, t.y::DOUBLE AS y FROM fc f JOIN test t ON t.unique_id = f.unique_id AND t.ds = f.ds)"
SCALE = "df AS (SELECT unique_id, y - lag(y, 4) OVER (PARTITION BY unique_id ORDER BY ds) AS d FROM train), scl AS (SELECT unique_id, AVG(abs(d)) AS a, AVG(d::DOUBLE * d) AS s FROM df GROUP BY 1)"


@query(f"""WITH {FGEO}, {LEVELS}, p AS (SELECT unique_id, model, AVG(abs(y - yhat)) AS a, AVG((y - yhat) ** 2) AS b FROM ev GROUP BY 1, 2)
SELECT lv.level, m.metric, p.model, round(AVG(CASE m.metric WHEN 'mae' THEN a / 1e6 WHEN 'rmse' THEN sqrt(b) / 1e6 ELSE b / 1e12 END), 4) AS value FROM p JOIN lv ON lv.unique_id = p.unique_id CROSS JOIN (SELECT unnest(['mae', 'mse', 'rmse']) AS metric) m GROUP BY 1, 2, 3""")
def eval_mae_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    found = E.evaluate(scored_frame(p), [M.mae(), M.mse(), M.rmse()], p.h)
    return found.select("level", "metric", "model", F.round(F.col("value") / F.when(F.col("metric") == "mse", 1e12).otherwise(1e6), 4).alias("value"))


def scaled_sql(value: str, metric: str) -> str:
    return f"""WITH {FGEO}, {LEVELS}, {SCALE}, p AS (SELECT e.unique_id, e.model, {value} AS v FROM ev e JOIN scl c ON c.unique_id = e.unique_id GROUP BY 1, 2)
SELECT lv.level, '{metric}' AS metric, p.model, round(AVG(v), 6) AS value FROM p JOIN lv ON lv.unique_id = p.unique_id GROUP BY 1, 3"""


def scaled(spark: SparkSession, sf_dir: str, metric: M.Metric) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    return E.evaluate(scored_frame(p), [metric], p.h, train=p.train).withColumn("value", F.round("value", 6))


@query(scaled_sql("AVG(abs(e.y - e.yhat)) / MIN(c.a)", "mase"))
def eval_mase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, M.mase(4))


@query(scaled_sql("AVG((e.y - e.yhat) ** 2) / MIN(c.s)", "msse"))
def eval_msse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, M.msse(4))


@query(scaled_sql("sqrt(AVG((e.y - e.yhat) ** 2) / MIN(c.s))", "rmsse"))
def eval_rmsse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, M.rmsse(4))


@query(f"""WITH {FGEO}, {LEVELS}, {SIGMA}, q AS (SELECT e.unique_id, e.ds, e.model, e.y, e.y - (e.yhat - {Z80} * g.sigma) AS a, e.y - (e.yhat + {Z80} * g.sigma) AS b FROM ev e JOIN sg g ON g.unique_id = e.unique_id AND g.ds = e.ds AND g.model = e.model),
p AS (SELECT unique_id, model, 2 * (SUM(GREATEST(0.1::DOUBLE * a, (0.1::DOUBLE - 1) * a)) + SUM(GREATEST(0.9::DOUBLE * b, (0.9::DOUBLE - 1) * b))) / 2 / SUM(abs(y)) AS v FROM q GROUP BY 1, 2)
SELECT lv.level, 'scaled_crps' AS metric, p.model, round(AVG(v), 6) AS value FROM p JOIN lv ON lv.unique_id = p.unique_id GROUP BY 1, 3""")
def eval_scaled_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    rows = I.normal_quantiles(scored_frame(p).join(sigmas(p), ["unique_id", *BY]), [0.1, 0.9])
    return E.evaluate(rows, [M.scaled_crps([0.1, 0.9])], p.h).withColumn("value", F.round("value", 6))


@query(f"""WITH {FGEO}, {LEVELS}, p AS (SELECT unique_id, model, AVG(abs(y - yhat)) AS a FROM ev GROUP BY 1, 2), g AS (SELECT lv.level, p.model, AVG(a) AS a FROM p JOIN lv ON lv.unique_id = p.unique_id GROUP BY 1, 2)
SELECT g.level, 'mae-scaled' AS metric, g.model, round(g.a / b.a, 6) AS value FROM g JOIN g b ON b.level = g.level AND b.model = 'naive'""")
def eval_benchmark_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    return E.evaluate(scored_frame(p), [M.mae()], p.h, benchmark="naive").withColumn("value", F.round("value", 6))


@query(f"WITH {FGEO} SELECT n.level, CAST(n.level_ord AS INTEGER) AS level_ord, f.ds, round(SUM(CASE WHEN model = 'naive' THEN yhat END) / 1000000.0 + 3.7e-9, 4) AS naive, round(SUM(CASE WHEN model = 'snaive' THEN yhat END) / 1000000.0 + 3.7e-9, 4) AS snaive FROM fc f JOIN nodes n ON n.unique_id = f.unique_id GROUP BY 1, 2, 3")
def plot_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    wide = p.fcst.groupBy("unique_id", "ds").pivot("model", ["naive", "snaive"]).agg(F.first("yhat"))
    gap = HierarchicalPlot(p.h).predictions_gap(wide, ["naive", "snaive"])
    return gap.select("level", "level_ord", "ds", million("naive").alias("naive"), million("snaive").alias("snaive"))


@query(f"WITH {GEO}, b AS (SELECT MIN(bottom_id) AS b FROM summing) SELECT p.unique_id, p.ds, p.y, n.level FROM panel p JOIN summing s ON s.unique_id = p.unique_id JOIN b ON s.bottom_id = b.b JOIN nodes n ON n.unique_id = p.unique_id")
def linked_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, h = A.aggregate(demo.dense(demo.order_rows(spark, sf_dir), demo.GEO[-1]), demo.GEO, check=False)
    first = h.summing.agg(F.min("bottom_id")).first()[0]
    return HierarchicalPlot(h).linked_series(panel, first).select("unique_id", "ds", "y", "level")


def wide_panel(p: demo.Panel) -> tuple[DataFrame, DataFrame]:
    wide = lambda df, *keep: df.groupBy("unique_id", "ds", *keep).pivot("model", ["naive", "snaive"]).agg(F.first("yhat"))
    return wide(p.fcst), wide(p.fitted, "y")


WIDE_BANDS = ", ".join(f"""round(MAX(CASE WHEN model = '{m}' THEN {c} END) / 1000000.0 + 3.7e-9, 4) AS "{m}/BottomUp{n}\"""" for m in ("naive", "snaive") for c, n in (("yhat", ""), ("lo", "-lo-80"), ("hi", "-hi-80")))


def in_millions(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(f"`{c}`") / 1e6 + 3.7e-9, 4).alias(c) for c in df.columns if "/" in c))


@query(f"""WITH {FGEO}, {SCORES}, q AS (SELECT unique_id, model, quantile_cont(score, 0.1) AS a, quantile_cont(score, 0.9) AS b FROM sc GROUP BY 1, 2),
o AS (SELECT u.unique_id, u.ds, u.model, u.yhat, u.yhat + q.a AS lo, u.yhat + q.b AS hi FROM bu u JOIN q ON q.unique_id = u.unique_id AND q.model = u.model)
SELECT unique_id, ds, {WIDE_BANDS} FROM o GROUP BY 1, 2""")
def wide_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    y_hat, y = wide_panel(p)
    return in_millions(HierarchicalReconciliation([K.BottomUp()]).reconcile(y_hat, p.h, y, level=[80], intervals_method="conformal"), ["unique_id", "ds"])


def seed_sql(seed: int) -> str:
    return f"""sm{seed} AS (SELECT f.unique_id, f.ds, f.model, st.sample_id, f.yhat + e.e AS yhat FROM fc f JOIN hh ON hh.ds = f.ds CROSS JOIN (VALUES {starts_sql(TIMES, 4, 200, seed)}) st(sample_id, st) JOIN o ON o.k = st.st + hh.h JOIN err e ON e.ds = o.ds AND e.unique_id = f.unique_id AND e.model = f.model),
rec{seed} AS (SELECT s.unique_id, m.ds, m.model, m.sample_id, SUM(m.yhat) AS yhat FROM sm{seed} m JOIN summing s ON s.bottom_id = m.unique_id GROUP BY 1, 2, 3, 4),
b{seed} AS (SELECT unique_id, ds, model, {seed} AS seed, round(quantile_cont(yhat, 0.1) / 1000000.0 + 3.7e-9, 4) AS lo, round(quantile_cont(yhat, 0.9) / 1000000.0 + 3.7e-9, 4) AS hi FROM rec{seed} GROUP BY 1, 2, 3)"""


@query(f"""WITH {FGEO}, o AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS k FROM (SELECT DISTINCT ds FROM err)), hh AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS h FROM (SELECT DISTINCT ds FROM fc)),
{seed_sql(0)}, {seed_sql(1)} SELECT * FROM b0 UNION ALL SELECT * FROM b1""")
def bootstrap_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    y_hat, y = wide_panel(p)
    out = HierarchicalReconciliation([K.BottomUp()]).bootstrap_reconcile(y_hat, p.h, y, num_seeds=2, level=[80], intervals_method="bootstrap")
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"`{m}/BottomUp-lo-80`").alias("lo"), F.col(f"`{m}/BottomUp-hi-80`").alias("hi")) for m in ("naive", "snaive")))).alias("m")
    return out.select("unique_id", "ds", "seed", models).select("unique_id", "ds", "m.model", "seed", million("m.lo").alias("lo"), million("m.hi").alias("hi"))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers written as CSV to the shared folder and read again."""
    rows = frames.read_parquet(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    frames.write_csv(rows, path)
    return frames.read_csv(spark, path, rows.schema)


@query(ORACLES["tags_levels"])
def saved_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of a hierarchy that was saved and loaded again."""
    path = f"{shared_folder(spark)}/hierarchy-{uuid.uuid4().hex}"
    frames.save_hierarchy(demo.geo(spark, sf_dir).h, path)
    return frames.load_hierarchy(spark, path).nodes


@query()
def reconcile_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    y_hat, y = wide_panel(p)
    engine = HierarchicalReconciliation([K.BottomUp(), K.TopDown("average_proportions"), K.MinTrace("wls_var")])
    return engine.reconcile(y_hat, p.h, y, level=[80], intervals_method="conformal")


@query()
def bootstrap_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo.geo(spark, sf_dir)
    y_hat, y = wide_panel(p)
    return HierarchicalReconciliation([K.BottomUp()]).bootstrap_reconcile(y_hat, p.h, y, num_seeds=2, level=[80], intervals_method="bootstrap")


@query(f"""WITH {ORDERS}, keys AS (SELECT DISTINCT nation FROM rows_), times AS (SELECT DISTINCT ds FROM rows_),
q AS (SELECT k.nation AS unique_id, t.ds, CAST(COALESCE(SUM(r.y), 0) AS BIGINT) AS y FROM keys k CROSS JOIN times t LEFT JOIN rows_ r ON r.nation = k.nation AND r.ds = t.ds GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS k FROM q) SELECT unique_id, l.level || '-' || CAST((k - 1) // m + 1 AS VARCHAR) AS temporal_id, round(SUM(y * 1.02::DOUBLE) / 1000000.0 + 3.7e-9, 4) AS value FROM f CROSS JOIN (VALUES ('year', 4), ('semiannual', 2), ('quarter', 1)) l(level, m) GROUP BY 1, 2""")
def temporal_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = demo.dense(demo.order_rows(spark, sf_dir), ["nation"]).withColumnRenamed("nation", "unique_id")
    y, h = A.aggregate_temporal(every, SPEC)
    factor = F.when(F.col("temporal_id").startswith("quarter"), 1.02).otherwise(1.1)
    fcst = y.select("unique_id", "temporal_id", "ds", (F.col("y") * factor).alias("m"))
    done = HierarchicalReconciliation([K.BottomUp()]).reconcile(fcst, h, temporal=True)
    return done.select("unique_id", "temporal_id", F.round(F.col("`m/BottomUp`") / 1e6 + 3.7e-9, 4).alias("value"))


__all__ = ["ORACLES", "QUERIES"]
