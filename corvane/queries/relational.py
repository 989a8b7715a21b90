"""The same shapes over relational tables of volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.model import Tables
from corvane.operators import analytics
from corvane.queries import query


@query(
    """WITH l AS (SELECT o_custkey AS key, CAST(epoch(o_orderdate) AS BIGINT) AS secs, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT o_custkey AS key, CAST(epoch(o_orderdate) AS BIGINT) AS secs, o_orderkey AS tag FROM orders WHERE o_orderstatus = 'O'),
    m AS (SELECT l.*, r.tag, row_number() OVER (PARTITION BY l.id ORDER BY r.secs DESC, r.tag DESC) AS n FROM l LEFT JOIN r ON l.key = r.key AND r.secs <= l.secs)
    SELECT key, secs, id, coalesce(tag, -1) AS tag FROM m WHERE n = 1"""
)
def asof_orders(t: Tables) -> DataFrame:
    secs = F.unix_timestamp("o_orderdate").alias("secs")
    of = lambda state, name: t.orders.where(F.col("o_orderstatus") == state).select(F.col("o_custkey").alias("key"), secs, F.col("o_orderkey").alias(name))
    return analytics.asof_backward(of("F", "id"), of("O", "tag"), "key", "secs").fillna(-1, ["tag"])


@query(
    """SELECT * FROM (SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"""
)
def topk_per_customer(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"), rank.alias("rank")).where("rank <= 3")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def anti_customers(t: Tables) -> DataFrame:
    open_ = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(open_, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')")
def semi_returning_customers(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    buyers = t.orders.join(returned, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(buyers, "c_custkey", "left_semi").select("c_custkey")


@query(
    """SELECT coalesce(r_name, 'all') AS region, coalesce(n_name, 'all') AS nation, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""
)
def supplier_rollup(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance")).select(
        F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "suppliers", "balance"
    )


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(t: Tables) -> DataFrame:
    return t.lineitem.where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("SELECT l_partkey % 50 AS bucket, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1")
def price_percentiles(t: Tables) -> DataFrame:
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY l_extendedprice)")
    return t.lineitem.groupBy((F.col("l_partkey") % 50).alias("bucket")).agg(p(0.5).alias("p50"), p(0.95).alias("p95"))
