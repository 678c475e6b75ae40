"""The relational operators that spatial queries stand on, over the driver's tables, beside their SQL.

Spark provides all of these; the queries pin down the semantics that the workload relies on (nulls last, residual join
conditions, array unnesting, guarded division, set operations) and serve as templates.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


def _t(spark, sf_dir, *names):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def rel_filter_project(spark, sf_dir):
    (line,) = _t(spark, sf_dir, "lineitem")
    return line.where("l_discount >= 0.05 AND l_quantity < 24").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("price"))


def rel_equi_join(spark, sf_dir):
    orders, customer = _t(spark, sf_dir, "orders", "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


def rel_join_with_inequality(spark, sf_dir):
    """Pairs of suppliers of one nation, each once: the residual is part of the join."""
    (s,) = _t(spark, sf_dir, "supplier")
    a, b = (s.select(F.col("s_suppkey").alias(f"key_{n}"), F.col("s_nationkey").alias(f"nation_{n}")) for n in (1, 2))
    return a.join(b, (F.col("nation_1") == F.col("nation_2")) & (F.col("key_1") < F.col("key_2"))).select("key_1", "key_2")


def rel_left_join(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    spent = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return customer.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


def rel_semi_join(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    return customer.join(orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def rel_anti_join(spark, sf_dir):
    """Customers without a large order."""
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    return customer.join(orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def rel_full_join(spark, sf_dir):
    """Both sides have keys that the other lacks: customers without a large order, and suppliers beyond them."""
    customer, supplier = _t(spark, sf_dir, "customer", "supplier")
    a = customer.where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    b = supplier.where("s_acctbal > 0").select("s_suppkey", "s_acctbal")
    return a.join(b, F.col("c_custkey") == F.col("s_suppkey"), "full")


def rel_cross_join(spark, sf_dir):
    """Two dimension tables whose sizes do not grow."""
    region, nation = _t(spark, sf_dir, "region", "nation")
    return region.crossJoin(nation).select("r_name", "n_name")


def rel_aggregate_having(spark, sf_dir):
    (line,) = _t(spark, sf_dir, "lineitem")
    g = line.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))
    return g.where("n > 10")


def rel_collect_and_unnest(spark, sf_dir):
    (nation,) = _t(spark, sf_dir, "nation")
    g = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return g.select("n_regionkey", F.posexplode("names").alias("pos", "n_name"))


def rel_window_top_n(spark, sf_dir):
    (orders,) = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def rel_top_k(spark, sf_dir):
    (orders,) = _t(spark, sf_dir, "orders")
    return orders.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


def rel_union_all(spark, sf_dir):
    customer, supplier = _t(spark, sf_dir, "customer", "supplier")
    return customer.select(F.col("c_nationkey").alias("nation")).unionAll(supplier.select("s_nationkey")).groupBy("nation").agg(F.count("*").alias("n"))


def rel_intersect(spark, sf_dir):
    customer, supplier = _t(spark, sf_dir, "customer", "supplier")
    return customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(supplier.select("s_nationkey"))


def rel_except(spark, sf_dir):
    """Customers without a large order."""
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    return customer.select(F.col("c_custkey").alias("key")).subtract(orders.where("o_totalprice > 300000").select("o_custkey"))


def rel_rollup(spark, sf_dir):
    (line,) = _t(spark, sf_dir, "lineitem")
    g = line.rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    return g.select("l_returnflag", "l_linestatus", "level", "n", "qty")


def rel_cube(spark, sf_dir):
    (orders,) = _t(spark, sf_dir, "orders")
    g = orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return g.select("o_orderstatus", "o_orderpriority", "n")


def rel_grouping_sets(spark, sf_dir):
    (orders,) = _t(spark, sf_dir, "orders")
    g = orders.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return g.select("o_orderstatus", "o_orderpriority", "n")


def rel_distinct(spark, sf_dir):
    (line,) = _t(spark, sf_dir, "lineitem")
    return line.select("l_returnflag", "l_linestatus", "l_tax").distinct()


def rel_window_frames(spark, sf_dir):
    """Running sums, a moving extreme, neighbours and quartiles of each customer's orders."""
    (orders,) = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = lambda a, b: w.rowsBetween(a, b)
    return orders.select("o_orderkey", F.count("*").over(rows(Window.unboundedPreceding, 0)).alias("so_far"), F.max("o_totalprice").over(rows(-2, 0)).alias("high"),
                         F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"), F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(w).alias("nth"))


def rel_interval_join(spark, sf_dir):
    """Lines shipped within three days after their order: equality bounds the pairs, the interval is the residual."""
    orders, line = _t(spark, sf_dir, "orders", "lineitem")
    near = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS"))
    return orders.join(line, near).select("o_orderkey", "l_linenumber")


def rel_as_of_join(spark, sf_dir):
    """For each line its order's customer's latest earlier order: one window over both tables, no pairs."""
    (orders,) = _t(spark, sf_dir, "orders")
    large = orders.where("o_totalprice > 200000").select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("large_key"), F.lit(None).cast("bigint").alias("o_orderkey"))
    both = large.unionByName(orders.select("o_custkey", F.col("o_orderdate").alias("at"), F.lit(None).cast("bigint").alias("large_key"), "o_orderkey"))
    w = Window.partitionBy("o_custkey").orderBy("at", F.col("o_orderkey").asc_nulls_first(), "large_key").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("large_key", F.last("large_key", ignorenulls=True).over(w)).where("o_orderkey is not null").select("o_orderkey", "large_key")


def rel_scalar_subquery(spark, sf_dir):
    part, = _t(spark, sf_dir, "part")
    mean = part.agg(F.round(F.avg("p_retailprice"), 2).alias("mean"))
    return part.crossJoin(F.broadcast(mean)).where("p_retailprice > mean").select("p_partkey")


def rel_case_and_guarded_division(spark, sf_dir):
    (line,) = _t(spark, sf_dir, "lineitem")
    ratio = F.round(F.col("l_extendedprice") / F.expr("nullif(l_tax, 0D)"), 4)
    return line.select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") == 0, "free").when(F.col("l_tax") < 0.04, "low").otherwise("high").alias("band"), ratio.alias("ratio"))


def rel_months_and_durations(spark, sf_dir):
    (orders,) = _t(spark, sf_dir, "orders")
    return orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("rel_")}

SQL = {
    "rel_filter_project": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS price FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24",
    "rel_equi_join": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
    "rel_join_with_inequality": "SELECT a.s_suppkey AS key_1, b.s_suppkey AS key_2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "rel_left_join": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "rel_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "rel_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "rel_full_join": "SELECT c_custkey, c_acctbal, s_suppkey, s_acctbal FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON c_custkey = s_suppkey",
    "rel_cross_join": "SELECT r_name, n_name FROM region, nation",
    "rel_aggregate_having": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10",
    "rel_collect_and_unnest": "SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS pos, n_name FROM nation",
    "rel_window_top_n": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3",
    "rel_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50",
    "rel_union_all": "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    "rel_intersect": "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier",
    "rel_except": "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    "rel_rollup": "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::INT AS level, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rel_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "rel_distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem",
    "rel_window_frames": """SELECT o_orderkey, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far, max(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS high,
  lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next, ntile(4) OVER w::INT AS quarter, dense_rank() OVER w::INT AS nth
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "rel_interval_join": "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 3 DAY",
    "rel_as_of_join": """SELECT o.o_orderkey, (SELECT max_by(l.o_orderkey, (l.o_orderdate, l.o_orderkey)) FROM orders l
  WHERE l.o_custkey = o.o_custkey AND l.o_totalprice > 200000 AND l.o_orderdate <= o.o_orderdate) AS large_key FROM orders o""",
    "rel_scalar_subquery": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT round(avg(p_retailprice), 2) FROM part)",
    "rel_case_and_guarded_division": "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'free' WHEN l_tax < 0.04 THEN 'low' ELSE 'high' END AS band, round(l_extendedprice / nullif(l_tax, 0), 4) AS ratio FROM lineitem",
    "rel_months_and_durations": "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1",
}
