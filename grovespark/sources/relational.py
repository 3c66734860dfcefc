"""Trees from key references: customer, its orders, their line items.

The canonical node table has a row a node: ``node_id`` is the pre-order rank,
``last_desc`` the last rank below, so subtrees are intervals and their size is
``last_desc - node_id + 1``; children sit at (``prop_idx``, ``child_idx``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovespark.plans.state import broadcast_as_measured

NODE_COLUMNS = ["tree_id", "node_id", "parent_id", "prop_idx", "child_idx", "depth", "last_desc", "label", "n_props", "child_counts", "is_leaf"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree a customer.  An order's items are in property 0 if their line status is F, else in property 1.

    Items and orders meet partitioned by order, orders and customers by customer;
    numbering windows reuse these partitionings.
    """
    broadcast_as_measured(spark)
    order_keys = ["l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_extendedprice"]
    prop = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    of_order = Window.partitionBy("l_orderkey")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", prop.alias("prop_idx"), *order_keys).select(
        F.col("l_orderkey").alias("order_id"),
        "prop_idx",
        (F.row_number().over(Window.partitionBy("l_orderkey", "prop_idx").orderBy(*order_keys)) - 1).alias("child_idx"),
        F.row_number().over(of_order.orderBy("prop_idx", *order_keys)).alias("place"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
    )
    counts = items.groupBy("order_id").agg(F.count_if(F.col("prop_idx") == 0).cast("int").alias("n0"), F.count_if(F.col("prop_idx") == 1).cast("int").alias("n1"))
    by_customer = Window.partitionBy("tree_id").orderBy("order_id")
    n0, n1 = (F.coalesce(c, F.lit(0)) for c in ("n0", "n1"))
    orders = (
        read(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("tree_id"), F.col("o_orderpriority").alias("label"))
        .join(counts, "order_id", "left")
        .withColumns({"n0": n0, "n1": n1, "items": n0 + n1})
        .withColumn("start", (1 + F.coalesce(F.sum(F.col("items") + 1).over(by_customer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))
        .withColumn("child_idx", (F.row_number().over(by_customer) - 1).cast("int"))
    )
    totals = orders.groupBy("tree_id").agg(F.count("*").cast("int").alias("orders"), F.sum(F.col("items") + 1).cast("int").alias("below"))
    roots = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tree_id"), F.col("c_mktsegment").alias("label")).join(totals, "tree_id", "left")
    no_int = F.lit(None).cast("int")
    below, n_orders = F.coalesce("below", F.lit(0)), F.coalesce("orders", F.lit(0))
    root_rows = roots.select("tree_id", F.lit(0).alias("node_id"), no_int.alias("parent_id"), no_int.alias("prop_idx"), no_int.alias("child_idx"), F.lit(0).alias("depth"), below.alias("last_desc"), "label", F.lit(1).alias("n_props"), F.array(n_orders).alias("child_counts"), (n_orders == 0).alias("is_leaf"))
    order_rows = orders.select("tree_id", F.col("start").alias("node_id"), F.lit(0).alias("parent_id"), F.lit(0).alias("prop_idx"), "child_idx", F.lit(1).alias("depth"), (F.col("start") + F.col("items")).alias("last_desc"), "label", F.lit(2).alias("n_props"), F.array("n0", "n1").alias("child_counts"), (F.col("items") == 0).alias("is_leaf"))
    placed = items.join(orders.select("order_id", "tree_id", "start"), "order_id")
    item_rows = placed.select("tree_id", (F.col("start") + F.col("place")).alias("node_id"), F.col("start").alias("parent_id"), "prop_idx", "child_idx", F.lit(2).alias("depth"), (F.col("start") + F.col("place")).alias("last_desc"), "label", F.lit(0).alias("n_props"), F.array().cast("array<int>").alias("child_counts"), F.lit(True).alias("is_leaf"))
    return root_rows.unionByName(order_rows).unionByName(item_rows)


#: The same table in DuckDB, as common table expressions ending in ``nodes``.
NODES_SQL = """
items AS (
  SELECT l_orderkey AS order_id, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS prop_idx, l_returnflag || l_linestatus AS label,
    l_linenumber, l_returnflag, l_linestatus, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
placed_items AS (
  SELECT order_id, prop_idx, label,
    row_number() OVER (PARTITION BY order_id, prop_idx ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey, l_suppkey, l_extendedprice) - 1 AS child_idx,
    row_number() OVER (PARTITION BY order_id ORDER BY prop_idx, l_linenumber, l_returnflag, l_linestatus, l_partkey, l_suppkey, l_extendedprice) AS place FROM items),
counts AS (
  SELECT order_id, count(*) FILTER (prop_idx = 0) AS n0, count(*) FILTER (prop_idx = 1) AS n1 FROM items GROUP BY order_id),
orders_placed AS (
  SELECT o_orderkey AS order_id, o_custkey AS tree_id, o_orderpriority AS label, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1,
    1 + coalesce(sum(coalesce(n0, 0) + coalesce(n1, 0) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS child_idx
  FROM orders LEFT JOIN counts ON order_id = o_orderkey),
nodes AS MATERIALIZED (
  SELECT c_custkey AS tree_id, CAST(0 AS INT) AS node_id, CAST(NULL AS INT) AS parent_id, CAST(NULL AS INT) AS prop_idx, CAST(NULL AS INT) AS child_idx, 0 AS depth,
    CAST(coalesce(below, 0) AS INT) AS last_desc, c_mktsegment AS label, 1 AS n_props, [CAST(coalesce(n, 0) AS INT)] AS child_counts, coalesce(n, 0) = 0 AS is_leaf
  FROM customer LEFT JOIN (SELECT tree_id, count(*) AS n, sum(n0 + n1 + 1) AS below FROM orders_placed GROUP BY tree_id) t ON t.tree_id = c_custkey
  UNION ALL
  SELECT tree_id, CAST(start AS INT), 0, 0, CAST(child_idx AS INT), 1, CAST(start + n0 + n1 AS INT), label, 2, [CAST(n0 AS INT), CAST(n1 AS INT)], n0 + n1 = 0 FROM orders_placed
  UNION ALL
  SELECT o.tree_id, CAST(o.start + i.place AS INT), CAST(o.start AS INT), i.prop_idx, CAST(i.child_idx AS INT), 2, CAST(o.start + i.place AS INT), i.label, 0, CAST([] AS INT[]), true
  FROM placed_items i JOIN orders_placed o ON o.order_id = i.order_id)
"""
