"""Structural operators over the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.functions import label_text
from grovespark.operators.ranking import running_sum
from grovespark.plans.state import cut


def tree_sizes(nodes: DataFrame) -> DataFrame:
    """Nodes of each tree, from the root's interval alone; equals the number of productions."""
    return nodes.where("parent_id IS NULL").select("tree_id", (F.col("last_desc") + 1).cast("long").alias("size"))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree_id", "node_id", (F.col("last_desc") - F.col("node_id") + 1).cast("long").alias("size"))


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """Childless nodes of each tree; a node may have properties and yet no children."""
    return nodes.groupBy("tree_id").agg(F.count_if("is_leaf").alias("leaves"), F.count_if(F.col("is_leaf") & (F.col("n_props") > 0)).alias("empty_inner"))


def depth_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count("*").alias("nodes"))


def label_multiset(nodes: DataFrame) -> DataFrame:
    """How often each label is in each tree."""
    return nodes.groupBy("tree_id", "label").agg(F.count("*").alias("n"))


def node_paths(nodes: DataFrame) -> DataFrame:
    """For each node the way up: labels, properties and places from its parent to the root.

    A way that does not reach the root yet is followed by that of the node it ends at, so the
    number of joins is the logarithm of the depth.
    """
    tops = nodes.select("tree_id", F.col("node_id").alias("up"), F.col("label").alias("up_label"), F.col("parent_id").isNull().alias("ended"))
    one = lambda c: F.array(F.col(c))
    first = nodes.where("parent_id IS NOT NULL").select("tree_id", "node_id", F.col("parent_id").alias("up"), one("prop_idx").alias("props"), one("child_idx").alias("places"))
    columns = ["tree_id", "node_id", "up", "ended", "labels", "props", "places"]
    ways = cut(first.join(tops, ["tree_id", "up"]).withColumn("labels", one("up_label")).select(columns))
    while not ways.where("NOT ended").isEmpty():
        further = ways.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("ended").alias("ended2"), *[F.col(c).alias(f"{c}2") for c in columns[4:]])
        on = ways.where("NOT ended").join(further, ["tree_id", "up"]).select("tree_id", "node_id", F.col("up2").alias("up"), F.col("ended2").alias("ended"), *[F.concat(c, f"{c}2").alias(c) for c in columns[4:]])
        ways = cut(ways.where("ended").unionByName(on))
    return ways.select("tree_id", "node_id", *[F.array_join(F.col(c).cast("array<string>"), ">").alias(c) for c in columns[4:]])


def symbols(nodes: DataFrame) -> DataFrame:
    """Dictionary of labels: dense ids in label order."""
    return running_sum(nodes.select("label").distinct(), [F.col("label")], F.lit(1), "place").select("label", (F.col("place") - 1).cast("int").alias("symbol_id"))


def unit_keys(alphabet: DataFrame, nodes: DataFrame, unit: Column) -> DataFrame:
    """label, unit_key: one row, the first symbol that tops a tree and is a unit by ``unit``, a condition over the label."""
    tops = nodes.where("parent_id IS NULL").select("label").distinct().where(unit)
    return alphabet.join(tops, "label", "left_semi").select("label", F.col("symbol_id").alias("unit_key")).orderBy("unit_key").limit(1)


def remap(nodes: DataFrame, alphabet: DataFrame) -> DataFrame:
    """Encode labels by another alphabet; labels it lacks get a null id."""
    return nodes.join(alphabet, "label", "left")


def with_roots(nodes: DataFrame, is_root: Column) -> DataFrame:
    """Mark where fragments begin: the top always, leaves never, other nodes as ``is_root`` says."""
    return nodes.withColumn("is_root", F.col("parent_id").isNull() | (~F.col("is_leaf") & is_root))


def similarity(multisets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity: intersection over union of two trees' label multisets."""
    left = pairs.join(multisets.select(F.col("tree_id").alias("a"), "label", F.col("n").alias("x")), "a")
    right = pairs.join(multisets.select(F.col("tree_id").alias("b"), "label", F.col("n").alias("y")), "b")
    both = left.unionByName(right, allowMissingColumns=True).groupBy("a", "b", "label").agg(F.coalesce(F.max("x"), F.lit(0)).alias("x"), F.coalesce(F.max("y"), F.lit(0)).alias("y"))
    return both.groupBy("a", "b").agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("similarity"))


def canonical(nodes: DataFrame, group: list[str], with_flags: bool = False) -> DataFrame:
    """One string a group: ``label(counts)`` of its nodes in pre-order, roots starred if asked for."""
    token = F.concat(label_text(F.col("label")), F.lit("("), F.array_join(F.col("child_counts").cast("array<string>"), "."), F.lit(")"))
    if with_flags:
        token = F.concat(F.when(F.col("is_root"), "*").otherwise(""), token)
    rows = F.sort_array(F.collect_list(F.struct("node_id", token.alias("token"))))
    return nodes.groupBy(*group).agg(F.array_join(F.transform(rows, lambda r: r["token"]), " ").alias("canon"), F.count("*").alias("size"))
