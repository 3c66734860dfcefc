"""Recurring fragments: choosing, counting, covering, ranking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovespark.functions import label_of, without_roots

MIN_COUNT, MIN_SIZE = 10, 7
#: A token of a form: up to a closing bracket that is not escaped; a blank follows.
TOKEN = r"((?:[^\\)]|\\.)+\)) ?"


def frequent(grammar: DataFrame, min_count: int = MIN_COUNT, min_size: int = MIN_SIZE) -> DataFrame:
    """Fragments that are frequent and large enough, each form once; root flags don't count in the form."""
    return grammar.where((F.col("cnt") >= min_count) & (F.col("size") >= min_size)).select(without_roots(F.col("rhs")).alias("form"), "size").distinct()


def parse_forms(forms: DataFrame) -> DataFrame:
    """rule_id and node rows of canonical forms ``label(counts) label(counts) ...`` in pre-order.

    The parent of a token is found by the counts: token i's depth in the pre-order
    follows from how many children are still open, a running sum over the tokens.
    Labels may hold any characters, since separators in them are escaped.
    """
    token = forms.select("rule_id", F.posexplode(F.regexp_extract_all("form", F.lit(TOKEN), F.lit(1))).alias("node_id", "token"))
    label = label_of(F.regexp_extract("token", r"^(.*)\(([0-9.]*)\)$", 1))
    counts = F.regexp_extract("token", r"^(.*)\(([0-9.]*)\)$", 2)
    rows = token.select("rule_id", "node_id", label.alias("label"), F.when(counts == "", F.array().cast("array<int>")).otherwise(F.split(counts, r"\.").cast("array<int>")).alias("child_counts"))
    below = F.aggregate("child_counts", F.lit(0), lambda s, c: s + c)
    w = Window.partitionBy("rule_id").orderBy("node_id")
    # open(i): children still to come after token i; the subtree of i ends where this first falls to open(i) - children(i)
    rows = rows.withColumn("kids", below).withColumn("open", F.sum(F.col("kids") - 1).over(w))
    a, b = rows.alias("a"), rows.alias("b")
    later = a.join(b, F.expr("a.rule_id = b.rule_id AND b.node_id >= a.node_id AND b.open <= a.open - a.kids"))
    last = later.groupBy("a.rule_id", "a.node_id").agg(F.min("b.node_id").alias("last_desc"))
    placed = rows.join(last, ["rule_id", "node_id"])
    up = placed.select("rule_id", F.col("node_id").alias("p_id"), F.col("last_desc").alias("p_last"), F.col("child_counts").alias("p_counts"))
    above = placed.join(up, "rule_id").where("p_id < node_id AND node_id <= p_last").groupBy("rule_id", "node_id").agg(F.max("p_id").alias("parent_id"))
    linked = placed.join(above, ["rule_id", "node_id"], "left").join(up.select("rule_id", F.col("p_id").alias("parent_id"), "p_counts"), ["rule_id", "parent_id"], "left")
    place = F.row_number().over(Window.partitionBy("rule_id", "parent_id").orderBy("node_id")) - 1
    ends = F.transform(F.sequence(F.lit(1), F.size("p_counts")), lambda k: F.aggregate(F.slice("p_counts", F.lit(1), k), F.lit(0), lambda s, c: s + c))
    ranked = linked.withColumn("place", F.when(F.col("parent_id").isNotNull(), place)).withColumn("ends", F.when(F.col("parent_id").isNotNull(), ends))
    prop = F.size(F.filter("ends", lambda e: e <= F.col("place")))
    return ranked.withColumn("prop_idx", F.when(F.col("parent_id").isNotNull(), prop)).select(
        "rule_id", "node_id", "parent_id", "prop_idx",
        F.when(F.col("prop_idx") > 0, F.col("place") - F.element_at("ends", F.col("prop_idx"))).otherwise(F.col("place")).cast("int").alias("child_idx"),
        "last_desc", "label", F.size("child_counts").alias("n_props"), "child_counts", (F.col("kids") == 0).alias("is_leaf"),
    )


def file_statistics(files: DataFrame, sizes: DataFrame, kept: DataFrame) -> DataFrame:
    """tree_id, coverage (covered nodes of all patterns over size; patterns may overlap), file_recall, mean_size of the patterns in it.

    ``files``: tree_id, nodes, patterns, sites of trees with a match, see ``matching.coverage_of_trees``.
    """
    total = kept.agg(F.count("*").alias("all"))
    joined = sizes.join(files, "tree_id", "left").fillna(0, ["nodes", "patterns", "sites"]).crossJoin(F.broadcast(total))  # one row
    return joined.select("tree_id", (F.col("nodes") / F.col("size")).alias("coverage"), (F.col("patterns") / F.col("all")).alias("file_recall"), F.coalesce(F.try_divide("nodes", "patterns"), F.lit(0.0)).alias("mean_size"), "sites")


def corpus_statistics(files: DataFrame) -> DataFrame:
    return files.agg(F.avg("coverage").alias("coverage"), F.avg("file_recall").alias("file_recall"), F.avg("mean_size").alias("mean_size"), F.sum("sites").alias("sites"))


def threshold_grid(per: DataFrame, patterns: DataFrame, counts: list[int], sizes: list[int]) -> DataFrame:
    """min_count, min_size, patterns, seen, recall, sites: for every pair of thresholds.

    ``patterns``: rule_id, cnt, size; ``per``: tree_id, rule_id, sites.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("min_count"), F.lit(s).alias("min_size")) for c in counts for s in sizes]))
    sites = per.groupBy("rule_id").agg(F.sum("sites").alias("sites"))
    each = patterns.join(sites, "rule_id", "left").fillna(0, ["sites"]).withColumn("g", grid).select("*", "g.*").where("cnt >= min_count AND size >= min_size")
    seen = F.count_if(F.col("sites") > 0)
    return each.groupBy("min_count", "min_size").agg(F.count("*").alias("patterns"), seen.alias("seen"), (seen / F.count("*")).alias("recall"), F.sum("sites").alias("sites"))


def document_frequency(per: DataFrame, least: int) -> DataFrame:
    return per.groupBy("rule_id").agg(F.count_distinct("tree_id").alias("files")).where(F.col("files") >= least)


def coverage(once: DataFrame, covered: DataFrame, sizes: DataFrame, patterns: DataFrame) -> DataFrame:
    """covered, nodes, coverage, precision: distinct covered nodes (``once``) over all, distinct patterns matched over all."""
    hit = once.agg(F.count("*").alias("covered"))
    used = covered.select("rule_id").distinct().agg(F.count("*").alias("used"))
    every = sizes.agg(F.sum("size").alias("nodes")).crossJoin(patterns.select("rule_id").distinct().agg(F.count("*").alias("all")))
    return hit.crossJoin(used).crossJoin(every).select("covered", "nodes", (F.col("covered") / F.col("nodes")).alias("coverage"), (F.col("used") / F.col("all")).alias("precision"))


def recall_by_size(seen: DataFrame, patterns: DataFrame, sizes: list[int]) -> DataFrame:
    """min_size, patterns, seen, recall."""
    marked = patterns.join(seen.select("rule_id").distinct().withColumn("hit", F.lit(1)), "rule_id", "left").fillna(0, ["hit"])
    each = marked.withColumn("min_size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("size >= min_size")
    return each.groupBy("min_size").agg(F.count("*").alias("patterns"), F.sum("hit").alias("seen"), F.avg("hit").alias("recall"))


def pattern_index(per: DataFrame) -> DataFrame:
    """rule_id, files, sites, first_file, last_file: where each pattern occurs; the list itself is ``per``."""
    return per.groupBy("rule_id").agg(F.count("*").alias("files"), F.sum("sites").alias("sites"), F.min("tree_id").alias("first_file"), F.max("tree_id").alias("last_file"))


def rank_greedily(covered: DataFrame, gains: DataFrame, limit: int = 25) -> DataFrame:
    """rank, rule_id, score: again and again the idiom with the largest gain * floor(uncovered nodes / size), which then covers its nodes.

    Ties go to the smaller rule_id.  One small aggregate a step comes to the driver;
    what is covered stays a table, cut by checkpoints.
    """
    from grovespark.plans.state import cut

    left = cut(covered.select("rule_id", "tree_id", "node_id").distinct())
    spark, out = covered.sparkSession, []
    for rank in range(1, limit + 1):
        fresh = left.groupBy("rule_id").agg(F.count("*").alias("n")).join(gains, "rule_id")
        score = F.col("gain") * F.floor(F.col("n") / F.col("size"))
        best = fresh.select("rule_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "rule_id").first()
        if best is None:
            break
        out.append((rank, best.rule_id, best.score))
        taken = left.where(F.col("rule_id") == best.rule_id).select("tree_id", "node_id")
        left = left.join(taken, ["tree_id", "node_id"], "left_anti")
        if rank % 4 == 0:
            left = cut(left)
    return spark.createDataFrame(out, f"rank int, rule_id {covered.schema['rule_id'].dataType.simpleString()}, score double")


def common_tops(cluster_nodes: DataFrame, accept: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(cluster, node columns of the first tree: what is left of it; cluster, members: trees accepted, the first one not counted).

    A fold over each cluster's trees in the order of tree_id: the top begins as the whole
    first tree; a tree whose common top with it has at least ``accept`` of its nodes, and
    one at least, is accepted and the common top takes its place.

    Only a tree that is accepted and shares less than all changes the top.  A step
    compares all trees that are left of all clusters with the tops at once and goes on behind each
    cluster's first such tree, so there are as many steps as changes of the top, at most its
    nodes, whatever the number of trees; no task holds a cluster.
    """
    from grovespark.operators.matching import maximal_overlap
    from grovespark.plans.state import cut

    nodes = cut(cluster_nodes)
    trees = cut(nodes.select("cluster", F.col("tree_id").alias("b")).distinct())
    first = trees.groupBy("cluster").agg(F.min("b").alias("tree_id"))
    top, left = cut(nodes.join(first, ["cluster", "tree_id"])), cut(trees.join(first, "cluster").where("b > tree_id").select("cluster", "b"))
    trees_only, members = cut(nodes.drop("cluster").distinct()), None
    while not left.isEmpty():
        named = top.drop("tree_id").withColumnRenamed("cluster", "tree_id")
        common = cut(maximal_overlap(named, trees_only, left.select(F.col("cluster").alias("a"), "b")).withColumnRenamed("a", "cluster"))
        size = top.groupBy("cluster").agg(F.count("*").alias("size"))
        shared = common.groupBy("cluster", "b").agg(F.count("*").alias("n")).join(size, "cluster").where(F.col("n") >= accept * F.col("size"))
        shared = cut(shared)
        change = cut(shared.where("n < size").groupBy("cluster").agg(F.min("b").alias("changed")))
        passed = shared.join(change, "cluster", "left").where("changed IS NULL OR b <= changed").groupBy("cluster").agg(F.count("*").alias("members"))
        members = passed if members is None else members.unionByName(passed)
        smaller = common.join(change.withColumnRenamed("changed", "b"), ["cluster", "b"], "left_semi").select("cluster", "node_id")
        kept = top.join(change, "cluster", "left_anti").unionByName(top.join(smaller, ["cluster", "node_id"], "left_semi").select(top.columns))
        top, left = cut(kept), cut(left.join(change, "cluster").where("b > changed").select("cluster", "b"))
    if members is None:
        return top, first.select("cluster", F.lit(0).cast("long").alias("members")).where("false")
    return top, members.groupBy("cluster").agg(F.sum("members").alias("members"))


def clone_overlap(cluster_nodes: DataFrame, accept: float = 0.9) -> DataFrame:
    """cluster, size, members: nodes of the common top of each cluster's trees (see ``common_tops``) and how many beside the first have it; clusters with such trees only."""
    top, members = common_tops(cluster_nodes, accept)
    return top.groupBy("cluster").agg(F.count("*").alias("size")).join(members, "cluster")


def merge_patterns(*corpora: DataFrame) -> DataFrame:
    """Distinct forms, with their size, of several corpora of patterns."""
    every = corpora[0]
    for other in corpora[1:]:
        every = every.unionByName(other)
    return every.distinct()


def long_snippets(nodes: DataFrame, least: int = 20) -> DataFrame:
    """tree_id, tokens of trees with more than ``least`` leaves beside a first and a last one."""
    return nodes.groupBy("tree_id").agg(F.count_if("is_leaf").alias("tokens")).where(F.col("tokens") - 2 > least)
