"""Context-free rules and tree-substitution grammars as counted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovespark.functions import label_text, rule_text
from grovespark.plans.state import cut


def of_head(column: str) -> Column:
    """Sum of a column over all rules of the head."""
    return F.sum(column).over(Window.partitionBy("head"))


def rules_of_nodes(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, head, rhs: the rule at every inner node, and at the top even if it is a leaf.

    rhs has one list of labels for each property, empty ones included.
    """
    children = F.sort_array(F.collect_list(F.struct("prop_idx", "child_idx", "label")))
    below = nodes.where("parent_id IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(children.alias("children"))
    inner = nodes.where("parent_id IS NULL OR NOT is_leaf").select("tree_id", "node_id", F.col("label").alias("head"), "n_props")
    places = F.when(F.col("n_props") > 0, F.sequence(F.lit(0), F.col("n_props") - 1)).otherwise(F.array().cast("array<int>"))
    rhs = F.transform(places, lambda p: F.transform(F.filter(F.coalesce("children", F.array()), lambda c: c["prop_idx"] == p), lambda c: c["label"]))
    return inner.join(below, ["tree_id", "node_id"], "left").select("tree_id", "node_id", "head", rule_text(rhs).alias("rhs"))


def count_rules(rules: DataFrame) -> DataFrame:
    """head, rhs, cnt; counted before and after the shuffle."""
    return rules.groupBy("head", "rhs").agg(F.count("*").alias("cnt"))


def add_counts(*grammars: DataFrame) -> DataFrame:
    """Add grammars with the columns head, rhs, cnt; negative counts take away."""
    every = grammars[0]
    for other in grammars[1:]:
        every = every.unionByName(other)
    return every.groupBy("head", "rhs").agg(F.sum("cnt").alias("cnt")).where("cnt != 0")


def remove_counts(grammar: DataFrame, removed: DataFrame) -> DataFrame:
    """Take counts away, of each rule what is there at most; rules without count vanish."""
    gone = removed.groupBy("head", "rhs").agg(F.sum("cnt").alias("gone"))
    left = grammar.join(gone, ["head", "rhs"], "left").withColumn("cnt", F.col("cnt") - F.least("cnt", F.coalesce("gone", F.lit(0))))
    return left.where("cnt > 0").select("head", "rhs", "cnt")


def ml_probabilities(grammar: DataFrame) -> DataFrame:
    """head, rhs, cnt, total, p = cnt / total of the head."""
    return grammar.withColumn("total", of_head("cnt")).withColumn("p", F.col("cnt") / F.col("total"))


def look_up(rules: DataFrame, grammar: DataFrame) -> DataFrame:
    """Rules with cnt and total of the grammar, 0 where it lacks the rule or the head."""
    known = grammar.select("head", "rhs", "cnt")
    totals = grammar.groupBy("head").agg(F.sum("cnt").alias("total"))
    return rules.join(known, ["head", "rhs"], "left").join(totals, "head", "left").fillna(0, ["cnt", "total"])


def ml_probability(cnt: Column, total: Column) -> Column:
    """1 for an unknown head, else the share of the rule."""
    return F.when(total == 0, 1.0).otherwise(F.try_divide(cnt.cast("double"), total.cast("double")))


def prune(grammar: DataFrame, least: int, unknown: str = "UNK") -> DataFrame:
    """Drop heads whose total is below ``least``; rarer rules of the others become one unknown rule with their sum."""
    kept = grammar.withColumn("total", of_head("cnt")).where(F.col("total") >= least)
    return kept.withColumn("rhs", F.when(F.col("cnt") < least, unknown).otherwise(F.col("rhs"))).groupBy("head", "rhs").agg(F.sum("cnt").alias("cnt"))


def fragment_of_nodes(rooted: DataFrame) -> DataFrame:
    """Each node below a top with ``frag_root``: the nearest node above it that begins a fragment.  A root is also a frontier of the fragment above.

    Pointers go to the parent first; one that does not end at a root yet takes over that of the node
    it points to, so the number of joins is the logarithm of the longest way to a root.
    """
    flags = rooted.select("tree_id", F.col("node_id").alias("up"), F.col("is_root").alias("ended"))
    parents = rooted.where("parent_id IS NOT NULL").select("tree_id", "node_id", F.col("parent_id").alias("up")).join(flags, ["tree_id", "up"]).select("tree_id", "node_id", "up", "ended")

    def followed(ways: DataFrame) -> DataFrame:
        further = ways.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("ended").alias("ended2"))
        on = ways.where("NOT ended").join(further, ["tree_id", "up"]).select("tree_id", "node_id", F.col("up2").alias("up"), F.col("ended2").alias("ended"))
        return cut(ways.where("ended").unionByName(on))

    ways = followed(parents)
    while not ways.where("NOT ended").isEmpty():
        ways = followed(ways)
    return ways.select("tree_id", "node_id", F.col("up").alias("frag_root"))


def fragment_rows(rooted: DataFrame, of_fragment: DataFrame | None = None) -> DataFrame:
    """The nodes of the fragment that begins at each root: frag_root and the columns of ``rooted``; roots below the top have no children there."""
    upper = fragment_of_nodes(rooted) if of_fragment is None else of_fragment
    lone = F.transform("child_counts", lambda c: F.lit(0))
    inside = rooted.join(upper, ["tree_id", "node_id"]).withColumn("child_counts", F.when(F.col("is_root"), lone).otherwise(F.col("child_counts")))
    return rooted.where("is_root").withColumn("frag_root", F.col("node_id")).unionByName(inside)


def fragments(rooted: DataFrame, of_fragment: DataFrame | None = None) -> DataFrame:
    """tree_id, frag_root, head, rhs (canonical string), size: the fragment that begins at each root.

    Roots below the top of a fragment end it: they are written starred and without children.
    """
    return as_text(fragment_rows(rooted, of_fragment))


def as_text(rows: DataFrame) -> DataFrame:
    """tree_id, frag_root, head, rhs, size of fragments given by their nodes."""
    token = F.concat(F.when(F.col("is_root"), "*").otherwise(""), label_text(F.col("label")), F.lit("("), F.array_join(F.col("child_counts").cast("array<string>"), "."), F.lit(")"))
    listed = F.sort_array(F.collect_list(F.struct("node_id", token.alias("token"), "label")))
    return rows.groupBy("tree_id", "frag_root").agg(listed.alias("rows")).select("tree_id", "frag_root", F.col("rows")[0]["label"].alias("head"), F.array_join(F.transform("rows", lambda r: r["token"]), " ").alias("rhs"), F.size("rows").cast("long").alias("size"))


def templetized_fragments(rooted: DataFrame, kinds: DataFrame) -> DataFrame:
    """``fragments`` in which labels of ``kinds`` (label, type) are variables ``type#k``, numbered by first occurrence in the fragment; so a variable at the top is 0."""
    rows = fragment_rows(rooted).join(kinds.select("label", "type"), "label", "left").withColumn("variable", F.when(F.col("type").isNotNull(), F.col("label")))
    firsts = rows.where("variable IS NOT NULL").groupBy("tree_id", "frag_root", "variable").agg(F.min("node_id").alias("first"))
    numbered = firsts.withColumn("k", F.row_number().over(Window.partitionBy("tree_id", "frag_root").orderBy("first")) - 1).drop("first")
    named = rows.join(numbered, ["tree_id", "frag_root", "variable"], "left")
    return as_text(named.withColumn("label", F.when(F.col("k").isNull(), F.col("label")).otherwise(F.concat("type", F.lit("#"), F.col("k").cast("string")))))


def merge_alphabets(left: DataFrame, left_symbols: DataFrame, right: DataFrame, right_symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grammar, alphabet) of two grammars whose symbols are numbered apart; the alphabet keeps the left numbers and appends the right's new labels.

    Grammars: head, rhs, cnt with ids in place of labels; alphabets: label, symbol_id.
    Ids in a rule are looked up one row a token and written back in order.
    """
    last = left_symbols.agg(F.coalesce(F.max("symbol_id"), F.lit(-1))).first()[0]
    new = right_symbols.join(left_symbols, "label", "left_anti")
    alphabet = left_symbols.select("label", "symbol_id").unionByName(new.select("label", (F.lit(last) + F.row_number().over(Window.orderBy("label"))).cast("int").alias("symbol_id")))
    change = right_symbols.select("label", F.col("symbol_id").cast("string").alias("old")).join(alphabet, "label").select("old", F.col("symbol_id").cast("string").alias("id"))
    tokens = right.select("head", "rhs", "cnt", F.posexplode(F.split("rhs", " ")).alias("place", "token")).withColumn("old", F.regexp_extract("token", r"^\*?(\d+)", 1))
    parts = tokens.join(change, "old").withColumn("token", F.concat(F.when(F.col("token").startswith("*"), "*").otherwise(""), "id", F.regexp_extract("token", r"(\(.*)$", 1)))
    listed = parts.groupBy("head", "rhs", "cnt").agg(F.sort_array(F.collect_list(F.struct("place", "token", "id"))).alias("parts"))
    moved = listed.select(F.col("parts")[0]["id"].alias("head"), F.array_join(F.transform("parts", lambda x: x["token"]), " ").alias("rhs"), "cnt")
    return add_counts(left.select("head", "rhs", "cnt"), moved), alphabet


def count_fragments(found: DataFrame) -> DataFrame:
    return found.groupBy("head", "rhs", "size").agg(F.count("*").alias("cnt"))


def size_histogram(grammar: DataFrame) -> DataFrame:
    return grammar.groupBy("size").agg(F.sum("cnt").alias("cnt"))


def size_buckets(grammar: DataFrame) -> DataFrame:
    """Counts of sizes up to 5, 15, 30 and beyond, and the mean size."""
    size, cnt = F.col("size"), F.col("cnt")
    bucket = lambda lo, hi: F.sum(F.when((size > lo) & (size <= hi), cnt).otherwise(0))
    return grammar.agg(bucket(-1, 5).alias("to_5"), bucket(5, 15).alias("to_15"), bucket(15, 30).alias("to_30"), bucket(30, 1 << 62).alias("over_30"), (F.sum(size * cnt) / F.sum(cnt)).alias("mean_size"))


def filter_corpus(nodes: DataFrame, least: int) -> DataFrame:
    """Cut children off every node whose rule is rarer than ``least``; tops and cut nodes begin trees of their own, leaf-only trees go.

    Returns tree_id, new_root, node_id, label: the surviving trees' nodes.
    """
    rules = rules_of_nodes(nodes).join(nodes.where("NOT is_leaf").select("tree_id", "node_id"), ["tree_id", "node_id"])
    rare = rules.join(count_rules(rules).where(F.col("cnt") < least), ["head", "rhs"]).select("tree_id", F.col("node_id").alias("parent_id"))
    marked = nodes.join(rare.withColumn("cut", F.lit(True)), ["tree_id", "parent_id"], "left").withColumn("is_root", F.col("parent_id").isNull() | F.coalesce("cut", F.lit(False)))
    upper = fragment_of_nodes(marked)
    placed = marked.join(upper, ["tree_id", "node_id"], "left").withColumn("new_root", F.when(F.col("is_root"), F.col("node_id")).otherwise(F.col("frag_root")))
    alive = placed.groupBy("tree_id", "new_root").count().where("count > 1").drop("count")
    return placed.join(alive, ["tree_id", "new_root"], "left_semi").select("tree_id", "new_root", "node_id", "label")
