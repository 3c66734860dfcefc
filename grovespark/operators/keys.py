"""Keys of subtrees and fragments: hashes made bottom-up, a level a step.

A node's key is a 64-bit hash of its label, number of properties and children's counts, and of its
children's keys, each with its place; equal keys mean equal trees, whatever characters labels hold.
A node that begins a fragment of its own counts in the fragment above with its label only.  A node's children come in
by exclusive or, so the key of a fragment in which one node begins or no longer begins a fragment follows
from the keys on the way up to the fragment's top: no fragment is built again for it.

Only inner nodes (and tops) take part in the steps; leaves never begin a fragment and are folded into
their parent once.  The number of steps is the depth of the deepest inner node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.plans.state import cut

#: With more levels than this each is written to the checkpoint folder, so that plans stay small.
LAZY_LEVELS = 2
ID = ["tree_id", "node_id"]


def _base() -> Column:
    return F.xxhash64("label", "n_props", "child_counts")


def _frontier() -> Column:
    return F.xxhash64("label", F.lit("frontier"))


def levels_of(nodes: DataFrame) -> int:
    """Depth of the deepest inner node, 0 without any."""
    return nodes.where("NOT is_leaf").agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]


def skeleton(nodes: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Tops and inner nodes with what their leaves add: tree_id, node_id, parent_id, depth, label, place, base, leafy, leaves, own_prior.

    ``priors``: tree_id, node_id, log2p of the rule at each node; 0 without.
    """
    place = F.xxhash64("prop_idx", "child_idx")
    leaf = F.xxhash64(place, F.xxhash64(_base(), F.lit(0).cast("long")))
    leaves = nodes.where("is_leaf AND parent_id IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.bit_xor(leaf).alias("leafy"), F.count("*").alias("leaves"))
    inner = nodes.where("parent_id IS NULL OR NOT is_leaf").select(*ID, "parent_id", "depth", "label", place.alias("place"), _base().alias("base"))
    out = inner.join(leaves, ID, "left")
    out = out.withColumn("own_prior", F.lit(0.0)) if priors is None else out.join(priors.select(*ID, F.col("log2p").alias("own_prior")), ID, "left")
    return out.fillna(0, ["leafy", "leaves", "own_prior"])


def keyed(skeleton: DataFrame, levels: int) -> DataFrame:
    """The skeleton with ``children`` (its children's share of the key), ``key``, ``size`` and ``prior`` of the fragment below each node.

    ``skeleton`` has is_root.  ``size`` counts the frontier, ``prior`` does not.
    """
    done = below = None
    for depth in range(levels, -1, -1):
        here = skeleton.where(F.col("depth") == depth)
        if below is None:
            terms = [F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0.0)]
        else:
            sums = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.bit_xor("term").alias("term"), F.sum("part_size").alias("part_size"), F.sum("part_prior").alias("part_prior"))
            here = here.join(sums, ID, "left")
            terms = [F.coalesce(c, F.lit(0)) for c in ("term", "part_size", "part_prior")]
        here = here.select(
            *skeleton.columns, F.col("leafy").bitwiseXOR(terms[0].cast("long")).alias("children"), (1 + F.col("leaves") + terms[1]).alias("size"), (F.col("own_prior") + terms[2]).alias("prior")
        ).withColumn("key", F.xxhash64("base", "children"))
        if levels > LAZY_LEVELS:
            here = cut(here)
        ends = F.col("is_root")
        below = here.where("parent_id IS NOT NULL").select(
            "tree_id", "parent_id", F.xxhash64("place", F.when(ends, _frontier()).otherwise(F.col("key"))).alias("term"),
            F.when(ends, 1).otherwise(F.col("size")).alias("part_size"), F.when(ends, 0.0).otherwise(F.col("prior")).alias("part_prior"),
        )
        done = here if done is None else done.unionByName(here)
    return done


def sites(keyed: DataFrame, levels: int) -> DataFrame:
    """tree_id, site, was_root, top, and key, head, size, prior of the fragments that joining (j) or splitting (u, l) at each inner node below a top gives.

    ``top`` is the nearest root above, where the upper and the joined fragment begin.
    """
    up = keyed.select("tree_id", F.col("node_id").alias("at"), *[F.col(c).alias(f"up_{c}") for c in ("parent_id", "place", "base", "children", "key", "size", "prior", "label", "is_root")])
    changed = F.when(F.col("is_root"), F.col("key")).otherwise(_frontier())
    own = F.when(F.col("is_root"), _frontier()).otherwise(F.col("key"))
    inner = keyed.where("parent_id IS NOT NULL")
    way = inner.select("tree_id", F.col("node_id").alias("site"), F.col("parent_id").alias("at"), F.xxhash64("place", own).alias("old"), F.xxhash64("place", changed).alias("new"))
    found = None
    for step in range(levels):
        met = way.join(up, ["tree_id", "at"]).withColumn("flipped", F.xxhash64("up_base", F.col("up_children").bitwiseXOR(F.col("old")).bitwiseXOR(F.col("new"))))
        if levels > LAZY_LEVELS:
            met = cut(met)
        ended = met.where("up_is_root").select("tree_id", "site", F.col("at").alias("top"), F.col("up_key").alias("top_key"), "flipped", F.col("up_size").alias("top_size"), F.col("up_prior").alias("top_prior"), F.col("up_label").alias("u_head"))
        found = ended if found is None else found.unionByName(ended)
        way = met.where("NOT up_is_root").select("tree_id", "site", F.col("up_parent_id").alias("at"), F.xxhash64("up_place", "up_key").alias("old"), F.xxhash64("up_place", "flipped").alias("new"))
    below = inner.select("tree_id", F.col("node_id").alias("site"), F.col("is_root").alias("was_root"), F.col("key").alias("l_key"), F.col("label").alias("l_head"), F.col("size").alias("l_size"), F.col("prior").alias("l_prior"))
    if found is None:  # no inner node below a top
        none = {"top": "int", "top_key": "long", "flipped": "long", "top_size": "long", "top_prior": "double", "u_head": "string"}
        both = below.where("false").select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    else:
        both = below.join(found, ["tree_id", "site"])
    was = F.col("was_root")
    pick = lambda split, joined: F.when(was, split).otherwise(joined)
    return both.select(
        "tree_id", "site", "was_root", "top", F.col("u_head").alias("j_head"), "u_head", "l_head",
        pick(F.col("flipped"), F.col("top_key")).alias("j_key"), pick(F.col("top_key"), F.col("flipped")).alias("u_key"), "l_key",
        pick(F.col("top_size") + F.col("l_size") - 1, F.col("top_size")).alias("j_size"), pick(F.col("top_size"), F.col("top_size") - F.col("l_size") + 1).alias("u_size"), "l_size",
        pick(F.col("top_prior") + F.col("l_prior"), F.col("top_prior")).alias("j_prior"), pick(F.col("top_prior"), F.col("top_prior") - F.col("l_prior")).alias("u_prior"), "l_prior",
    )


def subtree_keys(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, label, key, size of every node's whole subtree."""
    whole = keyed(skeleton(nodes).withColumn("is_root", F.col("parent_id").isNull()), levels_of(nodes)).select(*ID, "label", "key", "size")
    leaves = nodes.where("is_leaf AND parent_id IS NOT NULL").select(*ID, "label", F.xxhash64(_base(), F.lit(0).cast("long")).alias("key"), F.lit(1).cast("long").alias("size"))
    return whole.unionByName(leaves)


def subtree_classes(nodes: DataFrame) -> DataFrame:
    """A row for each distinct subtree: label, size, n, and its first occurrence (tree_id, node_id)."""
    return subtree_keys(nodes).groupBy("key", "label", "size").agg(F.count("*").alias("n"), F.min(F.struct(*ID)).alias("first")).select("label", "size", "n", "first.*")


def equal_trees(nodes: DataFrame) -> DataFrame:
    """tree_id, class_id: the smallest id of the trees that are equal to it, node by node."""
    tops = nodes.where("parent_id IS NULL").select(*ID)
    keys = subtree_keys(nodes).join(tops, ID, "left_semi").select("tree_id", "key")
    return keys.join(keys.groupBy("key").agg(F.min("tree_id").alias("class_id")), "key").select("tree_id", "class_id")


def fragment_counts(keyed: DataFrame) -> DataFrame:
    """head, key, size, cnt of the fragments of a segmentation."""
    return keyed.where("is_root").groupBy(F.col("label").alias("head"), "key", "size").agg(F.count("*").alias("cnt"))
