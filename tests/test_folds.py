"""Folds of common tops and inside probabilities with supertrees, against loops."""

import math
import random

import pytest

from grovespark.operators import idioms
from grovespark.operators import matching as ma
from grovespark.operators import probability as pr

from .helpers import node_rows, nodes_frame, rules_frame


def parts(tree):
    return (tree[0], tree[1:]) if isinstance(tree, tuple) else (tree, ())


def agree(one, two):
    return parts(one)[0] == parts(two)[0] and len(parts(one)[1]) == len(parts(two)[1])


def common(one, two):
    """The common top of two trees that agree at their tops: in each property up to the first child that differs."""
    props = []
    for a, b in zip(parts(one)[1], parts(two)[1], strict=True):
        kept = []
        for x, y in zip(a, b, strict=False):
            if not agree(x, y):
                break
            kept.append(common(x, y))
        props.append(kept)
    return (parts(one)[0], *props)


def size(tree):
    return 1 + sum(size(c) for p in parts(tree)[1] for c in p)


def ends_of(rule, node):
    """Tree nodes under the rule's leaves, or None where the rule does not reach as far as the tree."""
    if not agree(rule, node):
        return None
    if not any(parts(rule)[1]):
        return [node]
    if not any(parts(node)[1]):
        return None
    out = []
    for a, b in zip(parts(rule)[1], parts(node)[1], strict=True):
        if len(a) < len(b):
            return None
        for x, y in zip(a, b, strict=False):
            below = ends_of(x, y)
            if below is None:
                return None
            out += below
    return out


def inside(node, rules):
    if not any(parts(node)[1]):
        return 1.0
    if not any(parts(r)[0] == parts(node)[0] for r, _ in rules):
        return math.prod(inside(c, rules) for p in parts(node)[1] for c in p)
    total = 0.0
    for rule, p in rules:
        ends = ends_of(rule, node) if any(parts(rule)[1]) else None
        if ends is not None:
            total += p * math.prod(inside(e, rules) for e in ends)
    return total


def grown(r, depth):
    """A random tree whose every node has one property, as leaves of the parsed rules have."""
    label = r.choice("A|")
    return (label, [grown(r, depth - 1) for _ in range(r.choice([0, 1, 2, 2]) if depth else 0)])


@pytest.mark.parametrize("seed", [1, 2])
def test_inside_with_supertrees_against_enumeration(spark, seed):
    r = random.Random(seed)
    trees = [("A", [grown(r, 2), grown(r, 1)]) for _ in range(40)]
    rules = [(t, 2.0 ** -r.randint(1, 4)) for t in (grown(r, 2) for _ in range(60))]
    log2p = spark.createDataFrame([(k + 1, math.log2(p)) for k, (_, p) in enumerate(rules)], "rule_id long, log2p double")
    nodes, patterns = nodes_frame(spark, *trees), rules_frame(spark, *[t for t, _ in rules])
    got = {x.tree_id: x.log2p for x in pr.inside_log2(nodes, patterns, log2p, all_children=False).collect()}
    want = {k + 1: inside(t, rules) for k, t in enumerate(trees)}
    assert {k: round(2**v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert sum(0 < v < 1 for v in want.values()) >= 5
    sites = {(x.rule_id, x.tree_id) for x in ma.supertree_sites(patterns, nodes).where("anchor = 0").collect()}
    assert sites == {(i + 1, k + 1) for i, (p, _) in enumerate(rules) for k, t in enumerate(trees) if ends_of(p, t) is not None}


def edited(r, tree):
    """The tree with some leaves renamed or gone."""
    label, props = parts(tree)
    if not any(props):
        return (r.choice("xy"), *props) if r.random() < 0.04 else tree
    return (label, *[[edited(r, c) for c in p if r.random() > 0.01] for p in props])


@pytest.mark.parametrize("accept", [0.9, 0.5])
def test_common_tops_against_a_loop(spark, accept):
    r = random.Random(5)
    rows, clusters, number = [], {}, 0
    for c in range(6):
        base = ("r", [("s", [(r.choice("abc"), []) for _ in range(5)], [("t", [("u", [])])]) for _ in range(6)])
        clusters[f"k{c}"] = []
        for _ in range(r.choice([1, 4, 12])):
            tree = edited(r, base) if r.random() < 0.9 else ("q", [])
            number += 1
            clusters[f"k{c}"].append(tree)
            rows += [(f"k{c}", *x) for x in node_rows(number, tree)]
    nodes = spark.createDataFrame(rows, "cluster string, " + schema())
    want = {}
    for name, trees in clusters.items():
        top, members = trees[0], 0
        for tree in trees[1:]:
            both = common(top, tree) if agree(top, tree) else None
            if both is not None and size(both) >= accept * size(top):
                top, members = both, members + 1
        if members:
            want[name] = (size(top), members)
    got = {x.cluster: (x["size"], x.members) for x in idioms.clone_overlap(nodes, accept).collect()}
    assert got == want and len(want) > 1


def schema():
    from grovespark.sources.text import NODES

    return NODES if isinstance(NODES, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODES.fields)
