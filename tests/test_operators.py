import json
import math
from unittest import mock

import pytest
from pyspark.sql import functions as F

from grovespark.functions import log2_sum_exp
from grovespark.operators import cooccurrence as co
from grovespark.operators import grammar as gr
from grovespark.operators import idioms
from grovespark.operators import matching as ma
from grovespark.operators import probability as pr
from grovespark.operators import rewrite as rw
from grovespark.operators import sampling as sa
from grovespark.operators import structure as st
from grovespark.operators.ranking import running_sum
from grovespark.plans.train import final_threshold
from grovespark.sources import text as tx
from tests.helpers import nodes_frame, rules_frame

TREE_1 = ("1", [], [("3", [], ["6", "5"]), ("2", ["4"])], [])
SAMPLE = ("1", [("2", ["4"], [])], [("2", ["5", "6"])])


def test_rules_and_ml_probability(spark):
    one = nodes_frame(spark, ("1", [], ["3"], ["2"]), ("1", ["4"], [], []))
    grammar = gr.ml_probabilities(gr.count_rules(gr.rules_of_nodes(one)))
    assert {(r.rhs, r.p) for r in grammar.collect()} == {("|3|2", 0.5), ("4||", 0.5)}
    asked = spark.createDataFrame([("1", "|3|2"), ("1", "nothing"), ("9", "4")], "head string, rhs string")
    found = gr.look_up(asked, gr.count_rules(gr.rules_of_nodes(one)))
    got = found.select("head", "rhs", gr.ml_probability(F.col("cnt"), F.col("total")).alias("p")).collect()
    assert {(r.head, r.rhs): r.p for r in got} == {("1", "|3|2"): 0.5, ("1", "nothing"): 0.0, ("9", "4"): 1.0}


def test_prior_of_sample_tree(spark):
    nodes = nodes_frame(spark, SAMPLE)
    rules = gr.rules_of_nodes(nodes)
    found = pr.tree_log2_prior(rules, gr.count_rules(rules)).first()
    assert found.log2p == pytest.approx(math.log2(0.25))
    row = spark.range(1).select(pr.geometric_log2(F.lit(6), 10.0).alias("g")).first()
    assert row.g == pytest.approx(math.log2(0.9**5 * 0.1))


def test_posterior(spark):
    prior = math.log2(0.25 * 0.9**5 * 0.1)
    post = lambda remove: pr.posterior_log2(F.lit(1), F.lit(1), F.lit(prior), 10.0, remove)
    row = spark.range(1).select(post(True).alias("less"), post(False).alias("kept")).first()
    assert row.less == pytest.approx(prior)
    assert row.kept == pytest.approx(math.log2((1 + 10 * 2**prior) / 11))


def test_add_and_remove(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "head string, rhs string, cnt long")
    grammar = gr.add_counts(frame(("1", "a", 1)), frame(("1", "a", 1)), frame(("1", "b", 1)))
    assert {(r.rhs, r.cnt) for r in grammar.collect()} == {("a", 2), ("b", 1)}
    left = gr.remove_counts(grammar, frame(("1", "a", 1), ("1", "b", 5), ("2", "c", 1)))
    assert [(r.rhs, r.cnt) for r in left.collect()] == [("a", 1)]
    pruned = gr.prune(frame(("1", "a", 5), ("1", "b", 1), ("1", "c", 1), ("2", "x", 1)), 2)
    assert {(r.rhs, r.cnt) for r in pruned.collect()} == {("a", 5), ("UNK", 2)}


def test_fragments(spark):
    nodes = nodes_frame(spark, ("1", [("2", ["4"])], [("3", ["5", "6"])]))
    cut = st.with_roots(nodes, F.col("label") == "2")
    found = {r["head"]: (r.rhs, r["size"]) for r in gr.fragments(cut).collect()}
    assert found == {"1": ("*1(1.1) *2(0) 3(2) 5() 6()", 5), "2": ("*2(1) 4()", 2)}
    whole = st.with_roots(nodes, F.lit(False))
    assert [r["size"] for r in gr.fragments(whole).collect()] == [6]


FULL = ("1", ["0"], [("1", [("2", ["4"])], ["8"])])
#: A tree that grows, and whether it (and the full tree the other way) matches as prefix, reaches as far, matches with all children.
STAGES = [
    (("1", ["0"], []), "TFFTFF"),
    (("1", ["0"], [("1", [], [])]), "TFTFTF"),
    (("1", ["0"], [("1", [("2", [])], [])]), "TFFFFF"),
    (("1", ["0"], [("1", [("2", ["4"])], [])]), "TFFTFF"),
    (FULL, "TTTTTT"),
    (("1", ["0"], [("1", [("2", ["4"])], ["8", "9"])]), "FTTFFF"),
]


def test_matching_stages(spark):
    """All stages at once: trees 1 to 6 are the stages, 7 is the full tree."""
    trees = [t for t, _ in STAGES] + [FULL]
    nodes, rules = nodes_frame(spark, *trees), rules_frame(spark, *trees)
    tops = lambda df: {(r.rule_id, r.tree_id) for r in df.where("anchor = 0 AND (rule_id = 7 OR tree_id = 7)").collect()}
    prefix, over, whole = tops(ma.match_sites(rules, nodes)), tops(ma.supertree_sites(rules, nodes)), tops(ma.match_sites(rules, nodes, all_children=True))
    for k, (_, expected) in enumerate(STAGES, 1):
        got = [p in found for found in (prefix, over, whole) for p in ((k, 7), (7, k))]
        assert "".join("T" if x else "F" for x in got) == expected, k


def test_matching_deep(spark):
    tree = ("1", [("2", ["3", "4"], [])], [("2", ["3"], [])])
    patterns = rules_frame(spark, ("2", ["3"], []), ("2", ["3", "4"], []), ("2", [], []), ("1", [("2", [], [])], []))
    sites = lambda **k: sorted((r.rule_id, r.anchor) for r in ma.match_sites(patterns, nodes_frame(spark, tree), **k).collect())
    assert sites() == [(1, 1), (1, 4), (2, 1), (3, 1), (3, 4), (4, 0)]
    assert sites(all_children=True) == [(1, 4), (2, 1), (3, 1), (3, 4)]
    assert ma.covered_nodes(patterns, nodes_frame(spark, tree)).where("rule_id = 2").count() == 3


def test_overlaps(spark):
    nodes = nodes_frame(spark, ("1", ["2", "3", "4"]), ("1", ["2", "9", "4", "5"]))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert sorted(r.node_id for r in ma.maximal_overlap(nodes, nodes, pairs).collect()) == [0, 1]
    assert sorted(r.node_id for r in ma.overlap(nodes, nodes, pairs).collect()) == [0, 1, 3]


@pytest.mark.parametrize("more,expected", [([], math.log2(0.75)), (["x"], float("-inf"))])
def test_inside_probability(spark, more, expected):
    """Two ways to build the tree; none for one with a child that no rule has."""
    grammar = [("A", [("B", ["D", "E"]), "C"]), ("A", [("B", []), "C"]), ("B", ["D", "E"]), ("B", ["D", "F"]), ("D", ["A", "C"])]
    rules = rules_frame(spark, *grammar)
    log2p = spark.createDataFrame([(1, -1.0), (2, -1.0), (3, -1.0), (4, -1.0), (5, 0.0)], "rule_id long, log2p double")
    tree = nodes_frame(spark, ("A", [("B", ["D", "E"] + more), "C"]))
    # leaves of the grammar's nodes carry one property where the tree's do
    assert pr.inside_log2(tree, rules, log2p).first().log2p == pytest.approx(expected)


def test_forms_round_trip(spark):
    nodes = nodes_frame(spark, TREE_1, SAMPLE, ("7",), ("8", [], ["9"]))
    forms = st.canonical(nodes, ["tree_id"]).select(F.col("tree_id").alias("rule_id"), F.col("canon").alias("form"))
    key = ["rule_id", "node_id", "parent_id", "prop_idx", "child_idx", "last_desc", "label", "n_props", "is_leaf"]
    want = nodes.withColumnRenamed("tree_id", "rule_id").select(key).collect()
    assert sorted(map(tuple, idioms.parse_forms(forms).select(key).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_binarize_round_trip(spark):
    nodes = nodes_frame(spark, ("1", ["3", ("2", ["4", "5", "6", "7", "8", "9"])], ["x", "y", "z"]))
    key = ["tree_id", "node_id", "parent_id", "prop_idx", "child_idx", "label"]
    assert sorted(map(tuple, rw.debinarize(rw.binarize(nodes)).select(key).collect()), key=str) == sorted(map(tuple, nodes.select(key).collect()), key=str)


def test_block_scores_and_draws(spark):
    """Two sites of equal weight: split and joined are equally likely."""
    lit = F.lit
    scores = sa.block_scores(lit(1).cast("long"), lit(0).cast("long"), {k: lit(v) for k, v in {"u": 0, "l": 0, "j": 1, "nu": 1, "nl": 0}.items()}, {"u": lit(-1.0), "l": lit(-1.0), "j": lit(-2.0)}, lit(0), lit(0), 10.0)
    row = spark.range(1).select(scores.alias("s")).first().s
    assert row[0] == pytest.approx(row[1])
    draws = spark.range(1000).select(sa.draw_index(F.array(lit(-1.0), lit(-2.0), lit(-2.0)), (F.col("id") + 0.5) / 1000).alias("k")).groupBy("k").count()
    assert {r.k: r["count"] for r in draws.collect()} == {0: 500, 1: 250, 2: 250}
    p = spark.range(1).select(sa.join_probability(lit(-1.0), lit(-2.0)).alias("p"), sa.join_probability(lit(float("-inf")), lit(-2.0)).alias("q")).first()
    assert (p.p, p.q) == (pytest.approx(2 / 3), 0.0)


def test_sweep_keeps_tops_and_leaves(spark):
    nodes = nodes_frame(spark, SAMPLE, SAMPLE, ("1", ["2"], []))
    rules = gr.rules_of_nodes(nodes)
    rooted = st.with_roots(nodes, F.lit(False))
    after = sa.sweep(rooted, rules, gr.count_rules(rules), 10.0, 10.0, seed=3, step=0)
    assert after.where("parent_id IS NULL AND NOT is_root").count() == 0
    assert after.where("parent_id IS NOT NULL AND is_leaf AND is_root").count() == 0
    assert after.count() == rooted.count()


def test_generation_follows_rules(spark):
    rules = spark.createDataFrame([("A", "B,C", 3), ("A", "C", 1), ("B", "c", 1)], "head string, rhs string, cnt long")
    heads = spark.range(400).select(F.col("id").alias("sample"), F.lit("A").alias("head"))
    got = sa.generate(heads, rules, 1, 4)
    first = {r.rhs: r["count"] for r in got.where("head = 'A'").groupBy("rhs").count().collect()}
    assert sum(first.values()) == 400 and abs(first["C"] - 100) < 40
    assert got.where("head = 'B'").count() == first["B,C"]


def test_cooccurrence(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "b")], "doc long, row string")
    cols = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc long, col string")
    pairs = co.count_pairs(rows, cols)
    got = {(r.row, r.col): r.lift for r in co.lifts(pairs, rows, cols).collect()}
    assert got["a", "x"] == pytest.approx(math.log((2 / 4) / (2 / 4) / (2 / 3)))
    asked = co.log_lift(spark.createDataFrame([("a", "y")], "row string, col string"), co.lifts(pairs, rows, cols))
    assert asked.first().lift == float("-inf")


def test_html_and_clones(spark):
    pages = spark.createDataFrame([(1, '<p>a<br>b<b>c</p><script>var t="</p>";</script><p>'), (2, None), (3, "")], "page_id long, html string")
    got = [(r.label, r.parent_id, r.last_desc) for r in tx.html_trees(pages).where("tree_id = 1").orderBy("node_id").collect()]
    assert got == [("#document", None, 5), ("p", 0, 3), ("br", 1, 2), ("b", 1, 3), ("script", 0, 4), ("p", 0, 5)]
    assert tx.html_trees(pages).where("tree_id > 1").count() == 2
    lines = ["000001\tdist:0.0\tFILE a.java LINE:10:5", "", "000002\tdist:1.5\tFILE b/c.java LINE:1:2", "noise"]
    frame = spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)], "file string, line_no long, line string")
    assert sorted((r.cluster, r.file, r.first_line, r.n_lines, r.distance) for r in tx.clone_clusters(frame).collect()) == [(0, "a.java", 10, 5, 0.0), (1, "b/c.java", 1, 2, 1.5)]


def test_page_that_the_parser_refuses(spark):
    with mock.patch.object(tx._Tree, "close", side_effect=AssertionError("no such section")):
        assert tx.parsed("<p>x") == ([["#document", None]], "no such section")
    assert tx.parsed("<p><b>x</b></p>") == ([["#document", None], ["p", 0], ["b", 1]], None)
    pages = spark.createDataFrame([(1, "<p>x</p><![bad"), (2, "<p><b>x</b></p>"), (3, None)], "page_id long, html string")
    got = tx.html_trees(pages).groupBy("tree_id").agg(F.count("*").alias("n"), F.count("error").alias("errors")).collect()
    assert {(r.tree_id, r.n) for r in got} == {(1, 2), (2, 3), (3, 1)} and sum(r.errors for r in got) == 0


def test_nested_json(spark):
    nodes = nodes_frame(spark, TREE_1, ('a"b\n', [("c", ["\u00e9", "x\\y"])], ["z"]), ("alone",))
    got = {r.tree_id: json.loads(r.json) for r in tx.nested_json(nodes).collect()}
    made = lambda name, *children: {"name": name, "children": list(children)}
    assert got == {
        1: made("1", made("3", made("6"), made("5")), made("2", made("4"))),
        2: made('a"b\n', made("c", made("\u00e9"), made("x\\y")), made("z")),
        3: made("alone"),
    }


def test_log_sum_of_tiny_probabilities(spark):
    rows = spark.createDataFrame([("a", -3000.0), ("a", -3000.0), ("a", float("-inf")), ("b", float("-inf")), ("c", -1.0)], "k string, x double")
    got = {r.k: r.log2p for r in log2_sum_exp(rows, ["k"], F.col("x")).collect()}
    assert got == {"a": -2999.0, "b": float("-inf"), "c": -1.0}


def test_running_sum(spark):
    rows = spark.range(0, 1000, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("x"), (F.col("id") % 5).alias("v"))
    got = running_sum(rows, [F.desc("x")], F.col("v"), "upto").orderBy(F.desc("x")).collect()
    total = 0
    for r in got:
        total += r.v
        assert r.upto == total
    assert len(got) == 1000
    assert running_sum(rows.limit(0), [F.col("x")], F.col("v"), "upto").count() == 0


def test_variable_types(spark):
    nodes = nodes_frame(spark, ("r", ["x", "5", ("x", ["y"])]))
    kinds = spark.createDataFrame([("x", "int")], "label string, type string"), spark.createDataFrame([("5", "%NUM%")], "label string, type string")
    rows = lambda delegated: {(r.node_key, r.parent_key, r.child_idx, r.label, r.n_props) for r in rw.variable_types(nodes, *kinds, delegated).collect()}
    common = {("n0", None, None, "r", 1), ("n2", "t2", 0, "5", 0), ("t2", "n0", 1, "%TEMPLATE%:%NUM%", 1), ("n3", "n0", 2, "x", 1), ("n4", "n3", 0, "y", 0)}
    assert rows(False) == common | {("n1", "n0", 0, "%TEMPLATE%:int", 0)}
    assert rows(True) == common | {("n1", "t1", 0, "%TEMPLATE%:int", 0), ("t1", "n0", 0, "%GenericVariable%", 1)}
    assert [r[0] for r in spark.createDataFrame([("%TEMPLATE%:int",), ("x",)], "l string").select(rw.is_template(F.col("l"))).collect()] == [True, False]


def test_symbol_lines(spark):
    rows = spark.createDataFrame([("X", {"k": "v"}, ["q", "p"], {}), ("Y", {}, [], {"b": "2", "a": "1"})], "kind string, simple map<string,string>, child_props array<string>, annotations map<string,string>")
    assert [r.line for r in tx.symbol_lines(rows).orderBy("kind").collect()] == ["Type : X Simple Props: [k:v, ] Child Props: [p, q, ] Annotations: []", "Type : Y Simple Props: [] Child Props: [] Annotations: [a:1, b:2, ]"]


def test_long_chain_printed(spark):
    nodes = nodes_frame(spark, ("r", [str(k) for k in range(40)], ["a", "b"]))
    got = rw.printed_chains(rw.binarize(nodes)).collect()
    assert [(r.parent_key, r.prop_idx, r.text) for r in got] == [("n0", 0, " ".join(str(k) for k in range(40)))]


def test_entropy_report(spark):
    inside = spark.createDataFrame([(1, -6.0), (2, -1.0)], "tree_id long, log2p double")
    tokens = spark.createDataFrame([(1, 3), (2, 0)], "tree_id long, tokens long")
    assert {r.tree_id: r.per_token for r in pr.entropy_report(inside, tokens).collect()} == {1: -2.0, 2: 0.0}


def test_final_threshold():
    assert final_threshold(50) == 27


def test_posterior_of_an_unlikely_fragment(spark):
    post = lambda n, total: pr.posterior_log2(F.lit(n), F.lit(total), F.lit(-5000.0), 2.0, True)
    row = spark.range(1).select(post(1, 4).alias("last"), post(0, 0).alias("new"), post(3, 4).alias("often")).first()
    assert row.last == pytest.approx(1 - 5000 - math.log2(5))
    assert row.new == pytest.approx(-5000.0)
    assert row.often == pytest.approx(math.log2(2 / 5))


def test_greedy_ranking_against_a_loop(spark):
    covered = {1: {1, 2, 3, 4}, 2: {3, 4, 5, 6, 7, 8}, 3: {9}, 4: {1, 2}}
    gain, size = {1: 3.0, 2: 2.0, 3: 1.0, 4: 3.0}, {1: 2, 2: 2, 3: 2, 4: 1}
    frame = spark.createDataFrame([(k, 1, n) for k, v in covered.items() for n in v], "rule_id long, tree_id long, node_id int")
    gains = spark.createDataFrame([(k, gain[k], size[k]) for k in gain], "rule_id long, gain double, size int")
    want, left = [], {k: set(v) for k, v in covered.items()}
    while True:
        score, best = max((gain[k] * (len(left[k]) // size[k]), -k) for k in left)
        if score <= 0:
            break
        want.append((len(want) + 1, -best, score))
        taken = set(left[-best])
        left = {k: v - taken for k, v in left.items()}
    assert [tuple(r) for r in idioms.rank_greedily(frame, gains).orderBy("rank").collect()] == want


def test_hyperparameters_against_a_loop(spark):
    rows = [("a", 3, 5, -2.0, 4), ("b", 1, 5, -5000.0, 3), ("c", 1, 1, -1.0, 1)]
    frame = spark.createDataFrame(rows, "rhs string, cnt long, total long, prior double, size int")
    got = {(r.alpha, r.mean_size): r.log2p for r in sa.hyperparameters(frame, [0.5, 10.0], [2.0, 5.0]).collect()}
    for alpha, mean in got:
        want = 0.0
        for _, cnt, total, prior, size in rows:
            prior += (size - 1) * math.log2(1 - 1 / mean) - math.log2(mean)
            others = math.log2(cnt - 1 + alpha * 2**prior) if cnt > 1 else math.log2(alpha) + prior
            want += cnt * (others - math.log2(total - 1 + alpha))
        assert got[alpha, mean] == pytest.approx(want)
    assert len(got) == 4


def test_clone_overlap(spark):
    nodes = nodes_frame(spark, ("r", ["a", "b"]), ("r", ["a", "b"]), ("r", ["a", "c"]), ("q", ["a"]))
    cluster = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k"), (4, "l")], "tree_id long, cluster string")
    got = idioms.clone_overlap(nodes.join(cluster, "tree_id"), 0.9).collect()
    assert [(r.cluster, r.size, r.members) for r in got] == [("k", 3, 1)]


def chain(n):
    tree = ("x",)
    for k in range(n - 1):
        tree = (str(k % 7), [tree])
    return tree


def test_deep_trees_have_no_limit(spark):
    nodes = nodes_frame(spark, chain(12), chain(12)).coalesce(1).cache()
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert ma.overlap(nodes, nodes, pairs).count() == 12
    assert ma.height(rules_frame(spark, chain(67)).coalesce(1)) == 66
