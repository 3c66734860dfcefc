import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grovespark.functions import uniform
from grovespark.operators import grammar as gr
from grovespark.operators import sampling as sa
from grovespark.operators.structure import with_roots
from grovespark.plans.train import active_share, train
from tests.helpers import nodes_frame

ONE = ("1", [("2", ["4"], [])], [("2", ["5", "6"])])
TWO = ("1", [("1", ["4"], [("1", ["7"], [])])], [])
ALPHA, MEAN = 2.0, 5.0


@pytest.fixture(scope="module")
def corpus(spark):
    nodes = nodes_frame(spark, *[ONE] * 14, *[TWO] * 9).cache()
    rules = gr.rules_of_nodes(nodes).cache()
    rooted = with_roots(nodes, (F.col("tree_id") + F.col("node_id")) % 3 != 0).cache()
    return nodes, rules, gr.count_rules(rules).cache(), rooted


def test_scores_against_adding_fragments_one_by_one(spark, corpus):
    """The chance of m of n sites being split is that of adding all their fragments in turn to a corpus without them."""
    _, rules, cfg, rooted = corpus
    scored = sa.scored_sites(rooted, rules, cfg, sa.pick_sites(rooted, 3, 0)).cache()
    sites = scored.collect()
    all_fragments = [(r.head, r.rhs) for r in gr.fragments(rooted).collect()]
    prior = lambda x, r: 2 ** (r[f"{x}_prior"] + (r[f"{x}_size"] - 1) * math.log2(1 - 1 / MEAN) - math.log2(MEAN))
    seen = 0
    for t in sa.site_types(scored, ALPHA, MEAN).collect():
        mine = [r for r in sites if all(r[c] == t[c] for c in sa.SITE_TYPE)]
        name = {x: (mine[0][f"{x}_head"], mine[0][f"{x}_rhs"]) for x in "jul"}
        p = {x: prior(x, mine[0]) for x in "jul"}
        counts = Counter(all_fragments)
        for r in mine:
            for x in "ul" if r.was_root else "j":
                counts[name[x]] -= 1
        assert min(counts.values()) >= 0 and (t.n, t.n_split) == (len(mine), sum(r.was_root for r in mine))
        for m, score in enumerate(t.scores):
            now, want = counts.copy(), math.log2(math.comb(t.n, m))
            for kind in ["ul"] * m + ["j"] * (t.n - m):
                heads = Counter()
                for (head, _), n in now.items():
                    heads[head] += n
                for x in kind:
                    want += math.log2(now[name[x]] + ALPHA * p[x]) - math.log2(heads[name[x][0]] + ALPHA)
                for x in kind:
                    now[name[x]] += 1
            # a split draws both fragments from the same counts
            if name["u"] != name["l"]:
                assert score == pytest.approx(want, abs=1e-6)
                seen += 1
    assert seen > 10


def test_block_sweep_sets_the_drawn_number(spark, corpus):
    _, rules, cfg, rooted = corpus
    sites = sa.pick_sites(rooted, 3, 1)
    scored = sa.scored_sites(rooted, rules, cfg, sites)
    m = sa.draw_index(F.col("scores"), uniform(F.lit(1), *[F.col(c) for c in sa.SITE_TYPE], seed=3))
    drawn = {tuple(r[c] for c in sa.SITE_TYPE): r.m for r in sa.site_types(scored, ALPHA, MEAN).select(*sa.SITE_TYPE, m.alias("m")).collect()}
    after = sa.block_sweep(rooted, rules, cfg, ALPHA, MEAN, 3, 1).cache()
    now = after.select("tree_id", F.col("node_id").alias("site"), "is_root")
    got = Counter()
    for r in scored.join(now, ["tree_id", "site"]).collect():
        got[tuple(r[c] for c in sa.SITE_TYPE)] += r.is_root
    assert dict(got) == drawn
    key = ["tree_id", "node_id", "is_root"]
    changed = rooted.select(key).exceptAll(after.select(key)).select("tree_id", F.col("node_id").alias("site"))
    assert after.count() == rooted.count() and changed.exceptAll(changed.join(sites, ["tree_id", "site"], "left_semi")).count() == 0


def test_pinned_nodes_stay(spark, corpus):
    _, _, _, rooted = corpus
    pinned = spark.createDataFrame([("1", "2")], "parent_label string, label string")
    picked = sa.pick_sites(rooted, 1, 0, pinned).join(rooted.withColumnRenamed("node_id", "site"), ["tree_id", "site"])
    assert {r.label for r in picked.select("label").distinct().collect()} == {"1"}


def test_training_goes_on_where_it_ended(spark):
    nodes = nodes_frame(spark, *[ONE] * 4, *[TWO] * 3).coalesce(1).cache()
    options = {"mean_size": MEAN, "block": True, "growing": True}
    _, last = train(nodes, 3, **options)
    _, half = train(nodes, 3, stop=iter([False, True]).__next__, **options)
    _, resumed = train(nodes, 3, begin=2, rooted=half, **options)
    assert sorted(map(str, resumed.collect())) == sorted(map(str, last.collect()))
    assert active_share(0) == 0.05 and active_share(1000) == 1.0
