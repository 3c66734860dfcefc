"""Registered queries of the tree operators, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.functions import uniform, without_roots
from grovespark.operators import cooccurrence as co
from grovespark.operators import grammar as gr
from grovespark.operators import hyper, idioms, keys
from grovespark.operators import matching as ma
from grovespark.operators import probability as pr
from grovespark.operators import rewrite as rw
from grovespark.operators import sampling as sa
from grovespark.operators import segmentation as se
from grovespark.operators import structure as st
from grovespark.plans.state import cut
from grovespark.plans.train import node_priors, train
from grovespark.sources import text as tx
from grovespark.sources.relational import NODE_COLUMNS, NODES_SQL, customer_trees, read
from grovespark.streaming import counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def over_nodes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(x.strip() for x in (NODES_SQL, *ctes)) + "\n" + body


#: Every third inner node begins a fragment.
ROOTED = "rooted AS (SELECT *, parent_id IS NULL OR (NOT is_leaf AND (tree_id + node_id) % 3 = 0) AS is_root FROM nodes)"
RULES = """
rules AS (
  SELECT n.tree_id, n.node_id, n.label AS head,
    coalesce(string_agg(c.label, ',' ORDER BY c.child_idx) FILTER (c.prop_idx = 0), '')
      || CASE WHEN n.n_props = 2 THEN '|' || coalesce(string_agg(c.label, ',' ORDER BY c.child_idx) FILTER (c.prop_idx = 1), '') ELSE '' END AS rhs
  FROM nodes n LEFT JOIN nodes c ON c.tree_id = n.tree_id AND c.parent_id = n.node_id
  WHERE n.parent_id IS NULL OR NOT n.is_leaf GROUP BY n.tree_id, n.node_id, n.label, n.n_props)"""
CFG = "cfg AS (SELECT head, rhs, count(*) AS cnt FROM rules WHERE tree_id % 2 = 0 GROUP BY head, rhs), heads AS (SELECT head, sum(cnt) AS total FROM cfg GROUP BY head)"
LOOKED = "looked AS (SELECT r.*, coalesce(c.cnt, 0) AS cnt, coalesce(h.total, 0) AS total FROM rules r LEFT JOIN cfg c ON c.head = r.head AND c.rhs = r.rhs LEFT JOIN heads h ON h.head = r.head)"
P = "CASE WHEN total = 0 THEN 1.0 ELSE CAST(cnt AS DOUBLE) / total END"
FRAGMENTS = """
upper_of AS (
  SELECT n.tree_id, n.node_id, max(r.node_id) AS frag_root FROM rooted n JOIN rooted r ON r.tree_id = n.tree_id AND r.is_root AND r.node_id < n.node_id AND n.node_id <= r.last_desc
  GROUP BY n.tree_id, n.node_id),
frag_nodes AS (
  SELECT tree_id, node_id AS frag_root, node_id, label, is_root, child_counts FROM rooted WHERE is_root
  UNION ALL
  SELECT n.tree_id, u.frag_root, n.node_id, n.label, n.is_root, CASE WHEN n.is_root THEN list_transform(n.child_counts, lambda x: 0) ELSE n.child_counts END
  FROM rooted n JOIN upper_of u ON u.tree_id = n.tree_id AND u.node_id = n.node_id),
frags AS (
  SELECT tree_id, frag_root, arg_min(label, node_id) AS head, count(*) AS size,
    string_agg((CASE WHEN is_root THEN '*' ELSE '' END) || label || '(' || array_to_string(child_counts, '.') || ')', ' ' ORDER BY node_id) AS rhs
  FROM frag_nodes GROUP BY tree_id, frag_root),
tsg AS (SELECT head, rhs, size, count(*) AS cnt FROM frags GROUP BY head, rhs, size)"""


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_trees(spark, sf_dir)


def rooted_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as the way to the nearest root is looked up several times."""
    return cut(st.with_roots(nodes_of(spark, sf_dir), (F.col("tree_id") + F.col("node_id")) % 3 == 0))


def trained(rules: DataFrame) -> DataFrame:
    """Rule counts of even trees."""
    return pr.train_cfg(rules, F.col("tree_id") % 2 == 0)


@query(over_nodes("SELECT head, rhs, cnt, total, CAST(cnt AS DOUBLE) / total AS p FROM cfg JOIN heads USING (head)", RULES, CFG))
def cfg_ml_prob(spark, sf_dir):
    out = gr.ml_probabilities(trained(gr.rules_of_nodes(nodes_of(spark, sf_dir))))
    return out.select("head", "rhs", "cnt", "total", "p")


@query(over_nodes(f"SELECT tree_id, round(sum(log2(CASE WHEN {P} = 0 THEN 1e-9 ELSE {P} END)), 6) AS log2p FROM looked GROUP BY tree_id", RULES, CFG, LOOKED))
def cfg_tree_logprob(spark, sf_dir):
    rules = gr.rules_of_nodes(nodes_of(spark, sf_dir))
    return pr.tree_log2_prior(rules, trained(rules)).select("tree_id", F.round("log2p", 6).alias("log2p"))


@query(over_nodes("SELECT tree_id, node_id, parent_id, prop_idx, child_idx, depth, last_desc, label, n_props, array_to_string(child_counts, '.') AS child_counts, is_leaf FROM nodes"))
def tree_nodes(spark, sf_dir):
    return nodes_of(spark, sf_dir).select(*NODE_COLUMNS).withColumn("child_counts", F.array_join(F.col("child_counts").cast("array<string>"), "."))


@query(over_nodes("SELECT tree_id, count(*) AS size FROM nodes GROUP BY tree_id"))
def tree_size(spark, sf_dir):
    return st.tree_sizes(nodes_of(spark, sf_dir))


@query(over_nodes("SELECT n.tree_id, n.node_id, count(*) AS size FROM nodes n JOIN nodes d ON d.tree_id = n.tree_id AND d.node_id BETWEEN n.node_id AND n.last_desc GROUP BY n.tree_id, n.node_id"))
def subtree_size(spark, sf_dir):
    return st.subtree_sizes(nodes_of(spark, sf_dir))


@query(over_nodes("SELECT tree_id, count(*) FILTER (is_leaf) AS leaves, count(*) FILTER (is_leaf AND n_props > 0) AS empty_inner FROM nodes GROUP BY tree_id"))
def leaf_count(spark, sf_dir):
    return st.leaf_counts(nodes_of(spark, sf_dir))


@query(over_nodes("SELECT depth, count(*) AS nodes FROM nodes GROUP BY depth"))
def depth_hist(spark, sf_dir):
    return st.depth_histogram(nodes_of(spark, sf_dir))


@query(over_nodes("SELECT tree_id, label, count(*) AS n FROM nodes GROUP BY tree_id, label"))
def label_multiset(spark, sf_dir):
    return st.label_multiset(nodes_of(spark, sf_dir))


@query(
    over_nodes(
        """SELECT n.tree_id, n.node_id, string_agg(a.label, '>' ORDER BY a.depth DESC) AS labels,
  concat_ws('>', any_value(n.prop_idx), string_agg(CAST(a.prop_idx AS VARCHAR), '>' ORDER BY a.depth DESC)) AS props,
  concat_ws('>', any_value(n.child_idx), string_agg(CAST(a.child_idx AS VARCHAR), '>' ORDER BY a.depth DESC)) AS places
FROM nodes n JOIN nodes a ON a.tree_id = n.tree_id AND a.node_id < n.node_id AND n.node_id <= a.last_desc GROUP BY n.tree_id, n.node_id"""
    )
)
def node_paths(spark, sf_dir):
    return st.node_paths(nodes_of(spark, sf_dir))


@query(over_nodes("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS symbol_id FROM (SELECT DISTINCT label FROM nodes)"))
def symbol_dictionary(spark, sf_dir):
    return st.symbols(nodes_of(spark, sf_dir))


@query(over_nodes("SELECT tree_id, string_agg(label || '(' || array_to_string(child_counts, '.') || ')', ' ' ORDER BY node_id) AS canon, count(*) AS size FROM nodes GROUP BY tree_id"))
def canonical_tree(spark, sf_dir):
    return st.canonical(nodes_of(spark, sf_dir), ["tree_id"])


@query(over_nodes("SELECT head, rhs, count(*) AS cnt FROM rules GROUP BY head, rhs", RULES))
def cfg_rules(spark, sf_dir):
    return gr.count_rules(gr.rules_of_nodes(nodes_of(spark, sf_dir)))


@query(over_nodes("SELECT head, rhs, cnt FROM (SELECT head, rhs, sum(CASE WHEN tree_id % 2 = 0 THEN 1 ELSE 2 END) AS cnt FROM rules GROUP BY head, rhs) WHERE cnt != 0", RULES))
def cfg_prior_with_more(spark, sf_dir):
    rules = gr.rules_of_nodes(nodes_of(spark, sf_dir))
    more = gr.count_rules(rules.where("tree_id % 2 = 1"))
    return gr.add_counts(gr.count_rules(rules), more)


@query(
    over_nodes(
        f"""SELECT tree_id, CASE WHEN min({P}) = 0 THEN NULL ELSE round(sum(CASE WHEN {P} = 0 THEN 0 ELSE log2({P}) END), 6) END AS log2p, any_value(tokens) AS tokens,
  CASE WHEN min({P}) = 0 THEN NULL ELSE round(sum(CASE WHEN {P} = 0 THEN 0 ELSE log2({P}) END) / any_value(tokens), 6) END AS per_token
FROM looked JOIN (SELECT tree_id, count(*) AS tokens FROM nodes WHERE is_leaf GROUP BY tree_id) USING (tree_id) GROUP BY tree_id""",
        RULES, CFG, LOOKED,
    )
)
def cfg_entropy(spark, sf_dir):
    """Minus infinity is shown as null."""
    nodes = nodes_of(spark, sf_dir)
    rules, tokens = gr.rules_of_nodes(nodes), nodes.where("is_leaf").groupBy("tree_id").agg(F.count("*").alias("tokens"))
    out = pr.document_entropy(rules, trained(rules), tokens)
    shown = lambda c: F.when(F.col(c) == float("-inf"), None).otherwise(F.round(c, 6)).alias(c)
    return out.select("tree_id", shown("log2p"), "tokens", shown("per_token"))


@query(over_nodes(f"SELECT CASE WHEN total = 0 THEN 'no head' WHEN cnt = 0 THEN 'no rule' ELSE 'known' END AS kind, count(*) AS n, round(avg({P}), 9) AS mean_p FROM looked GROUP BY 1", RULES, "cfg AS (SELECT head, rhs, count(*) AS cnt FROM rules WHERE tree_id % 2 = 0 AND head != 'BUILDING' GROUP BY head, rhs), heads AS (SELECT head, sum(cnt) AS total FROM cfg GROUP BY head)", LOOKED))
def cfg_unknown_head(spark, sf_dir):
    rules = gr.rules_of_nodes(nodes_of(spark, sf_dir))
    found = gr.look_up(rules, pr.train_cfg(rules, F.expr("tree_id % 2 = 0 AND head != 'BUILDING'")))
    kind = F.when(F.col("total") == 0, "no head").when(F.col("cnt") == 0, "no rule").otherwise("known")
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(gr.ml_probability(F.col("cnt"), F.col("total"))), 9).alias("mean_p"))


@query(over_nodes("SELECT tree_id, frag_root, head, rhs, size FROM frags", ROOTED, FRAGMENTS))
def tsg_fragments(spark, sf_dir):
    return gr.fragments(rooted_of(spark, sf_dir))


@query(over_nodes("SELECT * FROM tsg", ROOTED, FRAGMENTS))
def tsg_counts(spark, sf_dir):
    return gr.count_fragments(gr.fragments(rooted_of(spark, sf_dir)))


@query(
    over_nodes(
        """SELECT head, CASE WHEN cnt < 3 THEN 'UNK' ELSE rhs END AS rhs, CAST(sum(cnt) AS BIGINT) AS cnt
FROM (SELECT *, sum(cnt) OVER (PARTITION BY head) AS total FROM tsg) WHERE total >= 3 GROUP BY 1, 2""",
        ROOTED, FRAGMENTS,
    )
)
def tsg_prune(spark, sf_dir):
    return gr.prune(gr.count_fragments(gr.fragments(rooted_of(spark, sf_dir))), 3)


@query(over_nodes("SELECT size, CAST(sum(cnt) AS BIGINT) AS cnt FROM tsg GROUP BY size", ROOTED, FRAGMENTS))
def tsg_size_hist(spark, sf_dir):
    return gr.size_histogram(gr.count_fragments(gr.fragments(rooted_of(spark, sf_dir))))


@query(
    over_nodes(
        """SELECT CAST(sum(CASE WHEN size <= 5 THEN cnt ELSE 0 END) AS BIGINT) AS to_5, CAST(sum(CASE WHEN size > 5 AND size <= 15 THEN cnt ELSE 0 END) AS BIGINT) AS to_15,
  CAST(sum(CASE WHEN size > 15 AND size <= 30 THEN cnt ELSE 0 END) AS BIGINT) AS to_30, CAST(sum(CASE WHEN size > 30 THEN cnt ELSE 0 END) AS BIGINT) AS over_30,
  round(sum(size * cnt) / sum(cnt), 9) AS mean_size FROM tsg""",
        ROOTED, FRAGMENTS,
    )
)
def tsg_size_buckets(spark, sf_dir):
    out = gr.size_buckets(gr.count_fragments(gr.fragments(rooted_of(spark, sf_dir))))
    return out.withColumn("mean_size", F.round("mean_size", 9))


@query(over_nodes("SELECT head, rhs, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT head, rhs, CASE WHEN tree_id % 5 = 0 THEN 2 ELSE 1 END AS n FROM frags) GROUP BY head, rhs", ROOTED, FRAGMENTS))
def tsg_merge(spark, sf_dir):
    found = gr.fragments(rooted_of(spark, sf_dir))
    return gr.add_counts(gr.count_rules(found), gr.count_rules(found.where("tree_id % 5 = 0")))


@query(
    over_nodes(
        """SELECT head, rhs, cnt - least(cnt, gone) AS cnt FROM
(SELECT head, rhs, count(*) AS cnt, 2 * count(*) FILTER (tree_id % 5 = 0) AS gone FROM frags GROUP BY head, rhs) WHERE cnt > gone""",
        ROOTED, FRAGMENTS,
    )
)
def tsg_remove(spark, sf_dir):
    """More is taken away of some than there is."""
    found = gr.fragments(rooted_of(spark, sf_dir))
    gone = gr.count_rules(found.where("tree_id % 5 = 0")).withColumn("cnt", 2 * F.col("cnt"))
    return gr.remove_counts(gr.count_rules(found), gone)


RARE = """
inner_rules AS (SELECT r.* FROM rules r JOIN nodes n USING (tree_id, node_id) WHERE NOT n.is_leaf),
rare AS (SELECT tree_id, node_id FROM inner_rules JOIN (SELECT head, rhs FROM inner_rules GROUP BY head, rhs HAVING count(*) < 3) USING (head, rhs)),
rooted AS (SELECT n.*, n.parent_id IS NULL OR r.node_id IS NOT NULL AS is_root FROM nodes n LEFT JOIN rare r ON r.tree_id = n.tree_id AND r.node_id = n.parent_id),
placed AS (
  SELECT n.tree_id, n.node_id, n.label, CASE WHEN any_value(n.is_root) THEN n.node_id ELSE max(r.node_id) END AS new_root
  FROM rooted n LEFT JOIN rooted r ON r.tree_id = n.tree_id AND r.is_root AND r.node_id < n.node_id AND n.node_id <= r.last_desc GROUP BY n.tree_id, n.node_id, n.label)"""


@query(over_nodes("SELECT tree_id, new_root, node_id, label FROM (SELECT *, count(*) OVER (PARTITION BY tree_id, new_root) AS n FROM placed) WHERE n > 1", RULES, RARE))
def corpus_filter(spark, sf_dir):
    return gr.filter_corpus(nodes_of(spark, sf_dir), 3)


PRIORS = """
frag_rules AS (
  SELECT CASE WHEN n.is_root THEN n.node_id ELSE u.frag_root END AS frag_root, l.* FROM looked l JOIN rooted n USING (tree_id, node_id) LEFT JOIN upper_of u USING (tree_id, node_id)),
priors AS (SELECT tree_id, frag_root, sum(log2(CASE WHEN p = 0 THEN 1e-9 ELSE p END)) AS prior FROM (SELECT *, {P} AS p FROM frag_rules) GROUP BY tree_id, frag_root),
scored AS (
  SELECT f.*, prior, t.cnt, sum(1) OVER (PARTITION BY f.head) AS total FROM frags f JOIN priors USING (tree_id, frag_root) JOIN tsg t ON t.head = f.head AND t.rhs = f.rhs)""".replace("{P}", P)


def fragment_priors(spark, sf_dir):
    rooted = rooted_of(spark, sf_dir)
    rules, upper = cut(gr.rules_of_nodes(rooted)), gr.fragment_of_nodes(rooted)
    return cut(gr.fragments(rooted, upper)), pr.fragment_log2_prior(rooted, upper, rules, trained(rules))


@query(over_nodes("SELECT tree_id, frag_root, round(prior, 6) AS prior, round(prior + (size - 1) * log2(0.9) + log2(0.1), 6) AS with_size FROM scored", ROOTED, FRAGMENTS, RULES, CFG, LOOKED, PRIORS))
def prior_geometric(spark, sf_dir):
    found, priors = fragment_priors(spark, sf_dir)
    joined = found.join(priors, ["tree_id", "frag_root"])
    return joined.select("tree_id", "frag_root", F.round("prior", 6).alias("prior"), F.round(F.col("prior") + pr.geometric_log2(F.col("size"), 10.0), 6).alias("with_size"))


@query(over_nodes("SELECT tree_id, frag_root, cnt, CAST(total AS BIGINT) AS total, round(least(0, log2(cnt + 10 * pow(2, prior)) - log2(total + 10)), 6) AS posterior, round(least(0, log2(cnt - 1 + 10 * pow(2, prior)) - log2(total - 1 + 10)), 6) AS without_one FROM scored", ROOTED, FRAGMENTS, RULES, CFG, LOOKED, PRIORS))
def posterior_rule(spark, sf_dir):
    out = pr.fragment_posteriors(*fragment_priors(spark, sf_dir), alpha=10.0)
    less = pr.posterior_log2(F.col("cnt"), F.col("total"), F.col("prior"), 10.0, remove=True)
    return out.select("tree_id", "frag_root", "cnt", "total", F.round("posterior", 6).alias("posterior"), F.round(less, 6).alias("without_one"))


@query(over_nodes("SELECT tree_id, round(sum(least(0, log2(cnt + 10 * pow(2, prior)) - log2(total + 10))), 6) AS log2p, CAST(sum(size) AS BIGINT) AS nodes FROM scored GROUP BY tree_id", ROOTED, FRAGMENTS, RULES, CFG, LOOKED, PRIORS))
def tree_posterior(spark, sf_dir):
    out = pr.tree_posteriors(pr.fragment_posteriors(*fragment_priors(spark, sf_dir), alpha=10.0))
    return out.select("tree_id", F.round("log2p", 6).alias("log2p"), "nodes")


#: Patterns are the forms of fragments that occur at least three times with two nodes or more, in all trees; a form is its own id.
#: Their nodes are those of a form's first occurrence.
PATTERNS = """
kept AS MATERIALIZED (SELECT replace(rhs, '*', '') AS rule_id, size, CAST(sum(cnt) AS BIGINT) AS cnt FROM tsg WHERE cnt >= 3 AND size >= 2 GROUP BY 1, 2),
examples AS (SELECT rule_id, min({{'t': f.tree_id, 'r': f.frag_root}}) AS x FROM kept JOIN frags f ON replace(f.rhs, '*', '') = rule_id GROUP BY rule_id),
ranked AS (
  SELECT e.rule_id, f.tree_id, f.node_id AS old_id, f.frag_root, f.label, f.child_counts, CAST(row_number() OVER (PARTITION BY e.rule_id ORDER BY f.node_id) - 1 AS INT) AS node_id
  FROM examples e JOIN frag_nodes f ON f.tree_id = e.x.t AND f.frag_root = e.x.r),
patterns AS MATERIALIZED (
  SELECT r.rule_id, r.node_id, u.node_id AS parent_id, CASE WHEN u.node_id IS NULL THEN NULL ELSE n.prop_idx END AS prop_idx, CASE WHEN u.node_id IS NULL THEN NULL ELSE n.child_idx END AS child_idx,
    r.label, n.n_props, r.child_counts, coalesce(list_sum(r.child_counts), 0) = 0 AS is_leaf
  FROM ranked r JOIN nodes n ON n.tree_id = r.tree_id AND n.node_id = r.old_id
  LEFT JOIN ranked u ON u.rule_id = r.rule_id AND u.old_id = n.parent_id AND r.old_id != r.frag_root),
sizes AS (SELECT rule_id, count(*) AS size FROM patterns GROUP BY rule_id)""".replace("{{", "{").replace("}}", "}")


def forms_of(rooted: DataFrame) -> DataFrame:
    """rule_id (the form), size, cnt of the frequent fragments."""
    counted = gr.count_fragments(gr.fragments(rooted)).withColumn("rule_id", without_roots(F.col("rhs")))
    kept = idioms.frequent(counted, 3, 2).withColumnRenamed("form", "rule_id")
    return counted.where("cnt >= 3").join(kept, ["rule_id", "size"]).groupBy("rule_id", "size").agg(F.sum("cnt").alias("cnt"))


def pattern_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node rows of the frequent forms, all nodes, form of each rule_id): a number stands for the form, which is long, until the end."""
    rooted = rooted_of(spark, sf_dir)
    forms = cut(forms_of(rooted).withColumnRenamed("rule_id", "form").withColumn("rule_id", F.monotonically_increasing_id()))
    return cut(idioms.parse_forms(forms.select("rule_id", "form"))), rooted.drop("is_root"), forms


def by_form(found: DataFrame, forms: DataFrame) -> DataFrame:
    """``found`` with the form as its rule_id."""
    named = forms.select(F.col("rule_id").alias("number"), "form")
    return found.withColumnRenamed("rule_id", "number").join(named, "number").withColumnRenamed("form", "rule_id").select(found.columns)


NEXT = """
al{i} AS (
  SELECT a.rule_id, a.tree_id, a.anchor, p.node_id AS p_id, n.node_id FROM al{h} a JOIN patterns p ON p.rule_id = a.rule_id AND p.parent_id = a.p_id
    JOIN nodes n ON n.tree_id = a.tree_id AND n.parent_id = a.node_id AND n.prop_idx = p.prop_idx AND n.child_idx = p.child_idx AND n.label = p.label AND n.n_props = p.n_props AND {{fits}})"""
ALIGNED = (
    """
al0 AS (SELECT p.rule_id, n.tree_id, n.node_id AS anchor, p.node_id AS p_id, n.node_id FROM patterns p JOIN nodes n ON p.parent_id IS NULL AND p.label = n.label AND p.n_props = n.n_props AND {fits}),"""
    + NEXT.format(h=0, i=1) + "," + NEXT.format(h=1, i=2) + """,
aligned AS MATERIALIZED (SELECT * FROM al0 UNION ALL SELECT * FROM al1 UNION ALL SELECT * FROM al2),
sites AS MATERIALIZED (SELECT rule_id, tree_id, anchor FROM aligned JOIN sizes USING (rule_id) GROUP BY rule_id, tree_id, anchor, size HAVING count(*) = size),
covered AS (SELECT rule_id, tree_id, anchor, node_id FROM aligned JOIN sites USING (rule_id, tree_id, anchor))"""
)
MINED = (ROOTED, FRAGMENTS, PATTERNS)
PREFIX = ALIGNED.format(fits="coalesce(p.child_counts[1] <= n.child_counts[1], true) AND coalesce(p.child_counts[2] <= n.child_counts[2], true)")
WHOLE = ALIGNED.format(fits="(p.is_leaf OR p.child_counts = n.child_counts)")


@query(over_nodes("SELECT * FROM sites", *MINED, PREFIX))
def match_partial(spark, sf_dir):
    patterns, nodes, forms = pattern_table(spark, sf_dir)
    return by_form(ma.match_sites(patterns, nodes), forms)


@query(over_nodes("SELECT * FROM sites", *MINED, WHOLE))
def match_all_children(spark, sf_dir):
    patterns, nodes, forms = pattern_table(spark, sf_dir)
    return by_form(ma.match_sites(patterns, nodes, all_children=True), forms)


SUPER = """
s0 AS MATERIALIZED (SELECT p.rule_id, t.tree_id, t.node_id AS anchor, p.node_id AS p_id, t.node_id FROM patterns p JOIN nodes t ON p.parent_id IS NULL AND p.label = t.label AND p.n_props = t.n_props)""" + "".join(
    f""",
b{i} AS (
  SELECT s.rule_id, s.tree_id, s.anchor, q.node_id AS p_id, c.node_id, p.is_leaf AS p_leaf, coalesce(q.label = c.label AND q.n_props = c.n_props, false) AS agrees, t.is_leaf OR coalesce(p.child_counts[1] < t.child_counts[1], false) OR coalesce(p.child_counts[2] < t.child_counts[2], false) AS fewer
  FROM s{i} s JOIN patterns p ON p.rule_id = s.rule_id AND p.node_id = s.p_id JOIN nodes t ON t.tree_id = s.tree_id AND t.node_id = s.node_id
  LEFT JOIN nodes c ON NOT p.is_leaf AND c.tree_id = s.tree_id AND c.parent_id = s.node_id LEFT JOIN patterns q ON q.rule_id = s.rule_id AND q.parent_id = s.p_id AND q.prop_idx = c.prop_idx AND q.child_idx = c.child_idx),
s{i + 1} AS (SELECT rule_id, tree_id, anchor, p_id, node_id FROM b{i} WHERE agrees)"""
    for i in range(3)
)
BAD = " UNION ".join(f"SELECT rule_id, tree_id, anchor FROM b{i} WHERE NOT p_leaf AND (fewer OR NOT agrees)" for i in range(3))


@query(over_nodes(f"SELECT rule_id, tree_id, anchor FROM s0 EXCEPT ({BAD})", *MINED, SUPER))
def match_supertree(spark, sf_dir):
    patterns, nodes, forms = pattern_table(spark, sf_dir)
    return by_form(ma.supertree_sites(patterns, nodes), forms)


@query(over_nodes("SELECT tree_id, rule_id, count(*) AS sites FROM sites GROUP BY tree_id, rule_id", *MINED, PREFIX))
def match_sites(spark, sf_dir):
    patterns, nodes, forms = pattern_table(spark, sf_dir)
    return by_form(ma.patterns_in_trees(patterns, nodes), forms)


@query(over_nodes("SELECT DISTINCT tree_id, node_id FROM covered", *MINED, PREFIX))
def covered_nodes(spark, sf_dir):
    return ma.covered_once(*ma.covered_kinds(*pattern_table(spark, sf_dir)[:2]))


@query(over_nodes("SELECT tree_id, round(CAST(count(*) AS DOUBLE) / count(DISTINCT node_id), 9) AS ratio FROM covered GROUP BY tree_id", *MINED, PREFIX))
def duplication_ratio(spark, sf_dir):
    return ma.duplication(*ma.covered_kinds(*pattern_table(spark, sf_dir)[:2])).withColumn("ratio", F.round("ratio", 9))


PAIRS = "pairs AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer)"


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))


OVERLAP = """
l0 AS (SELECT a, b, x.node_id AS a_id, y.node_id AS b_id FROM pairs JOIN nodes x ON x.tree_id = a AND x.parent_id IS NULL JOIN nodes y ON y.tree_id = b AND y.parent_id IS NULL WHERE x.label = y.label AND x.n_props = y.n_props),
j1 AS (SELECT a, b, l0.a_id AS pa, x.node_id AS a_id, y.node_id AS b_id, x.prop_idx, x.child_idx, x.label = y.label AND x.n_props = y.n_props AS same FROM l0 JOIN nodes x ON x.tree_id = a AND x.parent_id = a_id JOIN nodes y ON y.tree_id = b AND y.parent_id = b_id AND y.prop_idx = x.prop_idx AND y.child_idx = x.child_idx),
l1 AS (SELECT * FROM (SELECT *, min(CASE WHEN NOT same THEN child_idx END) OVER (PARTITION BY a, b, pa, prop_idx) AS f FROM j1) WHERE {keep}),
j2 AS (SELECT l1.a, l1.b, l1.a_id AS pa, x.node_id AS a_id, y.node_id AS b_id, x.prop_idx, x.child_idx, x.label = y.label AND x.n_props = y.n_props AS same FROM l1 JOIN nodes x ON x.tree_id = a AND x.parent_id = a_id JOIN nodes y ON y.tree_id = b AND y.parent_id = b_id AND y.prop_idx = x.prop_idx AND y.child_idx = x.child_idx),
l2 AS (SELECT * FROM (SELECT *, min(CASE WHEN NOT same THEN child_idx END) OVER (PARTITION BY a, b, pa, prop_idx) AS f FROM j2) WHERE {keep})"""
SHARED = "SELECT a, b, a_id AS node_id FROM l0 UNION ALL SELECT a, b, a_id FROM l1 UNION ALL SELECT a, b, a_id FROM l2"


@query(over_nodes(SHARED, PAIRS, OVERLAP.format(keep="f IS NULL OR child_idx < f")))
def maximal_overlap(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return ma.maximal_overlap(nodes, nodes, neighbours(spark, sf_dir))


@query(over_nodes(SHARED, PAIRS, OVERLAP.format(keep="same")))
def overlapping_nodes(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return ma.overlap(nodes, nodes, neighbours(spark, sf_dir))


SIMILAR = "bags AS (SELECT tree_id, label, count(*) AS n FROM nodes GROUP BY tree_id, label), similar_pairs AS (SELECT a, b, CAST(sum(least(coalesce(x, 0), coalesce(y, 0))) AS DOUBLE) / sum(greatest(coalesce(x, 0), coalesce(y, 0))) AS similarity FROM (SELECT a, b, label, max(n) FILTER (tree_id = a) AS x, max(n) FILTER (tree_id = b) AS y FROM pairs JOIN bags ON tree_id IN (a, b) GROUP BY a, b, label) GROUP BY a, b)"


@query(over_nodes("SELECT a, b, round(similarity, 9) AS similarity FROM similar_pairs", PAIRS, SIMILAR))
def node_set_similarity(spark, sf_dir):
    return st.similarity(st.label_multiset(nodes_of(spark, sf_dir)), neighbours(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


@query(over_nodes("SELECT a, b FROM similar_pairs WHERE similarity <= 0.8", PAIRS, SIMILAR))
def similar_pairs_removed(spark, sf_dir):
    return st.similarity(st.label_multiset(nodes_of(spark, sf_dir)), neighbours(spark, sf_dir)).where("similarity <= 0.8").select("a", "b")


KEPT = "tree_sizes AS (SELECT tree_id, count(*) AS size FROM nodes GROUP BY tree_id)"


@query(over_nodes("SELECT DISTINCT replace(rhs, '*', '') AS form, size FROM tsg WHERE cnt >= 3 AND size >= 2", ROOTED, FRAGMENTS))
def pattern_filter(spark, sf_dir):
    return idioms.frequent(gr.count_fragments(gr.fragments(rooted_of(spark, sf_dir))), 3, 2)


@query(over_nodes("SELECT rule_id, count(DISTINCT tree_id) AS files FROM sites GROUP BY rule_id HAVING count(DISTINCT tree_id) >= 3", *MINED, PREFIX))
def pattern_docfreq(spark, sf_dir):
    patterns, nodes, forms = pattern_table(spark, sf_dir)
    return by_form(idioms.document_frequency(ma.patterns_in_trees(patterns, nodes), 3), forms)


FILES = """
per AS (SELECT tree_id, rule_id, count(DISTINCT node_id) AS nodes, count(DISTINCT anchor) AS sites FROM covered GROUP BY tree_id, rule_id),
files AS (
  SELECT t.tree_id, CAST(coalesce(sum(p.nodes), 0) AS DOUBLE) / any_value(t.size) AS coverage, CAST(count(p.rule_id) AS DOUBLE) / (SELECT count(*) FROM kept) AS file_recall,
    CASE WHEN count(p.rule_id) = 0 THEN 0.0 ELSE CAST(sum(p.nodes) AS DOUBLE) / count(p.rule_id) END AS mean_size, CAST(coalesce(sum(p.sites), 0) AS BIGINT) AS sites
  FROM tree_sizes t LEFT JOIN per p ON p.tree_id = t.tree_id GROUP BY t.tree_id)"""


def file_table(spark, sf_dir):
    patterns, nodes, _ = pattern_table(spark, sf_dir)
    return idioms.file_statistics(ma.coverage_of_trees(patterns, nodes), st.tree_sizes(nodes), ma.pattern_sizes(patterns))


@query(over_nodes("SELECT tree_id, round(coverage, 9) AS coverage, round(file_recall, 9) AS file_recall, round(mean_size, 9) AS mean_size, sites FROM files", *MINED, PREFIX, KEPT, FILES))
def pattern_stats(spark, sf_dir):
    return file_table(spark, sf_dir).select("tree_id", *[F.round(c, 9).alias(c) for c in ("coverage", "file_recall", "mean_size")], "sites")


@query(over_nodes("SELECT round(avg(coverage), 9) AS coverage, round(avg(file_recall), 9) AS file_recall, round(avg(mean_size), 9) AS mean_size, CAST(sum(sites) AS BIGINT) AS sites FROM files", *MINED, PREFIX, KEPT, FILES))
def pattern_corpus_stats(spark, sf_dir):
    return idioms.corpus_statistics(file_table(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("coverage", "file_recall", "mean_size")], "sites")


@query(
    over_nodes(
        """SELECT min_count, min_size, count(*) AS patterns, count(*) FILTER (s.sites > 0) AS seen, round(CAST(count(*) FILTER (s.sites > 0) AS DOUBLE) / count(*), 9) AS recall, CAST(coalesce(sum(s.sites), 0) AS BIGINT) AS sites
FROM kept k LEFT JOIN (SELECT rule_id, count(*) AS sites FROM sites GROUP BY rule_id) s USING (rule_id), (VALUES (3), (5), (10)) c(min_count), (VALUES (2), (4), (6)) z(min_size)
WHERE k.cnt >= min_count AND k.size >= min_size GROUP BY min_count, min_size""",
        *MINED, PREFIX, KEPT,
    )
)
def pattern_threshold_grid(spark, sf_dir):
    patterns, nodes, forms = pattern_table(spark, sf_dir)
    out = idioms.threshold_grid(ma.patterns_in_trees(patterns, nodes), forms.drop("form"), [3, 5, 10], [2, 4, 6])
    return out.withColumn("recall", F.round("recall", 9))


@query(
    over_nodes(
        """SELECT (SELECT count(*) FROM (SELECT DISTINCT tree_id, node_id FROM covered)) AS covered, (SELECT count(*) FROM nodes) AS nodes,
  round((SELECT count(*) FROM (SELECT DISTINCT tree_id, node_id FROM covered)) / CAST((SELECT count(*) FROM nodes) AS DOUBLE), 9) AS coverage,
  round((SELECT count(DISTINCT rule_id) FROM covered) / CAST((SELECT count(*) FROM sizes) AS DOUBLE), 9) AS precision""",
        *MINED, PREFIX,
    )
)
def pattern_coverage(spark, sf_dir):
    patterns, nodes, _ = pattern_table(spark, sf_dir)
    kinds, covered = ma.covered_kinds(patterns, nodes)
    out = idioms.coverage(ma.covered_once(kinds, covered), covered, st.tree_sizes(nodes), patterns)
    return out.withColumns({"coverage": F.round("coverage", 9), "precision": F.round("precision", 9)})


@query(
    over_nodes(
        """SELECT min_size, count(*) AS patterns, CAST(sum(hit) AS BIGINT) AS seen, round(avg(hit), 9) AS recall
FROM (SELECT k.rule_id, k.size, CASE WHEN EXISTS (SELECT 1 FROM sites s WHERE s.rule_id = k.rule_id) THEN 1 ELSE 0 END AS hit FROM sizes k), (VALUES (1), (3), (5), (8)) v(min_size)
WHERE size >= min_size GROUP BY min_size""",
        *MINED, PREFIX,
    )
)
def snippet_recall(spark, sf_dir):
    patterns, nodes, _ = pattern_table(spark, sf_dir)
    seen = ma.match_sites(patterns, nodes)
    return idioms.recall_by_size(seen, ma.pattern_sizes(patterns), [1, 3, 5, 8]).withColumn("recall", F.round("recall", 9))


@query(over_nodes("SELECT rule_id, count(*) AS files, CAST(sum(n) AS BIGINT) AS sites, min(tree_id) AS first_file, max(tree_id) AS last_file FROM (SELECT rule_id, tree_id, count(*) AS n FROM sites GROUP BY rule_id, tree_id) GROUP BY rule_id", *MINED, PREFIX))
def pattern_file_index(spark, sf_dir):
    patterns, nodes, forms = pattern_table(spark, sf_dir)
    return by_form(idioms.pattern_index(ma.patterns_in_trees(patterns, nodes)), forms)


@query()
def idiom_rank_greedy(spark, sf_dir):
    """By how much a fragment's own probability exceeds that of its rules, in bits."""
    patterns, nodes, forms = pattern_table(spark, sf_dir)
    found, priors = fragment_priors(spark, sf_dir)
    scored = pr.fragment_posteriors(found, priors, alpha=1.0)
    gain = F.greatest(F.lit(0.0), F.avg(F.log2(F.col("cnt") / F.col("total")) - F.col("prior")))
    gains = by_form(ma.pattern_sizes(patterns), forms).join(scored.groupBy(without_roots(F.col("rhs")).alias("rule_id")).agg(gain.alias("gain")), "rule_id")
    return idioms.rank_greedily(by_form(ma.covered_nodes(patterns, nodes), forms), gains)


@query()
def clone_clusters(spark, sf_dir):
    """Trees of one market segment and number of orders are a cluster; what nine tenths of overlap leave of its first tree, and how many others share that."""
    nodes = nodes_of(spark, sf_dir)
    cluster = nodes.where("parent_id IS NULL").select("tree_id", F.concat("label", F.lit("/"), F.array_join(F.col("child_counts").cast("array<string>"), ".")).alias("cluster"))
    top, members = idioms.common_tops(nodes.join(cluster, "tree_id"))
    return top.groupBy("cluster").agg(F.count("*").alias("size")).join(members, "cluster", "left").fillna(0, ["members"])


@query(
    over_nodes(
        """SELECT n.tree_id, n.node_id, concat_ws('/', t.label, n.depth - t.depth, p.label, n.prop_idx, n.child_idx, n.label, string_agg(c.prop_idx || ':' || c.label, ',' ORDER BY c.prop_idx, c.child_idx, c.label)) AS site_type
FROM rooted n JOIN upper_of u USING (tree_id, node_id) JOIN nodes t ON t.tree_id = n.tree_id AND t.node_id = u.frag_root JOIN nodes p ON p.tree_id = n.tree_id AND p.node_id = n.parent_id
JOIN nodes c ON c.tree_id = n.tree_id AND c.parent_id = n.node_id WHERE NOT n.is_leaf GROUP BY n.tree_id, n.node_id, t.label, n.depth, t.depth, p.label, n.prop_idx, n.child_idx, n.label""",
        ROOTED, FRAGMENTS,
    )
)
def same_type_sites(spark, sf_dir):
    rooted = rooted_of(spark, sf_dir)
    return ma.same_type_sites(rooted, gr.fragment_of_nodes(rooted))


# Co-occurrence: users' event types against hours of the day; documents' long words against sources.
EVENT = "ev_rows AS (SELECT DISTINCT user_id AS doc, event_type AS row FROM events), ev_cols AS (SELECT DISTINCT user_id AS doc, 'h' || hour(ts) AS col FROM events), pairs AS (SELECT row, col, count(*) AS n FROM ev_rows JOIN ev_cols USING (doc) GROUP BY row, col), nr AS (SELECT row, count(*) AS n_row FROM ev_rows GROUP BY row), nc AS (SELECT col, count(*) AS n_col FROM ev_cols GROUP BY col)"
LIFT = "lifted AS (SELECT row, col, n, n_row, n_col, ln(CAST(n AS DOUBLE) / (SELECT sum(n) FROM pairs)) - ln(CAST(n_row AS DOUBLE) / (SELECT sum(n_row) FROM nr)) - ln(CAST(n_col AS DOUBLE) / (SELECT sum(n_col) FROM nc)) AS lift FROM pairs JOIN nr USING (row) JOIN nc USING (col))"
PMI = "pmi AS (SELECT row, col, round(ln(n) - ln(CAST(sum(n) OVER (PARTITION BY {by}) AS DOUBLE)) - ln(CAST(n_row AS DOUBLE) / (SELECT sum(n_row) FROM nr)) - ln(CAST(n_col AS DOUBLE) / (SELECT sum(n_col) FROM nc)), 6) AS pmi FROM pairs JOIN nr USING (row) JOIN nc USING (col))"


def event_elements(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("doc"), F.col("event_type").alias("row")).distinct()
    return rows, events.select(F.col("user_id").alias("doc"), F.concat(F.lit("h"), F.hour("ts").cast("string")).alias("col")).distinct()


@query(f"WITH {EVENT} SELECT row, col, n FROM pairs")
def cooc_counts(spark, sf_dir):
    return co.count_pairs(*event_elements(spark, sf_dir))


def event_lifts(spark, sf_dir):
    rows, cols = event_elements(spark, sf_dir)
    return co.lifts(co.count_pairs(rows, cols), rows, cols)


@query(f"WITH {EVENT}, {LIFT} SELECT row, col, n, round(lift, 6) AS lift FROM lifted")
def cooc_lift(spark, sf_dir):
    return event_lifts(spark, sf_dir).select("row", "col", "n", F.round("lift", 6).alias("lift"))


@query(f"WITH {EVENT}, {LIFT} SELECT row, col, n, round(lift, 6) AS lift FROM lifted WHERE n > 40")
def cooc_prune(spark, sf_dir):
    return co.prune_pairs(event_lifts(spark, sf_dir), 40).select("row", "col", "n", F.round("lift", 6).alias("lift"))


@query(f"WITH {EVENT}, {PMI.format(by='row')} SELECT * FROM pmi")
def pmi_column(spark, sf_dir):
    rows, cols = event_elements(spark, sf_dir)
    return co.mutual_information(co.count_pairs(rows, cols), rows, cols, "row").withColumn("pmi", F.round("pmi", 6))


@query(f"WITH {EVENT}, {PMI.format(by='col')} SELECT * FROM pmi")
def pmi_row(spark, sf_dir):
    rows, cols = event_elements(spark, sf_dir)
    return co.mutual_information(co.count_pairs(rows, cols), rows, cols, "col").withColumn("pmi", F.round("pmi", 6))


@query(f"WITH {EVENT} SELECT col, n_col AS n, CAST(row_number() OVER (ORDER BY n_col DESC, col) AS INT) AS rank FROM nc")
def top_columns(spark, sf_dir):
    return co.popularity(event_elements(spark, sf_dir)[1], "col")


@query(f"WITH {EVENT}, {LIFT}, best AS (SELECT DISTINCT col FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY round(lift, 9) DESC, col) AS k FROM lifted) WHERE k <= 1) SELECT col FROM nc LEFT JOIN (SELECT col, 0 AS f FROM best) USING (col) ORDER BY coalesce(f, 1), n_col DESC, col LIMIT 8")
def top_patterns(spark, sf_dir):
    return co.top_and_fill(event_lifts(spark, sf_dir), co.popularity(event_elements(spark, sf_dir)[1], "col"), 1, 8)


@query(f"WITH {EVENT}, {LIFT} SELECT r.row, c.col, coalesce(round(exp(lift), 6), 0.0) AS value FROM nr r CROSS JOIN nc c LEFT JOIN lifted l ON l.row = r.row AND l.col = c.col")
def lift_matrix(spark, sf_dir):
    rows, cols = event_elements(spark, sf_dir)
    return co.lift_matrix(rows, cols, event_lifts(spark, sf_dir)).withColumn("value", F.round("value", 6))


ITEMS = "items_in AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS item FROM lineitem), single AS (SELECT item, count(*) AS c FROM items_in GROUP BY item), cooc AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items_in x JOIN items_in y ON x.doc = y.doc AND x.item < y.item GROUP BY 1, 2)"


def order_items(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("item")).distinct()


@query(f"WITH {ITEMS}, t AS (SELECT (SELECT sum(n) FROM cooc) AS np, (SELECT sum(c) FROM single) AS ni) SELECT a, b, n, round(n / CAST(np AS DOUBLE) * (ln(n / CAST(np AS DOUBLE)) - ln(x.c / CAST(ni AS DOUBLE)) - ln(y.c / CAST(ni AS DOUBLE))), 9) AS score FROM cooc JOIN single x ON x.item = a JOIN single y ON y.item = b, t WHERE n > 2")
def pair_likelihood_ratio(spark, sf_dir):
    return co.likely_pairs(order_items(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"WITH {ITEMS}, p AS (SELECT item AS a, item + 1 AS b FROM single), m AS (SELECT a, b, doc, max(CASE WHEN item = a THEN 1 ELSE 0 END) AS x, max(CASE WHEN item = b THEN 1 ELSE 0 END) AS y FROM p JOIN items_in ON item IN (a, b) GROUP BY a, b, doc) SELECT a, b, CAST(sum(2 * x * y) AS BIGINT) AS both, CAST(sum(x + y) AS BIGINT) AS either, round(CAST(sum(2 * x * y) AS DOUBLE) / sum(x + y), 9) AS accuracy FROM m GROUP BY a, b")
def cooc_accuracy(spark, sf_dir):
    items = order_items(spark, sf_dir)
    pairs = items.select(F.col("item").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return co.pair_accuracy(pairs, items).withColumn("accuracy", F.round("accuracy", 9))


SUGGEST = f"{EVENT}, {PMI.format(by='row')}, ranked AS (SELECT doc, col, score, CAST(row_number() OVER (PARTITION BY doc ORDER BY score DESC, col) AS INT) AS rank FROM (SELECT doc, col, max(pmi) AS score FROM ev_rows JOIN pmi USING (row) GROUP BY doc, col))"


def suggested(spark, sf_dir):
    rows, cols = event_elements(spark, sf_dir)
    scores = co.mutual_information(co.count_pairs(rows, cols), rows, cols, "row").withColumn("pmi", F.round("pmi", 6))
    return co.suggestions(rows, scores), cols


@query(f"WITH {SUGGEST} SELECT doc, col, score, rank FROM ranked")
def suggest_max_pmi(spark, sf_dir):
    return suggested(spark, sf_dir)[0]


@query(f"WITH {SUGGEST}, per AS (SELECT doc, max(rank) AS n, min(CASE WHEN c.col IS NOT NULL THEN rank END) AS first FROM ranked r LEFT JOIN ev_cols c USING (doc, col) GROUP BY doc) SELECT k, count(*) AS docs, count(*) FILTER (first <= k) AS found, round(CAST(count(*) FILTER (first <= k) AS DOUBLE) / count(*), 9) AS recall FROM per, (VALUES (1), (2), (3), (4), (5), (10), (15), (20)) v(k) WHERE n >= k GROUP BY k")
def recall_at_k(spark, sf_dir):
    ranked, truth = suggested(spark, sf_dir)
    return co.recall_at(ranked, truth, [1, 2, 3, 4, 5, 10, 15, 20]).withColumn("recall", F.round("recall", 9))


@query(f"WITH {SUGGEST}, cuts AS (SELECT split, max(score) AS threshold FROM (SELECT score, sum(count(*)) OVER (ORDER BY score DESC) AS upto FROM ranked GROUP BY score) r, (VALUES (0.1), (0.25), (0.5), (0.9)) v(split) WHERE upto >= floor((SELECT count(*) FROM ranked) * CAST(split AS DOUBLE)) + 1 GROUP BY split), per AS (SELECT CAST(split AS DOUBLE) AS split, threshold, doc, count(*) AS size, avg(CASE WHEN c.col IS NULL THEN 0 ELSE 1 END) AS p FROM ranked r JOIN cuts ON score >= threshold LEFT JOIN ev_cols c USING (doc, col) GROUP BY split, threshold, doc) SELECT split, threshold, count(*) AS docs, round(avg(size), 9) AS mean_size, round(avg(p), 9) AS precision FROM per GROUP BY split, threshold")
def precision_at_threshold(spark, sf_dir):
    ranked, truth = suggested(spark, sf_dir)
    out = co.precision_at(ranked, truth, [0.1, 0.25, 0.5, 0.9])
    return out.withColumns({"mean_size": F.round("mean_size", 9), "precision": F.round("precision", 9)})


@query("SELECT DISTINCT page_id, regexp_replace(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '\\.[^.]+$', '') AS package FROM pages")
def super_packages(spark, sf_dir):
    host = F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", co.super_package(host).alias("package")).distinct()


# Rewriting.
BINARY = """
spread AS (
  SELECT n.*, count(*) OVER (PARTITION BY n.tree_id, n.parent_id, n.prop_idx) AS m, lag(n.node_id) OVER (PARTITION BY n.tree_id, n.parent_id, n.prop_idx ORDER BY n.child_idx) AS before, p.label AS parent_label
  FROM nodes n LEFT JOIN nodes p ON p.tree_id = n.tree_id AND p.node_id = n.parent_id),
binary_nodes AS (
  SELECT tree_id, 'n' || node_id AS node_key, CASE WHEN parent_id IS NULL THEN NULL WHEN m <= 2 THEN 'n' || parent_id WHEN child_idx = m - 1 THEN 'm' || before ELSE 'm' || node_id END AS parent_key,
    CASE WHEN parent_id IS NULL THEN NULL WHEN m > 2 THEN 0 ELSE prop_idx END AS prop_idx, CASE WHEN parent_id IS NULL THEN NULL WHEN m <= 2 THEN child_idx WHEN child_idx = m - 1 THEN 1 ELSE 0 END AS child_idx, label, node_id AS orig_node_id
  FROM spread
  UNION ALL
  SELECT tree_id, 'm' || node_id, CASE WHEN child_idx = 0 THEN 'n' || parent_id ELSE 'm' || before END, CASE WHEN child_idx = 0 THEN prop_idx ELSE 1 END, 0, 'MULTI:' || parent_label, NULL
  FROM spread WHERE parent_id IS NOT NULL AND m > 2 AND child_idx < m - 1)"""


@query(over_nodes("SELECT * FROM binary_nodes", BINARY))
def binarize(spark, sf_dir):
    return rw.binarize(nodes_of(spark, sf_dir))


@query(over_nodes("SELECT tree_id, node_id, parent_id, prop_idx, child_idx, label FROM nodes"))
def debinarize_roundtrip(spark, sf_dir):
    return rw.debinarize(rw.binarize(nodes_of(spark, sf_dir)))


@query(
    over_nodes(
        """SELECT tree_id, parent_id, prop_idx, min(child_idx) AS first_idx, max(child_idx) AS last_idx, arg_min_null(l, child_idx) AS left_label, arg_max_null(r, child_idx) AS right_label
FROM (SELECT *, count(*) OVER (PARTITION BY tree_id, parent_id, prop_idx) AS m, lag(label) OVER w AS l, lead(label) OVER w AS r,
  row_number() OVER w - row_number() OVER (PARTITION BY tree_id, parent_id, prop_idx, is_root ORDER BY child_idx) AS run
  FROM rooted WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY tree_id, parent_id, prop_idx ORDER BY child_idx))
WHERE m > 2 AND is_root GROUP BY tree_id, parent_id, prop_idx, run""",
        ROOTED,
    )
)
def sequential_multinode(spark, sf_dir):
    return rw.sequential(rooted_of(spark, sf_dir))


@query(over_nodes("SELECT tree_id, node_id, lag(label) OVER w AS left_label, lead(label) OVER w AS right_label FROM nodes WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY tree_id, parent_id, prop_idx ORDER BY child_idx) QUALIFY count(*) OVER (PARTITION BY tree_id, parent_id, prop_idx) > 2"))
def sibling_neighbours(spark, sf_dir):
    return rw.neighbours(nodes_of(spark, sf_dir))


VARS = "firsts AS (SELECT tree_id, label, min(node_id) AS f FROM nodes GROUP BY tree_id, label), vars AS (SELECT tree_id, label, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY f) - 1 AS INT) AS var_id FROM firsts)"


@query(over_nodes("SELECT tree_id, node_id, var_id FROM nodes JOIN vars USING (tree_id, label)", VARS))
def var_reparam(spark, sf_dir):
    return rw.reparametrize(nodes_of(spark, sf_dir))


@query(over_nodes("SELECT n.tree_id, n.node_id, concat_ws('^', n.label, p.label) AS label FROM nodes n LEFT JOIN nodes p ON p.tree_id = n.tree_id AND p.node_id = n.parent_id"))
def parent_annotation(spark, sf_dir):
    return rw.annotate_parent(nodes_of(spark, sf_dir))


@query(
    over_nodes(
        """SELECT n.tree_id, n.node_id, CASE WHEN v.var_id IS NULL THEN NULL ELSE 'ITEM#' || v.var_id END AS template FROM nodes n LEFT JOIN
(SELECT tree_id, label, row_number() OVER (PARTITION BY tree_id ORDER BY min(node_id)) - 1 AS var_id FROM nodes WHERE depth = 2 GROUP BY tree_id, label) v ON v.tree_id = n.tree_id AND v.label = n.label"""
    )
)
def templetize(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return rw.templetize(nodes, nodes.where("depth = 2").select("label", F.lit("ITEM").alias("type")).distinct())


@query(over_nodes("SELECT tree_id, node_id, CASE WHEN depth = 0 THEN NULL ELSE 0 END AS parent_id FROM nodes WHERE depth != 1"))
def detempletize(spark, sf_dir):
    """Orders are spliced out; their items move up to the customer."""
    return rw.splice_out(nodes_of(spark, sf_dir), "depth = 1")


#: Returned items are variables, other finished ones literals.
TYPED = """SELECT tree_id, 'n' || node_id AS node_key, CASE WHEN l OR (v AND {delegated}) THEN 't' || node_id ELSE 'n' || parent_id END AS parent_key,
  CASE WHEN l OR (v AND {delegated}) THEN 0 ELSE prop_idx END AS prop_idx, CASE WHEN l OR (v AND {delegated}) THEN 0 ELSE child_idx END AS child_idx,
  CASE WHEN v THEN '%TEMPLATE%:RETURNED' ELSE label END AS label, CASE WHEN v THEN 0 ELSE n_props END AS n_props
FROM (SELECT *, label = 'RF' AS v, label = 'AF' AS l FROM nodes)
UNION ALL
SELECT tree_id, 't' || node_id, 'n' || parent_id, prop_idx, child_idx, CASE WHEN label = 'AF' THEN '%TEMPLATE%:%ITEM_LITERAL%' ELSE '%GenericVariable%' END, 1
FROM nodes WHERE label = 'AF' OR (label = 'RF' AND {delegated})"""


def typed(spark, sf_dir, delegated):
    nodes = nodes_of(spark, sf_dir)
    kinds = lambda label, kind: nodes.where(F.col("label") == label).select("label", F.lit(kind).alias("type")).distinct()
    return rw.variable_types(nodes, kinds("RF", "RETURNED"), kinds("AF", "%ITEM_LITERAL%"), delegated)


# Sampling, generation, sources and sinks.
@query(
    over_nodes(
        """SELECT r.tree_id, r.node_id, round(1 / (1 + pow(2, s - j)), 9) AS p FROM (SELECT tree_id, node_id, -CAST(node_id % 13 AS DOUBLE) / 2 AS j, -CAST(tree_id % 7 AS DOUBLE) / 3 AS s FROM nodes WHERE depth = 1) r"""
    )
)
def join_probability(spark, sf_dir):
    sites = nodes_of(spark, sf_dir).where("depth = 1")
    p = sa.join_probability(-(F.col("node_id") % 13).cast("double") / 2, -(F.col("tree_id") % 7).cast("double") / 3)
    return sites.select("tree_id", "node_id", F.round(p, 9).alias("p"))


#: The first order with items of every tree; what joining and splitting there gives.
SITES = """
site AS MATERIALIZED (SELECT tree_id, min(node_id) AS site FROM rooted WHERE parent_id IS NOT NULL AND NOT is_leaf GROUP BY tree_id),
changed AS MATERIALIZED (
  SELECT r.*, x.part, CASE WHEN r.node_id = s.site THEN x.part = 'u' ELSE r.is_root END AS flag FROM rooted r JOIN site s USING (tree_id), (VALUES ('j'), ('u')) x(part)),
part_nodes AS (
  SELECT c.tree_id, c.part, c.node_id, c.label, c.flag, CASE WHEN c.node_id != 0 AND c.flag THEN list_transform(c.child_counts, lambda x: 0) ELSE c.child_counts END AS counts
  FROM changed c LEFT JOIN changed p ON p.tree_id = c.tree_id AND p.part = c.part AND p.node_id = c.parent_id WHERE c.depth < 2 OR NOT p.flag
  UNION ALL SELECT r.tree_id, 'l', r.node_id, r.label, r.node_id = s.site, r.child_counts FROM rooted r JOIN site s USING (tree_id) WHERE r.node_id = s.site OR r.parent_id = s.site),
part_forms AS (
  SELECT tree_id, part, arg_min(label, node_id) AS head, count(*) AS size, string_agg((CASE WHEN flag THEN '*' ELSE '' END) || label || '(' || array_to_string(counts, '.') || ')', ' ' ORDER BY node_id) AS rhs
  FROM part_nodes GROUP BY tree_id, part),
site_priors AS (
  SELECT tree_id, sum(v) AS j, coalesce(sum(v) FILTER (node_id = site), 0) AS l FROM (
    SELECT tree_id, node_id, site, log2(CASE WHEN {P} = 0 THEN 1e-9 ELSE {P} END) AS v FROM looked JOIN rooted USING (tree_id, node_id) JOIN site USING (tree_id) WHERE node_id = 0 OR NOT is_root OR node_id = site)
  GROUP BY tree_id),
part_counts AS (
  SELECT f.tree_id, f.part, w.is_root AS was_root, coalesce(t.cnt, 0) AS cnt, coalesce(h.total, 0) AS total,
    CASE f.part WHEN 'j' THEN p.j WHEN 'l' THEN p.l ELSE p.j - p.l END + (f.size - 1) * log2(0.9) + log2(0.1) AS prior,
    CASE WHEN (f.part = 'j') != w.is_root AND coalesce(t.cnt, 0) > 0 THEN 1 ELSE 0 END AS less
  FROM part_forms f JOIN site_priors p USING (tree_id) JOIN site s USING (tree_id) JOIN rooted w ON w.tree_id = f.tree_id AND w.node_id = s.site
  LEFT JOIN (SELECT head, rhs, sum(cnt) AS cnt FROM tsg GROUP BY head, rhs) t ON t.head = f.head AND t.rhs = f.rhs LEFT JOIN (SELECT head, sum(cnt) AS total FROM tsg GROUP BY head) h ON h.head = f.head),
part_scores AS (
  SELECT tree_id, part, was_root, least(0, CASE WHEN cnt > less THEN log2(cnt - less + pow(2, prior)) ELSE prior END - log2(total - less + 1)) AS score FROM part_counts),
site_scores AS (
  SELECT tree_id, was_root, sum(score) FILTER (part = 'j') AS j, sum(score) FILTER (part != 'j') AS s FROM part_scores GROUP BY tree_id, was_root)""".replace("{P}", P)


@query(over_nodes("SELECT tree_id, site, was_root, round(CASE WHEN s - j > 1000 THEN 0 ELSE 1 / (1 + pow(2, s - j)) END, 6) AS p FROM site_scores JOIN site USING (tree_id)", ROOTED, FRAGMENTS, RULES, CFG, LOOKED, SITES))
def site_join_probability(spark, sf_dir):
    """What the sampler would draw from at the first site of every tree, by the counts of the corpus."""
    rooted = rooted_of(spark, sf_dir)
    rules = cut(gr.rules_of_nodes(rooted))
    sites = rooted.where("parent_id IS NOT NULL AND NOT is_leaf").groupBy("tree_id").agg(F.min("node_id").alias("site"))
    scored = sa.scored_sites(rooted, rules, trained(rules), sites)
    return sa.site_probabilities(scored, 1.0, 10.0).withColumn("p", F.round("p", 6))


#: What the training steps need of the trees: orders with what they look like as a frontier and as inner nodes, and tops.
ALL_RULES = "cfg AS (SELECT head, rhs, count(*) AS cnt FROM rules GROUP BY head, rhs), heads AS (SELECT head, sum(cnt) AS total FROM cfg GROUP BY head)"
ORDERS = f"""
rule_logs AS (SELECT tree_id, node_id, log2(CASE WHEN {P} = 0 THEN 1e-9 ELSE {P} END) AS lp FROM looked),
orders_in AS MATERIALIZED (
  SELECT n.tree_id, n.node_id, n.label, n.is_leaf, '*' || n.label || '(0.0)' AS star, n.last_desc - n.node_id + 1 AS size, any_value(CASE WHEN n.is_leaf THEN 0 ELSE lp END) AS lp,
    n.label || '(' || array_to_string(n.child_counts, '.') || ')' || coalesce(' ' || string_agg(c.label || '()', ' ' ORDER BY c.node_id), '') AS open
  FROM nodes n LEFT JOIN nodes c ON c.tree_id = n.tree_id AND c.parent_id = n.node_id LEFT JOIN rule_logs l ON l.tree_id = n.tree_id AND l.node_id = n.node_id
  WHERE n.depth = 1 GROUP BY n.tree_id, n.node_id, n.label, n.is_leaf, n.last_desc, n.child_counts),
tops_in AS MATERIALIZED (SELECT tree_id, label, '*' || label || '(' || array_to_string(child_counts, '.') || ')' AS token, lp FROM nodes JOIN rule_logs USING (tree_id, node_id) WHERE depth = 0)"""


def drawn_sql(seed: int, *key: str) -> str:
    text = " || '/' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def item_sql(label: str) -> str:
    """An item as the number 0 of its type."""
    return f"CASE WHEN length({label}) = 2 THEN 'ITEM#0' ELSE {label} END"


def numbered_sql(rhs: str) -> str:
    """A fragment's text with items numbered: how many different ones come before the first of it."""
    tokens = f"string_split({rhs}, ' ')"
    items = f"list_filter({tokens}, lambda y: length(y) = 4 AND y LIKE '%()')"
    number = f"len(list_distinct(list_slice({items}, 1, list_position({items}, x) - 1)))"
    return f"array_to_string(list_transform({tokens}, lambda x: CASE WHEN length(x) = 4 AND x LIKE '%()' THEN 'ITEM#' || {number} || '()' ELSE x END), ' ')"


def step_sql(k: int, block: bool, mean: float, templetized: bool = False) -> str:
    """The k-th training step: from the flags f{k} to f{k + 1}; all sites of a customer touch the top's fragment, so one a tree is drawn."""
    named = numbered_sql if templetized else lambda rhs: rhs
    prior = lambda x: f"{x}_prior + ({x}_size - 1) * log2({1 - 1 / mean}) + log2({1 / mean})"
    parts = "".join(f", coalesce({x}.cnt, 0) AS {x}_cnt, coalesce({x}h.total, 0) AS {x}_total, {prior(x)} AS p{x}" for x in "jul")
    joins = "".join(f" LEFT JOIN c{k} {x} ON {x}.head = {x}_head AND {x}.rhs = {x}_rhs LEFT JOIN h{k} {x}h ON {x}h.head = {x}_head" for x in "jul")
    weight = lambda c, p: f"CASE WHEN {c} > 0 THEN log2({c} + pow(2, {p})) ELSE {p} END"
    score = lambda x, less: f"least(0, {weight(f'({x}_cnt - {less})', f'p{x}')} - log2({x}_total - {less} + 1))"
    less = lambda x: f"(CASE WHEN {'was' if x != 'j' else 'NOT was'} AND {x}_cnt > 0 THEN 1 ELSE 0 END)"
    listed = lambda upto, body: f"coalesce(list_sum(list_transform(range({upto}), lambda i: {body})), 0)"
    head = f"""
st{k} AS MATERIALIZED (SELECT o.*, coalesce(f.flag, false) AS flag FROM orders_in o LEFT JOIN f{k} f USING (tree_id, node_id)),
tree_forms{k} AS (SELECT t.tree_id, t.label AS head, t.token || coalesce(' ' || string_agg(CASE WHEN flag THEN star ELSE open END, ' ' ORDER BY node_id), '') AS rhs, 1 + coalesce(sum(CASE WHEN flag THEN 1 ELSE s.size END), 0) AS size
  FROM tops_in t LEFT JOIN st{k} s USING (tree_id) GROUP BY t.tree_id, t.label, t.token),
c{k} AS MATERIALIZED (SELECT head, {named("rhs")} AS rhs, size, count(*) AS cnt FROM (SELECT head, rhs, size FROM tree_forms{k} UNION ALL SELECT label, '*' || open, size FROM st{k} WHERE flag) GROUP BY ALL),
h{k} AS (SELECT head, sum(cnt) AS total FROM c{k} GROUP BY head)"""
    sites = f""",
sites{k} AS MATERIALIZED (
  SELECT s.tree_id, s.node_id AS site, s.flag AS was, t.label AS j_head, t.label AS u_head, s.label AS l_head, '*' || s.open AS l_rhs, s.size AS l_size, s.lp AS l_prior,
    t.token || ' ' || string_agg(CASE WHEN o.flag AND o.node_id != s.node_id THEN o.star ELSE o.open END, ' ' ORDER BY o.node_id) AS j_rhs, t.token || ' ' || string_agg(CASE WHEN o.flag OR o.node_id = s.node_id THEN o.star ELSE o.open END, ' ' ORDER BY o.node_id) AS u_rhs,
    1 + sum(CASE WHEN o.flag AND o.node_id != s.node_id THEN 1 ELSE o.size END) AS j_size, 1 + sum(CASE WHEN o.flag OR o.node_id = s.node_id THEN 1 ELSE o.size END) AS u_size,
    t.lp + sum(CASE WHEN o.flag AND o.node_id != s.node_id THEN 0 ELSE o.lp END) AS j_prior, t.lp + sum(CASE WHEN o.flag OR o.node_id = s.node_id THEN 0 ELSE o.lp END) AS u_prior
  FROM st{k} s JOIN tops_in t USING (tree_id) JOIN st{k} o ON o.tree_id = s.tree_id WHERE NOT s.is_leaf
  GROUP BY s.tree_id, s.node_id, s.flag, t.label, s.label, s.open, s.size, s.lp, t.token, t.lp)"""
    if templetized:
        sites = sites.replace("MATERIALIZED (", f"MATERIALIZED (SELECT * REPLACE ({', '.join(f'{named(x)} AS {x}' for x in ('j_rhs', 'u_rhs', 'l_rhs'))}) FROM (", 1) + ")"
    if not block:
        pick = f""",
picked{k} AS (SELECT * FROM sites{k} QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY {drawn_sql(1, str(k), "tree_id", "site")}, site) = 1),
scored{k} AS (SELECT p.tree_id, site, was{parts} FROM picked{k} p{joins}),
summed{k} AS (SELECT tree_id, site, {score("j", less("j"))} AS j, {score("u", less("u"))} + {score("l", less("l"))} AS s FROM scored{k}),
new{k} AS MATERIALIZED (SELECT tree_id, site, {drawn_sql(2, str(k), "tree_id", "site")} > CASE WHEN s - j > 1000 THEN 0 ELSE 1 / (1 + pow(2, s - j)) END AS flag FROM summed{k})"""
    else:
        pick = f""",
firsts{k} AS (SELECT j_rhs, u_rhs, l_rhs, min({{'t': tree_id, 's': site}}) AS f FROM sites{k} GROUP BY ALL),
picked{k} AS MATERIALIZED (SELECT s.* FROM sites{k} s JOIN firsts{k} USING (j_rhs, u_rhs, l_rhs) QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY {drawn_sql(3, str(k), "f.t", "f.s")}, {drawn_sql(1, str(k), "tree_id", "site")}, site) = 1),
types{k} AS (SELECT j_rhs, u_rhs, l_rhs, count(*) AS n, count(*) FILTER (was) AS n_split, min({{'t': tree_id, 's': site}}) AS f, any_value(j_head) AS j_head, any_value(u_head) AS u_head, any_value(l_head) AS l_head,
  max(j_size) AS j_size, max(u_size) AS u_size, max(l_size) AS l_size, max(j_prior) AS j_prior, max(u_prior) AS u_prior, max(l_prior) AS l_prior FROM picked{k} GROUP BY j_rhs, u_rhs, l_rhs),
scored{k} AS (SELECT t.j_rhs, t.u_rhs, t.l_rhs, n, n_split, f{parts} FROM types{k} t{joins}),
m_scores{k} AS MATERIALIZED (SELECT *, lgamma(n + 1) / ln(2) - lgamma(m + 1) / ln(2) - lgamma(n - m + 1) / ln(2)
    + {listed("m", weight("(u_cnt - n_split + i)", "pu") + " + " + weight("(l_cnt - n_split + i)", "pl") + " - log2(u_total - n + i + 1) - log2(l_total - n_split + i + 1)")}
    + {listed("n - m", weight("(j_cnt - (n - n_split) + i)", "pj") + " - log2(u_total - n + i + m + 1)")} AS score
  FROM scored{k}, unnest(range(n + 1)) x(m)),
drawn{k} AS (SELECT j_rhs, u_rhs, l_rhs, arg_max(m, score * ln(2) - ln(-ln({drawn_sql(4, str(k), "f.t", "f.s", "m")} + pow(2, -53)))) AS m FROM m_scores{k} GROUP BY j_rhs, u_rhs, l_rhs),
new{k} AS MATERIALIZED (SELECT tree_id, site, row_number() OVER (PARTITION BY j_rhs, u_rhs, l_rhs ORDER BY {drawn_sql(2, str(k), "tree_id", "site")}, tree_id, site) <= m AS flag FROM picked{k} JOIN drawn{k} USING (j_rhs, u_rhs, l_rhs))"""
    return head + sites + pick + f""",
f{k + 1} AS MATERIALIZED (SELECT tree_id, f.node_id, coalesce(n.flag, f.flag) AS flag FROM f{k} f LEFT JOIN (SELECT tree_id, site AS node_id, flag FROM new{k}) n USING (tree_id, node_id))"""


FLAGS = f"f0 AS MATERIALIZED (SELECT tree_id, node_id, {drawn_sql(1, 'tree_id', 'node_id')} < 0.9 AS flag FROM nodes WHERE depth = 1 AND NOT is_leaf)"


def training_sql(steps: int, block: bool, templetized: bool = False) -> str:
    last = step_sql(steps, block, 10.0, templetized).split(f",\nsites{steps} AS")[0]
    rules = RULES.replace("c.label", item_sql("c.label")) if templetized else RULES
    return over_nodes(f"SELECT head, rhs, CAST(size AS BIGINT) AS size, cnt FROM c{steps}", rules, ALL_RULES, LOOKED, ORDERS, FLAGS, *[step_sql(k, block, 10.0, templetized) for k in range(steps)], last)


@query(over_nodes("SELECT f.t AS tree_id, f.s AS site, n, n_split, m, round(score, 6) AS score FROM m_scores0", RULES, ALL_RULES, LOOKED, ORDERS, FLAGS, step_sql(0, True, 10.0)))
def samplem_scores(spark, sf_dir):
    """For every type of site that the first block step draws, named by its first site: the score of each number of them being split."""
    nodes = cut(nodes_of(spark, sf_dir))
    levels = keys.levels_of(nodes)
    rooted = st.with_roots(nodes, uniform(F.col("tree_id"), F.col("node_id"), seed=1) < 0.9)
    state = keys.skeleton(nodes, node_priors(nodes)).join(rooted.select("tree_id", "node_id", "is_root"), ["tree_id", "node_id"])
    keyed = cut(keys.keyed(state, levels))
    chosen = se.chosen_sites(cut(keys.sites(keyed, levels)), 1, 0, True)
    counted = se.with_counts(se.types_of(chosen), keys.fragment_counts(keyed))
    return se.scores(counted, 1.0, 10.0).select("first.tree_id", "first.site", "n", "n_split", "m", F.round("score", 6).alias("score"))


@query(training_sql(5, False))
def gibbs_train(spark, sf_dir):
    """Five iterations of maximal sets of sites; the grammar summed after the burn-in."""
    return train(cut(nodes_of(spark, sf_dir)), 5, alpha=1.0, mean_size=10.0)[0]


@query(training_sql(5, False, True))
def templetized_train(spark, sf_dir):
    """Five iterations in which items are variables, renumbered within each of a site's three fragments."""
    nodes = cut(nodes_of(spark, sf_dir))
    kinds = nodes.where("length(label) = 2").select("label", F.lit("ITEM").alias("type")).distinct()
    return train(nodes, 5, alpha=1.0, mean_size=10.0, kinds=kinds)[0]


@query(
    over_nodes(
        """SELECT head, rhs, count(*) AS cnt FROM (
  SELECT tree_id, frag_root, arg_min(named, node_id) AS head, string_agg((CASE WHEN is_root THEN '*' ELSE '' END) || named || '(' || array_to_string(child_counts, '.') || ')', ' ' ORDER BY node_id) AS rhs
  FROM (SELECT f.*, CASE WHEN length(label) != 2 THEN label ELSE 'ITEM#' || (dense_rank() OVER (PARTITION BY tree_id, frag_root, length(label) = 2 ORDER BY first_id) - 1) END AS named
    FROM (SELECT *, min(node_id) OVER (PARTITION BY tree_id, frag_root, label) AS first_id FROM frag_nodes) f)
  GROUP BY tree_id, frag_root) GROUP BY head, rhs""",
        ROOTED, FRAGMENTS,
    )
)
def tsg_templetized(spark, sf_dir):
    """Items are variables."""
    rooted = rooted_of(spark, sf_dir)
    kinds = rooted.where("length(label) = 2").select("label", F.lit("ITEM").alias("type")).distinct()
    return gr.count_rules(gr.templetized_fragments(rooted, kinds))


APART = """
left_symbols AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM nodes WHERE tree_id % 2 = 0)),
alphabet AS (
  SELECT * FROM left_symbols UNION ALL
  SELECT label, (SELECT coalesce(max(id), -1) FROM left_symbols) + row_number() OVER (ORDER BY label) FROM (SELECT DISTINCT label FROM nodes WHERE tree_id % 2 = 1 AND label NOT IN (SELECT label FROM left_symbols)))"""


@query(
    over_nodes(
        """SELECT head, rhs, count(*) AS cnt FROM (
  SELECT tree_id, frag_root, CAST(arg_min(id, node_id) AS VARCHAR) AS head, string_agg((CASE WHEN is_root THEN '*' ELSE '' END) || id || '(' || array_to_string(child_counts, '.') || ')', ' ' ORDER BY node_id) AS rhs
  FROM frag_nodes JOIN alphabet USING (label) GROUP BY tree_id, frag_root) GROUP BY head, rhs""",
        ROOTED, FRAGMENTS, APART,
    )
)
def tsg_merge_alphabets(spark, sf_dir):
    """Grammars of even and of odd trees, each with numbers of its own."""
    rooted, halves = rooted_of(spark, sf_dir), []
    for rest in (0, 1):
        half = rooted.where(F.col("tree_id") % 2 == rest)
        alphabet = cut(st.symbols(half))
        coded = st.remap(half, alphabet).withColumn("label", F.col("symbol_id").cast("string")).drop("symbol_id")
        halves += [gr.count_rules(gr.fragments(coded)), alphabet]
    return gr.merge_alphabets(*halves)[0]


@query(over_nodes("SELECT DISTINCT form, size FROM (SELECT tree_id % 2 AS half, replace(rhs, '*', '') AS form, size, rhs, count(*) AS cnt FROM frags GROUP BY 1, 2, 3, 4) WHERE cnt >= 3 AND size >= 2", ROOTED, FRAGMENTS))
def pattern_merge(spark, sf_dir):
    """Patterns of even and of odd trees."""
    found = gr.fragments(rooted_of(spark, sf_dir))
    return idioms.merge_patterns(*[idioms.frequent(gr.count_fragments(found.where(F.col("tree_id") % 2 == rest)), 3, 2) for rest in (0, 1)])


@query(over_nodes("SELECT tree_id, count(*) FILTER (is_leaf) AS tokens FROM nodes GROUP BY tree_id HAVING count(*) FILTER (is_leaf) - 2 > 20"))
def snippet_length(spark, sf_dir):
    return idioms.long_snippets(nodes_of(spark, sf_dir))


@query(training_sql(5, True))
def block_train(spark, sf_dir):
    """Five iterations that draw the sites of a type together; the grammar summed after the burn-in."""
    return train(cut(nodes_of(spark, sf_dir)), 5, alpha=1.0, mean_size=10.0, block=True)[0]


#: Labels that hold the separators of the text forms: items `A,` and `A`, orders with brackets and stars, so that joined texts of different trees agree.
HOSTILE = """
hostile AS MATERIALIZED (SELECT tree_id, node_id, parent_id, prop_idx, child_idx, depth, n_props, child_counts, is_leaf,
  CASE depth WHEN 0 THEN label WHEN 1 THEN '*' || replace(label, '-', ') (') ELSE CASE label WHEN 'RF' THEN 'a,b' WHEN 'AF' THEN 'a' ELSE 'b' END END AS label FROM nodes),
lists AS MATERIALIZED (
  SELECT p.tree_id, p.node_id, p.depth, p.label, p.n_props, p.last_desc - p.node_id + 1 AS size, coalesce(list([CAST(c.prop_idx AS VARCHAR), c.label] ORDER BY c.prop_idx, c.child_idx) FILTER (c.node_id IS NOT NULL), []) AS below
  FROM (SELECT h.*, n.last_desc FROM hostile h JOIN nodes n USING (tree_id, node_id)) p LEFT JOIN hostile c ON c.tree_id = p.tree_id AND c.parent_id = p.node_id GROUP BY p.tree_id, p.node_id, p.depth, p.label, p.n_props, p.last_desc),
wholes AS (
  SELECT tree_id, node_id, label, n_props, size, [below] AS whole FROM lists WHERE depth > 0
  UNION ALL
  SELECT t.tree_id, t.node_id, t.label, t.n_props, t.size, coalesce(list([[o.label, CAST(o.n_props AS VARCHAR)]] || o.below ORDER BY o.node_id) FILTER (o.node_id IS NOT NULL), []) FROM lists t LEFT JOIN lists o ON o.tree_id = t.tree_id AND o.depth = 1 WHERE t.depth = 0 GROUP BY t.tree_id, t.node_id, t.label, t.n_props, t.size)"""


def hostile_of(spark, sf_dir):
    item = F.when(F.col("label") == "RF", "a,b").when(F.col("label") == "AF", "a").otherwise("b")
    label = F.when(F.col("depth") == 0, F.col("label")).when(F.col("depth") == 1, F.concat(F.lit("*"), F.replace("label", F.lit("-"), F.lit(") (")))).otherwise(item)
    return nodes_of(spark, sf_dir).withColumn("label", label)


@query(over_nodes("SELECT label, size, n, f.t AS tree_id, f.i AS node_id FROM (SELECT label, n_props, size, whole, count(*) AS n, min({'t': tree_id, 'i': node_id}) AS f FROM wholes GROUP BY label, n_props, size, whole)", HOSTILE))
def subtree_classes(spark, sf_dir):
    """Distinct subtrees of trees whose labels hold commas, brackets and stars."""
    return keys.subtree_classes(cut(hostile_of(spark, sf_dir)))


@query(over_nodes("SELECT tree_id, min(tree_id) OVER (PARTITION BY label, n_props, size, whole) AS class_id FROM wholes WHERE node_id = 0", HOSTILE))
def equal_trees(spark, sf_dir):
    return keys.equal_trees(cut(hostile_of(spark, sf_dir)))


@query(over_nodes("SELECT head, CAST(count(*) AS BIGINT) AS rules, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT label AS head, n_props, below, count(*) AS cnt FROM lists WHERE depth = 0 OR len(below) > 0 GROUP BY label, n_props, below) GROUP BY head", HOSTILE))
def hostile_rules(spark, sf_dir):
    """How many different rules each head has, where joined labels would agree."""
    rules = gr.count_rules(gr.rules_of_nodes(cut(hostile_of(spark, sf_dir))))
    return rules.groupBy("head").agg(F.count("*").alias("rules"), F.sum("cnt").alias("cnt"))


@query()
def hyperparameter_grid(spark, sf_dir):
    found, priors = fragment_priors(spark, sf_dir)
    scored = pr.fragment_posteriors(found, priors, alpha=1.0)
    distinct = scored.groupBy("head", "rhs").agg(F.first("cnt").alias("cnt"), F.first("total").alias("total"), F.avg("prior").alias("prior"), F.first("size").alias("size"))
    return sa.hyperparameters(distinct, [0.5, 1.0, 10.0, 100.0], [2.0, 5.0, 20.0])


@query()
def hyperparameter_fit(spark, sf_dir):
    """Where the corpus of all fragments is most likely, by following the gradient."""
    found, priors = fragment_priors(spark, sf_dir)
    scored = pr.fragment_posteriors(found, priors, alpha=1.0)
    distinct = cut(scored.groupBy("head", "rhs").agg(F.first("cnt").alias("cnt"), F.first("total").alias("total"), F.avg("prior").alias("prior"), F.first("size").alias("size")))
    got = hyper.fitted(distinct)
    return spark.createDataFrame([(got["alpha"], got["mean_size"], got["log2p"], got["steps"])], "alpha double, mean_size double, log2p double, steps int")


@query()
def generate_cfg(spark, sf_dir):
    """A random tree for every customer, from the rules of all trees."""
    nodes = nodes_of(spark, sf_dir)
    heads = nodes.where("parent_id IS NULL").select(F.col("tree_id").alias("sample"), F.col("label").alias("head"))
    return sa.generate(heads, gr.count_rules(gr.rules_of_nodes(nodes)), 7, 3)


@query()
def generate_tsg(spark, sf_dir):
    rooted = rooted_of(spark, sf_dir)
    heads = rooted.where("parent_id IS NULL").select(F.col("tree_id").alias("sample"), F.col("label").alias("head"))
    return sa.generate_fragments(heads, gr.count_rules(gr.fragments(rooted)), 7, 3)


@query()
def inside_logprob(spark, sf_dir):
    """Trees of customers under the grammar of all their fragments."""
    rooted = rooted_of(spark, sf_dir)
    grammar = gr.count_rules(gr.fragments(rooted))
    rules = cut(gr.ml_probabilities(grammar).withColumn("rule_id", F.xxhash64("head", "rhs")))
    forms = idioms.parse_forms(rules.select("rule_id", without_roots(F.col("rhs")).alias("form")))
    return pr.inside_log2(rooted, forms, rules.select("rule_id", F.log2("p").alias("log2p")))


@query()
def inside_supertree(spark, sf_dir):
    """As ``inside_logprob``, with fragments that may reach further than the tree."""
    rooted = rooted_of(spark, sf_dir)
    rules = cut(gr.ml_probabilities(gr.count_rules(gr.fragments(rooted))).withColumn("rule_id", F.xxhash64("head", "rhs")))
    forms = idioms.parse_forms(rules.select("rule_id", without_roots(F.col("rhs")).alias("form")))
    return pr.inside_log2(rooted, forms, rules.select("rule_id", F.log2("p").alias("log2p")), all_children=False)


@query()
def tsg_entropy(spark, sf_dir):
    """Trees under the grammar of all fragments as a language model: log-probability, and that per leaf."""
    tokens = st.leaf_counts(nodes_of(spark, sf_dir)).select("tree_id", F.col("leaves").alias("tokens"))
    return pr.entropy_report(inside_logprob(spark, sf_dir), tokens)


@query()
def html_trees(spark, sf_dir):
    return tx.html_trees(read(spark, sf_dir, "pages"))


@query(
    over_nodes(
        """SELECT tree_id, string_agg('{"name":' || to_json(label)::VARCHAR || ',"children":[' || repeat(']}', depth - coalesce(following, 0) + 1) || CASE WHEN following <= depth THEN ',' ELSE '' END, '' ORDER BY node_id) AS json
FROM (SELECT *, lead(depth) OVER (PARTITION BY tree_id ORDER BY node_id) AS following FROM nodes) GROUP BY tree_id"""
    )
)
def json_export(spark, sf_dir):
    return tx.nested_json(nodes_of(spark, sf_dir))


@query(
    over_nodes(
        """SELECT line, count(*) AS n FROM (SELECT 'Type : ' || CASE n.depth WHEN 0 THEN 'customer' WHEN 1 THEN 'order' ELSE 'item' END || ' Simple Props: [value:' || n.label || ', ] Child Props: ['
  || CASE n.n_props WHEN 0 THEN '' WHEN 1 THEN 'p0, ' ELSE 'p0, p1, ' END || '] Annotations: [' || CASE WHEN p.label IS NULL THEN '' ELSE 'parent:' || p.label || ', ' END || ']' AS line
FROM nodes n LEFT JOIN nodes p ON p.tree_id = n.tree_id AND p.node_id = n.parent_id) GROUP BY line"""
    )
)
def symbol_printer(spark, sf_dir):
    """Symbols annotated with their parent's label, and how many nodes have them."""
    nodes = nodes_of(spark, sf_dir)
    up = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("label").alias("up"))
    counted = nodes.join(up, ["tree_id", "parent_id"], "left").groupBy("depth", "label", "n_props", "up").agg(F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    return tx.symbol_lines(
        counted.select(
            "n", F.element_at(F.array(F.lit("customer"), F.lit("order"), F.lit("item")), F.col("depth") + 1).alias("kind"), F.create_map(F.lit("value"), "label").alias("simple"),
            F.when(F.col("n_props") > 0, F.transform(F.sequence(F.lit(0), F.col("n_props") - 1), lambda k: F.concat(F.lit("p"), k.cast("string")))).otherwise(none).alias("child_props"),
            F.when(F.col("up").isNotNull(), F.create_map(F.lit("parent"), "up")).otherwise(F.create_map().cast("map<string,string>")).alias("annotations"),
        )
    ).groupBy("line").agg(F.sum("n").alias("n"))


@query(over_nodes("SELECT tree_id, 'n' || parent_id AS parent_key, prop_idx, string_agg(label, ' ' ORDER BY child_idx) AS text FROM nodes WHERE parent_id IS NOT NULL GROUP BY tree_id, parent_id, prop_idx HAVING count(*) > 2"))
def multinode_printer(spark, sf_dir):
    return rw.printed_chains(rw.binarize(nodes_of(spark, sf_dir)))


@query(over_nodes(TYPED.format(delegated="false")))
def variable_types(spark, sf_dir):
    return typed(spark, sf_dir, False)


@query(over_nodes(TYPED.format(delegated="true")))
def delegated_types(spark, sf_dir):
    return typed(spark, sf_dir, True)


@query(over_nodes("SELECT label, CAST(symbol_id AS INT) AS unit_key FROM (SELECT label, row_number() OVER (ORDER BY label) - 1 AS symbol_id FROM (SELECT DISTINCT label FROM nodes)) WHERE label IN (SELECT label FROM nodes WHERE parent_id IS NULL) AND label >= 'C' ORDER BY symbol_id LIMIT 1"))
def unit_key(spark, sf_dir):
    """The first symbol that is a unit."""
    nodes = nodes_of(spark, sf_dir)
    return st.unit_keys(st.symbols(nodes), nodes, F.col("label") >= "C")


@query(over_nodes("SELECT tree_id, string_agg(repeat('-', depth) || CASE WHEN parent_id IS NULL THEN '' ELSE '(' || prop_idx || ')' END || label, chr(10) ORDER BY node_id) AS text FROM nodes GROUP BY tree_id"))
def tree_printer(spark, sf_dir):
    return tx.pretty(nodes_of(spark, sf_dir))


@query(over_nodes("SELECT head, rhs, CAST(sum(cnt) OVER (PARTITION BY head) AS BIGINT) AS total, cnt, printf('>Prob %.5f (%d)', CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY head), cnt) AS line FROM tsg", ROOTED, FRAGMENTS))
def grammar_printer(spark, sf_dir):
    return tx.report(gr.count_rules(gr.fragments(rooted_of(spark, sf_dir))))


@query("SELECT l_returnflag || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY 1")
def stream_label_counts(spark, sf_dir):
    return counts.run_to_end(counts.label_counts(counts.item_stream(spark, sf_dir)))
