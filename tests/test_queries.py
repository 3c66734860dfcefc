"""Every query that has SQL gives what DuckDB gives, at the smallest size."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A selection that touches every module and stays quick.
NAMES = ["tree_nodes", "node_paths", "cfg_ml_prob", "cfg_entropy", "tsg_counts", "tsg_prune", "tsg_templetized", "tsg_merge_alphabets", "pattern_merge", "snippet_length", "corpus_filter", "posterior_rule", "match_partial", "match_supertree", "maximal_overlap", "pattern_stats", "pattern_threshold_grid", "cooc_lift", "pmi_column", "pair_likelihood_ratio", "recall_at_k", "precision_at_threshold", "binarize", "sequential_multinode", "samplem_scores", "subtree_classes", "equal_trees", "hostile_rules", "detempletize", "tree_printer", "json_export", "symbol_printer", "multinode_printer", "variable_types", "delegated_types", "unit_key", "site_join_probability", "top_columns", "symbol_dictionary", "stream_label_counts"]


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    from grovespark.plans import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in result.fetchall()), key=repr)
    frame = catalog.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in frame.collect()), key=repr)
    assert got == want


def test_entry_survives_without_training_operators():
    import importlib
    import sys
    from unittest import mock

    import __spark_entry__ as entry

    gone = {"grovespark.llm": None, "grovespark.llm.queries": None, "corpus_pipeline": None}
    with mock.patch.dict(sys.modules, gone):
        module = importlib.reload(entry)
        assert "cfg_ml_prob" in module.queries() and not any(k.startswith("op") for k in module.queries())
    importlib.reload(entry)
