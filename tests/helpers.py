"""Trees written as nested tuples: (label, [children of property 0], [children of property 1], ...)."""

from grovespark.sources.text import NODES


def node_rows(tree_id, tree):
    rows = []

    def add(node, parent, prop, idx, depth):
        label, *props = node if isinstance(node, tuple) else (node,)
        i = len(rows)
        rows.append(None)
        for p, children in enumerate(props):
            for k, child in enumerate(children):
                add(child, i, p, k, depth + 1)
        counts = [len(c) for c in props]
        rows[i] = (tree_id, i, parent, prop, idx, depth, len(rows) - 1, label, len(props), counts, not any(counts))

    add(tree, None, None, None, 0)
    return rows


def nodes_frame(spark, *trees):
    rows = [r for k, t in enumerate(trees) for r in node_rows(k + 1, t)]
    return spark.createDataFrame(rows, NODES)


def rules_frame(spark, *trees):
    return nodes_frame(spark, *trees).withColumnRenamed("tree_id", "rule_id")
