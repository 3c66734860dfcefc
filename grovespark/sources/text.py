"""Text in and out: whole files, markup to trees, clone reports, pretty printing, nested JSON."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NODES = "tree_id long, node_id int, parent_id int, prop_idx int, child_idx int, depth int, last_desc int, label string, n_props int, child_counts array<int>, is_leaf boolean"
TREE_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
LINE = r"^\d+\s+dist:([0-9.]+)\s+FILE\s+(\S+)\s+LINE:(\d+):(\d+)"


def read_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, text: one row a file below ``path``, whose name ends with ``suffix``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [["#document", None]], [0]

    def handle_starttag(self, tag, attrs):
        self.rows.append([tag, self.open[-1]])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.rows.append([tag, self.open[-1]])

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.rows[self.open[k]][0] == tag:
                del self.open[k:]
                break


def number(rows: list[tuple[str, int | None]]) -> list[tuple]:
    """Node rows from (label, parent) in pre-order, all children in property 0."""
    depth, last, kids = [0] * len(rows), list(range(len(rows))), [0] * len(rows)
    place = [None] * len(rows)
    for i, (_, parent) in enumerate(rows):
        if parent is not None:
            depth[i], place[i] = depth[parent] + 1, kids[parent]
            kids[parent] += 1
    for i in range(len(rows) - 1, 0, -1):
        last[rows[i][1]] = max(last[rows[i][1]], last[i])
    return [(i, p, None if p is None else 0, place[i], depth[i], last[i], label, 1, [kids[i]], kids[i] == 0) for i, (label, p) in enumerate(rows)]


def parsed(html: str | None) -> tuple[list, str | None]:
    """(label, parent) of the elements in pre-order, and why the parser refused the page, if it did."""
    parser = _Tree()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError) as problem:
        return _Tree().rows, str(problem) or type(problem).__name__
    return parser.rows, None


def html_trees(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """Node rows of each page's elements, and ``error``.

    Raw-text elements hold no elements, unclosed ones end with their parent.  A null
    page has the document node alone.  A page that the parser refuses has so too, with
    the reason in ``error``, which is null elsewhere: it is reported, and stops nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key_value, html in zip(batch[key], batch[text], strict=True):
                found, error = parsed(html)
                rows.extend((key_value, *r, error) for r in number(found))
            yield pd.DataFrame(rows, columns=[*TREE_COLUMNS, "error"]).astype({"parent_id": "Int32", "prop_idx": "Int32", "child_idx": "Int32"})

    return pages.select(key, text).mapInPandas(run, NODES + ", error string")


def clone_clusters(lines: DataFrame) -> DataFrame:
    """cluster, file, first_line, n_lines, distance from (file, line_no, line) of clone reports; blank lines separate clusters."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("cluster", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(w)).where(F.col("line").rlike(LINE))
    part = lambda k: F.regexp_extract("line", LINE, k)
    return rows.select("cluster", part(2).alias("file"), part(3).cast("int").alias("first_line"), part(4).cast("int").alias("n_lines"), part(1).cast("double").alias("distance"))


def pretty(nodes: DataFrame) -> DataFrame:
    """tree_id, text: a line a node, indented by ``-(property)`` for each level."""
    line = F.concat(F.repeat(F.lit("-"), F.col("depth")), F.when(F.col("parent_id").isNull(), "").otherwise(F.concat(F.lit("("), F.col("prop_idx").cast("string"), F.lit(")"))), "label")
    rows = F.sort_array(F.collect_list(F.struct("node_id", line.alias("line"))))
    return nodes.groupBy("tree_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def nested_json(nodes: DataFrame) -> DataFrame:
    """tree_id, json: ``{"name": ..., "children": [...]}`` of each tree.

    In pre-order a node's text is known from its own depth and the next one's: it is
    opened, closed with as many nodes above it as end there, and a comma goes before a
    sibling.  So a tree is one window and one aggregate, however deep.
    """
    following = F.lead("depth").over(Window.partitionBy("tree_id").orderBy("node_id"))
    name = F.to_json(F.array("label"))
    ends = F.repeat(F.lit("]}"), F.col("depth") - F.coalesce("next", F.lit(0)) + 1)
    piece = F.concat(F.lit('{"name":'), F.substring(name, F.lit(2), F.length(name) - 2), F.lit(',"children":['), ends, F.when(F.col("next") <= F.col("depth"), ",").otherwise(""))
    rows = F.sort_array(F.collect_list(F.struct("node_id", piece.alias("piece"))))
    return nodes.select("tree_id", "node_id", "depth", "label", following.alias("next")).groupBy("tree_id").agg(F.array_join(F.transform(rows, lambda r: r["piece"]), "").alias("json"))


def symbol_lines(symbols: DataFrame) -> DataFrame:
    """line: ``Type : X Simple Props: [k:v, ] Child Props: [p, ] Annotations: [k:v, ]`` of (kind, simple, child_props, annotations): a string, a map, an array, a map."""
    each = lambda texts: F.array_join(F.transform(F.sort_array(texts), lambda t: F.concat(t, F.lit(", "))), "")
    pairs = lambda m: F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    line = F.concat(F.lit("Type : "), "kind", F.lit(" Simple Props: ["), each(pairs("simple")), F.lit("] Child Props: ["), each(F.col("child_props")), F.lit("] Annotations: ["), each(pairs("annotations")), F.lit("]"))
    return symbols.select("*", line.alias("line"))


def report(grammar: DataFrame) -> DataFrame:
    """head, rhs, cnt, p as text lines: heads by total, then rules by count."""
    total = F.sum("cnt").over(Window.partitionBy("head"))
    rows = grammar.withColumn("total", total)
    text = F.format_string(">Prob %.5f (%d)", F.col("cnt") / F.col("total"), F.col("cnt"))
    return rows.select("head", "rhs", "total", "cnt", text.alias("line"))
