"""Which elements occur together: pairs, lift, mutual information, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovespark.functions import NEG_INF, ln
from grovespark.operators.ranking import running_sum


def count_pairs(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """row, col, n over documents, from (doc, row) and (doc, col), each distinct per document."""
    return rows.distinct().join(columns.distinct(), "doc").groupBy("row", "col").agg(F.count("*").alias("n"))


def lifts(pairs: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """row, col, n, lift = ln of p(row, col) / p(row) p(col); totals are sums of element counts over documents."""
    r = rows.distinct().groupBy("row").agg(F.count("*").alias("n_row"))
    c = columns.distinct().groupBy("col").agg(F.count("*").alias("n_col"))
    totals = pairs.agg(F.sum("n").alias("all")).crossJoin(r.agg(F.sum("n_row").alias("all_rows"))).crossJoin(c.agg(F.sum("n_col").alias("all_cols")))
    joined = pairs.join(r, "row").join(c, "col").crossJoin(F.broadcast(totals))  # one row of totals
    value = ln(F.col("n") / F.col("all")) - ln(F.col("n_row") / F.col("all_rows")) - ln(F.col("n_col") / F.col("all_cols"))
    return joined.select("row", "col", "n", "n_row", "n_col", value.alias("lift"))


def log_lift(pairs: DataFrame, lifted: DataFrame) -> DataFrame:
    """lift of asked pairs, -inf for those never seen together."""
    return pairs.join(lifted.select("row", "col", "lift"), ["row", "col"], "left").fillna({"lift": NEG_INF})


def prune_pairs(lifted: DataFrame, least: int) -> DataFrame:
    """Drop pairs seen ``least`` times or fewer; totals stay as they were."""
    return lifted.where(F.col("n") > least)


def mutual_information(pairs: DataFrame, rows: DataFrame, columns: DataFrame, by: str = "row") -> DataFrame:
    """row, col, pmi within each row (or column): share of the pair in the row, over the row's and the column's shares."""
    r = rows.distinct().groupBy("row").agg(F.count("*").alias("n_row"))
    c = columns.distinct().groupBy("col").agg(F.count("*").alias("n_col"))
    within = F.sum("n").over(Window.partitionBy(by))
    totals = r.agg(F.sum("n_row").alias("all_rows")).crossJoin(c.agg(F.sum("n_col").alias("all_cols")))
    joined = pairs.withColumn("within", within).join(r, "row").join(c, "col").crossJoin(F.broadcast(totals))  # one row of totals
    value = ln(F.col("n").cast("double")) - ln(F.col("within").cast("double")) - ln(F.col("n_row") / F.col("all_rows")) - ln(F.col("n_col") / F.col("all_cols"))
    return joined.select("row", "col", value.alias("pmi"))


def likely_pairs(items: DataFrame, least: int = 2) -> DataFrame:
    """a, b, n, score: unordered pairs of elements seen together in more than ``least`` documents, by likelihood ratio.

    Only elements that are frequent enough themselves can be in such a pair, so the
    others go before documents are joined with themselves.
    """
    seen = items.distinct()
    single = seen.groupBy("item").agg(F.count("*").alias("c"))
    often = seen.join(single.where(F.col("c") > least).select("item"), "item", "left_semi")
    pairs = often.withColumnRenamed("item", "a").join(often.withColumnRenamed("item", "b"), "doc").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    every = seen.withColumnRenamed("item", "a").groupBy("doc").agg(F.count("*").alias("k")).agg(F.sum(F.expr("k * (k - 1) / 2")).alias("all_pairs"))
    totals = every.crossJoin(single.agg(F.sum("c").alias("all_items")))
    one, two = single.withColumnsRenamed({"item": "a", "c": "ca"}), single.withColumnsRenamed({"item": "b", "c": "cb"})
    joined = pairs.where(F.col("n") > least).join(one, "a").join(two, "b").crossJoin(F.broadcast(totals))  # one row of totals
    p = F.col("n") / F.col("all_pairs")
    score = p * (F.log(p) - F.log(F.col("ca") / F.col("all_items")) - F.log(F.col("cb") / F.col("all_items")))
    return joined.select("a", "b", "n", score.alias("score"))


def pair_accuracy(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """a, b, both, either, accuracy in test documents; documents with both count in both directions."""
    seen = items.distinct()
    has_a = pairs.join(seen.withColumnRenamed("item", "a"), "a").select("a", "b", "doc", F.lit(1).alias("x"), F.lit(0).alias("y"))
    has_b = pairs.join(seen.withColumnRenamed("item", "b"), "b").select("a", "b", "doc", F.lit(0).alias("x"), F.lit(1).alias("y"))
    met = has_a.unionByName(has_b).groupBy("a", "b", "doc").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    both = F.sum(2 * F.col("x") * F.col("y"))
    either = F.sum(F.col("x") + F.col("y"))
    return met.groupBy("a", "b").agg(both.alias("both"), either.alias("either"), (both / either).alias("accuracy"))


def popularity(elements: DataFrame, name: str) -> DataFrame:
    """Elements by number of documents, most first, then by name."""
    counted = elements.distinct().groupBy(name).agg(F.count("*").alias("n"))
    return running_sum(counted, [F.desc("n"), F.col(name)], F.lit(1), "rank").withColumn("rank", F.col("rank").cast("int"))


def top_and_fill(lifted: DataFrame, popular: DataFrame, per_row: int, most: int) -> DataFrame:
    """col: the best columns by lift of every row, filled up with popular ones to ``most``."""
    best = lifted.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy(F.round("lift", 9).desc(), "col"))).where(F.col("k") <= per_row).select("col").distinct()
    ranked = popular.join(best.withColumn("first", F.lit(0)), "col", "left").fillna(1, ["first"])
    return ranked.orderBy("first", "rank").limit(most).select("col")


def lift_matrix(rows: DataFrame, columns: DataFrame, lifted: DataFrame) -> DataFrame:
    """row, col, value = exp(lift), 0 for pairs never seen; for the chosen rows and columns."""
    # the matrix is the result: chosen rows times chosen columns
    grid = rows.select("row").distinct().crossJoin(columns.select("col").distinct()).join(lifted.select("row", "col", "lift"), ["row", "col"], "left")
    return grid.select("row", "col", F.coalesce(F.exp("lift"), F.lit(0.0)).alias("value"))


def suggestions(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """doc, col, score, rank: for each document the columns by their best score over the rows it has."""
    best = documents.distinct().join(scores, "row").groupBy("doc", "col").agg(F.max("pmi").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "col")))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """k, docs, found, recall: documents with at least k suggestions, and those with a correct one among the first k."""
    right = ranked.join(truth.distinct().withColumn("right", F.lit(1)), ["doc", "col"], "left")
    per_doc = right.groupBy("doc").agg(F.max("rank").alias("n"), F.min(F.when(F.col("right") == 1, F.col("rank"))).alias("first"))
    each = per_doc.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("n >= k")
    found = F.count_if(F.col("first") <= F.col("k"))
    return each.groupBy("k").agg(F.count("*").alias("docs"), found.alias("found"), (found / F.count("*")).alias("recall"))


def precision_at(ranked: DataFrame, truth: DataFrame, splits: list[float]) -> DataFrame:
    """split, threshold, docs, mean_size, precision: suggestions with scores from the one at that share of the descending order on.

    Distinct scores are sorted in ranges, with running counts of their suggestions.
    """
    distinct = ranked.groupBy("score").agg(F.count("*").alias("n"))
    running = running_sum(distinct, [F.desc("score")], F.col("n"), "upto")
    total = ranked.agg(F.count("*").alias("total"))
    wanted = F.floor(F.col("total") * F.col("split")) + 1
    grid = total.withColumn("split", F.explode(F.array(*[F.lit(float(s)) for s in splits])))
    cuts = running.join(grid, F.col("upto") >= wanted).groupBy("split").agg(F.max("score").alias("threshold"))
    right = ranked.join(truth.distinct().withColumn("right", F.lit(1)), ["doc", "col"], "left").fillna(0, ["right"])
    kept = right.join(F.broadcast(cuts), F.col("score") >= F.col("threshold"))  # one row a split
    per_doc = kept.groupBy("split", "threshold", "doc").agg(F.count("*").alias("size"), F.avg("right").alias("precision"))
    return per_doc.groupBy("split", "threshold").agg(F.count("*").alias("docs"), F.avg("size").alias("mean_size"), F.avg("precision").alias("precision"))


def super_package(name: str):
    """The part before the last dot; all of it if there is none."""
    return F.regexp_replace(name, r"\.[^.]+$", "")
