"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def log2(x: Column) -> Column:
    """Base-2 logarithm with log2(0) = -inf, where the engine's own gives null."""
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(F.log2(x))


def ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(F.log(x))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def log2_sum_exp(rows: DataFrame, group: list[str], x: Column) -> DataFrame:
    """``group`` and log2p: log2 of the sum of the powers of two of ``x``, relative to the group's maximum so that nothing underflows.

    The maximum is a window over the partitioning that the aggregate uses too.
    """
    most = F.max("x_").over(Window.partitionBy(*group))
    each = rows.select(*group, x.alias("x_")).withColumn("most_", most)
    part = F.when(F.col("x_") == NEG_INF, 0.0).otherwise(F.pow(F.lit(2.0), F.col("x_") - F.col("most_")))
    total = each.groupBy(*group).agg(F.max("most_").alias("most_"), F.sum(part).alias("sum_"))
    return total.select(*group, F.when(F.col("most_") == NEG_INF, NEG_INF).otherwise(F.col("most_") + F.log2("sum_")).alias("log2p"))


def log2_binomial(n: Column, k: Column) -> Column:
    """log2 of n over k, as a sum over 1 .. min(k, n - k)."""
    least = F.least(k, n - k)
    terms = F.when(least <= 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), least.cast("bigint")))
    return F.aggregate(terms, F.lit(0.0), lambda s, i: s + F.log2((n - least + i).cast("double")) - F.log2(i.cast("double")))


def uniform(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on seed and key alone: 52 bits of a digest of their text, which any engine can make."""
    text = F.concat_ws("/", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


#: The right-hand side of a node without properties.
NO_PROPERTY = r"\0"
#: Characters that separate things in the text of rules and fragments.
_MARKS = r"([\\,|*()])"


def label_text(label: Column) -> Column:
    """A label with separators escaped, so that texts of different rules differ; an empty label is written too."""
    return F.when(label == "", r"\e").otherwise(F.regexp_replace(label, _MARKS, r"\\$1"))


def label_of(text: Column) -> Column:
    """The label that ``label_text`` wrote."""
    return F.when(text == r"\e", "").otherwise(F.regexp_replace(text, r"\\(.)", "$1"))


def without_roots(form: Column) -> Column:
    """The text of a fragment without the stars before its tokens."""
    return F.regexp_replace(form, r"(?<!\\)\*", "")


def rule_text(rhs: Column) -> Column:
    """A right-hand side, an array of labels for each property, as ``a,b|c``; without any property a mark of its own."""
    return F.when(F.size(rhs) == 0, NO_PROPERTY).otherwise(F.array_join(F.transform(rhs, lambda p: F.array_join(F.transform(p, label_text), ",")), "|"))
