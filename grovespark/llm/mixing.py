"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target, target over size is the
repetition rate, and a document is emitted floor(rate) times plus one more time
with probability equal to the fraction.  The draw is a hash of seed and doc_id, so
every rerun, and every executor that repeats a lost task, draws alike.

The per-source table has one row a source and is the only thing that is joined
back; documents are never shuffled.  A source with a third of all rows costs
nothing extra: sums are formed before the shuffle and the join sends the small
side as long as it has few rows, which is counted first.

Defined results: null text has size 0; null source is a source of its own, last
in order; a source whose documents are all empty has target 0 and takes nothing;
equal doc_ids draw alike; an empty table gives an empty result; other columns of
the input pass through ``emit`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovespark.llm.common import WORD, cut, fresh

SEED = "mix-1"
#: No source is repeated more often than this.
MOST = 3
#: A per-source table of up to so many rows (some 100 bytes each) is broadcast.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1): the first 32 bits of an MD5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, repeating in code point order, null last, no target above ``most`` sizes.

    What capped sources leave is shared among the others by weight until none is
    above its cap.  The end of that process is target = least(cap, level * weight)
    for one level: with sources in order of cap / weight, the level is what
    remains after the caps before, over the weight from there on, at the first
    source that this level doesn't lift above its cap.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("reach", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0)))
        .withColumn("passed", F.coalesce(F.sum("weight").over(by_cap), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("before")) / (F.sum("weight").over(every) - F.col("passed")))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(every))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def copies(docs: DataFrame, seed: str = SEED, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and ``copies``: how often the mix takes the document."""
    sized = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    per_source = targets(sized, most).withColumnRenamed("source", "of_source")
    rate = F.col("target") / F.col("source_size")
    return (
        sized.join(per_source, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rate", F.when(F.col("source_size") > 0, rate).otherwise(0.0))
        .withColumn("copies", F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0))
        .select("doc_id", "source", "size", "source_size", "target", "copies")
    )


def emit(docs: DataFrame, seed: str = SEED, most: int = MOST) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the mix takes it, all columns kept."""
    sized = docs.select("source", words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    of, rate, number = fresh(docs.columns, "of", "rate", "number")
    per_source = cut(targets(sized, most).select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate)))
    if per_source.count() <= BROADCAST_SOURCES:  # else documents are shuffled by source, and the engine splits hot ones
        per_source = F.broadcast(per_source)
    n = F.floor(rate) + F.when(draw(F.col("doc_id"), seed) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    joined = docs.join(per_source, F.col("source").eqNullSafe(F.col(of)))
    return joined.withColumn(number, F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same in DuckDB, over a relation named ``{docs}``.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size FROM {docs}),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM per),
ordered AS (
  SELECT *, cap / weight AS reach,
    coalesce(sum(cap) OVER w, 0) AS before, coalesce(sum(weight) OVER w, 0) AS passed,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, max(CASE WHEN CAST(total - before AS DOUBLE) / CAST(all_weight - passed AS DOUBLE) <= reach
    THEN CAST(total - before AS DOUBLE) / CAST(all_weight - passed AS DOUBLE) END) OVER () AS level FROM ordered),
rated AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target,
    CASE WHEN source_size > 0 THEN least(CAST(cap AS DOUBLE), level * weight) / source_size ELSE 0.0 END AS rate FROM leveled)
SELECT d.doc_id, d.size, r.source_size, r.target,
  CAST(d.size * (floor(r.rate) + CASE WHEN CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS UBIGINT) / 4294967296.0
    < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""
