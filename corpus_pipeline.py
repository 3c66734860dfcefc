"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm import bpe, jaccard, langid, mixing, pii
from grovespark.llm.common import fresh, removed, shared_folder, stored, table
from grovespark.llm.queries import pseudonym_key, tokenizer_path

#: Documents whose best language is less probable than this are in none of the languages learned.
LEAST_LANGUAGE = 0.5
#: Near copies share 0.8 of their five-word shingles.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from ``lang``; those without letters or of no known language go."""
    network = langid.train(docs, F.lit(True))
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = langid.predict(docs, network, keep=tuple(docs.columns), names=(lang, score))
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays; texts without words are no copies of each other.

    Rows are told apart by a hash of all their columns: rows of one id with other texts
    are documents of their own, a null id comes last, and equal rows are one document.
    Texts are not shuffled for this: the rows that go, few of all, are joined out, and
    only rows that occur more than once and stay are grouped.
    """
    row, group, times = fresh(docs.columns, "row", "group", "times")
    hashed = [c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))]
    keyed = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    found = jaccard.join(keyed.select(F.col(row).alias("doc_id"), "text"), NEAR_WIDTH, NEAR_PERCENT)
    ids = keyed.groupBy(row).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias(times))
    placed = stored(found.select(F.col("doc_id").alias(row), F.col("component_id").alias(group)).distinct().join(ids, row))
    first = placed.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    going, repeated = placed.join(first, row, "left_anti"), placed.join(first, row, "left_semi").where(F.col(times) > 1)
    once = keyed.join(going.union(repeated).select(row), row, "left_anti").select(*docs.columns)
    twice = keyed.join(repeated.select(row), row, "left_semi").dropDuplicates([row]).select(*docs.columns)
    return once.union(twice)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within its format; n_chars follows the new text."""
    found = pii.pseudonymise(docs, pseudonym_key(spark), keep=tuple(docs.columns), kinds=fresh(docs.columns, "kinds")[0])
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with its source."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "source"), decoded=False)


STAGES = [("language ID", identify), ("n-gram Jaccard join", one_of_near_copies), ("PII", pseudonyms), ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

#: Stages train models and encode with a vocabulary, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
