"""Label counts over arriving items, as a Structured Streaming aggregation.

Counts add up, so the result of a stream equals that of the batch over the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def item_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as they arrive: files of the folder, a few at a time."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/lineitem.parquet*")


def label_counts(items: DataFrame) -> DataFrame:
    """label, n: the state has one row a label."""
    return items.groupBy(F.concat("l_returnflag", "l_linestatus").alias("label")).agg(F.count("*").alias("n"))


def run_to_end(counts: DataFrame) -> DataFrame:
    """Process what is there, then give the counts; the sink holds the aggregate, one row a label."""
    name = f"counts_{uuid.uuid4().hex}"
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.table(name)
