"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one set with ``setCheckpointDir``.

    Where there is neither, a session on one machine, as in tests, gets a temporary
    folder of its own; a cluster gets an error, since a local folder would lose data.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened where a column has one of them already, whatever its case."""
    used = {c.lower() for c in taken}
    return [next(n for k in range(len(used) + 1) if (n := name + "_" * k).lower() not in used) for name in names]


def kept_columns(keep: tuple[str, ...], names: tuple[str, ...]) -> list[str]:
    """``keep`` once each, without columns whose place the operator's own columns take."""
    own = {n.lower() for n in names}
    return [c for c in dict.fromkeys(keep) if c.lower() not in own]


def schema_of(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}, " for c in keep)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; smaller than a checkpoint for large tables of numbers."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows that go to Python at once where rows are whole documents.
BATCH_ROWS = 1000


def batched(docs: DataFrame) -> DataFrame:
    """``docs``, with the session set to hand whole documents to Python in smaller batches than rows of numbers.

    Ten thousand documents a batch are held several times over, by the executor and
    by Python.  A smaller setting of the user's stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(docs.sparkSession.conf.get(name)) > BATCH_ROWS:
        docs.sparkSession.conf.set(name, BATCH_ROWS)
    return docs


def held_out(doc_id: Column, folds: int) -> Column:
    """True for the rows that training may not see: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0
