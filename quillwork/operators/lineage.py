"""Cut lineage and shared folders."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or on a local master, and only there, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


#: Folders of this driver, deleted when it ends.
_own: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for what a query writes on its way; it goes when the driver ends."""
    _own.append((spark, f"{shared_dir(spark)}/quillwork-{name}-{uuid.uuid4().hex}"))
    return _own[-1][1]


def drop_scratch() -> None:
    """Delete the folders that scratch() and checkpointed() have made; no result that reads them may still be needed."""
    while _own:
        spark, path = _own.pop()
        with contextlib.suppress(Exception):  # the session is gone: the folder's owner cleans up
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(drop_scratch)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which a lost executor does not lose."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
        _own.append((df.sparkSession, context.getCheckpointDir()))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table below the shared folder: as checkpointed(), but packed in columns, of which each reader takes its own."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows of a few numbers that a task sorts or hashes at a time.
ROWS_A_TASK = 1_000_000


def parted(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys, in parts whose number grows with its rows, so that what one task holds does not."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def dealt(df: DataFrame) -> DataFrame:
    """df over all partitions: rows that a small file holds are few tasks else, however dear each row is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
