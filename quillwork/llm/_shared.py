"""Helpers shared by the text-corpus operators: scratch tables, table access, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word and normalisation rule of this subpackage.
SPACE = r"\x20\x09-\x0D"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, or one of its own on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor never
    recomputes what is above it and several readers share one computation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillwork-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() has written and that no result still to be computed reads."""
    for path in {t.scratch_path for t in tables}:
        entry = next(x for x in _written if x[1] == path)
        _written.remove(entry)
        _delete(*entry)


def scratch_mark() -> int:
    """The number of tables written so far, for drop_scratch."""
    return len(_written)


def drop_scratch(since: int = 0, keep_last: int = 0) -> None:
    """Delete the tables that cut() has written since a mark, but for the last ones; call it when no
    result that reads them is still needed. What is left goes when the driver ends."""
    end = len(_written) - keep_last
    gone, _written[since:end] = _written[since:end], []
    for entry in gone:
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: the folder's owner cleans up
        return


atexit.register(drop_scratch)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_ids(df: DataFrame, *columns: Column) -> DataFrame:
    """The named columns and a row number of no meaning; stable only once the result is written."""
    return df.select(F.monotonically_increasing_id().alias("row_id"), *columns)
