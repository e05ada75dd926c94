"""Tables that cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


#: Folders of the tables that `written` gave, for as long as these are referred to.
FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session within one process, as in tests, may do without and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="agentlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@lru_cache(maxsize=64)
def own_folder(folder: str, application: str, session: SparkSession) -> str:
    """A folder of this application's within the shared one; the file system deletes it when the driver ends."""
    path = session._jvm.org.apache.hadoop.fs.Path(f"{folder}/agentlens-{application}")
    files = path.getFileSystem(session._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{own_folder(shared_folder(spark), spark.sparkContext.applicationId, spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: what several plans start from is computed once, and a lost executor loses nothing.

    `options` go to the writer, such as a smaller row group for rows of large lists, which are read a row group at a time.
    """
    spark = df.sparkSession
    path = new_table(spark)
    df.write.options(**options).parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    FOLDERS[again] = path
    return again


def discarded(*tables: DataFrame) -> None:
    """Deletes the files of tables from `written`: what was derived from them is written itself, so that nothing reads them again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(FOLDERS.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
