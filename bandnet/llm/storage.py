"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_written: list[str] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a cluster must name it.

    A session within one process that names none gets a folder of this module's own; its settings stay as they are.
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a folder shared by all executors")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="bandnet-llm-"))
        folder = _own[0]
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What follows is planned from files, so a lost executor costs a reread and never a change of the rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/bandnet-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing will read again; other tables are left alone."""
    for table in tables:
        path = getattr(table, "stored_path", None)
        if path in _written:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _written.remove(path)


def discard_stored(spark: SparkSession) -> int:
    """Delete the tables that this process has stored; call it when no result built on them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    count = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count


def fresh_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for helpers that clash with none of the table's own, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found
