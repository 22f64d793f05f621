"""Sinks: sorted CSV parts, one CSV part, SQLite tables in one transaction, or a text file per row."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Mapping
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.values import GridError


def table_name(prefix: str, run_id: str, step: str) -> str:
    return f"{prefix}_{run_id}_{step}"


def write_csv_parts(df: DataFrame, path: str, order: list[str]) -> None:
    """A folder of CSV parts which, read by name, are in the given order; for tables of any size."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A folder with one CSV part in the given order, replaced as a whole; one task writes it, so for small results."""
    df.repartition(1).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True)


#: Files that one task writes, and the most tasks.
TASK_FILES, TASKS = 1024, 10_000
#: Characters that Spark's writer escapes in the name of a subfolder.
_ESCAPED = {c: f"%{c:02X}" for c in (*range(1, 32), *b"\"#%'*/:=?\\{[]^", 127)}


def _subfolder(value: str | None) -> str:
    """The name that Spark's writer gives a value's subfolder."""
    return f"run={value.translate(_ESCAPED) if value else '__HIVE_DEFAULT_PARTITION__'}"


def _write_files(root: str, rows: Iterable[Row]) -> None:
    """One file a subfolder, of rows sorted by it; a file has its name once it is whole, so a task may run again."""
    for name, same in groupby(rows, lambda r: _subfolder(r.run)):
        folder = f"{root}/{name}"
        os.makedirs(folder, exist_ok=True)
        passing = f"{folder}/.{uuid.uuid4().hex}"
        with open(passing, "wb") as out:
            out.writelines(bytes(r.value or b"") + b"\n" for r in same)
        os.replace(passing, f"{folder}/part-00000.txt")


def write_texts(df: DataFrame, root: str, folder: str, text: str) -> None:
    """Every row's text as a file in the subfolder that the column `folder` names, which is to be unique.

    The file's name begins with `part-`, its subfolder is the row's, and a line end follows the text. Small files take far
    longer than their bytes say, so a count of the rows, not the partitions they lie in, decides how many tasks share them.
    Rows are dealt by the subfolder, so a task that runs again writes the same files. On a mounted folder (file://) tasks
    write the files themselves, since Hadoop starts several processes a file there to set its mode. Elsewhere Spark's own
    writer does, and each task moves its files to their place, which the driver would otherwise do one by one.
    """
    rows = df.select(F.col(folder).cast("string").alias("run"), F.col(text).alias("value"))
    n = min(TASKS, df.count() // TASK_FILES + 1)
    dealt = rows.repartition(n, "run")
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        dealt.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("run").text(root)
        return
    files.delete(place, True)
    files.mkdirs(place)
    local = place.toUri().getPath()
    dealt.select("run", F.col("value").cast("binary")).sortWithinPartitions("run").foreachPartition(lambda part: _write_files(local, part))
    files.create(context._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")).close()


def write_sqlite(tables: Mapping[str, DataFrame], path: str) -> None:
    """Drop, create and fill all tables in one transaction; rows come partition by partition, never all at once.

    The file is the driver's own, so this exports small results; large ones belong into Parquet or a database.
    """
    for df in tables.values():
        if len({c.lower() for c in df.columns}) < len(df.columns):
            raise GridError("E413", "column titles must differ in more than case")
    quote = lambda name: '"' + name.replace('"', '""') + '"'
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}
    db = sqlite3.connect(path, isolation_level=None)
    try:
        db.execute("BEGIN")
        for name, df in tables.items():
            db.execute(f"DROP TABLE IF EXISTS {quote(name)}")
            db.execute(f"CREATE TABLE {quote(name)} ({', '.join(f'{quote(c)} {kinds.get(t, "TEXT")}' for c, t in df.dtypes)})")
            flat = df.select(*(F.col(f"`{c}`").cast("int") if t == "boolean" else F.col(f"`{c}`") for c, t in df.dtypes))
            marks = ", ".join("?" * len(df.columns))
            db.executemany(f"INSERT INTO {quote(name)} VALUES ({marks})", (tuple(r) for r in flat.toLocalIterator()))
        db.execute("COMMIT")
    except BaseException:
        db.execute("ROLLBACK")
        raise
    finally:
        db.close()
