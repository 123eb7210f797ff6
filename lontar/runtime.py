"""What operators need from the session: tables, shared scratch space, broadcasts of a checked size."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, as files, that a side may have to be broadcast. Columns of Parquet may take several times that in memory.
BROADCAST_BYTES = 8 << 20
#: Nodes of a plan over which Spark knows the bytes of its files, or at least no fewer.
_SIZED = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "LogicalRDD"}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lontar-"), "lontar.zip")  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name, path.relative_to(root)))
    sc.addPyFile(archive)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``: one file, or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, read straight from files, dealt to all cores where its files make fewer parts than that: for small tables
    before stages that work long on each row. Large tables have parts enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir where the cluster names one. Only a local session, whose
    executors are the driver, gets a folder of our own; elsewhere a missing setting is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lontar-")
        sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Later stages then start from files that outlive a lost executor, and the optimiser sees their true size.
    The files go when the driver ends.
    """
    spark = df.sparkSession
    ship(spark)  # operators may be called on tables that ``table`` did not read
    path = f"{shared_dir(spark).rstrip('/')}/lontar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that ``cut_lineage`` wrote and that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone, and its folder is the cluster's to clear
        pass


def file_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` reads, if it does no more than choose of their rows and columns; else None."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in _SIZED:
            return None
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return int(str(plan.stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its files have at most ``most`` bytes; else as it is, to be joined by a shuffle.

    What is not read straight from files is written first (``cut_lineage``), so that its size is known, not guessed.
    """
    size = file_bytes(df)
    if size is None:
        df = cut_lineage(df)
        size = file_bytes(df)
    return F.broadcast(df) if size is not None and size <= most else df
