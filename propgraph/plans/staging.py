"""Tables written to the cluster's shared folder, which cut lineage and survive lost executors.

``spark.checkpoint.dir`` names the folder. Only where it is unset, and only in local mode, a
temporary folder takes its place; a cluster without the setting is an error, because a folder of
one machine would not be seen by the others.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []
#: Paths of staged tables, by the identity of their DataFrame while it lives.
_PATHS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='propgraph-')}"
    _WRITTEN.append((spark, folder))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; removed when the driver program ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet and read back: its lineage ends at the files."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def keyed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """``df`` written once in buckets by ``key``, sorted in each: joins and sums on the key shuffle only their other side."""
    spark = df.sparkSession
    path, buckets = new_path(spark, tag), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"propgraph_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key).write.option("compression", "zstd").option("path", path)
    rows.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    _TABLES.append((spark, name))
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing will read again."""
    if (path := _PATHS.pop(id(df), None)) is not None:
        remove(df.sparkSession, path)
        _WRITTEN[:] = [w for w in _WRITTEN if w[1] != path]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, name in _TABLES:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # the session may be gone already
            remove(spark, path)
