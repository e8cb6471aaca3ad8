"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Tables of each open scope, the innermost last.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent (a laptop, a test) a temporary folder of
    this machine is used instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-tallyloom-"))
    return _LOCAL[0]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result depends on those files alone, so a lost executor costs a re-read
    and no recomputation of what lies above.  Columns keep names and types.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the tables that are cut inside, also after an error, when the scope
    ends.  What they feed is read or written inside; a frame that still depends on
    them is of no use afterwards.  A scope inside another removes its own."""
    tables: list[str] = []
    _SCOPES.append(tables)
    try:
        yield tables
    finally:
        _SCOPES.remove(tables)
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        for name in tables:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(settings).delete(path, True)
