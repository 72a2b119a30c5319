"""Session-level helpers shared by every operator: table access, written intermediates, bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 100_000

_local_dirs: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, _local_dirs[0], ignore_errors=True)
    return f"file://{_local_dirs[0]}"


#: Tables of this process that weren't deleted yet.
_written: list[Written] = []


class Written:
    """A table written below the shared folder; ``df`` reads it back, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, label: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        _written.append(self)

    def drop(self) -> None:
        if self in _written:
            _written.remove(self)
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_out(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: it survives the loss of executors."""
    return Written(df, label).df


def clean() -> None:
    """Delete all tables that queries have written out so far: call it once their results were read or written.

    A query's plan reads its written tables until it ends, so they can't go earlier by themselves.
    """
    for table in list(_written):
        table.drop()


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else ``df`` for a shuffled join."""
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).take(limit + 1)) <= limit else df


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
