"""Tables written to the folder that driver and executors share.

Iterative operators cut their lineage here instead of holding blocks on executors, so a lost executor costs a
re-read and never a result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's own switch to remove a query's shuffle files once it has ended; a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Store:
    """Written tables of one operator call, under one folder of their own, which goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, {}
        system, path = self._path(self.root)
        system.deleteOnExit(path)

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def put(self, df: DataFrame, name: str, instead: bool = False, tight: bool = False) -> DataFrame:
        """Writes ``df`` as Parquet and returns a DataFrame that reads it. instead: the table last put under the name goes. tight: for less disk."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path, compression="zstd" if tight else "snappy")
        finally:
            self.spark.conf.set(CLEANUP, before)
        if instead:
            self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes the tables last put under the names; call it once nothing lazy reads them any more."""
        for name in names:
            if path := self.paths.pop(name, None):
                system, p = self._path(path)
                system.delete(p, True)

    def keep(self, *names: str) -> None:
        """Removes all tables but those last put under the names."""
        self.drop(*(x for x in [*self.paths] if x not in names))
