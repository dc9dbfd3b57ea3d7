"""Staged tables: how the operators of this subpackage cut lineage.

Every multi-pass operator writes its intermediate results as Parquet below the shared folder that the session names in
``spark.checkpoint.dir`` and reads them back.  A lost executor then costs the running stage only, shuffle files of an
earlier stage can go, and an exchange that follows a staged table stands directly below a join, where adaptive execution
can split its skewed partitions.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: shuffle files go with the query that made them, and Arrow batches to Python are small, since
#: their buffers lie outside the executor's heap.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where the session names none, a local master, whose executors are the driver's
    threads, gets a temporary one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: So many ids (16 MB) are sent to every executor at most.
BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone`` (distinct ``doc_id``, staged); rows without one stay.

    The ids are counted.  Up to BROADCAST_IDS they are broadcast and no document moves; beyond, both sides meet by doc_id.
    """
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def with_ids(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``wanted`` (distinct ``doc_id``, staged); sent as in ``without_ids``."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "doc_id")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    except Exception:  # the JVM may be gone; the folder is then the cluster's to clean
        pass


class Store:
    """Staged tables of one run of one operator.

    ``keep`` writes and rereads, ``drop`` deletes a table that is no longer needed, ``done`` drops all but the result.
    The result stays until the driver ends, since the caller's DataFrame reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.live: set[str] = set()
        self.tables: dict[str, str] = {}  # bucketed ones, by label
        atexit.register(_at_exit, spark, self.root)

    def keep(self, df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{label}"
        before = {k: self.spark.conf.get(k) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        self.live.add(label)
        schema = df.schema
        if partition_by:
            return self.spark.read.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, label: str, by: str, buckets: int) -> DataFrame:
        """The rows of ``df`` dealt by the column ``by`` once, for several joins on it that don't move them again."""
        path, name = f"{self.root}/{label}", f"staged_{uuid.uuid4().hex}"
        before = {k: self.spark.conf.get(k) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            writer = df.repartition(buckets, by).write.format("parquet").option("compression", "zstd").option("path", path)
            writer.bucketBy(buckets, by).saveAsTable(name)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        self.live.add(label)
        self.tables[label] = name
        return self.spark.table(name)

    def drop(self, *labels: str) -> None:
        for label in labels:
            if label in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(label)}")
            _delete(self.spark, f"{self.root}/{label}")
            self.live.discard(label)

    def done(self, df: DataFrame, label: str = "result") -> DataFrame:
        out = self.keep(df, label)
        self.drop(*[x for x in self.live if x != label])
        return out
