"""Written intermediate tables in the folder that all machines share.

The folder is the one that ``spark.checkpoint.dir`` names.  A table that is
written here has no lineage: a lost executor costs a re-read, not the
recomputation of the stages before it.  Without that setting a session on one
machine gets a folder of its own; on a cluster that is an error, since a folder
of the driver's machine is not seen by the executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Workspaces of this process whose tables results may still read.
_open: list[Workspace] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one set on the context."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = context._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="terrane-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """One run's tables.  ``keep`` writes and rereads, ``drop`` deletes early;
    what is left goes with ``release``, once the results have been written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _open.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        self._delete(self.root)
        if self in _open:
            _open.remove(self)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def opened() -> list[Workspace]:
    """The workspaces that are open now."""
    return list(_open)


def release(*keep: Workspace) -> None:
    """Delete the tables of all workspaces but those given: for a caller that
    has written the results that read them.  ``release(*before)``, with
    ``before = opened()`` from its start, leaves other callers' tables alone."""
    for ws in list(_open):
        if ws not in keep:
            ws.close()


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small: whole texts are handed to Python, and ten
    thousand long ones at once would not fit beside the heap.  The session's
    setting is lowered (never raised), since plans read it when they run."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly, for work that takes long over few bytes: a table's
    file gives a task for so many bytes, or for each row group, and a small
    shuffle is made into few tasks."""
    return df.repartition(partitions(df.sparkSession))


#: Tasks that rows of one value are dealt out to, at most.
SHARES = 4


def spread_alike(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """df dealt out like ``spread``, with rows of one value after one another, so
    that a task works it out once; by their keys they go to several tasks, so
    that a value of very many rows is not one task's."""
    share = F.pmod(F.xxhash64(*keys), F.lit(SHARES))
    dealt = df.withColumn("__value", F.xxhash64(value)).repartition(partitions(df.sparkSession), "__value", share)
    return dealt.sortWithinPartitions("__value").drop("__value")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
