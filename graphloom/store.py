"""Durable intermediate tables.

Iterative plans and plans that read an intermediate result twice cut their lineage here.
Tables go to the folder that the cluster names in ``spark.checkpoint.dir``, which all
executors and the driver share, so a lost executor never loses them.  Only where that
setting is absent in local mode (tests, notebooks) a folder of our own is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_ROOTS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one only where the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _OWN[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """``DataFrame.checkpoint`` needs a folder; a folder that is set already is kept."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder of Parquet tables that one operator call writes in the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/graphloom-{label}-{uuid.uuid4().hex}"
        _ROOTS.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as a scan of the written files."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        _delete(self.spark, self.path(name))


def free_shuffles(spark: SparkSession) -> None:
    """Has the JVM look for plans that nothing refers to any more, whose shuffle files Spark then deletes.

    Without it they stay until the driver's next full collection, long after their phase.
    """
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _sweep() -> None:
    for spark, root in _ROOTS:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, root)
        except Exception:  # the JVM may be gone already
            return
