"""Spark session defaults and scratch storage for iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeweft")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    On a cluster this is ``spark.checkpoint.dir``; a folder of our own is used only where that
    setting is absent, which is the case in local tests; a cluster without it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="codeweft-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written intermediate tables: lineage is cut and a lost executor costs only a re-read.

    ``save`` writes a frame as Parquet and returns the frame that reads it back; ``drop`` deletes
    a table that no later step reads. What is left goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/codeweft-{name}-{uuid.uuid4().hex}"
        self._made: dict[int, str] = {}
        self._n = 0
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._made[id(back)] = path
        return back

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = self._made.pop(id(df), None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the context may be gone already
            pass
