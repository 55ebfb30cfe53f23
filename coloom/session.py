"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "coloom", **conf) -> SparkSession:
    """A session for tests and the bench.  On a cluster, use the one spark-submit gives."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.compress", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for data between jobs, which all executors share.

    It is named by ``spark.checkpoint.dir``.  Only a local master without that
    setting gets a temporary folder of its own, which goes when the program ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="coloom-ckpt-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Rows of the largest input that one shuffle partition is meant for, and bytes of a shuffle that one task reads.
ROWS, READ = 250_000, "16MB"
PARTITIONS, ADVISORY = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Give shuffles as many partitions as ``rows`` need, never fewer than the session was given.

    With a fixed number a task's rows, and its sort and hash memory, grow with the tables.
    Adaptive execution would merge partitions to 64 MB of compressed rows, some 20 times that in
    memory, so it is told less.  For fewer rows, what the session was given comes back.
    """
    need = -(-rows // ROWS)
    given = _given(spark, PARTITIONS)
    _settle(spark, PARTITIONS, given, str(max(need, int(given))))
    given = _given(spark, ADVISORY)
    _settle(spark, ADVISORY, given, READ if need > int(_given(spark, PARTITIONS)) else given)


def _given(spark: SparkSession, key: str) -> str:
    """The session's own value: what is set now, unless ``_settle`` set it."""
    now = spark.conf.get(key)
    return spark.conf.get(f"coloom.given.{key}", now) if spark.conf.get(f"coloom.set.{key}", None) == now else now


def _settle(spark: SparkSession, key: str, given: str, value: str) -> None:
    spark.conf.set(f"coloom.given.{key}", given)
    spark.conf.set(f"coloom.set.{key}", value)
    spark.conf.set(key, value)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back with an empty lineage.

    The data outlives any executor.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files go of plans that nobody holds any more.

    Spark deletes them once the driver's heap was collected, which on a large heap may be long after
    ``cut`` has made them useless; until then they add up on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
