"""Session settings and the shared scratch area.

The library never forces a broadcast: Spark's own size check
(``spark.sql.autoBroadcastJoinThreshold``) decides, and anything larger is a
shuffled join whose hot partitions adaptive execution splits at run time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # timestamps and years must not depend on the machine
    "spark.sql.session.timeZone": "UTC",
    # run-time re-planning: coalesced partitions, split hot partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more exchange further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# folders of local sessions that name none, by application
_OWN_DIRS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on to any session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "terrascore", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session; ``conf`` keys use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app_name)
    # recording the Python line of every Column call makes building a plan slower
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, object]) -> Iterator[None]:
    """Session settings for the actions inside, put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId  # the setting itself can't be changed while a session runs
    if application not in _OWN_DIRS:
        _OWN_DIRS[application] = tempfile.mkdtemp(prefix="terrascore-")
    return _OWN_DIRS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/terrascore/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably, lets several consumers share one computation, and
    gives the optimiser the true size of the result to choose joins with.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, label: str = "stage") -> Iterator[DataFrame]:
    """``stage`` for a frame that no other outlives: its folder is deleted at the end, also after a failure."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
