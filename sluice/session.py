"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: What streams with keyed lists and timers need; Spark's default provider has neither.
KEYED_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def configure(spark: SparkSession) -> SparkSession:
    """Set what the semantics need: UTC clock and last-wins duplicate JSON keys."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Other settings for a while; those of before come back, also after an error.

    A stream keeps those it was started under.
    """
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is
    used only by a local-mode session that names none, as in tests.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="sluice-")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there.

    For narrow results of costly work that several passes need, and that must
    survive the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows ready for costly work per row, in at least as many tasks as there are cores.

    Only a scan with fewer splits than that, such as one small file, is
    shuffled; anything larger is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session with the same settings but for those that pay off on large tables.

    Adaptive execution makes each shuffle of a query a job, with a thread of
    its own for a minute, which costs more than the work on a few thousand rows.
    """
    small = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            small.conf.set(name, value)
    for name, value in {"adaptive.enabled": "false", "shuffle.partitions": str(partitions), "autoBroadcastJoinThreshold": "-1"}.items():
        small.conf.set(f"spark.sql.{name}", value)
    return small


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slice_count(spark: SparkSession) -> int:
    """How many key ranges a hot group is split into, from the shuffle width."""
    return max(16, 4 * shuffle_width(spark))
