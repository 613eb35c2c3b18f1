"""Session settings and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

def build_session(app: str = "docaudit", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster's own values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        STATE_STORE: ROCKSDB,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | str = 8, **conf) -> SparkSession:
    return build_session(
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g", "spark.sql.files.maxPartitionBytes": "4m", **conf},
    )


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, unless a store other than Spark's default is set.

    A stream that restarts stays with the store its checkpoint names.
    """
    if spark.conf.get(STATE_STORE).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKSDB)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; a scratch folder only on one machine with none set."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="docaudit-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared checkpoint folder and read back: computed once, with a short lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
