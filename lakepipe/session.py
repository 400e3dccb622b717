"""Session defaults and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

# For large inputs, on top: pass to ``build_session(conf=...)`` or to spark-submit.
CLUSTER_CONF = {
    # start wide, adaptive execution merges what turns out small
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    # fewer, larger input splits
    "spark.sql.files.maxPartitionBytes": "512m",
    # stream state on disk instead of in executor memory
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(
    app: str = "lakepipe", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="lakepipe-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder. All paths of a session are deleted when it ends."""
    root = f"{shared_root(spark)}/lakepipe/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    root, context = shared_root(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return df.checkpoint(eager=True)


#: With this setting a command deletes its shuffle files as soon as it has ended, on the executors too.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_cleanly(df: DataFrame, path: str) -> None:
    """Write a table; the shuffle files of the job go with its end, as what comes after reads the table."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_SHUFFLES, None)
    conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(CLEAN_SHUFFLES)
        else:
            conf.set(CLEAN_SHUFFLES, before)


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """The rows, written as a table of the shared folder and read back; the table goes when the session ends."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    write_cleanly(df, path)
    return spark.read.schema(df.schema).parquet(path)
