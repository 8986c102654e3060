"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# bytes of rows a byte of Parquet stands for at most: 10 to 20 on the tables of the views
FILE_TO_ROWS = 30.0
# most bytes of rows that the planner may broadcast by its own choice; a plan may hold a dozen of such joins at a time
AUTO_BROADCAST = 1 << 20


def build_session(app: str = "seaway", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller passes its own session."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # long expressions are built much faster
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("SEAWAY_DRIVER_MEMORY", "12g"))
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` names the folder all executors share and is always used when it is
    set. Only where it is unset and the session is local (tests) a temporary folder is made.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if set_dir:
        if current.isEmpty() or not current.get().startswith(set_dir.rstrip("/")):
            spark.sparkContext.setCheckpointDir(set_dir)
        return set_dir
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        made = os.path.join(tempfile.gettempdir(), f"seaway-checkpoint-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(made)
        return made
    return current.get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files that survive the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def size_by_rows(spark: SparkSession) -> None:
    """Lets the planner judge files by the rows they hold and broadcast small frames only; set once a session, a stricter value of the caller stays.

    Parquet packs repeated values, so a file is a small part of its rows in memory (a table of 1.2 million targets: 5 MB of file, 106 MB of rows).
    By the size of the file alone, tables that grow with the data count as small and are broadcast through the driver until it fails.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name, "1.0")) < FILE_TO_ROWS:
        spark.conf.set(name, str(FILE_TO_ROWS))
        small = "spark.sql.autoBroadcastJoinThreshold"
        now = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(small).lower())
        if now and int(now[1]) << 10 * " kmgt".index(now[2] or " ") > AUTO_BROADCAST:
            spark.conf.set(small, str(AUTO_BROADCAST))


def settle(df: DataFrame) -> DataFrame:
    """The frame written to the checkpoint folder as Parquet and read again; for loops.

    A checkpointed frame keeps the size that was estimated for it, and estimates of joins are products. In a loop that joins a
    frame with itself they double their digits every round until planning takes longer than the work. Files have a size of their own.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
