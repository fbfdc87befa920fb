"""Session factory and the two session services that every operator may need."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "graphloam", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    On a cluster leave ``master`` unset: the submitter's settings win. Adaptive
    execution stays on, so shuffle partitions are coalesced and skewed joins split.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: ``spark.checkpoint.dir``, or a temporary one where it is unset.

    The temporary folder is for a single machine (tests); a cluster must name a shared one.
    """
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "graphloam-checkpoints"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint (never a local one)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once as a Parquet table in the checkpoint folder: smaller than a checkpoint and read by column.

    The table stays until the folder is cleared, as checkpoints of lost sessions do.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_round(df: DataFrame) -> DataFrame:
    """``settle`` for loops: a table in the checkpoint folder, whose size Spark reads from its files.

    A checkpoint keeps the size that its plan was estimated at. Joins multiply estimates, so a
    loop of joins would double their digits in each round until planning takes longer than the work.
    """
    return stored(df, "round")


#: A side of a join is broadcast on purpose only when its settled row count is at most this.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which must be settled, with a broadcast hint if it has at most ``limit`` rows; else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Rows that a task gets at most, on average, where its memory must not follow the input.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as ``rows`` need, one for each core at least.

    Adaptive execution joins partitions by their compressed bytes, so of names that
    compress well it makes a few tasks with millions of rows each. A number that is given stays.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
