"""Session settings and lineage cuts shared by every flow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of a part that a model is fitted on: a forest of 100 trees holds some 530 bytes for each.
PART_ROWS = 500_000


def local_session(cpus: int | str = 8, app: str = "finops_spark", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark.

    On a cluster the session comes from the submitter; nothing below depends on
    these values, they only keep small runs fast and comparable.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a local
    session that names none gets a fresh temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name for an intermediate table, reachable by all executors."""
    return f"{_checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; ``by`` names a
    column with few values whose parts are then read on their own."""
    path = shared_folder(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Deal the rows evenly over all cores, at most ``part_rows`` to a part: for steps with much work a row,
    which would otherwise run in as many tasks as the files happen to give."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-df.count() // (cores * part_rows))))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder."""
    _checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
