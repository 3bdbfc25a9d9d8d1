"""Session settings and the shared working folder."""

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", name: str = "statledger", **settings) -> SparkSession:
    """Session for tests and the benchmark; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from spark.checkpoint.dir.

    Only a local-mode session without the setting gets a temporary folder of its
    own; on a cluster the setting is required.
    """
    folder = spark.conf.get(_CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CHECKPOINT_DIR} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="statledger-")
    spark.conf.set(_CHECKPOINT_DIR, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return os.path.join(shared_folder(spark), "statledger", f"{name}-{uuid.uuid4().hex}")


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it a command's shuffle files go when the command ends. Else they stay until the driver happens to
    collect its garbage, and all shuffles of a job of many commands add up on disk."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


def side_by_side(*steps) -> list:
    """The results of steps that don't need each other. Their jobs fill the cores that one step leaves idle; all
    steps end, also if one fails, before its failure is raised."""
    if not steps:
        return []
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(step)) for step in steps]
    return [step.result() for step in running]


def written(df: DataFrame, name: str, partition_by: list = None) -> DataFrame:
    """The frame after a round trip through Parquet in the shared folder.

    Cuts the lineage: what follows reads files, so a lost executor costs a re-read
    and not the work before, and row numbers given at a scan are settled.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
