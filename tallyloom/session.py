"""Session helpers: a local session for tests, and the shared checkpoint folder."""

from __future__ import annotations

import re
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    extra = {"spark.checkpoint.dir": checkpoint_dir} if checkpoint_dir else {}
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(map=extra)
        .getOrCreate()
    )


def ship_by_value(module: str) -> None:
    """Send the functions of a module to the workers with the job, so that executors need
    numpy and pandas but not this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, as in tests, a folder under the warehouse takes its
    place: the warehouse is shared wherever tables are.  A warehouse in the file system of
    one machine is not, so on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        one_machine = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        if not one_machine and re.match(r"file:|/", warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; "
                             f"{warehouse} belongs to one machine")
        configured = f"{warehouse}/_stages"
    return configured.rstrip("/")


def new_folder(spark: SparkSession, kind: str = "stage") -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative operators restart from it when executors die."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write a table that several passes will read, and return a scan of it.

    The passes then read only their columns instead of repeating the work above, and a
    lost executor costs a re-read.  The folder is left to the caller's clean-up policy.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)
