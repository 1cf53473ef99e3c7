"""Settings of the running session that operators depend on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


_TEMPORARY: dict[str, str] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` below `directory`, read lazily."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is plain ``local`` is a temporary folder made, one for the application, which
    goes with the process; a cluster without a shared folder is refused, as its executors could not read each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _TEMPORARY:
            _TEMPORARY[name] = tempfile.mkdtemp(prefix="quiver-")
            atexit.register(shutil.rmtree, _TEMPORARY[name], ignore_errors=True)
        folder = _TEMPORARY[name]
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` through a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """Number of partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpointed_in_loop(df: DataFrame) -> DataFrame:
    """`checkpointed` for the tables of an iteration.

    A checkpoint keeps the size that the optimiser guessed for its plan. Guesses of joins are products, so from round to
    round they get more digits, until planning takes longer than the work. Here the files are scanned afresh, as a table
    of unknown size.
    """
    spark, kept = df.sparkSession, checkpointed(df)
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
