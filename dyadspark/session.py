"""Session settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "dyadspark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings above; anything in ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fan_out(spark: SparkSession) -> int:
    """Partition count for steps whose output is far larger than their input.

    AQE sizes shuffles by input bytes. A pair join reads kilobytes and writes
    millions of rows, so its partition number is stated instead of left to AQE.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(configured, spark.sparkContext.defaultParallelism)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python tasks in Arrow batches of about 8 MB from here on, for the whole session.

    Spark's own bound is 64 MB (or 10,000 rows). JVM and Python hold a batch for each task outside the heap, the JVM in
    buffers that grow by doubling. Rows and results stay the same, a longer text is a batch of its own. A bound the user has set stays.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8m")


def run_folder(spark: SparkSession) -> str:
    """The session's own folder for intermediates, in ``spark.checkpoint.dir``; it is deleted when the session's JVM ends.

    A session whose executors are other machines or processes has to name a folder they share. Only a session
    inside one process (``local[...]``) may do without and then uses the temporary folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    folder = f"{base}/dyadspark-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A fresh path where a job may write a table it reads back."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


_WRITTEN = "_dyadspark_table"


def materialise(df: DataFrame) -> DataFrame:
    """Write a step's result to the shared folder and go on from the written table.

    Used where a result is read several times or a loop would grow its plan. The
    table outlives lost executors, and Spark knows its size and columns. The session's shuffle files are
    removed as soon as the execution that made them ends, so a job of many steps holds those of one.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    if spark.conf.get(REMOVE_SHUFFLES, "false") != "true":
        spark.conf.set(REMOVE_SHUFFLES, "true")  # from the first written step on, for the whole session
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    setattr(table, _WRITTEN, path)
    return table


def reads(derived: DataFrame, table: DataFrame) -> DataFrame:
    """``derived``, marked so that ``release`` deletes ``table``, the one table it reads."""
    setattr(derived, _WRITTEN, getattr(table, _WRITTEN, None))
    return derived


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more: call it when their successors are written.

    Other DataFrames are ignored, also those derived from such a table.
    """
    for table in tables:
        path = getattr(table, _WRITTEN, None)
        if path is not None:
            sc = table.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
            setattr(table, _WRITTEN, None)
