"""Session helpers: building a local session for tests/bench, and cutting lineage.

Library code never creates its own session; every function takes the caller's
DataFrames (and the session they belong to).  Lineage is cut with reliable
``checkpoint()`` into the folder the cluster names in ``spark.checkpoint.dir``;
only local sessions (tests, bench) set that folder themselves, when it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "glyphmill") -> SparkSession:
    """A ``local[N]`` session for tests and the bench (UI off, AQE on, Arrow on)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLYPHMILL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster configured, if any."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured checkpoint folder; set a scratch one only in a local session without one.

    On a cluster ``spark.checkpoint.dir`` must name shared storage; there is no
    machine-local fallback.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        wanted = tempfile.mkdtemp(prefix="glyphmill-ckpt-")
    spark.sparkContext.setCheckpointDir(wanted)
    return wanted


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder and return the short-lineage copy.

    Used between rounds of iterative jobs (vocabulary training, gradient rounds) so
    that plans do not grow with the round number and a lost executor only
    recomputes the current round.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # Persist first: a reliable checkpoint otherwise computes the plan twice
    # (once for the eager action, once more to write the checkpoint files).
    staged = df.persist()
    try:
        return staged.checkpoint(eager=True)
    finally:
        staged.unpersist()


#: Row groups of scratch tables: a writer or reader holds one, texts and all.
ROW_GROUP_BYTES = 32 << 20


def save_scratch(df: DataFrame, name: str, folder_by: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and read it back.

    ``folder_by`` names a column whose every value gets a folder of its own (``scratch_root``).

    Like ``cut_lineage``, but the table can be dropped by ``drop_scratch`` as soon as
    no later step reads it, so loops leave nothing behind.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/glyphmill-{uuid.uuid4().hex}/{name}"
    writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES)
    (writer.partitionBy(folder_by) if folder_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_root(df: DataFrame) -> str | None:
    """The folder of a table made by ``save_scratch``; None when it has no file."""
    for file in df.inputFiles():
        parts = file.split("/")
        at = [i for i, part in enumerate(parts) if part.startswith("glyphmill-")]
        if at:
            return "/".join(parts[:at[-1] + 2])
    return None


def drop_scratch(df: DataFrame) -> None:
    """Delete a table made by ``save_scratch`` (its whole folder), through Spark's file systems."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = scratch_root(df)
    if root is not None:
        path = jvm.org.apache.hadoop.fs.Path(root.rpartition("/")[0])
        path.getFileSystem(conf).delete(path, True)


def save_bucketed(df: DataFrame, keys: list[str], buckets: int) -> tuple[DataFrame, str]:
    """Like ``save_scratch``, in ``buckets`` hash buckets of ``keys``: tables of equal keys and buckets join without a shuffle.

    Returns the table and its name, by which ``drop_bucketed`` removes it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"glyphmill_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/glyphmill-{uuid.uuid4().hex}/{name}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name), name


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Forget a table made by ``save_bucketed`` and delete its folder."""
    table = spark.table(name)
    drop_scratch(table)
    spark.sql(f"DROP TABLE {name}")


#: Bytes of an Arrow batch.  Spark's bound of 10,000 rows holds any number of bytes, and both the JVM
#: and the Python worker hold a batch several times (as it grows, in, out).
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session end at BATCH_BYTES (one longer row is a batch), unless it has a bound of its own.

    The bound is read when a job runs, so it stays set for the frames that a stage returns.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


_PKG_PARENT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_worker_import(spark: SparkSession) -> None:
    """Let Python workers import this package (needed by the Arrow jobs), one BLAS thread per task cpu.

    Adds the package's parent folder to the PYTHONPATH handed to Python workers.
    On a cluster the package is normally shipped with ``--py-files``; this only
    covers sessions started without it (local runs, tests).
    """
    env = spark.sparkContext.environment
    current = env.get("PYTHONPATH", "")
    parts = [p for p in current.split(os.pathsep) if p]
    if _PKG_PARENT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_PKG_PARENT] + parts)
    # One task per core: NumPy's BLAS inside a task gets the task's cores
    # (spark.task.cpus), not every core of the machine, unless the user chose.
    task_cpus = spark.conf.get("spark.task.cpus", "1") or "1"
    for var in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        if var not in env and var not in os.environ:
            env[var] = task_cpus
