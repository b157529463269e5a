"""Session helpers.

Library code never creates a session on its own; these helpers are for tests,
``bench.py`` and scripts.  On a cluster the checkpoint directory comes from the
cluster configuration (``spark.checkpoint.dir``); we only set one where it is
unset, as in local tests.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "notedrift",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder
        .master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir``.  Where it is unset, ``fallback`` is
    registered if given; otherwise a fresh scratch folder, but only for a
    session that runs in one process (``local[*]``, as in tests).  On a cluster
    an unset folder is an error: a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or fallback
    if not conf_dir:
        master = sc.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="notedrift-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: Spark's setting that removes the shuffle files of a write once it is done (a lost one would be made again).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Queries that are planned and run inside remove their shuffle files when they end, not with the driver's garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: one job, lineage cut, and the table survives executor loss
    (the cluster's checkpoint folder is shared storage).  The table has the denser
    codec, and the shuffle files of the job go with it, not with the driver's garbage."""
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/notedrift-tables/{name}-{uuid.uuid4().hex}"
    with short_lived_shuffles(spark):  # the query of the write is planned inside
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    table.materialized_path = path
    return table


def dealt(df: DataFrame, key: str, rows: int, each: int = 1 << 14) -> DataFrame:
    """``df`` by hash of ``key`` in parts of about ``each`` of ``rows`` rows, one a core at least: rows of few bytes that take much
    work would else be put together in a few tasks, by their bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), key)


def discard(table: DataFrame) -> None:
    """Delete a table that `materialize` returned, once nothing reads it any more (no DataFrame that is still to run)."""
    path = table.__dict__.pop("materialized_path", None)
    if path and "/notedrift-tables/" in path:
        jvm = table.sparkSession.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
