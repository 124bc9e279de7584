"""Session helpers: one place that builds a local session for tests and benches, and cuts lineage on shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC time and Arrow on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        made = spark.sparkContext.getCheckpointDir()
    return made


def spread(df: DataFrame, each: int = 4) -> DataFrame:
    """df dealt evenly to so many tasks a core: a small file is read by few tasks, however much work its rows are."""
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism)


_written: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later stages survive lost executors without recomputing it.

    The table stays until sweep(), as results that are still to be computed may read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables materialise() has written and sweep() hasn't removed."""
    return len(_written)


def sweep(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Remove the tables that materialise() has written in this process, once their results are stored; how many there were.

    first, last: only those from the place first (as written() gave it) up to last, exclusive.
    """
    gone = _written[first:last]
    del _written[first:last]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)
