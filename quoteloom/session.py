"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Fresh folder for intermediate tables, inside the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where no shared folder exists, falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Intermediate result written once as a table, for several branches to read.

    A written table survives lost executors, and the branches prune its columns and know its size.
    """
    folder = f"{shared_folder(df.sparkSession)}/part"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def local_session(cpus: str = "8", partitions: int = 8, name: str = "quoteloom") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # wide rule projections: methods too long for the JIT are split instead of fused
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
