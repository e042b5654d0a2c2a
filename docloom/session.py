"""Session helpers: code shipping, table access and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(app: str = "docloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings every docloom job assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DOCLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor.

    The package is zipped once per application and handed to Spark's own file server, so
    nothing has to be installed on the nodes and a replaced executor fetches it again.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return spark
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="docloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only if unset.

    Clusters set ``spark.checkpoint.dir``. Without it (tests, ``local[*]``) driver and
    executors are one process and a temporary folder is shared by definition; on a cluster
    that would be a folder of the driver's machine only, so it is refused.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        where = sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="docloom-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for one intermediate table of this application."""
    return f"{shared_folder(spark).rstrip('/')}/docloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; results read from them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/docloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives executor loss."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def setting(spark: SparkSession, name: str, default):
    """A threshold: the session's ``docloom.NAME``, else the environment's ``DOCLOOM_NAME``, else the default."""
    return spark.conf.get(f"docloom.{name}", None) or os.environ.get("DOCLOOM_" + name.upper().replace(".", "_")) or default


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
