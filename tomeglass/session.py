"""Session settings and the shared folder for tables that have to outlive one plan."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "tomeglass", memory: str = "16g") -> SparkSession:
    """A session for tests and the benchmark. On a cluster the submitted session is used as it is."""
    partitions = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application; functions that run in Python tasks are imported there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="tomeglass-"), "tomeglass")
        root, name = os.path.split(package)
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", root, name))
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only on a local master: on a cluster a
    machine-local folder would be lost with the machine, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    named = named or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tomeglass-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tomeglass/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, and the catalogue's entries of indexes among them.

    For the end of a job, or for when no DataFrame that was made before is read again. Indexes and models that were written
    to a path of the caller's stay.
    """
    own = _own_dir(spark)
    for table in spark.catalog.listTables():
        if table.name.startswith("postings_") and not table.isTemporary:
            rows = spark.sql(f"DESCRIBE FORMATTED {table.name}").where("col_name = 'Location'").collect()
            if rows and f"/{own.split(':', 1)[-1].strip('/')}/" in rows[0]["data_type"]:
                spark.sql(f"DROP TABLE {table.name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table below the shared folder, so that several readers do not recompute it."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that nothing reads any more, and let Spark drop the shuffles of plans that are gone."""
    jvm, files = df.sparkSession.sparkContext._jvm, df.inputFiles()
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash rows by ``key`` if they are read in fewer tasks than there are cores, as from one small file.

    For costly work on each row. A large table is read in many more tasks and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
