"""Session settings, shipping of the package to the workers, and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def builder(app: str = "corpusloom") -> SparkSession.Builder:
    """Settings every plan here relies on; sizes and masters are left to the caller."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(here):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("corpusloom", os.path.relpath(full, here)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def spread_small(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has far fewer partitions than there are, as one small file has; else df itself.

    For operators that spend much time on a row: moving a small input once costs less than one busy core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local session that names none gets one of its own; on a cluster, whose machines don't share their
    temporary folders, that is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-" + uuid.uuid4().hex))
    return sc.getCheckpointDir()


_WRITTEN: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them from there: the lineage ends here.

    ``forget`` deletes the tables once their readers are done.
    """
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete all tables that ``materialise`` has written; results that still read them must be stored before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
