"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "channelgraph") -> SparkSession:
    """A session for tests and the bench. On a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, or a local one where it names none."""
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    # the setting cannot change in a running session, so a local folder is remembered here
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-channelgraph-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never reused."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps use to the shared folder, and go on from there.

    The plan starts anew, the work is done once, and it survives the loss of executors. Python functions in the plan find
    this package on every executor.
    """
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete the files of a settled result whose readers have all been written."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def plain_unions(spark: SparkSession) -> None:
    """Unions do not claim to be partitioned as their parts are.

    Spark 4.1 plans joins upon that claim; where adaptive execution then reads the parts otherwise, as it does in a merge over a
    merge, the union has more partitions than the other side and the join fails.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package: Python functions in tasks import it by name.

    A zip of the package folder is added to the application once. It does nothing where the package is not a plain
    folder (an installed or zipped copy, which reached the executors some other way).
    """
    app = spark.sparkContext.applicationId
    folder = os.path.dirname(os.path.abspath(__file__))
    if app in _shipped or not os.path.isdir(folder):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "channelgraph.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for top, folders, names in os.walk(folder):
            folders[:] = [f for f in folders if f != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(top, name)
                    packed.write(file, os.path.relpath(file, os.path.dirname(folder)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
