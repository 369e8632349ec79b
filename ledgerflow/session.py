"""Session settings and the shared folder for tables the jobs write.

Written intermediate tables (month-partitioned layouts, replica copies,
sync logs, streaming checkpoints) live under the folder the cluster names
in ``spark.checkpoint.dir``. That folder is shared by all executors. A local
session without the setting (tests) uses a folder beside its warehouse.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Settings the operators are designed around. AQE re-plans joins at run time
# (broadcast only when the measured side is under the threshold, otherwise
# sort-merge), splits skewed join partitions and coalesces small shuffle
# partitions to the advisory size, so no operator pins a join strategy.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "ledgerflow",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with ``DEFAULT_CONF`` applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir``.

    Only a local session without one gets a folder beside its warehouse,
    registered as its checkpoint folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    try:
        current = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - no driver context (Spark Connect)
        current, local_context = None, False
    else:
        local_context = True
    if current:
        return current.rstrip("/")
    master = spark.conf.get("spark.master", "") or ""
    if not (local_context and master.startswith("local")) or master.startswith("local-cluster"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder all executors share "
            "(e.g. on HDFS or an object store) for the tables these jobs write"
        )
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused location under the shared folder."""
    return f"{shared_dir(spark)}/ledgerflow/{name}-{uuid.uuid4().hex[:12]}"


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new location under the shared folder that is deleted when the driver ends."""
    path = fresh_path(spark, name)
    try:
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    except Exception:  # noqa: BLE001 - no driver JVM (Spark Connect): the folder is left to the cluster
        pass
    return path


def stable_path(spark: SparkSession, name: str, *parts: str) -> str:
    """A location under the shared folder keyed by ``parts`` (e.g. the target of a stream that resumes there)."""
    digest = hashlib.sha1("\x00".join(parts).encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/ledgerflow/{name}-{digest}"


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration, or None without a driver JVM (Spark Connect)."""
    try:
        context = spark.sparkContext
        hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()), hadoop_path
    except Exception:  # noqa: BLE001 - no driver JVM
        return None


def names_in(spark: SparkSession, path: str) -> list[str] | None:
    """Names of the files and folders in a folder (none if it is absent); None without a driver JVM."""
    found = _file_system(spark, path)
    if found is None:
        return None
    system, hadoop_path = found
    return [f.getPath().getName() for f in system.listStatus(hadoop_path)] if system.exists(hadoop_path) else []


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; False if it was not there, or there is no driver JVM to do it."""
    found = _file_system(spark, path)
    return bool(found and found[0].delete(found[1], True))


@contextlib.contextmanager
def session_settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings (dots written as double underscores) for the jobs started inside."""
    wanted = {name.replace("__", "."): value for name, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on its file system (local, HDFS, object store).

    Uses the Hadoop file system of the session when the driver has one
    (classic sessions); otherwise (Spark Connect) lists the path through a
    ``binaryFile`` read, which fails with PATH_NOT_FOUND when it is absent.
    """
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001 - no driver JVM (Spark Connect)
        jvm = None
    if jvm is not None:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return bool(hadoop_path.getFileSystem(conf).exists(hadoop_path))
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise
