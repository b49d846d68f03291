"""Session settings and durable scratch space."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app_name: str = "nightframe", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings every operator assumes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps in the data model are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting (tests, laptops) gets a private folder
    under the system temporary directory; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = os.environ.get("NIGHTFRAME_LOCAL_SCRATCH")
    if not root:
        root = tempfile.mkdtemp(prefix="nightframe-")
        os.environ["NIGHTFRAME_LOCAL_SCRATCH"] = root
    return root


#: The open scopes of this thread (or task); other threads have their own.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch_scopes", default=())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique path below the scratch root."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _SCOPES.get():
        made.append(path)
    return path


@contextlib.contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collect the scratch paths made inside by this thread, for :func:`remove_scratch` once nothing reads them."""
    made: list[str] = []
    before = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(before)


def remove_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored intermediates by way of the file system they lie in; empties ``paths``."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that a path names on every machine, or none if it lies in a store that is not a file system of theirs."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    place = files.makeQualified(found).toUri()
    return place.getPath() if place.getScheme() == "file" else None


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    Used where one expensive intermediate feeds several branches: the copy
    survives the loss of executors, unlike cached blocks.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
