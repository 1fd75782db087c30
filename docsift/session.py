"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes, splits
# skewed shuffle partitions and coalesces tiny ones; the broadcast threshold is
# the size check behind every join that may become a broadcast.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "docsift", shuffle_partitions: int = 8,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only where it is unset (local runs, tests) a folder is chosen here.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if fallback is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = fallback or tempfile.mkdtemp(prefix="docsift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that functions of its modules can run
    in Python workers wherever they start. Done once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docsift-ship-")) / "docsift_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


_mine = threading.local()


def _scratch() -> list[str]:
    """The intermediate folders that this thread has made."""
    if not hasattr(_mine, "paths"):
        _mine.paths = []
    return _mine.paths


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint root for written intermediate tables."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "tables", f"{name}-{os.getpid()}-{next(_counter)}")
    _scratch().append(path)
    return path


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the intermediate tables that this thread writes inside, at the end:
    for work whose results are written elsewhere before it ends."""
    first = len(_scratch())
    try:
        yield
    finally:
        remove_folders(spark, _scratch()[first:])
        del _scratch()[first:]


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


def write_table(df, name: str):
    """Write ``df`` once to a fresh Parquet table under the checkpoint root and
    return a reader of it. Cuts lineage like a reliable checkpoint, in one
    pass, and survives executor loss (the folder is shared storage)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
