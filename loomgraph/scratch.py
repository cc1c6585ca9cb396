"""Paths in the folder that all executors share; they are removed when the session stops."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only where that is unset (tests in local mode) a fresh local folder is taken and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written_paths(sc) -> list[str]:
    """The paths made under this context that are still there; they go when it stops, or else when the driver ends."""
    paths = getattr(sc, "_loom_paths", None)
    if paths is None:
        paths = sc._loom_paths = []
        stop = sc.stop

        def cleaned_stop() -> None:
            _remove(sc, paths)
            stop()

        sc.stop = cleaned_stop
        atexit.register(_remove, sc, paths)
    return paths


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    written_paths(spark.sparkContext).append(path)
    return path


def drop_path(sc, path: str) -> None:
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _remove(sc, paths: list[str]) -> None:
    if getattr(sc, "_jsc", None) is None:
        return
    while paths:
        drop_path(sc, paths.pop())
