"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: What is left to clean up at the driver's end, by the key it is released under.
_left: dict[object, Callable[[], None]] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_thread = threading.local()


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is installed beside the driver's copy.

    On a cluster without a shared install, ship the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master (tests, one machine) gets a folder of our own. On a cluster that would
    be a different disk on each machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"file://{_own_dir()}"


@cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="vicinal-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _scopes() -> list[list[object]]:
    if not hasattr(_thread, "scopes"):
        _thread.scopes = []
    return _thread.scopes


def _hold(key: object, close: Callable[[], None], outlive: bool) -> None:
    _left[key] = close
    scopes = _scopes()[:-1] if outlive else _scopes()
    if scopes:
        scopes[-1].append(key)


def _close(key: object) -> None:
    close = _left.pop(key, None)
    if close:
        close()


@contextmanager
def scratch() -> Iterator[None]:
    """Everything materialised or broadcast within goes at the end, but for what is to outlive it.

    Frames that read such files must have been run by then. Without a scope, files last until `release`
    or the driver's end: a lazy result needs them until its caller has run it.
    """
    _scopes().append([])
    try:
        yield
    finally:
        for key in _scopes().pop():
            _close(key)


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    if jvm is None:
        return
    sc = SparkContext._active_spark_context
    conf = sc._jsc.hadoopConfiguration() if sc and sc._jsc else jvm.org.apache.hadoop.conf.Configuration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clean_up() -> None:
    for key in [k for k in _left if isinstance(k, str)]:
        try:
            _close(key)
        except Exception:  # noqa: BLE001  the JVM may be gone, and the folder with it
            return


def scratch_path(spark: SparkSession, label: str, outlive: bool = False) -> str:
    """A new path in the shared folder; what is written there goes with the scope around."""
    path = f"{shared_dir(spark)}/vicinal/{label}-{uuid.uuid4().hex}"
    _hold(path, lambda: _delete(path), outlive)
    return path


def materialise(df: DataFrame, label: str = "step", outlive: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder (in folders by some columns) and read it back.

    Unlike a cached block the files outlive the executor that wrote them. They go with the scope around
    (`scratch`), or with the next outer one if they are to outlive it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label, outlive)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if by else out
    _paths[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames that `materialise` returned; never read them afterwards."""
    for df in frames:
        _close(_paths[df])


def share(spark: SparkSession, value: object, outlive: bool = False) -> Broadcast:
    """A broadcast variable that is destroyed with the scope around. What is shipped must have a known bound."""
    sent = spark.sparkContext.broadcast(value)
    _hold(id(sent), sent.destroy, outlive)
    return sent


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that df reads: file sizes where it is a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
