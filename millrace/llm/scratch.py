"""Tables written once and read back, in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and
driver and executors are one process (local tests) is one made under the driver's
temporary folder and put into the session, so that every later call finds the same
one; on a cluster an unset folder raises.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []
_owners: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a slash at its end."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} is not set: it has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    for owned in _owners:
        owned.append(path)
    return path


@contextmanager
def only(spark: SparkSession, *names: str) -> Iterator[None]:
    """Deletes, at the end, the tables made inside but those of ``names``, which are still read."""
    with owned() as paths:
        yield
    for path in paths:
        if path.rpartition("/")[2].rpartition("-")[0] not in names:
            drop(spark, path)


@contextmanager
def owned() -> Iterator[list[str]]:
    """Collects the paths made inside, for a caller that knows when they are done with."""
    paths: list[str] = []
    _owners.append(paths)
    try:
        yield paths
    finally:
        _owners[:] = [p for p in _owners if p is not paths]


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it as read from there.

    That cuts the lineage: a lost executor costs a rerun of the tasks that read
    the files, not of what made them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made[:] = [m for m in _made if m[1] != path]


def _clean() -> None:
    for spark, path in list(_made):
        if spark.sparkContext._jsc is not None:
            drop(spark, path)


atexit.register(_clean)
