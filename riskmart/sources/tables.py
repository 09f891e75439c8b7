"""Whole-table writes, and tables written once and read back."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Beside a finished layer: its build id, and the digest of what it was built from. Readers skip names with an underscore.
BUILD_MARK = "_build.json"


@lru_cache(maxsize=None)
def _local_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"riskmart-{application_id}-")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application, visible to every executor.

    It lies under the session's ``spark.checkpoint.dir``. Where none is set, a local master uses a temporary folder of the
    driver; any other is an error, since executors of other machines would not see it.
    """
    context = spark.sparkContext
    application = context.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return f"{configured.rstrip('/')}/riskmart/{application}"
    if not is_local(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir(application)


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its ``_SUCCESS`` mark, on any Hadoop file system."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    found, system = _path(spark, path)
    system.delete(found, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder the name of one that is gone."""
    found, system = _path(spark, path)
    if not system.rename(found, _path(spark, to)[0]):
        raise OSError(f"{path} could not be renamed to {to}")


def make_dir(spark: SparkSession, path: str) -> None:
    found, system = _path(spark, path)
    system.mkdirs(found)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and modification time of the files that ``path`` (a file, folder or pattern) stands for."""
    pattern, system = _path(spark, path)
    found = []
    for status in system.globStatus(pattern) or ():
        entries = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(e.getPath().toString(), e.getLen(), e.getModificationTime()) for e in entries]
    return sorted(found)


def digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, None if there is none."""
    place, system = _path(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file under another name first, so that readers never see half of it."""
    place, system = _path(spark, path)
    fresh, _ = _path(spark, f"{path}.{uuid4().hex}")
    stream = system.create(fresh, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    system.delete(place, False)
    system.rename(fresh, place)


def read_mark(spark: SparkSession, path: str) -> dict:
    """Build id and key of the layer at ``path``; empty if it has none or is unfinished."""
    text = read_text(spark, f"{path}/{BUILD_MARK}")
    return {} if text is None else json.loads(text)


def write_mark(spark: SparkSession, path: str, key: str) -> str:
    """Mark the layer at ``path`` as finished under a new build id."""
    build = uuid4().hex
    write_text(spark, f"{path}/{BUILD_MARK}", json.dumps({"build": build, "key": key}))
    return build


def build_id(spark: SparkSession, path: str) -> str | None:
    return read_mark(spark, path).get("build")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def is_current(spark: SparkSession, path: str, key: str | None) -> bool:
    """Whether a finished table is there and, with a ``key``, was built under the same one."""
    if not is_complete(spark, path):
        return False
    return key is None or read_mark(spark, path).get("key") == key


def materialize(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    path: str,
    refresh: bool = False,
    key: str | None = None,
) -> DataFrame:
    """Build and write a table unless a finished one is there, then read it back.

    ``key`` digests everything the table depends on, upstream build ids included; a table built under another key is
    built again. Readers get the stored rows and a plan without the lineage, so nothing downstream
    computes them a second time and a lost executor costs only a re-read.
    """
    if refresh or not is_current(spark, path, key):
        write_table(build(), path)
        if key is not None:
            write_mark(spark, path, key)
    return spark.read.parquet(path)
