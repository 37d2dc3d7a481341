"""Tables that are replaced or extended as a whole.

Data goes into a folder of its own first; an empty marker file, created in one step, makes it part of the table.  A job
that is killed before leaves a folder that nothing refers to, and readers keep what they had.  Everything goes through
Hadoop's FileSystem, so any store that Spark writes to will do.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_NUMBERED = re.compile(r"(\d{12})-([0-9a-f]{32})")


class Folder:
    """A table's folder, with markers and data folders in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, sub: str) -> list[str]:
        at = self._path(f"{self.path}/{sub}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def mark(self, sub: str, name: str) -> bool:
        """Create an empty file; False if it is there already."""
        return bool(self._fs.createNewFile(self._path(f"{self.path}/{sub}/{name}")))

    def remove(self, sub: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{sub}"), True)


def _versions(folder: Folder) -> list[tuple[int, str]]:
    return [(int(m[1]), m[2]) for m in map(_NUMBERED.fullmatch, folder.names("_versions")) if m]


def publish(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write ``df`` as the next version of the table at ``path`` and return its number.

    The version counts from the moment its marker is there; until then, and if the write fails or is killed, the
    last one stays the table, even if ``df`` itself reads it.  ``keep`` versions stay for readers that have begun;
    older ones are removed.  A folder without a marker is left alone: another job may be writing it.
    """
    if keep < 1:
        raise ValueError("keep at least the version that is published")
    folder = Folder(df.sparkSession, path)
    name = uuid.uuid4().hex
    df.write.parquet(f"{folder.path}/data/{name}")
    number = max((n for n, _ in _versions(folder)), default=0) + 1
    folder.mark("_versions", f"{number:012d}-{name}")
    for old, data in _versions(folder)[:-keep]:
        folder.remove(f"_versions/{old:012d}-{data}")
        folder.remove(f"data/{data}")
    return number


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version of a published table, or an earlier one that is still kept."""
    found = [data for n, data in _versions(Folder(spark, path)) if version in (None, n)]
    if not found:
        raise FileNotFoundError(f"no version {'' if version is None else version} of {path} has been published")
    return spark.read.parquet(f"{path.rstrip('/')}/data/{found[-1]}")


_BATCH = re.compile(r"[A-Za-z0-9._-]{1,100}")


def append_once(df: DataFrame, path: str, batch: str) -> bool:
    """Append ``df`` to the table at ``path`` under the name ``batch``; False, with nothing written, if that name is there.

    A retried batch, a replayed stream or a job started twice thus adds its rows once: the rows are written into a
    folder of the attempt, and the batch's entry in the ledger, which names that folder, is made last.  Of two
    attempts at the same time the first entry in order counts.
    """
    if not _BATCH.fullmatch(batch):
        raise ValueError(f"a batch is named by letters, digits and . _ -: {batch!r}")
    folder = Folder(df.sparkSession, path)
    if batch in _ledger(folder):
        return False
    name = uuid.uuid4().hex
    df.write.parquet(f"{folder.path}/data/{name}")
    folder.mark("_batches", f"{batch}@{name}")
    return _ledger(folder)[batch] == name


def _ledger(folder: Folder) -> dict[str, str]:
    """Folder of every batch; the smallest name of those that one batch has."""
    found: dict[str, str] = {}
    for entry in folder.names("_batches"):
        batch, _, name = entry.partition("@")
        found.setdefault(batch, name)
    return found


def read_appended(spark: SparkSession, path: str, batches: list[str] | None = None) -> DataFrame:
    """All batches of the table at ``path``, or the named ones."""
    ledger = _ledger(Folder(spark, path))
    names = [ledger[b] for b in (sorted(ledger) if batches is None else batches)]
    if not names:
        raise FileNotFoundError(f"nothing has been appended to {path}")
    return spark.read.parquet(*[f"{path.rstrip('/')}/data/{n}" for n in names])
