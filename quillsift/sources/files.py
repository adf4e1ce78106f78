"""Small files and folders on any file system that Spark can reach, and the shared work folder."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


class Files:
    """The Hadoop file system behind a path, for what the driver itself reads and writes."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm = spark, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())

    def read_json(self, path: str) -> Any:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isFile())

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        return self._fs.getContentSummary(self._path(path)).getLength()

    def age(self, path: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def write_new_json(self, path: str, value: Any) -> None:
        """Write a file that must not exist: whole under another name, then renamed, so it appears at once.

        Of two writers one gets FileExistsError, on file systems whose rename is atomic and
        fails where the target exists (HDFS, local disks, hierarchical stores).  A plain
        object store doesn't promise that: there one process must do all writes of a table.
        """
        part = f"{path}.{uuid.uuid4().hex}.part"
        stream = self._fs.create(self._path(part), True)
        try:
            stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1).encode()))
        finally:
            stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._path(part), self._path(path), options)
        except Exception as e:
            self.delete(part)
            if self.exists(path):
                raise FileExistsError(f"{path} exists") from e
            raise


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillsift-work-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Delete what ``written`` holds of these, once nothing reads it any more."""
    for df in frames:
        Files(df.sparkSession, df._written).delete(df._written)
