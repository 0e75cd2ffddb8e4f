"""Where jobs put tables of their own: below spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        key = spark.sparkContext.applicationId
        if key not in _local:
            _local[key] = tempfile.mkdtemp(prefix="rillmark-")
            atexit.register(shutil.rmtree, _local[key], ignore_errors=True)
        base = "file://" + _local[key]
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/rillmark-{what}-{uuid.uuid4().hex}"


class Files:
    """The few file operations that ledgers and sinks need, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> bytes | None:
        """A small file's bytes; None if there is none."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> bool:
        """Writes a new file; False if it is there already. Exclusive: of two writers one wins."""
        fs, p = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception as e:  # py4j gives the file system's own exception as a cause
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(data))
            out.hflush()
        finally:
            out.close()
        return True

    def create_whole(self, path: str, data: bytes) -> bool:
        """As create(), but readers never see a part of it: it is written beside its place and renamed, which fails if
        the place is taken."""
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        self.create(beside, data)
        try:
            self._rename(beside, path, "NONE")
        except Exception as e:
            self.delete(beside)
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def replace(self, path: str, data: bytes) -> None:
        """Writes beside path and renames over it: readers see the old bytes or the new ones."""
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        self.create(beside, data)
        self.rename_over(beside, path)

    def rename_over(self, source: str, target: str) -> None:
        self._rename(source, target, "OVERWRITE")

    def _rename(self, source: str, target: str, how: str) -> None:
        path = self.jvm.org.apache.hadoop.fs.Path
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), self.conf)
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, how)
        context.rename(path(source), path(target), options)

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        """The names in a folder; none if there is no such folder."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p))
