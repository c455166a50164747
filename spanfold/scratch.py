"""Where a run keeps tables that it needs only for itself."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of the cluster sees")
    if Scratch._own is None:
        Scratch._own = tempfile.mkdtemp(prefix="spanfold-")
        atexit.register(shutil.rmtree, Scratch._own, ignore_errors=True)
    return f"file://{Scratch._own}"


class Scratch:
    """Tables of one run in the folder that the cluster shares, gone when the session's process ends.

    A table written here has no lineage: a lost executor costs no earlier stage.
    """

    _own: str | None = None

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}_{name}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a table that nothing reads any more."""
        for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if self.base.split(":", 1)[-1].lstrip("/") in at:
                self._delete(at)

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
