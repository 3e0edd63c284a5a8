"""Keyed tables in files: rows are dealt to folders by the hash of their key, and a manifest says which folder of each part counts.

A change writes new folders for the parts it touches, and then a manifest of the next number, in one rename. Until that is there, readers see the table as
it was; whatever a crashed change has left is never read.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share; only in local mode a temporary one stands in for an unset setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="lexiquarry-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        named = f"file://{_LOCAL[0]}"
    return f"{named.rstrip('/')}/lexiquarry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class StoredTable:
    """A table at ``path``, keyed by ``keys``, in ``parts`` parts."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], parts: int = 16) -> None:
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), list(keys), parts
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """Number of the last manifest; 0 without any."""
        folder = self._hadoop(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit()), default=0)

    def manifest(self) -> dict[int, str]:
        """Folder of each part that has rows."""
        if not (number := self.version()):
            return {}
        stream = self._fs.open(self._hadoop(f"{self.path}/_manifests/{number}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def _switch(self, folders: dict[int, str], number: int) -> None:
        name, target = self._hadoop(f"{self.path}/_manifests/.{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/_manifests/{number}.json")
        out = self._fs.create(name, False)
        try:
            out.write(bytearray(json.dumps(folders).encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(name, target):
            self._fs.delete(name, False)
            raise RuntimeError(f"another writer has made version {number} of {self.path}")

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _write(self, df: DataFrame) -> dict[int, str]:
        """Folders of the parts of ``df``, written by one job."""
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn("_part", self.part()).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(f"{self.path}/{folder}"))]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("_part=")}

    def replace(self, df: DataFrame) -> None:
        """Make ``df`` the whole table."""
        self._switch(self._write(df), self.version() + 1)

    def read(self, parts: Sequence[int] | None = None, schema=None) -> DataFrame:
        """The table, or some parts of it; an empty frame of ``schema`` where it has none of them."""
        folders = [f"{self.path}/{v}" for k, v in self.manifest().items() if parts is None or k in parts]
        return self.spark.read.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def change(self, rows: DataFrame, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """fn(current rows, ``rows``), as of ``operators.merge``, for the parts that the keys of ``rows`` belong to; all others stay as they are. Number of parts rewritten.

        The driver gets the numbers of the touched parts, ``parts`` at most.
        """
        number, folders = self.version(), self.manifest()
        touched = sorted(r[0] for r in rows.select(self.part()).distinct().collect())
        if not touched:
            return 0
        new = self._write(fn(self.read(touched, rows.schema), rows))
        self._switch({k: v for k, v in folders.items() if k not in touched} | new, number + 1)
        return len(touched)
