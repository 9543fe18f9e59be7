"""Where kept results live: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of this machine where it is unset (as in tests)."""
    if conf := spark.conf.get("spark.checkpoint.dir", None):
        return conf.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
    return sc.getCheckpointDir().rstrip("/")


class Stored:
    """A DataFrame written to the shared folder; reading it needs no lineage, drop() deletes the files."""

    def __init__(self, df: DataFrame, name: str = "state") -> None:
        self.spark, self.name = df.sparkSession, name
        self.path = f"{shared_dir(self.spark)}/brindle/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.schema = df.schema
        self._rows: int | None = None
        self._bytes: int | None = None

    @property
    def bytes(self) -> int:
        """Of the files, once."""
        if self._bytes is None:
            path, fs = self._at()
            self._bytes = fs.getContentSummary(path).getLength()
        return self._bytes

    @property
    def rows(self) -> int:
        """Counted from the files' footers, once."""
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _at(self) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self) -> None:
        path, fs = self._at()
        fs.delete(path, True)


def store_all(frames: dict, name) -> dict:
    """Stored forms of several DataFrames, written side by side; ``name(key)`` names each."""
    if len(frames) < 2:
        return {k: Stored(df, name(k)) for k, df in frames.items()}
    with ThreadPoolExecutor(min(8, len(frames))) as pool:
        return dict(zip(frames, pool.map(lambda k: Stored(frames[k], name(k)), frames)))


class Parts:
    """A state that grows: files are only ever added; beyond ``most`` of them they are written into one again."""

    def __init__(self, first: Stored, name: str = "state", most: int = 8) -> None:
        self.name, self.most = name, most
        self.parts = [first]

    @property
    def df(self) -> DataFrame:
        out = self.parts[0].df
        for p in self.parts[1:]:
            out = out.unionByName(p.df)
        return out

    @property
    def bytes(self) -> int:
        return sum(p.bytes for p in self.parts)

    def append(self, part: Stored, merge=None) -> list[Stored]:
        """Add a part; the parts that are no longer read come back (``merge`` shrinks the rows when they are written again)."""
        self.parts.append(part)
        if len(self.parts) <= self.most:
            return []
        old, rows = self.parts, self.df
        self.parts = [Stored(merge(rows) if merge else rows, self.name)]
        return old

    def drop(self) -> None:
        for p in self.parts:
            p.drop()
