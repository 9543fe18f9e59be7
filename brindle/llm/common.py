"""What the operators of this folder share: tables, materialising, text buffers and hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space and code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"

_ROOT = str(Path(__file__).resolve().parents[2])
_written: list[tuple[weakref.ref, str]] = []


#: Bytes after which a batch of rows for a Python worker ends, and the setting that says so; Spark's own limit is 10,000 rows of any length.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 7_500_000


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where only the driver's path has it, and get rows in batches of limited bytes, unless the session has a limit."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, env.get("PYTHONPATH")) if p)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one of this machine where it is unset."""
    sc = spark.sparkContext
    if conf := spark.conf.get("spark.checkpoint.dir", None):
        return conf
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/brindle/{name}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of materialized tables that nothing still to be run reads."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            remove(t.sparkSession, path)


def traced(make) -> tuple[DataFrame, list[str]]:
    """What ``make()`` returns, and the paths that it wrote in the shared folder."""
    n = len(_written)
    out = make()
    return out, [path for _, path in _written[n:]]


def roots_of(df: DataFrame) -> list[str]:
    """The paths that the files ``df`` reads were listed from."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        try:
            paths = leaves.apply(i).relation().location().rootPaths()
        except Exception:  # noqa: BLE001 - rows that come from no files
            continue
        out += [paths.apply(k).toString() for k in range(paths.size())]
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for ref, path in _written:
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


#: Bytes of 64-bit row keys up to which drop_rows() broadcasts them.
BROADCAST_KEYS = 32 << 20


def drop_rows(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``df`` without the rows whose xxhash64 of ``columns`` is in the one column of ``keys``.

    A counted, small set of keys is broadcast, so that texts stay where they
    are; a larger one meets the rows in a shuffle.
    """
    keys = materialize(keys.toDF("__key").distinct(), "row-keys")
    small = keys.count() * 8 <= BROADCAST_KEYS
    return df.withColumn("__key", F.xxhash64(*columns)).join(F.broadcast(keys) if small else keys.hint("merge"), "__key", "left_anti").drop("__key")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of what ``df`` reads."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Catalyst's estimate where it knows nothing is the largest long; so are products of such.
UNKNOWN = 1 << 60


def shuffle_partitions(df: DataFrame, factor: float, target: int = 48 << 20) -> int:
    """Partitions so that ``factor`` times the input, split among them, is about ``target`` bytes each."""
    spark = df.sparkSession
    size = input_bytes(df)
    need = int(size * factor / target) + 1 if size < UNKNOWN else 1
    return max(need, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, 4)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def crc_mod(column: str, mod: int):
    """crc32 of the id as decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def words_of(column):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")


# Vectorised text helpers --------------------------------------------------

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x2545F4914F6CDD1D)  # odd, 5 modulo 8: its powers repeat late
_UNSTEP = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Powers that a worker keeps from one task to the next, two tables of so many.
KEPT_POWERS = 2 << 20


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, r in enumerate((_STEP, _UNSTEP)):
            p = np.full(n + n // 4, r, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end]; values are bytes, or uint64 symbols already mixed."""
    n, most = len(values), 1 << 18
    step, unstep = (p[:most] for p in _power(min(n + 1, most)))
    far = [_power(2)[k][1:2] * p[-1:] for k, p in enumerate((step, unstep))]  # powers of ``most``, if there are so many places
    sums, base, bases = np.zeros(n + 1, np.uint64), np.ones(1, np.uint64), []
    for i in range(0, n + 1, most):  # eight bytes for each byte of text, but once
        v = values[i : i + most]
        v = (_BYTE[v] if v.dtype == np.uint8 else v) * step[: len(v)] * base
        v[:1] += sums[i : i + 1]
        np.cumsum(v, out=sums[i + 1 : i + 1 + len(v)])
        base = base * far[0]
        bases.append(bases[-1] * far[1] if bases else np.ones(1, np.uint64))
    h = (sums[ends] - sums[starts]) * unstep[starts % most] * np.concatenate(bases)[starts // most]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def byte_class(excluded: bytes) -> np.ndarray:
    """Table over bytes: True for those of a word, given the bytes that end one."""
    t = np.ones(256, bool)
    t[list(excluded)] = False
    return t


#: Words [^\x20\x09-\x0D]+.
WORD = byte_class(SPACES.encode())


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words of every text; text d has words first[d]:first[d+1]. No word crosses texts."""
    n = len(data)
    inside = word[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(inside[1:], inside[:-1], out=change[1:n]) if n else None
    change[offsets] = True
    edges = np.flatnonzero(change)
    full = inside[edges[:-1]] if n else np.zeros(0, bool)
    starts, ends = edges[:-1][full], edges[1:][full]
    return starts, ends, np.searchsorted(starts, offsets)


def chunks(column: pa.Array, most: int = 1 << 20):
    """(first row, data, offsets) of consecutive rows with about ``most`` bytes of text; a longer text is a chunk of its own."""
    data, offsets = utf8(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start, start + 1, ... for each length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(total)


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d+1]] for each row d."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def give_back() -> None:
    """Give memory that is free, of Arrow's pool and of the heap, back to the system; long tables of powers go too."""
    import ctypes

    if len(_powers[0]) > KEPT_POWERS:
        _powers[:] = [p[:1].copy() for p in _powers]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trim() -> None:
    """Give memory that this worker no longer needs back to the system; workers live on between tasks."""
    import gc

    gc.collect()
    give_back()


def tidy(run):
    """``run``, for mapInArrow, whose worker gives memory back when a task ends: it waits beside whatever its executor does next."""

    @wraps(run)
    def task(batches):
        yield from run(batches)
        give_back()

    return task


class Sorted:
    """A map from uint64 keys to small integers, as two sorted arrays: a sixth of a dict's memory."""

    def __init__(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Take in keys that are sorted and not yet known."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)


# Packed shuffles: one row per bucket and batch instead of one per entry ------


def scatter(bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (bucket, one binary column for each array): the arrays' entries, dealt by bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    bounds = np.append(heads, len(b)).astype(np.int64)
    cols = [pa.array(b[heads].astype(np.int32))]
    for v in arrays.values():
        data = np.ascontiguousarray(v[order])
        size = data.dtype.itemsize
        cols.append(pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer((bounds * size).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]))
    return pa.RecordBatch.from_arrays(cols, ["bucket", *arrays])


def scattered(names: list[str]) -> str:
    return "bucket int, " + ", ".join(f"{n} binary" for n in names)


def gather(batches, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """All entries that reached this partition, as one array for each column."""
    parts: dict[str, list[np.ndarray]] = {n: [] for n in kinds}
    for batch in batches:
        for n, kind in kinds.items():
            parts[n].append(np.frombuffer(utf8(batch.column(n))[0].tobytes(), kind))
    return {n: np.concatenate(p) if p else np.zeros(0, kinds[n]) for n, p in parts.items()}
