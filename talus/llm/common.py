"""What the corpus operators share: bounded batches, word boundaries, rolling hashes, shared tables.

A *word* is a maximal run of characters other than space and U+0009 to U+000D; on UTF-8 bytes
that is what ``bytes.split()`` returns, and ``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, for ``translate`` and ``trim``.
WS = " \t\n\x0b\f\r"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INV = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


@lru_cache(1)
def _local_dir() -> str:
    """A folder of this process: driver and executors are one, and the setting cannot be changed once a session runs."""
    return "file://" + tempfile.mkdtemp(prefix="talus-checkpoint-")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have been stopped already
        pass


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    ``release`` deletes it early, or the part with one value of ``by``; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/talus-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talus_path = path
    atexit.register(_delete_at_exit, spark, path)
    return out


def release(df: DataFrame, part: str = "") -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more, or a part such as ``key=value`` of it."""
    _delete(df.sparkSession, f"{df._talus_path}/{part}" if part else df._talus_path)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of phases that are over: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = 10_000) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the size check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has ``most`` bytes of ``column`` or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        first = 0
        while first < len(size):
            base = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = column.buffers()
    offs = np.frombuffer(raw[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offs[0] : offs[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the first word's number of each document (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up, self.down = self._row(1, self.base), self._row(1, self.inverse)

    @staticmethod
    def _row(n: int, base: np.uint64) -> np.ndarray:
        row = np.full(n, base, np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = -(-n // (1 << 18)) * (1 << 18)
            self.up, self.down = self._row(n, self.base), self._row(n, self.inverse)


_POWERS = {}


def powers(which: int = 0) -> Powers:
    if which not in _POWERS:
        _POWERS[which] = Powers((_MULT, _MULT2)[which])
    return _POWERS[which]


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of values[i] * base**i; ``span_hash`` takes differences of them."""
    p = powers(which)
    p.need(len(values) + 1)
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * p.up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end], equal for equal content wherever it stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(which).down[starts] + (ends - starts).astype(np.uint64))


def byte_values(seed: int = 11) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = byte_values()
_BYTES2 = byte_values(12)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a buffer (lower-case it first if case should not count)."""
    return span_hash(prefix_hash(_BYTES[data]), starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        shift = width - have
        out = np.minimum(out[: len(out) - shift], out[shift:])
    return out[:n]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with more underscores in front for as long as a column of ``taken`` starts with it."""
    while any(c.lower().startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads: others, whatever their names, do not clash."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
