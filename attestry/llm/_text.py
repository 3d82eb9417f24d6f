"""Vectorised byte-level helpers shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  Words are found on the UTF-8 bytes (all
separators used here are ASCII, so byte and code point views agree) and hashed
with a polynomial over random byte values modulo 2**64, all in numpy, without a
Python object per word.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 1 << 20

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15


def _byte_values() -> np.ndarray:
    """Random odd 64-bit values per byte; A-Z share those of a-z."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    values[65:91] = values[97:123]
    return values


_BYTE = _byte_values()
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_MULT, pow(_MULT, -1, 1 << 64))):
            full = np.full(n, base, _U)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def separators(keep: Callable[[int], bool]) -> np.ndarray:
    return np.array([not keep(b) for b in range(256)])


#: Words are runs of anything but space and the controls 9 to 13.
SPACE_SEP = separators(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of ASCII digits and letters, and of anything beyond ASCII.
ALNUM_SEP = separators(lambda b: b >= 0x80 or chr(b).isalnum())


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (one more at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~sep[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0] = before[-1] = False
    before[1:-1] = inside[:-1]
    edge = offs[(offs > 0) & (offs < len(buf))]
    before[edge] = False
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, A-Z taken as a-z; in stretches of SLICE_BYTES, so that a very long text needs no more memory for it."""
    if len(buf) <= 2 * SLICE_BYTES:
        return _word_hashes(buf, starts, ends)
    out = np.empty(len(starts), _U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right")))
        low = starts[a]
        out[a:b] = _word_hashes(buf[low : ends[b - 1]], starts[a:b] - low, ends[a:b] - low)
        a = b
    return out


def code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte of a text, and its end, the code points before it."""
    return np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))


def _word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes (order counts); one for each place it can start."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    out = np.full(count, _U(n), _U)
    for k in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[k : k + count]
    return mix(out)


def crc32_mod(column: pa.Array, mod: int) -> np.ndarray:
    """crc32 of the decimal text of each id, modulo ``mod``; null ids as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if v is None else str(v).encode()) % mod for v in column.to_pylist()], np.int64)


def append_arrow(df: DataFrame, fields: T.StructType, make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Adds columns computed per Arrow batch; a column of df with the name of a new one is replaced."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *fields.fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, *fields.names])

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local session without one, as in tests, gets one beside its warehouse."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = f"file://{os.path.abspath('spark-warehouse')}/checkpoints"
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name for a table of this session in the shared folder; ``remove`` takes it away."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a table of the shared folder that no result needs any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as compressed Parquet and read from there."""
    spark = df.sparkSession
    folder = new_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
