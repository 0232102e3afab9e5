"""Helpers shared by the corpus operators: shared storage, size-checked joins, Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all contracts of this subpackage count words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a lookup table up to which it is broadcast (checked by a count before each use).
BROADCAST_ROWS = 50_000
#: Values of a table of whole numbers up to which it is broadcast: some 16 MB at most.
BROADCAST_KEYS = 500_000
#: Bytes of compressed Parquet up to which a written table is broadcast.
BROADCAST_BYTES = 8 << 20
#: Replicas of a lookup table that is too large to broadcast, so that hot keys spread.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a temporary one if all runs in one
    process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="talentlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the driver's file system client deletes it when the session ends."""
    path = f"{shared_dir(spark)}/talentlake/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def configured(spark: SparkSession) -> SparkSession:
    """Make a session ready for this subpackage's Python stages.

    Executors get the package's modules as a Python file, as they need not see the driver's folders; texts go to Python
    in batches of some 2 MB, so that a worker's memory follows no table's text lengths."""
    sc = spark.sparkContext
    if not getattr(sc, "talentlake_shipped", False):
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="talentlake-")) / "talentlake.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(package.rglob("*.py")):
                out.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(target))
        sc.talentlake_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    return spark


def tidied(f: Callable) -> Callable:
    """A function on Arrow batches that gives free memory back when a task ends: workers wait for other tasks, beside others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Free memory to the system, as far as this platform's allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table from written(); 0 for another."""
    path = getattr(df, "written_path", None)
    if path is None:
        return 0
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column for (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", rows: int | None = None, hot: bool = True) -> DataFrame:
    """Join a lookup table whose keys are distinct. It is broadcast if a count finds at most BROADCAST_ROWS rows,
    or, of whole-number columns alone, BROADCAST_KEYS values; a larger one is replicated SALTS times and joined on key and salt, which spreads a hot key of big. With hot=False, for
    keys that few rows of big share, and for semi and anti joins, a larger one is shuffled as it is. Null keys match."""
    rows = small.count() if rows is None else rows
    names = fresh(big, *(f"k_{k}" for k in keys))
    right = small.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    on = None
    for k, n in zip(keys, names, strict=True):
        on = F.col(k).eqNullSafe(F.col(n)) if on is None else on & F.col(k).eqNullSafe(F.col(n))
    narrow = all(kind in ("bigint", "int") for _, kind in small.dtypes)
    fits = rows <= (max(BROADCAST_KEYS // len(small.columns), BROADCAST_ROWS) if narrow else BROADCAST_ROWS)
    if fits and _written_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(right), on, how).drop(*names)
    if how in ("left_semi", "left_anti"):
        return big.join(right, on, how)
    if not hot:
        return big.join(right, on, how).drop(*names)
    salt_l, salt_r = fresh(big, "salt_l", "salt_r")
    left = big.withColumn(salt_l, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    right = right.withColumn(salt_r, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, on & (F.col(salt_l) == F.col(salt_r)), how).drop(*names, salt_l, salt_r)


def n_words(text: Column) -> Column:
    """How many words a text has (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its offsets, one more than rows, from 0; null and empty texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes each; a longer row stands alone."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = out[-1][1]
    return out


#: Fixed odd multiplier of the positional hashes, its inverse modulo 2**64, and the seed of the byte table.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: int, name: str) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        step = np.full(size, base & ((1 << 64) - 1), np.uint64)
        step[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(step)
    return have[:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start byte, end byte) of every word of a block of texts, A-Z lower-cased, in text order.

    A word's hash depends on its folded bytes alone: prefix sums of byte values times powers of an odd base,
    shifted back by the base's inverse. Words never cross rows. With marks, a full stop or comma that ends a word right
    behind an ASCII letter is a word of its own."""
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    stop = np.ones(n, bool)
    stop[:-1] = ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[last] = True
    stop &= inside
    if marks:
        own = np.flatnonzero(stop & ~begin & ((raw == 0x2E) | (raw == 0x2C)))
        own = own[_LETTER[raw[own - 1]]]
        begin[own] = True
        stop[own - 1] = True
        starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[_FOLD[raw]] * _powers(n, _P, "p"), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _powers(n, _P_INV, "inv")[starts] + (ends - starts).astype(np.uint64))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows, starts, ends


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of `width` words; a row of fewer words but one at least has its whole sequence as one."""
    total = len(hashes)
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    weights = [np.uint64(pow(_P, 3 * k + 1, 1 << 64)) for k in range(width)]
    full = total - width + 1
    out_h, out_r = [], []
    if full > 0:
        acc = hashes[:full] * weights[0]
        for k in range(1, width):
            acc = acc + mix64(hashes[k : k + full] + np.uint64(k)) * weights[k]
        ok = rows[:full] == rows[width - 1 :]
        out_h.append(mix64(acc[ok]))
        out_r.append(rows[:full][ok])
    counts = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.concatenate(([0], np.cumsum(counts)))
        h = counts[short].astype(np.uint64)
        for k in range(width - 1):
            on = counts[short] > k
            h[on] = mix64(h[on] * np.uint64(_P) + hashes[at[short[on]] + k])
        out_h.append(h)
        out_r.append(short)
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    if len(short):
        o = np.argsort(r, kind="stable")
        h, r = h[o], r[o]
    return h, r
