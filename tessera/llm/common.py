"""Helpers that several operators share: a scratch area all executors see, and Arrow batch slicing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every contract: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once by an Arrow function; a longer single text is one slice.
SLICE_BYTES = 2 << 20


_LEFT: set[str] = set()
#: Scratch tables that were not removed yet.
_MADE: dict[str, None] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's own.

    Only where neither is set (a local session, as in tests) a temporary folder is chosen.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(path)
    own = f"{path.rstrip('/')}/tessera-{sc.applicationId}"
    if own not in _LEFT:  # what is not discarded before goes when the application ends
        _LEFT.add(own)
        place = sc._jvm.org.apache.hadoop.fs.Path(own)
        files = place.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return own


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table of the scratch area and read it back: lineage ends at replicated files."""
    path = scratch_path(df.sparkSession, tag)
    with _released_shuffles(df.sparkSession):
        df.write.parquet(path)
    return _placed(df.sparkSession.read.schema(df.schema).parquet(path), path)


def few(df: DataFrame) -> DataFrame:
    """The rows in a thirty-second of the shuffle partitions, four at least: aggregates with few rows make few tasks and files so."""
    return df.coalesce(max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 32))


def bucketed(df: DataFrame, column: str, buckets: int, tag: str) -> DataFrame:
    """As ``materialize``, bucketed by ``column``: joins by it read the table without a shuffle."""
    spark = df.sparkSession
    path, name = scratch_path(spark, tag), f"tessera_{uuid.uuid4().hex}"
    with _released_shuffles(spark):
        df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    made = spark.table(name)
    made.schema  # resolved, so that the name is needed no more; the files stay
    spark.sql(f"drop table {name}")
    return _placed(made, path)


def _placed(df: DataFrame, path: str) -> DataFrame:
    df._scratch = path
    _MADE[path] = None
    return df


def scratch_made() -> list[str]:
    """The scratch tables there are, oldest first."""
    return list(_MADE)


def release(paths: list[str], docs: DataFrame) -> None:
    """Remove scratch tables but those that ``docs`` still reads."""
    read = {part for f in docs.inputFiles() for part in f.split("/")[-3:-1]} if paths else set()
    for path in paths:
        if path in _MADE and path.rpartition("/")[2] not in read:
            _delete(docs.sparkSession, path)


@contextmanager
def _released_shuffles(spark: SparkSession):
    """Within, the engine drops a query's shuffle files when it ends: what it wrote is all that is needed."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _MADE.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch tables (call when no result that reads them is still needed)."""
    _delete(spark, scratch_dir(spark))


#: Bytes of an Arrow batch between the engine and Python; the engine's default is 16 times as much.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bounded(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, so that long texts do not add up in a worker or an executor."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def trim() -> None:
    """Give memory that a task has freed back to the system; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Zero-copy row ranges of a batch whose ``column`` holds about ``limit`` bytes each."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(column)
    if col.nbytes <= limit:
        yield batch
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(lengths.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start, n - start)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added; one of the same name is replaced."""
    names = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word that are read as whole lanes of eight; longer words are hashed each by itself.
LANE_BYTES = 64
_LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POINTS = np.zeros(256, bool)
_POINTS[list(b".,!?;:")] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[list(range(65, 91)) + list(range(97, 123))] = True
#: Second bytes of the letters whose first byte in UTF-8 is C3.
_LATIN = np.zeros(256, bool)
_LATIN[list({*range(0x80, 0xC0)} - {0x97, 0xB7})] = True


def word_spans(texts: pa.Array, lower: bool = False, points: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a string column, found on its buffer: (bytes, starts, stops, first word of each text).

    The last array has one entry more than there are texts. With ``lower`` A-Z are given as a-z.
    With ``points`` a point, comma or the like that ends a word after a Latin letter is a word of its own. Null is empty.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n_docs = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n_docs + 1].astype(np.int64) if n_docs else np.zeros(1, np.int64)
    if at[-1] == at[0]:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, np.zeros(n_docs + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = at[:-1][at[:-1] < len(raw)]
    begins[cuts] |= inside[cuts]
    begins_at = np.flatnonzero(begins)
    last = at[1:][at[1:] > 0] - 1
    closing = np.append(inside[:-1] & ~inside[1:], inside[-1:])
    closing[last] |= inside[last]
    stop = np.flatnonzero(closing) + 1
    if points:
        before = raw[np.maximum(stop - 2, 0)]
        letter = _LETTERS[before] | _LATIN[before] & (stop - begins_at > 2) & (raw[np.maximum(stop - 3, 0)] == 0xC3)
        cut = np.flatnonzero(_POINTS[raw[stop - 1]] & (stop - begins_at > 1) & letter)
        at_point = stop[cut] - 1
        begins_at, stop = np.insert(begins_at, cut + 1, at_point), np.insert(stop, cut, at_point)
    return (_LOWER[raw] if lower else raw), begins_at, stop, np.searchsorted(begins_at, at)


def of_letters(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which words consist of ASCII and Latin-1 letters alone."""
    after_c3 = np.append(False, raw[:-1] == 0xC3) & _LATIN[raw]
    good = _LETTERS[raw] | after_c3
    good[:-1] |= after_c3[1:]
    bad = np.append(0, np.cumsum(~good))
    return bad[stop] == bad[start]


def lanes(raw: np.ndarray, start: np.ndarray, size: np.ndarray, count: int) -> np.ndarray:
    """The bytes of words of at most 8 * count bytes, as ``count`` rows of integers, zero beyond the word."""
    data = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", data, strides=(1,))
    out = np.zeros((count, len(start)), np.uint64)
    if len(start):
        out[0] = eight[start] & _LANE_MASKS[np.minimum(size, 8)]
    for j in range(1, count):
        longer = np.flatnonzero(size > 8 * j)
        if not len(longer):
            break
        out[j, longer] = eight[start[longer] + 8 * j] & _LANE_MASKS[np.minimum(size[longer] - 8 * j, 8)]
    return out


def hash_lanes(rows: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words given as lanes: each lane goes through two rounds of multiplication."""
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    h = mix((h ^ rows[0]) * np.uint64(0xD6E8FEB86659FD93))
    for j in range(1, len(rows)):
        longer = np.flatnonzero(size > 8 * j)
        if not len(longer):
            break
        h[longer] = mix((h[longer] ^ rows[j, longer]) * np.uint64(0xD6E8FEB86659FD93))
    return h


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, *seeds: int) -> list[np.ndarray]:
    """One array of 64-bit hashes of all words for each seed."""
    size = stop - start
    width = max(1, min(LANE_BYTES, int(size.max(initial=1)) + 7) // 8)
    rows = lanes(raw, start, np.minimum(size, 8 * width), width)
    found = [hash_lanes(rows, size, s) for s in seeds]
    for i in np.flatnonzero(size > LANE_BYTES).tolist():
        word = raw[start[i] : stop[i]].data
        for h, s in zip(found, seeds):
            h[i] = xxhash.xxh3_64_intdigest(word, s)
    return found
