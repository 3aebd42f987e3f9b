"""Token ids in Parquet files that can be read in parts.

Format: one row per document in ascending doc_id order over all files (nulls first): ``part`` (the file's
place in the order), ``seq`` (row in the file), ``doc_id``, ``n_tokens`` and ``ids`` (list of int). Integers
without a small value set are delta-packed (data page v2), others dictionary-coded; row groups and pages are
small, and column and page indexes let a reader fetch the ids of a few documents, or lengths alone, without
touching the rest. Files are written by the engine's committer, so lost executors leave no partial file.

Words are told apart by their bytes; hashes only say where to look.

Defined results: a null text counts as empty and has only the end id; repeated doc_ids keep the order they are
read in; an empty table writes no rows and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_lanes, lanes, of_letters, slices, trim, word_spans

#: Bytes of known words and their ids that a worker keeps while it lives.
CACHE_BYTES = 96 << 20
#: Bytes of text looked up at once.
SLICE = 2 << 20
#: Longer words (in bytes) are encoded anew in each slice.
CACHED_WORD = 32
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "compression": "zstd",
}
SCHEMA = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def _gathered(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every run of ``count`` places, one run after the other."""
    done = np.append(0, np.cumsum(count))
    return np.repeat(begin - done[:-1], count) + np.arange(done[-1])


class WordTable:
    """Ids by word: an open-addressing hash table in arrays, looked up for many words at once.

    A word is its bytes, as lanes, and its size; both are compared on every hit. When the table outgrows
    ``limit`` bytes, the half that was used least goes.
    """

    LANES = CACHED_WORD // 8

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit = limit
        self._clear(1 << 14)

    def _clear(self, capacity: int) -> None:
        self.n = self.used = 0
        self.lanes = np.zeros((self.LANES, capacity), np.uint64)
        self.size, self.uses = np.zeros(capacity, np.uint8), np.zeros(capacity, np.uint16)
        self.start, self.count = np.zeros(capacity, np.int64), np.zeros(capacity, np.int32)
        self.ids = np.zeros(4 * capacity, np.int32)
        self.slots = np.full(4 * capacity, -1, np.int32)

    def _grown(self, n: int, ids: int) -> None:
        if n > len(self.size):
            to = 1 << (n - 1).bit_length()
            more = to - len(self.size)
            self.lanes = np.concatenate([self.lanes, np.zeros((self.LANES, more), np.uint64)], 1)
            self.size, self.uses, self.start, self.count = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.size, self.uses, self.start, self.count))
            self.slots = np.full(2 * to, -1, np.int32)
            self._place(np.arange(self.n))
        if ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros((1 << (ids - 1).bit_length()) - len(self.ids), np.int32)])

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _place(self, entries: np.ndarray) -> None:
        slot, last = self._slot(hash_lanes(self.lanes[:, entries], self.size[entries])), len(self.slots) - 1
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            lost = self.slots[slot] != entries
            entries, slot = entries[lost], (slot[lost] + 1) & last

    def find(self, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of every word, -1 where there is none."""
        out = np.full(len(size), -1, np.int32)
        slot, last, open_ = self._slot(hash_lanes(rows, size)), len(self.slots) - 1, np.arange(len(size))
        while len(open_):
            entry = self.slots[slot]
            taken = entry >= 0
            open_, slot, entry = open_[taken], slot[taken], entry[taken]
            same = (self.lanes[0, entry] == rows[0, open_]) & (self.size[entry] == size[open_])
            for j in range(1, self.LANES):
                longer = np.flatnonzero(same & (size[open_] > 8 * j))
                same[longer] = self.lanes[j, entry[longer]] == rows[j, open_[longer]]
            out[open_[same]] = entry[same]
            open_, slot = open_[~same], (slot[~same] + 1) & last
        return out

    def add(self, rows: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Add words that are not in the table, each once, with their ids one after the other."""
        a, b = self.n, self.n + len(size)
        self._grown(b, self.used + len(ids))
        self.lanes[:, a:b], self.size[a:b], self.count[a:b], self.uses[a:b] = rows, size, count, 0
        self.start[a:b] = self.used + np.cumsum(count) - count
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = b, self.used + len(ids)
        self._place(np.arange(a, b))

    def used_now(self, entries: np.ndarray) -> None:
        self.uses[entries] += self.uses[entries] < 60_000

    def shrink(self) -> None:
        """Keep the limit; entries change their numbers."""
        if self.n * (self.lanes.itemsize * self.LANES + 15 + 8) + 4 * self.used <= self.limit:
            return
        kept = np.sort(np.argsort(-self.uses[: self.n].astype(np.int32), kind="stable")[: self.n // 2])
        rows, size, count, uses = self.lanes[:, kept], self.size[kept], self.count[kept], self.uses[kept] >> 1
        ids = self.ids[_gathered(self.start[kept], count)]
        self._clear(1 << max(14, (len(kept) - 1).bit_length()))
        self.add(rows, size, ids, count)
        self.uses[: self.n] = uses


class WordEncoder:
    """A tokenizer whose pre-tokenizer never crosses white space, with a table of ids by word.

    Normaliser, pre-tokenizer and merges of such a tokenizer see every run between white space alone, so the
    ids of a text are those of its words in turn; likewise it parts a point or comma from the letter before.
    Words not in the table are encoded by the library in joined batches. Words of letters alone end at tokens
    with the vocabulary's word end; between others stands a control character as a word, whose single id shows
    where each ends.
    """

    MARK = "\x01"
    BATCH = 1000

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._plain([self.MARK])[0]
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        steps = spec["normalizer"] or {}
        heads = {t["content"][:2] for t in spec["added_tokens"]}  # these match before letters are lowered
        self.added = re.compile("|".join(map(re.escape, heads)).encode() or b"(?!)")
        self.lowers = any(n.get("type") == "Lowercase" for n in steps.get("normalizers", [steps])) and not any(c.isalpha() for h in heads for c in h)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.table = WordTable(cache_bytes)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each)."""
        count, begin, flat, used = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0

        def take(which: np.ndarray, ids: np.ndarray, first: np.ndarray, stop_: np.ndarray) -> None:
            nonlocal used
            if len(first) != len(which):
                raise RuntimeError("the tokenizer did not give every word its ids")
            count[which], begin[which] = stop_ - first, used + first
            flat.append(ids)
            used += len(ids)

        # the words alone, each with a space behind it
        size = stop - start
        at = _gathered(start, size + 1)
        stop = np.cumsum(size + 1) - 1
        at[stop] = len(raw)
        raw, start = np.append(raw, np.uint8(32))[at], stop - size
        simple = of_letters(raw, start, stop) if self.ends.any() else np.zeros(len(start), bool)
        some = np.flatnonzero(simple)
        parts = [some[k : k + self.BATCH] for k in range(0, len(some), self.BATCH)]
        texts = [raw[_gathered(start[which], size[which] + 1)].tobytes().decode() for which in parts]
        for which, ids in zip(parts, self._plain(texts)):
            ends = np.flatnonzero(self.ends[ids]) + 1
            take(which, ids, np.append(0, ends[:-1])[: len(ends)], ends)
        rest = np.flatnonzero(~simple)
        words = [raw[a:b].tobytes().decode() for a, b in zip(start[rest].tolist(), stop[rest].tolist())]
        if len(self.mark) == 1 and not any(self.MARK in w for w in words):
            parts = [rest[k : k + self.BATCH] for k in range(0, len(rest), self.BATCH)]
            joined = [f" {self.MARK} ".join(words[k : k + self.BATCH]) for k in range(0, len(words), self.BATCH)]
            for which, ids in zip(parts, self._plain(joined)):
                marks = np.flatnonzero(ids == self.mark[0])
                take(which, ids, np.append(0, marks + 1), np.append(marks, len(ids)))
        else:
            for i, ids in enumerate(self._plain(words)):
                take(rest[i : i + 1], ids, np.zeros(1, np.int64), np.array([len(ids)]))
        all_ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        return all_ids[_gathered(begin, count)], count

    def _caseless(self, texts: pa.Array) -> bool:
        """Whether A-Z may count as a-z: the tokenizer lowers them, and there is no mark that joins the letter before.

        Bytes from CC up begin characters from U+0300 up, the first such mark. What may be an added token is told
        apart by case as well.
        """
        data = texts.buffers()[2]
        part = texts.offset, texts.offset + len(texts)
        if not self.lowers or data is None or not len(texts):
            return False
        at = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        codes = np.frombuffer(data, np.uint8)[at[part[0]] : at[part[1]]]
        return bool(codes.max(initial=0) < 0xCC) and not self.added.search(codes.data)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """The ids of every text of a column, each followed by ``end_id``."""
        raw, start, stop, first = word_spans(texts, lower=self._caseless(texts), points=self.ends.any())
        size, table = stop - start, self.table
        table.shrink()
        short = np.flatnonzero(size <= CACHED_WORD)
        rows = lanes(raw, start[short], size[short], table.LANES)
        entry = np.full(len(size), -1, np.int32)
        entry[short] = found = table.find(rows, size[short])
        lost = np.flatnonzero(found < 0)
        if len(lost):
            # words not known yet; of two with one hash the first is added, and the other stays unknown
            _, at = np.unique(hash_lanes(rows[:, lost], size[short][lost]), return_index=True)
            new = lost[at]
            table.add(rows[:, new], size[short[new]], *self._words(raw, start[short[new]], stop[short[new]]))
            entry[short[lost]] = table.find(rows[:, lost], size[short[lost]])
        table.used_now(entry[entry >= 0])
        rest = np.flatnonzero(entry < 0)
        ids, count = table.ids[: table.used], np.zeros(len(size), np.int64)
        begin = np.zeros(len(size), np.int64)
        known = entry >= 0
        begin[known], count[known] = table.start[entry[known]], table.count[entry[known]]
        if len(rest):
            more, count[rest] = self._words(raw, start[rest], stop[rest])
            begin[rest] = len(ids) + np.cumsum(count[rest]) - count[rest]
            ids = np.concatenate([ids, more])
        if end_id is not None:  # one more word, at the end of every text
            ids = np.append(ids, np.int32(end_id))
            begin, count = np.insert(begin, first[1:], len(ids) - 1), np.insert(count, first[1:], 1)
            first = first + np.arange(len(first))
        offsets = np.append(0, np.cumsum(count))[first]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[_gathered(begin, count)], pa.int32()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file; a worker keeps it, with its table of words, while it lives."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode every whole text, append ``end_id`` and write files in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq = encoder(tokenizer_path), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lists, n = enc.encode(part.column("text"), end_id), part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(seq, seq + n), pa.int64()), part.column("doc_id"), pa.compute.list_value_length(lists).cast(pa.int64()), lists],
                    names=["seq", "doc_id", "n_tokens", "ids"],
                )
                seq += n
        trim()

    out = rows.select("doc_id", "text").mapInArrow(run, T.StructType(SCHEMA.fields[1:]))
    out.select(F.spark_partition_id().cast("long").alias("part"), *SCHEMA.names[1:]).write.options(**FORMAT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_some(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents: the filter reaches the files, whose indexes leave most pages unread."""
    return read(spark, path).where(F.col("doc_id").isin(list(doc_ids)))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, start): ids before each document. Reads only the length column.

    Lengths are summed inside a file; between files only one row per file is ordered in one task.
    """
    lengths = read(spark, path).select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = lengths.groupBy("part").agg(F.sum("n_tokens").alias("_sum")).select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = lengths.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(files, "part").select("part", "seq", (F.col("_offset") + F.col("_in")).alias("start"))


def checksums(stored: DataFrame) -> DataFrame:
    """Add ``ids_crc32``: unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            at = ids.offsets.to_pylist()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in SCHEMA.names[:4]] + [pa.array(crc, pa.int64())], names=[*SCHEMA.names[:4], "ids_crc32"])

    return stored.mapInArrow(run, T.StructType([*SCHEMA.fields[:4], T.StructField("ids_crc32", T.LongType())]))
