"""Token files: the encoder's table of words against the library, and reading in parts."""

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_files
from tessera.llm.common import hash_lanes, lanes, scratch_path, word_hashes, word_spans
from tessera.llm.queries import tokenizer_path

NAME = tokenizer_path("word_bpe_49k.json")


def thue_morse(n, one, other):
    return "".join(one if i.bit_count() % 2 == 0 else other for i in range(n))


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(NAME)


def ids(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def test_words_that_linear_hashes_confuse(lib):
    words = [thue_morse(n, *pair) for n in (16, 32, 1024, 2048) for pair in ("ab", "ba", "Ab", "é,")]
    own = token_files.WordEncoder(NAME)
    for _ in range(2):  # new, then known
        assert own.encode(pa.array(words)).to_pylist() == [ids(lib, w) for w in words]
    raw, start, stop, _ = word_spans(pa.array(words))
    for h in word_hashes(raw, start, stop, 1, 2):
        assert len(set(h.tolist())) == len(set(words))


def test_words_are_compared_not_only_hashed(lib, monkeypatch):
    monkeypatch.setattr(token_files, "hash_lanes", lambda rows, size, seed=0: np.zeros(len(size), np.uint64))
    own = token_files.WordEncoder(NAME)
    texts = ["one two three", "two three four one", "", "éé one\x00 one"]
    for _ in range(3):  # all words have one hash
        assert own.encode(pa.array(texts)).to_pylist() == [ids(lib, t) for t in texts]


def test_table_keeps_its_limit(lib):
    own, rnd = token_files.WordEncoder(NAME, cache_bytes=1 << 17), random.Random(1)
    for _ in range(12):
        texts = [" ".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 40))) + rnd.choice(["", ",", "."]) for _ in range(200)) + " often seen" for _ in range(5)]
        assert own.encode(pa.array(texts), 2).to_pylist() == [ids(lib, t) + [2] for t in texts]
        own.table.shrink()
        assert own.table.n * 55 + 4 * own.table.used <= 1 << 17
    rows = lanes(np.frombuffer(b"often", np.uint8), np.zeros(1, int), np.array([5]), 4)
    assert own.table.find(rows, np.array([5]))[0] >= 0 and len(hash_lanes(rows, np.array([5]))) == 1


def test_files(spark, lib):
    long = " ".join(f"w{i}ord" for i in range(200_000))
    data = [(3, "b c"), (None, "none"), (1, long), (2, None), (None, ""), (2, "again"), (2, "again"), (4, "漢字" * 4000), (5, "x" * 70_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "part": F.lit(1.5), "_row": F.lit(0)})
    path = scratch_path(spark, "t")
    token_files.write(docs, path, NAME)
    stored = token_files.checksums(token_files.read(spark, path)).join(token_files.starts(spark, path), ["part", "seq"]).orderBy("part", "seq").collect()
    assert [r.doc_id for r in stored] == [None, None, 1, 2, 2, 2, 3, 4, 5]
    wanted = sorted((i if i is not None else -1, zlib.crc32(np.array(ids(lib, t) + [2], "<u4").tobytes()), len(ids(lib, t)) + 1) for i, t in data)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in stored) == wanted
    assert [r.start for r in stored] == np.cumsum([0, *[r.n_tokens for r in stored]])[:-1].tolist()
    empty = scratch_path(spark, "t")
    token_files.write(docs.limit(0), empty, NAME)
    assert token_files.checksums(token_files.read(spark, empty)).join(token_files.starts(spark, empty), ["part", "seq"]).count() == 0


def test_reading_a_few_documents(spark, lib, tmp_path):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("document number "), F.col("id")).alias("text"))
    path = str(tmp_path / "files")
    token_files.write(docs, path, NAME)
    some = token_files.read_some(spark, path, [17, 4242])
    assert {r.doc_id: r.ids for r in some.collect()} == {i: ids(lib, f"document number {i}") + [2] for i in (17, 4242)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [17,4242])]" in plan
    lengths = token_files.read(spark, path).select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n_tokens:bigint>" in lengths
    for f in glob.glob(f"{path}/*.parquet"):
        column = pq.ParquetFile(f).metadata.row_group(0).column(2)
        assert column.has_column_index and column.has_offset_index
