"""Exact Jaccard self-join on word shingles by a token-group matrix, as classes of linked documents.

1. Rows. Every row gets a number and is written once, bucketed by it; later steps join that table by number, so
   no text is shuffled again but those that are compared.
2. Sets. Each whole text becomes its set of shingle hashes. A narrow row per document has the set's size, min-hashes
   and a bit signature. Documents with the same words in the same order are one class; later steps use the class's
   first row only.
3. Groups. Classes that share a min-hash are compared with a few leaders of their bucket, first by signature, then
   exactly; exact links make first components. A component is cut into groups of about ``GROUP`` members, and the
   union of each group's tokens is stored as a signature.
4. Matrix. Two sets that link share a token among the first n - ceil(t * n) + 1 of each, in any common order; here
   tokens that a bounded sketch of each task found often come last. So the matrix holds, for each token, the classes
   that have it in their prefix; a class whose prefix meets another component's row is a query to that component, the
   smaller component asking, unless sizes, positions of the token or parities of token cells rule a link out. Rows of a
   token beyond ``RUN_ROWS`` are dealt out again as pairs of blocks.
5. Bounding. A query's overlap with any member of a group is at most its overlap with the group's stored union.
   Only groups whose bound reaches the threshold are opened: only then are texts moved.
6. Opening. Members are compared until one links, as the members of a group are known to be connected.
7. Components of all links, and for each document the smallest doc_id of its own.

Buckets, groups, and tokens with many rows are split. Scratch tables replace lineage.

Hashes. Words are hashed with two seeds that are drawn for each run, shingles from the words' hashes. Sets are of the
first; a class needs equal hashes of both, and a link that the first declares must hold for sets of the second too.
So whatever the texts, two different ones pass for one with odds of about 2**-64 a pair compared, 2**-128 for a class.

Defined results: null and empty texts, and texts of white space, have no shingles and link with nothing;
fewer words than a shingle has are one shingle, the whole sequence; repeated rows link with each other; a null
doc_id takes part but is never a component's smallest unless all are null; repeated doc_ids are separate rows; other
columns are ignored. ``docs`` must give the same rows in the same order if a task runs again, as files do.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, discard, materialize, mix, slices, trim, word_hashes, word_spans
from .components import components

#: Members of a group of the matrix.
GROUP = 64
#: Leaders kept while a bucket is streamed, and rows of a bucket in one task.
LEADERS, BUCKET_ROWS = 12, 1024
#: Queries to a group in one task.
QUERY_ROWS = 4096
#: Classes of one token compared in one task; more are split.
RUN_ROWS = 8192
#: Tokens counted at a time, entries of a task's sketch, and of all tasks' together; tokens are frequent from HOT_COUNT on.
SKETCH_TOKENS, SKETCH, HOT_TOKENS, HOT_COUNT = 1 << 21, 1 << 15, 1 << 18, 24
SLICE = 1 << 20
_MIN_HASHES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Two seeds of word hashes.
Seeds = tuple[int, int]


def _windows(word: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    n_windows = max(0, len(word) - k + 1)
    window = word[:n_windows] * factor[0]
    for j in range(1, k):
        window += word[j : n_windows + j] * factor[j]
    window = mix(window)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(window[a : b - k + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(word[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, k: int, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, start, stop, first = word_spans(texts, lower=True)
    return _windows(word_hashes(raw, start, stop, seed)[0], first, k)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |a & b| >= num * |a | b|."""
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum()) if len(b) else 0
    return den * common >= num * (len(a) + len(b) - common)


def parity(s: np.ndarray) -> np.ndarray:
    """Which of 128 cells hold an odd number of the set's tokens, as two int64."""
    return np.packbits(np.bincount(s >> np.uint64(57), minlength=128).astype(np.uint8) & 1).view(np.int64)


def signature(s: np.ndarray) -> bytes:
    """A bit for each token, in the smallest power of two of bits that is four times their number or more."""
    size = max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(size, np.uint8)
    bits[s & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sized(bits: np.ndarray, size: int) -> np.ndarray:
    """A signature in ``size`` words: folded, or repeated, which claims more than was there but never less."""
    if len(bits) > size:
        return np.bitwise_or.reduce(bits.reshape(-1, size), 0)
    return np.tile(bits, size // len(bits))


def most_shared(n: int, bits: np.ndarray, other: np.ndarray) -> int:
    """A bound on how many of the n tokens of ``bits`` are among those of ``other``."""
    size = min(len(bits), len(other))
    mine = _sized(bits, size)
    return n - int(np.bitwise_count(mine).sum()) + int(np.bitwise_count(mine & _sized(other, size)).sum())


def _bits(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u8")


def _least_overlap(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shares with any set it links to, at least."""
    return -(-num * n // den)


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


_L, _B = T.LongType(), T.BinaryType()
_SETS = _schema(rid=_L, doc_id=_L, n=_L, c1=_L, c2=_L, m0=_L, m1=_L, m2=_L, bits=_B)
_LINK = _schema(u=_L, v=_L)
_ASK = _schema(nid=_L, gid=_L)
_ROW = ["token", "nid", "comp", "members", "place", "b0", "b1"]
_POSTING = _schema(**dict.fromkeys(_ROW, _L))
_MET = _schema(nid=_L, comp=_L, token=_L, block=_L, members=_L, place=_L, b0=_L, b1=_L)


def _batch(schema: T.StructType, *columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema)], names=schema.names)


class Sketch:
    """Counts of frequent tokens in bounded space: chunks are counted exactly, and the largest sums kept."""

    def __init__(self):
        self.held, self.size = [], 0
        self.token, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.held.append(s)
        self.size += len(s)
        if self.size >= SKETCH_TOKENS:
            self.fold()

    def fold(self) -> None:
        if not self.held:
            return
        token, count = np.unique(np.concatenate(self.held), return_counts=True)
        often = count > 1
        token, at = np.unique(np.concatenate([self.token, token[often]]), return_inverse=True)
        count = np.bincount(at, np.concatenate([self.count, count[often]])).astype(np.int64)
        if len(token) > SKETCH:
            top = np.sort(np.argpartition(-count, SKETCH)[:SKETCH])
            token, count = token[top], count[top]
        self.token, self.count, self.held, self.size = token, count, [], 0


def _sets(rows: DataFrame, k: int, seeds: Seeds) -> DataFrame:
    """A narrow row per document; then, with null rid, the frequent tokens of the task: m0 is the token, n its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                raw, start, stop, first = word_spans(piece.column("text"), lower=True)
                word, second = word_hashes(raw, start, stop, *seeds)
                sets = _windows(word, first, k)
                c1 = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
                c2 = [xxhash.xxh3_64_intdigest(second[a:b].tobytes()) - 2**63 if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                mins = [[int(mix(s * m).min().view(np.int64)) if len(s) else None for s in sets] for m in _MIN_HASHES]
                yield _batch(_SETS, piece.column("rid"), piece.column("doc_id"), list(map(len, sets)), c1, c2, *mins, [signature(s) if len(s) else None for s in sets])
                for s in sets:
                    sketch.add(s)
        sketch.fold()
        if len(sketch.token):
            none = pa.nulls(len(sketch.token), pa.int64())
            yield _batch(_SETS, none, none, sketch.count, none, none, sketch.token.view(np.int64), none, none, pa.nulls(len(none), pa.binary()))
        trim()

    return rows.select("rid", "doc_id", "text").mapInArrow(run, _SETS)


def _frequent(sets: DataFrame) -> np.ndarray:
    """Frequent tokens by rising count; at most HOT_TOKENS."""
    counts = sets.where("rid is null").groupBy("m0").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT)
    return counts.orderBy(F.col("n").desc(), "m0").limit(HOT_TOKENS).toArrow().column("m0").to_numpy()[::-1].view(np.uint64)


def _leader_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(nid, gid): classes and the leader of their bucket that they may link to; rows come sorted by (r, bucket, salt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, []
        for batch in batches:
            pairs = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("r", "bucket", "salt")))
            for key, nid, n, data in zip(keys, batch.column("nid").to_pylist(), batch.column("n").to_pylist(), batch.column("bits")):
                if key != at:
                    at, leaders = key, []
                bits, best, score = _bits(data.as_py()), None, 0.0
                for other, m, theirs in leaders:
                    if den * min(n, m) >= num * max(n, m):
                        most = min(most_shared(n, bits, theirs), most_shared(m, theirs, bits))
                        if den * most >= num * (n + m - most) and most / (n + m - most) > score:
                            best, score = other, most / (n + m - most)
                if best is not None:
                    pairs.append((nid, best))
                elif len(leaders) < LEADERS:
                    leaders.append((nid, n, bits))
            if pairs:
                yield _batch(_ASK, *zip(*pairs))

    return rows.mapInArrow(run, _ASK)


def _unions(rows: DataFrame) -> DataFrame:
    """(gid, bits): the union of the signatures of each group's members; rows come sorted by gid."""
    schema = _schema(gid=_L, bits=_B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, union = None, None
        for batch in batches:
            done = []
            for gid, data in zip(batch.column("gid").to_pylist(), batch.column("bits")):
                bits = _bits(data.as_py())
                if gid != at:
                    if at is not None:
                        done.append((at, union.tobytes()))
                    at, union = gid, bits
                else:
                    size = max(len(union), len(bits))
                    union = _sized(union, size) | _sized(bits, size)
            if done:
                yield _batch(schema, *zip(*done))
        if at is not None:
            yield _batch(schema, [at], [union.tobytes()])

    return rows.mapInArrow(run, schema)


def _postings(classes: DataFrame, k: int, num: int, den: int, hot: np.ndarray, seed: int) -> DataFrame:
    """The prefix of each class in the common order; place is n << 32 | position, b0 and b1 are parity bits."""
    by_value = np.argsort(hot, kind="stable")
    shared = classes.sparkSession.sparkContext.broadcast((hot[by_value], by_value))  # at most HOT_TOKENS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = shared.value
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                tokens, counts, places, bits = [], [], [], []
                for s in shingle_sets(piece.column("text"), k, seed):
                    width = len(s) - _least_overlap(len(s), num, den) + 1 if len(s) else 0
                    bits.append(parity(s))
                    if len(values) and width:
                        at = np.searchsorted(values, s)
                        at[at == len(values)] = 0
                        frequent = values[at] == s
                        if frequent.any():
                            s = np.concatenate([s[~frequent], s[frequent][np.argsort(ranks[at[frequent]])]])
                    tokens.append(s[:width])
                    counts.append(len(tokens[-1]))
                    places.append((len(s) << 32) + np.arange(counts[-1]))
                repeated = [np.repeat(piece.column(c).to_numpy(zero_copy_only=False), counts) for c in ("nid", "comp", "members")]
                yield _batch(_POSTING, np.concatenate(tokens).view(np.int64), *repeated, np.concatenate(places), *[np.repeat(b, counts) for b in np.array(bits).reshape(-1, 2).T])

    return classes.select("nid", "comp", "members", "text").mapInArrow(run, _POSTING)


class Run:
    """Postings of classes as arrays, and which of them ask which."""

    def __init__(self, nid, comp, members, place, b0, b1):
        self.nid, self.comp, self.members = nid, comp, members
        self.n, self.at, self.b0, self.b1 = place >> 32, place & 0xFFFFFFFF, b0.view(np.uint64), b1.view(np.uint64)

    def part(self, which, axis: int | None = None) -> Run:
        made = Run.__new__(Run)
        for name, x in vars(self).items():
            x = x[which]
            setattr(made, name, x[:, None] if axis else x)
        return made

    def before(self, other: Run) -> np.ndarray:
        """Which rows ask the other's: those of the smaller component, of equal ones of that with the smaller number."""
        return (self.members < other.members) | (self.members == other.members) & (self.comp < other.comp)

    def may_link(self, other: Run, num: int, den: int) -> np.ndarray:
        """What follows the token bounds the overlap; cells of different parity bound the symmetric difference."""
        n, m = self.n, other.n
        least = -(-num * (n + m) // (num + den))
        apart = np.bitwise_count(self.b0 ^ other.b0).astype(np.int64) + np.bitwise_count(self.b1 ^ other.b1)
        return (np.minimum(n - self.at, m - other.at) >= least) & (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (apart <= n + m - 2 * least)


def _pairs(a: Run, b: Run, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asking class, asked component) between the rows of a and b."""
    step = max(1, (1 << 19) // max(1, len(b.nid)))
    for k in range(0, len(a.nid), step):
        left = a.part(slice(k, k + step), 1)
        i, j = np.nonzero(left.may_link(b, num, den) & (left.comp != b.comp))
        if len(i):
            x, y = a.part(k + i), b.part(j)
            first = x.before(y)
            yield np.where(first, x.nid, y.nid), np.where(first, y.comp, x.comp)


def _meetings(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(nid, comp): queries to other components, from token runs of rows sorted by (token, place).

    Rows of runs longer than RUN_ROWS come back, with token and block, to be compared block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        heavy, block = None, 0
        out: set[tuple[int, int]] = set()

        def drain() -> pa.RecordBatch:
            nid, comp = zip(*out) if out else ((), ())
            out.clear()
            return _batch(_MET, nid, comp, *[pa.nulls(len(nid), pa.int64())] * 6)

        def put_off(cols: list[np.ndarray]) -> pa.RecordBatch:
            token, nid, comp, members, place, b0, b1 = cols
            return _batch(_MET, nid, comp, token, np.full(len(nid), block), members, place, b0, b1)

        def meet(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, rows = cols[0], Run(*cols[1:])
            edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(edge, len(token)))
            two = edge[size == 2]  # most runs: all at once
            x, y = rows.part(two), rows.part(two + 1)
            both = np.flatnonzero(x.may_link(y, num, den) & (x.comp != y.comp))
            x, y = x.part(both), y.part(both)
            first = x.before(y)
            out.update(zip(np.where(first, x.nid, y.nid).tolist(), np.where(first, y.comp, x.comp).tolist()))
            for a, r in zip(edge[size > 2].tolist(), size[size > 2].tolist()):
                part = rows.part(slice(a, a + r))
                if (part.comp == part.comp[0]).all():
                    continue
                for nid, comp in _pairs(part, part, num, den):
                    out.update(zip(nid.tolist(), comp.tolist()))
                    if len(out) >= 200_000:
                        yield drain()

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in _ROW]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            if heavy is not None:
                stop = int(np.searchsorted(cols[0], heavy, "right"))
                for k in range(0, stop, RUN_ROWS):
                    yield put_off([c[k : min(stop, k + RUN_ROWS)] for c in cols])
                    block += 1
                cols = [c[stop:] for c in cols]
                if not len(cols[0]):
                    rest = None
                    continue
                heavy = None
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on
            yield from meet([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
            if len(rest[0]) > RUN_ROWS:
                heavy, block = rest[0][0], 0
                for k in range(0, len(rest[0]), RUN_ROWS):
                    yield put_off([c[k : k + RUN_ROWS] for c in rest])
                    block += 1
                rest = None
            if len(out) >= 200_000:
                yield drain()
        if rest is not None:
            yield from meet(rest)
        if out:
            yield drain()
        trim()

    return postings.mapInArrow(run, _MET)


def _block_meetings(put_off: DataFrame, num: int, den: int) -> DataFrame:
    """The queries between blocks of long runs: blocks of one token go by size, and those too far apart never meet."""
    ask = _schema(nid=_L, comp=_L)
    keys = ["token", "i", "j"]
    blocks = put_off.groupBy("token", "block").agg(F.min(F.shiftright("place", 32)).alias("low"), F.max(F.shiftright("place", 32)).alias("high"))
    left, right = blocks.select("token", F.col("block").alias("i"), "high"), blocks.select("token", F.col("block").alias("j"), "low")
    cells = left.join(right, "token").where((F.col("i") <= F.col("j")) & (F.col("high") * den >= F.col("low") * num)).select(*keys)
    values = ["nid", "comp", "members", "place", "b0", "b1"]
    side = lambda at, s, cells: put_off.withColumnRenamed("block", at).join(cells, ["token", at]).select(*keys, F.lit(s).alias("side"), *values)
    rows = side("i", 0, cells).union(side("j", 1, cells.where("i < j")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def meet() -> Iterator[pa.RecordBatch]:
            if at is not None:
                a, b = (Run(*(np.concatenate(x) for x in zip(*h))) if h else None for h in held)
                for nid, comp in _pairs(a, a if b is None else b, num, den):
                    both = np.unique(np.stack([nid, comp]), axis=1)
                    yield _batch(ask, both[0], both[1])

        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "side", *values)}
            key = np.stack([cols[c] for c in (*keys, "side")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *cell, s = key[a].tolist()
                if cell != at:
                    yield from meet()
                    at, held = cell, ([], [])
                held[s].append([cols[c][a:b] for c in values])
        yield from meet()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, ask)


def _bounded(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Queries to groups whose union may hold enough of their tokens; rows come sorted by (gid, salt, asks), the union first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, union = None, None
        for batch in batches:
            found = []
            keys = zip(batch.column("gid").to_pylist(), batch.column("salt").to_pylist())
            for key, asks, nid, n, data in zip(keys, *(batch.column(c).to_pylist() for c in ("asks", "nid", "n")), batch.column("bits")):
                bits = _bits(data.as_py())
                if not asks:
                    at, union = key, bits
                elif key == at and most_shared(n, bits, union) >= _least_overlap(n, num, den):
                    found.append((nid, key[0]))
            if found:
                yield _batch(_ASK, *zip(*found))

    return rows.mapInArrow(run, _ASK)


class _Text:
    """A class's text with its sets of both seeds; the second is made when a link is declared."""

    def __init__(self, nid: int, text: pa.Array, first: np.ndarray):
        self.nid, self.text, self.first, self._second = nid, text, first, None

    def second(self, k: int, seed: int) -> np.ndarray:
        if self._second is None:
            (self._second,) = shingle_sets(self.text, k, seed)
        return self._second


def _open_groups(rows: DataFrame, k: int, num: int, den: int, seeds: Seeds) -> DataFrame:
    """Links of queries to members of groups; rows come sorted by (gid, salt, asks), members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                links = []
                texts = piece.column("text")
                keys = zip(piece.column("gid").to_pylist(), piece.column("salt").to_pylist())
                for i, (key, asks, nid, s) in enumerate(zip(keys, piece.column("asks").to_pylist(), piece.column("nid").to_pylist(), shingle_sets(texts, k, seeds[0]))):
                    if key != at:
                        at, members = key, []
                    one = _Text(nid, pa.array([texts[i].as_py()], pa.string()) if not asks else texts.slice(i, 1), s)
                    if not asks:
                        members.append(one)
                        continue
                    for other in members:
                        if linked(s, other.first, num, den) and linked(one.second(k, seeds[1]), other.second(k, seeds[1]), num, den):
                            links.append((nid, other.nid))
                            break
                if links:
                    yield _batch(_LINK, *zip(*links))
        trim()

    return rows.mapInArrow(run, _LINK)


def _salted(asked: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, groups' rows) with a salt, so that no task gets many more than QUERY_ROWS queries to a group."""
    load = asked.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("salts"))
    asking = asked.join(load, "gid").withColumn("salt", F.pmod(F.xxhash64("nid"), "salts").cast("int")).drop("salts").withColumn("asks", F.lit(1))
    opened = groups.join(load, "gid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumn("asks", F.lit(0))
    return asking, opened


def _links(asked: DataFrame, members: DataFrame, texts: DataFrame, k: int, num: int, den: int, seeds: Seeds) -> DataFrame:
    """The exact links of (nid, gid) to the members (nid, gid) of the groups."""
    asking, opened = _salted(asked, members)
    columns = ["gid", "salt", "asks", "nid"]
    rows = asking.select(*columns).union(opened.select(*columns)).join(texts.select(F.col("rid").alias("nid"), "text"), "nid")
    return materialize(_open_groups(rows.repartition("gid", "salt").sortWithinPartitions(*columns), k, num, den, seeds), "join-links")


def _classified(docs: DataFrame, shingle: int, num: int, den: int, carry: list[str], seeds: Seeds | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with rid, doc_id, text and the columns of ``carry`` under k_; sets; component of every class)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeds = seeds or (secrets.randbits(64), secrets.randbits(64))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"k_{c}") for c in carry]
    )
    texts = bucketed(rows.repartition(parts, "rid"), "rid", parts, "join-rows")
    made = bucketed(_sets(texts, shingle, seeds), "rid", parts, "join-sets")
    hot = _frequent(made)
    sets = made.where("rid is not null")
    numbers = sets.select(F.col("rid").alias("nid"), "n", "m0", "m1", "m2")
    signatures = sets.select(F.col("rid").alias("nid"), "n", "bits")
    named = sets.where("c1 is not null").groupBy("c1", "c2").agg(F.min("rid").alias("nid"), F.min("doc_id").alias("least"))
    named = materialize(named, "join-classes")
    classes = materialize(named.select("nid").join(numbers, "nid"), "join-numbers")

    # leaders of min-hash buckets
    keys = classes.select("nid", F.posexplode(F.array("m0", "m1", "m2")).alias("r", "bucket"))
    sizes = keys.groupBy("r", "bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    salt = F.pmod(F.xxhash64("nid"), F.ceil(F.col("c") / BUCKET_ROWS)).cast("int")
    dealt = keys.join(sizes, ["r", "bucket"]).select("nid", "r", "bucket", salt.alias("salt")).join(signatures, "nid")
    pairs = materialize(_leader_pairs(dealt.repartition("r", "bucket", "salt").sortWithinPartitions("r", "bucket", "salt", "nid"), num, den).distinct(), "join-pairs")
    leaders = pairs.select(F.col("gid").alias("nid"), "gid").distinct()
    links = _links(pairs, leaders, texts, shingle, num, den, seeds)
    known = components(links)

    # members of a component in hash order, cut into as many groups as keep them near GROUP
    groups = classes.select("nid", "n").join(known.withColumnRenamed("node", "nid"), "nid", "left").withColumnRenamed("component", "comp")
    many = groups.where("comp is not null")
    count = many.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    many = many.join(count, "comp").withColumn("cell", F.pmod(F.xxhash64("nid"), F.ceil(F.col("members") / GROUP)))
    many = materialize(many, "join-members")
    first = many.groupBy("comp", "cell").agg(F.min("nid").alias("gid"))
    columns = ["nid", "n", "comp", "members", "gid"]
    alone = groups.where("comp is null").select("nid", "n", F.col("nid").alias("comp"), F.lit(1).cast("long").alias("members"), F.col("nid").alias("gid"))
    groups = materialize(many.join(first, ["comp", "cell"]).select(*columns).union(alone.select(*columns)), "join-groups")
    unions = materialize(_unions(groups.where("members > 1").select("nid", "gid").join(signatures, "nid").repartition("gid").sortWithinPartitions("gid").select("gid", "bits")), "join-unions")

    # matrix and queries
    postings = _postings(groups.join(texts.select(F.col("rid").alias("nid"), "text"), "nid"), shingle, num, den, hot, seeds[0])
    met = materialize(_meetings(postings.repartition("token").sortWithinPartitions("token", "place"), num, den), "join-meetings")
    asked = met.where("token is null").select("nid", "comp")
    put_off = met.where("token is not null")
    if put_off.limit(1).count():
        asked = asked.union(_block_meetings(put_off, num, den))
    ranges = groups.groupBy("comp", "gid").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    asked = asked.distinct().join(classes.select("nid", F.col("n").alias("nq")), "nid").join(ranges, "comp")
    asked = materialize(asked.where((F.col("high") * den >= F.col("nq") * num) & (F.col("low") * num <= F.col("nq") * den)).select("nid", "gid"), "join-queries")

    # what a query shares with a group's union at most
    asking, opened = _salted(asked, groups.select("gid", (F.col("members") > 1).alias("many")).distinct())
    asking = asking.join(signatures, "nid")
    none = F.lit(None).cast("long")
    stored = lambda many, bits: opened.where(F.col("many") == many).join(bits, "gid").select("gid", "salt", "asks", "bits")
    opened = stored(True, unions).union(stored(False, signatures.select(F.col("nid").alias("gid"), "bits")))
    columns = ["gid", "salt", "asks", "nid", "n", "bits"]
    rows = asking.select(*columns).union(opened.withColumns({"nid": none, "n": none}).select(*columns))
    near = materialize(_bounded(rows.repartition("gid", "salt").sortWithinPartitions("gid", "salt", "asks"), num, den), "join-near")
    more = _links(near, groups.select("nid", "gid"), texts, shingle, num, den, seeds)

    final = components(links.union(more)).withColumnRenamed("node", "nid")
    named = named.join(final, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    named = materialize(named.select("c1", "c2", "component", "least"), "join-components")
    discard(classes, pairs, links, many, groups, unions, met, asked, near, more)
    return texts, sets, named


def join_classes(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, seeds: Seeds | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two documents link when den * |a & b| >= num * |a | b|.
    """
    _, sets, named = _classified(docs, shingle, num, den, [], seeds)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = materialize(named.join(least, "component").select("c1", "c2", "component_id"), "join-named")
    found = sets.select("doc_id", "n", "c1", "c2").join(known, ["c1", "c2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, seeds: Seeds | None = None) -> DataFrame:
    """One row of each component of near copies stays: that with the smallest doc_id, of several such the first.

    A row without an id stays only if no row of its component has one. Rows without shingles all stay.
    """
    rows, sets, named = _classified(docs, shingle, num, den, docs.columns, seeds)
    placed = sets.where("c1 is not null").join(named.select("c1", "c2", "component"), ["c1", "c2"])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    stay = placed.groupBy("component").agg(F.min(order)["rid"].alias("rid")).select("rid").union(sets.where("c1 is null").select("rid"))
    return rows.join(stay, "rid", "left_semi").select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])
