"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A sequence of pieces is the BPE encoding of its text exactly if every two neighbours are compatible, that
is, if merging their joined text from characters ends with these two pieces again. So the encoder walks
left to right: it takes the longest piece that starts at the position (found by one Aho-Corasick pass over
the reversed segment), checks it against its left neighbour, falls back to shorter prefixes, and when none
fits marks the position as failed in a bit field and steps back. Every position fails at most once, so the
work is linear in the text.

Pieces join only at most a run of white space with the word behind it, and many characters are in no longer
piece; the text is cut at such places first and the encodings of short segments are kept in a bounded cache.
New short segments are encoded many at once, each array operation taking one step of the walk in all of them;
long ones one by one.

Defined results: a null text counts as empty; empty text has no ids and decodes to empty; repeated rows are
encoded each by itself; output columns replace input columns of the same name; other columns pass through. Models that
are not of the merge type, that normalise or do not put a space before the text, or that have user-defined or unused
pieces are refused with a ValueError.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, trim, with_columns

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNK_SURFACE = " ⁇ "
#: Segments kept during a task: half of them new, half those that were in use before; longer ones are not kept.
CACHE_SEGMENTS, CACHED_LENGTH = 600_000, 64
#: Neighbour checks kept, and the binary logarithm of the places of their table.
CACHE_PAIRS, PLACES = 400_000, 20
#: Characters of a text encoded at once; the cut moves on to the next segment boundary.
CHUNK = 1 << 20
#: Characters of texts cut into segments at once, and segments that walk together.
GROUP, WALKERS = 1 << 21, 1 << 14
#: Bits of a symbol: the number of a piece, or behind those a character.
SYMBOL = 22
#: Odd multiplier that spreads pairs over the places.
SPREAD = 0x9E3779B97F4A7C15


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


class Codec:
    """Encoder and decoder of one merge-type model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        trainer: dict[int, object] = {}
        norm: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                scores.append(f.get(2, 0.0))
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only models of the merge type (BPE) are supported")
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24):
            raise ValueError("only identity normalisation with a space before the text is supported")
        if {USER_DEFINED, UNUSED} & set(self.types):
            raise ValueError("user-defined and unused pieces are not supported")
        self.byte_fallback = bool(trainer.get(35))
        self.unk = self.types.index(UNKNOWN)
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.surface = [{CONTROL: "", UNKNOWN: UNK_SURFACE}.get(t, p.replace(SPACE, " ")) for p, t in zip(self.pieces, self.types)]
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else s.encode() for i, s in enumerate(self.surface)]
        first = [r[1:] if t == NORMAL and p.startswith(SPACE) else r for r, p, t in zip(raw, self.pieces, self.types)]
        #: Bytes of every id, and of every id at the start of a text.
        self.raw = pa.array(raw + first, pa.large_binary())
        self.control = np.array([t == CONTROL for t in self.types])
        self._prepare(scores)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _prepare(self, scores: list[float]) -> None:
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        #: Lower merges first. Characters need no merge.
        self.rank = {p: order[scores[i]] for p, i in self.ids.items() if len(p) > 1}
        shared = len(self.rank) - len(set(self.rank.values()))
        often = {}
        for r in self.rank.values() if shared else ():
            often[r] = often.get(r, 0) + 1
        self.split: dict[str, tuple[str, str]] = {}
        #: Pieces in whose merge tree ranks rise strictly, so that ranks are times.
        self.timed: set[str] = set()
        used = {SPACE}.union(*self.rank)
        #: A character in no piece, put between segments; as a word itself it keeps the automaton from being empty.
        self.gap = next(c for c in map(chr, range(1, 0x110000)) if c not in used)
        automaton = ahocorasick.Automaton()
        automaton.add_word(self.gap, -1)
        for p in sorted(self.rank, key=len):
            found, last = self.merge(p)
            if len(found) != 1:
                continue
            automaton.add_word(p[::-1], len(self.split))
            self.split[p] = last
            if often.get(self.rank[p], 1) == 1 and all(len(x) == 1 or x in self.timed and self.rank[x] < self.rank[p] for x in last):
                self.timed.add(p)
        self.shorter: dict[str, str] = {}
        for p in self.split:
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.split), p[0])
        automaton.make_automaton()
        self.automaton = automaton
        inner = {c for p in self.split for c in p} - {SPACE}
        #: Then spaces are no boundary.
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.split)
        self.uncut = self.whole or not inner
        #: 2 for the space, 1 for other characters of pieces, 0 for those in no longer piece.
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[[ord(c) for c in inner]] = 1
        self.kind[ord(SPACE)] = 2
        self.pairs: dict[tuple[str, str], bool] = {}
        # The same for walks in arrays, where symbols are numbers; the last entry stands for all characters.
        self.names = list(self.split)
        number = {p: i for i, p in enumerate(self.names)}
        self.sizes = np.array([*map(len, self.names), 1])
        self.less = np.array([*(number.get(self.shorter[p], len(number) + ord(p[0])) for p in self.names), -1])
        self.piece_ids = np.array([self.ids[p] for p in self.names], np.int32)
        #: Open addressing: each entry is a pair of symbols and, as the lowest bit, whether they are compatible.
        self.table, self.kept = np.full(1 << PLACES, -1), 0

    def forget(self) -> None:
        """Empty the caches that grow with the text; a worker may run other tasks next."""
        self.cache, self.older = {}, {}
        self.pairs.clear()

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging from characters: best rank first, leftmost of equals. Also the last merge."""
        parts, last, rank = list(text), None, self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` from characters gives these two pieces.

        Walks back in time along the two inner edges of their merge trees: at each moment the two pieces that
        touch must not merge before their own parents take them. Pieces with equal ranks are merged plainly.
        """
        timed = self.timed
        if (len(left) > 1 and left not in timed) or (len(right) > 1 and right not in timed):
            return self.merge(left + right)[0] == [left, right]
        rank, split = self.rank, self.split
        until_l = until_r = len(rank) + 1
        made_l = rank[left] if len(left) > 1 else -1
        made_r = rank[right] if len(right) > 1 else -1
        while True:
            r = rank.get(left + right)
            if r is not None and r < until_l and r <= until_r:
                return False
            if made_l > made_r:  # of two equal merges the left one came first
                until_l, left = made_l, split[left][1]
                made_l = rank[left] if len(left) > 1 else -1
            elif made_r >= 0:
                until_r, right = made_r, split[right][0]
                made_r = rank[right] if len(right) > 1 else -1
            else:
                return True

    def backtrack(self, segment: str) -> list[str]:
        n = len(segment)
        longest: list[str | None] = [None] * n
        for end, number in self.automaton.iter(segment[::-1]):  # the longest of those that end together is first
            if longest[-1 - end] is None and number >= 0:
                longest[-1 - end] = self.names[number]
        failed = bytearray((n >> 3) + 1)
        shorter, pairs = self.shorter, self.pairs
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        tokens: list[str] = []
        at, piece = 0, longest[0] or segment[0]
        while True:
            before = tokens[-1] if tokens else None
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if before is None:
                        break
                    fits = pairs.get((before, piece))
                    if fits is None:
                        fits = pairs[before, piece] = self.compatible(before, piece)
                    if fits:
                        break
                piece = shorter.get(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = tokens.pop()
                at -= len(piece)
                continue
            tokens.append(piece)
            at = end
            if at == n:
                return tokens
            piece = longest[at] or segment[at]

    def symbol(self, number: int) -> str:
        return self.names[number] if number < len(self.names) else chr(number - len(self.names))

    def compatible_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs of symbols."""
        pair = left.astype(np.int64) << SYMBOL | right
        fits = np.zeros(len(pair), bool)
        todo, place, absent = np.arange(len(pair)), (pair.astype(np.uint64) * np.uint64(SPREAD) >> np.uint64(64 - PLACES)).astype(np.int64), []
        while len(todo):
            seen = self.table[place]
            known = seen >> 1 == pair[todo]
            fits[todo[known]] = seen[known] & 1
            absent.append(todo[seen < 0])
            on = (seen >= 0) & ~known
            todo, place = todo[on], place[on] + 1 & (1 << PLACES) - 1
        absent = np.concatenate(absent) if absent else todo
        if len(absent):
            new, which = np.unique(pair[absent], return_inverse=True)
            if self.kept + len(new) > CACHE_PAIRS:
                self.table.fill(-1)
                self.kept = 0
            found, cells = [], memoryview(self.table)
            for p in new.tolist():
                found.append(self.compatible(self.symbol(p >> SYMBOL), self.symbol(p & (1 << SYMBOL) - 1)))
                at = (p * SPREAD & (1 << 64) - 1) >> 64 - PLACES
                while cells[at] >= 0:
                    at = at + 1 & (1 << PLACES) - 1
                cells[at] = p << 1 | found[-1]
            self.kept += len(new)
            fits[absent] = np.array(found)[which]
        return fits

    def backtrack_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``backtrack`` of many segments, one step of each at a time: all symbols, and where each segment's end."""
        joined, count = self.gap.join(segments), len(self.names)
        n, size = len(joined), np.fromiter(map(len, segments), np.int64, len(segments))
        last = np.cumsum(size + 1) - 1
        longest = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64) + count
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined[::-1])), np.int32).reshape(-1, 2)
        found = found[np.append(True, found[1:, 0] != found[:-1, 0])[: len(found)] & (found[:, 1] >= 0)]
        longest[n - 1 - found[:, 0]] = found[:, 1]
        closed, failed = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        closed[last] = True
        ending = np.full(n + 1, -1)  # the symbol that ends at each position
        at = last - size
        piece = longest[at]
        while len(at):
            which = np.minimum(piece, count)
            end, before = at + self.sizes[which], ending[at]
            good = ~failed[end]
            ask = np.flatnonzero(good & (before >= 0))
            good[ask] = self.compatible_all(before[ask], piece[ask])
            on, back = end[good], at[~good]
            ending[on] = piece[good]
            on = on[~closed[on]]
            other = self.less[which[~good]]
            if (none := other < 0).any():
                stuck = back[none]
                failed[stuck] = True
                other[none] = ending[stuck]
                ending[stuck] = -1
                back[none] = stuck - self.sizes[np.minimum(other[none], count)]
            at, piece = np.concatenate([on, back]), np.concatenate([longest[on], other])
        ends = np.flatnonzero(ending >= 0)
        return ending[ends], np.searchsorted(ends, last, "right")

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(segments), WALKERS):
            symbols, stops = self.backtrack_all(segments[k : k + WALKERS])
            count = len(self.names)
            chars, which = np.unique(symbols[symbols >= count], return_inverse=True)
            spelt = [self.spell(chr(c - count)) for c in chars.tolist()]
            pool = np.concatenate([self.piece_ids, np.array([i for ids in spelt for i in ids], np.int32)])
            many = np.ones(len(symbols), np.int64)
            if spelt:
                lengths = np.array([len(ids) for ids in spelt])
                many[symbols >= count] = lengths[which]
                symbols[symbols >= count] = (count + np.cumsum(lengths) - lengths)[which]
            until = np.append(0, np.cumsum(many))
            ids = pool[np.repeat(symbols - until[:-1], many) + np.arange(until[-1])].tobytes()
            cuts = [0, *(4 * until[stops]).tolist()]
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def spell(self, piece: str) -> list[int]:
        """The ids of a piece or character."""
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_fallback else [self.unk]

    def encode_segment(self, segment: str) -> bytes:
        return array("i", [i for piece in self.backtrack(segment) for i in self.spell(piece)]).tobytes()

    def _chunks(self, text: str) -> Iterator[str]:
        at, n = 0, len(text)
        while n - at > CHUNK and not self.whole:
            cut = text.find(SPACE, at + CHUNK)
            while cut > 0 and text[cut - 1] == SPACE:
                cut = text.find(SPACE, cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _groups(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        owners, chunks, size = [], [], 0
        for i, text in enumerate(texts):
            for chunk in self._chunks(SPACE + text.replace(" ", SPACE)) if text else ():
                owners.append(i)
                chunks.append(chunk)
                size += len(chunk)
                if size >= GROUP:
                    yield owners, chunks
                    owners, chunks, size = [], [], 0
        if chunks:
            yield owners, chunks

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and the number of each chunk's."""
        joined = "".join(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths) - lengths
        begins = np.zeros(len(joined), bool)
        if not self.uncut:  # a character in no piece stands alone, spaces begin a segment, others go on
            kind = self.kind[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
            begins[1:] = (kind[1:] == 0) | (kind[1:] > kind[:-1])
        begins[starts] = True
        begins = np.flatnonzero(begins)
        data = np.frombuffer(joined.encode(), np.uint8)
        offsets = np.append(np.flatnonzero(data & 0xC0 != 0x80)[begins], len(data))
        found = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        segments = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        young, old = self.cache, self.older
        ids = list(map(young.get, segments))
        fresh, places = [], []
        for k in [k for k, x in enumerate(ids) if x is None]:
            s = segments[k]
            if (known := old.get(s)) is not None:
                ids[k] = young[s] = known
            elif len(s) <= CACHED_LENGTH:
                fresh.append(s)
                places.append(k)
            else:
                ids[k] = self.encode_segment(s)
        for k, s, x in zip(places, fresh, self.encode_segments(fresh)):
            ids[k] = young[s] = x
        if len(young) > CACHE_SEGMENTS // 2:
            self.cache, self.older = {}, {s: x for s, x in young.items() if len(s) <= 24}
        taken = pa.array(ids, pa.large_binary()).take(found.indices)
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(begins) + 1] >> 2
        bounds = at[np.append(np.searchsorted(begins, starts), len(begins))]
        return np.frombuffer(taken.buffers()[2], np.int32)[: at[-1]], np.diff(bounds)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the bounds of each text's (one more than there are texts)."""
        parts, lengths = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for owners, chunks in self._groups(texts):
            found, counts = self._encode_chunks(chunks)
            parts.append(found)
            np.add.at(lengths, owners, counts)
        ids, bounds = np.concatenate(parts), np.append(0, np.cumsum(lengths))
        if not self.byte_fallback and len(ids):  # neighbouring unknown characters are one id
            keep = np.append(True, (ids[1:] != self.unk) | (ids[:-1] != self.unk))
            keep[bounds[:-1][lengths > 0]] = True
            ids, bounds = ids[keep], np.append(0, np.cumsum(keep))[bounds]
        return ids, bounds

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """``decode`` of many id lists that lie end to end, with their bounds (one more than there are lists).

        The bytes of all ids in a row are the text wherever they are valid UTF-8, as every other piece is so by itself.
        """
        n, some = len(bounds) - 1, bounds[1:] > bounds[:-1]
        first = np.zeros(len(ids), np.int64)
        first[bounds[:-1][some]] = len(self.pieces)
        taken = self.raw.take(pa.array(ids + first))
        at = np.frombuffer(taken.buffers()[1], np.int64)[bounds] if len(ids) else bounds
        data = memoryview(taken.buffers()[2])[: at[-1]] if at[-1] else memoryview(b"")
        heads = np.frombuffer(data, np.uint8)[at[:-1][at[1:] > at[:-1]]]
        if at[-1] < 1 << 31 and not self.control[ids].any() and not (heads & 0xC0 == 0x80).any():
            try:
                str(data, "utf-8")
                return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
            except UnicodeDecodeError:
                pass
        texts = []
        for a, b, i, j in zip(at.tolist(), at[1:].tolist(), bounds.tolist(), bounds[1:].tolist()):
            try:
                texts.append(self.decode(ids[i:j].tolist()) if self.control[ids[i:j]].any() else str(data[a:b], "utf-8"))
            except UnicodeDecodeError:
                texts.append(self.decode(ids[i:j].tolist()))
        return pa.array(texts, pa.string())

    def decode(self, ids) -> str:
        """As the library does: one space at the start goes, runs of byte pieces are read as UTF-8."""
        if not len(ids):
            return ""
        surface, byte_of = self.surface, self.byte_of
        if not byte_of or byte_of.keys().isdisjoint(ids):
            text = "".join(map(surface.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(utf8(bytes(run)))
                    run.clear()
                parts.append(surface[i])
            if run:
                parts.append(utf8(bytes(run)))
            text = "".join(parts)
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        return text[1:] if first is not None and self.types[first] == NORMAL and self.pieces[first].startswith(SPACE) else text


def utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no valid character gives one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for k in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + k].decode())
                    at += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, loaded once per process."""
    if path not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path] = Codec(f.read())
    return _CODECS[path]


def _extended(df: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()])


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of every whole text, and with ``decoded`` also their decoding (one pass, no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for part in slices(batch, text):
                found, bounds = c.encode_all(part.column(text).to_pylist())
                new = {ids: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))}
                if decoded:
                    new[decoded] = c.decode_all(found, bounds)
                yield with_columns(part, new)
        c.forget()
        trim()

    new = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    return df.mapInArrow(run, _extended(df, new))


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of every id list; null or empty lists give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            yield with_columns(batch, {text: pa.array([c.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.string())})

    return df.mapInArrow(run, _extended(df, {text: T.StringType()}))
