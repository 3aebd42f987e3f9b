"""Statistics of whole texts, computed in an Arrow function with whole-buffer byte operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, trim, with_columns

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
#: bytes.split() without arguments splits at exactly these six.
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 8
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = h[:n] * _POWERS[0]
    for k in range(1, WINDOW):
        windows += h[k : n + k] * _POWERS[k]
    in_order = np.sort(windows)
    same = in_order[1:] == in_order[:-1]
    if not same.any():
        return 0
    twice = np.isin(windows, in_order[1:][same])
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW : n + WINDOW] -= twice
    return int((np.cumsum(edge) > 0).sum())


RULE_STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_stops"]


def rule_stats(text: str | None) -> tuple:
    """Values of RULE_STATS; a null text counts as empty."""
    if not text:
        return (0,) * len(RULE_STATS)
    data = text.encode()
    size = len(data)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()] if b"\n" in data else [data] * bool(words)
    return (
        len(words),
        len(text) - (size - len(data.translate(None, SPACES))),
        size - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        size - len(data.translate(None, UPPER)),
        data.count(b".") + data.count(b",") + data.count(b"!"),
    )


FEATURES = [
    "log_words", "word_length", "distinct", "symbols", "upper", "digits", "bangs", "pipes", "stops", "commas", "questions", "slashes", "ats", "quotes",
    "lines", "line_words", "dup_lines", "repeats", "non_ascii", "longest", "controls", "brackets",
]


def features(text: str | None) -> tuple:
    """Values of FEATURES: sizes and shares that do not depend on language, source or id."""
    if not text:
        return (0.0,) * len(FEATURES)
    data = text.encode()
    size, chars = len(data), len(text)
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    m = max(1, len(lines))
    count = data.count
    return (
        float(np.log1p(len(words))),
        chars / n,
        len(set(words)) / n,
        (size - len(data.translate(None, SYMBOLS))) / n,
        (size - len(data.translate(None, UPPER))) / n,
        (size - len(data.translate(None, DIGITS))) / n,
        count(b"!") / n,
        count(b"|") / n,
        count(b".") / n,
        count(b",") / n,
        count(b"?") / n,
        count(b"/") / n,
        count(b"@") / n,
        count(b'"') / n,
        m / n,
        float(np.log1p(n / m)),
        1.0 - len(set(lines)) / m,
        repeated_words(words) / n,
        (size - chars) / n,
        float(np.log1p(max(map(len, words), default=0))),
        (size - len(data.translate(None, bytes(range(9)) + bytes(range(14, 32))))) / n,
        (count(b"(") + count(b"[") + count(b"{")) / n,
    )


def add_stats(df: DataFrame, f: Callable[[str | None], tuple], names: list[str], kind: T.DataType, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Replace the text by one column per statistic, or with ``keep_text`` add them."""
    arrow = pa.float64() if isinstance(kind, T.DoubleType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows = [f(t) for t in part.column(text).to_pylist()]
                kept = part if keep_text else part.select([c for c in part.schema.names if c != text])
                yield with_columns(kept, {name: pa.array(column, arrow) for name, column in zip(names, zip(*rows))})
        trim()

    schema = [x for x in df.schema.fields if (keep_text or x.name != text) and x.name not in names] + [T.StructField(n, kind) for n in names]
    return df.mapInArrow(run, T.StructType(schema))
