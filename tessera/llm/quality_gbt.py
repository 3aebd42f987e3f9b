"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Statistics of every whole text are computed where the text is read and written as a narrow table; labelled
rows of that table train the trees on the driver, and all rows are scored with the trees laid out in flat
arrays, so that a batch walks one level of all trees with a few numpy gathers.

Training uses about ``max_rows`` labelled ids at most, those whose hash is below a threshold that follows from their
number, so no more than that ever leaves the executors; scores cover all rows. Everything is deterministic.

Defined results: a null or empty text has all statistics 0 and gets a score; labels that are null, or differ
for one id, are not learnt from; repeated documents are scored each, and of several rows of one id the one with the
smallest statistics is learnt from; ids without a document are ignored; other columns are ignored; if no
label can be learnt from, every score is 0.5, and if all agree it is near that label. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, trim
from .textstats import FEATURES, add_stats, features


#: Labelled ids to learn from, about, at most.
MAX_ROWS = 40_000


@dataclass
class Trees:
    """All trees in flat arrays; ``left`` of a leaf is the leaf itself. ``roots`` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), block):
            part = x[a : a + block]
            rows = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[a : a + block] = self.base + self.value[at].sum(1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges of at most ``bins`` bins per column, between neighbouring values."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
        edges.append((values[1:] + values[:-1]) / 2)
    return edges


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, leaf_rows: int = 20, l2: float = 1.0) -> Trees:
    """Boosting of the logistic loss; a split takes the best gain over all features' histograms."""
    p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base = float(np.log(p / (1 - p)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.mean() < 1:
        edges = bin_edges(x, bins)
        codes = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], 1)  # value <= edge k: code <= k
        width = bins + 1
        offset = np.arange(x.shape[1]) * width
        raw = np.full(len(y), base)
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            roots.append(len(nodes))
            nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            open_nodes = [(roots[-1], np.arange(len(y)), 0)]
            while open_nodes:
                node, rows, level = open_nodes.pop()
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = None
                if level < depth and len(rows) >= 2 * leaf_rows:
                    flat = (codes[rows] + offset).ravel()
                    size = width * x.shape[1]
                    reps = x.shape[1]
                    hg = np.bincount(flat, np.repeat(g[rows], reps), size).reshape(-1, width).cumsum(1)
                    hh = np.bincount(flat, np.repeat(h[rows], reps), size).reshape(-1, width).cumsum(1)
                    hn = np.bincount(flat, minlength=size).reshape(-1, width).cumsum(1)
                    gain = hg**2 / (hh + l2) + (total_g - hg) ** 2 / (total_h - hh + l2) - total_g**2 / (total_h + l2)
                    gain[(hn < leaf_rows) | (len(rows) - hn < leaf_rows)] = -1
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        best = (int(f), int(b))
                if best is None:
                    value = -rate * total_g / (total_h + l2)
                    nodes[node][4] = value
                    raw[rows] += value
                    continue
                f, b = best
                goes_left = codes[rows, f] <= b
                l, r = len(nodes), len(nodes) + 1
                nodes.append([0, np.inf, l, l, 0.0])
                nodes.append([0, np.inf, r, r, 0.0])
                nodes[node][:4] = [f, edges[f][b], l, r]
                open_nodes += [(l, rows[goes_left], level + 1), (r, rows[~goes_left], level + 1)]
    if not nodes:
        nodes, roots = [[0, np.inf, 0, 0, 0.0]], [0]
    c = list(zip(*nodes))
    return Trees(np.array(c[0], np.int32), np.array(c[1]), np.array(c[2], np.int32), np.array(c[3], np.int32), np.array(c[4]), np.array(roots, np.int32), depth, base)


def document_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The statistics of every whole text beside the columns of ``keep``; written once, as it is read twice."""
    return materialize(add_stats(docs.select(*keep, "text"), features, FEATURES, T.DoubleType()), "quality-features")


def sampled_labels(labels: DataFrame, usable, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, y) of about ``max_rows`` ids at most whose label can be learnt from, by their hash."""
    known = labels.where(F.col("quality").isin(0, 1) & usable).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("doc_id", "y")
    share = max_rows / max(1, known.count())
    return known if share >= 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(share * (1 << 31)))


def fit_rows(stats: DataFrame, sample: DataFrame) -> Trees:
    """Trees from the statistics (doc_id, FEATURES) of the sample's ids, one row for each id."""
    rows = stats.join(F.broadcast(sample), "doc_id")  # sampled_labels bounds its size
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"), F.first("y").alias("y"))
    found = rows.select("doc_id", "x.*", "y").toPandas().sort_values("doc_id")
    return fit(found[FEATURES].to_numpy(float), found["y"].to_numpy(float))


def train(stats: DataFrame, labels: DataFrame, usable, max_rows: int = MAX_ROWS) -> Trees:
    """Trees for ``labels`` (doc_id, quality); only rows where ``usable`` (a column of doc_id) holds are learnt."""
    return fit_rows(stats, sampled_labels(labels, usable, max_rows))


def train_on_documents(docs: DataFrame, labels: DataFrame, usable, max_rows: int = MAX_ROWS) -> Trees:
    """As ``train``, from documents: statistics are computed of the sample's documents alone."""
    sample = materialize(sampled_labels(labels, usable, max_rows), "quality-sample")
    some = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    return fit_rows(add_stats(some, features, FEATURES, T.DoubleType()), sample)


def score(stats: DataFrame, trees: Trees, out: str = "score") -> DataFrame:
    """Replace the statistics by the score. The trees are at most rounds * 2**(depth + 1) nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], 1) if batch.num_rows else np.zeros((0, len(FEATURES)))
            names = [n for n in batch.schema.names if n not in FEATURES and n != out]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(trees.score(x))], names=[*names, out])

    schema = [f for f in stats.schema.fields if f.name not in FEATURES and f.name != out]
    return stats.mapInArrow(run, T.StructType([*schema, T.StructField(out, T.DoubleType())]))


def accepted(docs: DataFrame, trees: Trees, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, judged where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = np.array([features(t) for t in part.column(text).to_pylist()], float).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(trees.score(x) >= threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)


def learnable(doc_id=None):
    """Rows to learn from: those whose CRC-32 of the id's decimal text leaves another remainder by 3 than 1."""
    c = F.col("doc_id") if doc_id is None else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 3 != 1
