"""Quality rules: fixed base rules, then robust outliers of each language and source.

Every document that passes the base rules has a vector of transformed statistics. For each (language, source) the
regularised minimum-covariance-determinant estimate of centre and scatter is sought over all its rows: of the subsets of
``share`` of the rows, the one whose covariance, with a floor added, has the smallest determinant. The search starts from
four robust estimates (medians and deviations; all rows; correlations of squashed values; correlations of directions) and
concentrates: distances to the present estimate, then mean and covariance of exactly the nearest share of rows. Each step
lowers the determinant. After ``first_steps`` the best ``go_on`` starts of each group go on until theirs falls no more, and
the smallest wins: a local minimum, which following all four to their ends may lower a little. Documents whose squared Mahalanobis distance is above ``cutoff`` are rejected.

Equal vectors are one row with a weight. A step is a few aggregations over all rows: counts by fine bins of log distance
give the bin in which the share ends, and only that bin's rows (about a six-hundredth of a group) are ordered, by
distance, then vector. All others meet the small table of estimates where they are read, and leave as partial sums. So the
largest group costs no more than any other rows, nothing is sampled, and ties are cut alike in each run. Tables with a few
rows for each group are written as few files: the footers of hundreds would pass for a table too large to be sent to all tasks,
and every step would shuffle all rows by group, in stages whose tasks add up in the driver. Only estimates that are by
themselves larger than the engine's broadcast threshold still make a step do so.

A floor added to the variances, the resolution of the statistics in the shortest text that passes the base rules,
keeps statistics that are the same in most of a group (no symbols at all) from rejecting deviations of one count. Groups
of fewer than ``min_rows`` rows are estimated together by language, and languages of fewer than that together.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are
groups of their own; repeated rows count each; empty tables give empty results; a group of one is kept; other columns
are ignored, and one to be kept that has the name of a result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, few, materialize
from .textstats import RULE_STATS, add_stats, rule_stats

VECTOR = ["v_length", "v_symbols", "v_upper", "v_stops", "v_lines", "v_repeats"]
#: Words of the shortest text that passes the base rules.
MIN_WORDS = 20
#: Standard deviations, in the transformed units below, that are never counted as strange: one character, mark,
#: capital, stop, repeated line or repeated word more or less in MIN_WORDS words (a word has a character at least).
FLOOR = [log1p(1 + 1 / MIN_WORDS) - log1p(1), *[log1p(1 / MIN_WORDS)] * 3, *[1 / MIN_WORDS] * 2]
#: Squared distance that one of a million rows passes if the vectors are normal (chi-square, 6 degrees of freedom).
CUTOFF = 38.26
#: Grid of the medians: cells per unit; the transformed statistics lie in 0 to a few units.
GRID = 256
#: Bins of distance for each doubling, and what is added to distances before logarithms.
PER_DOUBLING, LEAST = 256, 1e-9
#: Steps of all starts, starts that go on, and the fall of a log determinant that counts.
FIRST_STEPS, GO_ON, SETTLED = 2, 2, 1e-7


def vector(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "v_length": F.log1p(F.col("word_chars") / n),
            "v_symbols": F.log1p(F.col("n_symbols") / n),
            "v_upper": F.log1p(F.col("n_upper") / n),
            "v_stops": F.log1p(F.col("n_stops") / n),
            "v_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "v_repeats": F.col("n_repeat_words") / n,
        }
    )


def _chi2(x: float, d: int) -> float:
    """Distribution of chi-square with an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - exp(-x / 2) * total


def _consistency(share: float, d: int) -> float:
    """Factor by which the covariance of the nearest ``share`` falls short of the whole's."""
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, d) < share else (low, mid)
    return share / _chi2(low, d + 2)


def _placed(rows: DataFrame, now: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """The rows beside their group's estimates: other columns of both, offsets u_i from the centre, and d2, the squared distance."""
    d = len(VECTOR)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    centre = {f"e_{i}": F.col("centre")[i] for i in range(d)}
    # plain columns, taken from the arrays in the small table: the code for a row stays small enough to be compiled
    inverse = {f"e_{i}_{j}": F.col("inverse")[i * d + j] * (1 if i == j else 2) for i, j in pairs}
    known = rows.join(now.withColumns(centre | inverse).drop("centre", "inverse", "logdet"), key, how)
    known = known.withColumns({f"u_{i}": F.col(v) - F.col(f"e_{i}") for i, v in enumerate(VECTOR)})
    total = F.lit(0.0)
    for i in range(d):
        line = F.col(f"e_{i}_{i}") * F.col(f"u_{i}")
        for j in range(i + 1, d):
            line = line + F.col(f"e_{i}_{j}") * F.col(f"u_{j}")
        total = total + F.col(f"u_{i}") * line
    return known.withColumn("d2", F.greatest(total, F.lit(0.0))).drop(*centre, *inverse)


_ESTIMATE = T.StructType(
    [T.StructField("gid", T.LongType()), T.StructField("start", T.IntegerType())]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("centre", "inverse")] + [T.StructField("logdet", T.DoubleType())]
)


def _regularised(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inverse, log determinant) of covariances with the floor added."""
    full = cov + np.diag(np.square(FLOOR))
    return np.linalg.inv(full), np.linalg.slogdet(full)[1]


def _moments(u: list[Column], weight: Column, tag: str = "") -> list[Column]:
    d = len(u)
    return [F.sum(weight * u[i]).alias(f"s{tag}_{i}") for i in range(d)] + [F.sum(weight * u[i] * u[j]).alias(f"s{tag}_{i}_{j}") for i in range(d) for j in range(i, d)]


def _mean_cov(batch: pa.RecordBatch, n: np.ndarray, tag: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Means, and covariances, of the sums of a batch's rows."""
    d = len(VECTOR)
    get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    mean = np.stack([get(f"s{tag}_{i}") for i in range(d)], 1) / n[:, None]
    cov = np.zeros((len(n), d, d))
    for i in range(d):
        for j in range(i, d):
            cov[:, i, j] = cov[:, j, i] = get(f"s{tag}_{i}_{j}") / n - mean[:, i] * mean[:, j]
    return mean, cov


def _rows_of(gid: pa.Array, start: pa.Array | int, centre: np.ndarray, cov: np.ndarray) -> pa.RecordBatch:
    inverse, logdet = _regularised(cov)
    start = pa.array(np.full(len(gid), start, np.int32)) if isinstance(start, int) else start
    return pa.RecordBatch.from_arrays([gid, start, pa.array(centre.tolist()), pa.array(inverse.reshape(len(gid), -1).tolist()), pa.array(logdet)], names=_ESTIMATE.names)


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """From (gid, start, n, s_i, s_i_j) with sums about the old ``centre`` to new centre and inverse covariance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mean, cov = _mean_cov(batch, batch.column("n").to_numpy(zero_copy_only=False).astype(float))
                yield _rows_of(batch.column("gid"), batch.column("start"), np.array(batch.column("centre").to_pylist()) + mean, cov * factor)

    return sums.mapInArrow(run, _ESTIMATE)


def _medians(rows: DataFrame) -> DataFrame:
    """(gid, median, mad): arrays of each coordinate's median and median deviation, from counts on a grid."""

    def medians(counts: DataFrame) -> DataFrame:
        w = Window.partitionBy("gid", "i")
        counts = counts.withColumn("below", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
        return counts.where("2 * below >= all").groupBy("gid", "i").agg((F.min("cell") / GRID).alias("median"))

    cells = rows.select("gid", "w", F.posexplode(F.array(*[F.round(F.col(v) * GRID) for v in VECTOR])).alias("i", "cell"))
    counts = materialize(few(cells.groupBy("gid", "i", "cell").agg(F.sum("w").alias("n"))), "rule-cells")
    centre = materialize(few(medians(counts)), "rule-centres")
    away = counts.join(centre, ["gid", "i"]).withColumn("cell", F.abs(F.col("cell") - F.round(F.col("median") * GRID)))
    both = centre.join(medians(away.groupBy("gid", "i", "cell").agg(F.sum("n").alias("n"))).withColumnRenamed("median", "mad"), ["gid", "i"])
    x = F.sort_array(F.collect_list(F.struct("i", "median", "mad")))
    return both.groupBy("gid").agg(F.transform(x, lambda y: y["median"]).alias("median"), F.transform(x, lambda y: y["mad"]).alias("mad"))


def _starts(rows: DataFrame) -> DataFrame:
    """The four estimates the search starts from."""
    d, floor = len(VECTOR), np.array(FLOOR)
    medians = materialize(few(_medians(rows)), "rule-medians")
    unit = [F.sqrt(F.pow(F.col("mad")[i] * 1.4826, 2) + FLOOR[i] ** 2) for i in range(d)]
    units = medians.select("gid", *[F.col("median")[i].alias(f"m{i}") for i in range(d)], *[c.alias(f"d{i}") for i, c in enumerate(unit)])
    known = rows.join(units, "gid").select("gid", "w", *[((F.col(v) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, v in enumerate(VECTOR)])
    z = [F.col(f"z{i}") for i in range(d)]
    squares = z[0] * z[0]
    for c in z[1:]:
        squares = squares + c * c
    known = known.withColumn("length", F.sqrt(squares) + 1e-12)
    kinds = {"a": z, "b": [F.tanh(c) for c in z], "c": [c / F.col("length") for c in z]}
    known = known.select("gid", "w", *[c.alias(f"{tag}{i}") for tag, u in kinds.items() for i, c in enumerate(u)])
    moments = [m for tag in kinds for m in _moments([F.col(f"{tag}{i}") for i in range(d)], F.col("w"), tag)]
    sums = few(known.groupBy("gid").agg(F.sum("w").alias("n"), *moments)).join(medians, "gid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gid, n = batch.column("gid"), batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            median, mad = (np.array(batch.column(c).to_pylist()) for c in ("median", "mad"))
            unit = np.sqrt(np.square(mad * 1.4826) + np.square(floor))
            outer = unit[:, :, None] * unit[:, None, :]
            yield _rows_of(gid, 0, median, outer * np.eye(d))
            mean, cov = _mean_cov(batch, n, "a")
            yield _rows_of(gid, 1, median + unit * mean, outer * cov)
            for start, tag in ((2, "b"), (3, "c")):
                mean, cov = _mean_cov(batch, n, tag)
                yield _rows_of(gid, start, median, outer * _correlation(cov if tag == "b" else cov + mean[:, :, None] * mean[:, None, :]))

    return sums.mapInArrow(run, _ESTIMATE)


def _correlation(cov: np.ndarray) -> np.ndarray:
    """Covariances scaled to ones on the diagonal; a coordinate without variance is uncorrelated."""
    d = cov.shape[-1]
    spread = np.sqrt(np.maximum(np.einsum("nii->ni", cov), 0))
    flat = spread < 1e-9
    spread[flat] = 1
    out = cov / (spread[:, :, None] * spread[:, None, :])
    out[flat[:, :, None] | flat[:, None, :]] = 0
    out[:, range(d), range(d)] = 1
    return out


def _step(rows: DataFrame, now: DataFrame, share: float, factor: float) -> DataFrame:
    """Estimates from exactly the nearest share of each group's rows, ties by vector."""
    key = ["gid", "start"]
    bin_of = F.floor(F.log2(F.col("d2") + LEAST) * PER_DOUBLING)
    counts = few(_placed(rows, now, ["gid"]).groupBy(*key, bin_of.alias("bin")).agg(F.sum("w").alias("n")))
    w = Window.partitionBy(*key)
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("wanted", F.ceil(F.sum("n").over(w) * F.lit(share)))
    cut = counts.where("upto >= wanted").groupBy(*key).agg(F.min(F.struct("bin", (F.col("wanted") - F.col("upto") + F.col("n")).alias("need"))).alias("cut"))
    ends = materialize(now.join(few(cut.select(*key, F.col("cut")["bin"].alias("last"), F.col("cut")["need"].alias("need"))), key), "rule-ends")
    known = _placed(rows, ends, ["gid"]).withColumn("bin", bin_of)
    before = F.coalesce(F.sum("w").over(w.orderBy("d2", *VECTOR).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = few(known.where("bin = last").withColumn("left", F.col("need") - before).where("left > 0").withColumn("w", F.least("w", "left")))
    sums = [F.sum("w").alias("n"), *_moments([F.col(f"u_{i}") for i in range(len(VECTOR))], F.col("w"))]
    used = [*key, "w", *[f"u_{i}" for i in range(len(VECTOR))]]
    whole = few(known.where("bin < last").select(used).union(edge.select(used)).groupBy(*key).agg(*sums))
    return _estimates(whole.join(now.select(*key, "centre"), key), factor)


def concentrated(rows: DataFrame, share: float = 0.75, first_steps: int = FIRST_STEPS, go_on: int = GO_ON) -> DataFrame:
    """(gid, start, centre, inverse, logdet): the estimate of each group of ``rows`` (gid, the vector, w: how often)."""
    factor = _consistency(share, len(VECTOR))
    key, names = ["gid", "start"], _ESTIMATE.names
    now = materialize(_starts(rows), "rule-estimate")
    for _ in range(first_steps):
        now = materialize(_step(rows, now, share, factor), "rule-estimate")
    rank = Window.partitionBy("gid").orderBy("logdet", "start")
    best = lambda few: now.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= few).select(names)
    now = materialize(few(best(go_on).withColumn("moving", F.lit(True))), "rule-estimate")
    while True:  # ends: determinants of finitely many subsets fall
        before = now
        new = _step(rows, before.where("moving").select(names), share, factor)
        new = new.join(before.select(*key, F.col("logdet").alias("was")), key).withColumn("moving", F.col("was") - F.col("logdet") > SETTLED)
        now = materialize(few(new.select(*names, "moving").union(before.where("not moving"))), "rule-estimate")
        discard(before)
        if now.where("moving").isEmpty():
            return materialize(few(best(1)), "rule-estimate")


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_statistics(docs: DataFrame, keep_text: bool) -> DataFrame:
    """A written table of the documents' statistics, with or without their texts."""
    return materialize(vector(add_stats(docs, rule_stats, RULE_STATS, T.LongType(), keep_text=keep_text).withColumn("base_failed", _failed())), "rule-stats")


def estimate(stats: DataFrame, share: float = 0.75, min_rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """(group of each language and source, estimate of each group)."""
    sizes = stats.where("not base_failed").groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"))
    alone = F.col("n") >= min_rows
    by_lang = F.sum(F.when(~alone, F.col("n"))).over(Window.partitionBy("g_lang")) >= min_rows
    level = F.when(alone, 0).when(by_lang, 1).otherwise(2)
    groups = sizes.select("g_lang", "g_source", level.alias("level"))
    gid = F.when(F.col("level") == 0, F.xxhash64(F.lit(0), F.to_json(F.struct("g_lang", "g_source")))).when(F.col("level") == 1, F.xxhash64(F.lit(1), F.to_json(F.struct("g_lang")))).otherwise(0)
    groups = materialize(few(groups.withColumn("gid", gid.cast("long")).drop("level")), "rule-groups")
    rows = stats.where("not base_failed").join(groups, _same(stats, groups)).groupBy("gid", *VECTOR).agg(F.count(F.lit(1)).alias("w"))
    rows = materialize(rows, "rule-vectors")
    now = concentrated(rows, share)
    discard(rows)
    return groups, now


def _same(stats: DataFrame, groups: DataFrame) -> Column:
    return stats["g_lang"].eqNullSafe(groups["g_lang"]) & stats["g_source"].eqNullSafe(groups["g_source"])


def _judged(stats: DataFrame, groups: DataFrame, now: DataFrame, cutoff: float) -> DataFrame:
    placed = _placed(stats.join(groups, _same(stats, groups), "left").drop("g_lang", "g_source"), now, ["gid"], "left")
    placed = placed.withColumn("distance", F.when(~F.col("base_failed"), F.col("d2")))
    return placed.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def _grouped(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns under a prefix, so that no name of theirs clashes, beside text, language and source."""
    return docs.select(*[F.col(c).alias(f"k_{c}") for c in columns if c != "text"], F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "text")


def assess(docs: DataFrame, cutoff: float = CUTOFF, keep: list[str] | None = None, **options) -> DataFrame:
    """The columns of ``keep`` (not the text), RULE_STATS, base_failed, distance (squared, null if base_failed) and kept."""
    made = [*RULE_STATS, *VECTOR, "base_failed", "distance", "kept"]
    keep = [c for c in keep or ["doc_id"] if c not in made and c != "text"]
    stats = with_statistics(_grouped(docs, keep), keep_text=False)
    judged = _judged(stats, *estimate(stats, **options), cutoff)
    return judged.select(*[F.col(f"k_{c}").alias(c) for c in keep], *made)


def accepted(docs: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """The documents that pass, as they are. They are written once with their statistics, which estimates read alone."""
    stats = with_statistics(_grouped(docs, docs.columns), keep_text=True)
    judged = _judged(stats, *estimate(stats, **options), cutoff)
    return judged.where("kept").select(*[F.col(c if c == "text" else f"k_{c}").alias(c) for c in docs.columns])
