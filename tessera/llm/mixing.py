"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Target: sources, in order of their names' code points (null last), get weights by position; the budget is
   shared by weight, and a source whose share passes its cap stops there while the rest is shared anew. With
   sources in order of cap per weight that is one pass of window sums.
2. Quota: the budget in blocks goes to sources by highest quotients target / (2 * seats + 1). Seats that every
   such allocation must give come from a divisor that is safely too large; only the few seats left, at most
   one and a half per source, are compared as quotients.
3. Shards: a source is hashed into about sqrt(words) shards, so that neither the list of shards of a source nor
   the documents of a shard grow large; the source's blocks are apportioned to shards the same way.
4. Selection: a shard's documents in seeded order are one row of words; a quota takes the row as often as it
   holds whole, then its first blocks.

Only DataFrame functions run; texts are read once and never shuffled.

Defined results: a null text has size 0 and takes nothing; null is a source of its own, after all names; an
empty table gives an empty result; repeated rows are separate documents; ties in quotients go to the earlier
source or shard; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Words of a shard per document-side shard count: a source of w words has sqrt(w / SHARD_WORDS) shards.
SHARD_WORDS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """(source, size) to (source, source_id, source_size, weight, target); one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_cap = Window.orderBy("ratio", "source_id")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = sizes.withColumn("source_id", (F.row_number().over(by_name) - 1).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("source_id") % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("limit") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    # the level at which this source, and all with a larger cap per weight, would share what smaller caps leave
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("open", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_id", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.when(F.col("open").isNull() | (F.col("ratio") <= F.col("open")), F.col("limit")).otherwise(F.col("weight") * F.col("open")))
    return s.select("source", "source_id", "source_size", "weight", "target")


def sainte_lague(votes: DataFrame, group: list[str], key: str, vote: str, seats: str, out: str) -> DataFrame:
    """Add integer ``out``: the ``seats`` of each group shared among its rows by highest quotients of ``vote``.

    ``votes`` must be a written table: it is read twice.
    """
    w = Window.partitionBy(*group)
    v = votes.withColumn("_all", F.sum(vote).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    share = lambda half: F.greatest(F.floor(F.col(vote) * (F.col(seats) + half * F.col("_n") / 2.0) / F.col("_all") + 0.5), F.lit(0)).cast("long")
    none = F.coalesce(F.col("_all") <= 0, F.lit(True)) | (F.col(seats) <= 0)
    v = v.withColumn("_sure", F.when(none | (F.col(seats) <= F.col("_n") / 2.0), 0).otherwise(share(-1)).cast("long"))
    v = v.withColumn("_most", F.when(none, 0).otherwise(share(1)).cast("long"))
    v = v.withColumn("_left", F.when(none, 0).otherwise(F.col(seats) - F.sum("_sure").over(w)))
    tried = v.where("_most > _sure").select(*group, key, vote, "_left", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_seat"))
    order = Window.partitionBy(*group).orderBy((F.col(vote) / (2 * F.col("_seat") + 1)).desc(), F.col(key), F.col("_seat"))
    won = tried.withColumn("_r", F.row_number().over(order)).where("_r <= _left").groupBy(*group, key).agg(F.count(F.lit(1)).alias("_won"))
    joined = v.join(won, [*group, key], "left")
    return joined.withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_all", "_n", "_sure", "_most", "_left", "_won")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    cap: float = 2.0,
    block_words: int = 8,
    seed: int = 17,
    carry: list[str] | None = None,
) -> DataFrame:
    """Quotas of every document: doc_id, size, source_size, target, taken (and the columns of ``carry``)."""
    carry = carry or []
    base = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_order"),
        *carry,
    )
    base = materialize(base, "mix-sizes")
    sources = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap)
    sources = sources.withColumn("_g", F.lit(0)).withColumn("_blocks", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    sources = sainte_lague(materialize(sources, "mix-sources"), ["_g"], "source_id", "target", "_blocks", "blocks")
    sources = sources.withColumn("shards", F.greatest(F.ceil(F.sqrt(F.col("source_size") / SHARD_WORDS)), F.lit(1)).cast("long"))
    sources = materialize(sources.select("source", "source_id", "source_size", "target", "blocks", "shards"), "mix-quotas")

    known = base.join(sources, base["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    known = known.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("shards")))
    cells = known.groupBy("source_id", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    cells = sainte_lague(materialize(cells, "mix-shards"), ["source_id"], "shard", "shard_size", "blocks", "quota")
    cells = cells.select("source_id", "shard", "shard_size", "quota")

    row = Window.partitionBy("source_id", "shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.join(cells, ["source_id", "shard"]).withColumn("_before", F.coalesce(F.sum("size").over(row), F.lit(0)))
    words = F.least(F.col("quota") * block_words, F.floor(F.col("shard_size") * F.lit(float(cap))).cast("long"))
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    last = F.least(F.greatest(words - rounds * F.col("shard_size") - F.col("_before"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * rounds + last).alias("taken"), *carry)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, then its first words for what is left.

    Documents that are not taken go. A part keeps whole words, joined by single spaces, and n_chars, where there
    is such a column, becomes its length.
    """
    columns = docs.columns
    inner = [f"k_{c}" for c in columns]
    base = docs.select(*[F.col(c).alias(k) for c, k in zip(columns, inner)], F.monotonically_increasing_id().alias("_row"))
    base = materialize(base, "mix-documents")
    quota = mix(base.select(F.col("k_doc_id").alias("doc_id"), F.col("k_source").alias("source"), F.col("k_text").alias("text"), "_row"), carry=["_row"], **options)
    quota = quota.where("taken > 0").select("_row", F.floor(F.col("taken") / F.col("size")).alias("_whole"), (F.col("taken") % F.col("size")).alias("_part"))
    rows = base.join(quota, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0))))
    cut = F.col("_copy") > F.col("_whole")
    words = F.regexp_extract_all(F.col("k_text"), F.lit(WORD), 0)
    rows = rows.withColumn("k_text", F.when(cut, F.array_join(F.slice(words, 1, F.col("_part").cast("int")), " ")).otherwise(F.col("k_text")))
    if "n_chars" in columns:
        rows = rows.withColumn("k_n_chars", F.when(cut, F.char_length("k_text")).otherwise(F.col("k_n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(k).alias(c) for c, k in zip(columns, inner)])
