"""The registered query of each operator, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(f: Query) -> Query:
    from .common import bounded

    _QUERIES[f.__name__] = lambda spark, sf_dir: f(bounded(spark), sf_dir)
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentencepiece_bpe as sp

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sp.encode(docs, tokenizer_path("piece_bpe_32k.model"), "text", ids="ids", decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@register
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan_windows(table(spark, sf_dir, "documents"))


_SQL["op2_license_scan"] = r"""
with templates(place, license, template) as (values
         (1, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
         (2, 'MIT', 'Released under the MIT License.'),
         (3, 'GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
         (4, 'CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.')),
     d as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
     parts as (select n, unnest(list_distinct(list_append(string_split(text, chr(10)), text))) as part from d),
     words as (select n, regexp_extract_all(lower(part), '[\p{L}\p{N}]+(?:\.[0-9]+)*') as w from parts),
     known as (select place, license, regexp_extract_all(lower(template), '[\p{L}\p{N}]+(?:\.[0-9]+)*') as w from templates),
     b as (select n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from words where len(w) > 1),
     t as (select place, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as t from known),
     scored as (select n, place, license, 2 * len(list_intersect(b, t)) / (len(b) + len(t)) as dice from b, t),
     best as (select * from scored where dice >= 0.8 qualify row_number() over (partition by n order by dice desc, place) = 1)
select doc_id, license, coalesce(dice, 0.0::double) as dice from d left join best using (n)
"""


@register
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


@register
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_gbt as q

    stats = q.document_features(table(spark, sf_dir, "documents"), ["doc_id"])
    scored = q.score(stats, q.train(stats, table(spark, sf_dir, "labels"), q.learnable()))
    return scored.select("doc_id", (~q.learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.join_classes(table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


@register
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files
    from .common import scratch_path

    path = scratch_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    stored = token_files.checksums(token_files.read(spark, path))
    return stored.join(token_files.starts(spark, path), ["part", "seq"]).select("doc_id", "start", "n_tokens", "ids_crc32")


@register
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    from .common import scratch_path

    merged = warc.archive_and_read(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL["op7_warc"] = """
with p as (select page_id, coalesce(html, '') as h from pages),
     d as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest from p),
     f as (select *, min(page_id) over (partition by payload_digest) as first_id from d),
     r as (select *, payload_bytes >= 100 and first_id is not null and page_id is distinct from first_id as again from f)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first_id end as refers_to
from r
"""


@register
def op9_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vamana

    vectors = table(spark, sf_dir, "embeddings")
    return vamana.neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))


#: (host, path, verdict)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@register
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    judged = quality_rules.assess(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@register
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linkgraph

    return linkgraph.judge(table(spark, sf_dir, "pages"), URL_RULES)


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
