"""URL filter: rules by host and path, and for the rest trust and distrust propagated over links between hosts.

Hosts with allowed pages are trusted seeds, hosts with blocked pages are blocked seeds, each in proportion to
such pages. Trust follows links (personalised PageRank from the trusted seeds); distrust goes against them,
from a blocked host to those that link to it. Mass that reaches a host without a way on returns to the seeds.
A host is blocked when its distrust is above ``ratio`` times its trust; one without either is allowed.

Only DataFrame functions run. Pages are reduced to one row per pair of hosts before any iteration, and each
iteration ends in a written table, so lineage stays short. Iteration goes on until a step moves less than
``tolerance`` in all; as each shrinks the moves by ``damping``, the rounds this takes at most are known before.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and is allowed; a null
html has no links; repeated pages count each; of rules that fit, the longest text wins, of equal ones the one
with the longer host, then the first listed; a null page_id is judged like any other; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize

#: (host, path, verdict)
Rule = tuple[str, str, str]
#: Up to so many rules become one expression; a longer list is joined as a table.
MAX_RULES = 500
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null if none does."""
    text = verdict = F.lit(None).cast("string")
    # the last one wrapped around is tested first
    for h, p, v in reversed(sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def by_table(known: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule and by_rule to rows with host and path, from a table of rules (host, path, verdict, place).

    Each distinct (host, path) asks for its host's suffixes with the path's beginnings of lengths that rules have, by
    equality; so a host with many rules or many pages is no hot key.
    """
    rules = materialize(rules.withColumn("length", F.char_length("path")), "url-rules")
    lengths = F.broadcast(rules.agg(F.array_sort(F.collect_set("length")).alias("lengths")))  # one row: distinct lengths of paths
    asked = known.select("host", "path").distinct().crossJoin(lengths)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = asked.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("h"), "lengths")
    asked = asked.select("host", "path", "h", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n"))
    asked = asked.select("host", "path", "h", F.substring("path", F.lit(1), F.col("n")).alias("p"))
    fits = asked.join(rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict", "place"), ["h", "p"])
    text = F.concat("h", "p")
    order = F.struct(-F.char_length(text), -F.char_length("h"), "place")
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct(text.alias("rule"), "verdict"), order).alias("best"))
    found = known.join(best, ["host", "path"], "left")
    return found.withColumns({"rule": F.col("best")["rule"], "by_rule": F.col("best")["verdict"]}).drop("best")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) of links between different hosts; relative links stay on their host and are no edge."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), 1)).alias("href"))
    to = url_host(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href")))
    links = links.select(F.col("host").alias("src"), to.alias("dst")).where("src <> dst and dst <> '' and src <> ''")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def enough_rounds(damping: float, tolerance: float) -> int:
    """Rounds after which a step moves less than ``tolerance``: trust and distrust each move 2 * damping ** n at most in round n."""
    return 2 if damping <= 0 else max(1, ceil(log(tolerance / 4) / log(damping)) + 1)


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int | None, tolerance: float) -> DataFrame:
    """(host, trust, distrust). ``seeds``: host, trust0, distrust0 of every host with a page, each summing to 1 or 0.

    Fails if ``rounds`` (None: as many as the tolerance can need) end before the tolerance is met.
    """
    rounds = enough_rounds(damping, tolerance) if rounds is None else rounds
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("links").alias("out_links"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("links").alias("in_links"))
    nodes = seeds.join(out, "host", "full").join(into, "host", "full")
    zero = F.lit(0.0)
    nodes = nodes.select("host", F.coalesce("trust0", zero).alias("trust0"), F.coalesce("distrust0", zero).alias("distrust0"), "out_links", "in_links")
    now = materialize(nodes.withColumns({"trust": F.col("trust0"), "distrust": F.col("distrust0")}), "hosts")
    before = now
    for _ in range(rounds):
        ahead = edges.join(now.select(F.col("host").alias("src"), "trust", "out_links"), "src")
        ahead = ahead.select(F.col("dst").alias("host"), (F.col("trust") * F.col("links") / F.col("out_links")).alias("t"), zero.alias("d"))
        back = edges.join(now.select(F.col("host").alias("dst"), "distrust", "in_links"), "dst")
        back = back.select(F.col("src").alias("host"), zero.alias("t"), (F.col("distrust") * F.col("links") / F.col("in_links")).alias("d"))
        gained = ahead.union(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        # what flows nowhere goes back to the seeds
        lost = now.agg(
            F.coalesce(F.sum(F.when(F.col("out_links").isNull(), F.col("trust"))), zero).alias("lost_t"),
            F.coalesce(F.sum(F.when(F.col("in_links").isNull(), F.col("distrust"))), zero).alias("lost_d"),
        )
        step = now.join(gained, "host", "left").crossJoin(F.broadcast(lost))  # one row
        new = lambda base, gain, lost: (1 - damping) * F.col(base) + damping * (F.coalesce(gain, zero) + F.col(lost) * F.col(base))
        step = step.select(
            "host", "trust0", "distrust0", "out_links", "in_links", new("trust0", "t", "lost_t").alias("trust"), new("distrust0", "d", "lost_d").alias("distrust"),
            (F.abs(new("trust0", "t", "lost_t") - F.col("trust")) + F.abs(new("distrust0", "d", "lost_d") - F.col("distrust"))).alias("moved"),
        )
        step = materialize(step, "hosts")
        moved = step.agg(F.sum("moved")).first()[0] or 0.0
        discard(before)
        before, now = step, step.drop("moved")
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"ranks of hosts not settled to {tolerance} after {rounds} rounds")
    return now.select("host", "trust", "distrust")


def judge(
    pages: DataFrame, rules: list[Rule] | DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6, ratio: float = 1.0, max_rules: int = MAX_RULES
) -> DataFrame:
    """page_id, host, path, rule, verdict, host_trust and host_distrust of every page.

    ``rules`` are (host, path, verdict), also as a table with these columns and ``place``, the order of equal ones.
    ``rounds`` (None: as many as ``tolerance`` can need) bounds the iteration, which fails if it is not enough.
    """
    known = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    if isinstance(rules, list) and len(rules) > max_rules:
        rules = pages.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rules)], "host string, path string, verdict string, place long")
    if isinstance(rules, DataFrame):
        edges = host_edges(known)
        known = by_table(known.select("page_id", "host", "path"), rules)
    else:
        rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
        edges = host_edges(known)
        known = known.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    edges = materialize(edges, "host-edges")
    counts = known.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("by_rule") == "allow", 1)).alias("a"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("b")
    )
    counts = materialize(counts, "host-seeds")
    sums = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    seeds = counts.crossJoin(F.broadcast(sums)).select("host", share("a", "all_a").alias("trust0"), share("b", "all_b").alias("distrust0"))
    scores = propagate(edges, seeds, damping, rounds, tolerance)
    judged = known.join(scores, "host", "left")
    zero = F.lit(0.0)
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    by_host = F.when(distrust > ratio * trust, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), trust.alias("host_trust"), distrust.alias("host_distrust"))
