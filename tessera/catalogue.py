"""The query catalogue: one entry per capability, each built with plans over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import avg, col, count, lit, max_, min_, sum_
from .plans.nodes import Query, desc, index_scan, scan
from .run import to_dataframe
from .session import configure
from .sources.catalog import Catalog

_PLANS: dict[str, Callable[[], tuple[Query, Callable[[DataFrame], DataFrame] | None]]] = {}


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The given tables, and views of all their rows with NULLs and unmatched keys, which the tables lack.

    Orders of a quarter of the customers get the key of no customer.
    """
    c = Catalog(spark, sf_dir)
    orders, customer, nation = c.table("orders"), c.table("customer"), c.table("nation")
    unless = lambda key, m, r, value: F.when(F.col(key) % m != r, value)
    known = F.when(F.col("o_custkey") % 4 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    c.add(
        "no",
        orders.select("o_orderkey", unless("o_orderkey", 7, 0, known).alias("ck"), unless("o_orderkey", 5, 0, F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("st")),
    )
    c.add(
        "nc",
        customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), unless("c_custkey", 6, 1, F.col("c_mktsegment")).alias("seg"), F.col("c_nationkey").alias("nk")),
    )
    third = lambda key: F.when(key % 3 == 0, True).when(key % 3 == 1, False)
    c.add("tv", nation.select(F.col("n_nationkey").alias("i"), third(F.col("n_nationkey")).alias("a"), third(F.floor(F.col("n_nationkey") / 3)).alias("b")))
    c.add("s2", c.table("supplier").select("s_suppkey", "s_nationkey"))
    c.add("n2", nation.select("n_nationkey", "n_name"))
    return c


def _plan(f: Callable) -> Callable:
    """Register a function that gives a plan, or a plan and what to do with its DataFrame (rounding)."""
    _PLANS[f.__name__] = f
    return f


def _rounded(**digits: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


@_plan
def scan_table():
    return scan("supplier").select(*[col(c) for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")])


@_plan
def scan_index():
    found = index_scan("orders", col("o_orderstatus").eq("P"), "orders_status")
    return found.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@_plan
def project_alias():
    return scan("orders", "o").select(col("o.o_orderkey").alias("order_id"), col("o.o_totalprice").alias("total"))


@_plan
def project_literals():
    return scan("region").select(col("r_regionkey"), lit(7).alias("i"), lit(1.5).alias("f"), lit("x").alias("s"), lit(True).alias("b"))


@_plan
def project_star():
    return scan("nation", "n").select("*"), lambda df: df.toDF(*[c.removeprefix("n.") for c in df.columns])


@_plan
def filter_comparisons():
    a, n = col("s_acctbal"), col("s_nationkey")
    kept = scan("supplier").where((a > -500) & n.ne(24))
    return kept.select("s_suppkey", (a > 0).alias("gt"), (a >= 0).alias("ge"), (a < 0).alias("lt"), (a <= 0).alias("le"), n.eq(3).alias("eq"), n.ne(3).alias("ne"))


@_plan
def filter_or():
    s = col("o_orderstatus")
    return scan("orders").where(s.eq("P") | s.eq("F")).select("o_orderkey")


@_plan
def filter_null_comparison():
    return scan("no").where(col("price") > 250000).select("o_orderkey")


@_plan
def logic_three_valued():
    a, b = col("a"), col("b")
    return scan("tv").select("i", (a & b).alias("a_and_b"), (a | b).alias("a_or_b"), (~a).alias("not_a"))


@_plan
def between():
    return scan("lineitem").where(col("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@_plan
def between_negated_null():
    return scan("no").where(col("price").between(100000, 300000, negated=True)).select("o_orderkey")


@_plan
def between_null_bound():
    n = col("s_nationkey")
    return scan("supplier").select("s_suppkey", n.between(10, None).alias("b"), n.between(10, None, negated=True).alias("nb"))


@_plan
def in_list():
    return scan("orders").where(col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@_plan
def in_list_null_member():
    n = col("s_nationkey")
    return scan("supplier").select("s_suppkey", n.isin(1, None, 5).alias("m"), n.isin(1, None, 5, negated=True).alias("nm"))


@_plan
def like_percent():
    return scan("part").where(col("p_name").like("blue%")).select("p_partkey", "p_name")


@_plan
def like_underscore():
    return scan("nation").where(col("n_name").like("NATION__")).select("n_nationkey")


@_plan
def like_escape():
    return scan("nation").where(col("n_name").like("NATION\\_1%")).select("n_nationkey")


@_plan
def like_negated_null():
    return scan("nc").where(col("seg").like("%ING", negated=True)).select("id")


@_plan
def is_null():
    return scan("no").where(col("price").is_null()).select("o_orderkey")


@_plan
def is_not_null():
    return scan("no").where(col("price").is_not_null()).select("o_orderkey")


@_plan
def arith_add_sub_mul():
    charge = col("l_extendedprice") * (1 - col("l_discount")) * (1 + col("l_tax"))
    return scan("lineitem").select("l_orderkey", "l_linenumber", charge.alias("charge"))


@_plan
def arith_div_is_float():
    return scan("supplier").select("s_suppkey", (col("s_suppkey") / (col("s_nationkey") + 1)).alias("q"))


@_plan
def arith_mod_floored():
    return scan("supplier").select("s_suppkey", ((col("s_nationkey") - 12) % 5).alias("m"))


@_plan
def arith_narrow_columns():
    n = col("l_linenumber")
    return scan("lineitem").select("l_orderkey", "l_linenumber", (n * 1_000_000_007).alias("p"), (n + 2_147_483_647).alias("s"), (-n).alias("m"))


@_plan
def arith_null_propagation():
    p, k = col("price"), col("o_orderkey")
    return scan("no").where(k > 0).select("o_orderkey", (p * 2).alias("p2"), (p / k).alias("pq"))


@_plan
def unary_neg_pos():
    return scan("supplier").select("s_suppkey", (-col("s_acctbal")).alias("neg"), (+col("s_nationkey")).alias("pos"))


def _equi(how: str, strategy: str | None = "hash"):
    joined = scan("nc").join(scan("no"), col("nc.id").eq(col("no.ck")), how, strategy)
    return joined.select(col("nc.id"), col("nc.name"), col("no.o_orderkey"), col("no.price"))


def _theta(how: str):
    condition = (col("s2.s_nationkey") < col("n2.n_nationkey")) & (col("s2.s_suppkey") + col("n2.n_nationkey") > 40)
    return scan("s2").join(scan("n2"), condition, how).select("s2.s_suppkey", "n2.n_nationkey", "n2.n_name")


for _how in ("inner", "left", "right", "full"):
    _PLANS[f"hash_join_{_how}"] = lambda how=_how: _equi(how)
    _PLANS[f"nl_join_{_how}"] = lambda how=_how: _theta(how)


@_plan
def cross_join():
    return scan("region", "r").join(scan("nation", "n")).select("r.r_name", "n.n_name")


def _always(how: str):
    return scan("region", "r").join(scan("nation", "n"), None, how).select("r.r_name", "n.n_name")


for _how in ("left", "right", "full"):
    _PLANS[f"nl_join_{_how}_no_condition"] = lambda how=_how: _always(how)


@_plan
def self_join():
    joined = scan("nation", "a").join(scan("nation", "b"), col("a.n_regionkey").eq(col("b.n_regionkey")))
    return joined.select(col("a.n_nationkey").alias("a_key"), col("b.n_nationkey").alias("b_key"))


@_plan
def agg_group_sum_count():
    q, p = sum_(col("l_quantity")), sum_(col("l_extendedprice"))
    g = scan("lineitem").group("l_returnflag", "l_linestatus").agg(q, p, count())
    return g.select("l_returnflag", "l_linestatus", q.alias("sum_qty"), p.alias("sum_price"), count().alias("n")), _rounded(sum_qty=2, sum_price=2)


@_plan
def agg_null_group():
    n = count(col("seg"))
    return scan("nc").group("seg").agg(count(), n).select("seg", count().alias("n"), n.alias("nn"))


@_plan
def agg_skips_nulls():
    p = col("price")
    c, s, a, lo, hi = count(p), sum_(p), avg(p), min_(p), max_(p)
    g = scan("no").group("st").agg(count(), c, s, a, lo, hi)
    return g.select("st", count().alias("n"), c.alias("np"), s.alias("s"), a.alias("a"), lo.alias("mi"), hi.alias("ma")), _rounded(s=2, a=2)


@_plan
def agg_all_null_group():
    key, p = col("o_orderkey") % 5, col("price")
    return scan("no").group(key).agg(sum_(p), count(p)).select(col("(o_orderkey MOD 5)").alias("g"), sum_(p).is_null().alias("sum_null"), count(p).alias("n"))


@_plan
def agg_global():
    q, d = avg(col("l_quantity")), col("l_shipdate")
    g = scan("lineitem").group().agg(q, min_(d), max_(d), count())
    return g.select(q.alias("a"), min_(d).alias("d0"), max_(d).alias("d1"), count().alias("n")), _rounded(a=6)


@_plan
def agg_global_empty():
    s, a, m = sum_(col("o_totalprice")), avg(col("o_totalprice")), min_(col("o_orderstatus"))
    g = scan("orders").where(col("o_orderkey") < 0).group().agg(count(), s, a, m)
    return g.select(count().alias("n"), s.alias("s"), a.alias("a"), m.alias("m"))


@_plan
def agg_group_empty():
    return scan("orders").where(col("o_orderkey") < 0).group("o_orderstatus").agg(count()).select("o_orderstatus", count().alias("n"))


@_plan
def agg_min_max_string():
    s = col("l_linestatus")
    return scan("lineitem").group("l_returnflag").agg(min_(s), max_(s)).select("l_returnflag", min_(s).alias("mi"), max_(s).alias("ma"))


@_plan
def agg_sum_integer():
    n = col("l_linenumber")
    return scan("lineitem").group("l_returnflag").agg(sum_(n), avg(n)).select("l_returnflag", sum_(n).alias("s"), avg(n).alias("a"))


@_plan
def agg_distinct():
    n = col("l_linenumber")
    c, s, a = count(col("l_suppkey"), distinct=True), sum_(n, distinct=True), avg(n, distinct=True)
    return scan("lineitem").group("l_returnflag").agg(c, s, a).select("l_returnflag", c.alias("cd"), s.alias("sd"), a.alias("ad"))


@_plan
def agg_group_by_expression():
    g = scan("lineitem").group(col("l_quantity") > 25, col("l_linenumber") + 1).agg(count())
    return g.select(col("(l_quantity GT 25)").alias("big"), col("(l_linenumber ADD 1)").alias("ln"), count().alias("n"))


@_plan
def agg_keys_only():
    return scan("orders").group("o_orderstatus", "o_orderpriority").agg().select("o_orderstatus", "o_orderpriority")


@_plan
def agg_over_expression():
    r = sum_(col("l_extendedprice") * (1 - col("l_discount")))
    return scan("lineitem").group("l_returnflag").agg(r).select("l_returnflag", r.alias("rev")), _rounded(rev=2)


@_plan
def having():
    return scan("orders").group("o_custkey").agg(count()).where(count() > 12).select("o_custkey", count().alias("n"))


@_plan
def project_over_aggregate():
    s = sum_(col("l_extendedprice"))
    return scan("lineitem").group("l_returnflag").agg(s, count()).select("l_returnflag", (s / count()).alias("mean_price")), _rounded(mean_price=4)


@_plan
def distinct_rows():
    return scan("lineitem").select("l_returnflag", "l_linestatus").distinct()


@_plan
def distinct_nulls():
    return scan("nc").select("seg", (col("nk") % 2).alias("parity")).distinct()


@_plan
def sort_asc_nulls_last():
    return scan("no").sort("price", "o_orderkey").select("o_orderkey", "price")


@_plan
def sort_desc_nulls_last():
    return scan("no").sort(desc("price"), "o_orderkey").select("o_orderkey", "price")


@_plan
def sort_null_tail():
    return scan("no").sort(desc("price"), "o_orderkey").limit(offset=100).select("o_orderkey", "price")


@_plan
def sort_by_nothing():
    return scan("supplier").sort().select("s_suppkey", "s_name")


@_plan
def sort_multi_mixed():
    return scan("orders").sort("o_orderstatus", desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_orderstatus", "o_totalprice")


@_plan
def sort_string_expression():
    return scan("part").sort(desc("p_name"), "p_partkey").limit(25).select("p_partkey", "p_name")


@_plan
def limit_offset():
    return scan("supplier").sort("s_suppkey").limit(10, 5).select("s_suppkey")


@_plan
def offset_only():
    return scan("supplier").sort("s_suppkey").limit(offset=90).select("s_suppkey")


@_plan
def limit_zero():
    return scan("supplier").sort("s_suppkey").limit(0).select("s_suppkey")


@_plan
def pipeline_join_agg_sort_limit():
    s = sum_(col("o.o_totalprice"))
    joined = scan("nation", "n").join(scan("customer", "c"), col("n.n_nationkey").eq(col("c.c_nationkey")), strategy="hash")
    joined = joined.join(scan("orders", "o"), col("c.c_custkey").eq(col("o.o_custkey")), strategy="hash").where(col("o.o_orderstatus").ne("F"))
    g = joined.group("n.n_name").agg(s, count()).select(col("n_name").alias("country"), s.alias("total"), count().alias("n_orders"))
    return g.sort(desc("total"), "country").limit(10), _rounded(total=2)


@_plan
def pipeline_left_join_filter_sort():
    joined = scan("nc").join(scan("no"), col("nc.id").eq(col("no.ck")), "left", "hash").where(col("no.price").is_not_null())
    return joined.select(col("nc.name").alias("name"), col("no.price").alias("amount")).sort("amount", "name").limit(100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(make: Callable) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = make()
            plan, after = made if isinstance(made, tuple) else (made, None)
            df = to_dataframe(plan, _catalog(configure(spark), sf_dir))
            return after(df) if after else df

        return run

    return {name: runner(make) for name, make in _PLANS.items()}
