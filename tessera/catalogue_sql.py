"""SQL of each catalogue query, for a second engine to check the results."""

#: Orders with unknown customers and prices, a quarter of the customers' orders with the key of no customer; customers with unknown segments.
_NO = """no as (select o_orderkey, case when o_orderkey%7=0 then null when o_custkey%4=0 then -o_custkey else o_custkey end as ck, case when o_orderkey%5=0 then null else o_totalprice end as price, o_orderstatus as st from orders)"""
_NC = """nc as (select c_custkey as id, c_name as name, case when c_custkey%6=1 then null else c_mktsegment end as seg, c_nationkey as nk from customer)"""
_S2 = "s2 as (select s_suppkey, s_nationkey from supplier), n2 as (select n_nationkey, n_name from nation)"

SQL = {
    "scan_table": """select * from supplier""",
    "scan_index": """select * from orders where o_orderstatus='P'""",
    "project_alias": """select o_orderkey as order_id, o_totalprice as total from orders""",
    "project_literals": """select r_regionkey, 7 as i, cast(1.5 as double) as f, 'x' as s, true as b from region""",
    "project_star": """select * from nation""",
    "filter_comparisons": """select s_suppkey, s_acctbal>0 as gt, s_acctbal>=0 as ge, s_acctbal<0 as lt, s_acctbal<=0 as le, s_nationkey=3 as eq, s_nationkey<>3 as ne from supplier where s_acctbal>-500 and s_nationkey<>24""",
    "filter_or": """select o_orderkey from orders where o_orderstatus='P' or o_orderstatus='F'""",
    "filter_null_comparison": f"""with {_NO} select o_orderkey from no where price>250000""",
    "logic_three_valued": """with tv as (select n_nationkey as i, case n_nationkey%3 when 0 then true when 1 then false end as a, case cast(floor(n_nationkey/3) as int)%3 when 0 then true when 1 then false end as b from nation) select i, a and b as a_and_b, a or b as a_or_b, not a as not_a from tv""",
    "between": """select l_orderkey,l_linenumber,l_quantity from lineitem where l_quantity between 10 and 20""",
    "between_negated_null": f"""with {_NO} select o_orderkey from no where not (price between 100000 and 300000)""",
    "between_null_bound": """select s_suppkey, s_nationkey between 10 and null as b, not (s_nationkey between 10 and null) as nb from supplier""",
    "in_list": """select o_orderkey from orders where o_orderpriority in ('1-URGENT','5-LOW')""",
    "in_list_null_member": """select s_suppkey, s_nationkey in (1,null,5) as m, s_nationkey not in (1,null,5) as nm from supplier""",
    "like_percent": """select p_partkey,p_name from part where p_name like 'blue%'""",
    "like_underscore": """select n_nationkey from nation where n_name like 'NATION__'""",
    "like_escape": r"""select n_nationkey from nation where n_name like 'NATION\_1%' escape '\'""",
    "like_negated_null": f"""with {_NC} select id from nc where seg not like '%ING'""",
    "is_null": f"""with {_NO} select o_orderkey from no where price is null""",
    "is_not_null": f"""with {_NO} select o_orderkey from no where price is not null""",
    "arith_add_sub_mul": """select l_orderkey,l_linenumber,l_extendedprice*(1-l_discount)*(1+l_tax) as charge from lineitem""",
    "arith_div_is_float": """select s_suppkey, s_suppkey/(s_nationkey+1) as q from supplier""",
    "arith_mod_floored": """select s_suppkey, cast(case when (s_nationkey-12)%5<0 then (s_nationkey-12)%5+5 else (s_nationkey-12)%5 end as bigint) as m from supplier""",
    "arith_narrow_columns": """select l_orderkey, l_linenumber, cast(l_linenumber as bigint)*1000000007 as p, cast(l_linenumber as bigint)+2147483647 as s, -cast(l_linenumber as bigint) as m from lineitem""",
    "arith_null_propagation": f"""with {_NO} select o_orderkey, price*2 as p2, price/o_orderkey as pq from no where o_orderkey>0""",
    "unary_neg_pos": """select s_suppkey, -s_acctbal as neg, cast(s_nationkey as bigint) as pos from supplier""",
    "hash_join_inner": f"""with {_NC}, {_NO} select nc.id, nc.name, no.o_orderkey, no.price from nc join no on nc.id=no.ck""",
    "nl_join_inner": f"""with {_S2} select s2.s_suppkey, n2.n_nationkey, n2.n_name from s2 join n2 on s2.s_nationkey<n2.n_nationkey and s2.s_suppkey+n2.n_nationkey>40""",
    "hash_join_left": f"""with {_NC}, {_NO} select nc.id, nc.name, no.o_orderkey, no.price from nc left join no on nc.id=no.ck""",
    "nl_join_left": f"""with {_S2} select s2.s_suppkey, n2.n_nationkey, n2.n_name from s2 left join n2 on s2.s_nationkey<n2.n_nationkey and s2.s_suppkey+n2.n_nationkey>40""",
    "hash_join_right": f"""with {_NC}, {_NO} select nc.id, nc.name, no.o_orderkey, no.price from nc right join no on nc.id=no.ck""",
    "nl_join_right": f"""with {_S2} select s2.s_suppkey, n2.n_nationkey, n2.n_name from s2 right join n2 on s2.s_nationkey<n2.n_nationkey and s2.s_suppkey+n2.n_nationkey>40""",
    "hash_join_full": f"""with {_NC}, {_NO} select nc.id, nc.name, no.o_orderkey, no.price from nc full join no on nc.id=no.ck""",
    "nl_join_full": f"""with {_S2} select s2.s_suppkey, n2.n_nationkey, n2.n_name from s2 full join n2 on s2.s_nationkey<n2.n_nationkey and s2.s_suppkey+n2.n_nationkey>40""",
    "cross_join": """select r.r_name, n.n_name from region r cross join nation n""",
    **{f"nl_join_{how}_no_condition": f"""select r.r_name, n.n_name from region r {how} join nation n on true""" for how in ("left", "right", "full")},
    "self_join": """select a.n_nationkey as a_key, b.n_nationkey as b_key from nation a join nation b on a.n_regionkey=b.n_regionkey""",
    "agg_group_sum_count": """select l_returnflag, l_linestatus, round(sum(l_quantity),2) as sum_qty, round(sum(l_extendedprice),2) as sum_price, count(*) as n from lineitem group by l_returnflag, l_linestatus""",
    "agg_null_group": f"""with {_NC} select seg, count(*) as n, count(seg) as nn from nc group by seg""",
    "agg_skips_nulls": f"""with {_NO} select st, count(*) as n, count(price) as np, round(sum(price),2) as s, round(avg(price),2) as a, min(price) as mi, max(price) as ma from no group by st""",
    "agg_all_null_group": f"""with {_NO} select o_orderkey%5 as g, sum(price) is null as sum_null, count(price) as n from no group by o_orderkey%5""",
    "agg_global": """select round(avg(l_quantity),6) as a, min(l_shipdate) as d0, max(l_shipdate) as d1, count(*) as n from lineitem""",
    "agg_global_empty": """select count(*) as n, sum(o_totalprice) as s, avg(o_totalprice) as a, min(o_orderstatus) as m from orders where o_orderkey<0""",
    "agg_group_empty": """select o_orderstatus, count(*) as n from orders where o_orderkey<0 group by o_orderstatus""",
    "agg_min_max_string": """select l_returnflag, min(l_linestatus) as mi, max(l_linestatus) as ma from lineitem group by l_returnflag""",
    "agg_sum_integer": """select l_returnflag, cast(sum(l_linenumber) as bigint) as s, avg(l_linenumber) as a from lineitem group by l_returnflag""",
    "agg_distinct": """select l_returnflag, count(distinct l_suppkey) as cd, cast(sum(distinct l_linenumber) as bigint) as sd, avg(distinct l_linenumber) as ad from lineitem group by l_returnflag""",
    "agg_group_by_expression": """select l_quantity>25 as big, cast(l_linenumber as bigint)+1 as ln, count(*) as n from lineitem group by 1, 2""",
    "agg_keys_only": """select o_orderstatus, o_orderpriority from orders group by o_orderstatus, o_orderpriority""",
    "agg_over_expression": """select l_returnflag, round(sum(l_extendedprice*(1-l_discount)),2) as rev from lineitem group by l_returnflag""",
    "having": """select o_custkey, count(*) as n from orders group by o_custkey having count(*)>12""",
    "project_over_aggregate": """select l_returnflag, round(sum(l_extendedprice)/count(*),4) as mean_price from lineitem group by l_returnflag""",
    "distinct_rows": """select distinct l_returnflag, l_linestatus from lineitem""",
    "distinct_nulls": f"""with {_NC} select distinct seg, cast(nk%2 as bigint) as parity from nc""",
    "sort_asc_nulls_last": f"""with {_NO} select o_orderkey, price from no order by price asc nulls last, o_orderkey asc nulls last""",
    "sort_desc_nulls_last": f"""with {_NO} select o_orderkey, price from no order by price desc nulls last, o_orderkey asc nulls last""",
    "sort_null_tail": f"""with {_NO} select o_orderkey, price from no order by price desc nulls last, o_orderkey asc nulls last offset 100""",
    "sort_by_nothing": """select s_suppkey, s_name from supplier""",
    "sort_multi_mixed": """select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderstatus asc nulls last, o_totalprice desc nulls last, o_orderkey asc nulls last limit 40""",
    "sort_string_expression": """select p_partkey, p_name from part order by p_name desc nulls last, p_partkey asc nulls last limit 25""",
    "limit_offset": """select s_suppkey from supplier order by s_suppkey limit 10 offset 5""",
    "offset_only": """select s_suppkey from supplier order by s_suppkey offset 90""",
    "limit_zero": """select s_suppkey from supplier order by s_suppkey limit 0""",
    "pipeline_join_agg_sort_limit": """select n.n_name as country, round(sum(o.o_totalprice),2) as total, count(*) as n_orders from nation n join customer c on n.n_nationkey=c.c_nationkey join orders o on c.c_custkey=o.o_custkey where o.o_orderstatus<>'F' group by n.n_name order by total desc nulls last, country asc nulls last limit 10""",
    "pipeline_left_join_filter_sort": f"""with {_NC}, {_NO} select nc.name as name, no.price as amount from nc left join no on nc.id=no.ck where no.price is not null order by amount asc nulls last, name asc nulls last limit 100""",
}
