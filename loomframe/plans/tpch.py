"""The 22 decision-support queries and variants, as parameterised SQL that Catalyst plans.

The tables lack some columns of the full schema. Derived ones are proxies,
stated here once: partsupp is the distinct (part, supplier) pairs of lineitem
with 10 available units for each line and the least unit price in whole units as cost; a line
is committed 45 days after its order and received 10 days after shipping; ship
modes and instructions are the line number modulo 7 and 4; the container is the part size modulo 4;
the country code is the nation key. Ranges include both ends where the library offers ``range``.
"""

from __future__ import annotations

from collections.abc import Callable

from ..registry import register
from ..tables import plain, run_sql

PARTSUPP = "(select l_partkey as ps_partkey, l_suppkey as ps_suppkey, cast(10 * count(*) as double) as ps_availqty, floor(min(l_extendedprice / l_quantity)) as ps_supplycost from {lineitem} group by l_partkey, l_suppkey)"
LATE = "(select l.*, o_orderdate, o_orderpriority, o_orderstatus, o_orderdate + interval '45' day as l_commitdate, l_shipdate + interval '10' day as l_receiptdate from {lineitem} l join {orders} o on l_orderkey = o_orderkey)"
REV = "l_extendedprice * (1 - l_discount)"


def q1(end: str = "1998-09-01") -> str:
    return f"""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum({REV}), 2) as sum_disc_price,
  round(sum({REV} * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from {{lineitem}} where l_shipdate <= timestamp '{end}' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus"""


def q2(region: int = 3, size: int = 15, suffix: str = "PROMO") -> str:
    return f"""with c as (select p_partkey, p_brand, s_suppkey, s_name, s_acctbal, n_name, ps_supplycost, min(ps_supplycost) over (partition by p_partkey) as least
  from {PARTSUPP} ps join {{part}} on p_partkey = ps_partkey join {{supplier}} on s_suppkey = ps_suppkey join {{nation}} on s_nationkey = n_nationkey where n_regionkey = {region} and p_size = {size} and p_type like '%{suffix}')
select s_acctbal, s_name, n_name, p_partkey, p_brand, ps_supplycost from c where ps_supplycost = least order by s_acctbal desc, n_name, s_name, p_partkey"""


def q3(segment: str = "BUILDING", date: str = "1997-03-15", limit: int = 10) -> str:
    return f"""select l_orderkey, o_orderdate, round(sum({REV}), 2) as revenue from {{customer}} join {{orders}} on c_custkey = o_custkey join {{lineitem}} on l_orderkey = o_orderkey
where c_mktsegment = '{segment}' and o_orderdate < timestamp '{date}' and l_shipdate > timestamp '{date}' group by l_orderkey, o_orderdate having sum({REV}) > 0 order by revenue desc, o_orderdate, l_orderkey limit {limit}"""


def q4(start: str = "1997-07-01", end: str = "1997-09-30") -> str:
    return f"""select o_orderpriority, count(*) as order_count from {{orders}} o where o_orderdate between timestamp '{start}' and timestamp '{end}'
  and exists (select 1 from {LATE} x where x.l_orderkey = o.o_orderkey and l_commitdate < l_receiptdate) group by o_orderpriority order by o_orderpriority"""


def q5(region: int = 2, start: str = "1996-01-01", end: str = "1997-01-01", all_nations: bool = False) -> str:
    inner = f"""select n_nationkey, sum({REV}) as revenue from {{customer}} join {{orders}} on c_custkey = o_custkey join {{lineitem}} on l_orderkey = o_orderkey join {{supplier}} on l_suppkey = s_suppkey and c_nationkey = s_nationkey
  join {{nation}} on s_nationkey = n_nationkey where n_regionkey = {region} and o_orderdate >= timestamp '{start}' and o_orderdate < timestamp '{end}' group by n_nationkey"""
    join = "left join" if all_nations else "join"
    return f"select n_name, round(coalesce(revenue, 0), 2) as revenue from {{nation}} n {join} ({inner}) r on n.n_nationkey = r.n_nationkey order by revenue desc, n_name"


def q6(start: str = "1996-01-01", end: str = "1996-12-31", discount: float = 0.06, quantity: int = 24) -> str:
    return f"select round(sum(l_extendedprice * l_discount), 2) as revenue from {{lineitem}} where l_shipdate between timestamp '{start}' and timestamp '{end}' and l_discount > {discount - 0.0101} and l_discount < {discount + 0.0101} and l_quantity < {quantity}"


def q7(one: int = 6, two: int = 7) -> str:
    return f"""select s_nationkey as supp_nation, c_nationkey as cust_nation, cast(year(l_shipdate) as int) as l_year, round(sum({REV}), 2) as revenue
from {{supplier}} join {{lineitem}} on s_suppkey = l_suppkey join {{orders}} on o_orderkey = l_orderkey join {{customer}} on c_custkey = o_custkey
where ((s_nationkey = {one} and c_nationkey = {two}) or (s_nationkey = {two} and c_nationkey = {one})) and year(l_shipdate) in (1995, 1996) group by s_nationkey, c_nationkey, year(l_shipdate) order by 1, 2, 3"""


def q8(region: int = 1, nation: int = 2, kind: str = "ECONOMY") -> str:
    return f"""select cast(year(o_orderdate) as int) as o_year, round(sum(case when s_nationkey = {nation} then {REV} else 0 end) / sum({REV}), 6) as mkt_share
from {{part}} join {{lineitem}} on p_partkey = l_partkey join {{supplier}} on s_suppkey = l_suppkey join {{orders}} on o_orderkey = l_orderkey join {{customer}} on c_custkey = o_custkey join {{nation}} on c_nationkey = n_nationkey
where n_regionkey = {region} and p_type = '{kind}' and year(o_orderdate) in (1995, 1996) group by year(o_orderdate) order by 1"""


def q8_customer_first(region: int = 1, nation: int = 2, kind: str = "ECONOMY") -> str:
    return f"""with c as (select c_custkey from {{customer}} join {{nation}} on c_nationkey = n_nationkey where n_regionkey = {region}),
o as (select o_orderkey, cast(year(o_orderdate) as int) as o_year from {{orders}} join c on o_custkey = c_custkey where year(o_orderdate) in (1995, 1996)),
v as (select o_year, s_nationkey, {REV} as v from o join {{lineitem}} on l_orderkey = o_orderkey join {{part}} on p_partkey = l_partkey join {{supplier}} on s_suppkey = l_suppkey where p_type = '{kind}')
select o_year, round(sum(case when s_nationkey = {nation} then v else 0 end) / sum(v), 6) as mkt_share from v group by o_year order by o_year"""


def q9(word: str = "red") -> str:
    return f"""select n_name, cast(year(o_orderdate) as int) as o_year, round(sum({REV} - ps_supplycost * l_quantity), 2) as profit
from {{lineitem}} join {{part}} on p_partkey = l_partkey join {{supplier}} on s_suppkey = l_suppkey join {PARTSUPP} ps on ps_partkey = l_partkey and ps_suppkey = l_suppkey join {{orders}} on o_orderkey = l_orderkey join {{nation}} on s_nationkey = n_nationkey
where p_name like '%{word}%' group by n_name, year(o_orderdate) having sum({REV} - ps_supplycost * l_quantity) <> 0 order by n_name, o_year desc"""


def q10(start: str = "1996-10-01", end: str = "1996-12-31", limit: int = 20) -> str:
    return f"""with r as (select o_custkey, round(sum({REV}), 2) as revenue from {{orders}} join {{lineitem}} on l_orderkey = o_orderkey where l_returnflag = 'R' and o_orderdate between timestamp '{start}' and timestamp '{end}' group by o_custkey),
t as (select * from r order by revenue desc, o_custkey limit {limit})
select c_custkey, c_name, revenue, c_acctbal, n_name from t join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey order by revenue desc, c_custkey"""


def q11(nation: int = 7, fraction: float = 0.001) -> str:
    return f"""with v as (select ps_partkey, sum(ps_supplycost * ps_availqty) as value from {PARTSUPP} ps join {{supplier}} on ps_suppkey = s_suppkey where s_nationkey = {nation} group by ps_partkey)
select ps_partkey, round(value, 2) as value from v where value > {fraction} * (select sum(value) from v) order by value desc, ps_partkey"""


def q12(one: int = 2, two: int = 5, start: str = "1997-01-01", end: str = "1998-01-01") -> str:
    return f"""select cast(l_linenumber % 7 as int) as shipmode, cast(sum(case when o_orderpriority like '1%' or o_orderpriority like '2%' then 1 else 0 end) as bigint) as high_line_count, cast(sum(case when o_orderpriority like '1%' or o_orderpriority like '2%' then 0 else 1 end) as bigint) as low_line_count
from {LATE} x where l_linenumber % 7 in ({one}, {two}) and l_receiptdate >= timestamp '{start}' and l_receiptdate < timestamp '{end}' and l_commitdate < l_receiptdate and l_shipdate < l_commitdate group by l_linenumber % 7 order by 1"""


def q13(zero: bool = True) -> str:
    """zero: whether customers without orders are a bucket."""
    where = "" if zero else "where c_count > 0"
    return f"with c as (select c_custkey, count(o_orderkey) as c_count from {{customer}} left join {{orders}} on c_custkey = o_custkey group by c_custkey) select c_count, count(*) as custdist from c {where} group by c_count order by custdist desc, c_count desc"


def q14(start: str = "1997-09-01", end: str = "1997-09-30") -> str:
    return f"select round(100 * sum(case when p_type like 'PROMO%' then {REV} else 0 end) / sum({REV}), 4) as promo_revenue from {{lineitem}} join {{part}} on l_partkey = p_partkey where l_shipdate between timestamp '{start}' and timestamp '{end}'"


def q15(start: str = "1997-01-01", end: str = "1997-03-31") -> str:
    return f"""with r as (select l_suppkey, round(sum({REV}), 2) as total_revenue from {{lineitem}} where l_shipdate between timestamp '{start}' and timestamp '{end}' group by l_suppkey)
select s_suppkey, s_name, total_revenue from r join {{supplier}} on l_suppkey = s_suppkey where total_revenue = (select max(total_revenue) from r) order by s_suppkey"""


def q16(brand: str = "Brand#5", prefix: str = "MEDIUM", sizes: tuple = (49, 14, 23, 45, 19, 3, 36, 9), distinct: bool = True) -> str:
    count = "count(distinct ps_suppkey)" if distinct else "count(*)"
    return f"""select p_brand, p_type, p_size, {count} as supplier_cnt from {PARTSUPP} ps join {{part}} on p_partkey = ps_partkey where p_brand <> '{brand}' and p_type not like '{prefix}%' and p_size in {sizes}
  and ps_suppkey not in (select s_suppkey from {{supplier}} where s_acctbal < 0) group by p_brand, p_type, p_size order by supplier_cnt desc, p_brand, p_type, p_size"""


def q17(brand: str = "Brand#3", container: int = 1) -> str:
    return f"""with x as (select l_quantity, l_extendedprice, avg(l_quantity) over (partition by l_partkey) as a from {{lineitem}} join {{part}} on l_partkey = p_partkey where p_brand = '{brand}' and p_size % 4 = {container})
select round(sum(l_extendedprice) / 7, 2) as avg_yearly from x where l_quantity < 0.2 * a"""


def q18(quantity: int = 300) -> str:
    return f"""with big as (select l_orderkey, sum(l_quantity) as sum_qty from {{lineitem}} group by l_orderkey having sum(l_quantity) > {quantity})
select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum_qty from big join {{orders}} on l_orderkey = o_orderkey join {{customer}} on c_custkey = o_custkey order by o_totalprice desc, o_orderdate, o_orderkey"""


def q19(quantities: tuple = (1, 10, 20), brands: tuple = ("Brand#1", "Brand#2", "Brand#3"), sizes: tuple = (5, 10, 15)) -> str:
    blocks = " or ".join(f"(p_brand = '{b}' and p_size between 1 and {s} and l_quantity between {q} and {q + 10})" for q, b, s in zip(quantities, brands, sizes, strict=True))
    return f"select round(sum({REV}), 2) as revenue from {{lineitem}} join {{part}} on p_partkey = l_partkey where ({blocks}) and l_linenumber % 4 = 1 and l_linenumber % 7 in (1, 2, 3)"


def q20(nation: int = 3, word: str = "red", start: str = "1996-01-01", end: str = "1996-12-31") -> str:
    return f"""with shipped as (select l_partkey, l_suppkey, sum(l_quantity) as q from {{lineitem}} where l_shipdate between timestamp '{start}' and timestamp '{end}' group by l_partkey, l_suppkey),
ok as (select distinct ps_suppkey from {PARTSUPP} ps join {{part}} on p_partkey = ps_partkey left join shipped on l_partkey = ps_partkey and l_suppkey = ps_suppkey where p_name like '{word}%' and 2 * ps_availqty > coalesce(q, 0))
select s_suppkey, s_name from {{supplier}} join ok on ps_suppkey = s_suppkey where s_nationkey = {nation} order by s_suppkey"""


def q21(nation: int = 20) -> str:
    return f"""with o as (select l_orderkey, l_suppkey, max(case when l_receiptdate > l_commitdate then 1 else 0 end) as late from {LATE} x where o_orderstatus = 'F' group by l_orderkey, l_suppkey),
k as (select l_orderkey, l_suppkey, late, count(*) over (partition by l_orderkey) as supps, sum(late) over (partition by l_orderkey) as lates from o),
w as (select l_suppkey, count(*) as c from k where late = 1 and supps > 1 and lates = 1 group by l_suppkey)
select s_name, coalesce(c, 0) as numwait from {{supplier}} left join w on l_suppkey = s_suppkey where s_nationkey = {nation} order by numwait desc, s_name"""


def q22(codes: tuple = (1, 3, 5, 7, 9, 11, 13), since: str = "2000-06-01") -> str:
    """since: customers without orders from then on count."""
    return f"""with c as (select * from {{customer}} where c_nationkey in {codes})
select c_nationkey as cntrycode, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from c where c_acctbal > (select avg(c_acctbal) from c where c_acctbal > 0) and not exists (select 1 from {{orders}} where o_custkey = c_custkey and o_orderdate >= timestamp '{since}') group by c_nationkey order by c_nationkey"""


VARIANTS: dict[str, str] = {f.__name__: f() for f in (q1, q2, q3, q4, q5, q6, q7, q8, q8_customer_first, q9, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22)} | {
    "q5_all_nations": q5(all_nations=True),
    "q13_no_zero": q13(zero=False),
    "q16_plain_count": q16(distinct=False),
}


def _runner(template: str) -> Callable:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, template)


for _name, _template in VARIANTS.items():
    register(_name, plain(_template))(_runner(_template))
