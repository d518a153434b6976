"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import register
from ..tables import table
from .hashing import hashed, hashed_sql


def three_way(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a compares with b."""
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


def ordered_contains(c: Column, one: str, two: str) -> Column:
    """Whether ``two`` comes somewhere after ``one``."""
    after = F.substring(c, F.instr(c, one) + len(one), F.lit(2147483647))
    return F.contains(c, F.lit(one)) & F.contains(after, F.lit(two))


def two_digit_code(c: Column) -> Column:
    return F.expr("try_cast(null as int)") if c is None else F.substring(c, 1, 2).try_cast("int")


def letters_only(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z]", " "))


def checked_length(c: Column, most: int) -> Column:
    """The text; a longer one is an error."""
    return F.when(F.char_length(c) <= most, c).otherwise(F.raise_error(F.lit(f"longer than {most}")))


def percent(hundredths: Column) -> Column:
    return hundredths / 100.0


def log_sum(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """L1 distance of two pairs given as logs."""
    return F.abs(F.exp(a0) - F.exp(b0)) + F.abs(F.exp(a1) - F.exp(b1))


def signed_log2(x: Column) -> Column:
    """sign(x) * floor(log2 |x|), 0 at 0."""
    return F.when(x == 0, 0).otherwise(F.signum(x) * F.floor(F.log2(F.abs(x)))).cast("int")


def hash_range(seed: int, a: Column, lo: int, hi: int) -> Column:
    """A reproducible value in [lo, hi)."""
    return lo + hashed(a, seed=seed) % (hi - lo)


def sdbm(c: Column, bits: int = 32) -> Column:
    """The rolling string hash h = code + 65599 h, modulo 2**bits, of the text's code points."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * 65599 + x) % (1 << bits))


def next_day_of_28(year: Column, month: Column, day: Column) -> Column:
    """(y, m, d) of the following day where every month has 28 days."""
    last, december = day >= 28, month >= 12
    return F.struct(
        F.when(last & december, year + 1).otherwise(year).alias("y"), F.when(last & december, 1).when(last, month + 1).otherwise(month).alias("m"), F.when(last, 1).otherwise(day + 1).alias("d"),
    )


def _register() -> None:
    register("string_hash", "select p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda x: cast(ord(x) as bigint)), lambda h, x: (h * 65599 + x) % 4294967296, cast(0 as bigint)) as h from part")(
        lambda s, d: table(s, d, "part").select("p_partkey", sdbm(F.col("p_name")).alias("h"))
    )
    register("days_of_28", "select o_orderkey, case when day(o_orderdate) >= 28 and month(o_orderdate) >= 12 then year(o_orderdate) + 1 else year(o_orderdate) end as y, case when day(o_orderdate) >= 28 and month(o_orderdate) >= 12 then 1 when day(o_orderdate) >= 28 then month(o_orderdate) + 1 else month(o_orderdate) end as m, case when day(o_orderdate) >= 28 then 1 else day(o_orderdate) + 1 end as d from orders")(
        lambda s, d: table(s, d, "orders").select("o_orderkey", next_day_of_28(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("x")).select("o_orderkey", "x.y", "x.m", "x.d")
    )
    register("percent_value", "select l_orderkey, l_linenumber, cast(round(l_discount * 100) as int) / 100.0e0 as value from lineitem")(
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", percent(F.round(F.col("l_discount") * 100).cast("int")).alias("value"))
    )
    register("string_functions", "select p_partkey, case when p_brand < 'Brand#2' then -1 when p_brand = 'Brand#2' then 0 else 1 end as cmp, p_type like '%MO' as ends, p_type like 'PRO%' as starts, contains(p_name, '1') as has, p_name like '%a%t%' as ordered, p_type in ('PROMO', 'SMALL') as listed, lower(regexp_replace(p_brand, '[^A-Za-z]', ' ', 'g')) as clean, try_cast(substr(p_brand, 7, 2) as int) as code from part")(
        lambda s, d: table(s, d, "part").select(
            "p_partkey", three_way(F.col("p_brand"), F.lit("Brand#2")).alias("cmp"), F.endswith("p_type", F.lit("MO")).alias("ends"), F.startswith("p_type", F.lit("PRO")).alias("starts"), F.contains("p_name", F.lit("1")).alias("has"),
            ordered_contains(F.col("p_name"), "a", "t").alias("ordered"), F.col("p_type").isin("PROMO", "SMALL").alias("listed"), letters_only(checked_length(F.col("p_brand"), 100)).alias("clean"), two_digit_code(F.substring("p_brand", 7, 2)).alias("code"),
        )
    )
    register("date_functions", "select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(day(o_orderdate) as int) as d, strftime(o_orderdate, '%Y-%m-%d') as text, strftime(o_orderdate + interval 1 day, '%Y-%m-%d') as next, o_orderdate <= timestamp '1998-01-01' as early from orders")(
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"), F.date_add(F.to_date("o_orderdate"), 1).cast("string").alias("next"), (F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz")).alias("early"))
    )
    register("math_functions", "select l_orderkey, l_linenumber, round(greatest(l_tax, l_discount) + ln(1 + exp(-abs(l_tax - l_discount))), 8) as lse, cast(case when l_partkey = 500 then 0 else sign(l_partkey - 500) * floor(log2(abs(l_partkey - 500))) end as int) as lg, l_partkey >> 3 as bucket, round(sin(l_quantity) + cos(l_tax) + atan2(l_tax, l_quantity) + sqrt(l_quantity), 8) as trig, round(abs(exp(-l_tax) - exp(-l_discount)) * 2, 8) as dist from lineitem")(
        lambda s, d: table(s, d, "lineitem").select(
            "l_orderkey", "l_linenumber", F.round(log_sum(F.col("l_tax"), F.col("l_discount")), 8).alias("lse"), signed_log2(F.col("l_partkey") - 500).alias("lg"), F.shiftright("l_partkey", 3).alias("bucket"),
            F.round(F.sin("l_quantity") + F.cos("l_tax") + F.atan2("l_tax", "l_quantity") + F.sqrt("l_quantity"), 8).alias("trig"), F.round(log_distance(-F.col("l_tax"), -F.col("l_tax"), -F.col("l_discount"), -F.col("l_discount")), 8).alias("dist"),
        )
    )
    register("parse_numbers", "select doc_id, try_cast(regexp_extract(text, '[0-9]+') as bigint) as n from documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.regexp_extract("text", "[0-9]+", 0).try_cast("long").alias("n")))
    register("hash_range", f"select o_orderkey, 10 + {hashed_sql('o_orderkey', seed=7)} % 10 as h from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", hash_range(7, F.col("o_orderkey"), 10, 20).alias("h")))


_register()
