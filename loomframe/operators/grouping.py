"""Grouping primitives: hash aggregates with partial sums, and dense results by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register
from ..tables import table


def reduce_by_key(rows: DataFrame, key: Column, agg: Column) -> DataFrame:
    """(key, value): one aggregate for each key."""
    return rows.groupBy(key.alias("key")).agg(agg.alias("value"))


def group_by_key(rows: DataFrame, key: Column, order: Column, value: Column) -> DataFrame:
    """(key, values): each key's values in input order. A list is a row, so keys must be small enough for one."""
    return rows.groupBy(key.alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]).alias("values"))


def histogram_by_key(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("count"))


def reduce_by_index(rows: DataFrame, index: Column, buckets: int, agg: Column, zero) -> DataFrame:
    """(index, value) for every index below ``buckets``; those without rows get the identity."""
    got = rows.groupBy(index.cast("long").alias("index")).agg(agg.alias("value"))
    every = rows.sparkSession.range(buckets).select(F.col("id").alias("index"))
    return every.join(got, "index", "left").select("index", F.coalesce("value", F.lit(zero)).alias("value"))


def group_by_index(rows: DataFrame, index: Column, buckets: int, order: Column, value: Column) -> DataFrame:
    got = group_by_key(rows, index.cast("long"), order, value).withColumnRenamed("key", "index")
    every = rows.sparkSession.range(buckets).select(F.col("id").alias("index"))
    return every.join(got, "index", "left").select("index", F.coalesce("values", F.array().cast("array<long>")).alias("values"))


def salted_reduce(rows: DataFrame, key: Column, value: Column, salts: int = 32) -> DataFrame:
    """(key, distinct): distinct values a key, salted by value so that a hot key spreads."""
    spread = rows.select(key.alias("key"), value.alias("v"), F.pmod(F.xxhash64(value), F.lit(salts)).alias("s"))
    part = spread.groupBy("key", "s").agg(F.count_distinct("v").alias("d"))
    return part.groupBy("key").agg(F.sum("d").alias("distinct"))


def _lines(spark, d):
    return table(spark, d, "lineitem")


register("reduce_by_key", "select l_partkey as key, round(sum(l_quantity), 2) as value from lineitem group by 1")(lambda s, d: reduce_by_key(_lines(s, d), F.col("l_partkey"), F.round(F.sum("l_quantity"), 2)))
register("group_by_key", "select c_nationkey as key, list(c_custkey order by c_custkey) as values from customer group by 1")(lambda s, d: group_by_key(table(s, d, "customer"), F.col("c_nationkey"), F.col("c_custkey"), F.col("c_custkey")))
register("group_by_key_ordered", "select c_mktsegment as key, list(c_custkey order by c_custkey) as values from customer group by 1 order by 1")(lambda s, d: group_by_key(table(s, d, "customer"), F.col("c_mktsegment"), F.col("c_custkey"), F.col("c_custkey")).orderBy("key"))
register("histogram_by_key", "select l_suppkey as key, count(*) as count from lineitem group by 1")(lambda s, d: histogram_by_key(_lines(s, d), F.col("l_suppkey")))
register("remove_duplicates", "select distinct l_partkey, l_suppkey from lineitem")(lambda s, d: _lines(s, d).select("l_partkey", "l_suppkey").distinct())
register("reduce_by_index", "select i as index, coalesce(v, 0) as value from range(64) t(i) left join (select cast(p_size as bigint) as k, round(sum(p_retailprice), 2) as v from part group by 1) p on k = i")(lambda s, d: reduce_by_index(table(s, d, "part"), F.col("p_size"), 64, F.round(F.sum("p_retailprice"), 2), 0.0))
register("histogram_by_index", "select i as index, coalesce(v, 0) as value from range(64) t(i) left join (select cast(p_size as bigint) as k, count(*) as v from part group by 1) p on k = i")(lambda s, d: reduce_by_index(table(s, d, "part"), F.col("p_size"), 64, F.count("*"), 0))
register("remove_duplicate_integers", "select distinct cast(l_quantity as bigint) as q from lineitem")(lambda s, d: _lines(s, d).select(F.col("l_quantity").cast("long").alias("q")).distinct())
register("group_by_index", "select i as index, coalesce(v, []) as values from range(64) t(i) left join (select cast(p_size as bigint) as k, list(p_partkey order by p_partkey) as v from part group by 1) p on k = i")(lambda s, d: group_by_index(table(s, d, "part"), F.col("p_size"), 64, F.col("p_partkey"), F.col("p_partkey")))
register("group_by_and_combine", "select o_custkey as key, round(sum(o_totalprice), 2) as value from orders group by 1")(lambda s, d: reduce_by_key(table(s, d, "orders"), F.col("o_custkey"), F.round(F.sum("o_totalprice"), 2)))
register("collect_reduce_sparse", "select l_returnflag as key, count(distinct l_partkey) as distinct from lineitem group by 1")(lambda s, d: salted_reduce(_lines(s, d), F.col("l_returnflag"), F.col("l_partkey")))
register(
    "monoids",
    "select l_linenumber as key, cast(bit_and(l_orderkey) as bigint) as a, cast(bit_or(l_orderkey) as bigint) as o, cast(bit_xor(l_orderkey) as bigint) as x, min(l_orderkey) as lo, max(l_orderkey) as hi, bool_and(l_tax > 0) as every, bool_or(l_tax > 0.07) as some from lineitem group by 1",
)(lambda s, d: _lines(s, d).groupBy(F.col("l_linenumber").alias("key")).agg(F.bit_and("l_orderkey").alias("a"), F.bit_or("l_orderkey").alias("o"), F.bit_xor("l_orderkey").alias("x"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"), F.bool_and(F.expr("l_tax > 0")).alias("every"), F.bool_or(F.expr("l_tax > 0.07")).alias("some")))
