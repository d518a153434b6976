"""Graphs as edges (src, dst, w): transformations, statistics, and the frontier operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hashed, hashed_sql
from ..registry import register
from ..tables import table
from .sequence import dense


def order_graph(spark, d: str) -> DataFrame:
    """Every order is an edge from its customer to a customer that its key picks, weighted 1 to 10."""
    n = table(spark, d, "customer").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").crossJoin(F.broadcast(n))  # one row
    return o.select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31 + 7) % F.col("n")).alias("dst"), (1 + F.col("o_orderkey") % 10).alias("w"))


def vertices_of(spark, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"))


def transpose(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def symmetrise(e: DataFrame) -> DataFrame:
    """With every edge's reverse, blindly."""
    return e.unionByName(transpose(e))


def undirected(e: DataFrame) -> DataFrame:
    """(src, dst), both directions, without loops and repeats."""
    return symmetrise(e.select("src", "dst")).where("src <> dst").distinct()


def cleanup(e: DataFrame) -> DataFrame:
    """Without loops; of repeated edges the lightest stays."""
    return e.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def relabel(e: DataFrame, names: DataFrame) -> DataFrame:
    """Edges under new ids by a map (id, new); edges with an end outside the map go."""
    a, b = names.toDF("src", "s"), names.toDF("dst", "t")
    return e.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def degrees(e: DataFrame, vertices: DataFrame, side: str = "src") -> DataFrame:
    """(id, degree) of every vertex, 0 included."""
    return vertices.join(e.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_order(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, new): dense names by falling degree, then id."""
    deg = degrees(e, vertices).select((-F.col("degree")).alias("k"), "id")
    return dense(deg.withColumnRenamed("id", "i"), ["k", "i"]).select(F.col("i").alias("id"), F.col("idx").alias("new"))


def parent_degree_order(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, new): dense names by falling greatest degree among predecessors, then id."""
    deg = degrees(e, vertices).select(F.col("id").alias("src"), "degree")
    best = e.join(deg, "src").groupBy(F.col("dst").alias("id")).agg(F.max("degree").alias("m"))
    k = vertices.join(best, "id", "left").select((-F.coalesce("m", F.lit(0))).alias("k"), F.col("id").alias("i"))
    return dense(k, ["k", "i"]).select(F.col("i").alias("id"), F.col("idx").alias("new"))


def without_high_degree(e: DataFrame, vertices: DataFrame, most: int) -> DataFrame:
    keep = degrees(e, vertices).where(F.col("degree") <= most).select(F.col("id").alias("i"))
    return relabel(e, dense(keep, ["i"]).select(F.col("i").alias("id"), F.col("idx").alias("new")))


def random_names(vertices: DataFrame, seed: int = 1) -> DataFrame:
    return dense(vertices.select(hashed(F.col("id"), seed=seed).alias("h"), F.col("id").alias("i")), ["h", "i"]).select(F.col("i").alias("id"), F.col("idx").alias("new"))


def random_weights(e: DataFrame, lo: int, hi: int, seed: int = 1) -> DataFrame:
    return e.withColumn("w", lo + hashed(F.col("src"), F.col("dst"), seed=seed) % (hi - lo + 1))


def add_ring(e: DataFrame, n: int, closed: bool = True) -> DataFrame:
    """With edges i -> i - 1 (and 0 -> n - 1 if closed), weight 1."""
    ring = e.sparkSession.range(0 if closed else 1, n).select(F.col("id").alias("src"), F.pmod(F.col("id") - 1, F.lit(n)).alias("dst"), F.lit(1).cast("long").alias("w"))
    return e.select("src", "dst", "w").unionByName(ring)


def add_tree(e: DataFrame, n: int, both: bool = False) -> DataFrame:
    """With the edges i -> 2 i + 1 and 2 i + 2 of a binary tree, weight 1."""
    tree = e.sparkSession.range(n).select(F.col("id").alias("src"), F.explode(F.array(2 * F.col("id") + 1, 2 * F.col("id") + 2)).alias("dst"), F.lit(1).cast("long").alias("w")).where(F.col("dst") < n)
    return e.select("src", "dst", "w").unionByName(symmetrise(tree) if both else tree)


def sorted_edges(e: DataFrame, by: str = "dst") -> DataFrame:
    """Adjacencies together and sorted; one shuffle by range of the source."""
    return e.repartitionByRange("src").sortWithinPartitions("src", by)


def parts_by_edges(e: DataFrame, vertices: DataFrame, parts: int, side: str = "src") -> DataFrame:
    """(id, part): vertices in order, cut so that each part has about as many edges."""
    from .sequence import scan

    deg = degrees(e, vertices, side).select(F.col("id").alias("i"), "degree")
    at = scan(dense(deg, ["i"]).select("idx", F.col("degree").alias("x"))).select("idx", "prefix").join(dense(deg, ["i"]).select("idx", "i"), "idx")
    m = e.agg(F.count("*").alias("m"))
    return at.crossJoin(F.broadcast(m)).select(F.col("i").alias("id"), F.least(F.expr(f"prefix * {parts} div greatest(m, 1)"), F.lit(parts - 1)).alias("part"))  # one row


def offsets(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, offset): where each vertex' edges begin in the adjacency array."""
    from .sequence import scan

    deg = degrees(e, vertices).select(F.col("id").alias("i"), "degree")
    d = dense(deg, ["i"])
    return scan(d.select("idx", F.col("degree").alias("x"))).select("idx", "prefix").join(d.select("idx", "i"), "idx").select(F.col("i").alias("id"), F.col("prefix").alias("offset"))


def inconsistent(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with an end that is no vertex: none in a consistent graph."""
    known = vertices.select("id")
    return e.join(known.toDF("src"), "src", "left_anti").unionByName(e.join(known.toDF("dst"), "dst", "left_anti").select(*e.columns))


def histogram(values: DataFrame, width: int = 1) -> DataFrame:
    """(bin, n) of rows (x), gaps filled from 0 to the last bin."""
    got = values.groupBy(F.floor(F.col("x") / width).alias("bin")).agg(F.count("*").alias("n"))
    top = got.agg(F.max("bin")).first()[0]
    return values.sparkSession.range((top or 0) + 1).select(F.col("id").alias("bin")).join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def sparsity(e: DataFrame, n: int, columns: int) -> DataFrame:
    """(row, col): blocks of a columns x columns grid that hold an edge."""
    at = lambda c: F.floor(F.col(c) * columns / n)
    return e.select(at("src").alias("row"), at("dst").alias("col")).distinct()


# Frontier operators: a vertex subset is a DataFrame (id, and its data if any).


def edge_map(e: DataFrame, frontier: DataFrame, value: Column, reduce: Callable[[str], Column], visited: DataFrame | None = None) -> DataFrame:
    """(id, value): targets of edges out of the frontier, each with the reduced value; ``visited`` ones are left out.

    value may use the frontier's columns and w. Whether the frontier is
    broadcast (sparse) or shuffled (dense) is left to the adaptive planner.
    """
    out = frontier.withColumnRenamed("id", "src").join(e, "src").select("dst", value.alias("value")).groupBy(F.col("dst").alias("id")).agg(reduce("value").alias("value"))
    return out if visited is None else out.join(visited.select("id"), "id", "left_anti")


def edge_map_filter(e: DataFrame, frontier: DataFrame, p: Column) -> DataFrame:
    """(id, n): how many neighbours of each frontier vertex satisfy ``p`` (over src, dst, w)."""
    return frontier.select(F.col("id").alias("src")).join(e, "src", "left").groupBy(F.col("src").alias("id")).agg(F.count_if(p).alias("n"))


def pack_edges(e: DataFrame, frontier: DataFrame, p: Column) -> DataFrame:
    """The graph without the frontier's edges that fail ``p``."""
    mine = frontier.select(F.col("id").alias("src")).withColumn("__f", F.lit(True))
    return e.join(mine, "src", "left").where(F.col("__f").isNull() | p).drop("__f")


def hyper_step(members: DataFrame, frontier: DataFrame, from_vertices: bool = True) -> DataFrame:
    """(id, n): hyperedges touched by vertices, or the other way, of memberships (v, h); n counts the touching ones."""
    a, b = ("v", "h") if from_vertices else ("h", "v")
    return frontier.select(F.col("id").alias(a)).join(members, a).groupBy(F.col(b).alias("id")).agg(F.count("*").alias("n"))


def take_bucket(state: DataFrame) -> tuple[int | None, DataFrame]:
    """The least open bucket of (id, bucket; null: closed) and its ids."""
    least = state.agg(F.min("bucket")).first()[0]
    return least, state.where(F.col("bucket") == least).select("id")


G = "(select o_custkey as src, (o_orderkey * 31 + 7) % (select count(*) from customer) as dst, 1 + o_orderkey % 10 as w from orders)"
_V = "(select c_custkey as id from customer)"
UND = f"(select distinct src, dst from (select src, dst from {G} union all select dst, src from {G}) where src <> dst)"


def _g(name: str, sql: str | None):
    def add(f):
        register(name, sql)(lambda s, d: f(order_graph(s, d), vertices_of(s, d)))

    return add


_DEG = f"(select id, (select count(*) from {G} where src = id) as degree from {_V})"
_g("transpose", f"select dst as src, src as dst, w from {G}")(lambda e, v: transpose(e))
_g("symmetrise", f"select src, dst, w from {G} union all select dst, src, w from {G}")(lambda e, v: symmetrise(e))
_g("make_undirected", f"select src, dst from {UND}")(lambda e, v: undirected(e))
_g("cleanup", f"select src, dst, min(w) as w from {G} where src <> dst group by 1, 2")(lambda e, v: cleanup(e))
_g("remove_duplicate_edges", f"select distinct src, dst from {G}")(lambda e, v: e.select("src", "dst").distinct())
_g("lower_triangle", f"select src, dst, w from {G} where src <= dst")(lambda e, v: e.where("src <= dst"))
_g("sorted_by_dst", f"select src, dst, w from {G}")(lambda e, v: sorted_edges(e))
_g("sorted_by_weight", f"select src, dst, w from {G}")(lambda e, v: sorted_edges(e, "w"))
_NEW = f"(select id, row_number() over (order by degree desc, id) - 1 as new from {_DEG})"
_g("sorted_degree", f"select a.new as src, b.new as dst, w from {G} g join {_NEW} a on a.id = src join {_NEW} b on b.id = dst")(lambda e, v: relabel(e, degree_order(e, v)))
_PNEW = f"(select id, row_number() over (order by coalesce(m, 0) desc, id) - 1 as new from {_V} left join (select dst, max(degree) as m from {G} join {_DEG} on id = src group by dst) on dst = id)"
_g("sorted_parent_degree", f"select a.new as src, b.new as dst, w from {G} g join {_PNEW} a on a.id = src join {_PNEW} b on b.id = dst")(lambda e, v: relabel(e, parent_degree_order(e, v)))
_LOW = f"(select id, row_number() over (order by id) - 1 as new from {_DEG} where degree <= 10)"
_g("low_degree", f"select a.new as src, b.new as dst, w from {G} g join {_LOW} a on a.id = src join {_LOW} b on b.id = dst")(lambda e, v: without_high_degree(e, v, 10))
_g("remap", f"select src * 2 as src, dst * 2 as dst, w from {G}")(lambda e, v: relabel(e, v.select("id", (2 * F.col("id")).alias("new"))))
_RNEW = f"(select id, row_number() over (order by {hashed_sql('id', seed=1)}, id) - 1 as new from {_V})"
_g("randomise_nodes", f"select a.new as src, b.new as dst, w from {G} g join {_RNEW} a on a.id = src join {_RNEW} b on b.id = dst")(lambda e, v: relabel(e, random_names(v)))
_g("randomise_weights", f"select src, dst, 1 + {hashed_sql('src', 'dst', seed=1)} % 100 as w from {G}")(lambda e, v: random_weights(e, 1, 100))
_g("add_ring", f"select src, dst, w from {G} union all select i, (i + 99) % 100, 1 from range(100) t(i)")(lambda e, v: add_ring(e, 100))
_g("add_line", f"select src, dst, w from {G} union all select i, i - 1, 1 from range(1, 100) t(i)")(lambda e, v: add_ring(e, 100, False))
_g("add_tree", f"select src, dst, w from {G} union all select i, 2 * i + j, 1 from range(100) t(i), range(1, 3) u(j) where 2 * i + j < 100")(lambda e, v: add_tree(e, 100))
_g("partition_by_source", f"select id, least((c * 8) // (select count(*) from {G}), 7) as part from (select id, cast(coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as c from {_DEG})")(lambda e, v: parts_by_edges(e, v, 8))
_DDEG = f"(select id, (select count(*) from {G} where dst = id) as degree from {_V})"
_g("partition_by_destination", f"select id, least((c * 8) // (select count(*) from {G}), 7) as part from (select id, cast(coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as c from {_DDEG})")(lambda e, v: parts_by_edges(e, v, 8, "dst"))
_g("offsets", f"select id, cast(coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from {_DEG}")(lambda e, v: offsets(e, v))
_g("adjacency_lists", f"select src, list(dst order by dst) as neighbours from {G} group by src")(lambda e, v: e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours")))
_g("check_consistency", f"select src, dst, w from {G} where src not in (select c_custkey from customer) or dst not in (select c_custkey from customer)")(lambda e, v: inconsistent(e, v))
_g("find_edge", f"select src, dst, w from {G} where src = 7 and dst in (select dst from {G} where src = 7)")(lambda e, v: e.where("src = 7"))
_g("graph_summary", f"select (select count(*) from customer) as n, count(*) as m from {G}")(lambda e, v: v.agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("m"))))
_g("degrees", f"select id, degree from {_DEG}")(lambda e, v: degrees(e, v))
_g("max_degree_node", f"select id, degree from {_DEG} order by degree desc, id limit 1")(lambda e, v: degrees(e, v).orderBy(F.desc("degree"), "id").limit(1))
_g("degree_histogram", f"select b as bin, (select count(*) from {_DEG} where degree = b) as n from range((select max(degree) + 1 from {_DEG})) t(b)")(lambda e, v: histogram(degrees(e, v).select(F.col("degree").alias("x"))))
_g("in_degree_histogram", f"select b as bin, (select count(*) from {_DDEG} where degree = b) as n from range((select max(degree) + 1 from {_DDEG})) t(b)")(lambda e, v: histogram(degrees(e, v, "dst").select(F.col("degree").alias("x"))))
_g("binned_degree_histogram", f"select b as bin, (select count(*) from {_DEG} where degree // 5 = b) as n from range((select max(degree) // 5 + 1 from {_DEG})) t(b)")(lambda e, v: histogram(degrees(e, v).select(F.col("degree").alias("x")), 5))
_g("destination_histogram", f"select dst, count(*) as n from {G} group by dst")(lambda e, v: e.groupBy("dst").agg(F.count("*").alias("n")))
_g("sparsity_pattern", f"select distinct src * 10 // 2000 as row, dst * 10 // 2000 as col from {G}")(lambda e, v: sparsity(e, 2000, 10))
_g("edge_map", f"select dst as id, min(w) as value from {G} where src < 50 and dst >= 50 group by dst")(lambda e, v: edge_map(e, v.where("id < 50"), F.col("w"), F.min, v.where("id < 50")))
_g("edge_map_induced", f"select distinct dst as id from {G} where src < 50")(lambda e, v: edge_map(e, v.where("id < 50"), F.col("w"), F.min).select("id"))
_g("edge_map_reduce", f"select dst as id, cast(sum(w * src) as bigint) as value from {G} group by dst")(lambda e, v: edge_map(e, v.withColumn("x", F.col("id")), F.col("w") * F.col("x"), F.sum))
_g("edge_map_count", f"select dst as id, count(*) as value from {G} where src < 500 group by dst")(lambda e, v: edge_map(e, v.where("id < 500"), F.col("w"), F.count))
_g("edge_map_filter", f"select c_custkey as id, (select count(*) from {G} where src = c_custkey and w > 5) as n from customer")(lambda e, v: edge_map_filter(e, v, F.col("w") > 5))
_g("pack_edges", f"select src, dst, w from {G} where src >= 100 or w > 5")(lambda e, v: pack_edges(e, v.where("id < 100"), F.col("w") > 5))
_g("vertex_map", "select c_custkey as id, c_custkey * 2 as x from customer")(lambda e, v: v.select("id", (F.col("id") * 2).alias("x")))
_g("vertex_filter", "select c_custkey as id from customer where c_custkey % 3 = 1")(lambda e, v: v.where("id % 3 = 1"))
register("hyper_propagate", "select l_partkey as id, count(*) as n from lineitem where l_orderkey < 1000 group by 1")(lambda s, d: hyper_step(table(s, d, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("h")), table(s, d, "orders").where("o_orderkey < 1000").select(F.col("o_orderkey").alias("id")), False))
register("next_bucket", "select o_custkey as id from orders where o_orderkey % 17 = (select min(o_orderkey % 17) from orders)")(lambda s, d: take_bucket(table(s, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 17).alias("bucket")))[1])


def without(e: DataFrame, gone: DataFrame, nodes: bool = False) -> DataFrame:
    """The graph without edges (src, dst), or without nodes (id) and their edges."""
    if nodes:
        return e.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select(*e.columns)
    return e.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*e.columns)


def edges_of_lists(lists: DataFrame) -> DataFrame:
    """(src, dst) of adjacency lists (src, neighbours)."""
    return lists.select("src", F.explode("neighbours").alias("dst"))


def adjacency_lists(e: DataFrame) -> DataFrame:
    """(src, neighbours): sorted lists; a list is a row."""
    return e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def parts_by_nodes_and_edges(e: DataFrame, vertices: DataFrame, parts: int, node_size: int = 1, edge_size: int = 1) -> DataFrame:
    """(id, part): vertices in order, cut so that each part has about the same weighted sum of nodes and edges."""
    from .sequence import scan

    deg = dense(degrees(e, vertices).select(F.col("id").alias("i"), (node_size + edge_size * F.col("degree")).alias("x")), ["i"])
    at = scan(deg.select("idx", "x")).select("idx", "prefix").join(deg.select("idx", "i"), "idx")
    total = deg.agg(F.sum("x").alias("total"))
    return at.crossJoin(F.broadcast(total)).select(F.col("i").alias("id"), F.least(F.expr(f"prefix * {parts} div total"), F.lit(parts - 1)).alias("part"))  # one row


_g("transpose_in_place", f"select dst as src, src as dst, w from {G}")(lambda e, v: transpose(transpose(transpose(e))))
_g("partitioned_transpose", f"select dst as src, src as dst, w, dst % 4 as part from {G}")(lambda e, v: transpose(e).withColumn("part", F.col("src") % 4).repartition(4, "part"))
_g("partitioned_random_weights", f"select src, dst, 1 + {hashed_sql('src', 'dst', seed=5)} % 10 as w from {G}")(lambda e, v: random_weights(e, 1, 10, 5))
_g("clean_without_data", f"select distinct src, dst from {G} where src <> dst")(lambda e, v: e.where("src <> dst").select("src", "dst").distinct())
_g("remap_by_file", f"select n - 1 - src as src, n - 1 - dst as dst, w from {G}, (select count(*) as n from customer)")(lambda e, v: relabel(e, v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n")))).select("id", (F.col("n") - 1 - F.col("id")).alias("new"))))  # one row
_RNEW5 = f"(select id, row_number() over (order by {hashed_sql('id', seed=5)}, id) - 1 as new from {_V})"
_g("graph_reorder", f"select a.new as src, b.new as dst, w from {G} g join {_RNEW5} a on a.id = src join {_RNEW5} b on b.id = dst")(lambda e, v: relabel(e, random_names(v, 5)))
_g("edges_from_graph", f"select src, dst from {G}")(lambda e, v: edges_of_lists(adjacency_lists(e)))
_g("sort_edges_by_data", f"select src, list(dst order by w, dst) as neighbours from {G} group by src")(lambda e, v: e.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "dst"))), lambda x: x["dst"]).alias("neighbours")))
_g("sort_edges_by_dst", f"select src, list(w order by dst, w) as weights from {G} group by src")(lambda e, v: e.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("dst", "w"))), lambda x: x["w"]).alias("weights")))
_g("graph_add_edges", f"select src, dst, w from {G} union all select src, src, 0 from (select distinct src from {G} where w = 1)")(lambda e, v: e.unionByName(e.where("w = 1").select("src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("w")).distinct()))
_g("graph_remove_edges", f"select src, dst, w from {G} where (src, dst) not in (select (src, dst) from {G} where w = 3)")(lambda e, v: without(e, e.where("w = 3")))
_g("graph_remove_nodes", f"select src, dst, w from {G} where src % 9 <> 0 and dst % 9 <> 0")(lambda e, v: without(e, v.where("id % 9 = 0").select("id"), True))
_g("divide_by_node", f"select id, least((c * 6) // (select sum(2 + 3 * degree) from {_DEG}), 5) as part from (select id, cast(coalesce(sum(2 + 3 * degree) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as c from {_DEG})")(lambda e, v: parts_by_nodes_and_edges(e, v, 6, 2, 3))
