"""Graph analytics as rounds of joins and partial aggregates on vertex keys.

State is a DataFrame that each round writes (see ``stored``), so lineage stays
short and a lost executor costs one round. Edges are read from their own
written copy in every round. Rounds end when nothing changes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hashed, hashed_sql
from ..registry import register
from ..tables import forget, scratch, stored, table
from .graph import UND, G, degrees, order_graph, undirected, vertices_of
from .sequence import dense


#: Written changes that are read side by side before they are put together.
_CHANGES = 16


class _Growing:
    """A table of which each round writes the new rows only; every _CHANGES rounds ``together`` makes one table of what was written."""

    def __init__(self, first: DataFrame, together: Callable[[DataFrame], DataFrame] = lambda x: x):
        self.parts, self.together = [stored(first)], together

    def rows(self) -> DataFrame:
        """Everything written, before ``together``."""
        return reduce(DataFrame.unionByName, self.parts)

    def add(self, new: DataFrame) -> DataFrame:
        """Writes ``new``, which may read this table, and returns it."""
        new = stored(new)
        self.parts.append(new)
        return new

    def settle(self) -> None:
        if len(self.parts) > _CHANGES:
            whole = stored(self.together(self.rows()))
            for x in self.parts[:-1]:  # the last one may be the next round's frontier
                forget(x)
            self.parts = [whole]


def bfs(e: DataFrame, source: int, max_rounds: int = 1 << 20) -> DataFrame:
    """(id, dist, parent): hops from the source; the parent is the least predecessor on a shortest path, the source's own is itself.

    A round writes its level only.
    """
    e = stored(e.select("src", "dst").distinct())
    front = e.sparkSession.createDataFrame([(source, 0, source)], "id long, dist long, parent long")
    seen = _Growing(front)
    for r in range(1, max_rounds):
        near = front.select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = seen.add(near.join(seen.rows().select("id"), "id", "left_anti").select("id", F.lit(r).cast("long").alias("dist"), "parent"))
        if front.isEmpty():
            break
        seen.settle()
    return seen.rows()


def shortest_paths(e: DataFrame, source: int, delta: int | None = None, target: int | None = None, bound: Callable[[DataFrame], DataFrame] | None = None, max_rounds: int = 1 << 20) -> DataFrame:
    """(id, dist, parent): least weights from the source, for weights >= 0.

    With ``delta`` only the open vertices of the least distance bucket of that
    width push in a round. With ``target`` whatever cannot shorten its distance
    is pruned; ``bound`` may add a column h to (id, dist), a lower bound of the
    way still to go. A round writes the distances that got shorter, and the open vertices.
    """
    spark = e.sparkSession
    e = stored(e.groupBy("src", "dst").agg(F.min("w").alias("w")))
    least = lambda x: x.groupBy("id").agg(F.min(F.struct("dist", "parent")).alias("b")).select("id", "b.dist", "b.parent")
    first = spark.createDataFrame([(source, 0, source)], "id long, dist long, parent long")
    known, open_ = _Growing(first, least), stored(first.select("id", "dist"))
    for _ in range(max_rounds):
        active = open_
        if target is not None:
            best = known.rows().where(F.col("id") == target).agg(F.min("dist")).first()[0]
            if best is not None:
                active = bound(active).where(F.col("dist") + F.col("h") < best).select("id", "dist") if bound else active.where(F.col("dist") < best)
        push = active
        if delta is not None:
            nearest = active.agg(F.min("dist")).first()[0]
            if nearest is None:
                break
            push = active.where(F.col("dist") < (nearest // delta + 1) * delta)
        offers = push.select(F.col("id").alias("src"), "dist").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("parent"))).alias("o")).select("id", "o.dist", "o.parent")
        now = known.rows().groupBy("id").agg(F.min("dist").alias("now"))
        better = known.add(offers.join(now, "id", "left").where("now is null or dist < now").select("id", "dist", "parent"))
        if delta is None:
            after = better.select("id", "dist")
        else:
            after = active.join(push.select("id"), "id", "left_anti").unionByName(better.select("id", "dist")).groupBy("id").agg(F.min("dist").alias("dist"))
        after = stored(after)
        if after.isEmpty():
            break
        forget(open_)
        open_ = after
        known.settle()
    return least(known.rows())


def bellman_ford(e: DataFrame, source: int, vertices: int) -> DataFrame | None:
    """(id, dist) with any weights; None if a negative cycle can be reached."""
    e = stored(e.groupBy("src", "dst").agg(F.min("w").alias("w")))
    state = stored(e.sparkSession.createDataFrame([(source, 0)], "id long, dist long"))
    for _ in range(vertices):
        offers = state.select(F.col("id").alias("src"), "dist").join(e, "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"))
        new = stored(state.unionByName(offers).groupBy("id").agg(F.min("dist").alias("dist")))
        changed = not new.join(state, ["id", "dist"], "left_anti").isEmpty()
        state = new
        if not changed:
            return state
    return None


def path(found: DataFrame, target: int) -> DataFrame:
    """(step, id, dist): the way to the target by parents, from the source on; empty if it was not reached.

    Parents are followed by doubling: as many joins as the way's length has bits.
    """
    up = stored(found.select("id", "parent", "dist"))
    way = stored(up.where(F.col("id") == target).select("id", "dist", F.lit(0).cast("long").alias("back")))
    jump, step = up.select("id", "parent"), 1
    dist = up.select("id", "dist")
    while not way.isEmpty():
        more = way.join(jump, "id").select(F.col("parent").alias("id"), (F.col("back") + step).alias("back")).join(dist, "id").select("id", "dist", "back")
        whole = stored(way.unionByName(more).groupBy("id", "dist").agg(F.min("back").alias("back")))  # the source is its own parent and comes again
        grown = whole.count() > way.count()
        way = whole
        if not grown:
            break
        jump, step = stored(jump.join(jump.toDF("parent", "p2"), "parent").select("id", F.col("p2").alias("parent"))), 2 * step
    top = way.agg(F.max("back").alias("top"))
    return way.crossJoin(F.broadcast(top)).select((F.col("top") - F.col("back")).alias("step"), "id", "dist")  # one row


EARTH_CM = 637100000


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, halved: bool = False) -> Column:
    """Whole centimetres; as defined here the sines are of the full differences, ``halved`` gives the haversine."""
    k = 0.5 if halved else 1.0
    a, b = F.sin((lat2 - lat1) * k), F.sin((lon2 - lon1) * k)
    x = a * a + F.cos(lat1) * F.cos(lat2) * b * b
    return F.floor(2 * F.atan2(F.sqrt(x), F.sqrt(F.greatest(F.lit(0.0), 1 - x))) * EARTH_CM)


def edge_length(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, w): the least weight of an edge between the ends of each pair that has one."""
    return pairs.join(e, ["src", "dst"]).groupBy("src", "dst").agg(F.min("w").alias("w"))


def undirected_weights(e: DataFrame) -> DataFrame:
    """Edges both ways, without loops."""
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst")


def a_star(e: DataFrame, places: DataFrame, source: int, target: int) -> DataFrame:
    """(step, id, dist): the shortest way by weights in cm, pruned by the great circle to the target (id, lat, lon)."""
    goal = places.where(F.col("id") == target).select(F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))

    def bound(active: DataFrame) -> DataFrame:
        return active.join(places, "id").crossJoin(F.broadcast(goal)).withColumn("h", great_circle(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"), True))  # one row

    return path(shortest_paths(e, source, target=target, bound=bound), target)


def pagerank(e: DataFrame, vertices: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank): power iteration from 1/n; vertices without edges out pass nothing on."""
    n = vertices.count()
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    e = stored(e.join(out, "src").select("src", "dst", "deg"))
    rank = vertices.select("id", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        got = e.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("s"))
        rank = vertices.join(got, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if i % 3 == 2:
            rank = stored(rank)
    return rank


def residual_pagerank(e: DataFrame, vertices: DataFrame, tolerance: float = 1e-3, alpha: float = 0.85, max_rounds: int = 1 << 20) -> DataFrame:
    """(id, value): unnormalised push ranking; each vertex starts with residual 1 - alpha and hands alpha of it on while above the tolerance."""
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    e = stored(e.join(out, "src").select("src", "dst", "deg"))
    state = stored(vertices.select("id", F.lit(0.0).alias("value"), F.lit(1 - alpha).alias("res")))
    for _ in range(max_rounds):
        push = state.where(F.col("res") > tolerance).select(F.col("id").alias("src"), "res")
        if push.isEmpty():
            break
        got = push.join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(alpha * F.col("res") / F.col("deg")).alias("got"))
        big = F.col("res") > tolerance
        state = stored(state.join(got, "id", "left").select("id", F.when(big, F.col("value") + F.col("res")).otherwise(F.col("value")).alias("value"), (F.when(big, 0.0).otherwise(F.col("res")) + F.coalesce("got", F.lit(0.0))).alias("res")))
    return state.select("id", "value")


def components(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the least vertex in reach, edges taken as undirected; labels jump to their label's label each round."""
    both = stored(undirected(e))
    state = stored(vertices.select("id", F.col("id").alias("c")))
    while True:
        near = both.select(F.col("src").alias("id"), "dst").join(state.select(F.col("id").alias("dst"), "c"), "dst").groupBy("id").agg(F.min("c").alias("m"))
        hung = state.join(near, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"))
        new = stored(hung.join(hung.select(F.col("id").alias("c"), F.col("c").alias("cc")), "c").select("id", F.least("c", "cc").alias("c")))
        if new.join(state, ["id", "c"], "left_anti").isEmpty():
            return new.withColumnRenamed("c", "component")
        state = new


def betweenness(e: DataFrame, source: int) -> DataFrame:
    """(id, score): Brandes' dependency of the source on each vertex it reaches."""
    e = stored(e.select("src", "dst").distinct())
    dist = stored(bfs(e, source).select("id", "dist"))
    top = dist.agg(F.max("dist")).first()[0]
    dag = e.join(dist.toDF("src", "ds"), "src").join(dist.toDF("dst", "dd"), "dst").where("dd = ds + 1")
    dag = stored(dag)
    sigma = dist.where("dist = 0").select("id", F.lit(1.0).alias("sigma"))
    levels = [sigma]
    for r in range(1, top + 1):
        sigma = stored(dag.where(F.col("dd") == r).join(levels[-1].withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma")))
        levels.append(sigma)
    after = levels[-1].select("id", "sigma", F.lit(0.0).alias("score"))
    out = after
    for r in range(top - 1, -1, -1):
        got = dag.where(F.col("ds") == r).join(after.select(F.col("id").alias("dst"), ((1 + F.col("score")) / F.col("sigma")).alias("x")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("x"))
        after = stored(levels[r].join(got, "id", "left").select("id", "sigma", (F.col("sigma") * F.coalesce("x", F.lit(0.0))).alias("score")))
        out = out.unionByName(after)
    return out.select("id", F.when(F.col("id") == source, 0.0).otherwise(F.col("score")).alias("score"))


def kcore(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, core): the largest k such that the vertex survives in the k-core."""
    both = undirected(e)
    live, k = stored(both), 0
    out = vertices.join(live.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("core"))
    while True:
        deg = stored(live.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")))
        least = deg.agg(F.min("d")).first()[0]
        if least is None:
            return out
        k = max(k, least)
        peeled = deg.where(F.col("d") <= k).select("id")
        live = stored(live.join(peeled.toDF("src"), "src", "left_anti").join(peeled.toDF("dst"), "dst", "left_anti"))
        left = live.select(F.col("src").alias("id")).distinct()
        out = stored(out.unionByName(deg.select("id").join(left, "id", "left_anti").select("id", F.lit(k).cast("long").alias("core"))))


def triangles(e: DataFrame) -> DataFrame:
    """(triangles): edges point from lower to higher (degree, id), which bounds the wedges of a hub."""
    both = undirected(e)
    deg = both.groupBy("src").agg(F.count("*").alias("d"))
    o = both.join(deg, "src").join(deg.toDF("dst", "dd"), "dst").where("struct(d, src) < struct(dd, dst)").select("src", "dst")
    wedges = o.select("src", F.col("dst").alias("b")).join(o.select("src", F.col("dst").alias("c")), "src").where("b <> c").select(F.col("b").alias("src"), F.col("c").alias("dst"))
    return wedges.join(o, ["src", "dst"]).agg(F.count("*").alias("triangles"))


def independent_set(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id): the lexicographically first maximal independent set: a vertex joins once no smaller neighbour is undecided or in."""
    both = stored(undirected(e))
    open_, chosen = stored(vertices.select("id")), None
    while True:
        live = both.join(open_.toDF("src"), "src", "left_semi").join(open_.toDF("dst"), "dst", "left_semi")
        win = stored(open_.join(live.where("dst < src").select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        chosen = win if chosen is None else stored(chosen.unionByName(win))
        out = both.join(win.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id")).unionByName(win).distinct()
        open_ = stored(open_.join(out, "id", "left_anti"))
        if open_.isEmpty():
            return chosen


def independent_set_errors(e: DataFrame, vertices: DataFrame, chosen: DataFrame) -> DataFrame:
    """Vertices that break independence or maximality."""
    both = undirected(e)
    inside = both.join(chosen.toDF("src"), "src", "left_semi").join(chosen.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    near = both.join(chosen.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id"))
    return inside.unionByName(vertices.select("id").join(chosen, "id", "left_anti").join(near, "id", "left_anti"))


def matching(e: DataFrame) -> DataFrame:
    """(eid): what a greedy pass over edges (eid, src, dst) by eid would match: an edge joins when it is first at both ends."""
    live, out = stored(e.where("src <> dst").select("eid", "src", "dst")), None
    while not live.isEmpty():
        ends = live.select("eid", F.explode(F.array("src", "dst")).alias("v"))
        first = ends.groupBy("v").agg(F.min("eid").alias("eid"))
        win = stored(first.groupBy("eid").agg(F.count("*").alias("c")).where("c = 2").join(live, "eid").select("eid", "src", "dst"))
        out = win.select("eid") if out is None else stored(out.unionByName(win.select("eid")))
        used = win.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        live = stored(live.join(used.toDF("src"), "src", "left_anti").join(used.toDF("dst"), "dst", "left_anti"))
    return out if out is not None else e.select("eid").where("false")


def spanning_forest(e: DataFrame, weighted: bool = True) -> DataFrame:
    """(eid): the minimum spanning forest of edges (eid, src, dst, w) under (w, eid), by Boruvka rounds; by eid alone if not weighted."""
    live = stored(e.where("src <> dst").select("eid", "src", "dst", (F.col("w") if weighted else F.lit(0)).alias("w")))
    out = None
    while not live.isEmpty():
        ends = live.select("eid", "w", "src", "dst").unionByName(live.select("eid", "w", F.col("dst").alias("src"), F.col("src").alias("dst")))
        best = ends.groupBy("src").agg(F.min(F.struct("w", "eid", "dst")).alias("b")).select(F.col("src").alias("id"), F.col("b.eid").alias("eid"), F.col("b.dst").alias("to"))
        best = stored(best)
        won = best.select("eid").distinct()
        out = won if out is None else stored(out.unionByName(won))
        names = best.select("id")
        comp = components(best.select(F.col("id").alias("src"), F.col("to").alias("dst")), names)
        a, b = comp.toDF("src", "cs"), comp.toDF("dst", "cd")
        live = stored(live.join(a, "src").join(b, "dst").where("cs <> cd").select("eid", F.col("cs").alias("src"), F.col("cd").alias("dst"), "w"))
    return out.distinct() if out is not None else e.select("eid").where("false")


def colouring(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, colour): greedy by falling degree, then id: a vertex takes the least colour free once all earlier neighbours have theirs."""
    both = undirected(e)
    deg = degrees(both, vertices)
    o = both.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst").where("dd > ds or (dd = ds and dst < src)").select("src", "dst")
    o = stored(o)  # src waits for dst
    done, todo = None, stored(vertices.select("id"))
    while not todo.isEmpty():
        blocked = o.join(todo.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        ready = todo.join(blocked, "id", "left_anti")
        if done is None:
            new = ready.select("id", F.lit(0).alias("colour"))
        else:
            near = o.join(done.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("c").alias("used"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
            new = ready.join(near, "id", "left").select("id", F.coalesce(free, F.lit(0)).alias("colour"))
        new = stored(new)
        done = new if done is None else stored(done.unionByName(new))
        todo = stored(todo.join(new, "id", "left_anti"))
    return done


def low_diameter(e: DataFrame, vertices: DataFrame, beta: float = 0.2, seed: int = 1) -> DataFrame:
    """(id, centre): each vertex starts a search after an exponential delay unless one reached it before; earliest, then least centre, wins."""
    both = stored(undirected(e))
    u = (F.pmod(hashed(F.col("id"), seed=seed), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    delay = stored(vertices.select("id", (-F.log(u) / beta).alias("x")))
    top = delay.agg(F.max("x")).first()[0]
    if top is None:
        return vertices.select("id", F.col("id").alias("centre"))
    start = stored(delay.select("id", F.floor(top - F.col("x")).alias("at")))
    # neighbours of earlier rounds' vertices are in already, so a round asks those of the last one
    front = start.where("at = 0").select("id", F.col("id").alias("centre"))
    done = _Growing(front)
    for r in range(1, int(top) + 1):
        reach = both.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("centre").alias("centre"))
        own = start.where(F.col("at") == r).select("id", F.col("id").alias("centre")).join(reach.select("id"), "id", "left_anti")
        front = done.add(reach.unionByName(own).join(done.rows().select("id"), "id", "left_anti"))
        done.settle()
    return done.rows()


def set_cover(members: DataFrame) -> DataFrame:
    """(set): a greedy cover of memberships (set, x): in a round the sets of the top size class claim their elements, least set first, and join if they keep enough of them."""
    live, out = stored(members.select("set", "x").distinct()), None
    while not live.isEmpty():
        size = live.groupBy("set").agg(F.count("*").alias("n"))
        top = size.agg(F.max("n")).first()[0]
        floor = max(1, 1 << int(math.log2(top)))
        act = live.join(size.where(F.col("n") >= floor).select("set"), "set", "left_semi")
        won = act.groupBy("x").agg(F.min("set").alias("set")).groupBy("set").agg(F.count("*").alias("n"))
        join = stored(won.where(F.col("n") >= max(1, floor // 2)).select("set"))
        out = join if out is None else stored(out.unionByName(join))
        covered = live.join(join, "set", "left_semi").select("x").distinct()
        live = stored(live.join(covered, "x", "left_anti"))
    return out if out is not None else members.select("set").where("false")


def uncovered(members: DataFrame, cover: DataFrame) -> DataFrame:
    return members.select("x").distinct().join(members.join(cover, "set", "left_semi").select("x").distinct(), "x", "left_anti")


def cycle_count(permutation: DataFrame) -> DataFrame:
    """(cycles) of a permutation (i, p): the least element of each cycle, over strides that double, counts it once."""
    state, n, step = stored(permutation.select("i", F.col("p").alias("to"), F.least("i", "p").alias("least"))), permutation.count(), 1
    while step < n:
        on = state.select(F.col("i").alias("to"), F.col("to").alias("further"), F.col("least").alias("l2"))
        after = stored(state.join(on, "to").select("i", F.col("further").alias("to"), F.least("least", "l2").alias("least")))
        forget(state)
        state, step = after, 2 * step
    return state.agg(F.count_if(F.col("i") == F.col("least")).alias("cycles"))


def _slowest(step: Callable[[np.ndarray], np.ndarray], d: np.ndarray, v: np.ndarray, error: float, max_rounds: int) -> np.ndarray:
    """Where the power iteration of ``step``, the lazy walk on degrees ``d``, goes from ``v``, orthogonal to the constant vector.

    A round takes the best mix of the vector, its residual and the last direction, which needs about the square root of the
    power iteration's rounds and the same one step each. It ends as that does: when a step changes the vector by less than ``error``.
    """
    weight, ones = np.maximum(d, 1), (d > 0).astype(float)
    dot = lambda x, y: float((weight * x) @ y)
    level = lambda x: x - ones * (dot(ones, x) / max(dot(ones, ones), 1.0))
    unit = lambda *xs: [x / (np.sqrt(dot(xs[0], xs[0])) or 1.0) for x in xs]
    start = level(v)
    (x,), p, wp = unit(start), None, None
    wx = level(step(x))
    for k in range(max_rounds):
        far = np.sqrt(np.mean((wx / (np.abs(wx).max() or 1.0) - x / (np.abs(x).max() or 1.0)) ** 2))
        if far < error:
            exact = level(step(x))
            far = np.sqrt(np.mean((exact / (np.abs(exact).max() or 1.0) - x / (np.abs(x).max() or 1.0)) ** 2))
            wx, p = exact, None  # sums of steps drift; begin again from an exact one
            if far < error:
                break
        r = level(wx - dot(x, wx) * x)
        r -= dot(x, r) * x
        if dot(r, r) == 0:
            break
        (r,) = unit(r)
        wr = level(step(r))
        basis, moved = [x, r], [wx, wr]
        if p is not None:
            for q, wq in ((x, wx), (r, wr)):
                c = dot(q, p)
                p, wp = p - c * q, wp - c * wq
            if dot(p, p) > 1e-24:
                p, wp = unit(p, wp)
                basis, moved = [x, r, p], [wx, wr, wp]
        mix = np.array([[dot(q, w) for w in moved] for q in basis])
        c = np.linalg.eigh((mix + mix.T) / 2)[1][:, -1]
        c = c if c[0] >= 0 else -c
        p, wp = (sum(f * q for f, q in zip(c[1:], w[1:], strict=True)) for w in (basis, moved))
        p, wp, x, wx = p, wp, c[0] * x + p, c[0] * wx + wp
        scale = np.sqrt(dot(x, x)) or 1.0
        x, wx = x / scale, wx / scale
        if k % 64 == 63:
            x = level(x)
            wx = level(step(x))
        size = np.sqrt(dot(p, p))
        p, wp = (p / size, wp / size) if size else (None, None)
    return x if dot(x, start) >= 0 else -x


def _far_sums(both: DataFrame, names: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function of a vector over the places in ``names`` (id, idx): each place's sum over its neighbours. Edges are written once as arrays of a task's stretch of places; a call is one job that reads them and brings a sum a place."""
    src, dst = names.toDF("src", "s"), names.toDF("dst", "t")
    e = both.join(src, "src").join(dst, "dst").select("s", "t")
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append([c.to_numpy().astype("<i4") for c in batch.columns])
                rows += batch.num_rows
            if held and (batch is None or rows >= 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*held, strict=True)], names=["s", "t"])
                held, rows = [], 0

    packed = stored(e.repartitionByRange(parts, "s").sortWithinPartitions("s").mapInArrow(pack, "s binary, t binary"))

    def sums(v: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s, t in zip(batch.column(0), batch.column(1), strict=True):
                    at = np.frombuffer(s.as_buffer(), "<i4")
                    got = np.bincount(at - at[0], v[np.frombuffer(t.as_buffer(), "<i4")])
                    yield pa.RecordBatch.from_arrays([pa.array([int(at[0])], pa.int64()), pa.array([got.tobytes()], pa.binary())], names=["first", "x"])

        out = np.zeros(n)
        got = packed.mapInArrow(run, "first long, x binary").toArrow()
        for first, x in sorted(zip(got.column("first").to_pylist(), got.column("x").to_pylist(), strict=True)):
            own = np.frombuffer(x)
            out[first : first + len(own)] += own
        return out

    return sums


def separator(e: DataFrame, vertices: DataFrame, error: float = 5e-8, seed: int = 1, together: int = 1 << 22, max_rounds: int = 1 << 20) -> DataFrame:
    """(id, side): halves by the median of the vector that a power iteration on the lazy walk goes to, orthogonal to the constant vector, until the root mean square of a step's changes is below ``error``.

    The driver does the steps for at most ``together`` vertices and edges. Beyond these the edges stay with the executors, and a step is
    a job, while there are at most ``together`` vertices, whose vectors the driver holds; with more a step of the power iteration is a join.
    """
    both = undirected(e)
    deg = stored(degrees(both, vertices))
    both = stored(both)
    x = stored(vertices.select("id", (F.pmod(hashed(F.col("id"), seed=seed), F.lit(1000003)) / 1000003.0 - 0.5).alias("x")))
    n = deg.count()
    few = n <= together
    if few:
        own = deg.join(x, "id").orderBy("id").select("id", "degree", "x").toArrow()
        d, v = own.column("degree").to_numpy().astype(float), own.column("x").to_numpy()
        if both.count() + n <= together:
            ids, ends = own.column("id").to_numpy(), both.select("src", "dst").toArrow()
            src, dst = (np.searchsorted(ids, ends.column(c).to_numpy()).astype(np.int32) for c in ("src", "dst"))
            sums = lambda v: np.bincount(src, v[dst], n)
        else:
            names = stored(e.sparkSession.createDataFrame(pa.table({"id": own.column("id"), "idx": np.arange(n)}), "id long, idx long"))
            sums = _far_sums(both, names, n)
        if n:
            v = _slowest(lambda v: 0.5 * v + 0.5 * sums(v) / np.maximum(d, 1), d, v, error, max_rounds)
        x = stored(e.sparkSession.createDataFrame(pa.table({"id": own.column("id"), "x": v}), "id long, x double"))
    for _ in range(0 if few else max_rounds):
        got = both.join(x.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("s"))
        new = deg.join(x.select("id", F.col("x").alias("old")), "id").join(got, "id", "left").select("id", "degree", "old", (0.5 * F.col("old") + 0.5 * F.coalesce("s", F.lit(0.0)) / F.greatest("degree", F.lit(1))).alias("x"))
        stats = new.agg(F.sum(F.col("x") * F.col("degree")) / F.greatest(F.sum("degree"), F.lit(1)), F.max(F.abs("x"))).first()
        x = stored(new.select("id", ((F.col("x") - stats[0]) / (stats[1] or 1.0)).alias("x"), "old"))
        moved = x.agg(F.sqrt(F.avg((F.col("x") - F.col("old")) ** 2))).first()[0]
        if moved is None or moved < error:
            break
    half = x.agg(F.percentile_approx("x", 0.5, 1 << 20)).first()[0]
    return x.select("id", F.when(F.col("x") > half, 1).otherwise(0).alias("side"))


def max_flow(e: DataFrame, source: int, target: int, together: int = 1 << 20) -> int:
    """The greatest flow along integer capacities w: shortest augmenting paths on the residual graph.

    Up to ``together`` edges, whose number is checked, the driver augments by levels; more are
    searched in rounds of joins, one path a search.
    """
    caps = stored(e.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w")))
    if caps.count() <= together:
        return _flow_by_levels([tuple(r) for r in caps.collect()], source, target)
    res = stored(caps.unionByName(caps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).cast("long").alias("w"))).groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w")))
    flow = 0
    while True:
        way = [r.id for r in path(bfs(res.where("w > 0"), source), target).orderBy("step").collect()]  # one path
        if not way:
            return flow
        steps = e.sparkSession.createDataFrame(list(zip(way, way[1:], strict=False)), "src long, dst long")
        least = res.join(F.broadcast(steps), ["src", "dst"]).agg(F.min("w")).first()[0]
        change = steps.withColumn("c", F.lit(-least)).unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(least).alias("c")))
        after = stored(res.join(F.broadcast(change), ["src", "dst"], "left").select("src", "dst", (F.col("w") + F.coalesce("c", F.lit(0))).cast("long").alias("w")))
        forget(res)
        res, flow = after, flow + least


def _flow_by_levels(caps: list[tuple[int, int, int]], source: int, target: int) -> int:
    """Blocking flows on level graphs."""
    left: dict[int, dict[int, int]] = {}
    for a, b, w in caps:
        left.setdefault(a, {})[b] = left.get(a, {}).get(b, 0) + w
        left.setdefault(b, {}).setdefault(a, 0)
    flow = 0
    while source != target:
        level, front = {source: 0}, [source]
        while front and target not in level:
            front = [b for a in front for b, w in left.get(a, {}).items() if w > 0 and level.setdefault(b, level[a] + 1) == level[a] + 1 and b not in front]
            front = list(dict.fromkeys(front))
        if target not in level:
            return flow
        todo = {a: [b for b in out if level.get(b) == level.get(a, -2) + 1] for a, out in left.items()}
        way = [source]
        while way:  # depth first, dead ends are dropped
            a = way[-1]
            if a == target:
                room = min(left[x][y] for x, y in zip(way, way[1:], strict=False))
                for x, y in zip(way, way[1:], strict=False):
                    left[x][y] -= room
                    left[y][x] += room
                flow += room
                way = [source]
                continue
            while todo[a] and left[a][todo[a][-1]] == 0:
                todo[a].pop()
            if todo[a]:
                way.append(todo[a][-1])
            else:
                way.pop()
                if way:
                    todo[way[-1]].pop()
    return flow


def belief_propagation(nodes: DataFrame, edges: DataFrame, sensitivity: float = 1e-5, max_rounds: int = 200, by_residual: bool = False) -> DataFrame:
    """(id, p0, p1): marginals of a binary random field by rounds of log messages.

    All messages are renewed in a round or, ``by_residual``, only those that would change at least half as much as the one
    that would change most, until none would change by more than ``sensitivity``.

    nodes (id, l0, l1) are log potentials; edges (src, dst, t00, t01, t10, t11),
    one row for each direction, hold the log potential of (src state, dst state).
    """
    lse = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    edges = stored(edges)
    mu = stored(edges.select("src", "dst", F.lit(math.log(0.5)).alias("m0"), F.lit(math.log(0.5)).alias("m1")))
    for _ in range(max_rounds):
        into = mu.groupBy(F.col("dst").alias("id")).agg(F.sum("m0").alias("s0"), F.sum("m1").alias("s1"))
        own = nodes.join(into, "id", "left").select(F.col("id").alias("src"), (F.col("l0") + F.coalesce("s0", F.lit(0.0))).alias("a0"), (F.col("l1") + F.coalesce("s1", F.lit(0.0))).alias("a1"))
        back = mu.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("m0").alias("b0"), F.col("m1").alias("b1"))
        x = edges.join(own, "src").join(back, ["src", "dst"]).withColumn("c0", F.col("a0") - F.col("b0")).withColumn("c1", F.col("a1") - F.col("b1"))
        x = x.withColumn("n0", lse(F.col("t00") + F.col("c0"), F.col("t10") + F.col("c1"))).withColumn("n1", lse(F.col("t01") + F.col("c0"), F.col("t11") + F.col("c1")))
        z = lse(F.col("n0"), F.col("n1"))
        x = x.select("src", "dst", (F.col("n0") - z).alias("m0"), (F.col("n1") - z).alias("m1"))
        new = stored(x.join(mu.toDF("src", "dst", "o0", "o1"), ["src", "dst"]).withColumn("far", F.abs(F.exp("m0") - F.exp("o0")) + F.abs(F.exp("m1") - F.exp("o1"))))
        far = new.agg(F.max("far")).first()[0]
        if by_residual and far is not None:
            own = F.col("far") >= far / 2
            mu = new.select("src", "dst", F.when(own, F.col("m0")).otherwise(F.col("o0")).alias("m0"), F.when(own, F.col("m1")).otherwise(F.col("o1")).alias("m1"))
        else:
            mu = new.select("src", "dst", "m0", "m1")
        if far is None or far <= sensitivity:
            break
    into = mu.groupBy(F.col("dst").alias("id")).agg(F.sum("m0").alias("s0"), F.sum("m1").alias("s1"))
    own = nodes.join(into, "id", "left").select("id", (F.col("l0") + F.coalesce("s0", F.lit(0.0))).alias("a0"), (F.col("l1") + F.coalesce("s1", F.lit(0.0))).alias("a1"))
    z = lse(F.col("a0"), F.col("a1"))
    return own.select("id", F.exp(F.col("a0") - z).alias("p0"), F.exp(F.col("a1") - z).alias("p1"))


def _a(name: str, sql: str | None = None):
    def add(f):
        register(name, sql)(lambda s, d: f(order_graph(s, d), vertices_of(s, d)))

    return add


_E = f"e as materialized (select distinct src, dst from {G})"
#: Hops from vertex 0 on any graph: a round adds the vertices that no earlier one has.
_BFS = f"with recursive {_E}, d(id, dist) using key (id) as (select cast(0 as bigint), cast(0 as bigint) union select e.dst, min(d.dist) + 1 from d join e on e.src = d.id left join recurring.d k on k.id = e.dst where k.id is null group by e.dst) "
_PARENTS = "p as materialized (select cast(0 as bigint) as id, cast(0 as bigint) as dist, cast(0 as bigint) as parent union all select b.id, b.dist, min(src) from e join d a on a.id = src join d b on b.id = e.dst and b.dist = a.dist + 1 group by b.id, b.dist) "
_a("bfs_levels", _BFS + "select id, dist from d")(lambda e, v: bfs(e, 0).select("id", "dist"))
_a("bfs_parents", _BFS + ", " + _PARENTS + "select id, parent from p")(lambda e, v: bfs(e, 0).select("id", "parent"))
_a("path_reconstruction", _BFS + ", " + _PARENTS + ", way(id, dist, parent) as (select id, dist, parent from p where id = 77 union all select p.id, p.dist, p.parent from way join p on p.id = way.parent where way.id <> 0) select dist as step, id, dist from way")(lambda e, v: path(bfs(e, 0), 77))
#: Least weights from vertex 0: a round keeps the offers that are shorter than what is known.
_SP = f"with recursive e as materialized (select src, dst, min(w) as w from {G} group by 1, 2), d(id, dist) using key (id) as (select cast(0 as bigint), cast(0 as bigint) union select e.dst, min(d.dist + e.w) from d join e on e.src = d.id left join recurring.d k on k.id = e.dst group by e.dst, k.dist having k.dist is null or min(d.dist + e.w) < k.dist) "
_a("sssp", _SP + "select id, dist from d")(lambda e, v: shortest_paths(e, 0).select("id", "dist"))
_a("delta_stepping", _SP + "select id, dist from d")(lambda e, v: shortest_paths(e, 0, delta=8).select("id", "dist"))
_a("bellman_ford", _SP + "select id, dist from d")(lambda e, v: bellman_ford(e, 0, v.count()))
_a("ppsp", _SP + "select dist from d where id = 77")(lambda e, v: shortest_paths(e, 0, delta=8, target=77).where("id = 77").select("dist"))
_a("edge_length", f"select a.src, a.dst, min(g.w) as w from (select distinct src, dst from {G} where w > 5) a join {G} g on g.src = a.src and g.dst = a.dst group by 1, 2")(lambda e, v: edge_length(e, e.where("w > 5").select("src", "dst").distinct()))
_PR = f"with e as (select src, dst, count(*) over (partition by src) as deg from {G}), v as (select c_custkey as id from customer), r0 as (select id, 1.0 / (select count(*) from v) as rank from v)" + "".join(
    f", r{i} as (select id, 0.15 / (select count(*) from v) + 0.85 * coalesce(s, 0) as rank from v left join (select dst, sum(rank / deg) as s from e join r{i - 1} on id = src group by dst) on dst = id)" for i in range(1, 6)
)
_a("pagerank", _PR + " select id, round(rank * 1000, 6) as rank from r5")(lambda e, v: pagerank(e, v, 5).select("id", F.round(F.col("rank") * 1000, 6).alias("rank")))
_a("pagerank_top", _PR + " select id, round(rank * 1000, 6) as rank from r5 order by r5.rank desc, id limit 20")(lambda e, v: pagerank(e, v, 5).orderBy(F.desc("rank"), "id").limit(20).select("id", F.round(F.col("rank") * 1000, 6).alias("rank")))
_a("residual_pagerank")(residual_pagerank)
_CC = f"with recursive u as materialized (select src, dst from {UND}), r(id, c) using key (id) as (select cast(c_custkey as bigint), cast(c_custkey as bigint) from customer union select u.dst, min(r.c) from r join u on u.src = r.id join recurring.r k on k.id = u.dst group by u.dst, k.c having min(r.c) < k.c) "
_a("connected_components", _CC + "select id, c as component from r")(components)
_BC = f"""with recursive {_E}, s(id, dist, sigma) using key (id) as (select cast(0 as bigint), cast(0 as bigint), 1e0 union select e.dst, min(s.dist) + 1, sum(s.sigma) from s join e on e.src = s.id left join recurring.s k on k.id = e.dst where k.id is null group by e.dst),
  v as materialized (select * from s), top as materialized (select max(dist) as top from v),
  b(id, dist, sigma, score) as (select id, dist, sigma, 0e0 from v, top where dist = top union all
    select x.id, x.dist, any_value(x.sigma), coalesce(sum(x.sigma / b.sigma * (1 + b.score)) filter (e.src is not null), 0) from b join v x on x.dist = b.dist - 1 left join e on e.src = x.id and e.dst = b.id group by x.id, x.dist)
select id, round(case when id = 0 then 0 else score end, 6) as score from b"""
_a("betweenness", _BC)(lambda e, v: betweenness(e, 0).select("id", F.round("score", 6).alias("score")))
#: Coreness as the fixpoint from above of: the greatest k such that k neighbours have at least k.
_CORE = f"""with recursive u as materialized (select src, dst from {UND}), deg as materialized (select c_custkey as id, (select count(*) from u where src = c_custkey) as d from customer),
  r(id, c) using key (id) as (select cast(id as bigint), cast(d as bigint) from deg union
    select id, h from (select u.src as id, any_value(own.c) as c, list_reverse_sort(list(k.c)) as near from u join recurring.r k on k.id = u.dst join recurring.r own on own.id = u.src where u.src in (select dst from u join r on r.id = u.src) group by u.src) x,
      lateral (select cast(len(list_filter(range(1, len(near) + 1), lambda i: near[i] >= i)) as bigint) as h) y where h < c)
select id, c as core from r"""
_a("kcore", _CORE)(kcore)
_a("triangle_count", f"with u as materialized (select src, dst from {UND}) select count(*) as triangles from u a join u b on b.src = a.dst and b.dst > a.dst join u c on c.src = a.src and c.dst = b.dst where a.dst > a.src")(lambda e, v: triangles(e))
#: A greedy pass over the vertices in order, with a list of those chosen.
_MIS = f"""with n as (select c_custkey as id, (select list(dst) from {UND} where src = c_custkey and dst < c_custkey) as before from customer)
select unnest(list_reduce(list({{'id': id, 'before': coalesce(before, [])}} order by id), lambda chosen, v: case when list_has_any(chosen, v.before) then chosen else list_append(chosen, v.id) end, cast([] as bigint[]))) as id from n"""
_a("independent_set", _MIS)(independent_set)
_a("independent_set_check", "select 0 as id where false")(lambda e, v: independent_set_errors(e, v, independent_set(e, v)))
def _numbered(e: DataFrame) -> DataFrame:
    """Edges numbered by their ends and weight."""
    return e.withColumn("eid", F.col("src") * 100000000 + F.col("dst") * 100 + F.col("w")).distinct()


_NUM = f"(select distinct src * 100000000 + dst * 100 + w as eid, src, dst, w from {G} where src <> dst)"
#: A greedy pass over the edges in order, with the vertices used and the edges chosen.
_MATCH = f"""select unnest(list_reduce(list({{'eid': eid, 'src': src, 'dst': dst}} order by eid),
  lambda a, x: case when list_contains(a.used, x.src) or list_contains(a.used, x.dst) then a else {{'used': a.used || [x.src, x.dst], 'out': list_append(a.out, x.eid)}} end, {{'used': cast([] as bigint[]), 'out': cast([] as bigint[])}}).out) as eid from {_NUM}"""


def _kruskal(order: str) -> str:
    """A greedy pass over the edges in order, with each vertex' component and the edges chosen."""
    return f"""with s as (select list(id order by id) as comp from (select cast(c_custkey as bigint) as id from customer)), x as (select list({{'eid': eid, 'src': src, 'dst': dst}} order by {order}) as es from {_NUM})
select unnest(list_reduce(es, lambda a, x: case when a.comp[x.src + 1] = a.comp[x.dst + 1] then a else {{'comp': list_transform(a.comp, lambda c: case when c = a.comp[x.dst + 1] then a.comp[x.src + 1] else c end), 'out': list_append(a.out, x.eid)}} end,
  {{'comp': comp, 'out': cast([] as bigint[])}}).out) as eid from s, x"""


#: A greedy pass over the vertices by falling degree, with the colours so far.
_COLOUR = f"""with n as (select c_custkey as id, coalesce((select list(dst) from {UND} where src = c_custkey), []) as near from customer),
  x as (select list({{'id': id, 'near': near}} order by len(near) desc, id) as vs, max(id) as top from n),
  c as (select list_reduce(vs, lambda a, v: list_concat(list_append(a[:v.id], list_filter(range(0, len(v.near) + 1), lambda k: not list_contains(list_transform(v.near, lambda y: a[y + 1]), k))[1]), a[v.id + 2:]), list_transform(range(0, top + 1), lambda i: cast(-1 as bigint))) as colours from x)
select id, cast(colours[id + 1] as int) as colour from n, c"""
_a("maximal_matching", _MATCH)(lambda e, v: matching(_numbered(e)))
_a("min_spanning_forest", _kruskal("w, eid"))(lambda e, v: spanning_forest(_numbered(e)))
_a("spanning_forest", _kruskal("eid"))(lambda e, v: spanning_forest(_numbered(e), False))
_a("graph_colouring", _COLOUR)(colouring)
#: Rounds with a row -1 that counts them, since a round may add no vertex.
_LDD = f"""with recursive u as materialized (select src, dst from {UND}), x as (select c_custkey as id, -ln(({hashed_sql("c_custkey", seed=1)} % {1 << 30} + 1) / {float((1 << 30) + 1)!r}) / 0.2e0 as x from customer),
  s as materialized (select cast(id as bigint) as id, cast(floor((select max(x) from x) - x) as bigint) as start from x),
  r(id, centre, round) using key (id) as (select cast(-1 as bigint), cast(-1 as bigint), cast(0 as bigint) union all select id, id, cast(0 as bigint) from s where start <= 0 union
    select id, min(centre), max(round) from (
      select u.dst as id, k.centre as centre, t.round + 1 as round, 0 as late from r t join recurring.r k on k.id >= 0 and t.id = -1 join u on u.src = k.id
      union all select s.id, s.id, t.round + 1, 1 from r t join s on t.id = -1 and s.start <= t.round + 1 where s.id not in (select u.dst from recurring.r k join u on u.src = k.id)
      union all select -1, -1, t.round + 1, 2 from r t where t.id = -1 and (t.round <= (select max(start) from s) or (select count(*) from recurring.r) <= (select count(*) from s))) y
    where id = -1 or id not in (select id from recurring.r) group by id)
select id, centre from r where id >= 0"""
_a("low_diameter_decomposition", _LDD)(low_diameter)
_a("spectral_separator")(separator)


def _supplies(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("x"))


register("set_cover")(lambda s, d: set_cover(_supplies(s, d)))
register("set_cover_check", "select 0 as x where false")(lambda s, d: uncovered(_supplies(s, d), set_cover(_supplies(s, d))))
_PERM = "(select o_orderkey as i, row_number() over (order by o_custkey, o_orderkey) - 1 as p from orders)"
#: The least element over strides of 2**k, for permutations of up to 2**24 elements.
_STRIDES = "".join(f", s{k} as materialized (select a.i, b.p, least(a.m, b.m) as m from s{k - 1} a join s{k - 1} b on b.i = a.p)" for k in range(1, 25))
register("cycle_count", f"with s0 as materialized (select i, p, least(i, p) as m from {_PERM}){_STRIDES} select count(*) as cycles from s24 where i = m")(
    lambda s, d: cycle_count(dense(table(s, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("i")), ["a", "i"]).select("i", F.col("idx").alias("p")))
)
#: Customers as places on a sphere; an edge is a hundredth longer than the great circle, so that no bound is too long.
_PLACES = "(select c_custkey as id, (c_custkey % 170 - 85) * 0.01e0 as lat, (c_custkey * 7 % 340 - 170) * 0.01e0 as lon from customer)"


def _circle_sql(halved: bool = False) -> str:
    k = " * 0.5e0" if halved else ""
    a, b = f"sin((b.lat - a.lat){k})", f"sin((b.lon - a.lon){k})"
    x = f"({a} * {a} + cos(a.lat) * cos(b.lat) * {b} * {b})"
    return f"cast(floor(2 * atan2(sqrt({x}), sqrt(greatest(0e0, 1 - {x}))) * {EARTH_CM}) as bigint)"


def _places(v: DataFrame) -> DataFrame:
    return v.select("id", ((F.col("id") % 170 - 85) * 0.01).alias("lat"), ((F.col("id") * 7 % 340 - 170) * 0.01).alias("lon"))


def _roads(e: DataFrame, v: DataFrame) -> DataFrame:
    p = _places(v)
    ends = e.select("src", "dst").where("src <> dst").distinct().join(p.toDF("src", "alat", "alon"), "src").join(p.toDF("dst", "blat", "blon"), "dst")
    return ends.select("src", "dst", (F.floor(great_circle(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"), True) / 100) * 101 + 1).cast("long").alias("w"))


_ROADS = f"(select src, dst, {_circle_sql(True)} // 100 * 101 + 1 as w from (select distinct src, dst from {G} where src <> dst) g join {_PLACES} a on a.id = src join {_PLACES} b on b.id = dst)"
_a("great_circle", f"select src, dst, {_circle_sql()} as cm, {_circle_sql(True)} as halved from (select distinct src, dst from {G}) g join {_PLACES} a on a.id = src join {_PLACES} b on b.id = dst")(
    lambda e, v: e.select("src", "dst").distinct().join(_places(v).toDF("src", "alat", "alon"), "src").join(_places(v).toDF("dst", "blat", "blon"), "dst")
    .select("src", "dst", great_circle(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")).alias("cm"), great_circle(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"), True).alias("halved"))
)
_a("a_star", f"with recursive e as materialized {_ROADS}, d(id, dist) using key (id) as (select cast(0 as bigint), cast(0 as bigint) union select e.dst, min(d.dist + e.w) from d join e on e.src = d.id left join recurring.d k on k.id = e.dst group by e.dst, k.dist having k.dist is null or min(d.dist + e.w) < k.dist) select 0 as source, 77 as target, dist from d where id = 77")(
    lambda e, v: a_star(_roads(e, v), _places(v), 0, 77).groupBy().agg(F.min_by("id", "step").cast("int").alias("source"), F.max_by("id", "step").cast("int").alias("target"), F.max("dist").alias("dist"))
)
def _path_file(e: DataFrame, v: DataFrame) -> DataFrame:
    from ..sources.formats import numbered, write_path

    at = scratch(e.sparkSession)
    write_path(path(bfs(e, 0), 77), at)
    return numbered(e.sparkSession, at)


_a("path_file", _BFS + ", " + _PARENTS + ", way(id, dist, parent) as (select id, dist, parent from p where id = 77 union all select p.id, p.dist, p.parent from way join p on p.id = way.parent where way.id <> 0) select 0 as idx, '0 77 ' || max(dist) as line from way union all select dist + 1, cast(id as varchar) from way")(_path_file)
register("max_flow")(lambda s, d: s.createDataFrame([(max_flow(undirected_weights(order_graph(s, d)), 0, 77),)], "flow long"))
