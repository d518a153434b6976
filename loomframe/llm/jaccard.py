"""N-gram Jaccard self-join by prefix filters under several global orders.

A text's set is its distinct k-word shingles (words: A-Z lower-cased, split at
white space; fewer than k words are one shingle). Under any total order of all
shingles, two sets with Jaccard similarity t share a shingle among the first
n - ceil(t n) + 1 of each. Every order used here puts shingles that are
frequent in the corpus last (frequency classes from a table of fixed size that
counts all documents) and orders the rest by a hash of its own. Candidates of
the first order are kept only if they also share prefix shingles under every
other order, as many as the similarity asks for, and if their sizes allow it;
then they are verified on the whole sets.

Large groups are never expanded into pairs. Equal sets are one node. Postings
are range-partitioned by shingle, place in the prefix and node, so that a hot
shingle spreads over many tasks, and streamed: each node becomes a candidate
with the first one of its run only, the one with the fewest rarer shingles and
so the likeliest original of a group of copies. Components of the verified
links are found, and only what then still lies in different components under
one prefix shingle is compared in a second turn: those outside the shingle's
largest component against all. Places count: sets of nx and ny shingles that
must share s of them share one among the first nx - s + 1 and ny - s + 1. A shingle
that many nodes in several components share was taken for a rare one, as the table's buckets fill up with the
corpus; the sets under such shingles are joined again by an order of exact counts among them. After
this turn every pair that may link is either compared or already connected, so
no component is missed. Links inside components that others already connect take
a third turn, which compares all nodes under a prefix shingle, hot ones in salted
parts; it runs when ``Join.links`` or ``Join.link_counts`` is asked for, since
its work grows with the square of a group of different near copies.

Definitions for odd rows. Null, empty and blank texts have an empty set and
link with nothing. A null id never links. Rows with one id are one node,
which has the links of all its texts. Every input row gives one result row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialise, text_of
from .textcore import SPACE, Spans, chunks, mix, signed, slices, whole, windows

_ORDERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: log2 of the buckets of the frequency table, of the blocks it is added up in, and of the id slots of a pass.
FREQ_BITS, BLOCK_BITS, SLOT_BITS = 21, 12, 22


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle values) of every text of a batch."""
    for at, to, data, offsets in chunks(batch):
        words = Spans(data, offsets, SPACE, fold=True)
        values, bounds = windows(words.value, words.at, k)
        for d in range(to - at):
            a, b = bounds[d], bounds[d + 1]
            if b > a:
                yield at + d, np.unique(values[a:b])
            else:
                own = words.value[words.at[d] : words.at[d + 1]]
                yield at + d, np.array([whole(own)], np.uint64) if len(own) else own


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    one, two = mix(s), mix(s ^ _ORDERS[1])
    return int(signed(one.sum(dtype=np.uint64, keepdims=True))[0]), int(signed(two.sum(dtype=np.uint64, keepdims=True))[0])


def prefix(n: int, percent: int) -> int:
    """Shingles of a set of n of which one must be shared."""
    return n - -(-percent * n // 100) + 1


_COUNTED = "doc_id long, n long, f1 long, f2 long, block int, counts binary"


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << FREQ_BITS, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
        slots: list[np.ndarray] = []
        held = 0
        for batch in slices(batches):
            rows = []
            for row, s in shingle_sets(batch, k):
                rows.append((batch.column(0)[row].as_py(), len(s), *(fingerprint(s) if len(s) else (0, 0))))
                slots.append(s >> np.uint64(64 - FREQ_BITS))
                held += len(s)
                if held > 1 << 20:
                    table += np.bincount(np.concatenate(slots).view(np.int64), minlength=len(table)).astype(np.uint32)
                    slots, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], schema=schema)
        if slots:
            table += np.bincount(np.concatenate(slots).view(np.int64), minlength=len(table)).astype(np.uint32)
        for b in range(0, len(table), 1 << BLOCK_BITS):
            own = table[b : b + (1 << BLOCK_BITS)]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([b >> BLOCK_BITS], pa.int32()), pa.array([own.tobytes()], pa.binary())], schema=schema)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(counts.as_py(), np.uint32)
            total[block] = total[block] + own if block in total else own.astype(np.uint64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.uint64).tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def frequency_classes(blocks: DataFrame) -> np.ndarray:
    """A class for each of the 2**FREQ_BITS buckets; 0 for usual counts, one more for each 4 % above them, up to 255."""
    table = np.zeros(1 << FREQ_BITS, np.float64)
    size = 1 << BLOCK_BITS
    # the table's size is fixed, whatever the corpus; partial tables are added up in a stream
    for block, counts in blocks.repartition("block").mapInArrow(_add, "block int, counts binary").collect():
        table[block * size : (block + 1) * size] += np.frombuffer(counts, np.uint64)
    usual = max(1.0, float(np.median(table)))
    return np.clip(16 * np.log2(np.maximum(table, usual) / usual), 0, 255).astype(np.uint8)


_SKETCH = "doc_id long, n long, f1 long, f2 long, slack int, p1 array<long>, p2 array<int>, p3 array<int>"


def _sketch(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = shared.value, set()
        for batch in slices(batches):
            rows = []
            for row, s in shingle_sets(batch, k):
                doc_id = batch.column(0)[row].as_py()
                if not len(s) or doc_id is None:
                    continue
                same = fingerprint(s)
                if same in seen:  # one of equal sets stands for those of this task
                    continue
                seen.add(same)
                p = prefix(len(s), percent)
                first = (classes[s >> np.uint64(64 - FREQ_BITS)].astype(np.uint64)) << np.uint64(56)
                own = []
                for odd in _ORDERS:
                    key = first | (mix(s * odd) >> np.uint64(8))
                    least = np.argpartition(key, p - 1)[:p]
                    own.append(s[least] if own else s[least[np.argsort(key[least])]])
                short = [x.astype(np.uint32).view(np.int32) for x in own[1:]]
                slack = max(p - len(np.unique(x)) for x in short)  # shingles whose short forms coincide
                rows.append((doc_id, len(s), *same, slack, signed(own[0]), *short))
            if rows:
                kinds = [*[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "f1", "f2", "slack", "p1", "p2", "p3"])

    return run


def shared_needed(nx, ny, percent: int):
    """Shingles that sets of these sizes must share (numbers, arrays or columns)."""
    return (percent * (nx + ny) + 99 + percent) // (100 + percent)


def _runs(percent: int):
    """Postings (token, node, place, n), sorted by token, place and node, to rows (token, node, place, n, pivot, pair, edge) of runs of two nodes or more.

    pivot is the first node of the token in this partition, pair whether the
    places allow a link with it. The pivots of the first and the last run
    also come as rows with edge, since those runs may go on in the next partition.
    """
    names = ["token", "node", "place", "n", "pivot", "pair", "edge"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def alone(token, node, place, n, edge):
        return rows([token], [node], [place], [n], [node], [False], [edge])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the open run: (token, pivot, its place, its n), and whether the pivot's own row is out
        out = False
        for batch in batches:
            token, node, place, n = (np.asarray(batch.column(i)) for i in range(4))
            if not len(token):
                continue
            if last is None:
                yield alone(token[0], node[0], place[0], n[0], True)
            new = np.empty(len(token), bool)
            new[0] = last is None or token[0] != last[0]
            new[1:] = token[1:] != token[:-1]
            starts = np.flatnonzero(new)
            pivots = [x[starts] for x in (token, node, place, n)]
            of = np.cumsum(new) - 1
            lengths = np.bincount(of + (not new[0]))
            if not new[0]:  # the first rows go on with the open run
                of = of + 1
                pivots = [np.concatenate([[x], y]) for x, y in zip(last, pivots, strict=True)]
                if not out:
                    yield alone(*last, False)
                lengths[0] += 1
            keep = lengths[of] >= 2
            out = bool(lengths[-1] >= 2)
            last = tuple(x[-1] for x in pivots)
            if keep.any():
                of = of[keep]
                t, x, px, nx = (c[keep] for c in (token, node, place, n))
                y, py, ny = pivots[1][of], pivots[2][of], pivots[3][of]
                share = shared_needed(nx, ny, percent)
                yield rows(t, x, px, nx, y, (x != y) & (px <= nx - share) & (py <= ny - share), np.zeros(len(t), bool))
        if last is not None:
            yield alone(*last, True)

    return run


def _sets(k: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in slices(batches):
            ids = np.asarray(batch.column(0))
            slot = ids & ((1 << SLOT_BITS) - 1)
            batch = batch.filter(pa.array((slots[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            if batch.num_rows:
                own = [signed(s) for _, s in shingle_sets(batch, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "tokens"])

    return run


def _sets_of(texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of at least the wanted nodes.

    Ids are marked in a bitmap of fixed size; beyond a quarter of its slots the
    texts are semi-joined first, so that few unwanted ones are ever read.
    """
    spark = texts.sparkSession
    texts = texts.where("doc_id is not null")
    if nodes.count() > 1 << (SLOT_BITS - 2):
        texts = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    slot = F.col("node").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    bits = nodes.select(F.shiftright(slot, 15).alias("b"), slot.bitwiseAND(F.lit(32767)).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    table = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for b, own in bits.collect():  # 2**(SLOT_BITS - 15) rows of 4 kB at most
        table[b << 12 : (b + 1) << 12] = np.frombuffer(own, np.uint8)
    return texts.mapInArrow(_sets(k, spark.sparkContext.broadcast(table)), "node long, tokens array<long>")


@dataclass
class Join:
    """documents: (doc_id, n_shingles, component_id); connecting: (a, b, shared, joined), links between nodes that connect the components; members: (doc_id, node) of rows with a set."""

    documents: DataFrame
    connecting: DataFrame
    members: DataFrame
    others: Callable[[], DataFrame]

    @cached_property
    def links(self) -> DataFrame:
        """(a, b, shared, joined) of every link between nodes."""
        return self.connecting.unionByName(self.others())

    @cached_property
    def link_counts(self) -> DataFrame:
        """(doc_id, n_links): how many other documents each id has the same set as, or a link with."""
        nodes = materialise(self.members.groupBy("doc_id").agg(F.array_sort(F.collect_set("node")).alias("nodes")), "nodes")  # an id's texts are few
        # documents of one node and one set are counted together, those of several nodes by themselves
        of = nodes.select("doc_id", F.explode("nodes").alias("node"), (F.size("nodes") > 1).alias("several"))
        single = of.where("not several").groupBy("node").agg(F.count("*").alias("docs"))
        several = materialise(of.where("several").select("doc_id", "node"), "several")
        links = self.links.select("a", "b")
        near = links.toDF("node", "other").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).unionByName(single.select("node", F.col("node").alias("other")))
        if several.isEmpty():
            counts = near.join(single.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("docs").alias("n"))
            counts = of.join(counts, "node").select("doc_id", (F.col("n") - 1).alias("n_links"))
        else:
            near = near.unionByName(several.select("node", F.col("node").alias("other"))).distinct()
            asked = near.select(F.array("node").alias("nodes"), "other").unionByName(several.join(nodes, "doc_id").join(near, "node").select("nodes", "other")).distinct()
            alone = asked.join(single.withColumnRenamed("node", "other"), "other").groupBy("nodes").agg(F.sum("docs").alias("n"))
            more = asked.join(several.withColumnRenamed("node", "other"), "other").select("nodes", "doc_id").distinct().groupBy("nodes").agg(F.count("*").alias("m"))
            counts = nodes.join(alone, "nodes", "left").join(more, "nodes", "left").select("doc_id", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)) - 1).alias("n_links"))
        ids = self.documents.where("doc_id is not null").select("doc_id").distinct()
        return ids.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> Join:
    """All links of at least ``percent`` Jaccard similarity of k-word shingle sets, and their components.

    Links run between nodes; a node stands for all rows of one set. Components
    need only some links inside them; the others are compared when the result's
    ``links`` or ``link_counts`` is read.
    """
    spark, texts = docs.sparkSession, text_of(docs, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = materialise(texts.mapInArrow(_count(k), _COUNTED), "counted")
    classes = spark.sparkContext.broadcast(frequency_classes(counted.where("block is not null").select("block", "counts")))
    rows = counted.where("block is null").select("doc_id", "n", "f1", "f2")
    sketch = materialise(texts.mapInArrow(_sketch(k, percent, classes), _SKETCH), "sketch")
    sets = materialise(sketch.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node")), "nodes")
    standing = materialise(sketch.select("doc_id", "f1", "f2", "n").join(sets, ["f1", "f2", "n"]).select("doc_id", "node", "n"), "standing")
    # candidates of the first order: each posting with the first of its run
    postings = sketch.select(F.posexplode("p1").alias("place", "token"), "doc_id", "n").select("token", "doc_id", "place", "n")
    postings = postings.repartitionByRange(parts, "token", "place", "doc_id").sortWithinPartitions("token", "place", "doc_id")
    live = materialise(postings.mapInArrow(_runs(percent), "token long, doc_id long, place int, n long, pivot long, pair boolean, edge boolean"), "postings")
    edge = live.where("edge").select("token", "pivot")
    meet = edge.groupBy("token").agg(F.min("pivot").alias("least"))
    pairs = live.where("pair").select("doc_id", "pivot").distinct().unionByName(edge.join(meet, "token").where("pivot <> least").select(F.col("pivot").alias("doc_id"), F.col("least").alias("pivot")))
    one, two = standing.select("doc_id", F.col("node").alias("x")), standing.select(F.col("doc_id").alias("pivot"), F.col("node").alias("y"))
    pairs = pairs.join(one, "doc_id").join(two, "pivot").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = materialise(pairs, "candidates")
    links = _verified(pairs, sketch, texts, k, percent)
    # second turn: what shares a prefix shingle across components
    comp = components(links)
    tokens = live.select("token", "doc_id", "place").join(standing, "doc_id").select("token", "node", "place", "n").distinct()
    tokens = tokens.join(comp, "node", "left").select("token", "node", "place", "n", F.coalesce("component", "node").alias("component"))
    tokens = materialise(tokens, "tokens")
    sizes = tokens.groupBy("token", "component").agg(F.count("*").alias("c"))
    apart = tokens.join(materialise(_in_parts(sizes), "parts"), "token")
    cold, hot = apart.where(F.col("nodes") <= _HOT), apart.where(F.col("nodes") > _HOT)
    more = _met(cold.where("component <> main"), cold, percent).where("cx <> cy")
    if not hot.isEmpty():
        again = materialise(_recounted(hot.select("node", "n", "component").distinct(), texts, k, percent), "recounted")
        again = again.join(_in_parts(again.groupBy("token", "component").agg(F.count("*").alias("c"))), "token")
        more = more.unionByName(_met(again.where("component <> main"), again, percent).where("cx <> cy"))
    more = more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialise(more, "candidates")
    late = _verified(more, sketch, texts, k, percent)
    links = links.unionByName(late)
    comp = components(links) if not late.isEmpty() else comp
    members = rows.join(sets, ["f1", "f2", "n"]).select("doc_id", "node").where("doc_id is not null").distinct()
    # rows with one id are one node: their sets are connected through it
    twice = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("c")).where("c > 1")
    if not twice.isEmpty():
        same = members.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
        comp = components(links.select("a", "b").unionByName(same))
    # smallest ids are found by set, then by component, so that a set with a third of all rows is one row in both; the
    # rows then meet a written table, whose join the adaptive planner can split where a set is hot
    least = rows.where("doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("least"))
    label = sets.join(comp, "node", "left").join(least, ["f1", "f2", "n"]).select("f1", "f2", "n", F.coalesce("component", "node").alias("label"), "least")
    lowest = label.groupBy("label").agg(F.min("least").alias("component_id"))
    label = materialise(label.join(lowest, "label").select("f1", "f2", "n", "component_id"), "labels")
    documents = rows.join(label, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return Join(documents, links, members, lambda: _others(tokens, pairs.unionByName(more), sketch, texts, k, percent))


#: Nodes under one shingle that a task compares with the others of the shingle, and that share it before shingles are counted exactly.
_TOGETHER, _HOT = 256, 1024


def _in_parts(sizes: DataFrame) -> DataFrame:
    """(token, main, nodes) of the shingles whose nodes lie in several components, of (token, component, c nodes); main is the largest."""
    whole = sizes.groupBy("token").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("parts"), F.sum("c").alias("nodes"))
    return whole.where("parts > 1 and nodes > 2").select("token", "main", "nodes")


def _recounted(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, node, place, n, component): prefixes of the sets of (node, n, component) under the order of how many of these sets hold a shingle, counted exactly.

    Two of the sets that link share a shingle of these prefixes, whatever the
    order is. So a shingle that the table of fixed size let pass for a rare one moves
    back, and only sets that are mostly made of frequent shingles still meet under such.
    """
    own = nodes.select("node", F.col("n").alias("size"))
    sets = _sets_of(texts, nodes.select("node").distinct(), k).join(own, "node").where(F.size("tokens") == F.col("size"))
    rows = materialise(sets.select("node", F.col("size").alias("n"), F.explode("tokens").alias("token")), "shingles")
    counted = rows.join(rows.groupBy("token").agg(F.count("*").alias("c")), "token")
    place = F.row_number().over(Window.partitionBy("node", "n").orderBy("c", "token")) - 1
    placed = counted.withColumn("place", place).where(F.expr(f"place <= n - ({percent} * n + 99) div 100"))
    return placed.select("token", "node", "place", "n").join(nodes.select("node", "component"), "node").select("token", "node", "place", "n", "component")


def _met(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(x, cx, y, cy) of the rows of ``left`` and ``right`` under one shingle whose sizes and places allow a link.

    Rows are (token, node, place, n, component, nodes), nodes being the rows of
    the token. A shingle of more than _TOGETHER nodes is compared in parts: a node meets
    only those whose sizes fall in its own or a neighbouring band (outside of
    which no two sets reach the similarity), and salted parts of these, so
    that no task holds a hot shingle.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    hot, salts = F.col("nodes") > _TOGETHER, F.ceil(F.col("nodes") / _TOGETHER)
    none = F.array(F.lit(0))
    left = left.withColumn("band", F.explode(F.when(hot, F.array(band - 1, band, band + 1)).otherwise(none)))
    left = left.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), salts - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    left = left.select("token", "band", "salt", F.col("node").alias("x"), F.col("place").alias("px"), F.col("n").alias("nx"), F.col("component").alias("cx"))
    right = right.withColumn("band", F.when(hot, band).otherwise(0)).withColumn("salt", F.when(hot, F.pmod(F.xxhash64("node"), salts)).otherwise(F.lit(0).cast("long")))
    right = right.select("token", "band", "salt", F.col("node").alias("y"), F.col("place").alias("py"), F.col("n").alias("ny"), F.col("component").alias("cy"))
    share = F.expr(f"({percent} * (nx + ny) + {99 + percent}) div {100 + percent}")
    near = (F.col("x") != F.col("y")) & (F.col("px") <= F.col("nx") - share) & (F.col("py") <= F.col("ny") - share) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    return left.join(right, ["token", "band", "salt"]).where(near).select("x", "cx", "y", "cy")


def _others(tokens: DataFrame, compared: DataFrame, sketch: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, shared, joined) of the links among nodes under one prefix shingle that are not among the compared pairs."""
    live = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("nodes")).where("nodes > 1"), "token")
    pairs = _met(live, live, percent).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return _verified(materialise(pairs.join(compared, ["a", "b"], "left_anti"), "candidates"), sketch, texts, k, percent)


def _verified(pairs: DataFrame, sketch: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, shared, joined) of the candidate pairs that the sizes and the other orders allow and the whole sets confirm."""
    spark = pairs.sparkSession
    of = sketch.select("doc_id", "n", "slack", "p2", "p3")
    kept = pairs.join(of.toDF("a", "na", "sa", "a2", "a3"), "a").join(of.toDF("b", "nb", "sb", "b2", "b3"), "b")
    # Let x be the set whose prefix ends first in an order. All that its prefix shares with y lies in y's prefix, and
    # the rest of x holds n - prefix(n) shingles; together they must reach the overlap that the similarity asks for.
    need = F.expr(f"greatest(1, ({percent} * (na + nb) + {99 + percent}) div {100 + percent} - (({percent} * greatest(na, nb) + 99) div 100 - 1) - sa - sb)")
    kept = kept.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.size(F.array_intersect("a2", "b2")) >= need) & (F.size(F.array_intersect("a3", "b3")) >= need))
    kept = materialise(kept.select("a", "b"), "kept")
    if kept.isEmpty():
        return spark.createDataFrame([], "a long, b long, shared long, joined long")
    nodes = kept.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialise(_sets_of(texts, nodes, k).join(nodes, "node", "left_semi"), "sets")
    both = kept.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    both = both.select("a", "b", shared.alias("shared"), (F.size("ta") + F.size("tb") - shared).alias("joined"))
    return materialise(both.where(100 * F.col("shared") >= percent * F.col("joined")).groupBy("a", "b").agg(F.max("shared").alias("shared"), F.min("joined").alias("joined")), "links")
