"""Benchmark decontamination: pigeonhole edit matching.

Texts and test items are words (letters and digits, A-Z lower-cased). An item
of n words may differ from a passage by ``budget`` word edits; it is cut into
budget + 1 pieces, one of which any such passage holds unchanged. Piece hits
are found by value look-up over all word windows; the passage around each hit
is verified with Myers' bit-parallel edit distance over words.

Test items of up to ``block_chars`` characters in all are looked up in a table that
every task holds. More are joined: a set of fixed size tells which windows of the documents
may be pieces, those are joined with the pieces by their values, and the passages
around the hits are verified where the document's text and the item's meet. Either
way the documents' windows are read in one pass.

Definitions for odd rows. Null and empty texts, and items without a word, match
nothing. Items of few words have the same error rate, so those of fewer than
1 / ``rate`` words match unchanged only. Rows of the benchmark that agree in id and
text are one item, those of one id and different texts several. Every row of
``docs`` is searched on its own, so repeated rows repeat their matches; of
several passages near one item the closest counts, of equal ones the first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, split_by_ids, text_of
from .textcore import PUNCT, Spans, chunks, windows

_MATCH = "doc_id long, item_id long, distance long, item_words long, start long, end long"


def budget(n: int, rate: float) -> int:
    """Word edits allowed in an item of n words; a piece keeps at least one word."""
    return min(int(n * rate + 1e-9), n - 1)


def pieces(n: int, errors: int) -> list[int]:
    """Where the errors + 1 pieces of an item of n words begin."""
    return [n * i // (errors + 1) for i in range(errors + 1)]


def myers(pattern: list, text: list, anchored: bool = False) -> tuple[int, int]:
    """(least distance, words of ``text`` read for it) of ``pattern`` and a passage of ``text``.

    The passage may begin anywhere, or, if ``anchored``, must begin the text;
    it may end anywhere. Ties go to the shortest read.
    """
    n = len(pattern)
    where: dict = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, (n, 0)
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | anchored) & full
        minus = minus << 1 & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
        if score < best[0]:
            best = (score, j + 1)
    return best


def values_of(text: str | None) -> np.ndarray:
    """The values of a text's words."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return Spans(raw, np.array([0, len(raw)]), PUNCT, fold=True).value


def seeds(values: np.ndarray, rate: float, seed: int) -> Iterator[tuple[int, int, int]]:
    """(k, value, place) of the first k words of each piece of an item; k is ``seed``, or less for shorter pieces."""
    n = len(values)
    errors = budget(n, rate)
    k = min(seed, n // (errors + 1))
    for p in pieces(n, errors):
        yield k, int(windows(values[p : p + k], np.array([0, k]), k)[0][0]), p


def closest(pattern: list, errors: int, begins: list[int], words: np.ndarray) -> tuple[int, int, int] | None:
    """(distance, first word, end word) of the passage nearest to ``pattern`` near one of ``begins``, if within ``errors`` edits."""
    n, own = len(pattern), len(words)
    spans: list[list[int]] = []
    for b in sorted(begins):
        lo, hi = max(0, b - errors), min(own, b + n + errors)
        if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 4 * (n + 2 * errors):
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    best = None
    for lo, hi in spans:
        text = words[lo:hi].tolist()
        distance, read = myers(pattern, text)
        if distance <= errors and (best is None or distance < best[0]):
            back = myers(pattern[::-1], text[:read][::-1], anchored=True)[1]
            best = (distance, lo + read - back, lo + read)
    return best


class Items:
    """The look-up table of test items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, seed: int):
        self.words, self.errors, self.ids = [], [], []
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in items:
            values = values_of(text)
            if not len(values):
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            self.words.append(values.tolist())
            self.errors.append(budget(len(values), rate))
            for k, value, p in seeds(values, rate, seed):
                found[k].append((value, at, p))
        self.table = {}
        for k, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            near = np.zeros(1 << 16, bool)
            near[keys >> np.uint64(48)] = True
            self.table[k] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), near)

    def hits(self, words: Spans) -> Iterator[tuple[int, int, int]]:
        """(text, item, word where the item would begin) of every piece hit."""
        for k, (keys, item, at, near) in self.table.items():
            values, bounds = windows(words.value, words.at, k)
            maybe = np.flatnonzero(near[values >> np.uint64(48)])
            lo, hi = np.searchsorted(keys, values[maybe], "left"), np.searchsorted(keys, values[maybe], "right")
            for w, a, b in zip(maybe[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                d = int(np.searchsorted(bounds, w, "right")) - 1
                for x in range(a, b):
                    yield d, int(item[x]), w - int(bounds[d]) - int(at[x])

    def matches(self, words: Spans) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word) of the closest passage of each text and item within the budget."""
        found = defaultdict(set)
        for d, i, begin in self.hits(words):
            found[d, i].add(begin)
        for (d, i), begins in sorted(found.items()):
            best = closest(self.words[i], self.errors[i], list(begins), words.value[words.at[d] : words.at[d + 1]])
            if best:
                yield d, i, *best


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            rows = []
            for at, _, data, offsets in chunks(batch):
                words = Spans(data, offsets, PUNCT, fold=True)
                begins = None
                for d, i, distance, first, end in items.matches(words):
                    if begins is None:  # code points before each byte
                        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    lo, hi = words.start[words.at[d] + first], words.end[words.at[d] + end - 1]
                    rows.append((batch.column(0)[at + d].as_py(), items.ids[i], distance, len(items.words[i]), int(begins[lo] - begins[offsets[d]]), int(begins[hi] - begins[offsets[d]])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "distance", "item_words", "start", "end"])

    return run


#: log2 of the bits of the set of pieces, and of those of one row of it.
_PIECE_BITS, _ROW_BITS = 26, 15


def _pieces(rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item_id, text, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = values_of(text)
                rows += [(item_id, content, k, value - (value >> 63 << 64), p) for k, value, p in (seeds(values, rate, seed) if len(values) else ())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item_id", "item", "k", "value", "place"])

    return run


def _maybe(shared, sizes: list[int]):
    """(doc_id, content, k, value, at) of the windows whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for at, to, data, offsets in chunks(batch):
                words = Spans(data, offsets, PUNCT, fold=True)
                part = batch.slice(at, to - at)
                for k in sizes:
                    values, bounds = windows(words.value, words.at, k)
                    slot = (values & np.uint64((1 << _PIECE_BITS) - 1)).astype(np.int64)
                    hit = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    if len(hit):
                        d = np.searchsorted(bounds, hit, "right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(d)), part.column(2).take(pa.array(d)), pa.array(np.full(len(hit), k, np.int64)), pa.array(values[hit].view(np.int64)), pa.array((hit - bounds[d]).astype(np.int64))],
                            names=["doc_id", "content", "k", "value", "at"],
                        )

    return run


def _verify(rate: float):
    """Matches of rows (doc_id, text, item_id, item's text, begins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, item_id, item, begins in zip(*batch.columns, strict=True):
                raw, pattern = np.frombuffer(text.as_py().encode(), np.uint8), values_of(item.as_py())
                words = Spans(raw, np.array([0, len(raw)]), PUNCT, fold=True)
                best = closest(pattern.tolist(), budget(len(pattern), rate), begins.as_py(), words.value)
                if best:
                    distance, first, end = best
                    lo, hi = (int(np.count_nonzero((raw[:x] & 0xC0) != 0x80)) for x in (words.start[first], words.end[end - 1]))
                    rows.append((doc_id.as_py(), item_id.as_py(), distance, len(pattern), lo, hi))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "distance", "item_words", "start", "end"])

    return run


def _joined(texts: DataFrame, items: DataFrame, rate: float, seed: int) -> DataFrame:
    """The matches of any number of items: windows that may be pieces are joined with them by value."""
    spark = texts.sparkSession
    content = lambda c: F.xxhash64(c)
    items = materialise(items.withColumn("item", content(F.col("text"))), "items")
    cut = materialise(items.select("item_id", "text", "item").mapInArrow(_pieces(rate, seed), "item_id long, item long, k long, value long, place long"), "pieces")
    slot = F.col("value").bitwiseAND(F.lit((1 << _PIECE_BITS) - 1))
    rows = cut.select(F.shiftright(slot, _ROW_BITS).alias("row"), slot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table, size = np.zeros(1 << (_PIECE_BITS - 3), np.uint8), 1 << (_ROW_BITS - 3)
    for row, bits in rows.toLocalIterator():  # 2**(_PIECE_BITS - _ROW_BITS) rows at most, whatever the benchmark
        table[row * size : (row + 1) * size] = np.frombuffer(bits, np.uint8)
    sizes = sorted(r.k for r in cut.select("k").distinct().collect())  # at most ``seed``
    texts = texts.where("text is not null").withColumn("content", content(F.col("text")))
    maybe = texts.mapInArrow(_maybe(spark.sparkContext.broadcast(table), sizes), "doc_id long, content long, k long, value long, at long")
    near = maybe.join(cut, ["k", "value"]).select("doc_id", "content", "item_id", "item", (F.col("at") - F.col("place")).alias("begin"))
    near = materialise(near.groupBy("doc_id", "content", "item_id", "item").agg(F.collect_set("begin").alias("begins")), "near")  # within one text
    near = near.join(items.select(F.col("item_id").alias("i"), F.col("item").alias("c"), F.col("text").alias("item_text")), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item") == F.col("c")))
    near = near.select(F.col("doc_id").alias("d"), F.col("content").alias("own"), "item_id", "item_text", "begins")
    _, moved = split_by_ids(texts, near.select("d"))
    moved = moved.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("own")))
    return moved.select("doc_id", "text", "item_id", "item_text", "begins").mapInArrow(_verify(rate), _MATCH)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.2, seed: int = 4, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start, end): passages within ``rate`` word edits of a test item.

    start and end count code points of the text. Up to ``block_chars`` characters of
    test items are broadcast, and no row moves between executors; more are
    joined. ``seed`` is how many words of a piece are looked up at most, and doesn't change what is found.
    """
    spark, texts = docs.sparkSession, text_of(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null and text <> ''").dropDuplicates()
    if (items.agg(F.sum(F.char_length("text"))).first()[0] or 0) > block_chars:
        return _joined(texts, items, rate, seed)
    block = [(r.item_id, r.text) for r in items.collect()]  # as many as block_chars at most
    return texts.mapInArrow(_search(spark.sparkContext.broadcast(Items(block, rate, seed))), _MATCH)
