"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Every document becomes its token ids and an end id; one that is longer than
the capacity is cut into full pieces, the first piece taking the remainder.
Full pieces are sequences already. The others are dealt at random to groups of
about ``group_rows`` pieces; each group goes, longest first, to the tightest
open sequence, which a segment tree over the remaining capacities finds in
logarithmic time. Sequences left open by the groups are packed once more, as
wholes and in the same way, so that grouping costs next to nothing.

Definitions for odd rows. A null or empty text is the end id alone. Every row
is a document, repeated rows and null ids too. No row gives no piece. Pieces of
equal length are taken in any order. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Letters, signs and spaces on whose classes both libraries agree by construction of Unicode's stable categories.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*")
_SPECIAL = re.compile(r"<\|")
_loaded: dict = {}


class Encoder:
    """Ids of one vocabulary: a rank table's fast reader for plain text, the tokenizer file for any other."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.read, self.fast = lambda: Tokenizer.from_file(path), None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @cached_property
    def exact(self):
        """Read when a text asks for it, since two vocabularies take twice the memory."""
        return self.read()

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and _PLAIN.fullmatch(text) and not _SPECIAL.search(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    """One per worker and vocabulary."""
    if (path, ranks) not in _loaded:
        _loaded[path, ranks] = Encoder(path, ranks, pattern)
    return _loaded[path, ranks]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _tokenise(path: str, ranks: str | None, pattern: str | None, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks, pattern)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for piece, (at, n) in enumerate(cuts(len(ids), capacity)):
                    own = ids[at : at + n]
                    out.append((doc_id.as_py(), piece, at, n, zlib.crc32(own.tobytes()), *([own.astype(np.int64)] if with_ids else [])))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return run


class OpenBins:
    """Open bins by remaining capacity, under a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, left: int, by: int) -> None:
        i = left + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def push(self, left: int, bin_: int) -> None:
        self.bins[left].append(bin_)
        self._count(left, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the bin with the least remaining capacity of at least ``need``: (remaining, bin)."""
        tree, i = self.tree, need + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        left = i - self.size
        self._count(left, -1)
        return left, self.bins[left].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by best-fit decreasing."""
    open_bins, bins = OpenBins(capacity), 0
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_bins.tightest(need)
        if found is None:
            found, bins = (capacity, bins), bins + 1
        left, b = found
        bin_of[i], offset[i] = b, capacity - left
        if left > need:
            open_bins.push(left - need, b)
    return bin_of, offset


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        bin_of, offset = best_fit(group["length"].to_numpy(), capacity)
        fill = np.bincount(bin_of, weights=group["length"]).astype(np.int64)
        return pd.DataFrame({"item": group["item"], "bin": (group["g"].to_numpy() << 32) + bin_of, "offset": offset, "fill": fill[bin_of]})

    return run


def _grouped(items: DataFrame, capacity: int, group_rows: int) -> DataFrame:
    """(item, bin, offset, fill) of rows (item, length); items are unique."""
    groups = max(1, -(-items.count() // group_rows))
    dealt = items.withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups)))
    return materialise(dealt.groupBy("g").applyInPandas(_pack(capacity), "item long, bin long, offset long, fill long"), "bins")


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024, group_rows: int = 32768, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if ``with_ids``.

    ``ranks_path`` and ``pattern`` may name the same vocabulary as byte-pair
    ranks, which are read several times as fast and give the same ids.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    cut = text_of(docs, id_col, text_col).mapInArrow(_tokenise(tokenizer_path, ranks_path, pattern, end_id, capacity, with_ids), schema)
    cut = materialise(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = _grouped(cut.where(F.col("length") < capacity).select("item", "length"), capacity, group_rows)
    left = placed.groupBy("bin").agg(F.max("fill").alias("fill"))
    least = left.agg(F.min("fill")).first()[0]
    again = left.where(F.col("fill") + F.lit(least or capacity) <= capacity).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
    moved = _grouped(again, capacity, group_rows).select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
    placed = placed.join(moved, "bin", "left").select(
        "item", F.when(F.col("to").isNull(), 3 * F.col("bin")).otherwise(3 * F.col("to") + 1).alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
    )
    out = cut.join(placed, "item", "left")
    return out.select(*[c for c in cut.columns if c != "item"], F.coalesce("sequence_id", 3 * F.col("item") + 2).alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of :func:`pack`'s rows with ids: at most the capacity of ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
