"""Quality rules: cross-document line frequency.

Every text is counted once (words, symbols, repeated lines and windows) and its
lines are hashed after normalising (words, lower-cased A-Z, one space). For
each host the number of distinct documents with a line is counted; lines above
the host's limit are removed, and a document with too little left is rejected.

Definitions for odd rows. A null text is empty. A null host is a host of its
own. Documents with equal text are one document in the line counts, so exact
copies and repeated rows never make a line frequent. Every input row gives one
result row; other columns of the input are not read. :func:`cleaned` gives the
kept rows with all their columns; rows that agree in id, host and text share a
verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linedup
from .common import materialise, split_by_ids
from .textcore import NEWLINE, SPACE, Spans, chunks, mix, polynomial, signed, windows

SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
_COUNTED = "doc_id long, host string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<struct<line:long,words:int,at:int>>"


def _per_text(cumulative: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(cumulative, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _lines(words: Spans, lines: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Of each line: the number of its words and the value of its folded word sequence."""
    first, last = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
    n = len(words.value)
    odd = np.uint64(0x9E3779B97F4A7C15)
    base = np.full(n + 1, odd, np.uint64)
    base[0] = 1
    inverse = np.full(n + 1, np.uint64(pow(int(odd), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.value * np.cumprod(base, dtype=np.uint64)[:n], dtype=np.uint64)])
    return last - first, mix((total[last] - total[first]) * np.cumprod(inverse, dtype=np.uint64)[first] + (last - first).astype(np.uint64))


def _count(max_line_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch):
                words = Spans(data, offsets, SPACE)
                folded = Spans(data, offsets, SPACE, fold=True)
                lines = Spans(data, offsets, NEWLINE)
                n = to - at
                starts = ((data & 0xC0) != 0x80) & ~SPACE[data]
                seen, bounds = windows(words.value, words.at, 5)
                text_of_window = np.repeat(np.arange(n), np.diff(bounds))
                _, inverse, count = np.unique(seen ^ mix(text_of_window.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
                first = words.at[text_of_window] + np.arange(len(seen)) - bounds[text_of_window]
                twice = first[count[inverse] >= 2]
                cover = np.zeros(len(words.start) + 6, np.int64)
                np.add.at(cover, twice, 1)
                np.add.at(cover, twice + 5, -1)
                covered = np.cumsum(cover)[: len(words.start)] > 0
                line_words, line_value = _lines(folded, lines)
                raw = polynomial(data, lines.start, lines.end)
                text_of_line = np.repeat(np.arange(n), lines.counts)
                breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])  # a span is a line that is not empty; its number counts empty ones
                line_of_text = (breaks[lines.start] - breaks[offsets[:-1]][text_of_line]).astype(np.int32)
                real = line_words > 0
                dup = np.zeros(n, np.int64)
                own = mix(raw) ^ mix(text_of_line.astype(np.uint64) + np.uint64(1))
                _, index = np.unique(own[real], return_index=True)
                np.add.at(dup, text_of_line[real], 1)
                np.subtract.at(dup, text_of_line[real][index], 1)
                counted = real if max_line_words is None else real & (line_words <= max_line_words)
                content = mix(polynomial(data, offsets[:-1], offsets[1:]))
                out_line = pa.StructArray.from_arrays([pa.array(signed(line_value[counted])), pa.array(line_words[counted].astype(np.int32)), pa.array(line_of_text[counted])], names=["line", "words", "at"])
                out_at = np.concatenate([[0], np.cumsum(np.bincount(text_of_line[counted], minlength=n))]).astype(np.int32)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(words.counts.astype(np.int64)), pa.array(_per_text(starts, offsets)), pa.array(_per_text(SYMBOLS[data], offsets)), pa.array(dup), pa.array(_per_text(covered, words.at)), pa.array(signed(content)), pa.ListArray.from_arrays(pa.array(out_at), out_line)],
                    names=["doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines"],
                )

    return run


def _key(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, share: float, max_line_words: int | None, min_left: float, min_words: int, max_repeat_percent: int) -> DataFrame:
    """(doc_id, host, key, the counts, base_failed, n_removed_words, removed_lines, drops, kept); drops are the numbers of the removed lines."""
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
    counted = counted.withColumn("key", _key(F.col("text")))
    counted = materialise(counted.mapInArrow(_count(max_line_words), _COUNTED).withColumn("row", F.monotonically_increasing_id()), "quality")
    host = F.coalesce("host", F.lit("\0")).alias("host")
    line = counted.select("row", host, "content", F.explode("lines").alias("l")).select("row", "host", "content", "l.line", "l.words", "l.at")
    limits = counted.select(host, "content").distinct().groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.lit(share) * F.count("*")).alias("most"))
    # distinct documents of a line: both steps add up within each task first, so that a hot line or host is a few rows
    often = line.select("host", "line", "content").distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    often = often.join(limits, "host").where(F.col("docs") > F.col("most")).select("host", "line")
    removed = line.join(often, ["host", "line"]).groupBy("row").agg(F.sum("words").cast("long").alias("n_removed_words"), F.collect_set("line").alias("removed_lines"), F.array_sort(F.collect_list("at")).alias("drops"))
    out = counted.drop("lines", "content").join(removed, "row", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        gone.alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"),
        (~failed & (F.col("n_words") - gone >= min_left * F.col("n_words"))).alias("kept"),
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, share: float = 0.01, max_line_words: int | None = None, min_left: float = 0.1, min_words: int = 10, max_repeat_percent: int = 20
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the five counts, base_failed, n_removed_words, removed_lines, kept.

    A line, of any length unless ``max_line_words`` bounds it, is frequent on its
    host when more than ``max(min_docs, share * distinct documents of the host)``
    distinct documents have it. removed_lines holds the values of the frequent lines of
    the text. A document is rejected when the base rules fail or when its other
    lines hold less than ``min_left`` of its words.
    """
    return _judged(docs, id_col, text_col, host_col, min_docs, share, max_line_words, min_left, min_words, max_repeat_percent).drop("host", "key", "drops")


def cleaned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, share: float = 0.01, max_line_words: int | None = None, min_left: float = 0.1, min_words: int = 10, max_repeat_percent: int = 20
) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns, and their texts without the frequent lines.

    Only rows that go or lose lines are joined with their verdicts; the others' texts don't move.
    """
    judged = _judged(docs, id_col, text_col, host_col, min_docs, share, max_line_words, min_left, min_words, max_repeat_percent)
    acts = judged.where(~F.col("kept") | (F.size("drops") > 0)).select(F.col("doc_id").alias("__doc_id"), F.col("host").alias("__host"), F.col("key").alias("__key"), F.col("kept").alias("__kept"), "drops")
    acts = materialise(linedup.bitmaps(acts.dropDuplicates(["__doc_id", "__host", "__key"])), "verdicts")
    still, moved = split_by_ids(docs, acts.select("__doc_id"), id_col)
    text = F.col(text_col)
    moved = moved.withColumn("__own", _key(text.cast("string")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__doc_id")) & (F.col("__own") == F.col("__key")) & F.col(host_col).cast("string").eqNullSafe(F.col("__host"))
    moved = moved.join(acts.hint("merge"), same, "left")  # grows with the corpus
    moved = moved.where(F.coalesce("__kept", F.lit(True)))
    left = F.when(F.size("bitmap") > 0, F.array_join(linedup.kept_lines(text.cast("string"), F.col("bitmap")), "\n")).otherwise(text)
    return still.unionByName(moved.select(*[left.alias(c) if c == text_col else F.col(c) for c in docs.columns]))
