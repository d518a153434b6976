"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for every slot, one bit per language; the AND
over an n-gram's slots is the set of all languages that contain it. A text's
hits are counted by language (popcounts), corrected for the filter's false
positives, and the language with the most true hits is the prediction.

The filter is learned from a bounded sample: ``train_rows`` different labelled
rows of each language, picked by a hash of their id and text. All languages and
all n-grams of the sample are learned; the number of slots follows from the language
with the most n-grams, so that its share of set bits stays below a third.
n-grams are of bytes: A-Z lower-cased, other ASCII characters that are not
letters read as one space each.

Definitions for odd rows. A null text, or one without a letter, is ``und`` with
score 0. A text with letters but without any known n-gram, and every tie, goes
to the language with more training rows. Rows with a null language are not
learned from; equal rows are learned from once, and rows with one id are rows of their own. With nothing to
learn from, all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .textcore import _BASE, _INVERSE, _VALUES, _power, chunks, mix

GRAMS = (3, 5)
#: Hash functions of the filter, and log2 of its slots at least and of those written as one block.
HASHES, LEAST_BITS, BLOCK_BITS = 3, 16, 12
_MIXERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[:128] = 0x20
_NORMAL[0x61:0x7B] = np.arange(0x61, 0x7B)
_NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each n-gram, its value) for each n of GRAMS; every text stands between two spaces."""
    texts = len(offsets) - 1
    padded = np.full(len(data) + 2 * texts, 0x20, np.uint8)
    start = offsets[:-1] + 2 * np.arange(texts)
    end = offsets[1:] + 2 * np.arange(texts) + 2
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(texts) + 1, np.diff(offsets))] = _NORMAL[data]
    n = len(padded)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[False][padded] * _power(_BASE, n), dtype=np.uint64)])
    inverse = _power(_INVERSE, n + 1)
    for k in GRAMS:
        count = np.maximum(end - start - k + 1, 0)
        text = np.repeat(np.arange(texts), count)
        first = np.arange(len(text)) + np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        yield text, mix((total[first + k] - total[first]) * inverse[first] + np.uint64(k))


def slots(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for odd in _MIXERS[:HASHES]:
        yield (mix(values ^ odd) >> np.uint64(64 - bits)).view(np.int64)


def slot_bits(most: int) -> int:
    """log2 of the slots for a language of ``most`` n-grams: at least 8 slots for each."""
    return max(LEAST_BITS, (8 * most - 1).bit_length())


def mask_type(languages: int) -> np.dtype:
    """Of the masks of one plane: as many bits as there are languages, up to 64."""
    return np.dtype(f"u{next((n for n in (1, 2, 4) if languages <= 8 * n), 8)}")


def new_planes(languages: int, bits: int) -> np.ndarray:
    kind = mask_type(languages)
    return np.zeros((-(-languages // (8 * kind.itemsize)), 1 << bits), kind)


def mark(planes: np.ndarray, language: int, values: np.ndarray) -> None:
    """Sets the language's bit in the slots of its n-grams."""
    width, bits = 8 * planes.itemsize, planes.shape[1].bit_length() - 1
    for s in slots(values, bits):
        planes[language // width, s] |= planes.dtype.type(1 << language % width)


class Filter:
    """Languages and, for every slot, the mask of those that have it, in planes of up to 64 languages."""

    def __init__(self, languages: list[str], planes: np.ndarray):
        self.languages, self.planes = languages, planes
        self.width, self.bits = 8 * planes.itemsize, planes.shape[1].bit_length() - 1
        filled = [((planes[i // self.width] >> planes.dtype.type(i % self.width)) & planes.dtype.type(1)).mean() for i in range(len(languages))]
        self.false = np.array(filled, np.float64) ** HASHES

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams by text, and those found by text and language."""
        texts = len(offsets) - 1
        n, found = np.zeros(texts, np.int64), np.zeros((texts, len(self.languages)), np.int64)
        for text, values in grams(data, offsets):
            n += np.bincount(text, minlength=texts)
            at = list(slots(values, self.bits))
            for p, plane in enumerate(self.planes):
                mask = plane[at[0]]
                for s in at[1:]:
                    mask &= plane[s]
                for byte in range(0, min(self.width, len(self.languages) - p * self.width), 8):
                    first = p * self.width + byte
                    own = min(8, len(self.languages) - first)
                    eight = ((mask >> plane.dtype.type(byte)) & plane.dtype.type(255)).astype(np.int64)
                    table = np.bincount(text * 256 + eight, minlength=texts * 256).reshape(texts, 256)
                    found[:, first : first + own] += table @ ((np.arange(256)[:, None] >> np.arange(own)) & 1)
        return n, found

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and score of each text."""
        n, found = self.hits(data, offsets)
        true = np.clip((found - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.99)), 0, n[:, None])
        best = true.argmax(axis=1)
        return best, np.clip(true[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for at, to, data, offsets in chunks(batch):
            own = langs[at:to]
            for lang in sorted(set(own)):
                mine = own == lang
                values = np.concatenate([v[mine[t]] for t, v in grams(data, offsets)])
                value, count = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(count)], names=["lang", "gram", "c"])


def _blocks(languages: list[str], bits: int):
    """(plane, block, masks) of the blocks of slots that a task's (lang, gram) rows touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        planes = new_planes(len(languages), bits)
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            values = np.asarray(batch.column(1)).view(np.uint64)
            own = np.asarray(langs.indices)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                mark(planes, number[name], values[own == i])
        rows = [(p, at, part.tobytes()) for p, plane in enumerate(planes) for at, part in enumerate(plane.reshape(-1, 1 << BLOCK_BITS)) if part.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["plane", "block", "masks"])

    return run


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 1000) -> Filter:
    """The filter learned from the rows of ``docs`` for which ``train`` holds, at most ``train_rows`` of each language."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    picked = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("place", place)
    found = picked.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row a language
    if not found:
        return Filter([], new_planes(0, LEAST_BITS))
    # places below a threshold that leaves about twice the wanted rows, so that no language's rows meet in one task
    below = spark.createDataFrame([(r.lang, int(min(1.0, (2.0 * train_rows + 50) / r.n) * (1 << 40))) for r in found], "lang string, below long")
    some = picked.select("lang", "place").join(F.broadcast(below), "lang").where("place < below").select("lang", "place").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = some.withColumn("r", rank).where(F.col("r") <= train_rows).select("lang", "place")
    sample = picked.join(F.broadcast(chosen), ["lang", "place"], "left_semi").dropDuplicates(["lang", "place"])  # at most train_rows rows a language
    learned = materialise(sample.select("text", "lang").mapInArrow(_train, "lang string, gram long, c long").select("lang", "gram").distinct(), "grams")
    languages = [r.lang for r in found]
    most = learned.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    planes = new_planes(len(languages), slot_bits(most))
    size = 1 << BLOCK_BITS
    for p, at, masks in learned.mapInArrow(_blocks(languages, slot_bits(most)), "plane int, block int, masks binary").toLocalIterator():
        planes[p, at * size : (at + 1) * size] |= np.frombuffer(masks, planes.dtype)
    return Filter(languages, planes)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = shared.value
        for batch in batches:
            names, scores = [], []
            for at, to, data, offsets in chunks(batch):
                best, score = known.predict(data, offsets) if known.languages else (np.zeros(to - at, int), np.zeros(to - at))
                letters = np.concatenate([[0], np.cumsum(_NORMAL[data] - 0x61 < 26)])
                plain = letters[offsets[1:]] > letters[offsets[:-1]]
                for d in range(to - at):
                    real = known.languages and (plain[d] or has_letter(bytes(data[offsets[d] : offsets[d + 1]]).decode("utf-8", "replace")))
                    names.append(known.languages[best[d]] if real else "und")
                    scores.append(float(score[d]) if real else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, known: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; the score is the share of the text's n-grams that its language holds."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
