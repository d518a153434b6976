"""Line deduplication: first occurrences of hashed lines, as keep bitmaps.

Lines become 128-bit hashes of their keys (stripped, A-Z lower-cased). The
hashes are range-partitioned and sorted by document and position; one stream
over each partition knows every line's first document and drops the lines of
later ones. The result is a run-length compressed bitmap for each document that
loses lines; texts never move for it.

A hash held by more than 1/``share`` of all lines would overload one range. A
count by hash bucket, then by hash, finds them exactly: there can be no more
than ``share``. Their first documents are found with partial aggregates and go,
at most ``share`` rows, to the tasks that read the lines.

Only texts that lose lines are joined with their bitmaps. Which rows to ask for
is known from a set of fixed size (a bit for each of 2**22 hashes of their ids); the
others are passed on where they are read.

Definitions for odd rows. A null or empty text is one empty line. Rows with
one id are one document: none of its lines is dropped because of another row
of it. Their texts may differ: a bitmap belongs to an id and a text, so each row
loses only lines of its own that smaller ids hold. A null id sorts before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, split_by_ids, text_of

_TRIM = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Characters beyond ASCII that have a lower case: upper-case and title-case letters, letter numbers, other symbols.
_OTHER_UPPER = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"


def line_key(line: Column) -> Column:
    """The line, stripped and with A-Z lower-cased.

    Where no other character has a lower case, that is what ``lower`` gives; ``translate``
    takes several times as long and makes an object of every character.
    """
    bare = F.trim(line, F.lit(_TRIM))
    plain = (F.octet_length(bare) == F.char_length(bare)) | ~F.rlike(bare, F.lit(_OTHER_UPPER))
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def content(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, share: int = 4096) -> DataFrame:
    """(doc_id, content, bitmap) of the texts that lose lines; content tells apart the texts of one id.

    bitmap holds the lengths of alternating runs of kept and dropped lines,
    beginning with kept ones (which may be 0 long).
    """
    spark = docs.sparkSession
    texts = text_of(docs, id_col, text_col)
    lines = texts.select("doc_id", content(F.col("text")).alias("content"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select("doc_id", "content", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.char_length("key") >= min_chars)
    lines = materialise(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "content", "pos"), "lines")
    most = lines.count() // share
    bucket = F.col("h1").bitwiseAND(F.lit(65535))
    full = [r[0] for r in lines.groupBy(bucket.alias("b")).count().where(F.col("count") > most).collect()]  # fewer than `share`
    hot = None
    if full and most:
        hot = lines.where(bucket.isin(full)).groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("first")).where(F.col("c") > most)
        hot = materialise(hot.select("h1", "h2", "first"), "hot")
        if hot.isEmpty():
            hot = None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = lines if hot is None else lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    stream = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = rest.repartitionByRange(parts, "h1", "h2").withColumn("first", F.first_value("doc_id").over(stream))
    again = rest.where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "content", "pos")
    if hot is not None:
        again = again.unionByName(lines.join(F.broadcast(hot), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "content", "pos"))
    drops = again.groupBy("doc_id", "content").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    return bitmaps(drops)


def bitmaps(drops: DataFrame) -> DataFrame:
    """``drops`` with its column drops, sorted positions, as the column bitmap of run lengths.

    Columns are named step by step, because a lambda evaluates anew whatever
    expression it mentions besides columns.
    """
    begins = F.filter("drops", lambda p, i: (i == 0) | (F.get("drops", i - 1) != p - 1))
    ends = F.filter("drops", lambda p, i: (i == F.size("drops") - 1) | (F.get("drops", i + 1) != p + 1))
    others = [c for c in drops.columns if c != "drops"]
    runs = drops.select(*others, begins.alias("begins"), ends.alias("ends"))
    kept = lambda b, i: b - F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1) + 1)
    return runs.select(*others, F.flatten(F.transform("begins", lambda b, i: F.array(kept(b, i), F.get("ends", i) - b + 1))).alias("bitmap"))


def kept_lines(text: Column, bitmap: Column) -> Column:
    """The lines of ``text`` that its bitmap keeps (null: all)."""
    dropped = F.flatten(F.transform(F.coalesce(bitmap, F.array().cast("array<int>")), lambda n, i: F.array_repeat(i % 2 == 1, n)))
    marked = F.zip_with(split_lines(text), dropped, lambda line, gone: F.struct(line.alias("line"), gone.alias("gone")))
    return F.transform(F.filter(marked, lambda x: ~F.coalesce(x["gone"], F.lit(False))), lambda x: x["line"])


def n_dropped(bitmap: Column) -> Column:
    odd = F.transform(F.coalesce(bitmap, F.array().cast("array<int>")), lambda n, i: F.when(i % 2 == 1, n).otherwise(0))
    return F.aggregate(odd, F.lit(0).cast("long"), lambda a, n: a + n)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, share: int = 4096) -> DataFrame:
    """``docs`` with its text without the dropped lines, and columns __n_lines (before) and __n_dropped."""
    bits = materialise(dropped_lines(docs, id_col, text_col, min_chars, share), "bitmaps").select(F.col("doc_id").alias("__doc_id"), F.col("content").alias("__content"), F.col("bitmap").alias("__bitmap"))
    text = F.col(text_col)
    # what is joined grows with the corpus, so it is shuffled at every size
    still, moved = split_by_ids(docs, bits.select("__doc_id"), id_col)
    moved = moved.withColumn("__own", content(text.cast("string")))
    moved = moved.join(bits.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__doc_id")) & (F.col("__own") == F.col("__content")), "left").drop("__own", "__doc_id", "__content")
    out = still.withColumn("__bitmap", F.lit(None).cast("array<int>")).unionByName(moved)
    kept = F.when(F.col("__bitmap").isNull(), text).otherwise(F.array_join(kept_lines(text, F.col("__bitmap")), "\n"))
    return out.select(*[c for c in docs.columns if c != text_col], kept.alias(text_col), F.size(split_lines(text)).cast("long").alias("__n_lines"), n_dropped(F.col("__bitmap")).alias("__n_dropped"))
