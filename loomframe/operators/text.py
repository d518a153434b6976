"""Text operators: word counts, inverted index with postings algebra, suffix arrays, matching, distances, codes."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import register
from ..tables import stored, table


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, word): runs of ASCII letters, lower-cased."""
    return docs.select("doc_id", F.explode(F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", " ")), " +"), lambda w: w != "")).alias("word"))


def word_counts(docs: DataFrame) -> DataFrame:
    return words(docs).groupBy("word").agg(F.count("*").alias("n"))


def inverted_index(docs: DataFrame) -> DataFrame:
    """(word, doc_id, weight): postings with the number of occurrences, for documents of one row each.

    A row's words are sorted and counted in the row, so no posting moves to be counted.
    """
    listed = F.sort_array(F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", " ")), " +"), lambda w: w != ""))
    rows = docs.select("doc_id", listed.alias("w")).where("size(w) > 0")
    rows = rows.select("doc_id", "w", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1))).alias("at"))
    counted = F.transform("at", lambda a, k: F.struct(F.get("w", a).alias("word"), (F.coalesce(F.get("at", k + 1), F.size("w")) - a).cast("long").alias("weight")))
    return rows.select("doc_id", F.explode(counted).alias("p")).select("p.word", "doc_id", "p.weight")


def postings(index: DataFrame, word: str) -> DataFrame:
    return index.where(F.col("word") == word).select("doc_id", "weight")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("weight", "w2"), "doc_id").select("doc_id", (F.col("weight") + F.col("w2")).alias("weight"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("doc_id").agg(F.sum("weight").alias("weight"))


def but_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def top_k(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.desc("weight"), "doc_id").limit(k)


def suffix_array(chars: DataFrame) -> DataFrame:
    """(idx, rank): the place of each suffix of the character sequence (idx, c), by doubling the compared length.

    Ranks are the counts of smaller keys, from counts by distinct key, so a
    round is two joins and an aggregate; suffixes of unique rank stay in but settle.
    """
    from .sequence import dense

    def ranked(keyed: DataFrame) -> DataFrame:
        keys = dense(keyed.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"])
        from .sequence import scan

        before = scan(keys.select("idx", F.col("n").alias("x"))).select(F.col("idx").alias("i"), F.col("prefix").alias("rank")).join(keys.select(F.col("idx").alias("i"), "a", "b"), "i")
        return stored(keyed.join(before.select("a", "b", "rank"), ["a", "b"]).select("idx", "rank"))

    n = chars.count()
    state = ranked(chars.select("idx", F.col("c").cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    step = 1
    while step < n and state.select("rank").distinct().count() < n:
        after = state.select((F.col("idx") - step).alias("idx"), (F.col("rank") + 1).alias("b"))
        state = ranked(state.join(after, "idx", "left").select("idx", F.col("rank").alias("a"), F.coalesce("b", F.lit(0).cast("long")).alias("b")))
        step *= 2
    return state


def lcp(chars: DataFrame, ranks: DataFrame) -> DataFrame:
    """(rank, idx, before, lcp): common prefix of each suffix with its predecessor in the suffix array, by growing matched pairs."""
    prev = ranks.select((F.col("rank") + 1).alias("rank"), F.col("idx").alias("before"))
    pairs = ranks.join(prev, "rank").select("rank", "idx", "before", F.lit(0).cast("long").alias("lcp"))
    a, b = chars.select(F.col("idx").alias("i"), F.col("c").alias("ca")), chars.select(F.col("idx").alias("j"), F.col("c").alias("cb"))
    live, done = stored(pairs), None
    while True:
        grown = live.withColumn("i", F.col("idx") + F.col("lcp")).withColumn("j", F.col("before") + F.col("lcp")).join(a, "i", "left").join(b, "j", "left")
        same = F.col("ca").isNotNull() & (F.col("ca") == F.col("cb"))
        grown = stored(grown.select("rank", "idx", "before", "lcp", F.coalesce(same, F.lit(False)).alias("go")))
        stop = grown.where("not go").drop("go")
        done = stop if done is None else stored(done.unionByName(stop))
        live = grown.where("go").select("rank", "idx", "before", (F.col("lcp") + 1).alias("lcp"))
        if live.isEmpty():
            return done


def chars_of(text: DataFrame) -> DataFrame:
    """(idx, c): code points of one text (text)."""
    return text.select(F.posexplode(F.split("text", "")).alias("idx", "ch")).where("ch <> ''").select(F.col("idx").cast("long").alias("idx"), F.ascii("ch").cast("long").alias("c"))


def occurrences(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, pos): all places, overlapping ones too, where ``pattern`` begins."""
    places = F.expr(f"filter(sequence(0, greatest(char_length(text) - {len(pattern)}, 0)), i -> substring(text, i + 1, {len(pattern)}) = p)")
    return docs.where(F.contains("text", F.lit(pattern))).withColumn("p", F.lit(pattern)).select("doc_id", F.explode(places).alias("pos"))


@F.pandas_udf(T.LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Least insertions and deletions from one text to the other: lengths less twice the longest common subsequence, bit-parallel."""

    def one(x: str, y: str) -> int:
        x, y = x or "", y or ""
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for c in y:
            u = v & at.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return len(x) + len(y) - 2 * (len(x) - v.bit_count())

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def letters(docs: DataFrame) -> DataFrame:
    """(symbol, weight): the letters of all words."""
    return words(docs).select(F.explode(F.filter(F.split("word", ""), lambda x: x != "")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("weight"))


def huffman(weights: DataFrame) -> DataFrame:
    """(symbol, length) of an optimal prefix code of rows (symbol, weight): an alphabet fits the driver."""
    rows = weights.orderBy("symbol").collect()
    heap = [(r.weight, i, [i]) for i, r in enumerate(rows)]
    heapq.heapify(heap)
    length, n = [0] * len(rows), len(rows)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            length[i] += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
        n += 1
    return weights.sparkSession.createDataFrame([(r.symbol, x) for r, x in zip(rows, length, strict=True)], "symbol string, length long")


def bw_encode(chars: DataFrame) -> DataFrame:
    """(rank, c): the character before each suffix, in suffix order; the text ends with a 0 that sorts first."""
    n = chars.count()
    ended = chars.unionByName(chars.sparkSession.createDataFrame([(n, 0)], "idx long, c long"))
    ranks = suffix_array(ended)
    before = ended.select(((F.col("idx") + 1) % (n + 1)).alias("idx"), "c")
    return ranks.join(before, "idx").select("rank", "c")


def bw_decode(encoded: DataFrame) -> DataFrame:
    """(idx, c): the text of :func:`bw_encode`, its end mark left out; the last-to-first map is followed by doubling."""
    from .sequence import dense

    n = encoded.count()
    lf = stored(dense(encoded.select("c", F.col("rank").alias("r")), ["c", "r"]).select(F.col("r").alias("rank"), F.col("idx").alias("to"), "c"))
    # rank 0 is the end mark's suffix; steps back from it give the text from its end
    dist = stored(encoded.sparkSession.createDataFrame([(0, 0)], "rank long, k long"))
    jump = lf.select("rank", "to")
    have = 1
    while have < n:
        new = dist.join(jump, "rank").select(F.col("to").alias("rank"), (F.col("k") + have).alias("k")).where(F.col("k") < n)
        dist = stored(dist.unionByName(new))
        jump = stored(jump.join(jump.toDF("to", "t2"), "to").select("rank", F.col("t2").alias("to")))
        have *= 2
    return dist.join(lf, "rank").where("c <> 0").select((n - 2 - F.col("k")).alias("idx"), "c")


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _title(s, d):
    """The benchmark items' texts on one line: a text of some thousand characters."""
    return table(s, d, "benchmark").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda r: r["text"]), " ").alias("text"))


_W = r"(select doc_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), ' +'), lambda w: w <> '')) as word from documents)"
_P = f"(select doc_id, count(*) as weight from {_W} where word = '{{w}}' group by doc_id)"
_A, _B = _P.format(w="the"), _P.format(w="that")
register("word_counts", f"select word, count(*) as n from {_W} group by word")(lambda s, d: word_counts(_docs(s, d)))
register("inverted_index", f"select word, doc_id, count(*) as weight from {_W} group by word, doc_id")(lambda s, d: inverted_index(_docs(s, d)))
register("inverted_index_lists", f"select word, list(doc_id order by doc_id) as docs from (select distinct word, doc_id from {_W}) group by word")(lambda s, d: inverted_index(_docs(s, d)).groupBy("word").agg(F.array_sort(F.collect_list("doc_id")).alias("docs")))
register("postings", f"select doc_id, weight from {_A}")(lambda s, d: postings(inverted_index(_docs(s, d)), "the"))
register("postings_and", f"select a.doc_id, a.weight + b.weight as weight from {_A} a join {_B} b on a.doc_id = b.doc_id")(lambda s, d: both(postings(i := inverted_index(_docs(s, d)), "the"), postings(i, "that")))
register("postings_or", f"select doc_id, cast(sum(weight) as bigint) as weight from (select * from {_A} union all select * from {_B}) group by doc_id")(lambda s, d: either(postings(i := inverted_index(_docs(s, d)), "the"), postings(i, "that")))
register("postings_and_not", f"select doc_id, weight from {_A} where doc_id not in (select doc_id from {_B})")(lambda s, d: but_not(postings(i := inverted_index(_docs(s, d)), "the"), postings(i, "that")))
register("postings_top_k", f"select doc_id, weight from {_A} order by weight desc, doc_id limit 10")(lambda s, d: top_k(postings(inverted_index(_docs(s, d)), "the"), 10))
register("string_search", "select doc_id, unnest(list_filter(range(length(text)), lambda i: substr(text, i + 1, 6) = 'thathe')) as pos from documents where contains(text, 'thathe')")(lambda s, d: occurrences(_docs(s, d), "thathe").select("doc_id", F.col("pos").cast("long").alias("pos")))
_T = "(select string_agg(text, ' ' order by item_id) as t from benchmark)"
_SUF = f"(select i as idx, row_number() over (order by substr(t, i + 1)) - 1 as rank, substr(t, i + 1) as s from {_T}, lateral (select unnest(range(length(t))) as i))"
register("suffix_array", f"select idx, rank from {_SUF}")(lambda s, d: suffix_array(chars_of(_title(s, d))))
register("longest_repeat")(lambda s, d: lcp(c := stored(chars_of(_title(s, d))), suffix_array(c)).orderBy(F.desc("lcp"), "rank").limit(1).select("lcp", F.least("idx", "before").alias("one"), F.greatest("idx", "before").alias("two")))
register("bw_round_trip", "select unnest(range(length(t))) as idx, unnest(list_transform(string_split(t, ''), lambda c: ord(c))) as c from (select string_agg(text, ' ' order by item_id) as t from benchmark)")(lambda s, d: bw_decode(bw_encode(chars_of(_title(s, d)))))
register("edit_distance")(lambda s, d: table(s, d, "benchmark").select("item_id", edit_distance(F.col("text"), F.reverse("text")).alias("distance")))
_HUFF = f"select unnest(string_split(word, '')) as symbol from {_W}"
register("huffman_lengths")(lambda s, d: huffman(letters(_docs(s, d))))
register("letter_weights", f"select symbol, count(*) as weight from ({_HUFF}) group by symbol")(lambda s, d: letters(_docs(s, d)))
register("wiki_documents", r"select id, trim(lower(regexp_replace(body, '[^A-Za-z]+', ' ', 'g'))) as body from (select 0 as id, 'First one' as body union all select 1, 'Second, 2!')")(
    lambda s, d: parse_marked(s.createDataFrame([("<doc id=1>\nFirst one<doc id=2>\nSecond, 2!",)], "text string"))
)


def parse_marked(raw: DataFrame, mark: str = "<doc") -> DataFrame:
    """(id, body): texts cut at ``mark``, the head line dropped, letters lower-cased, the rest blanks."""
    cut = raw.select(F.posexplode(F.filter(F.split("text", mark, -1), lambda x: x != "")).alias("id", "part"))
    body = F.regexp_replace("part", r"^[^\n]*\n", "")
    return cut.select("id", F.trim(F.lower(F.regexp_replace(body, "[^A-Za-z]+", " "))).alias("body"))
