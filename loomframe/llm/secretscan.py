"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a blob named by its SHA-256. The ledger remembers
which (blob, rule, rule version) pairs were scanned; a scan reads only blobs
with a pair not yet in it, each once however many paths hold it, appends the
pairs and what was found, and joins findings back to every path.

Spans come from JVM regular expressions: the texts between a rule's matches
and the matches themselves, both leftmost and non-overlapping, give all
offsets as running sums of their lengths in code points.

Definitions for odd rows. A null text is the empty blob. Rows with one path
and text repeat their findings; a path may have many versions. Null paths are
kept. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, split_by_ids

_BLANK = "cast(array() as array<struct<start:long,end:long>>)"


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    pattern is a Java regular expression. A match is kept if its ``group`` has
    at least ``least`` characters. Texts without any of ``hints`` are not tried.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()


#: In the order in which kinds sort at one place. Greedy runs of at least n characters are found as such.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("=", ":")),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x20\t\r\n]+-----END [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, ("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyJ",)),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spans(text: Column, rule: Rule) -> tuple[Column, Column, Column, Column]:
    """Columns to evaluate first: the texts between matches, the matches, their deciding group, and whether to look at all."""
    pattern = F.lit(rule.pattern)
    hint = F.lit(True)
    if rule.hints:
        hint = F.contains(text, F.lit(rule.hints[0]))
        for h in rule.hints[1:]:
            hint = hint | F.contains(text, F.lit(h))
    found = hint & F.rlike(text, pattern)
    return F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group)), found


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, start, end) of rows (blob, text): spans in code points, end exclusive."""
    parts = []
    texts = blobs.select("blob", F.coalesce("text", F.lit("")).alias("text"))
    # one pass: the rules that match, then for those the pieces, then the running sums
    marked = texts.select("blob", "text", *[spans(F.col("text"), r)[3].alias(f"m{i}") for i, r in enumerate(rules)])
    marked = marked.where(" or ".join(f"m{i}" for i in range(len(rules))))
    for i, r in enumerate(rules):
        between, whole, group, _ = spans(F.col("text"), r)
        size = lambda a: F.transform(a, F.char_length)
        piece = F.arrays_zip(size(between).alias("b"), size(whole).alias("m"), size(group).alias("g"))
        parts.append(F.when(F.col(f"m{i}"), piece))
    pieces = marked.select("blob", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), p.alias("pieces")) for r, p in zip(rules, parts, strict=True)])).alias("x"))
    pieces = pieces.select("blob", "x.*").where("pieces is not null")
    running = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr(_BLANK).alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["b"] + F.coalesce(p["m"], F.lit(0))).alias("at"),
            F.when(p["m"].isNull() | (p["g"] < F.col("least")), acc["out"]).otherwise(F.array_append(acc["out"], F.struct((acc["at"] + p["b"]).alias("start"), (acc["at"] + p["b"] + p["m"]).alias("end")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return pieces.select("blob", "kind", "version", F.explode(running).alias("s")).select("blob", "kind", "version", "s.start", "s.end")


@dataclass
class Ledger:
    """scanned: (blob, kind, version); findings: (blob, kind, version, start, end)."""

    scanned: DataFrame
    findings: DataFrame


def empty_ledger(spark) -> Ledger:
    return Ledger(spark.createDataFrame([], "blob string, kind string, version int"), spark.createDataFrame([], "blob string, kind string, version int, start long, end long"))


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Ledger]:
    """Findings (path, blob, kind, version, start, end) of all paths under ``rules``, and the ledger after the scan.

    The first row of a blob stands for it, so each unseen text is scanned once, and only with the rules that the
    ledger lacks for it: after a new version of one rule, no other rule is tried on a known blob. No text moves.
    """
    spark = docs.sparkSession
    ledger = ledger or empty_ledger(spark)
    texts = docs.select(F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text"))
    held = texts.select("path", blob_of(F.col("text")).alias("blob"))
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    holders = held.groupBy("blob").agg(F.min("path").alias("path"))
    # unseen pairs: every blob with the rules that the ledger lacks for it
    known = ledger.scanned.join(F.broadcast(wanted), ["kind", "version"]).groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("known"))  # as many as there are rules
    all_rules = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    todo = holders.join(known, "blob", "left").select("path", "blob", F.when(F.col("known").isNull(), all_rules).otherwise(F.array_except(all_rules, "known")).alias("todo")).where(F.size("todo") > 0)
    # blobs that lack the same rules are scanned together, by those alone; there are as many such sets as the rules had versions
    lacks = F.array_join(F.transform("todo", lambda t: F.concat_ws(":", t["kind"], t["version"])), ",")
    todo = materialise(todo.withColumn("lacks", lacks), "unseen")
    fresh = None
    for (names,) in sorted(todo.select("lacks").distinct().collect()):
        own = todo.where(F.col("lacks") == names)
        missing = tuple(r for r in rules if f"{r.kind}:{r.version}" in names.split(","))
        # the holders' rows, and few others; what they hold besides the blobs is left out of the findings
        _, asked = split_by_ids(texts.withColumn("place", F.xxhash64("path")), own.select(F.xxhash64("path")), "place")
        part = scan_blobs(asked.select(blob_of(F.col("text")).alias("blob"), "text"), missing).join(own.select("blob"), "blob", "left_semi")
        fresh = part if fresh is None else fresh.unionByName(part)
    fresh = materialise(fresh.distinct() if fresh is not None else empty_ledger(spark).findings, "findings")
    after = Ledger(ledger.scanned.unionByName(todo.select("blob", F.explode("todo").alias("t")).select("blob", "t.kind", "t.version")), ledger.findings.unionByName(fresh))
    found = after.findings.join(F.broadcast(wanted), ["kind", "version"])
    return held.join(found, "blob").select("path", "blob", "kind", "version", "start", "end"), after


def digests(docs: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text", base: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """(path, blob, n by base kind, base_spans, spans) of every row of ``docs``; spans joined as kind:start:end by start, then kind as listed."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    by = found.select("blob", "kind", "start", "end").distinct().groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", F.array_position(order, F.col("kind")).alias("k"), "kind", "end"))).alias("all"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    none = F.expr("cast(array() as array<struct<start:long,k:long,kind:string,end:long>>)")
    own = docs.select(F.col(path_col).alias("path"), blob_of(F.col(text_col).cast("string")).alias("blob")).join(by, "blob", "left").withColumn("all", F.coalesce("all", none))
    def count(kind: str) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return own.select("path", "blob", *map(count, base), joined(F.filter("all", lambda s: s["kind"].isin(*base))).alias("base_spans"), joined(F.col("all")).alias("spans"))
