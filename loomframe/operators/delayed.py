"""Delayed sequences: operations that are composed without being run, and fused into one pass when a terminal asks for the result.

A delayed sequence is a column expression over positions, not a table: maps,
filters and zips on it only build the expression. ``Delayed`` keeps the source
and the expression apart, so that a chain of any length is one projection and one
filter of the source in one code-generated stage. Terminals are ``reduce``,
``to_sequence``, ``scan``, ``for_each`` and ``apply``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register
from ..tables import stored
from . import sequence
from .sequence import MONOIDS, S, seq_of


@dataclass(frozen=True)
class Delayed:
    """Positions of ``source`` (idx, ...), the value at each, and which of them are there."""

    source: DataFrame
    value: Column
    there: Column | None = None

    def map(self, f: Callable[[Column], Column]) -> Delayed:
        return replace(self, value=f(self.value))

    def filter(self, p: Callable[[Column], Column]) -> Delayed:
        own = p(self.value)
        return replace(self, there=own if self.there is None else self.there & own)

    def filter_op(self, f: Callable[[Column], Column]) -> Delayed:
        """Values of ``f`` where they are not null."""
        out = f(self.value)
        return replace(self, value=out, there=out.isNotNull() if self.there is None else self.there & out.isNotNull())

    def zip(self, *others: Column) -> Delayed:
        """With further values of the same positions, as one struct."""
        return replace(self, value=F.struct(self.value.alias("_0"), *[c.alias(f"_{i + 1}") for i, c in enumerate(others)]))

    def zip_with(self, f: Callable[..., Column], *others: Column) -> Delayed:
        return replace(self, value=f(self.value, *others))

    def enumerate(self) -> Delayed:
        return replace(self, value=F.struct(F.col("idx").alias("i"), self.value.alias("x")))

    def element(self, name: str) -> Delayed:
        """One component of struct values: keys, values or any other."""
        return replace(self, value=self.value[name])

    def rows(self) -> DataFrame:
        """(idx, x): still lazy; idx are the source's positions."""
        kept = self.source if self.there is None else self.source.where(self.there)
        return kept.select("idx", self.value.alias("x"))

    def flatten(self) -> DataFrame:
        """(idx, x) of array values, one after the other."""
        return sequence.flatten(self.rows().withColumnRenamed("x", "xs"))

    def reduce(self, monoid: str = "plus") -> DataFrame:
        """(total): the fold, in the same pass as all that was composed."""
        return sequence.reduce(self.rows(), monoid)

    def scan(self, monoid: str = "plus", inclusive: bool = False) -> DataFrame:
        return sequence.scan(self.rows(), monoid, inclusive)

    def to_sequence(self) -> DataFrame:
        """(idx, x), written and dense from 0."""
        out = sequence.dense(self.rows().withColumnRenamed("idx", "at"), ["at"]) if self.there is not None else self.rows()
        return stored(out.select("idx", "x"))

    def for_each(self, path: str) -> DataFrame:
        """Hands every value to a sink in one pass (text lines under ``path``) and returns what the sink holds."""
        self.rows().select(F.to_json(F.struct("idx", "x")).alias("value")).write.text(path)
        return self.source.sparkSession.read.text(path).select(F.from_json("value", self.rows().schema).alias("r")).select("r.*")


def delayed(seq: DataFrame) -> Delayed:
    """The values x of (idx, x)."""
    return Delayed(seq, F.col("x"))


def block_fold(seq: DataFrame, monoid: str = "plus", block: int = 1 << 10) -> DataFrame:
    """(block, total): the fold of each block of positions, which is what blocked iterators hand on."""
    return seq.groupBy(F.expr(f"idx div {block}").alias("block")).agg(MONOIDS[monoid][0]("x").cast("long").alias("total"))


def _of(name: str, sql: str):
    def add(f: Callable[[Delayed], DataFrame]):
        register(name, sql)(lambda spark, d: f(delayed(seq_of(spark, d))))

    return add


def _sink(x: Delayed) -> DataFrame:
    from ..tables import scratch

    return x.for_each(scratch(x.source.sparkSession))


_of("delayed_map", f"select idx, 3 * (x + 1) - 2 as x from {S}")(lambda x: x.map(lambda v: v + 1).map(lambda v: 3 * v).map(lambda v: v - 2).rows())
_of("delayed_filter", f"select idx, x from {S} where x % 2 = 0 and x > 100000")(lambda x: x.filter(lambda v: v % 2 == 0).filter(lambda v: v > 100000).rows())
_of("delayed_filter_op", f"select idx, x // 3 as x from {S} where x % 3 = 0 and (x // 3) % 2 = 1")(lambda x: x.filter_op(lambda v: F.when(v % 3 == 0, F.floor(v / 3))).filter(lambda v: v % 2 == 1).rows())
_of("delayed_flatten", f"select 2 * idx + j as idx, x * (1 - j) + idx * j as x from {S}, range(2) t(j)")(lambda x: x.map(lambda v: F.array(v, F.col("idx"))).flatten())
_of("delayed_scan", f"select idx, x % 7 as x, cast(coalesce(sum(x % 7) over (order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as prefix from {S}")(lambda x: x.map(lambda v: v % 7).scan())
_of("delayed_scan_inclusive", f"select idx, x % 7 as x, max(x % 7) over (order by idx) as prefix from {S}")(lambda x: x.map(lambda v: v % 7).scan("max", True))
_of("delayed_zip", f"select idx, x as a, idx * 2 as b, x % 5 as c from {S}")(lambda x: x.zip(F.col("idx") * 2, F.col("x") % 5).rows().select("idx", F.col("x._0").alias("a"), F.col("x._1").alias("b"), F.col("x._2").alias("c")))
_of("delayed_zip_with", f"select idx, x * idx + x % 5 as x from {S}")(lambda x: x.zip_with(lambda a, b, c: a * b + c, F.col("idx"), F.col("x") % 5).rows())
_of("delayed_enumerate", f"select idx as i, x from {S} where x > 200000")(lambda x: x.filter(lambda v: v > 200000).enumerate().rows().select("x.i", "x.x"))
_of("delayed_elements", f"select idx, x % 5 as x from {S}")(lambda x: x.zip(F.col("x") % 5).element("_1").rows())
_of("delayed_reduce", f"select cast(sum(x * x % 1009) as bigint) as total from {S} where x % 2 = 0")(lambda x: x.filter(lambda v: v % 2 == 0).map(lambda v: v * v % 1009).reduce())
_of("delayed_for_each", f"select idx, x + 1 as x from {S} where x % 4 = 0")(lambda x: _sink(x.filter(lambda v: v % 4 == 0).map(lambda v: v + 1)))
_of("delayed_to_sequence", f"select row_number() over (order by idx) - 1 as idx, 2 * x as x from {S} where x % 3 = 0")(lambda x: x.filter(lambda v: v % 3 == 0).map(lambda v: 2 * v).to_sequence())
_of("block_delayed", f"select idx // 1024 as block, cast(sum(x * 2) as bigint) as total from {S} where x % 2 = 1 group by 1")(lambda x: block_fold(x.filter(lambda v: v % 2 == 1).map(lambda v: v * 2).rows()))
