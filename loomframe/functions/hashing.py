"""Counter-based randomness: a number's reproducible 62-bit value, from arithmetic that any SQL engine has.

Two remainders of the key go through squarings and multiplications modulo a prime;
no product exceeds 63 bits, so engines that check for overflow give the same values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The greatest primes below 2**31, an odd number for folding keys, and the multipliers of the rounds.
_P, _Q, _FOLD, _A, _B = 2147483647, 2147483629, 1000003, 1103515245, 69621


class Sql:
    """A bigint expression as text, with the operators that the rounds use."""

    def __init__(self, text: object):
        self.text = str(text)

    def __add__(self, other):
        return Sql(f"({self.text} + {Sql(other).text})")

    def __mul__(self, other):
        return Sql(f"({self.text} * {Sql(other).text})")

    def __mod__(self, other):
        return Sql(f"({self.text} % {Sql(other).text})")

    def __str__(self) -> str:
        return self.text


def _rounds(x, seed: int):
    one, two = (x % _P + _P) % _P, (x % _Q + _Q) % _Q
    b = (one * _A + two + seed * 7919 + 12345) % _P
    c = (b * b + two) % _P
    d = (c * _B + b) % _P
    return ((d * d + c) % _P) * (_P + 1) + d


def hashed(*keys: Column, seed: int = 0) -> Column:
    """In [0, 2**62); several keys are folded into one first, so they must be well below 2**40."""
    return _rounds(reduce(lambda a, b: a * _FOLD + b, [k.cast("long") for k in keys]), seed)


def hashed_sql(*keys: str, seed: int = 0) -> str:
    """The same in SQL."""
    return str(_rounds(reduce(lambda a, b: a * _FOLD + b, [Sql(f"cast({k} as bigint)") for k in keys]), seed))


def uniform(*keys: Column, seed: int = 0) -> Column:
    """In [0, 1)."""
    return (hashed(*keys, seed=seed) % (1 << 53)) / F.lit(float(1 << 53))


def uniform_sql(*keys: str, seed: int = 0) -> str:
    return f"(cast({hashed_sql(*keys, seed=seed)} % {1 << 53} as double) / {float(1 << 53)!r}e0)".replace(".0e0", "e0")
