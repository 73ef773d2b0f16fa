"""Bitsets of any width: arrays of longs, bit b in word b / 64.

A set has as many words as its greatest bit needs; words beyond its end hold
nothing, so sets of different lengths compare without padding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def bit(place: Column) -> Column:
    """The long with one bit set, ``place`` in 0..63."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def from_bits(bits: Column) -> Column:
    """The set of an array of bit numbers; empty for an empty array.  A null or negative number is an error."""
    checked = F.transform(bits, lambda b: F.when(b.isNull() | (b < 0), F.raise_error(F.lit("a bit number is missing or negative")).cast("int")).otherwise(b.cast("int")))
    words = F.sequence(F.lit(0), F.floor(F.array_max(checked) / WORD).cast("int"))

    def word(w: Column) -> Column:
        inside = F.filter(checked, lambda b: F.floor(b / WORD) == w)
        return F.aggregate(inside, F.lit(0).cast("long"), lambda held, b: held.bitwiseOR(bit(b % WORD)))

    return F.when(F.size(bits) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def gathered(number: Column) -> Column:
    """Aggregate: the set of the bit numbers of a group; nulls don't count."""
    return from_bits(F.collect_set(number))


def has(held: Column, number: Column) -> Column:
    """Does the set hold the bit?"""
    word = F.coalesce(F.get(held, F.floor(number / WORD).cast("int")), F.lit(0).cast("long"))
    return word.bitwiseAND(bit(number % WORD)) != 0


def union(a: Column, b: Column) -> Column:
    nothing = F.lit(0).cast("long")
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, nothing).bitwiseOR(F.coalesce(y, nothing)))


def overlaps(a: Column, b: Column) -> Column:
    """Do the sets share a bit?"""
    return F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(x.bitwiseAND(y) != 0, F.lit(False))), lambda shared: shared)


def count(held: Column) -> Column:
    return F.aggregate(held, F.lit(0), lambda n, word: n + F.bit_count(word))
