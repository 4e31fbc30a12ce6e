"""The 32-bit string hash and the xorshift generator of seeded statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash's start, the mask of 32 bits, what a seed is combined with.
START, MASK, SALT = 5381, 0xFFFFFFFF, 0xDEADBEEF
BLOCK = 64


def string_seed(text: Column) -> Column:
    """h = (h * 33) xor character, kept to 32 bits, over the characters of the text."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(START).cast("long"), lambda h, c: (h * 33).bitwiseAND(F.lit(MASK)).bitwiseXOR(F.ascii(c).cast("long")))


def _int(x: Column) -> Column:
    """Unsigned 32 bits as a signed int."""
    return F.when(x >= 2**31, x - 2**32).otherwise(x).cast("int")


def _next(s: Column) -> Column:
    s = s.bitwiseXOR(F.shiftleft(s, 13))
    s = s.bitwiseXOR(F.shiftright(s, 17))
    return s.bitwiseXOR(F.shiftleft(s, 5))


def draws(seed: Column, n: int) -> Column:
    """The first n draws of the generator for a seed, as an array of doubles in 0..1.

    States are gathered in blocks, so that appending copies no more than a block.
    """
    last = lambda states: F.get(states, F.size(states) - 1)
    many = min(n, BLOCK)
    start = _int(seed.bitwiseXOR(F.lit(SALT)).bitwiseAND(F.lit(MASK)))
    block = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(many)), F.array(s), lambda acc, _: F.array_append(acc, _next(last(acc))), lambda acc: F.slice(acc, 2, many))
    blocks = F.aggregate(F.sequence(F.lit(1), F.lit(-(-n // many))), F.array(F.array(start)), lambda acc, _: F.array_append(acc, block(last(last(acc)))), lambda acc: F.flatten(F.slice(acc, 2, -(-n // many))))
    return F.transform(F.slice(blocks, 1, n), lambda s: s.cast("long").bitwiseAND(F.lit(MASK)).cast("double") / F.lit(float(MASK)))
