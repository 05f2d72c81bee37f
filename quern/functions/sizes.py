"""Sizes of index codes as Column expressions, so that no code has to be written to know its length.

The Elias-Fano sizes follow the published layout: low bits, unary high bits, and pointers sampled every 2**8 ones and 2**9 zeros.
Everything is integer arithmetic; no floating logarithm decides a bit width.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sampling rates, as powers of two, of pointers to zeros and ones and of ranks.
ZEROS, ONES, RANKS = 9, 8, 9
#: A rate that is never reached: strict sequences keep no pointers to zeros and no ranks.
NEVER = 63
#: Bits that name the chosen representation.
TYPE = 1
DISK_BLOCK = 4096
#: Units in which lists are read.
READ_UNITS = (4096, 8192, 16384, 32768, 65536)


def bit_length(x: Column) -> Column:
    """Number of binary digits; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0).cast("long")


def ceil_log2(x: Column) -> Column:
    return F.when(x > 1, bit_length(x - 1)).otherwise(0).cast("long")


def vbyte_bytes(x: Column) -> Column:
    """Bytes of seven bits."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(bit_length(x) / 7).cast("long"))


def gamma_bits(x: Column) -> Column:
    return 2 * (bit_length(x + 1) - 1) + 1


def delta_bits(x: Column) -> Column:
    low = bit_length(x + 1) - 1
    return gamma_bits(low) + low


def _over(x: Column, power: int) -> Column:
    return F.shiftright(x, power) if power < NEVER else F.lit(0).cast("long")


def elias_fano_bits(universe: Column, n: Column, zeros: int = ZEROS) -> Column:
    low = F.when(universe > n, bit_length(F.floor(universe / n)) - 1).otherwise(0)
    high = n + F.floor(universe / F.pow(F.lit(2.0), low)) + 2
    pointer = ceil_log2(high)
    return (_over(high - n, zeros) + _over(n, ONES)) * pointer + high + n * low


def ranked_bitvector_bits(universe: Column, n: Column, ranks: int = RANKS) -> Column:
    return _over(universe, ranks) * ceil_log2(n + 1) + _over(n, ONES) * ceil_log2(universe) + universe


def all_ones_bits(universe: Column, n: Column) -> Column:
    """Nothing, if every value below the universe is there; null otherwise."""
    return F.when(universe == n, F.lit(0).cast("long"))


def indexed_bits(universe: Column, n: Column) -> Column:
    """The cheapest representation of a weakly increasing sequence."""
    return F.coalesce(all_ones_bits(universe, n), F.least(elias_fano_bits(universe, n), ranked_bitvector_bits(universe, n)) + TYPE)


def strict_elias_fano_bits(universe: Column, n: Column, zeros: int = ZEROS) -> Column:
    return elias_fano_bits(universe - n + 1, n, zeros)


def strict_bits(universe: Column, n: Column) -> Column:
    """The cheapest representation of a strictly increasing sequence."""
    best = F.least(strict_elias_fano_bits(universe, n, NEVER), ranked_bitvector_bits(universe, n, NEVER))
    return F.coalesce(all_ones_bits(universe, n), best + TYPE)


def digits(x: np.ndarray) -> np.ndarray:
    """Binary digits of numbers below 2**53; 0 for 0."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def indexed_bits_of_all(universe: np.ndarray, n: np.ndarray) -> np.ndarray:
    """indexed_bits() of arrays, for the partitioner."""
    low = np.where(universe > n, digits(universe // n) - 1, 0)
    high = n + (universe >> low) + 2
    fano = (((high - n) >> ZEROS) + (n >> ONES)) * digits(high - 1) + high + n * low
    ranked = (universe >> RANKS) * digits(n) + (n >> ONES) * digits(universe - 1) + universe
    return np.where(universe == n, 0, np.minimum(fano, ranked) + TYPE)


def read_unit(length: Column, fixed: int | None = None) -> Column:
    """The smallest unit that holds a list, the largest one for longer lists, or always the fixed one."""
    if fixed:
        return F.lit(fixed).cast("long")
    out = F.lit(READ_UNITS[-1]).cast("long")
    for unit in reversed(READ_UNITS[:-1]):
        out = F.when(length <= unit, F.lit(unit).cast("long")).otherwise(out)
    return out
