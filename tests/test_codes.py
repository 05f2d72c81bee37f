"""Codes there and back, and sizes against codes and arithmetic."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import sizes
from quern.functions.codecs import CODECS, Bits, coded, decoded

U32 = st.lists(st.integers(0, 2**32 - 1), max_size=128)


@pytest.mark.parametrize("name", sorted(CODECS))
@pytest.mark.parametrize("n", [0, 1, 16, 127, 128])
@pytest.mark.parametrize("top", [1, 2, 1 << 7, 1 << 24, 1 << 32])
def test_blocks(name, n, top):
    rng = random.Random(n * 31 + top)
    values = [rng.randrange(top) for _ in range(n)]
    codec = CODECS[name]
    assert codec.decode(codec.encode(values), n) == values


@pytest.mark.parametrize("name", sorted(CODECS))
@settings(max_examples=60, deadline=None)
@given(values=U32)
def test_any_block(name, values):
    codec = CODECS[name]
    assert codec.decode(codec.encode(values), len(values)) == values


def test_bits():
    bits = Bits()
    bits.put(5, 3)
    bits.put(0, 4)
    bits.put(1, 1)
    back = Bits(bits.bytes())
    assert back.take(3) == 5 and back.zeros() == 4


def test_udfs(spark):
    df = spark.createDataFrame([(1, [3, 0, 70000]), (2, []), (3, None)], "id int, v array<long>")
    for name in CODECS:
        got = df.select("id", decoded(coded(F.col("v"), name), F.coalesce(F.size("v"), F.lit(0)), name).alias("v")).orderBy("id").collect()
        assert [r.v for r in got] == [[3, 0, 70000], [], None]


def test_lengths(spark):
    numbers = sorted({0, 1, 2, 3, 127, 128, 129, 255, 256, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**32 - 1, *(random.Random(1).randrange(2**32) for _ in range(50))})
    x = F.col("x")
    got = spark.createDataFrame([(n,) for n in numbers], "x long").select("x", sizes.vbyte_bytes(x), sizes.gamma_bits(x), sizes.delta_bits(x), sizes.ceil_log2(x), sizes.read_unit(x), sizes.read_unit(x, 65536)).collect()
    for n, vbyte, gamma, delta, log, unit, fixed in got:
        assert vbyte == len(CODECS["vbyte"].encode([n]))
        assert -(-gamma // 8) == len(CODECS["gamma"].encode([n])) and -(-delta // 8) == len(CODECS["delta"].encode([n]))
        assert log == (max(n, 1) - 1).bit_length()
        assert unit == next((u for u in sizes.READ_UNITS if n <= u), 65536) and fixed == 65536


def test_sequence_sizes_agree_with_plain_arithmetic(spark):
    pairs = [(u, n) for u in (1, 2, 10, 511, 512, 513, 20000, 1 << 20) for n in (1, 2, 7, 255, 256, 300, 20000) if n <= u]
    got = spark.createDataFrame(pairs, "u long, n long").select("u", "n", sizes.indexed_bits(F.col("u"), F.col("n")).cast("long"), sizes.strict_bits(F.col("u"), F.col("n")).cast("long")).collect()
    for u, n, indexed, strict in got:
        assert indexed == sizes.indexed_bits_of_all(np.array([u]), np.array([n]))[0]
        assert (strict == 0) == (u == n)
