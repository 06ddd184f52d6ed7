"""Blocked Bloom filters over 64-bit keys: built by a Spark aggregation, probed in numpy.

A block is one 64-bit word, so a probe reads one place.  A filter has no misses; what it lets
through in error is removed by the exact step that follows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
#: Random odd numbers that spread keys; any would do.
_SPREAD = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; equal numbers stay equal."""
    h = (h ^ (h >> _U(32))) * _SPREAD[0]
    h = (h ^ (h >> _U(29))) * _SPREAD[1]
    return h ^ (h >> _U(32))


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64."""
    out = np.full(max(n, 1), base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def bits(keys: np.ndarray) -> np.ndarray:
    """Six bits of a block for each key, from its low 36 bits."""
    out = np.zeros(keys.shape, _U)
    for k in range(6):
        out |= _U(1) << ((keys >> _U(6 * k)) & _U(63))
    return out


def place(keys: np.ndarray, blocks) -> np.ndarray:
    """Which of a power of two of blocks each key has, from bits that ``bits`` leaves alone."""
    return (keys >> _U(36)) & (blocks - _U(1))


def blocks_for(n: int, most: int, least: int = 1024) -> int:
    """A power of two of blocks, 32 bits or more for each of n keys unless ``most`` blocks are reached."""
    return min(most, max(least, 1 << max(0, (n // 2)).bit_length()))


def built(keys: DataFrame, blocks: int) -> np.ndarray:
    """The filter of a column ``key``; at most ``blocks`` rows come to the driver."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = batch["key"].to_numpy().view(_U)
            yield pd.DataFrame({"block": place(key, _U(blocks)).view(np.int64), "mask": bits(key).view(np.int64)})

    rows = keys.mapInPandas(task, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(blocks, _U)
    out[rows["block"].to_numpy()] = rows["mask"].to_numpy().view(_U)
    return out


def held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    want = bits(keys)
    return (table[place(keys, _U(len(table))).view(np.int64)] & want) == want
