"""Random numbers from a counter and a seed, alike in numpy, in Spark columns and in SQL.

The generator is a keyed permutation of the numbers below the prime 2^31 - 1: rounds of adding a key and taking the fifth
power (5 divides no factor of the group's order, so the power can be undone and no two counters give one number). All
steps fit in 64 bits with sign, so every engine computes the same.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column

from bandnet.functions.columns import key_hash, let

PRIME = 2**31 - 1
ROUNDS = 4


def round_keys(seed: int) -> list[int]:
    """A key below the prime for every round, from any integer seed."""
    state, keys = seed & 0xFFFFFFFFFFFFFFFF, []
    for _ in range(ROUNDS):
        state = (state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        keys.append((state >> 32) % PRIME)
    return keys


def _permuted(start: Any, seed: int, hold: Callable[[Any, Callable[[Any], Any]], Any]) -> Any:
    """The rounds over any numbers that add, multiply and leave remainders; ``hold`` names a value used several times."""
    value = start
    for key in round_keys(seed):
        value = hold((value + key) % PRIME, lambda x: hold(x * x % PRIME, lambda square: (square * square) % PRIME * x % PRIME))
    return value


def permuted_array(counter: np.ndarray, seed: int) -> np.ndarray:
    """A number below the prime for every counter."""
    return _permuted(np.asarray(counter, dtype=np.int64) % PRIME, seed, lambda value, body: body(value))


def uniform_array(counter: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for every counter."""
    return (permuted_array(counter, seed) + 0.5) / PRIME


def permuted_column(counter: Column, seed: int) -> Column:
    """``permuted_array`` as an expression over a column of whole numbers that are not negative."""
    return _permuted(counter.cast("bigint") % PRIME, seed, let)


def uniform_column(counter: Column, seed: int) -> Column:
    """``uniform_array`` as an expression."""
    return (permuted_column(counter, seed) + 0.5) / PRIME


def row_counter(key: Column | str) -> Column:
    """A counter below the prime for a row, from its key alone; a null key is an error."""
    return key_hash(key, "sample") % PRIME


def sampled_column(counter: Column, fraction: float, seed: int) -> Column:
    """Whether a row with this counter is in the sample of ``seed``."""
    return permuted_column(counter, seed) < sample_limit(fraction)


def sampled_array(counter: np.ndarray, fraction: float, seed: int) -> np.ndarray:
    """``sampled_column`` for numpy."""
    return permuted_array(counter, seed) < sample_limit(fraction)


def sample_limit(fraction: float) -> int:
    """Numbers of the generator below this are in a sample."""
    return round(fraction * PRIME)
