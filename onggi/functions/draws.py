"""Keyed uniform draws: the same for a row wherever it is computed, and in any order.

One hash per row and stage gives a base; the draw of a position is a fixed function of both. All values are integers
below MODULUS, so a comparison with a probability is exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2_147_483_647
STEP, STREAM, MULTIPLIER = 1_103_515_245, 362_436_069, 69_621


def base(seed: int, *key: Column | str) -> Column:
    """The base of a row: 32 bits of the hash of its key."""
    parts = [F.lit(str(seed)), *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint") % MODULUS


def draw(base: Column, position: Column, stream: int) -> Column:
    """An integer in [0, MODULUS) for one position; another stream is another draw."""
    x = (base + (position.cast("bigint") + 1) * STEP % MODULUS + F.lit(stream * STREAM % MODULUS)) % MODULUS
    return x * x % MODULUS * MULTIPLIER % MODULUS


def below(p: float) -> int:
    """The threshold of a probability."""
    return int(p * MODULUS)


def choice(d: Column, n: int) -> Column:
    """A draw as an index below n."""
    return F.floor(d * n / MODULUS).cast("int")
