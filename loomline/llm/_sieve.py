"""A bit map of 64-bit values: what it lacks is surely not among them, what it has may be.

It spares shuffles what cannot find a partner, always in front of an exact join. The map holds 2**MOST bits at most, whatever the
table; a table for which that is too few has no sieve, and then everything goes to the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import U, mix

#: Bits of the largest map (32 MB), and of the piece of it that one task makes.
MOST, PIECE = 28, 20


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values.astype(np.int64).view(U) ^ U(0x3C6EF372FE94F82B)) >> U(64 - bits)).astype(np.int64)


def _place(bits: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(_slots(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(slot >> PIECE), pa.array(slot & ((1 << PIECE) - 1))], ["piece", "bit"])

    return go


def _fill(bits: int):
    def go(t: pa.Table) -> pa.Table:
        own = np.zeros(1 << min(bits, PIECE), bool)
        own[t.column("bit").to_numpy()] = True
        return pa.table({"piece": t.column("piece").slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    return go


class Sieve:
    def __init__(self, sent, bits: int) -> None:
        self.sent, self.bits = sent, bits

    def may(self, values: np.ndarray) -> np.ndarray:
        """Which of these may be in the table."""
        slot = _slots(values, self.bits)
        return (self.sent.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def sieve(values: DataFrame) -> Sieve | None:
    """The sieve of a table of one column of distinct numbers; None for more than half of 2**MOST."""
    n = values.count()
    bits = max(16, int(16 * max(n, 1)).bit_length())
    if n > 1 << (MOST - 1):
        return None
    bits = min(bits, MOST)
    size = 1 << min(bits, PIECE)
    pieces = values.mapInArrow(_place(bits), "piece long, bit long").groupBy("piece").applyInArrow(_fill(bits), "piece long, bits binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces:
        out[r["piece"] * size // 8 :][: size // 8] = np.frombuffer(r["bits"], np.uint8)
    return Sieve(values.sparkSession.sparkContext.broadcast(out), bits)


def may(s: Sieve | None, c: str) -> Column:
    """Whether a column's number may be in the sieve's table; without a sieve it always may."""
    if s is None:
        return F.lit(True)

    @F.arrow_udf("boolean")
    def held(x: pa.Array) -> pa.Array:
        return pa.array(s.may(x.to_numpy()))

    return held(F.col(c))
