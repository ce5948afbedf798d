"""Bitmaps of a fixed size that tell which keys may belong to a set.

A sieve has one bit for each of ``2^bits`` slots and is built by aggregation.  Its size
does not follow the data, so it may always be broadcast.  A key outside the
set can share a slot with one inside: what passes is a superset, and the step after it
decides exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import shuffles_go

#: Bits in one row of a sieve, the width of Spark's bitmap functions.
ROW = 32768


def slots(keys: Column, bits: int) -> Column:
    return F.pmod(keys, F.lit(1 << bits))


def sieve(keys: DataFrame, bits: int) -> DataFrame:
    """(part, mask) of the 64-bit ``key`` column: 2^bits / 32768 rows of 4 KB at most."""
    slot = slots(F.col("key"), bits)
    return keys.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot % ROW).alias("mask"))


def marked(df: DataFrame, key: Column, passing: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with whether ``key`` may be in the sieve; the sieve is broadcast, for its size is fixed."""
    slot = slots(key, bits)
    found = df.withColumn("_slot", slot).join(F.broadcast(passing), F.shiftright("_slot", 15) == F.col("part"), "left")
    place = (F.col("_slot") % ROW).cast("int")
    byte = F.conv(F.hex(F.substring("mask", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn(name, F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))).drop("_slot", "part", "mask")


def as_array(passing: DataFrame, bits: int) -> np.ndarray:
    """The whole sieve as 2^bits / 8 bytes."""
    out = np.zeros((1 << bits) >> 3, np.uint8)
    with shuffles_go(passing.sparkSession):
        rows = passing.collect()
    for row in rows:
        at = row["part"] * (ROW >> 3)
        out[at : at + (ROW >> 3)] = np.frombuffer(row["mask"], np.uint8)
    return out


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit keys may be in the sieve."""
    slot = (keys & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1) > 0


#: Counted keys held by a task before it hands them on.
HELD = 2_500_000


class Tally:
    """Counts by key, added up inside a task; parts are merged when they are many."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        # parts are let go as soon as they are joined, so that no more than four arrays are held at once
        keys, self.keys = np.concatenate(self.keys), []
        order = np.argsort(keys)
        keys = keys[order]
        counts, self.counts = np.concatenate(self.counts), []
        counts = counts[order]
        del order
        if len(keys):
            first = np.append(True, keys[1:] != keys[:-1])
            counts = np.add.reduceat(counts, np.flatnonzero(first))
            keys = keys[first]
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return keys, counts

    def full(self) -> bool:
        return self.size > HELD * 8 // 5 and len(self.total()[0]) > HELD

    def handed_on(self) -> pa.RecordBatch:
        keys, counts = self.total()
        self.__init__()
        return pa.record_batch({"key": keys.view(np.int64), "n": counts})


def tallied(keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that hands on (key, n), the sums of the unsigned 64-bit keys that ``keys_of`` makes of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for keys in keys_of(batches):
            held.add(keys)
            if held.full():
                yield held.handed_on()
        yield held.handed_on()

    return run


def key_counts(rows: DataFrame, keys_of) -> DataFrame:
    """(key, n) over all rows."""
    return rows.mapInArrow(tallied(keys_of), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
