"""Bitmaps of the numbers in a column, of a bounded size, for dropping rows that can't match before they are shuffled."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.tokens import Shared

P = np.uint64(0x9E3779B97F4A7C15)
CHUNK, CHUNK_BYTES = 512, 8 << 20  # texts at once, fewer where they are long
LEAST_BITS, MOST_BITS = 20, 29  # of a bitmap: at most 64 MB
BLOCK = 16  # bits of a place within a block of it


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = max(1, min(CHUNK, CHUNK_BYTES * b.num_rows // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


class Bitmap:
    """Which numbers of a column are there, but for some that aren't; a bitmap of at most ``MOST_BITS``, sized by the numbers expected."""

    def __init__(self, df: DataFrame, column: str, expected: int, numbers: Callable[[pa.RecordBatch], np.ndarray] | None = None):
        self.bits = int(min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(expected, 1))))))
        bits = self.bits

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def rows() -> pa.RecordBatch:
                at = np.unique(np.concatenate(held))
                first = np.flatnonzero(np.diff(at >> BLOCK, prepend=-1))
                ends = np.append(first[1:], len(at))
                step = np.diff(at, prepend=0)
                step[first] = at[first] & (1 << BLOCK) - 1
                low, high = step.astype(np.uint8), (step >> 8).astype(np.uint8)  # apart, as the high bytes are nearly all 0 and pack well
                return pa.RecordBatch.from_arrays([pa.array(at[first] >> BLOCK), pa.array([low[a:b].tobytes() + high[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["k", "at"])

            for b in chunks(batches):
                held.append(np.unique(self.place(numbers(b) if numbers else b.column(0).to_numpy(zero_copy_only=False))))
                if sum(map(len, held)) > 1 << 22:
                    yield rows()
                    held.clear()
            if held:
                yield rows()

        def block(g: pa.Table) -> pa.Table:
            """A task gives at most 2^BLOCK places to a block."""
            there = np.zeros(1 << BLOCK, dtype=np.uint8)
            for x in g.column("at").to_pylist():
                low, high = np.frombuffer(x, dtype=np.uint8).reshape(2, -1).astype(np.int64)
                there[np.cumsum(high << 8 | low)] = 1
            return pa.table({"k": g.column("k")[:1], "bits": [np.packbits(there).tobytes()]})

        found = (df if numbers else df.select(column)).mapInArrow(places, "k bigint, at binary").groupBy("k").applyInArrow(block, "k bigint, bits binary").collect()
        all_ = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for k, x in found:
            all_[k << (BLOCK - 3) : (k + 1) << (BLOCK - 3)] = np.frombuffer(x, dtype=np.uint8)
        self.shared = Shared(df.sparkSession, all_)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "shared": getattr(self, "shared", None)}

    def place(self, g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((g.view(np.uint64) * P) >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, g: np.ndarray) -> np.ndarray:
        at = self.place(g)
        return self.shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def slot_counts(df: DataFrame, bits: int, slots_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often each of ``2^bits`` slots comes up in the rows of ``df``. A task sends its counts as ``2^bits >> BLOCK`` rows or a few more."""
    width = min(1 << bits, 1 << 10)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, dtype=np.int64)
        for b in chunks(batches):
            n += np.bincount(slots_of(b), minlength=1 << bits)
        parts = n.reshape(-1, width)
        k = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([parts[i].tobytes() for i in k], pa.binary())], names=["k", "n"])

    def summed(g: pa.Table) -> pa.Table:
        return pa.table({"k": g.column("k")[:1], "n": [sum(np.frombuffer(x, dtype=np.int64) for x in g.column("n").to_pylist()).tobytes()]})

    out = np.zeros((max(1, (1 << bits) // width), width), dtype=np.int64)
    for k, n in df.mapInArrow(counted, "k bigint, n binary").groupBy("k").applyInArrow(summed, "k bigint, n binary").collect():
        out[k] = np.frombuffer(n, dtype=np.int64)
    return out.reshape(-1)
