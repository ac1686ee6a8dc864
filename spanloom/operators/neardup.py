"""Texts close to a held-out set by the ratio of matching characters (``2 M / (len a + len b)`` of the longest-block matcher).

The held-out side is the stated query set: it is broadcast in blocks of bounded size, and every row meets it in the workers, in one scan, behind three upper
bounds, each cheaper than the next: lengths, character histograms (one matrix a batch), and the bit-parallel longest common subsequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import norm
from spanloom.session import ship

BLOCK_ROWS = 5_000
_HISTOGRAMS: dict[int, np.ndarray] = {}
CELLS = 96  # characters are counted in so many cells by code, which keeps the bound an upper one


def histogram(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), CELLS), dtype=np.int32)
    for i, t in enumerate(texts):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % CELLS, 1)
    return out


def reaches(masks: dict[str, int], n: int, b: str, least: float) -> bool:
    """Whether the longest common subsequence of a text given by its character masks and ``b`` reaches ``least``; stops once it can't."""
    full = (1 << n) - 1
    s = full
    for at in range(0, len(b), 32):
        if n - s.bit_count() + len(b) - at < least:
            return False
        for c in b[at : at + 32]:
            u = s & masks.get(c, 0)
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count() >= least


def masks_of(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def close_pairs(texts: list[str], held: list[str], held_hist: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
    n_held = np.array([len(h) for h in held])
    for i, (t, h) in enumerate(zip(texts, histogram(texts))):
        if not t:
            continue
        total = n_held + len(t)
        fits = 2 * np.minimum(n_held, len(t)) >= least * total
        at = np.flatnonzero(fits)
        at = at[2 * np.minimum(held_hist[at], h).sum(axis=1) >= least * total[at]]
        if not len(at):
            continue
        masks = masks_of(t)
        for k in at:
            if reaches(masks, len(t), held[k], least * float(total[k]) / 2):
                r = SequenceMatcher(None, t, held[k]).ratio()
                if r >= least:
                    yield i, int(k), r


def close_to(rows: DataFrame, held: DataFrame, key: str = "id", text: str = "instruction", held_key: str = "id", held_text: str = "instruction", least: float = 0.8) -> DataFrame:
    """``(key, held_key, ratio)``, ratio of six places, of rows whose normalised text is close to a held-out one. Null and wordless texts have none; repeated rows count once."""
    spark = rows.sparkSession
    ship(spark)
    h = held.select(F.col(held_key).cast("string").alias("k"), norm(held_text).alias("t")).where("t <> ''").distinct()
    blocks = max(1, -(-h.count() // BLOCK_ROWS))
    src = rows.select(key, norm(text).alias("t")).where("t <> ''").distinct()
    src = src.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # the work is in the workers, not in the bytes
    kind = rows.schema[key].dataType.simpleString()
    held_blocks = []
    for k in range(blocks):  # the driver holds one block at a time
        part = h.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == k).collect()
        held_blocks.append(spark.sparkContext.broadcast(([r[0] for r in part], [r[1] for r in part])))

    names = [b._jbroadcast.id() for b in held_blocks]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One scan of the rows, however many blocks there are."""
        for b in batches:
            own, texts = list(b[key]), list(b["t"])
            for k, block in enumerate(held_blocks):
                keys, held_texts = block.value
                if names[k] not in _HISTOGRAMS:
                    _HISTOGRAMS[names[k]] = histogram(held_texts)
                rows_ = [(own[i], keys[j], round(r, 6)) for i, j, r in close_pairs(texts, held_texts, _HISTOGRAMS[names[k]], least)]
                yield pd.DataFrame(rows_, columns=["a", "b", "ratio"])

    found = src.mapInPandas(run, f"a {kind}, b string, ratio double")
    return found.select(F.col("a").alias(key), F.col("b").alias(f"held_{held_key}"), "ratio")
