"""Token windows over long token tables, and the merge of scores of overlapping windows.

A token table has one row ``(doc_id, i, ...)`` a token. Partition it by ``doc_id`` once: windows, merge and decoding all work within a document,
so they share that one exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_starts(n: Column, width: int, stride: int) -> Column:
    """Starts of windows of ``width`` tokens that overlap by ``stride``, the last one ending at ``n``; none for no tokens."""
    step = max(width - stride, 1)
    last = F.when(n <= width, 0).otherwise(F.ceil((n - width) / F.lit(float(step))).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.expr("cast(array() as array<int>)"))


def windows(docs: DataFrame, max_tokens: int, stride: int, n: str = "n_tokens", special: tuple[int, int] | None = None) -> DataFrame:
    """One row a window: ``token_start, token_end, offset`` beside the columns of ``docs``; with special tokens two places are theirs."""
    width = max_tokens - 2 if special else max_tokens
    w = docs.withColumn("token_start", F.explode(window_starts(F.col(n), width, stride)))
    return w.withColumn("token_end", F.least(F.col("token_start") + width, F.col(n)).cast("int")).withColumn("offset", F.lit(1 if special else 0))


def window_inputs(encoded: DataFrame, max_tokens: int, stride: int, ids: str = "ids", special: tuple[int, int] | None = None) -> DataFrame:
    """Windows with ``input_ids`` and ``attention_mask``, unpadded; ``ids`` is an ``ARRAY<BIGINT>`` column."""
    w = windows(encoded.withColumn("_n", F.size(ids)), max_tokens, stride, "_n", special).drop("_n")
    part = F.slice(F.col(ids), F.col("token_start") + 1, F.col("token_end") - F.col("token_start"))
    if special:
        part = F.concat(F.array(F.lit(special[0]).cast("bigint")), part, F.array(F.lit(special[1]).cast("bigint")))
    return w.withColumn("input_ids", part).withColumn("attention_mask", F.array_repeat(F.lit(1).cast("bigint"), F.size(part)))


def best_window(rows: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """Of rows ``(key, tok, token_start, token_end, value)``, per token the value of the window in which it lies farthest from an edge, the earliest at a tie.

    One aggregation that keeps one row a token; nothing is sorted.
    """
    distance = F.least(F.col("tok") - F.col("token_start"), F.col("token_end") - 1 - F.col("tok"))
    return rows.groupBy(key, "tok").agg(F.max_by(F.struct(F.col("token_start"), F.col(value)), F.struct(distance, -F.col("token_start"))).alias("b")).select(key, "tok", F.col("b.token_start").alias("token_start"), F.col(f"b.{value}").alias(value))


def position_rows(scored: DataFrame, logits: str = "logits", key: str = "doc_id") -> DataFrame:
    """Windows with ``ARRAY<ARRAY<DOUBLE>>`` logits, special positions included, as one row a token of a window."""
    n = F.col("token_end") - F.col("token_start")
    body = F.slice(F.col(logits), F.col("offset") + 1, n)
    checked = F.when(F.size(logits) == n + 2 * F.col("offset"), body).otherwise(F.raise_error(F.lit("scores do not fit their window")))
    return scored.select(key, "token_start", "token_end", F.posexplode(checked).alias("p", "z")).select(key, "token_start", "token_end", (F.col("token_start") + F.col("p")).alias("tok"), "z")


def merge_logits(scored: DataFrame, tokens: DataFrame, logits: str = "logits", key: str = "doc_id") -> DataFrame:
    """Every token's best row of scores; a token no window covers is an error."""
    best = best_window(position_rows(scored, logits, key), "z", key)
    j = tokens.join(best.drop("token_start"), [key, "tok"], "left")
    return j.withColumn("z", F.coalesce("z", F.raise_error(F.lit("a token is in no window")).cast("array<double>")))


def merge_predictions(scored: DataFrame, tokens: DataFrame, logits: str = "logits", key: str = "doc_id") -> DataFrame:
    """Every token's ``label`` and ``probability``; null where no window covers it."""
    from spanloom.operators.scoring import prediction

    best = best_window(position_rows(scored, logits, key), "z", key)
    p = prediction(F.col("z"))
    return tokens.join(best.select(key, "tok", p["label"].alias("label"), p["probability"].alias("probability")), [key, "tok"], "left")


def best_scores(ids: np.ndarray, score: Callable[[np.ndarray], np.ndarray], max_tokens: int, stride: int, special: tuple[int, int] | None = None) -> np.ndarray:
    """Windows, scores and ``best_window`` of one document: a row of scores a token; only one window's scores are held beside them."""
    n, width = len(ids), max_tokens - 2 if special else max_tokens
    step = max(width - stride, 1)
    out, far = None, np.full(n, -1)
    for at in range(0, max(n - width + step, 1), step):
        stop = min(at + width, n)
        if special:
            z = score(np.concatenate(([special[0]], ids[at:stop], [special[1]])))[1:-1]
        else:
            z = score(ids[at:stop].copy())
        if stop - at == n:
            return z
        if out is None:
            out = np.empty((n, z.shape[1]))
        place = np.arange(stop - at)
        distance = np.minimum(place, place[::-1])
        nearer = distance > far[at:stop]
        out[at:stop][nearer], far[at:stop][nearer] = z[nearer], distance[nearer]
    return out
