"""Mixtures with target shares by a multivariate-hypergeometric splitting tree.

A source's documents fall into ``blocks`` blocks by a hash of their id. A source's goal is its share of all tokens, but at most its tokens
times ``max_repeats``; whole passes over it are taken first, then blocks in a permuted order until the goal is met most nearly. That gives
every source an exact quota of block uses. A binary tree splits the quotas among output shards by multivariate-hypergeometric draws, so each
shard is a fair sample of the whole mixture, and a shard takes the next positions of each source's permuted sequence: no two shards share a
block use. Inside a shard rows are ordered by ``shuffle_key``.

The driver holds one number a block: at most ``MAX_SOURCES`` times ``blocks`` of them. Documents without a source (null or blank) and
sources without a target stay out of the mixture; those of the latter count in the total. A null ``max_repeats`` is 1, a null share 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import count_tokens
from spanloom.session import cut

MAX_SOURCES = 256
PLAN_ROW, PLAN_BYTES = 64, 64 << 20  # bytes of a row of the plan at most, and of a plan that is broadcast


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Row a shard, column a source; columns add up to ``quotas`` and rows to equal totals, give or take one."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    total = int(quotas.sum())
    left = rng.multivariate_hypergeometric(quotas, total * half // shards, method="marginals")
    return np.vstack([split_quotas(left, half, rng), split_quotas(quotas - left, shards - half, rng)])


def block_uses(tokens: np.ndarray, goal: float, most: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """``(block, pass)`` in order: whole passes, each newly permuted, then a part of one whose end lies nearest to the goal."""
    live = np.flatnonzero(tokens >= 0)
    total, out = int(tokens[live].sum()), []
    if total == 0 or goal <= 0:
        return out
    whole = min(most, int(goal // total))
    for k in range(whole):
        out += [(int(b), k) for b in rng.permutation(live)]
    if whole < most:
        order = rng.permutation(live)
        sums = np.concatenate([[0], np.cumsum(tokens[order])])
        n = int(np.abs(sums - (goal - whole * total)).argmin())
        out += [(int(b), whole) for b in order[:n]]
    return out


@dataclass
class Mixture:
    rows: DataFrame  # doc_id, source, pass_no, shard, shuffle_key, n_tokens
    shares: DataFrame  # source, target_share, max_repeats, source_tokens, goal_tokens, mixed_tokens, actual_share, short


def mix(docs: DataFrame, targets: DataFrame, vocab: DataFrame, shards: int = 64, blocks: int = 1024, seed: int = 7) -> Mixture:
    spark = docs.sparkSession
    rng = np.random.default_rng(seed)
    label = lambda c: F.lower(F.trim(F.col(c)))
    d = docs.select("doc_id", label("source").alias("source"), "text").where("source <> ''")
    d = count_tokens(d, vocab).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("int"))
    d = cut(d)
    want = targets.groupBy(label("source").alias("source")).agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most")).where("source <> ''")
    wanted = sorted(map(tuple, want.limit(MAX_SOURCES + 1).collect()))
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    total = d.agg(F.sum("n_tokens")).first()[0] or 0
    sums = d.join(F.broadcast(want.select("source")), "source").groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect()
    by = {s: np.full(blocks, -1, dtype=np.int64) for s, _, _ in wanted}  # -1: no document
    for s, b, n in sums:
        by[s][b] = n
    uses, shares = [], []
    for s, share, most in wanted:
        t = by[s]
        size = int(np.maximum(t, 0).sum())
        goal = min(share * total, float(size * most))
        use = block_uses(t, goal, most, rng)
        uses.append(use)
        shares.append((s, share, most, size, goal, int(sum(t[b] for b, _ in use)), bool(size * most < share * total)))
    mixed = sum(x[5] for x in shares)
    share_rows = [(*x[:6], x[5] / mixed if mixed else 0.0, x[6]) for x in shares]
    out = spark.createDataFrame(share_rows, "source string, target_share double, max_repeats int, source_tokens bigint, goal_tokens double, mixed_tokens bigint, actual_share double, short boolean")
    parts = split_quotas(np.array([len(u) for u in uses] or [0]), shards, rng)
    ends = np.cumsum(parts, axis=0)
    plan = [(wanted[i][0], b, k, int(np.searchsorted(ends[:, i], at, "right"))) for i, u in enumerate(uses) for at, (b, k) in enumerate(u)]
    longest = max([0, *(len(s.encode()) for s, _, _ in wanted)])
    p = spark.createDataFrame(plan, "source string, block int, pass_no int, shard int")  # at most MAX_SOURCES x blocks x repeats rows
    rows = d.join(F.broadcast(p) if len(plan) * (PLAN_ROW + longest) <= PLAN_BYTES else p, ["source", "block"])
    rows = rows.select("doc_id", "source", "pass_no", "shard", F.xxhash64("doc_id", "pass_no", F.lit(seed)).alias("shuffle_key"), "n_tokens")
    return Mixture(rows, out)
