"""Documents into containers of fixed token capacity: minimum bin slack over the histogram of lengths.

How many documents there are doesn't matter to the plan, only how many have each length, and there are at most ``capacity`` lengths. The
driver therefore holds a histogram of at most ``capacity + 1`` numbers. It takes the longest remaining length, finds by a bitset subset-sum
over the remaining multiset the filling that comes closest to the capacity, reads the counts back from the kept bitsets, and uses that
pattern as often as the counts allow. Documents then get their rank among those of their length, from which container follows by arithmetic.

Null and blank texts have 0 tokens and go to container 0. A document larger than the capacity is cut at word ends into pieces of at most the
capacity (inside a word only when the word alone is larger), and only such a document is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import WORD, Costs, Shared, costs_of, vocabulary
from spanloom.session import cut


def word_prefix(costs: Costs, word: str, budget: int) -> int:
    """Length of the longest prefix of at most ``budget`` pieces that ends where a piece ends; at least one character."""
    at, n = 0, 0
    while at < len(word) and n < budget:
        known = costs.rest if at else costs.first
        for end in range(min(len(word), at + costs.longest), at, -1):
            if word[at:end] in known:
                break
        else:
            return max(at, 1)
        at, n = end, n + 1
    return max(at, 1)


def word_table(costs: Costs, text: str, budget: int) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and costs of the words; a word over ``budget`` is given in parts within it. Offsets are those of ``text``."""
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer: keep offsets by lowering one by one
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts, ends, sizes = [], [], []
    for m in WORD.finditer(low):
        w, a, b = m.group(), m.start(), m.end()
        n = costs[w]
        while n > budget:
            k = word_prefix(costs, w, budget)
            starts.append(a)
            ends.append(a + k)
            sizes.append(min(costs[w[:k]], budget))
            a, w = a + k, w[k:]
            n = costs[w] if w else 0
        if a < b:
            starts.append(a)
            ends.append(b)
            sizes.append(n)
    return starts, ends, sizes


def units(docs: DataFrame, vocab: DataFrame, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document, or one a piece of a document over the capacity: ``(key, piece_no, start_char, end_char, n_tokens)``."""
    shared = Shared(docs.sparkSession, vocabulary(vocab))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = costs_of(shared)
        for b in batches:
            take, rows = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                n = costs.count(x)
                if n <= capacity:
                    take.append(i)
                    rows.append((0, 0, len(x or ""), n))
                    continue
                starts, ends, sizes = word_table(costs, x, capacity)
                first, used, k = 0, 0, 0
                for j in range(len(sizes) + 1):
                    if j == len(sizes) or used + sizes[j] > capacity:
                        take.append(i)
                        rows.append((k, starts[first] if k else 0, ends[j - 1] if j < len(sizes) else len(x), used))
                        first, used, k = j, 0, k + 1
                    if j < len(sizes):
                        used += sizes[j]
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[key, "piece_no", "start_char", "end_char", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece_no int, start_char int, end_char int, n_tokens bigint")


def filling(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length of the multiset and, beside it, the lengths whose sum comes closest to the capacity."""
    longest = max(left)
    room = capacity - longest
    keep = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted(left, reverse=True):
        have = min(left[size] - (size == longest), room // size)
        times = 1
        while have > 0 and not reach >> room & 1:
            k = min(times, have)
            steps.append((size, k, reach))
            reach |= reach << size * k & keep
            have, times = have - k, times * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {longest: 1}
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + k
            at -= size * k
    return used


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """``(length, first_rank, end_rank, first_container, per_container)`` rows and the number of containers."""
    left = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    rank = dict.fromkeys(left, 0)
    rows, containers = [], 0
    while left:
        used = filling(left, capacity)
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            rows.append((n, rank[n], rank[n] + k * times, containers, k))
            rank[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        containers += times
    return rows, containers


def pack(docs: DataFrame, vocab: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", per_bucket: int = 1_000_000) -> DataFrame:
    """``(key, piece_no, start_char, end_char, n_tokens, container_id)``. Hot lengths are ranked in buckets of about ``per_bucket`` rows."""
    spark = docs.sparkSession
    u = cut(units(docs, vocab, capacity, key, text))
    histogram = {r[0]: r[1] for r in u.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    rows, _ = plan(histogram, capacity)
    by: dict[int, list] = {}
    for n, a, _, base, k in rows:
        by.setdefault(n, []).append((a, base, k))
    table = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for n, v in by.items()}
    shared = spark.sparkContext.broadcast(table)
    buckets = spark.createDataFrame([(n, max(1, -(-c // per_bucket))) for n, c in histogram.items()] or [(0, 1)], "n_tokens bigint, parts bigint")
    b = u.join(F.broadcast(buckets), "n_tokens").withColumn("part", F.pmod(F.xxhash64(key, "piece_no"), F.col("parts")))
    base = b.groupBy("n_tokens", "part").count()
    base = base.selectExpr("n_tokens", "part", "sum(count) over (partition by n_tokens order by part rows between unbounded preceding and 1 preceding) before")
    ranked = b.selectExpr("*", f"row_number() over (partition by n_tokens, part order by `{key}`, piece_no) - 1 r")
    ranked = ranked.join(base, ["n_tokens", "part"]).selectExpr(f"`{key}`", "piece_no", "start_char", "end_char", "n_tokens", "r + coalesce(before, 0) as rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, rank = x.column(4).to_numpy(), x.column(5).to_numpy()
            out = np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                if length in shared.value:
                    at = n == length
                    first, container, k = shared.value[length]
                    i = np.searchsorted(first, rank[at], "right") - 1
                    out[at] = container[i] + (rank[at] - first[i]) // k[i]
            yield pa.RecordBatch.from_arrays([*x.columns[:5], pa.array(out)], names=[*x.schema.names[:5], "container_id"])

    kind = docs.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{key}` {kind}, piece_no int, start_char int, end_char int, n_tokens bigint, container_id bigint")
