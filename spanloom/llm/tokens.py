"""Token counts under a given word-piece vocabulary, and everything that cuts by them.

Lower-cased text falls into words: maximal runs of letters and digits, and every other character that is no white space by itself. A word
is taken from its start by the longest piece each time (``##`` before every piece but the first) and costs the number of its pieces; a word
that cannot be covered costs 1. Words repeat, so a worker keeps the cost of each word it has met.

A cut is independent where no word spans it and lower-casing looks at neither side from the other: at white space and at characters that
are neither letters, digits, marks nor ignorable in casing. Only there are oversized texts cut, so chunk counts add up exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import ship

WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(f"[^\\W_]+|[^{WHITE}]")
#: White space, and punctuation that is not ignorable in casing.
INDEPENDENT = re.compile(f"[{WHITE}_,;!?()\\[\\]{{}}\"/\\\\|+=<>@#$%&*~、。！？，；：「」（）-]")
#: The vocabulary is broadcast; a larger one than this is no vocabulary of a tokenizer.
MAX_VOCAB = 2_000_000
#: Words kept per worker; beyond it the memory starts anew.
MAX_MEMO = 400_000


class Costs(dict):
    """Word to number of pieces; computed when first asked for."""

    def __init__(self, pieces: list[str]):
        super().__init__()
        self.first = {p for p in pieces if not p.startswith("##")}
        self.rest = {p[2:] for p in pieces if p.startswith("##")}
        self.longest = max([1, *map(len, self.first), *map(len, self.rest)])

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_MEMO:
            self.clear()
        at, n = 0, 0
        while at < len(word):
            known = self.rest if at else self.first
            for end in range(min(len(word), at + self.longest), at, -1):
                if word[at:end] in known:
                    break
            else:
                n = 1
                break
            at, n = end, n + 1
        self[word] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, WORD.findall(text.lower()))) if text else 0


def vocabulary(vocab: DataFrame, column: str = "token") -> list[str]:
    """The pieces, for a broadcast; fails beyond ``MAX_VOCAB`` instead of flooding the driver."""
    rows = vocab.select(column).where(F.col(column).isNotNull()).limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary of more than {MAX_VOCAB} pieces")
    return [r[0] for r in rows]


_COSTS: dict[int, Costs] = {}


def costs_of(shared) -> Costs:
    """One memory per worker and vocabulary."""
    if shared.id not in _COSTS:
        _COSTS.clear()
        _COSTS[shared.id] = Costs(shared.value)
    return _COSTS[shared.id]


class Shared:
    """A broadcast with a stable name, for code that runs in workers."""

    def __init__(self, spark, value):
        ship(spark)
        self.b = spark.sparkContext.broadcast(value)
        self.id = self.b._jbroadcast.id()

    def __getstate__(self):
        return {"b": self.b, "id": self.id}

    @property
    def value(self):
        return self.b.value


def count_tokens(df: DataFrame, vocab: DataFrame, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with its token count (BIGINT); a null text has 0. Map-only."""
    shared = Shared(df.sparkSession, vocabulary(vocab))
    keep = [c for c in df.columns if c not in (text, name)]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = costs_of(shared)
        for b in batches:
            n = pa.array([costs.count(x) for x in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, name])

    return df.select(*keep, text).mapInArrow(run, ", ".join([*fields, f"`{name}` bigint"]))


def independent_chunks(text: str, size: int) -> Iterator[str]:
    """Pieces of about ``size`` characters whose token counts add up to the whole's; a run without a safe place stays whole."""
    at = 0
    while len(text) - at > size:
        window = text[at : at + size]
        cuts = [m.end() for m in INDEPENDENT.finditer(window, max(0, size - 512))] or [m.end() for m in INDEPENDENT.finditer(window)]
        if cuts:
            end = at + cuts[-1]
        else:
            m = INDEPENDENT.search(text, at + size)
            end = m.end() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def compared(column: str) -> Column:
    """A label as it is compared: lower-cased, trimmed, null as ``unknown``."""
    return F.coalesce(F.lower(F.trim(F.col(column))), F.lit("unknown"))


def compared_lang(column: str = "lang") -> Column:
    return F.regexp_replace(compared(column), "[-_].*$", "")


def record_key(key: str, text: str) -> Column:
    """Rows with one id are one record; rows without an id are one record when their texts are equal."""
    return F.coalesce(F.concat(F.lit("i"), F.col(key)), F.concat(F.lit("t"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def token_budget(records: DataFrame, vocab: DataFrame, oversize: int = 8192) -> DataFrame:
    """``(source, lang, doctype, n_tokens)`` over records that count once an id.

    Texts over ``oversize`` characters are cut at independent places and their chunks salted over the workers; all others are counted where
    they are read. Only ids, labels and numbers are shuffled besides. Of copies of one id the largest count and the least labels hold.
    """
    spark = records.sparkSession
    shared = Shared(spark, vocabulary(vocab))
    r = records.select(record_key("id", "text").alias("k"), compared("source").alias("s"), compared_lang().alias("l"), compared("doctype").alias("d"), "text")
    large = F.length("text") > oversize
    schema = "k string, s string, l string, d string, chunk int, text string"

    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                parts = list(independent_chunks(row["text"], oversize))
                yield pa.RecordBatch.from_pydict({**{c: [row[c]] * len(parts) for c in "ksld"}, "chunk": pa.array(range(len(parts)), pa.int32()), "text": parts})

    def counted(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            costs = costs_of(shared)
            for b in batches:
                n = pa.array([costs.count(x) for x in b.column(5).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:5], n], names=["k", "s", "l", "d", "chunk", "n"])

        return df.mapInArrow(run, "k string, s string, l string, d string, chunk int, n bigint")

    small = r.where(~F.coalesce(large, F.lit(False))).select("k", "s", "l", "d", F.lit(0).alias("chunk"), "text")
    chunks = r.where(large).mapInArrow(chop, schema).repartition("k", "chunk")  # chunks of one text are salted by their number over all tasks there are
    each = counted(small).unionByName(counted(chunks))
    once = each.groupBy("k", "chunk").agg(F.min(F.struct("s", "l", "d")).alias("x"), F.max("n").alias("n"))
    whole = once.groupBy("k").agg(F.min("x").alias("x"), F.sum("n").alias("n"))
    return whole.groupBy(F.col("x.s").alias("source"), F.col("x.l").alias("lang"), F.col("x.d").alias("doctype")).agg(F.sum("n").cast("bigint").alias("n_tokens"))
