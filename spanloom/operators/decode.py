"""From labels of tokens to typed spans: BIO islands by window functions, and constrained BIOES Viterbi.

Input tables are long: ``(doc_id, i, start, end, word_id, label, p)`` with ``label`` as text (null: no prediction). One exchange by ``doc_id``
serves every window function here; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.scoring import log_softmax
from spanloom.session import ship
from spanloom.spec import Biases, DecodeConfig, bioes_tags

WHITE_ENDS = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def bio_spans(tokens: DataFrame, config: DecodeConfig, key: str = "doc_id") -> DataFrame:
    """``(key, type, start, end, confidence)`` by the BIO rules.

    A token that continues a word (its word id is non-null and that of the token before) takes the label of the word's first token. O closes a
    span; a label without a dash counts as B; a token goes on with the open span when the name is the same and it is I, E or a continuation.
    Confidence is the mean over tokens that decide; spans under the threshold or of unmapped names are dropped.
    """
    order = Window.partitionBy(key).orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.select(key, "i", "start", "end", "word_id", "label", "p")
    t = t.withColumn("cont", F.coalesce(F.col("word_id") == F.lag("word_id").over(order), F.lit(False)))
    t = t.withColumn("run", F.sum(F.when(F.col("cont"), 0).otherwise(1)).over(upto))
    t = t.withColumn("lab", F.coalesce(F.first("label").over(Window.partitionBy(key, "run").orderBy("i")), F.lit("O")))
    dash = F.instr("lab", "-")
    t = t.withColumn("name", F.when(F.col("lab") != "O", F.when(dash > 0, F.substring("lab", dash + 1, F.length("lab"))).otherwise(F.col("lab"))))
    t = t.withColumn("prefix", F.when(dash > 0, F.substring("lab", F.lit(1), dash - 1)).otherwise("B"))
    goes_on = F.coalesce(F.col("name") == F.lag("name").over(order), F.lit(False)) & (F.col("prefix").isin("I", "E") | F.col("cont"))
    t = t.withColumn("island", F.sum((F.col("name").isNotNull() & ~goes_on).cast("int")).over(upto)).where("name is not null")
    confidence = F.coalesce(F.avg(F.when(~F.col("cont") & F.col("label").isNotNull(), F.col("p"))), F.lit(0.0))
    spans = t.groupBy(key, "name", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), confidence.alias("confidence"))
    mapped = F.create_map(*[F.lit(x) for kv in config.label_map.items() for x in kv]) if config.label_map else F.create_map(F.lit(""), F.lit(None).cast("string"))
    return spans.withColumn("type", mapped[F.col("name")]).where(f"type is not null and confidence >= {config.threshold!r}").select(key, "type", "start", "end", "confidence")


def detections(spans: DataFrame, docs: DataFrame, config: DecodeConfig, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans with their value out of the original text (code-point offsets), trimmed of white space; empty ones go."""
    j = spans.join(docs.select(key, text), key)
    raw = F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))
    lead = F.length(raw) - F.length(F.regexp_replace(raw, r"^\p{IsWhite_Space}+", ""))
    j = j.withColumn("value", F.regexp_replace(raw, WHITE_ENDS, "")).withColumn("start", (F.col("start") + lead).cast("int")).where("value <> ''")
    j = j.withColumn("end", (F.col("start") + F.length("value")).cast("int"))
    return j.select(key, "type", "value", "start", "end", "confidence", F.lit(f"ner:{config.name}").alias("detector"), F.lit("model").alias("source"), F.lit(True).alias("enabled"))


#: Characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


class LabelTable:
    """Of each label its name (-1: background) and whether its prefix goes on with a span, by the rules of ``bio_spans``."""

    def __init__(self, labels: tuple[str, ...]):
        parts = [("", None) if x == "O" else tuple(x.split("-", 1)) if "-" in x else ("B", x) for x in labels]
        self.names = sorted({name for _, name in parts if name is not None})
        self.name = np.array([-1 if name is None else self.names.index(name) for _, name in parts], dtype=np.int64)
        self.goes_on = np.array([prefix in ("I", "E") for prefix, _ in parts], dtype=bool)


def flat_spans(first: np.ndarray, label: np.ndarray, p: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, table: LabelTable, config: DecodeConfig) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``bio_spans`` of the tokens of many documents in a row, ``first`` where one begins: of each span its first token, type, start, end, confidence.

    ``label`` is a number, and a negative word id is none.
    """
    n = len(first)
    cont = np.zeros(n, bool)
    cont[1:] = ~first[1:] & (words[1:] >= 0) & (words[1:] == words[:-1])
    lab = label[np.maximum.accumulate(np.where(cont, 0, np.arange(n)))] if n else label
    name = table.name[lab]
    on = np.zeros(n, bool)
    on[1:] = ~first[1:] & (name[1:] == name[:-1]) & (table.goes_on[lab[1:]] | cont[1:])
    at = np.flatnonzero(name >= 0)  # tokens of spans; those of one are neighbours
    begin = np.flatnonzero(~on[at])
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, pa.array([], pa.string()), none, none, np.zeros(0)
    decides = ~cont[at]
    with np.errstate(invalid="ignore"):
        sure = np.add.reduceat(np.where(decides, p[at], 0.0), begin) / np.add.reduceat(decides.astype(np.int64), begin)  # a span's first token decides
        kept = ~(sure < config.threshold)
    types = pa.array([config.label_map.get(x) for x in table.names], pa.string())
    kept &= types.is_valid().to_numpy(zero_copy_only=False)[name[at[begin]]]
    of = types.take(pa.array(name[at[begin]][kept]))
    return at[begin][kept], of, np.minimum.reduceat(starts[at], begin)[kept], np.maximum.reduceat(ends[at], begin)[kept], sure[kept]


def unit_offsets(text: str, unit: str) -> np.ndarray | None:
    """Offset in ``byte`` or ``utf16`` units at each code point and at the end; nothing where it is the number of code points."""
    if unit == "char" or text.isascii():
        return None
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    width = 1 + (c >= 0x10000) if unit == "utf16" else 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    return np.concatenate(([0], np.cumsum(width)))


def placed(docs: pa.RecordBatch, key: str, row: np.ndarray, of: pa.Array, start: np.ndarray, end: np.ndarray, sure: np.ndarray, unit: str) -> pa.RecordBatch:
    """``detections`` of spans in rows of a batch with ``key`` and ``text``, in the rows' order: values trimmed of white space, empty ones go, offsets in a unit."""
    used, at = np.unique(row, return_index=True)
    texts = docs.column(docs.schema.get_field_index("text")).take(pa.array(used, pa.int64())).to_pylist()
    each = np.diff(np.append(at, len(row))).tolist()
    raw = pa.array([t[a:b] for t, a, b in zip(chain.from_iterable(map(repeat, texts, each)), start.tolist(), end.tolist())], pa.string())
    size = lambda x: pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    value = pc.utf8_trim(raw, WHITE)
    start = start + size(raw) - size(pc.utf8_ltrim(raw, WHITE))
    end = start + size(value)
    kept = end > start
    for text, a, n in zip(texts, at.tolist(), each):
        if (units := unit_offsets(text, unit)) is not None:
            ok = slice(a, a + n)
            start[ok], end[ok] = units[np.minimum(start[ok], len(text))], units[np.minimum(end[ok], len(text))]  # an empty value may lie behind the text
    keys = docs.column(docs.schema.get_field_index(key)).take(pa.array(row, pa.int64()))
    parts = [keys, of, value, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(sure, pa.float64())]
    return pa.RecordBatch.from_arrays(parts, names=[key, "type", "value", "start", "end", "confidence"]).filter(pa.array(kept))


def transitions(labels: tuple[str, ...], biases: Biases) -> np.ndarray:
    """Bias of each allowed transition, minus infinity for the others."""
    tags = bioes_tags(labels)
    out = np.full((len(tags), len(tags)), -np.inf)
    for i, (a, x) in enumerate(tags):
        for j, (b, y) in enumerate(tags):
            if a == "O" and b == "O":
                out[i, j] = biases.background_stay
            elif a == "O" and b in "BS":
                out[i, j] = biases.background_to_start
            elif a in "ES" and b == "O":
                out[i, j] = biases.end_to_background
            elif a in "ES" and b in "BS":
                out[i, j] = biases.end_to_start
            elif a in "BI" and x == y and b in "IE":
                out[i, j] = biases.inside_to_continue if b == "I" else biases.inside_to_end
    return out


def viterbi_path(z: np.ndarray, moves: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The best path; of equal ones that of the lowest labels."""
    if np.isnan(z).any():
        raise ValueError("scores must not be NaN")
    top = z.max(axis=1, keepdims=True)
    logp = z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))
    score = np.where(starts, logp[0], -np.inf)
    back = np.zeros(z.shape, dtype=np.int64)
    for t in range(1, len(z)):
        cand = score[:, None] + moves
        back[t] = cand.argmax(axis=0)
        score = cand.max(axis=0) + logp[t]
    path = np.empty(len(z), dtype=np.int64)
    path[-1] = np.where(ends, score, -np.inf).argmax()
    for t in range(len(z) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def viterbi_flat(z: np.ndarray, stops: np.ndarray, labels: tuple[str, ...], biases: Biases) -> tuple[np.ndarray, np.ndarray]:
    """Number and probability of the best path's labels, of the scores of many documents in a row that end at ``stops``."""
    moves = transitions(labels, biases)
    tags = [t for t, _ in bioes_tags(labels)]
    begins, ends = np.array([t in "OBS" for t in tags]), np.array([t in "OES" for t in tags])
    path, at = np.zeros(len(z), np.int64), 0
    for stop in stops.tolist():
        if stop > at:
            path[at:stop] = viterbi_path(z[at:stop], moves, begins, ends)
        at = stop
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return path, e[np.arange(len(z)), path] / e.sum(axis=1)


def viterbi_labels(sequences: DataFrame, labels: tuple[str, ...], biases: Biases | None = None, key: str = "doc_id", scores: str = "m") -> DataFrame:
    """``(key, i, label, p)`` of the best path of every sequence ``m: ARRAY<ARRAY<DOUBLE>>``, for label sets of any size; empty sequences give nothing."""
    ship(sequences.sparkSession)
    moves = transitions(labels, biases or Biases())
    tags = [t for t, _ in bioes_tags(labels)]
    starts, ends = np.array([t in "OBS" for t in tags]), np.array([t in "OES" for t in tags])
    kind = sequences.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, at, lab, p = [], [], [], []
            for row, m in enumerate(b.column(1).to_pylist()):
                if not m:
                    continue
                z = np.array(m, dtype=np.float64)
                if z.ndim != 2 or z.shape[1] != len(labels):
                    raise ValueError("scores do not fit the labels")
                path = viterbi_path(z, moves, starts, ends)
                e = np.exp(z - z.max(axis=1, keepdims=True))
                take += [row] * len(path)
                at += range(len(path))
                lab += [labels[k] for k in path]
                p += (e[np.arange(len(path)), path] / e.sum(axis=1)).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(at, pa.int32()), pa.array(lab, pa.string()), pa.array(p, pa.float64())], names=[key, "i", "label", "p"])

    return sequences.select(key, scores).mapInArrow(run, f"`{key}` {kind}, i int, label string, p double")


def viterbi_native(m: Column, labels: tuple[str, ...], biases: Biases | None = None) -> Column:
    """The best path as an array of label numbers, by higher-order functions; meant for up to about nine labels."""
    moves = transitions(labels, biases or Biases())
    tags = [t for t, _ in bioes_tags(labels)]
    k = len(labels)
    worst = F.lit(float("-inf"))
    lp = F.transform(m, log_softmax)
    first = F.element_at(lp, 1)
    begin = F.array(*[first[j] if tags[j] in "OBS" else worst for j in range(k)])

    def step(acc: Column, row: Column) -> Column:
        cand = [F.array(*[acc["s"][i] + float(moves[i, j]) if np.isfinite(moves[i, j]) else worst for i in range(k)]) for j in range(k)]
        return F.struct(F.array(*[F.array_max(c) + row[j] for j, c in enumerate(cand)]).alias("s"), F.array_append(acc["b"], F.array(*[(F.array_position(c, F.array_max(c)) - 1).cast("int") for c in cand])).alias("b"))

    zero = F.struct(begin.alias("s"), F.expr("cast(array() as array<array<int>>)").alias("b"))

    def path(acc: Column) -> Column:
        last = F.array(*[acc["s"][j] if tags[j] in "OES" else worst for j in range(k)])
        end = F.array((F.array_position(last, F.array_max(last)) - 1).cast("int"))
        return F.aggregate(F.reverse(acc["b"]), end, lambda p, b: F.concat(F.array(F.get(b, F.element_at(p, 1))), p))

    return F.when(F.size(m) > 0, F.aggregate(F.slice(lp, F.lit(2), F.size(lp)), zero, step, path))
