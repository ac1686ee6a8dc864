"""Tokens with offsets: subword tokenizers in Arrow batches, their realignment and word ids; a native word splitter.

Offsets are code points; ``functions.text`` turns them into UTF-8 bytes or UTF-16 units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.session import ship
from spanloom.spec import tokenizer_kind

ENCODING = "ids array<bigint>, starts array<int>, ends array<int>, word_ids array<int>"
ENCODED = pa.struct([("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("word_ids", pa.list_(pa.int32()))])
NO_WORD = -1
#: Bytes of text that are encoded at once, but for a longer one; what the tokenizer makes of them is many times as large.
MOST_BYTES = 1 << 17
_TOKENIZERS: dict[int, object] = {}
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def slices(b: pa.RecordBatch, amounts: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most that amount each, or of one row."""
    upto, at = np.cumsum(amounts), 0
    while at < b.num_rows:
        stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")), at + 1)
        yield b.slice(at, stop - at)
        at = stop


def counts(encoding: pa.StructArray) -> np.ndarray:
    """Tokens of each row of encodings; none of a null."""
    ids = encoding.flatten()[0]
    return pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(encoding: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each row, and ids, starts, ends and word ids of all of them in a row, ``NO_WORD`` for a null."""
    ids, starts, ends, words = (x.flatten() for x in encoding.flatten())
    if not len(ids) == len(starts) == len(ends) == len(words):
        raise ValueError("encoding: unequal lengths")
    return (counts(encoding), *(x.to_numpy(zero_copy_only=False) for x in (ids, starts, ends, words.fill_null(NO_WORD))))


def nested(n: np.ndarray, *parts: pa.Array) -> pa.StructArray:
    """Encodings of ``n`` tokens each, out of ids, starts, ends and word ids in a row."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, x.cast(f.type.value_type)) for x, f in zip(parts, ENCODED)], fields=list(ENCODED))


def special_ids(tokenizer) -> tuple[int, int] | None:
    """First and last id that encoding adds around a text, or nothing when it adds none."""
    bare, whole = (tokenizer.encode("a", add_special_tokens=x).ids for x in (False, True))
    return None if bare == whole else (whole[0], whole[-1])


def load_tokenizer(source: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(source)
    t.no_truncation()
    t.no_padding()
    return t


def realign(text: str, pieces: list[str]) -> tuple[list[int], list[int]]:
    """Where sentence pieces stand in a text that the tokenizer normalised.

    Anchors are pieces found literally, skipping at most two characters more than the unfound pieces before them have. The unfound ones share
    the gap before the next anchor by their lengths, the last one taking the rest. A piece that begins a word takes the white space before it.
    """
    bodies = [p.lstrip("▁") for p in pieces]
    starts, ends = [0] * len(pieces), [0] * len(pieces)

    def anchor(body: str, at: int, slack: int) -> int:
        while body and at < len(text) and slack >= 0:
            if text.startswith(body, at):
                return at
            slack -= not text[at].isspace()
            at += 1
        return -1

    def spread(waiting: list[int], left: int, right: int) -> None:
        for i in waiting:
            inner = left
            while inner < right and text[inner].isspace():
                inner += 1
            stop = right if i == waiting[-1] else min(inner + len(bodies[i]), right)
            stop = inner + len(text[inner:stop].rstrip())
            starts[i] = left if pieces[i].startswith("▁") else inner
            ends[i] = left = max(stop, starts[i])

    cursor, waiting, owed = 0, [], 0
    for i, body in enumerate(bodies):
        at = anchor(body, cursor, owed + 2)
        if at < 0:
            waiting.append(i)
            owed += len(body)
            continue
        begin = at
        if pieces[i].startswith("▁"):
            begin = cursor + len(text[cursor:at].rstrip())
        spread(waiting, cursor, begin)
        starts[i], ends[i], cursor, waiting, owed = begin, at + len(body), at + len(body), [], 0
    spread(waiting, cursor, len(text))
    return starts, ends


def is_standalone(piece: str) -> bool:
    """Kana, Han or Hangul, or nothing alphanumeric."""
    return any("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯" for c in piece) or not any(c.isalnum() for c in piece)


def piece_word_ids(text: str, starts: list[int], ends: list[int]) -> list[int]:
    """Word numbers of sentence pieces: a new word at white space, a gap, and around standalone pieces."""
    out, word, alone, stop = [], 0, False, 0
    for k, (a, b) in enumerate(zip(starts, ends)):
        piece = text[a:b]
        now = is_standalone(piece)
        if k and (piece[:1].isspace() or now or alone or a > stop):
            word += 1
        out.append(word)
        alone, stop = now, b
    return out


def subword_encoder(spark: SparkSession, tokenizer_json: str, kind: str, text: str = "text") -> Batches:
    """Adds a struct ``encoding`` of parallel arrays, without special tokens; null text has a null encoding. Texts are encoded ``MOST_BYTES`` at once."""
    tokenizer_kind(kind)
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    name = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[name] = load_tokenizer(shared.value)
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for b in slices(whole, pc.binary_length(whole.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), MOST_BYTES):
                yield pa.RecordBatch.from_arrays([*b.columns, encodings(_TOKENIZERS[name], b.column(at).to_pylist(), kind)], names=[*b.schema.names, "encoding"])

    return run


def encodings(tokenizer, texts: list[str | None], kind: str) -> pa.StructArray:
    known = [x for x in texts if x is not None]
    made = tokenizer.encode_batch(known, add_special_tokens=False)
    n = np.array([len(e) for e in made], dtype=np.int64)
    ids = pa.array(np.fromiter(chain.from_iterable(e.ids for e in made), np.int64, int(n.sum())))
    if kind == "sentencepiece":
        places = [realign(x, e.tokens) for x, e in zip(known, made)]
        starts, ends = (pa.array(list(chain.from_iterable(p[k] for p in places)), pa.int32()) for k in (0, 1))
        words = pa.array(list(chain.from_iterable(piece_word_ids(x, *p) for x, p in zip(known, places))), pa.int32())
    else:
        places = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in made)), np.int32, 2 * int(n.sum()))
        starts, ends = pa.array(places[::2].copy()), pa.array(places[1::2].copy())
        words = pa.array(list(chain.from_iterable(e.word_ids for e in made)), pa.int32())
    out = nested(n, ids, starts, ends, words)
    if len(known) == len(texts):
        return out
    row = iter(range(len(known)))
    return out.take(pa.array([None if x is None else next(row) for x in texts], pa.int64()))


def encode(docs: DataFrame, tokenizer_json: str, kind: str, text: str = "text") -> DataFrame:
    """``docs`` with what ``subword_encoder`` adds. Map-only."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(subword_encoder(docs.sparkSession, tokenizer_json, kind, text), f"{fields}, encoding struct<{ENCODING.replace(' array', ':array')}>")


def refuse_errors(b: pa.RecordBatch, text: str) -> None:
    """``encoding_errors`` of a batch: offsets that are not ordered within the text are an error."""
    n, _, starts, ends, _ = flat(b.column(b.schema.get_field_index("encoding")))
    size = pc.utf8_length(b.column(b.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
    if not ((starts >= 0) & (starts <= ends) & (ends <= np.repeat(size, n))).all():
        raise ValueError("encoding: offsets out of order")


def encoding_errors(encoding: Column, text: Column) -> Column:
    """Reasons why an encoding is not valid, empty when it is: unequal lengths, or offsets that are not ordered within the text."""
    n = F.size(encoding["ids"])
    same = (n == F.size(encoding["starts"])) & (n == F.size(encoding["ends"])) & (n == F.size(encoding["word_ids"]))
    ordered = F.forall(F.zip_with(encoding["starts"], encoding["ends"], lambda s, e: (s >= 0) & (s <= e) & (e <= F.length(text))), lambda x: x)
    return F.filter(F.array(F.when(~same, F.lit("unequal lengths")), F.when(~ordered, F.lit("offsets out of order"))), lambda x: x.isNotNull())


def token_rows(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a token of ``encoding``: ``(key, i, id, start, end, word_id)``."""
    e = "encoding"
    z = F.arrays_zip(F.col(f"{e}.ids").alias("id"), F.col(f"{e}.starts").alias("start"), F.col(f"{e}.ends").alias("end"), F.col(f"{e}.word_ids").alias("word_id"))
    return encoded.select(key, F.posexplode(z).alias("i", "x")).select(key, "i", "x.id", "x.start", "x.end", "x.word_id")


def word_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A native tokenizer: runs of letters and digits, and runs of other characters but white space, ``(key, i, start, end, piece)``, code points.

    The text is split before each run, so pieces add up to it and offsets are running sums of lengths over the exchange that decoding uses anyway.
    """
    p = docs.select(key, F.posexplode(word_runs(text)).alias("pos", "run"))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("stop", F.sum(F.length("run")).over(upto))
    p = p.withColumn("piece", F.regexp_replace("run", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")).where("piece <> ''")
    lead = F.length("run") - F.length(F.regexp_replace("run", r"^\p{IsWhite_Space}+", ""))
    p = p.withColumn("start", (F.col("stop") - F.length("run") + lead).cast("int")).withColumn("end", (F.col("start") + F.length("piece")).cast("int"))
    return p.withColumn("i", (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("int")).select(key, "i", "start", "end", "piece")


def word_runs(text: Column | str) -> Column:
    """The text split before each run of letters and digits and each run of others; the parts add up to it."""
    return F.split(F.col(text) if isinstance(text, str) else text, r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])|(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}])", -1)


def word_encoder(token_id: Callable[[pa.Array], pa.Array], runs: str = "runs") -> Batches:
    """Encodings of the words of ``word_rows`` out of a column of ``word_runs``: ``token_id`` gives the ids of an array of pieces; each token is a word."""
    from spanloom.operators.decode import WHITE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(runs)
            for b in slices(whole, pc.list_value_length(whole.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 1 << 17):
                n = pc.list_value_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                text = b.column(at).flatten()
                size = lambda x: pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
                long, cut, piece = size(text), pc.utf8_ltrim(text, WHITE), pc.utf8_trim(text, WHITE)
                before = np.concatenate(([0], np.cumsum(long)))
                start = before[:-1] - np.repeat(before[np.cumsum(n) - n], n) + long - size(cut)
                token = size(piece) > 0
                kept = np.add.reduceat(np.append(token, False), np.cumsum(n) - n, dtype=np.int64) * (n > 0) if len(n) else n
                piece, start = piece.filter(pa.array(token)), start[token]
                word = np.arange(len(start)) - np.repeat(np.cumsum(kept) - kept, kept)
                enc = nested(kept, token_id(piece), pa.array(start), pa.array(start + size(piece)), pa.array(word))
                rest = [k for k in range(b.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), enc], names=[*(b.schema.names[k] for k in rest), "encoding"])

    return run


def word_ids_native(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """``piece_word_ids`` as window functions over ``(key, i, start, end, piece)``."""
    order = Window.partitionBy(key).orderBy("i")
    alone = F.col("piece").rlike("[぀-ヿ㐀-鿿가-힯]") | ~F.col("piece").rlike(r"[\p{IsAlphabetic}\p{N}]")
    p = pieces.withColumn("sa", alone).withColumn("first", F.lag("i").over(order).isNull())
    new = F.when(F.col("first"), 0).when(F.col("piece").rlike(r"^\p{IsWhite_Space}") | F.col("sa") | F.lag("sa").over(order) | (F.col("start") > F.lag("end").over(order)), 1).otherwise(0)
    return p.withColumn("new", new).withColumn("word_id", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("sa", "first", "new")
