"""Oversized texts into overlapping pieces, cut at natural boundaries and never inside a labelled span.

Texts and files of any size are processed by ranges, by one rule: at or after each multiple of the range's size lies a natural boundary, and what
is between two of them is cut on its own, looking back for the overlap; prefix sums over ranges number the pieces (and, for files, turn bytes into
characters). A text of one range is cut where it is read; of longer ones the ranges go to workers of their own, with a halo to the left. Of files,
workers see one range with halos each, find the first boundary in it, stitch the boundary table by a window over the ranges of a file, and no task
holds more than a range and its halos.

Pieces have at most ``limit`` tokens and start up to ``overlap`` tokens before the end of the piece before. A cut is the last paragraph end
in the second half of the room, else the last line end there, else the last sentence end, else the last word end; a span wider than the
limit, or a word of more tokens than the limit, is cut inside as nothing else is possible. Null and blank texts have no pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.bitmaps import Bitmap, chunks
from spanloom.llm.packing import word_table
from spanloom.llm.tokens import INDEPENDENT, Costs, Shared, costs_of, independent_chunks, record_key, vocabulary

#: What may stand between two words at which a piece may end, best first: 3 a paragraph end, 2 a line end, 1 a sentence end.
BLANK_LINE = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r|\n)")
LINE = re.compile(r"[\r\n\x0b\x0c\x85  ]")
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+(?=[^\sa-z])|[。！？।]")


def boundaries(text: str, starts: list[int], ends: list[int]) -> list[int]:
    """Class of the boundary after each word: 3 paragraph, 2 line, 1 sentence, 0 none."""
    out = [0] * len(ends)
    for pattern, kind in ((SENTENCE, 1), (LINE, 2), (BLANK_LINE, 3)):
        for m in pattern.finditer(text):
            i = bisect_left(starts, m.end()) - 1
            if 0 <= i < len(out) and out[i] < kind:
                out[i] = kind
    return out


def cut_text(costs: Costs, text: str, spans: list[tuple[int, int]], limit: int, overlap: int, begin: int = 0, stop: int | None = None) -> list[tuple[int, int, int]]:
    """Pieces ``(start, end, tokens)`` of ``text[begin:stop]``; the first may start before ``begin`` for its overlap when ``begin`` isn't 0."""
    starts, ends, sizes = word_table(costs, text, limit)
    if not starts:
        return []
    kinds = boundaries(text, starts, ends)
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    inside = set()  # word ends that lie within a span
    for a, b in spans:
        if a < b:
            inside.update(range(max(0, bisect_right(ends, a)), bisect_left(ends, b)))
    first = bisect_left(starts, begin)
    last = len(starts) if stop is None else bisect_left(starts, stop)

    def back(at: int, least: int) -> int:
        """The first word of a piece after the cut before word ``at``."""
        low = bisect_left(sums, sums[at] - overlap, least, at + 1)
        for k in range(low, at):
            if kinds[k - 1] and k - 1 not in inside and k > 0:
                return k
        for k in range(low, at):
            if k == 0 or k - 1 not in inside:
                return k
        return at

    out, s = [], first
    if begin and first < last:
        s = back(first, 0)
    done = first
    while done < last:
        most = bisect_right(sums, sums[s] + limit) - 1  # words [s, most) fit
        if most >= last:
            e = last
        else:
            least = max(done + 1, s + 1)
            half = max(least, bisect_left(sums, sums[s] + limit // 2))
            e = 0
            for kind, low in ((3, half), (2, half), (1, least), (2, least)):
                e = next((k for k in range(most, low - 1, -1) if kinds[k - 1] >= kind and k - 1 not in inside), 0)
                if e:
                    break
            e = e or next((k for k in range(most, least - 1, -1) if k - 1 not in inside), 0) or max(most, least)
        if sums[e] - sums[s] > limit:  # nothing but the overlap filled the piece
            s = done
            continue
        out.append((starts[s], ends[e - 1], sums[e] - sums[s]))
        done = e
        s = back(e, s + 1) if e < last else e
        if e < last and sums[done + 1] - sums[s] > limit:
            s = done
    return out


def first_boundary(text: str, at: int, halo: int, spans: list[tuple[int, int]], whole: bool = False) -> int:
    """The best place to cut in ``text[at:at + halo]``: a paragraph, line or sentence end, else a blank; outside of spans.

    Where there is none, ``at`` itself, or with ``whole`` the first place behind that no word or span spans, else the text's end.
    """
    near = [(a, b) for a, b in spans if a < b and b > at - halo and a < at + halo]

    def free(k: int, spans: list[tuple[int, int]]) -> bool:
        """Neither the cut nor the end of the word before it lies in a span."""
        end = k
        while end and text[end - 1].isspace():
            end -= 1
        return not any(a < k < b or a < end < b for a, b in spans)

    for pattern in (BLANK_LINE, LINE, SENTENCE, re.compile(r"\s+")):
        for m in pattern.finditer(text, at, at + halo):
            if free(m.end(), near):
                return m.end()
    if not whole:
        return at
    return next((m.end() for m in INDEPENDENT.finditer(text, at) if free(m.end(), spans)), len(text))


def over(costs: Costs, text: str | None, limit: int, size: int = 8192) -> bool:
    """Whether a text has more tokens than the limit; a long one is counted only as far as it takes."""
    n = 0
    for part in independent_chunks(text or "", size):
        n += costs.count(part)
        if n > limit:
            return True
    return False


PIECE = "start int, end int, n_tokens bigint, piece string, spans array<struct<start:int,end:int,label:string>>"


def split_records(records: DataFrame, vocab: DataFrame, limit: int = 256, overlap: int = 32, range_chars: int = 8192, halo: int = 2048, key: str = "id") -> DataFrame:
    """Pieces of every record over ``limit`` tokens: ``(key, piece_no, n_pieces, start, end, n_tokens, piece, spans)``.

    Offsets are code points of the record's text; ``spans`` are those that lie wholly in the piece, with offsets in it (null when the record
    has null spans). Repeated rows of one id count once, with the greatest of their texts; rows without an id are told apart by their text.
    Spans that are null, empty or out of range don't restrain cuts.
    """
    spark = records.sparkSession
    shared = Shared(spark, vocabulary(vocab))
    # one text an id: only rows whose id is repeated, and a few others, are shuffled, and the greatest text by code points stays
    r = records.select(F.col(key).alias("id"), record_key(key, "text").alias("k"), "text", "spans").where("text is not null")
    again = r.groupBy("k").count().where("count > 1").select(F.xxhash64("k").alias("h"))
    repeated = Bitmap(again, "h", again.count())
    kind = records.schema[key].dataType
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])
    head = [("id", to_arrow_type(kind)), ("k", pa.string()), ("r", pa.int32()), ("n", pa.int32())]
    piece_schema = pa.schema([*head, ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int64()), ("piece", pa.string()), ("spans", pa.list_(span))])
    range_schema = pa.schema([*head, ("base", pa.int32()), ("begin", pa.int32()), ("text", pa.string()), ("spans", pa.list_(span))])
    names = f"id {kind.simpleString()}, k string, r int, n int"

    def ranges_of(b: pa.RecordBatch) -> list[dict]:
        """The ranges of oversized texts, each from its boundary to the next one's, with a halo to the left."""
        costs, rows = costs_of(shared), []
        for row in b.filter(pa.array([over(costs, x, limit) for x in b.column(2).to_pylist()], pa.bool_())).to_pylist():
            text, spans = row["text"], valid(row["spans"])
            edges = [0]
            for at in range(range_chars, len(text), range_chars):
                if at > edges[-1]:
                    edges.append(first_boundary(text, at, halo, spans, True))
            edges = sorted({*edges, len(text)})
            for no, (begin, stop) in enumerate(zip(edges, edges[1:])):
                base = max(0, begin - halo)
                own = [s for s in row["spans"] or [] if s and s["start"] is not None and s["end"] is not None and s["start"] < stop and s["end"] > base]
                rows.append({"id": row["id"], "k": row["k"], "r": no, "n": len(edges) - 1, "base": base, "begin": begin - base, "text": text[base:stop], "spans": None if row["spans"] is None else own})
        return rows

    def pieces_of(rows: list[dict]) -> list[dict]:
        costs, out = costs_of(shared), []
        for row in rows:
            local = [(s["start"] - row["base"], s["end"] - row["base"]) for s in row["spans"] or []]
            pieces = [piece_row(row, p) for p in cut_text(costs, row["text"], local, limit, overlap, row["begin"])]
            if row["n"] == 1:
                for no, p in enumerate(pieces):  # all there are
                    p |= {"r": no, "n": len(pieces)}
            out += pieces
        return out

    def fresh(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield b.filter(pa.array(repeated.has(b.column(4).to_numpy(zero_copy_only=False)) == inside)).select(range(4))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist(ranges_of(b), schema=range_schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist(pieces_of(ranges_of(b)), schema=piece_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_pylist(pieces_of(b.to_pylist()), schema=piece_schema)

    spans_type = "array<struct<start:int,end:int,label:string>>"
    piece_fields, range_fields = f"{names}, {PIECE}", f"{names}, base int, begin int, text string, spans {spans_type}"
    known = r.withColumn("h", F.xxhash64("k"))
    twice = known.mapInArrow(lambda batches: fresh(batches, True), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema))
    best = F.max_by(F.struct(*r.columns), F.struct("text", F.xxhash64("spans")))
    twice = twice.groupBy(F.col("k").alias("_k")).agg(best.alias("_r")).select("_r.*")
    long = F.length("text") > range_chars
    single = known.where(~long).mapInArrow(lambda batches: whole(fresh(batches, False)), piece_fields).unionByName(twice.where(~long).mapInArrow(lambda batches: whole(chunks(batches)), piece_fields))
    ranges = known.where(long).mapInArrow(lambda batches: found(fresh(batches, False)), range_fields).unionByName(twice.where(long).mapInArrow(lambda batches: found(chunks(batches)), range_fields))
    several = ranges.repartition("k", "r").mapInArrow(cut, piece_fields)
    by_start = Window.partitionBy("k").orderBy("start")
    several = several.withColumn("no", (F.row_number().over(by_start) - 1).cast("int")).withColumn("n_pieces", F.count("*").over(Window.partitionBy("k")).cast("int"))
    single = single.withColumn("no", F.col("r")).withColumn("n_pieces", F.col("n"))
    out = single.unionByName(several)
    return out.select(F.col("id").alias(key), F.col("no").alias("piece_no"), "n_pieces", "start", "end", "n_tokens", "piece", "spans")


def valid(spans: list | None) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in spans or [] if s and s["start"] is not None and s["end"] is not None]


def piece_row(row: dict, piece: tuple[int, int, int]) -> dict:
    a, b, tokens = piece
    base, spans = row["base"], row["spans"]
    inner = None if spans is None else [{"start": s["start"] - base - a, "end": s["end"] - base - a, "label": s["label"]} for s in spans if a <= s["start"] - base and s["end"] - base <= b]
    return {"id": row["id"], "k": row["k"], "r": row["r"], "n": row["n"], "start": base + a, "end": base + b, "n_tokens": tokens, "piece": row["text"][a:b], "spans": inner}


def split_files(spark: SparkSession, paths: list[str], vocab: DataFrame, limit: int = 256, overlap: int = 32, range_bytes: int = 1 << 20, halo: int = 16384) -> DataFrame:
    """Pieces of UTF-8 files of any size, read by byte ranges: ``(path, piece_no, start_byte, end_byte, start_char, n_tokens, piece)``.

    Paths must be readable by every executor. No task reads more than a range and two halos. An empty file has no pieces.
    """
    from pyarrow import fs

    shared = Shared(spark, vocabulary(vocab))
    rows = []
    for p in paths:
        system, name = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
        size = system.get_file_info(name).size
        rows += [(p, size, -(-size // range_bytes))] if size else []
    files = spark.createDataFrame(rows or [("", 0, 0)], "path string, size bigint, n bigint").where("n > 0")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("r")).repartition(F.col("path"), F.col("r"))

    def read(path: str, a: int, b: int) -> tuple[str, int]:
        """Text of the bytes ``a`` to ``b``, and how many bytes of a character cut at the start were left out."""
        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(name) as f:
            raw = f.read_at(b - a, a)
        skip = 0
        while a and skip < min(3, len(raw)) and raw[skip] & 0xC0 == 0x80:
            skip += 1
        return raw[skip:].decode("utf8", "ignore"), skip

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for row in b.to_pylist():
                a = row["r"] * range_bytes
                text, skip = read(row["path"], a, min(row["size"], a + halo))
                found.append(a + skip + len(text[: first_boundary(text, 0, len(text), [])].encode()) if a else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*b.schema.names, "b"])

    ordered = Window.partitionBy("path").orderBy("r")
    stitched = ranges.mapInArrow(find, "path string, size bigint, r bigint, b bigint").withColumn("stop", F.coalesce(F.lead("b").over(ordered), "size"))

    def cut_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = costs_of(shared)
        for b in batches:
            for row in b.to_pylist():
                base = max(0, row["b"] - halo)
                left, skip = read(row["path"], base, row["b"])
                body, _ = read(row["path"], row["b"], row["stop"])
                text = left + body
                rows, char, byte = [], 0, base + skip
                for a, e, n in cut_text(costs, text, [], limit, overlap, len(left), len(text)):
                    byte += len(text[char:a].encode()) if a >= char else -len(text[a:char].encode())
                    char = a
                    piece = text[a:e]
                    rows.append({"path": row["path"], "r": row["r"], "n_chars": len(body), "start_byte": byte, "end_byte": byte + len(piece.encode()), "rel": a - len(left), "n_tokens": n, "piece": piece})
                yield pa.RecordBatch.from_pylist(rows, schema=piece_schema)

    piece_schema = pa.schema([("path", pa.string()), ("r", pa.int64()), ("n_chars", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("rel", pa.int64()), ("n_tokens", pa.int64()), ("piece", pa.string())])
    pieces = stitched.mapInArrow(cut_range, "path string, r bigint, n_chars bigint, start_byte bigint, end_byte bigint, rel bigint, n_tokens bigint, piece string")
    lengths = pieces.groupBy("path", "r").agg(F.max("n_chars").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = pieces.join(lengths.drop("n"), ["path", "r"]).withColumn("piece_no", F.row_number().over(Window.partitionBy("path").orderBy("start_byte")) - 1)
    return numbered.select("path", "piece_no", "start_byte", "end_byte", (F.col("before") + F.col("rel")).alias("start_char"), "n_tokens", "piece")
