"""The composed pipeline: documents to typed detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import title_cased
from spanloom.operators import decode, scoring, tokenize, windows
from spanloom.session import ship, spread
from spanloom.spec import ModelSpec


#: Tokens that are scored and decoded at once, but for a longer document.
MOST_TOKENS = 1 << 16


def detect(docs: DataFrame, spec: ModelSpec, tokenizer_json: str, make_scorer: Callable[[], scoring.TokenScorer], key: str = "doc_id", text: str = "text", offset_unit: str = "char") -> DataFrame:
    """Detections of every document; null and empty texts and null keys have none. Values come from the original text. Map-only."""
    src = model_text(spread(docs.select(key, F.col(text).alias("text"))).where("text <> ''"), spec, "_seen")
    encode = tokenize.subword_encoder(src.sparkSession, tokenizer_json, spec.tokenizer_kind, "_seen")

    def encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in encode(batches):
            tokenize.refuse_errors(b, "_seen")
            yield b

    return detect_encoded(src, spec, tokenize.special_ids(tokenize.load_tokenizer(tokenizer_json)), make_scorer, key, offset_unit, encoder)


def model_text(docs: DataFrame, spec: ModelSpec, to: str = "text") -> DataFrame:
    """Adds the text as the model sees it; of the same length."""
    return docs.withColumn(to, title_cased("text") if spec.title_case else F.col("text"))


def detect_encoded(
    docs: DataFrame, spec: ModelSpec, special: tuple[int, int] | None, make_scorer: Callable[[], scoring.TokenScorer], key: str = "doc_id", offset_unit: str = "char", encoder: tokenize.Batches | None = None
) -> DataFrame:
    """Detections of rows ``(key, text)`` with an ``encoding``, or with the columns of which ``encoder`` makes one. Empty encodings give none.

    ``text`` is the original one. A document's tokens, scores and labels never leave the batch it is read in, so nothing is exchanged, and only its
    spans come out. Offsets are in ``char`` (code points), ``byte`` (UTF-8) or ``utf16``.
    """
    ship(docs.sparkSession)
    config, labels = spec.decode_config(), decode.LabelTable(spec.labels)
    kind = docs.schema[key].dataType.simpleString()
    if offset_unit not in ("char", "byte", "utf16"):
        raise ValueError(f"unknown unit {offset_unit}")

    def found(b: pa.RecordBatch, scorer: scoring.TokenScorer) -> pa.RecordBatch:
        n, ids, starts, ends, words = tokenize.flat(b.column(b.schema.get_field_index("encoding")))
        stops = np.cumsum(n)
        z = np.empty((len(ids), len(spec.labels)))
        for at, stop in zip((stops - n).tolist(), stops.tolist()):
            if stop > at:
                z[at:stop] = windows.best_scores(ids[at:stop], lambda part: scoring.checked(scorer, part, len(spec.labels)), spec.max_tokens, spec.stride, special)
        first = np.zeros(len(ids), bool)
        first[(stops - n)[n > 0]] = True
        if spec.decoder == "bio":
            label, p = scoring.predictions(z)
        else:
            label, p = decode.viterbi_flat(z, stops, spec.labels, spec.biases)
            words = np.full(len(ids), tokenize.NO_WORD)  # every token decides
        begin, of, start, stop, sure = decode.flat_spans(first, label, p, starts, ends, words, labels, config)
        row = np.searchsorted(stops, begin, "right")
        return decode.placed(b, key, row, of, start, stop, sure, offset_unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scoring.scorer_of(spec.name, make_scorer)
        for b in encoder(batches) if encoder else batches:
            for part in tokenize.slices(b, tokenize.counts(b.column(b.schema.get_field_index("encoding"))), MOST_TOKENS):
                yield found(part, scorer)

    spans = docs.where(F.col(key).isNotNull()).mapInArrow(run, f"`{key}` {kind}, type string, value string, `start` int, `end` int, confidence double")
    return spans.select("*", F.lit(f"ner:{config.name}").alias("detector"), F.lit("model").alias("source"), F.lit(True).alias("enabled"))
