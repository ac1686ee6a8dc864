"""Joins of spans with tokens and with values: labels of tokens, and labels by known values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.windows import windows
from spanloom.session import ship


def token_labels(tokens: DataFrame, spans: DataFrame, key: str = "doc_id", cell: int = 256) -> DataFrame:
    """``(key, i, start, end, label)``: the first span that overlaps a token labels it.

    A token of no width gets ``-100``, one without a span ``O``; else ``I-`` when the token before has a width and overlaps the same span, and
    ``B-`` otherwise. Spans: ``(key, start, end, label)`` in the order of ``start, end, label``. Tokens meet only the spans in their own stretch of
    ``cell`` characters, so a long document costs no more than several short ones.
    """
    t = tokens.select(key, "i", "start", "end")
    order = Window.partitionBy(key).orderBy("i")
    before = F.struct(F.coalesce(F.lag("start").over(order), F.lit(0)).alias("ps"), F.coalesce(F.lag("end").over(order), F.lit(0)).alias("pe"))
    t = t.withColumn("_p", before)
    cells = lambda a, b: F.sequence(F.floor(a / cell), F.floor(F.greatest(a, b - 1) / cell))
    s = spans.where("start is not null and end is not null and end > start").select(F.col(key).alias("_k"), F.explode(cells(F.col("start"), F.col("end"))).alias("_c"), F.struct("start", "end", "label").alias("_s"))
    s = s.groupBy("_k", "_c").agg(F.array_sort(F.collect_list("_s")).alias("_s"))  # at most what lies in a stretch
    in_cell = t.where("end > start").withColumn("_c", F.explode(cells(F.col("start"), F.col("end"))))
    hit = F.get(F.filter("_s", lambda x: (x["start"] < F.col("end")) & (x["end"] > F.col("start"))), F.lit(0))
    j = in_cell.join(s, F.col(key).eqNullSafe(F.col("_k")) & (in_cell["_c"] == s["_c"]), "left").select(key, "i", "start", "end", "_p", hit.alias("x"))
    j = j.groupBy(key, "i", "start", "end", "_p").agg(F.min("x").alias("x"))
    inside = (F.col("_p.ps") < F.col("x.end")) & (F.col("_p.pe") > F.col("x.start")) & (F.col("_p.ps") != F.col("_p.pe"))
    label = F.when(F.col("x").isNull(), "O").otherwise(F.concat(F.when(inside, "I-").otherwise("B-"), F.col("x.label")))
    return j.select(key, "i", "start", "end", label.alias("label")).unionByName(t.where("end <= start").select(key, "i", "start", "end", F.lit("-100").alias("label")))


def label_windows(labels: DataFrame, max_tokens: int = 256, stride: int = 32, key: str = "doc_id") -> DataFrame:
    """``(key, token_start, token_end, labels)``: the labels of a document's tokens in overlapping windows, as a model is trained on them.

    The places of special tokens at both ends of a window have ``-100``. Labels: ``(key, i, label)``; a document without tokens has no window.
    """
    seq = labels.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]).alias("_all"))
    w = windows(seq.withColumn("_n", F.size("_all")), max_tokens, stride, "_n", special=(0, 0))
    ignored = F.array(F.lit("-100"))
    inner = F.slice("_all", F.col("token_start") + 1, F.col("token_end") - F.col("token_start"))
    return w.select(key, "token_start", "token_end", F.concat(ignored, inner, ignored).alias("labels"))


def span_rows(records: DataFrame, key: str = "id", spans: str = "spans") -> DataFrame:
    """``(key, start, end, label)``; null arrays and null spans give nothing."""
    return records.select(key, F.explode(spans).alias("x")).where("x is not null").select(key, "x.start", "x.end", "x.label")


def label_by_values(pages: DataFrame, values: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Spans ``(key, start, end, label)`` of a page's own values ``(key, value, label)``: the longest value first, whole words, no overlaps.

    Then persons, firms and addresses found by the notice grammar, and dates, each where nothing is labelled yet. Values travel with their page,
    one row a page.
    """
    from spanloom.operators.registry import grammar_spans, place_values

    ship(pages.sparkSession)
    packed = values.where("value is not null").groupBy(key).agg(F.collect_list(F.struct("value", "label")).alias("values"))
    j = pages.select(key, text).join(packed, key, "left")
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, vs in zip(b[key], b[text], b["values"]):
                if t:
                    spans = place_values(t, [(v["value"], v["label"]) for v in (vs if vs is not None else [])])
                    rows += [(k, *s) for s in grammar_spans(t, spans)]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "label"])

    return j.mapInPandas(run, f"`{key}` {kind}, start int, end int, label string")
