"""Detection in one pass over the documents, against the operators on long token tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import byte_offset, utf16_offset
from spanloom.operators import decode, detect, scoring, tokenize, windows
from spanloom.plans import catalog
from spanloom.spec import ModelSpec

BIO = ("O", "B-PER", "I-PER", "B-LOC", "I-LOC", "E-XX", "LOC")
BIOES = ("O", "B-PER", "I-PER", "E-PER", "S-PER", "B-LOC", "I-LOC", "E-LOC", "S-LOC")


def tokens_stay_in_their_batch(df):
    """No token is exchanged, sorted or joined; the documents may be dealt to more tasks."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("Join", "Aggregate", "Window", "Sort", "Generate") if x in plan] and plan.count("Repartition") <= 1, plan


def test_detect_words_is_map_only(spark, data):
    tokens_stay_in_their_batch(catalog.detect_words(spark, data))


def by_long_tables(enc, docs, spec, special, make, unit):
    """Windows, scores, merge and decoding as tables of tokens."""
    w = windows.window_inputs(enc.select("doc_id", "encoding.ids"), spec.max_tokens, spec.stride, "ids", special)
    scored = scoring.score_windows(w.drop("ids"), make, len(spec.labels), spec.name)
    tokens = tokenize.token_rows(enc).withColumnRenamed("i", "tok")
    if spec.decoder == "bio":
        names = F.array(*map(F.lit, spec.labels))
        t = windows.merge_predictions(scored, tokens).select("doc_id", F.col("tok").alias("i"), "start", "end", "word_id", F.get(names, F.col("label")).alias("label"), F.col("probability").alias("p"))
    else:
        rows = windows.merge_logits(scored, tokens).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok", "z"))), lambda x: x["z"]).alias("m"))
        t = tokens.select("doc_id", F.col("tok").alias("i"), "start", "end").join(decode.viterbi_labels(rows, spec.labels, spec.biases), ["doc_id", "i"]).withColumn("word_id", F.lit(None).cast("int"))
    found = decode.detections(decode.bio_spans(t, spec.decode_config()), docs, spec.decode_config())
    if unit != "char":
        f = {"byte": byte_offset, "utf16": utf16_offset}[unit]
        found = found.join(docs, "doc_id").withColumn("start", f("text", "start")).withColumn("end", f("text", "end")).drop("text")
    return found


@pytest.mark.parametrize("labels,decoder,unit,special", [(BIO, "bio", "byte", (1, 2)), (BIO, "bio", "char", None), (BIOES, "bioes-viterbi", "utf16", (1, 2))])
def test_one_pass_agrees_with_long_tables(spark, labels, decoder, unit, special):
    rng, rows = np.random.default_rng(5), []
    for doc in range(60):
        text = "".join(rng.choice(list("ab éß张😀\n　"), int(rng.integers(1, 90))))
        cuts = sorted({0, len(text), *rng.integers(0, len(text), int(rng.integers(0, 60))).tolist()}) if doc % 9 else [0]
        words = np.cumsum(rng.integers(0, 2, len(cuts))).tolist()
        ids = rng.integers(0, 5000, len(cuts)).tolist()
        rows.append((doc if doc else None, text, (ids[1:], cuts[:-1], cuts[1:], [None if w % 5 == 4 else w for w in words[1:]])))
    d = spark.createDataFrame(rows, "doc_id int, text string, encoding struct<ids:array<bigint>,starts:array<int>,ends:array<int>,word_ids:array<int>>")
    name = f"t-{decoder}-{unit}"
    spec = ModelSpec(name, "none", "bytelevel", "none", labels, {"PER": "PERSON", "LOC": "ADDRESS"}, 12, 3, 0.5, False, decoder)
    make = lambda: catalog.PlacedScorer(len(labels))
    row = lambda r: (r.doc_id, r.type, r.value, r.start, r.end, round(r.confidence, 9), r.detector, r.source, r.enabled)
    exp = by_long_tables(d.where("size(encoding.ids) > 0"), d.select("doc_id", "text"), spec, special, make, unit)
    got = detect.detect_encoded(d, spec, special, make, offset_unit=unit)
    assert got.columns == exp.columns and sorted(map(row, got.collect())) == sorted(map(row, exp.collect())) != []


def test_words_in_one_pass(spark):
    texts = [(1, "Ana-María, y  😀 Bo"), (2, None), (3, ""), (4, " \n　"), (5, "a"), (6, "x" * 50 + " é" * 40)]
    d = spark.createDataFrame(texts, "doc_id int, text string")
    rows = {}
    for r in tokenize.word_rows(d).orderBy("doc_id", "i").collect():
        rows.setdefault(r.doc_id, []).append((catalog.word_token_id(__import__("pyarrow").array([r.piece])).to_pylist()[0], r.start, r.end, r.i))
    runs = d.select("doc_id", tokenize.word_runs("text").alias("runs"))
    enc = runs.mapInArrow(tokenize.word_encoder(catalog.word_token_id), f"doc_id int, encoding struct<{tokenize.ENCODING.replace(' array', ':array')}>")
    got = {r.doc_id: list(zip(r.encoding.ids, r.encoding.starts, r.encoding.ends, r.encoding.word_ids)) for r in enc.collect()}
    assert got == {k: rows.get(k, []) for k, _ in texts}


def test_slices_keep_every_row():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(7))], names=["k"])
    parts = [p.column(0).to_pylist() for p in tokenize.slices(b, np.array([3, 0, 9, 1, 1, 0, 2]), 4)]
    assert parts == [[0, 1], [2], [3, 4, 5, 6]]


def test_detect_pipeline_is_map_only(spark, data):
    df = catalog.detect_pipeline(spark, data)
    tokens_stay_in_their_batch(df)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_encodings_in_parts(spark):
    source = open("/opt/tokenizers/byte_bpe_50k.json", encoding="utf8").read()
    t = tokenize.load_tokenizer(source)
    texts = ["张三 😀 met Élodie", None, "", "word " * 40_000, "a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    for r in tokenize.encode(rows, source, "bytelevel").collect():
        if r.text is None:
            assert r.encoding is None
            continue
        e = t.encode(r.text, add_special_tokens=False)
        assert (r.encoding.ids, list(zip(r.encoding.starts, r.encoding.ends)), r.encoding.word_ids) == (e.ids, e.offsets, e.word_ids)


def test_bad_encodings_are_refused():
    import pyarrow as pa

    def batch(text, starts, ends):
        enc = pa.array([{"ids": [1] * len(starts), "starts": starts, "ends": ends, "word_ids": [0] * len(starts)}], tokenize.ENCODED)
        return pa.RecordBatch.from_arrays([pa.array([text]), enc], names=["text", "encoding"])

    tokenize.refuse_errors(batch("é😀", [0, 1], [1, 2]), "text")
    for starts, ends in (([0, -1], [1, 2]), ([0, 2], [1, 1]), ([0, 1], [1, 3])):
        with pytest.raises(ValueError, match="out of order"):
            tokenize.refuse_errors(batch("é😀", starts, ends), "text")
