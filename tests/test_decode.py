"""Windows, scores and decoding against published vectors and plain Python."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import decode, scoring, tokenize, windows
from spanloom.spec import Biases, DecodeConfig, InvalidModel, ModelSpec, bioes_tags, parse_request, response

BIO = DecodeConfig("t", ("O",), {"PER": "PERSON", "LOC": "ADDRESS"}, 0.5)
TOKENS = "doc_id int, i int, start int, end int, word_id int, label string, p double"


def test_windows(spark):
    d = spark.createDataFrame([(1, 10), (2, 0), (3, 4)], "doc_id int, n_tokens int")
    got = {(r.doc_id, r.token_start, r.token_end, r.offset) for r in windows.windows(d, 6, 2, special=(100, 101)).collect()}
    assert got == {(1, 0, 4, 1), (1, 2, 6, 1), (1, 4, 8, 1), (1, 6, 10, 1), (3, 0, 4, 1)}
    got = [(r.token_start, r.token_end) for r in windows.windows(d.where("doc_id = 1"), 6, 2).collect()]
    assert got == [(0, 6), (4, 10)]


def test_window_counts(spark):
    params = [(w, s) for w in (3, 5, 8) for s in (0, 1, 4, 9)]
    for width, stride in params:
        rows = spark.range(1, 60).select(F.col("id").cast("int").alias("n")).select("n", windows.window_starts(F.col("n"), width, stride).alias("s")).collect()
        for r in rows:
            exp, step, at = [], max(width - stride, 1), 0
            while True:
                exp.append(at)
                if at + width >= r.n:
                    break
                at += step
            assert r.s == exp


def test_merge_logits(spark):
    d = spark.createDataFrame([(1, 10)], "doc_id int, n_tokens int")
    w = windows.windows(d, 6, 2)
    z = F.transform(F.sequence(F.lit(0), F.col("token_end") - F.col("token_start") - 1), lambda i: F.array((F.col("token_start") + i).cast("double"), F.col("token_start").cast("double")))
    tokens = spark.range(10).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("tok"))
    got = {r.tok: r.z for r in windows.merge_logits(w.withColumn("logits", z), tokens).collect()}
    assert got[5] == [5.0, 4.0] and got[2] == [2.0, 0.0]
    with pytest.raises(Exception, match="no window"):
        windows.merge_logits(w.withColumn("logits", z), tokens.union(tokens.select("doc_id", F.lit(77)))).collect()
    with pytest.raises(Exception, match="do not fit"):
        windows.merge_logits(w.withColumn("logits", F.slice(z, 1, 2)), tokens).collect()


def test_bio_vector(spark):
    t = spark.createDataFrame([(1, 0, 0, 1, 0, "B-PER", 0.9), (1, 1, 1, 2, 1, "I-PER", 0.8), (1, 2, 3, 8, 2, "B-LOC", 0.95)], TOKENS)
    docs = spark.createDataFrame([(1, "张三 Paris")], "doc_id int, text string")
    got = {(r.value, r.type) for r in decode.detections(decode.bio_spans(t, BIO), docs, BIO).collect()}
    assert got == {("张三", "PERSON"), ("Paris", "ADDRESS")}


def bio_by_hand(rows, config):
    out, cur, prev_word, label = [], None, None, "O"
    for _, i, s, e, w, lab, p in rows:
        cont = w is not None and w == prev_word
        prev_word = w
        if not cont:
            label = lab or "O"
        if label == "O":
            cur = None
            continue
        px, _, nm = label.partition("-")
        px, nm = (px, nm) if nm or "-" in label else ("B", label)
        if not (cur and cur[0] == nm and (px in "IE" or cont)):
            cur = [nm, s, e, []]
            out.append(cur)
        cur[1], cur[2] = min(cur[1], s), max(cur[2], e)
        if not cont and lab is not None:
            cur[3].append(p)
    res = set()
    for nm, s, e, ps in out:
        conf = sum(ps) / len(ps) if ps else 0.0
        if nm in config.label_map and conf >= config.threshold:
            res.add((config.label_map[nm], s, e, round(conf, 9)))
    return res


def test_bio_random(spark):
    rng = np.random.default_rng(3)
    rows, exp = [], {}
    for doc in range(200):
        seq, word = [], 0
        for i in range(int(rng.integers(0, 14))):
            word += int(rng.integers(0, 2))
            lab = [None, "O", "B-PER", "I-PER", "E-PER", "S-PER", "B-LOC", "I-LOC", "PER", "I-XXX"][rng.integers(0, 10)]
            seq.append((doc, i, i * 2, i * 2 + 1, None if rng.random() < 0.2 else word, lab, None if lab is None else float(rng.integers(1, 9)) / 8))
        rows += seq
        exp[doc] = bio_by_hand(seq, BIO)
    got = {d: set() for d in exp}
    for r in decode.bio_spans(spark.createDataFrame(rows, TOKENS), BIO).collect():
        got[r.doc_id].add((r.type, r.start, r.end, round(r.confidence, 9)))
    assert got == exp


LABELS = ("O", "B-person", "I-person", "E-person", "S-person", "B-secret", "I-secret", "E-secret", "S-secret")
VIT = DecodeConfig("v", LABELS, {"person": "PERSON"}, 0.0)


def run_viterbi(spark, text, m, biases=None):
    import re

    words = [x.span() for x in re.finditer(r"\S+", text)]
    d = spark.createDataFrame([(1, m)], "doc_id int, m array<array<double>>")
    lab = decode.viterbi_labels(d, LABELS, biases).collect()
    native = d.select(decode.viterbi_native(F.col("m"), LABELS, biases).alias("p")).first().p
    assert [LABELS[k] for k in native] == [r.label for r in sorted(lab, key=lambda r: r.i)]
    rows = [(1, r.i, *words[r.i], None, r.label, r.p) for r in lab]
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return sorted(r.value for r in decode.detections(decode.bio_spans(spark.createDataFrame(rows, TOKENS), VIT), docs, VIT).collect())


def one_hot(ks, v=4.0):
    return [[v if j == k else 0.0 for j in range(9)] for k in ks]


def test_viterbi_vectors(spark):
    assert run_viterbi(spark, "Ana María Ruiz y Bo usan sk-1", one_hot([1, 2, 3, 0, 4, 0, 8])) == ["Ana María Ruiz", "Bo"]
    m = one_hot([0, 2, 0, 0])
    m[1][4] = 3.5
    assert run_viterbi(spark, "x Ana Ruiz y", m) == ["Ana"]
    m = one_hot([0, 0, 0])
    m[1] = [1.0, -5.0, -5.0, -5.0, 0.6, -5.0, -5.0, -5.0, -5.0]
    assert run_viterbi(spark, "x Ana y", m) == []
    assert run_viterbi(spark, "x Ana y", m, Biases(background_to_start=1.0)) == ["Ana"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=5, max_size=5), min_size=1, max_size=4))
def test_viterbi_beats_every_path(m):
    import itertools

    labels = ("O", "B-x", "I-x", "E-x", "S-x")
    z = np.array(m, dtype=float)
    moves = decode.transitions(labels, Biases())
    starts, ends = np.array([1, 1, 0, 0, 1], bool), np.array([1, 0, 0, 1, 1], bool)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def score(p):
        if not starts[p[0]] or not ends[p[-1]]:
            return -np.inf
        return sum(logp[t][k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))

    best = max(score(p) for p in itertools.product(range(5), repeat=len(m)))
    assert abs(score(decode.viterbi_path(z, moves, starts, ends)) - best) < 1e-9


def test_nan_is_refused():
    with pytest.raises(ValueError):
        decode.viterbi_path(np.array([[np.nan, 0.0]]), np.zeros((2, 2)), np.array([True, True]), np.array([True, True]))


def test_prediction(spark):
    d = spark.createDataFrame([(1, [1.0, 3.0, 3.0]), (2, [])], "k int, z array<double>")
    got = {r.k: r.p for r in d.select("k", scoring.prediction(F.col("z")).alias("p")).collect()}
    assert got[1].label == 1 and abs(got[1].probability - 1 / (2 + np.exp(-2))) < 1e-12 and got[2] is None


def test_bioes_labels():
    assert bioes_tags(("O", "S-x")) == [("O", ""), ("S", "x")]
    for bad in (("O", "PER"), ("O", "B-")):
        with pytest.raises(InvalidModel):
            bioes_tags(bad)


def model(**change):
    import json

    raw = {"name": "m", "model": "m.onnx", "tokenizer": {"kind": "wordpiece", "file": "t"}, "labels": ["O", "S-x"], "labelMap": {}, "maxTokens": 8, "stride": 2, "threshold": 0.5, "padId": 3}
    return json.dumps(raw | change)


def test_spec():
    s = ModelSpec.from_json(model())
    assert s.decoder == "bio" and ModelSpec.from_json(s.to_json()) == s
    v = ModelSpec.from_json(model(decoder={"kind": "bioes-viterbi", "biases": {"endToStart": 1.5}}))
    assert v.biases.end_to_start == 1.5 and ModelSpec.from_json(v.to_json()) == v
    for change, word in [({"tokenizer": {"kind": "bpe", "file": "t"}}, "bpe"), ({"decoder": {"kind": "bioes-viterbi", "biases": {"backgroundStays": 1}}}, "backgroundStays"),
                         ({"decoder": {"kind": "bioes-viterbi"}, "labels": ["O", "DATE"]}, "DATE"), ({"maxTokens": 2}, "maxTokens"), ({"labels": []}, "labels")]:
        with pytest.raises(InvalidModel, match=word):
            ModelSpec.from_json(model(**change))
    assert parse_request('{"schema_version":1,"text":"a"}') == "a" and '"schema_version": 1' in response([])
    for bad in ('{"schema_version":2,"text":"a"}', "[]", "{", '{"schema_version":1}'):
        with pytest.raises(ValueError):
            parse_request(bad)


def test_realign_vector():
    text = "37,8\r\nºC y Dr. Tomás"
    pieces = ["▁3", "7,8", "▁o", "C", "▁y", "▁Dr", ".", "▁Tomás"]
    starts, ends = tokenize.realign(text, pieces)
    assert [text[a:b] for a, b in zip(starts, ends)] == ["3", "7,8", "\r\nº", "C", " y", " Dr", ".", " Tomás"]


@settings(max_examples=80, deadline=None)
@given(st.text("ab ºé", max_size=12), st.lists(st.text("▁abx", min_size=1, max_size=3), max_size=6))
def test_realign_keeps_order(text, pieces):
    starts, ends = tokenize.realign(text, pieces)
    assert all(0 <= a <= b <= len(text) for a, b in zip(starts, ends))
    assert starts == sorted(starts)


def test_word_ids_agree(spark):
    text = "张三 a-b cd，エ 가 x"
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = tokenize.word_ids_native(tokenize.word_rows(d)).orderBy("i").collect()
    assert [r.word_id for r in rows] == tokenize.piece_word_ids(text, [r.start for r in rows], [r.end for r in rows])
    assert all(text[r.start : r.end] == r.piece for r in rows)


def test_encode_bytelevel(spark):
    source = open("/opt/tokenizers/byte_bpe_50k.json", encoding="utf8").read()
    text = "张三 😀 met Élodie, alice@example.com"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    e = tokenize.encode(d, source, "bytelevel")
    got = {r.doc_id: r.encoding for r in e.collect()}
    assert got[2] is None and got[3].ids == [] and got[1].starts[0] == 0 and got[1].ends[-1] == len(text)
    bad = e.where("encoding is not null").select(tokenize.encoding_errors(F.col("encoding"), F.col("text")).alias("x")).collect()
    assert all(r.x == [] for r in bad)
    assert tokenize.special_ids(tokenize.load_tokenizer(source)) is None


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | 128 * bool(n)])
        if not n:
            return out


def field(no, payload):
    return varint(no << 3 | 2) + varint(len(payload)) + payload if isinstance(payload, bytes) else varint(no << 3) + varint(payload)


def gather_model(table):
    """``logits = table[input_ids]`` as an ONNX graph, written by hand."""
    def value(name, kind, dims):
        shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    t = np.array(table, dtype=np.float32)
    init = b"".join(field(1, d) for d in t.shape) + field(2, 1) + field(8, b"W") + field(9, t.tobytes())
    node = field(1, b"W") + field(1, b"input_ids") + field(2, b"logits") + field(4, b"Gather")
    graph = field(1, node) + field(2, b"g") + field(5, init) + field(11, value(b"input_ids", 7, [1, b"n"])) + field(12, value(b"logits", 1, [1, b"n", t.shape[1]]))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_onnx_scorer(spark):
    table = [[0.0, 1.0], [2.0, 0.5], [3.0, 4.0]]
    model_bytes = gather_model(table)
    d = spark.createDataFrame([(1, [0, 2, 1])], "doc_id int, ids array<bigint>")
    w = windows.window_inputs(d, 8, 2)
    got = scoring.score_windows(w, lambda: scoring.OnnxScorer(model_bytes), 2, "gather").first().logits
    assert got == [table[0], table[2], table[1]]
    with pytest.raises(Exception, match="labels"):
        scoring.score_windows(w, lambda: scoring.OnnxScorer(model_bytes), 3, "gather3").collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], TOKENS)
    assert decode.bio_spans(none, BIO).count() == 0
    assert tokenize.word_rows(spark.createDataFrame([], "doc_id int, text string")).count() == 0
