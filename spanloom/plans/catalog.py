"""Named queries over the whole test tables and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import identifiers as ids
from spanloom.functions import text as tx
from spanloom.operators import align, decode, detect, generate, intent, isolation, markup, neardup, registry, sampling, scorecard, scoring, tokenize, windows
from spanloom.session import once, spread, table
from spanloom.sources.files import build_report
from spanloom.spec import Biases, DecodeConfig, ModelSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin where there is one."""
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def clean(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(c))), F.lit("unknown"))


# -- tokens to detections -----------------------------------------------------------------------------------------------------------------

#: A word of four letters or more with a capital begins or goes on with a name; any other word is background.
CASE_CONFIG = DecodeConfig("case", ("O", "B-NAME", "I-NAME"), {"NAME": "PERSON"}, 0.5)

WORDS_SQL = r"""
words_ AS (
    SELECT doc_id, generate_subscripts(runs, 1) AS pos, unnest(runs) AS run FROM (
        SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS runs FROM documents WHERE text IS NOT NULL)
),
placed AS (
    SELECT *, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop,
        regexp_replace(run, '^[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{0b}]+', '') AS cut FROM words_
),
trimmed AS (SELECT *, regexp_replace(cut, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{0b}]+$', '') AS piece FROM placed),
toks AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, piece,
        (stop - length(run) + length(run) - length(cut))::INT AS s, (stop - length(cut) + length(piece))::INT AS e
    FROM trimmed WHERE piece <> ''
)
"""


def case_tokens(docs: DataFrame) -> DataFrame:
    """Word tokens with a label by letter case and a probability by length: a scorer that SQL can follow."""
    t = tokenize.word_rows(docs)
    name = F.col("piece").rlike(r"^\p{Lu}\p{L}{3,}$")
    label = F.when(name, F.when(F.length("piece") % 3 == 0, "I-NAME").otherwise("B-NAME")).otherwise("O")
    return t.withColumn("label", label).withColumn("p", F.when(F.length("piece") % 5 == 0, 0.25).otherwise(0.75)).withColumn("word_id", F.col("i"))


@query(
    "WITH " + WORDS_SQL + r""", lab AS (
    SELECT *, CASE WHEN regexp_matches(piece, '^\p{Lu}\p{L}{3,}$') THEN CASE WHEN length(piece) % 3 = 0 THEN 'I' ELSE 'B' END END AS px,
        CASE WHEN length(piece) % 5 = 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS p FROM toks),
    isl AS (SELECT *, sum(CASE WHEN px IS NULL THEN 0 WHEN prev IS NOT NULL AND px = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
        SELECT *, lag(px) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM lab)),
    sp AS (SELECT doc_id, g, min(s) AS s, max(e) AS e, avg(p) AS conf FROM isl WHERE px IS NOT NULL GROUP BY ALL HAVING avg(p) >= 0.5)
    SELECT doc_id, 'PERSON' AS type, substring(d.text, s + 1, e - s) AS value, s AS start, e AS "end", conf AS confidence, 'ner:case' AS detector, 'model' AS source, true AS enabled
    FROM sp JOIN documents d USING (doc_id)"""
)
def bio_detections(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents")).select("doc_id", "text").where("text is not null")
    return decode.detections(decode.bio_spans(case_tokens(docs), CASE_CONFIG), docs, CASE_CONFIG)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return detect_words(spark, folder)


@query("WITH " + WORDS_SQL + "SELECT doc_id, i::INT AS i, s AS start, e AS \"end\", piece FROM toks")
def word_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.word_rows(spread(table(spark, folder, "documents")).where("text is not null"))


@query(
    "WITH " + WORDS_SQL + r""", k AS (SELECT *, regexp_matches(piece, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') OR NOT regexp_matches(piece, '[\p{L}\p{N}\x{900}-\x{903}\x{93a}\x{93b}\x{93e}-\x{94c}\x{94e}\x{94f}\x{955}-\x{957}\x{962}\x{963}\x{e31}\x{e34}-\x{e3a}\x{e4d}]') AS sa FROM toks)
    SELECT doc_id, i::INT AS i, sum(CASE WHEN psa IS NULL THEN 0 WHEN sa OR psa OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::INT AS word_id
    FROM (SELECT *, lag(sa) OVER (PARTITION BY doc_id ORDER BY i) AS psa, lag(e) OVER (PARTITION BY doc_id ORDER BY i) AS pe FROM k)"""
)
def word_ids(spark: SparkSession, folder: str) -> DataFrame:
    pieces = tokenize.word_rows(spread(table(spark, folder, "documents")).where("text is not null"))
    return tokenize.word_ids_native(pieces).select("doc_id", "i", "word_id")


@query(
    r"""WITH n AS (SELECT doc_id, length(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS n FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 254 THEN 1 ELSE ceil((n - 254) / 222.0)::INT + 1 END)) * 222 AS ws FROM n WHERE n > 0),
    t AS (SELECT doc_id, ws, least(ws + 254, n) AS we, unnest(range(ws, least(ws + 254, n))) AS tok FROM w)
    SELECT doc_id, ws::INT AS token_start, count(*) AS n_best FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, tok ORDER BY least(tok - ws, we - 1 - tok) DESC, ws) AS r FROM t) WHERE r = 1 GROUP BY ALL"""
)
def window_merge(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents")).where("text is not null").select("doc_id", F.size(tx.words("text")).alias("n_tokens"))
    w = windows.windows(docs, 256, 32, special=(100, 101)).withColumn("tok", F.explode(F.sequence(F.col("token_start"), F.col("token_end") - 1)))
    best = windows.best_window(w.withColumn("v", F.col("token_start")), "v")
    return best.groupBy("doc_id", "token_start").agg(F.count("*").alias("n_best"))


@query(
    """SELECT vec_id, (list_position(z, list_max(z)) - 1)::INT AS label, round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS probability
    FROM (SELECT vec_id, list_transform(embedding[1:9], lambda x: x::DOUBLE * 10) AS z FROM embeddings)"""
)
def softmax_argmax(spark: SparkSession, folder: str) -> DataFrame:
    z = F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double") * 10)
    p = scoring.prediction(F.col("z"))
    return table(spark, folder, "embeddings").select("vec_id", z.alias("z")).select("vec_id", p["label"].alias("label"), F.round(p["probability"], 6).alias("probability"))


VITERBI_LABELS = ("O", "B-X", "I-X", "E-X", "S-X")


def _sequences(spark: SparkSession, folder: str, n: int = 5) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double") * 10).alias("z"))
    e = e.groupBy(F.floor(F.col("vec_id") / 10).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "z"))).alias("s"))
    return e.select("doc_id", F.transform("s", lambda x: x["z"]).alias("m"))


VITERBI_SQL = """WITH RECURSIVE e AS (SELECT vec_id // 10 AS sid, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS t, list_transform(embedding[1:5], lambda x: x::DOUBLE * 10) AS z FROM embeddings),
    lp AS (SELECT sid, t, unnest(range(0, 5)) AS j, unnest(list_transform(z, lambda x: x - list_max(z) - ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z))))))) AS v FROM e),
    ok(i, j) AS (VALUES (0,0),(0,1),(0,4),(1,2),(1,3),(2,2),(2,3),(3,0),(3,1),(3,4),(4,0),(4,1),(4,4)),
    run AS (SELECT sid, t, j, v AS score, [j] AS path FROM lp WHERE t = 1 AND j IN (0, 1, 4)
        UNION ALL
        SELECT sid, t, j, score, path FROM (SELECT r.sid, r.t + 1 AS t, ok.j, r.score + lp.v AS score, list_append(r.path, ok.j) AS path,
            row_number() OVER (PARTITION BY r.sid, ok.j ORDER BY r.score DESC, r.j) AS k
            FROM run r JOIN ok ON ok.i = r.j JOIN lp ON lp.sid = r.sid AND lp.t = r.t + 1 AND lp.j = ok.j) WHERE k = 1),
    best AS (SELECT sid, path, row_number() OVER (PARTITION BY sid ORDER BY score DESC, j) AS k FROM run r WHERE t = (SELECT max(t) FROM e WHERE e.sid = r.sid) AND j IN (0, 3, 4))
    SELECT sid AS doc_id, array_to_string(path, ',') AS path FROM best WHERE k = 1"""


@query(VITERBI_SQL)
def viterbi_native(spark: SparkSession, folder: str) -> DataFrame:
    path = decode.viterbi_native(F.col("m"), VITERBI_LABELS)
    return _sequences(spark, folder).select("doc_id", F.array_join(path.cast("array<string>"), ",").alias("path"))


@query(VITERBI_SQL)
def viterbi_batched(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode.viterbi_labels(_sequences(spark, folder), VITERBI_LABELS)
    at = F.array_position(F.array(*map(F.lit, VITERBI_LABELS)), F.col("label")) - 1
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", at.alias("k")))).alias("s"))
    return g.select("doc_id", F.array_join(F.transform("s", lambda x: x["k"].cast("string")), ",").alias("path"))


BIASED_LABELS = ("O", "B-X", "I-X", "E-X", "S-X", "B-Y", "I-Y", "E-Y", "S-Y")
BIASES = Biases(0.25, -0.5, 0.125, -0.25, 0.5, -0.125)


def viterbi_sql(labels: tuple[str, ...], biases: Biases) -> str:
    moves = decode.transitions(labels, biases)
    k = len(labels)
    ok = ", ".join(f"({i}, {j}, {moves[i, j]}::DOUBLE)" for i in range(k) for j in range(k) if moves[i, j] > -1e9)
    begin, end = (", ".join(str(i) for i, x in enumerate(labels) if x[0] in tags) for tags in ("OBS", "OES"))
    out = VITERBI_SQL.replace("embedding[1:5]", f"embedding[1:{k}]").replace("range(0, 5)", f"range(0, {k})").replace("j IN (0, 1, 4)", f"j IN ({begin})").replace("j IN (0, 3, 4)", f"j IN ({end})")
    at, to = out.index("ok(i, j) AS (VALUES "), out.index("),\n    run AS")
    return (out[:at] + "ok(i, j, b) AS (VALUES " + ok + out[to:]).replace("r.score + lp.v AS score", "r.score + ok.b + lp.v AS score").replace("ORDER BY r.score DESC, r.j", "ORDER BY r.score + ok.b DESC, r.j")


@query(viterbi_sql(BIASED_LABELS, BIASES))
def viterbi_biased(spark: SparkSession, folder: str) -> DataFrame:
    """Two kinds of entity and a bias on every move."""
    rows = decode.viterbi_labels(_sequences(spark, folder, len(BIASED_LABELS)), BIASED_LABELS, BIASES)
    at = F.array_position(F.array(*map(F.lit, BIASED_LABELS)), F.col("label")) - 1
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", at.alias("k")))).alias("s"))
    return g.select("doc_id", F.array_join(F.transform("s", lambda x: x["k"].cast("string")), ",").alias("path"))


class HashScorer:
    """Scores by a hash of the token id: stands in where no weights are at hand."""

    def __init__(self, n_labels: int):
        self.n = n_labels

    def score(self, ids_, mask):
        import numpy as np

        h = (ids_[:, None] * 2654435761 + np.arange(self.n)[None, :] * 40503) % 1009
        return h / 100.0


BYTE_SPEC = ModelSpec("hash", "none", "bytelevel", "byte_bpe_50k.json", ("O", "B-PER", "I-PER", "B-LOC", "I-LOC"), {"PER": "PERSON", "LOC": "ADDRESS"}, 256, 32, 0.5, True)


@query()
def detect_pipeline(spark: SparkSession, folder: str, tokenizers: str = "/opt/tokenizers") -> DataFrame:
    """The whole pipeline with a byte-level tokenizer of 50,257 pieces."""
    with open(f"{tokenizers}/byte_bpe_50k.json", encoding="utf8") as f:
        source = f.read()
    return detect.detect(table(spark, folder, "documents"), BYTE_SPEC, source, lambda: HashScorer(5), offset_unit="byte")


class PlacedScorer(HashScorer):
    """Scores that depend on a token's place in its window, too, so that it matters which window's are kept."""

    def score(self, ids_, mask):
        import numpy as np

        return (ids_[:, None] * 2654435761 + np.arange(self.n)[None, :] * 40503 + np.arange(len(ids_))[:, None] * 7919) % 1009 / 100.0


def word_token_id(pieces):
    """The id of a word: its length and its first character."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    first = pc.utf8_slice_codeunits(pieces, 0, 1).dictionary_encode()
    points = np.array([ord(x) for x in first.dictionary.to_pylist()], dtype=np.int64)
    return pa.array(pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) * 131 + points[first.indices.to_numpy(zero_copy_only=False)], pa.int64())


WORD_SPEC = ModelSpec("words", "none", "bytelevel", "none", ("O", "B-PER", "I-PER", "B-LOC", "I-LOC"), {"PER": "PERSON", "LOC": "ADDRESS"}, 256, 32, 0.5, True)
TITLED_SQL = r"""train_docs AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\p{L}+|[^\p{L}]+'),
    lambda x: CASE WHEN regexp_matches(x, '^\p{L}{4,}$') AND NOT regexp_matches(x, '\p{Ll}') AND strlen(x[1] || lower(x[2:])) = strlen(x) THEN x[1] || lower(x[2:]) ELSE x END), '') AS text FROM documents WHERE text <> '')"""


@query(
    "WITH " + TITLED_SQL + ", " + WORDS_SQL.replace("FROM documents", "FROM train_docs") + r""",
    n AS (SELECT doc_id, max(i) + 1 AS n FROM toks GROUP BY doc_id),
    win AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 254 THEN 1 ELSE ceil((n - 254) / 222.0)::INT + 1 END)) * 222 AS ws FROM n),
    place AS (SELECT doc_id, i, i - ws + 1 AS pos FROM (SELECT w.doc_id, t.i, w.ws, row_number() OVER (PARTITION BY t.doc_id, t.i ORDER BY least(t.i - ws, least(ws + 254, n) - 1 - t.i) DESC, ws) AS r
        FROM win w JOIN toks t ON t.doc_id = w.doc_id AND t.i >= ws AND t.i < least(ws + 254, n)) WHERE r = 1),
    z AS (SELECT t.doc_id, t.i, t.s, t.e, list_transform([0, 1, 2, 3, 4], lambda j: (((length(piece) * 131 + unicode(piece)) * 2654435761 + j * 40503 + pos * 7919) % 1009) / 100.0::DOUBLE) AS z FROM toks t JOIN place USING (doc_id, i)),
    lab AS (SELECT *, ['O', 'B-PER', 'I-PER', 'B-LOC', 'I-LOC'][list_position(z, list_max(z))] AS lab, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS p FROM z),
    nm AS (SELECT *, CASE WHEN lab <> 'O' THEN lab[3:] END AS name, lab[1] AS prefix FROM lab),
    isl AS (SELECT *, sum(CASE WHEN name IS NULL THEN 0 WHEN name = before AND prefix = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(name) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM nm)),
    sp AS (SELECT doc_id, name, g, min(s) AS s, max(e) AS e, avg(p) AS conf FROM isl WHERE name IS NOT NULL GROUP BY ALL HAVING avg(p) >= 0.5)
    SELECT doc_id, CASE name WHEN 'PER' THEN 'PERSON' ELSE 'ADDRESS' END AS type, md5(substring(d.text, s + 1, e - s)) AS value, strlen(substring(d.text, 1, s))::INT AS start, strlen(substring(d.text, 1, e))::INT AS "end",
        round(conf, 6) AS confidence, 'ner:words' AS detector FROM sp JOIN documents d USING (doc_id)"""
)
def detect_words(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline on word tokens, which SQL can follow: casing, windows, scores, the best window of each token, spans, values, byte offsets."""
    docs = spread(table(spark, folder, "documents")).select("doc_id", "text").where("text <> ''")
    docs = detect.model_text(docs, WORD_SPEC, "seen").select("doc_id", "text", tokenize.word_runs("seen").alias("runs"))
    found = detect.detect_encoded(docs, WORD_SPEC, (1, 2), lambda: PlacedScorer(5), offset_unit="byte", encoder=tokenize.word_encoder(word_token_id))
    return found.select("doc_id", "type", F.md5("value").alias("value"), "start", "end", F.round("confidence", 6).alias("confidence"), "detector")


# -- text ---------------------------------------------------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, md5(t) AS digest, strlen(t)::INT AS n_bytes FROM (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\p{L}+|[^\p{L}]+'),
        lambda x: CASE WHEN regexp_matches(x, '^\p{L}{4,}$') AND NOT regexp_matches(x, '\p{Ll}') AND strlen(x[1] || lower(x[2:])) = strlen(x) THEN x[1] || lower(x[2:]) ELSE x END), '') AS t FROM documents WHERE text IS NOT NULL)"""
)
def title_case(spark: SparkSession, folder: str) -> DataFrame:
    t = spread(table(spark, folder, "documents")).where("text is not null").select("doc_id", tx.title_cased("text").alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.octet_length("t").alias("n_bytes"))


SPANS_SQL = "SELECT id, text, s FROM (SELECT id, text, unnest(spans) AS s FROM (SELECT id, any_value(text) AS text, any_value(spans) AS spans FROM train GROUP BY id)) WHERE s IS NOT NULL"


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "train").dropDuplicates(["id"])


@query(
    r"""SELECT id, s.start AS start, s."end" AS "end", strlen(substring(text, 1, s.start))::INT AS start_byte, strlen(substring(text, 1, s."end"))::INT AS end_byte,
        (s."end" + length(regexp_extract_all(substring(text, 1, s."end"), '[\x{10000}-\x{10FFFF}]')))::INT AS end_utf16 FROM (""" + SPANS_SQL + ") WHERE text IS NOT NULL"
)
def span_offsets(spark: SparkSession, folder: str) -> DataFrame:
    r = _train(spark, folder).where("text is not null")
    s = r.select("id", "text", F.explode("spans").alias("x")).where("x is not null").select("id", "text", "x.start", "x.end")
    return s.select("id", "start", "end", tx.byte_offset("text", "start").alias("start_byte"), tx.byte_offset("text", "end").alias("end_byte"), tx.utf16_offset("text", "end").alias("end_utf16"))


PAGE = ("<html><style>p { margin: 0 }</style><h1>", "</h1><p>", "</p><script>var x = '</p>';</script><ul><li>A &amp; B</li></ul></html>")


@query(
    r"""WITH p AS (SELECT doc_id, '<html><style>p { margin: 0 }</style><h1>' || coalesce(doctype, '') || '</h1><p>' || replace(text, chr(10), '<br/>') ||
        '</p><script>var x = ''</p>'';</script><ul><li>A &amp; B</li></ul></html>' AS h FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<script[\s\S]*?</script>|<style[\s\S]*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>|</tr>|</dd>|</dt>|</h\d>|</li>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&', 'g') AS x FROM p),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), ' ([,.;:)])', '\1', 'g'), '\n{2,}', chr(10), 'g') AS x FROM a)
    SELECT doc_id, md5(regexp_replace(regexp_replace(x, '^[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+', ''), '[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+$', '')) AS digest FROM b"""
)
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    html = F.concat(F.lit(PAGE[0]), F.coalesce("doctype", F.lit("")), F.lit(PAGE[1]), F.replace("text", F.lit("\n"), F.lit("<br/>")), F.lit(PAGE[2]))
    return spread(table(spark, folder, "documents")).where("text is not null").select("doc_id", F.md5(tx.strip_tags(html)).alias("digest"))


@query(
    r"""SELECT k AS norm_digest, id, n FROM (SELECT md5(trim(regexp_replace(lower(instruction), '[^\p{L}\p{N}]+', ' ', 'g'))) AS k, min(id) AS id, count(*) AS n FROM intent_cases WHERE instruction IS NOT NULL GROUP BY 1)"""
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "intent_cases").where("instruction is not null").select("id", F.md5(tx.norm("instruction")).alias("k"))
    return sampling.first_of(c, "k", ["id"]).join(c.groupBy("k").agg(F.count("*").alias("n")), "k").select(F.col("k").alias("norm_digest"), "id", "n")


@query()
def residual_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names left unlabelled in announcements, and why a record would be dropped."""
    r = _train(spark, folder).where((clean("source") == "registry") & F.col("text").isNotNull())
    free = tx.residual_names(markup.unlabelled_text("text", "spans"), registry.BOILERPLATE)
    return markup.assemble(r, free).select("id", F.size(free).alias("n_residual"), "reason")


# -- isolation ----------------------------------------------------------------------------------------------------------------------------

SHINGLES_SQL = r"""
t AS (SELECT id, lower(trim(any_value(source))) AS source, any_value(text) AS text FROM train GROUP BY id),
tw AS (SELECT id, source, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM t WHERE text IS NOT NULL),
bw AS (SELECT regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM test_cases WHERE text IS NOT NULL),
ts AS (SELECT DISTINCT id, source, unnest(list_transform(range(1, length(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM tw WHERE length(w) >= 8),
bs AS (SELECT DISTINCT unnest(list_transform(range(1, length(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM bw WHERE length(w) >= 8),
shared AS (SELECT id, any_value(source) AS source, count(*) AS n FROM ts JOIN bs USING (g) GROUP BY id)
"""
NAMES_SQL = (
    r"""
names AS (SELECT DISTINCT name FROM (SELECT lower(e.value) AS name, regexp_extract_all(replace(lower(e.value), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w
    FROM (SELECT unnest(expected) AS e FROM test_cases) WHERE e.type IN ('PERSON', 'COMPANY')) WHERE length(w) >= 2 AND length(list_filter(w, lambda x: NOT list_contains(["""
    + ", ".join(f"'{w}'" for w in isolation.GENERIC_WORDS)
    + r"""], x))) > 0),
named AS (SELECT DISTINCT id, name FROM t JOIN names ON contains(lower(text), name)
    WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])' || regexp_escape(name) || '($|[^\p{L}\p{N}])'))
"""
)


@query("WITH " + SHINGLES_SQL + "SELECT id, n AS n_shared FROM shared WHERE n > 3")
def shared_runs(spark: SparkSession, folder: str) -> DataFrame:
    return isolation.shared_runs(_train(spark, folder), table(spark, folder, "test_cases"), key="id")


@query("WITH " + SHINGLES_SQL + "," + NAMES_SQL + "SELECT id, name FROM named")
def test_names_found(spark: SparkSession, folder: str) -> DataFrame:
    return isolation.names_in(_train(spark, folder), isolation.test_names(table(spark, folder, "test_cases")), key="id")


@query(
    "WITH " + SHINGLES_SQL + "," + NAMES_SQL + """SELECT id, 'id' AS kind, id AS detail FROM t WHERE id IN (SELECT case_id FROM test_cases)
    UNION ALL SELECT id, 'name', name FROM named
    UNION ALL SELECT id, 'runs', n::VARCHAR FROM shared WHERE n > CASE WHEN source = 'registry' THEN 25 ELSE 3 END"""
)
def violations(spark: SparkSession, folder: str) -> DataFrame:
    return isolation.violations(table(spark, folder, "train"), table(spark, folder, "test_cases"))


@query(
    r"""WITH v AS (SELECT DISTINCT trim(author) AS value FROM source_files WHERE author IS NOT NULL), parts AS (SELECT lower(value) AS part FROM v
    UNION SELECT unnest(regexp_split_to_array(lower(value), '\s+')) FROM v WHERE length(regexp_split_to_array(value, '\s+')) BETWEEN 2 AND 4 AND NOT regexp_matches(value, '\d')
        AND length(list_filter(regexp_split_to_array(value, '\s+'), lambda x: NOT regexp_matches(x, '^\p{Lu}'))) = 0)
    SELECT part FROM parts WHERE part <> ''"""
)
def blocked_values(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "source_files").where("author is not null").select(F.trim("author").alias("value")).distinct()
    return isolation.generator_values(v)


@query(
    "WITH " + SHINGLES_SQL + "," + NAMES_SQL + "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) NOT IN (SELECT name FROM names)"
)
def unblocked_names(spark: SparkSession, folder: str) -> DataFrame:
    names = isolation.test_names(table(spark, folder, "test_cases"))
    return isolation.unblocked(table(spark, folder, "customer").select("c_custkey", "c_name"), names, "c_name", "name")


@query()
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Training instructions close to a held-out one; brute force checks it in the tests."""
    return neardup.close_to(table(spark, folder, "intent_cases"), table(spark, folder, "shots"))


# -- sampling and reports -------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(id), id) <= greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 0.1::DOUBLE, 0)) AS in_dev
    FROM (SELECT id, min(coalesce(lower(split_part(split_part(trim(lang), '-', 1), '_', 1)), 'unknown')) AS lang FROM intent_cases WHERE id IS NOT NULL GROUP BY id)"""
)
def dev_split(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.coalesce(F.lower(F.regexp_replace(F.trim("lang"), "[-_].*$", "")), F.lit("unknown"))
    c = table(spark, folder, "intent_cases").where("id is not null").groupBy("id").agg(F.min(lang).alias("lang"))
    return sampling.dev_split(c, 0.1, "id", "lang")


@query(
    """SELECT file_id, doctype, n > 3 AND r <= CASE WHEN n > 3 THEN greatest(1, round_even(n * 0.1::DOUBLE, 0)) ELSE 0 END AS in_dev FROM (
    SELECT file_id, doctype, count(*) OVER (PARTITION BY doctype) AS n, row_number() OVER (PARTITION BY doctype ORDER BY md5(file_id), file_id) AS r FROM source_files)"""
)
def file_split(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.dev_split(table(spark, folder, "source_files").select("file_id", "doctype"), 0.1, "file_id", "doctype", more_than=3)


@query(
    """SELECT id, source, n FROM (SELECT id, source, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5(id), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT id, coalesce(lower(trim(any_value(source))), 'unknown') AS source, coalesce(length(any_value(text)), 0) AS n FROM train GROUP BY id)) WHERE before < 100000"""
)
def share_quota(spark: SparkSession, folder: str) -> DataFrame:
    r = _train(spark, folder).select("id", clean("source").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
    return sampling.quota(r, "n", F.lit(100_000), [F.md5("id"), "id"], ["source"])


@query(
    """WITH g AS (SELECT lower(trim(source)) AS source, regexp_replace(coalesce(lower(trim(lang)), 'unknown'), '[-_].*$', '') AS lang, count(DISTINCT id)::DOUBLE AS n FROM train GROUP BY ALL),
    h AS (SELECT lang, least(sum(CASE WHEN source = 'registry' THEN n ELSE 0 END), 10000 * 0.25::DOUBLE) AS reg FROM g GROUP BY lang)
    SELECT lang, unnest(['registry', 'document', 'template']) AS source, unnest([reg, 1500::DOUBLE, 10000 - reg - 1500::DOUBLE]) AS goal FROM h"""
)
def mix_goals(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.regexp_replace(clean("lang"), "[-_].*$", "")
    have = _train(spark, folder).groupBy(lang.alias("lang"), clean("source").alias("source")).agg(F.count("*").alias("n"))
    return sampling.mix_goals(have, 30_000)


@query(
    """WITH p AS (SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS k, count(*) OVER () AS n FROM source_files)
    SELECT o_orderkey, file_id FROM orders JOIN p ON o_orderkey % n = k"""
)
def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.round_robin(table(spark, folder, "orders").select("o_orderkey"), table(spark, folder, "source_files").select("file_id"), "o_orderkey", "file_id")


@query("SELECT id, count(*) AS n FROM train GROUP BY id HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.repeated(table(spark, folder, "train"), "id")


@query(
    """WITH g AS (SELECT source, lang, country, sum(n) / 900.0::DOUBLE AS chunks FROM (SELECT any_value(coalesce(lower(trim(source)), 'unknown')) AS source, any_value(regexp_replace(coalesce(lower(trim(lang)), 'unknown'), '[-_].*$', '')) AS lang,
        any_value(country) AS country, coalesce(length(any_value(text)), 0) AS n FROM train GROUP BY id) GROUP BY ALL)
    SELECT source, lang, country, round(chunks, 3) AS chunks, round(chunks / (SELECT sum(chunks) FROM g), 6) AS share FROM g"""
)
def chunk_report(spark: SparkSession, folder: str) -> DataFrame:
    r = _train(spark, folder).select(clean("source").alias("source"), F.regexp_replace(clean("lang"), "[-_].*$", "").alias("lang"), "country", F.coalesce("text", F.lit("")).alias("text"), F.lit("train").alias("split"))
    return build_report(r).select("source", "lang", "country", F.col("train").alias("chunks"), "share")


@query("SELECT coalesce(upper(trim(s.label)), 'unknown') AS value, count(*) AS n FROM (" + SPANS_SQL + ") GROUP BY 1")
def span_labels(spark: SparkSession, folder: str) -> DataFrame:
    s = align.span_rows(_train(spark, folder))
    return s.groupBy(F.coalesce(F.upper(F.trim("label")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(lower(trim(doctype)), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 25")
def top_doctypes(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.top_counts(spread(table(spark, folder, "documents")), clean("doctype"), 25)


@query("SELECT list_sort(list(n))[count(*) // 2 + 1] AS p50, list_sort(list(n))[count(*) * 9 // 10 + 1] AS p90 FROM (SELECT length(instruction) AS n FROM intent_cases WHERE instruction IS NOT NULL)")
def length_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "intent_cases").select(F.length("instruction").cast("bigint").alias("n"))
    return scorecard.index_percentiles(c, "n", {"p50": (1, 2), "p90": (9, 10)})


# -- spans ----------------------------------------------------------------------------------------------------------------------------------

MARKABLE_SQL = (
    """SELECT id, s.start AS start, s."end" AS "end", s.label AS label, substring(text, s.start + 1, s."end" - s.start) AS value, text FROM ("""
    + SPANS_SQL
    + r""") WHERE text IS NOT NULL AND s.label IN ('PER', 'ORG', 'LOC', 'DATE') AND s.start < s."end" AND s."end" <= length(text)"""
)


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    """Records written with inline markup: spans of the four labels whose value is trimmed and free of markup and line breaks."""
    r = _train(spark, folder).where("text is not null")
    good = F.array_sort(F.filter(F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int,label:string>>)")), lambda s: s["label"].isin("PER", "ORG", "LOC", "DATE") & (s["start"] < s["end"]) & (s["end"] <= F.length("text"))))

    def step(a: Column, s: Column) -> Column:
        value = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        ok = (s["start"] >= a["p"]) & ~value.rlike(r"[\[\]|\n]") & (value == F.trim(value))
        out = F.concat(a["o"], F.substring(F.col("text"), a["p"] + 1, s["start"] - a["p"]), F.lit("[["), s["label"], F.lit("|"), value, F.lit("]]"))
        return F.when(ok, F.struct(out.alias("o"), s["end"].alias("p"))).otherwise(a)

    acc = F.aggregate(good, F.struct(F.lit("").alias("o"), F.lit(0).alias("p")), step)
    r = r.select("id", "text", acc.alias("a"))
    return r.select("id", F.concat("a.o", F.substring(F.col("text"), F.col("a.p") + 1, F.length("text"))).alias("text"))


@query(
    "WITH m AS (" + MARKABLE_SQL + r"""), ok AS (SELECT * FROM m WHERE NOT regexp_matches(value, '[\[\]|\n]') AND value = trim(value))
    SELECT id, start, "end", label, value FROM (SELECT *, max("end") OVER (PARTITION BY id ORDER BY start, "end", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok) WHERE before IS NULL OR start >= before"""
)
def markup_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return markup.markup_spans(_marked(spark, folder))


@query(
    "WITH m AS (" + MARKABLE_SQL + r"""), ok AS (SELECT * FROM m WHERE NOT regexp_matches(value, '[\[\]|\n]') AND value = trim(value)),
    n AS (SELECT id, count(*)::INT AS n FROM (SELECT *, max("end") OVER (PARTITION BY id ORDER BY start, "end", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok) WHERE before IS NULL OR start >= before GROUP BY id),
    t AS (SELECT id, any_value(text) AS text FROM train WHERE text IS NOT NULL GROUP BY id)
    SELECT id, md5(regexp_replace(regexp_replace(text, '^\n+', ''), '\n+$', '')) AS digest, coalesce(n, 0)::INT AS n_spans FROM t LEFT JOIN n USING (id) WHERE text <> ''"""
)
def markup_records(spark: SparkSession, folder: str) -> DataFrame:
    """Markup to pieces to records."""
    r = markup.records_of_pieces(markup.pieces_of_markup(_marked(spark, folder)))
    return r.select("id", F.md5("text").alias("digest"), F.size("spans").alias("n_spans"))


TRAIN_TOKENS_SQL = WORDS_SQL.replace("documents", "train_docs")


@query(
    "WITH train_docs AS (SELECT id AS doc_id, any_value(text) AS text, any_value(spans) AS spans FROM train GROUP BY id), " + TRAIN_TOKENS_SQL + r""",
    sp AS (SELECT doc_id, s.start AS a, s."end" AS b, s.label AS l, row_number() OVER (PARTITION BY doc_id ORDER BY s.start NULLS FIRST, s."end" NULLS FIRST, s.label NULLS FIRST) AS o FROM (SELECT doc_id, unnest(spans) AS s FROM train_docs) WHERE s IS NOT NULL),
    tk AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY i), 0) AS ps, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY i), 0) AS pe FROM toks),
    j AS (SELECT tk.*, sp.a, sp.b, sp.l, row_number() OVER (PARTITION BY tk.doc_id, tk.i ORDER BY sp.o) AS k FROM tk LEFT JOIN sp ON sp.doc_id = tk.doc_id AND sp.a < tk.e AND sp.b > tk.s),
    lab AS (SELECT CASE WHEN a IS NULL THEN 'O' WHEN ps < b AND pe > a AND ps <> pe THEN 'I-' || l ELSE 'B-' || l END AS label FROM j WHERE k = 1)
    SELECT label, count(*) AS n FROM lab GROUP BY ALL"""
)
def token_labels(spark: SparkSession, folder: str) -> DataFrame:
    r = _train(spark, folder)
    tokens = tokenize.word_rows(r.where("text is not null").select(F.col("id").alias("doc_id"), "text"))
    spans = align.span_rows(r).withColumnRenamed("id", "doc_id")
    return align.token_labels(tokens, spans).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "WITH train_docs AS (SELECT id AS doc_id, any_value(text) AS text FROM train GROUP BY id), " + TRAIN_TOKENS_SQL + r""", n AS (SELECT doc_id, count(*) AS n FROM toks GROUP BY doc_id),
    w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 254 THEN 1 ELSE ceil((n - 254) / 222.0)::INT + 1 END)) * 222 AS ws FROM n)
    SELECT doc_id AS id, ws::INT AS token_start, least(ws + 254, n)::INT AS token_end, (least(ws + 254, n) - ws + 2)::INT AS n_places, true AS ignored FROM w"""
)
def label_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of training records in windows of 256 places, of which the first and last are ignored."""
    r = _train(spark, folder)
    tokens = tokenize.word_rows(r.where("text is not null").select(F.col("id").alias("doc_id"), "text"))
    w = align.label_windows(align.token_labels(tokens, align.span_rows(r).withColumnRenamed("id", "doc_id")))
    ends = (F.element_at("labels", 1) == "-100") & (F.element_at("labels", -1) == "-100") & ~F.array_contains(F.slice("labels", F.lit(2), F.size("labels") - 2), "-100")
    return w.select(F.col("doc_id").alias("id"), "token_start", "token_end", F.size("labels").alias("n_places"), ends.alias("ignored"))


@query(
    "WITH g AS (SELECT DISTINCT id, s.start AS a, s.\"end\" AS b, upper(trim(s.label)) AS l FROM (" + SPANS_SQL + r""") WHERE s.label IS NOT NULL),
    p AS (SELECT DISTINCT id, a, b + CASE WHEN a % 7 = 0 THEN 1 ELSE 0 END AS b, CASE WHEN a % 11 = 0 THEN 'LOC' ELSE l END AS l FROM g WHERE a % 13 <> 0),
    j AS (SELECT coalesce(g.l, p.l) AS label, g.l IS NOT NULL AND p.l IS NOT NULL AS both_, g.l IS NULL AS fp, p.l IS NULL AS fn FROM g FULL JOIN p ON g.id = p.id AND g.a = p.a AND g.b = p.b AND g.l = p.l),
    c AS (SELECT label, count(*) FILTER (both_) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM j GROUP BY label),
    u AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c)
    SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) ELSE 0 END AS recall,
        CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) ELSE 0 END AS f1 FROM u"""
)
def entity_scores(spark: SparkSession, folder: str) -> DataFrame:
    gold = align.span_rows(_train(spark, folder)).where("label is not null").withColumn("label", F.upper(F.trim("label")))
    moved = gold.where("start % 13 <> 0").withColumn("end", F.col("end") + F.when(F.col("start") % 7 == 0, 1).otherwise(0)).withColumn("label", F.when(F.col("start") % 11 == 0, "LOC").otherwise(F.col("label")))
    return scorecard.entity_scores(gold, moved, key="id")


# -- intents --------------------------------------------------------------------------------------------------------------------------------

#: A small keyword table of this project's own.
KEYWORDS = intent.Keywords({
    "regions": {"fr": ["french", "française", "francés", "france"], "es": ["spanish", "españa", "español"], "de": ["german", "deutsch"], "gb": ["british", "united kingdom"]},
    "verticals": {"finance": ["invoice", "factura", "facture", "rechnung", "bank account", "付款"], "employment": ["payslip", "nómina", "bulletin de paie"], "healthcare": ["clinic", "病历"]},
    "star_cues": ["only", "nothing else", "solo", "seulement", "nur", "只"], "case_sensitive": [], "except": {"fr": ["french press"]},
})


@query(
    """SELECT id, array_to_string(list_sort(list_transform(list_filter(map_entries(t), lambda e: e.key = '*' OR t['*'] IS NULL OR e.value <> t['*']), lambda e: e.key || '=' || e.value)), ',') AS types,
        (SELECT count(*) FROM (SELECT unnest(['PERSON','EMAIL','PHONE','ID','NUMBER','CARD','IBAN','DATE','BIRTH_DATE','AMOUNT','IP','URL','ADDRESS','COMPANY','SECRET','API_KEY']) AS k)
            WHERE CASE WHEN coalesce(t[k], t['*']) IS NULL THEN k NOT IN ('DATE', 'AMOUNT') ELSE coalesce(t[k], t['*']) = 'hide' END) AS n_hidden
    FROM (SELECT id, any_value(coalesce(expect.types, MAP {}::MAP(VARCHAR, VARCHAR))) AS t FROM intent_cases WHERE expect IS NOT NULL GROUP BY id)"""
)
def normalized_intents(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "intent_cases").where("expect is not null").dropDuplicates(["id"])
    t = F.coalesce("expect.types", F.expr("cast(map() as map<string,string>)"))
    entries = F.array_join(F.transform(F.coalesce(intent.normalize(F.col("expect"))["types"], F.expr("cast(array() as array<struct<key:string,value:string>>)")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    n = F.size(F.filter(intent.lits(intent.TYPES), lambda k: intent.hidden(t, k)))
    return c.select("id", entries.alias("types"), n.cast("bigint").alias("n_hidden"))


def canonical_sql(types: str, unsupported: str, **lists: str) -> str:
    """SQL of an intent's canonical JSON from SQL of its parts: a map, a boolean and lists, any of them null."""
    keys = "[" + ", ".join(f"'{k}'" for k in ("*", *intent.TYPES)) + "]"
    pruned = f"list_filter({keys}, lambda k: ({types})[k] IS NOT NULL AND (k = '*' OR ({types})['*'] IS NULL OR ({types})[k] <> ({types})['*']))"
    parts = [f"CASE WHEN len({pruned}) > 0 THEN '\"types\":{{' || array_to_string(list_transform({pruned}, lambda k: '\"' || k || '\":\"' || ({types})[k] || '\"'), ',') || '}}' END"]
    parts += [f"CASE WHEN len({c}) > 0 THEN '\"{k}\":[' || array_to_string(list_transform({c}, lambda x: to_json(x)::VARCHAR), ',') || ']' END" for k, c in lists.items()]
    parts.append(f"CASE WHEN {unsupported} THEN '\"unsupported\":true' END")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


CASES_SQL = "c AS (SELECT id, any_value(instruction) AS instruction, any_value(expect) AS x FROM intent_cases WHERE expect IS NOT NULL GROUP BY id)"
CANON = canonical_sql("coalesce(x.types, MAP {}::MAP(VARCHAR, VARCHAR))", "x.unsupported", **{k: f"x.{k}" for k in intent.LISTS})


@query(f"WITH {CASES_SQL} SELECT id, {CANON} AS raw, true AS same FROM c")
def intents_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical JSON of every intent, parsed again: equal ones are true."""
    c = table(spark, folder, "intent_cases").where("expect is not null").dropDuplicates(["id"]).select("id", "expect", intent.canonical(F.col("expect")).alias("raw"))
    back = intent.parse("raw")
    return c.select("id", "raw", intent.normalize(back).eqNullSafe(intent.normalize(F.col("expect"))).alias("same"))


def _predictions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Shots, and made predictions: most are right, some lack types or are no JSON."""
    shots = table(spark, folder, "shots")
    u = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 10
    raw = F.when(u == 0, "{not json").when(u == 1, F.lit('{"types":{"*":"off"}}')).otherwise(intent.canonical(F.col("expect")))
    p = shots.select("id", intent.parse(raw).alias("got"), (u * 30 + 50).cast("int").alias("ms"))
    return shots, p


#: What is wanted of each shot and how it was answered: 0 no JSON, 1 everything off, else right.
MARKS_SQL = """m AS (SELECT *, CASE WHEN ('0x' || substr(md5(id), 1, 8))::BIGINT % 10 = 1 THEN 1 WHEN expect IS NULL THEN 0 ELSE ('0x' || substr(md5(id), 1, 8))::BIGINT % 10 END AS u, coalesce(expect.types, MAP {}::MAP(VARCHAR, VARCHAR)) AS t,
        coalesce(len(expect.dictionary), 0) AS nd, coalesce(len(expect.never_hide), 0) AS nn, coalesce(len(expect.regions), 0) AS nr, coalesce(len(expect.verticals), 0) AS nv, coalesce(expect.unsupported, false) AS un FROM shots),
    k AS (SELECT *, u > 1 OR (u = 1 AND coalesce(t['*'] = 'off', false) AND len(list_filter(map_values(t), lambda v: v <> 'off')) = 0) AS o_types, u > 1 OR (u = 1 AND nr = 0) AS o_regions, u > 1 OR (u = 1 AND nv = 0) AS o_verticals,
        u > 1 OR (u = 1 AND nd = 0) AS o_dictionary, u > 1 OR (u = 1 AND nn = 0) AS o_never_hide, u > 1 OR (u = 1 AND NOT un) AS o_unsupported FROM m),
    w AS (SELECT *, o_types AND o_regions AND o_verticals AND o_dictionary AND o_never_hide AND o_unsupported AS ok,
        list_transform([""" + ", ".join(f"'{k}'" for k in intent.TYPES) + """], lambda e: {'e': e, 'h': CASE WHEN coalesce(t[e], t['*']) IS NULL THEN e NOT IN ('DATE', 'AMOUNT') ELSE coalesce(t[e], t['*']) = 'hide' END}) AS hid FROM k)"""


@query(
    "WITH " + MARKS_SQL + " SELECT count(*) AS n, sum(ok::INT)::BIGINT AS exact, sum((u = 0)::INT)::BIGINT AS invalid, "
    + ", ".join(f"sum(o_{f}::INT)::BIGINT AS ok_{f}" for f in ("types", "regions", "verticals", "dictionary", "never_hide", "unsupported")) + " FROM w"
)
def intent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scorecard.summary(scorecard.marks(scorecard.joined(*_predictions(spark, folder))))


@query(
    "WITH " + MARKS_SQL + """, s AS (SELECT CASE WHEN u = 1 THEN len(list_filter(hid, lambda z: z.h)) > 0 ELSE len(list_filter(hid, lambda z: z.h AND z.e IN ('DATE', 'AMOUNT'))) > 0 END OR nd > 0 AS leak, un AS unwarned,
        u = 0 AND len(list_filter(hid, lambda z: NOT z.h AND z.e NOT IN ('DATE', 'AMOUNT'))) > 0 AS over_ FROM w WHERE NOT ok)
    SELECT severity, count(*) AS n FROM (SELECT unnest(CASE WHEN leak OR unwarned OR over_ THEN list_filter([CASE WHEN leak THEN 'leak' END, CASE WHEN unwarned THEN 'unwarned' END, CASE WHEN over_ THEN 'overhide' END], lambda x: x IS NOT NULL) ELSE ['minor'] END) AS severity FROM s) GROUP BY 1"""
)
def intent_costs(spark: SparkSession, folder: str) -> DataFrame:
    return scorecard.cost_counts(scorecard.marks(scorecard.joined(*_predictions(spark, folder))))


@query(
    """WITH m AS (SELECT lang, tags, length(instruction) % 3 > 0 AS ok FROM shots), r AS (SELECT 'lang' AS grp, lang AS value, ok FROM m UNION ALL SELECT 'tag', unnest(tags), ok FROM m)
    SELECT grp, value, sum(ok::INT)::BIGINT AS hits, count(*) AS total, round(sum(ok::INT) / count(*)::DOUBLE, 6) AS rate FROM r GROUP BY ALL"""
)
def tag_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return scorecard.breakdown(table(spark, folder, "shots").withColumn("ok", F.length("instruction") % 3 > 0))


def hits_sql(field: str) -> str:
    """SQL of the values of a field whose keywords stand in ``low`` (folded, lower case), in the table's order."""
    found = []
    for value, words in KEYWORDS.table[field].items():
        rest = "low"
        for phrase in [*KEYWORDS.excepted.get(field, []), *KEYWORDS.excepted.get(value, [])]:
            rest = f"replace({rest}, '{KEYWORDS.fold(phrase)}', ' ')"
        found.append(f"CASE WHEN {' OR '.join(word_sql(rest, w) for w in words)} THEN '{value}' END")
    return f"list_filter([{', '.join(found)}], lambda v: v IS NOT NULL)"


def word_sql(text: str, word: str) -> str:
    w = KEYWORDS.fold(word)
    return f"regexp_matches({text}, '(^|[^0-9A-Za-z]){w}($|[^0-9A-Za-z])')" if w.isascii() else f"contains({text}, '{w}')"


FOLD_SQL = "strip_accents(lower(replace(replace({0}, '’', chr(39)), 'ß', 'ss')))"


@query(
    "WITH c AS (SELECT id, coalesce(any_value(instruction), '') AS instruction, any_value(expect) AS x FROM intent_cases GROUP BY id), f AS (SELECT *, " + FOLD_SQL.format("instruction") + " AS low, coalesce(x.types, MAP {}::MAP(VARCHAR, VARCHAR)) AS t FROM c),"
    + r""" g AS (SELECT *, CASE WHEN regexp_matches(instruction, '\{\s*["'']?(types|never_hide|dictionary)') THEN map_from_entries(list_filter(map_entries(t), lambda e: e.key <> '*' AND e.value = 'hide'))
        WHEN t['*'] IN ('off', 'keep') AND NOT (""" + " OR ".join(word_sql("low", w) for w in KEYWORDS.table["star_cues"]) + """) THEN map_from_entries(list_filter(map_entries(t), lambda e: e.key <> '*')) ELSE t END AS kept,
        """ + ", ".join(f"list_concat(coalesce(x.{k}, []), list_filter({hits_sql(k)}, lambda v: NOT list_contains(coalesce(x.{k}, []), v))) AS m_{k}" for k in ("regions", "verticals")) + ", "
    + ", ".join(f"list_filter(coalesce(x.{k}, []), lambda v: contains(low, {FOLD_SQL.format('v')})) AS m_{k}" for k in ("dictionary", "never_hide")) + " FROM f)"
    + " SELECT id, CASE WHEN x IS NOT NULL THEN " + canonical_sql("kept", "x.unsupported", **{k: f"m_{k}" for k in intent.LISTS}) + " END AS final FROM g"
)
def final_intents(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "intent_cases").dropDuplicates(["id"])
    p = intent.postprocess(c.select("id", "instruction", F.col("expect").alias("intent")), KEYWORDS)
    return p.select("id", intent.canonical(F.col("final")).alias("final"))


@query(f"WITH {CASES_SQL} SELECT id, unnest(['system', 'user', 'assistant']) AS role, unnest(['Answer with an intent as JSON.', instruction, {CANON}]) AS content FROM c")
def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "intent_cases").where("expect is not null").dropDuplicates(["id"])
    return c.select("id", F.explode(intent.chat("instruction", F.col("expect"), "Answer with an intent as JSON.")).alias("m")).select("id", "m.role", "m.content")


@query(
    """SELECT id, concat_ws('; ', CASE WHEN n > 1 THEN 'repeated id' END, CASE WHEN lang NOT IN ('en', 'fr', 'es', 'de', 'zh') OR lang IS NULL THEN 'unknown language' END, CASE WHEN expect IS NULL THEN 'no valid intent' END,
        CASE WHEN len(list_filter(coalesce(expect.dictionary, []), lambda t: NOT contains(coalesce(instruction, ''), t))) > 0 THEN 'dictionary: term is not in the instruction' END,
        CASE WHEN len(list_filter(coalesce(expect.never_hide, []), lambda t: NOT contains(coalesce(instruction, ''), t))) > 0 THEN 'never_hide: term is not in the instruction' END) AS errors
    FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM intent_cases)"""
)
def case_checks(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "intent_cases")
    counts = c.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("n"))
    c = c.join(counts, F.col("id").eqNullSafe(F.col("_id")))
    return c.select("id", F.array_join(intent.case_errors("instruction", "lang", F.col("expect"), F.col("n")), "; ").alias("errors"))


# -- identifiers ----------------------------------------------------------------------------------------------------------------------------


@query(
    r"""SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN n[i]::INT > 4 THEN n[i]::INT * 2 - 9 ELSE n[i]::INT * 2 END ELSE n[i]::INT END)) % 10 = 0 AS luhn,
        substring(n, 9, 8)::BIGINT % 23 = 22 AS e_letter FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 % 10000000000000000)::VARCHAR, 16, '0') AS n FROM orders)"""
)
def luhn_checks(spark: SparkSession, folder: str) -> DataFrame:
    n = F.lpad((F.col("o_orderkey") * 7919 % 10**16).cast("string"), 16, "0")
    o = table(spark, folder, "orders").select("o_orderkey", n.alias("n"))
    return o.select("o_orderkey", ids.is_card("n").alias("luhn"), ids.is_dni(F.concat(F.substring("n", 9, 8), F.lit("E"))).alias("e_letter"))


@query(
    r"""SELECT c_custkey, (substring(b, 1, 18)::HUGEINT * 1000000 + 142800 + k) % 97 = 1 AS iban FROM (
    SELECT c_custkey, c_custkey % 97 AS k, lpad((c_custkey * 104729)::VARCHAR, 18, '1') AS b FROM customer)"""
)
def iban_checks(spark: SparkSession, folder: str) -> DataFrame:
    body = F.lpad((F.col("c_custkey") * 104729).cast("string"), 18, "1")
    x = F.concat(F.lit("ES"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), body)
    return table(spark, folder, "customer").select("c_custkey", ids.is_iban(x).alias("iban"))


@query("SELECT c_custkey, unnest([" + ", ".join(f"'{k}'" for k in ids.KINDS) + "]) AS kind, true AS valid FROM customer")
def generated_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """For every customer one identifier of each kind, and whether its validator takes it. A projection a kind keeps each within generated code."""
    c = table(spark, folder, "customer").select("c_custkey")
    each = [once(c.withColumn("kind", F.lit(k)), value=ids.generate(k, F.col("c_custkey"), 1)).select("c_custkey", "kind", ids.VALIDATORS[k]("value").alias("valid")) for k in ids.KINDS]
    return functools.reduce(DataFrame.union, each)


# -- registers ------------------------------------------------------------------------------------------------------------------------------


@query()
def notice_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Test items labelled again by their own expected values and the notice grammar."""
    t = table(spark, folder, "test_cases")
    kinds = F.create_map(*[F.lit(x) for kv in {"PERSON": "PER", "COMPANY": "ORG", "ADDRESS": "LOC", "DATE": "DATE"}.items() for x in kv])
    v = t.select("case_id", F.explode("expected").alias("e")).select("case_id", F.col("e.value").alias("value"), kinds[F.col("e.type")].alias("label")).where("label is not null")
    return align.label_by_values(t.where("text is not null"), v, key="case_id")


@query(
    """SELECT s_suppkey, count(*) FILTER (label = 'ORG') AS n_org, count(*) FILTER (label = 'PER') AS n_per, count(*) FILTER (label = 'LOC') AS n_loc, count(*) FILTER (label = 'DATE') AS n_date
    FROM (SELECT s_suppkey, unnest(['ORG', 'LOC', 'PER', 'ORG', 'DATE']) AS label FROM supplier) GROUP BY 1"""
)
def acts(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers written as wrapped pages of acts, read back: lines joined, acts found, names and places labelled."""
    number, name = F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.upper(F.regexp_replace("s_name", "#", "N"))
    lines = F.array(F.concat(number, F.lit(" - "), name, F.lit(" SL. Constitución. Domicilio: C/ MAYOR 1 (MA-")), F.lit("DRID). Adm. Unico: PEREZ ANA;ACME SL."), F.lit("Núm. 12"), F.lit("Datos registrales. T 1, F 2 (1.02.20)."))
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.posexplode(lines).alias("line_no", "line"))
    p = registry.act_piece_rows(registry.spanish_acts(s), ["file", "act_no"]).where("label is not null")
    of = lambda k: F.sum((F.col("label") == k).cast("bigint")).alias(f"n_{k.lower()}")
    return p.groupBy(F.col("file").cast("bigint").alias("s_suppkey")).agg(of("ORG"), of("PER"), of("LOC"), of("DATE"))


def _record_columns(r: DataFrame) -> DataFrame:
    return r.select("id", "lang", "country", "source", "doctype", F.md5("text").alias("digest"), F.size("spans").alias("n_spans"), "reason")


def record_sql(text: str, lang: str, country: str, doctype: str, n_spans: int, rows: str, id_: str) -> str:
    return f"""SELECT id, '{lang}' AS lang, '{country}' AS country, 'registry' AS source, '{doctype}' AS doctype, md5(text) AS digest, {n_spans}::INT AS n_spans, CASE WHEN length(text) < 250 THEN 'too short' END AS reason
    FROM (SELECT {id_} AS id, {text} AS text FROM {rows})"""


@query(record_sql(
    "'BODACC A n° 12 du 05/03/2024 - Annonce n° ' || s_suppkey || '\nVentes - Avis\nTribunal de commerce de Reims\n\n' || s_name || ' SARL\nForme juridique : Société à responsabilité limitée\nCapital : 1000 EUR\nSiège social : 3 Rue A, 75001 Paris\n\nDate d''effet : 01/03/2024'".replace("\n", "' || chr(10) || '"),
    "fr", "FR", "vente", 5, "supplier", "'reg-fr-bodacc-2024-03-05-' || s_suppkey"))
def french_records(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as French notices, delivered twice, and read to records."""
    firm = '","formeJuridique":"Société à responsabilité limitée","capital":{"montantCapital":"1000","devise":"EUR"},"adresseSiegeSocial":{"france":{"numeroVoie":"3","nomVoie":"Rue A","codePostal":"75001","ville":"Paris"}}}}'
    given = {"dateparution": "2024-03-05", "publicationavis": "A", "parution": "12", "familleavis": "vente", "familleavis_lib": "Ventes", "typeavis_lib": "Avis", "tribunal": "Tribunal de commerce de Reims", "acte": '{"dateEffet":"2024-03-01"}'}
    n = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("numeroannonce"), *[F.lit(v).alias(k) for k, v in given.items()], F.concat(F.lit('{"personne":{"denomination":"'), F.col("s_name"), F.lit(" SARL" + firm)).alias("listepersonnes"),
        *[F.lit(None).cast("string").alias(k) for k in ("listeetablissements", "jugement")])
    return _record_columns(registry.french_records(n.union(n)))


@query(record_sql(
    "'BOLETÍN OFICIAL DEL REGISTRO MERCANTIL\nLunes 1 de abril de 2024\nActos inscritos\n\nMadrid\n' || acts".replace("\n", "' || chr(10) || '"), "es", "ES", "acts", 17,
    "(SELECT s_suppkey // 5 AS file, string_agg(lpad(s_suppkey::VARCHAR, 5, '0') || ' - ' || upper(replace(s_name, '#', 'N')) || ' SL. Constitución. Domicilio: C/ MAYOR 1 (MADRID). Adm. Unico: PEREZ ANA.', chr(10) ORDER BY s_suppkey) AS acts FROM supplier GROUP BY 1 HAVING count(*) = 5)",
    "'reg-es-borme-' || file || '-0'"))
def spanish_records(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as pages of five acts under one province, read to records."""
    number, name = F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.upper(F.regexp_replace("s_name", "#", "N"))
    s = table(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / 5).cast("string").alias("file"), "s_suppkey", F.concat(number, F.lit(" - "), name, F.lit(" SL. Constitución. Domicilio: C/ MAYOR 1 (MADRID). Adm. Unico: PEREZ ANA.")).alias("act"))
    files = s.select("file").distinct()
    lines = s.select("file", F.col("s_suppkey").cast("bigint").alias("line_no"), F.col("act").alias("line")).union(files.select("file", F.lit(-1).cast("bigint"), F.lit("MADRID"))).union(files.select("file", F.lit(-2).cast("bigint"), F.lit("Núm. 64")))
    return _record_columns(registry.spanish_records(lines, files.withColumn("date", F.lit("2024-04-01"))))


@query(record_sql(
    "s_name || ' of 3 Mill Lane, Leeds, LS1 4AP' || chr(10) || 'Granite & Sons Limited, contact Ada Marsh on 3 May 2024.'", "en", "GB", "notice", 5, "supplier", "'reg-gb-' || s_suppkey"))
def british_records(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as British notices: a page, and the values of its graph."""
    page = F.concat(F.lit("<html><article id='n'><p>Notice category: Corporate</p><p>Notice code:</p><p>2410</p><p>"), F.col("s_name"), F.lit(" of 3 Mill Lane, Leeds, LS1 4AP</p><p>Granite &amp; Sons Limited, contact Ada Marsh on 3 May 2024.</p></article><p>x</p></html>"))
    graph = F.concat(F.lit('[{"@id":"o","@type":"Company","name":"'), F.col("s_name"), F.lit('"},{"@id":"x/court/1","name":"Leeds"}]'))
    return _record_columns(registry.british_records(table(spark, folder, "supplier").select(F.concat(F.lit("reg-gb-"), F.col("s_suppkey").cast("string")).alias("id"), page.alias("html"), graph.alias("graph"), F.lit("notice").alias("doctype"))))


@query()
def rendered_templates(spark: SparkSession, folder: str) -> DataFrame:
    """A small template rendered once for every source file of its country, as records."""
    files = table(spark, folder, "source_files")
    template = "#country: GB\n#doctype: letter\nDear {{TITLE#1}} {{PER#1:surname}},\n{{ORG#1:legal}} wrote on {{DATE:long}} to {{PER#1:full}}, {{LOC#1:line}}, about {{AMOUNT}}.\nPay to {{IBAN}} ({{BIC}}), ring {{PHONE}} or {{MOBILE}}, mail {{EMAIL:PER#1}}. VAT {{VAT}}, {{COMPANYID}}, {{NATID}}, {{TAXID}}, {{PLATE}}, {{REF}}, {{ACCOUNT}}, {{SORTCODE}}, {{CARD4}}, {{NUM}}.\n{{ORG#1:name}}"
    templates = spark.createDataFrame([("t1", template)], "id string, text string")
    inv = spark.createDataFrame(
        [("GB", ["Ada", "Ben"], ["Marsh", "Lowell"], ["Ms", "Mr"], ["Granite Supply", "Harbour Tools"], ["Ltd", "plc"], ["GS"], ["Mill Lane"], ["Unit {n}"], ["clerk"], ["Billing"], ["{town} Council"], [("Leeds", "LS1 4AP", "Yorkshire")])],
        "country string, given_names array<string>, surnames array<string>, titles array<string>, org_names array<string>, legal_forms array<string>, acronyms array<string>, streets array<string>, units array<string>, jobs array<string>, departments array<string>, public_bodies array<string>, places array<struct<town:string,postcode:string,region:string>>",
    )
    docs = files.select(F.col("file_id").alias("doc_id"), F.lit("t1").alias("id"), F.lit("en").alias("lang"))
    pieces = generate.augment(generate.substitute_names(generate.render(templates, inv, docs), ["Ada", "Marsh", "Iris", "Noel"]))
    return markup.records_of_pieces(pieces, "doc_id").select("doc_id", "text", F.size("spans").alias("n_spans"))
