"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.groups import assign_splits, related_groups
from spanloom.llm.leaks import leaks
from spanloom.llm.mixing import mix
from spanloom.llm.overlap import overlaps
from spanloom.llm.packing import pack
from spanloom.llm.sentences import sentence_offsets
from spanloom.llm.splitting import split_files, split_records
from spanloom.llm.tokens import compared, compared_lang, count_tokens, token_budget
from spanloom.session import cut, delete_at_exit, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_offsets(table(spark, folder, "documents"))


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = p1_pieces(spark, folder)
    return pieces.where("piece_no = 0").select("id")


@query
def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_records(table(spark, folder, "train"), table(spark, folder, "vocab"))


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return token_budget(table(spark, folder, "train"), table(spark, folder, "vocab"))


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_containers(spark, folder).where("piece_no = 1").select("doc_id")


@query
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), table(spark, folder, "vocab"))


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_shares(spark, folder).where("short").select("source")


@query
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), table(spark, folder, "vocab")).shares


@query
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), table(spark, folder, "vocab")).rows


#: Token counts in SQL: the distinct words of the lower-cased texts, each taken piece by piece from its start.
_COUNTED = r"""
    words AS (SELECT k, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\p{L}\p{N}\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) AS w FROM texts),
    pieces AS (SELECT DISTINCT regexp_replace(token, '^##', '') AS piece, token LIKE '##%' AS inner_piece, length(regexp_replace(token, '^##', '')) AS n FROM vocab WHERE token IS NOT NULL),
    walk AS (
        SELECT w, 0 AS pos, 0 AS cost FROM (SELECT DISTINCT w FROM words)
        UNION ALL
        SELECT r.w, r.pos + max(p.n), any_value(r.cost) + 1
        FROM walk r JOIN pieces p ON p.inner_piece = (r.pos > 0) AND substr(r.w, r.pos + 1, p.n) = p.piece
        WHERE r.pos < length(r.w) GROUP BY r.w, r.pos
    ),
    costs AS (SELECT w, coalesce(max(CASE WHEN pos = length(w) THEN cost END), 1) AS cost FROM walk GROUP BY w),
    counted AS (SELECT t.k, coalesce(sum(c.cost), 0)::BIGINT AS n FROM texts t LEFT JOIN words USING (k) LEFT JOIN costs c USING (w) GROUP BY t.k)
"""
_TRAIN = "WITH RECURSIVE texts AS (SELECT id AS k, any_value(text) AS text FROM train GROUP BY id)," + _COUNTED
_DOCS = "WITH RECURSIVE texts AS (SELECT doc_id AS k, text FROM documents)," + _COUNTED

ORACLES["p1_found"] = _TRAIN + "SELECT k AS id FROM counted WHERE n > 256"
ORACLES["p5_found"] = (
    _TRAIN
    + """, labels AS (SELECT DISTINCT id AS k, coalesce(lower(trim(source)), 'unknown') AS source,
        regexp_replace(coalesce(lower(trim(lang)), 'unknown'), '[-_].*$', '') AS lang, coalesce(lower(trim(doctype)), 'unknown') AS doctype FROM train)
    SELECT source, lang, doctype, sum(n)::BIGINT AS n_tokens FROM counted JOIN labels USING (k) GROUP BY ALL"""
)
ORACLES["p6_found"] = _DOCS + "SELECT k AS doc_id FROM counted WHERE n > 2048"
ORACLES["p7_found"] = (
    _DOCS
    + """, sized AS (SELECT lower(trim(source)) AS source, sum(n)::BIGINT AS n FROM counted JOIN documents ON doc_id = k WHERE trim(source) <> '' GROUP BY ALL)
    SELECT m.source FROM mix_targets m LEFT JOIN sized s ON s.source = lower(trim(m.source))
    WHERE coalesce(s.n, 0) * m.max_repeats < m.target_share * (SELECT sum(n) FROM sized)"""
)


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return related_groups(table(spark, folder, "train"), table(spark, folder, "source_files"))


@query
def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    train = table(spark, folder, "train")
    groups = related_groups(train, table(spark, folder, "source_files"))
    label = F.concat_ws("/", compared_lang(), compared("doctype"))
    return assign_splits(cut(groups), train.select("id", label.alias("label")), {"train": 0.8, "validation": 0.1, "test": 0.1})


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "train"), table(spark, folder, "test_cases"))


@query
def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many items of each test set leaked, and into how many records."""
    found = p2_found(spark, folder).join(table(spark, folder, "test_cases").select("case_id", "test_set"), "case_id")
    return found.groupBy("test_set").agg(F.countDistinct("case_id").alias("n_items"), F.countDistinct("id").alias("n_records"), F.count("*").alias("n_pairs"))


def _splits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    train, dev, cases, shots = (table(spark, folder, n) for n in ("train", "dev", "intent_cases", "shots"))
    evaluation = dev.select(F.lit("records").alias("scope"), F.concat(F.lit("dev|"), "id").alias("id"), "text")
    evaluation = evaluation.union(shots.select(F.lit("instructions"), F.concat(F.coalesce("split", F.lit("unknown")), F.lit("|"), "id"), "instruction"))
    training = train.select(F.lit("records").alias("scope"), "id", "text").union(cases.select(F.lit("instructions"), "id", "instruction"))
    return evaluation, training


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = overlaps(*_splits(spark, folder))
    return found.select(F.substring_index("eval_id", "|", 1).alias("split"), F.expr("substring(eval_id, instr(eval_id, '|') + 1)").alias("eval_id"), "train_id")


@query
def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per split and source of the training record (its writer for instructions)."""
    scoped = lambda name, scope, source: table(spark, folder, name).select(F.lit(scope).alias("scope"), "id", compared(source).alias("source"))
    sources = scoped("train", "records", "source").union(scoped("intent_cases", "instructions", "writer")).groupBy("scope", "id").agg(F.min("source").alias("source"))
    found = p3_found(spark, folder).withColumn("scope", F.when(F.col("split") == "dev", "records").otherwise("instructions")).withColumnRenamed("train_id", "id")
    found = found.join(sources, ["scope", "id"])
    return found.groupBy("split", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval"), F.countDistinct("id").alias("n_train"))


@query
def p1_covered(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each oversized record must keep to: its tokens counted once, the limit, the overlap, order, and spans that are not cut."""
    train, vocab = table(spark, folder, "train"), table(spark, folder, "vocab")
    texts = train.where("id is not null and text is not null").groupBy("id").agg(F.max("text").alias("text"))
    order = Window.partitionBy("id").orderBy("piece_no")
    p = split_records(train, vocab).withColumn("before", F.lag("end").over(order)).join(texts, "id")
    twice = F.when(F.col("before") > F.col("start"), F.expr("substring(text, start + 1, before - start)"))
    between = F.when(F.col("before") < F.col("start"), F.expr("substring(text, before + 1, start - before)"))
    # a word over the limit is cut inside, and its parts needn't cost as much as the word
    p = p.withColumn("inside", F.expr("substring(text, end, 2)").rlike(r"^[\p{L}\p{N}]{2}$"))
    p = p.withColumn("gap", F.coalesce(between.rlike(r"[^\p{IsWhite_Space}]"), F.lit(False))).select("id", "piece_no", "n_pieces", "n_tokens", "gap", "inside", (F.length("piece") == F.col("end") - F.col("start")).alias("whole"), twice.alias("twice"))
    p = count_tokens(p, vocab, "twice", "n_twice")
    return p.groupBy("id").agg(
        F.when(F.bool_or("inside"), F.lit(-1)).otherwise(F.sum("n_tokens") - F.sum("n_twice")).alias("n_tokens"), (F.max("n_tokens") <= 256).alias("within"), (F.max("n_twice") <= 32).alias("overlaps"), (~F.bool_or("gap")).alias("covered"),
        ((F.max("piece_no") + 1 == F.max("n_pieces")) & (F.count("*") == F.max("n_pieces")) & (F.min("piece_no") == 0) & F.bool_and("whole")).alias("numbered"))


ORACLES["p1_covered"] = _TRAIN + "SELECT k AS id, CASE WHEN k NOT IN (SELECT k FROM words JOIN costs USING (w) WHERE cost > 256) THEN n ELSE -1 END AS n_tokens, true AS within, true AS overlaps, true AS covered, true AS numbered FROM counted WHERE n > 256 AND k IS NOT NULL"


@query
def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each language landed as one file and cut by byte ranges: pieces, and whether each stands in its file where it is said to."""
    d = table(spark, folder, "documents").where("text is not null").select(compared_lang().alias("file"), "doc_id", F.regexp_replace("text", r"\s+", " ").alias("value"))
    root = f"{shared_dir(spark).rstrip('/')}/landed/{uuid.uuid4().hex}"
    d.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(root)
    delete_at_exit(spark, root)
    paths = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(root).select("path").collect()]
    p = split_files(spark, [x.replace("file:", "", 1) if x.startswith("file:") else x for x in paths], table(spark, folder, "vocab"))
    name = F.regexp_extract("path", r"/file=([^/]*)/", 1)
    ok = (F.col("n_tokens") <= 256) & (F.octet_length("piece") == F.col("end_byte") - F.col("start_byte"))
    return p.groupBy(name.alias("file")).agg(F.bool_and(ok).alias("kept"), (F.max("piece_no") + 1 == F.count("*")).alias("numbered"), F.min("start_char").alias("first_char"))


ORACLES["p1_files"] = r"""SELECT regexp_replace(coalesce(lower(trim(lang)), 'unknown'), '[-_].*$', '') AS file, true AS kept, true AS numbered, 0::BIGINT AS first_char FROM documents WHERE text IS NOT NULL GROUP BY 1"""


@query
def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: tokens and documents in all, and whether none is over the capacity and no fewer could hold them."""
    p = p6_containers(spark, folder)
    each = p.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    c = each.agg(F.max("n").alias("fullest"), F.count(F.when(F.col("n") > 0, 1)).alias("used"), F.sum("n").alias("n_tokens"))
    n_docs = p.agg(F.countDistinct("doc_id")).first()[0]
    return c.select(F.lit(n_docs).cast("bigint").alias("n_docs"), "n_tokens", (F.col("fullest") <= 2048).alias("within"), (F.col("used") == F.ceil(F.col("n_tokens") / 2048)).alias("fewest"))


ORACLES["p6_fill"] = _DOCS + "SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, true AS within, true AS fewest FROM counted"


@query
def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture's rows against its shares: tokens of each source, repeats, uses within a pass, and the goal met as nearly as one block allows."""
    docs, targets, vocab = (table(spark, folder, n) for n in ("documents", "mix_targets", "vocab"))
    m = mix(docs, targets, vocab)
    uses = m.rows.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.countDistinct("pass_no", "shard").alias("places"), F.countDistinct("pass_no").alias("passes"), F.sum("n_tokens").alias("n"))
    got = uses.groupBy("source").agg(F.sum("n").alias("n"), F.max("uses").alias("most"), F.bool_and((F.col("uses") == F.col("passes")) & (F.col("uses") == F.col("places"))).alias("once"))
    j = m.shares.join(got, "source", "left")
    near = F.abs(F.col("mixed_tokens") - F.col("goal_tokens")) <= F.greatest(F.col("goal_tokens") * 0.02, F.lit(20_000.0))
    return j.select("source", "source_tokens", (F.coalesce("n", F.lit(0)) == F.col("mixed_tokens")).alias("agrees"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats"), F.coalesce("once", F.lit(True)).alias("once"), near.alias("near"))


ORACLES["p7_checked"] = (
    _DOCS
    + """, sized AS (SELECT lower(trim(source)) AS source, sum(n)::BIGINT AS n FROM counted JOIN documents ON doc_id = k WHERE trim(source) <> '' GROUP BY ALL)
    SELECT lower(trim(m.source)) AS source, coalesce(s.n, 0)::BIGINT AS source_tokens, true AS agrees, true AS repeats, true AS once, true AS near FROM mix_targets m LEFT JOIN sized s ON s.source = lower(trim(m.source))"""
)


@query
def p4_balance(spark: SparkSession, folder: str) -> DataFrame:
    """The splits of related records: ids, groups in more than one split, and whether sizes and label counts keep to the shares."""
    s = cut(p4_splits(spark, folder))
    train = table(spark, folder, "train")
    label = train.where("id is not null").groupBy("id").agg(F.min(F.concat_ws("/", compared_lang(), compared("doctype"))).alias("label"))
    apart = s.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
    goals = {"train": 0.8, "validation": 0.1, "test": 0.1}
    counts = s.join(label, "id").groupBy("label").pivot("split", list(goals)).count().na.fill(0)
    total = sum((F.col(k) for k in goals), F.lit(0))
    off = F.greatest(*[F.abs(F.sum(k) / F.sum(total) - v) for k, v in goals.items()])
    moved = F.sum(sum((F.abs(F.col(k) - v * total) for k, v in goals.items()), F.lit(0.0))) / F.sum(total)
    return counts.agg(F.lit(s.count()).cast("bigint").alias("n_ids"), F.lit(apart).cast("bigint").alias("n_apart"), (off < 0.02).alias("sizes"), (moved < 0.5).alias("labels"))


ORACLES["p4_balance"] = "SELECT count(DISTINCT id) AS n_ids, 0::BIGINT AS n_apart, true AS sizes, true AS labels FROM train"

#: Groups by the transitive closure of records, files, authors, announcements and companies.
ORACLES["p4_found"] = r"""WITH RECURSIVE p AS (
    SELECT id, min(lower(trim(source))) AS s, min(lower(trim(country))) AS c, min(lower(trim(doctype))) AS d, min(regexp_replace(upper(origin), '[^\p{L}\p{N}]', '', 'g')) AS co,
        regexp_extract(lower(trim(id)), '^(tpl-[a-z]{2}|doc-[a-z]{2}|x)-([a-z]{2})[-_](?:([a-z]+)[-_])?(\d+)(?:\.v\d+)?-\d+$', ['pre', 'cc', 'dt', 'no']) AS m,
        regexp_extract(lower(trim(id)), '^reg-[a-z]+-([a-z]{2})-(\d{2,4})[-_/.](\d+)[-_/.]\d+$', ['cc', 'yr', 'no']) AS g
    FROM train WHERE id IS NOT NULL GROUP BY id),
links AS (
    SELECT 'r' || id AS a, 'k' || CASE left(m.pre, 3) WHEN 'tpl' THEN 'template' WHEN 'doc' THEN 'document' ELSE s END || '|' || m.cc || '|' || CASE WHEN m.dt <> '' THEN m.dt ELSE d END || '|' || m.no::INT AS b FROM p WHERE m.pre <> ''
    UNION SELECT 'r' || id, 'n' || g.cc || '|' || CASE WHEN length(g.yr) = 2 THEN '20' || g.yr ELSE g.yr END || '|' || g.no::BIGINT FROM p WHERE g.yr <> ''
    UNION SELECT 'r' || id, 'c' || co FROM p WHERE co <> ''
    UNION SELECT 'f' || file_id, 'k' || lower(trim(source)) || '|' || lower(trim(country)) || '|' || lower(trim(doctype)) || '|' || file_no FROM source_files
    UNION SELECT 'f' || file_id, 'f' || adapted_from FROM source_files WHERE adapted_from IS NOT NULL
    UNION SELECT 'f' || file_id, 'a' || array_to_string(list_sort(list_filter(regexp_split_to_array(lower(author), '[\s,.;]+'), lambda w: w <> '')), ' ') FROM source_files WHERE trim(author) <> ''),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT 'r' || id AS root, 'r' || id AS node FROM p UNION SELECT root, b FROM reach JOIN e ON node = a)
SELECT coalesce(min(CASE WHEN node LIKE 'f%' THEN substr(node, 2) END), min(CASE WHEN node LIKE 'r%' THEN substr(node, 2) END)) AS group_id, substr(root, 2) AS id FROM reach GROUP BY root"""
