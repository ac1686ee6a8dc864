"""Landed files as tables, and tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.identifiers import KINDS, generate
from spanloom.operators import isolation
from spanloom.operators.markup import template_parts

SPAN = "array<struct<start:int,end:int,label:string>>"
RECORD = f"id string, lang string, country string, source string, doctype string, text string, spans {SPAN}, origin string"
CASE = "id string, lang string, instruction string, expect struct<types:map<string,string>,regions:array<string>,verticals:array<string>,dictionary:array<string>,never_hide:array<string>,unsupported:boolean>, tags array<string>, note string"
PREDICTION = "id string, raw string, ms int"
#: The country of a language's files that name none.
DEFAULT_COUNTRY = {"en": "GB", "fr": "FR", "es": "ES"}


def whole_files(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """``(path, folder, name, text)`` of all files under a folder; one row a file."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    d = d.select(path.alias("path"), F.col("value").alias("text"))
    bits = F.split("path", "/")
    return d.select("path", F.element_at(bits, -2).alias("folder"), F.element_at(bits, -1).alias("name"), "text")


def templates(spark: SparkSession, root: str) -> DataFrame:
    """``(id, lang, country, doctype, text, body)``; the language is the folder's name, the header is in the text."""
    d = whole_files(spark, root)
    p = template_parts("text")
    return d.select(F.regexp_replace("name", r"\.txt$", "").alias("id"), F.col("folder").alias("lang"), p["country"].alias("country"), p["doctype"].alias("doctype"), "text", p["body"].alias("body"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """``(id, lang, country, doctype, text)``: the country stands before the name's first dash, else it is the language's; ``neg…`` files are negatives."""
    d = whole_files(spark, root)
    base = F.regexp_replace("name", r"\.txt$", "")
    first = F.upper(F.substring_index(base, "-", 1))
    fallback = F.element_at(F.create_map(*[x for kv in DEFAULT_COUNTRY.items() for x in map(F.lit, kv)]), F.col("folder"))
    country = F.when(first.rlike("^[A-Z]{2}$"), first).otherwise(fallback)
    doctype = F.when(base.startswith("neg"), "negatives").otherwise(F.get(F.split(base, "-"), F.lit(1)))
    return d.select(base.alias("id"), F.col("folder").alias("lang"), country.alias("country"), doctype.alias("doctype"), F.regexp_replace("text", r"^\n+|\n+$", "").alias("text"))


def inventory_entries(spark: SparkSession, root: str) -> DataFrame:
    """``(country, key, value)`` of the names, firms by sector, acronyms and streets of inventory files (JSON, one a country)."""
    named = "array<struct<name:string,gender:string>>"
    schema = f"country string, lang string, given_names {named}, surnames {named}, org_names map<string,array<string>>, acronyms array<string>, streets array<string>"
    d = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(root)
    flat = lambda key, c: d.select("country", F.lit(key).alias("key"), F.explode(c).alias("value"))
    out = flat("given_names", F.transform("given_names", lambda x: x["name"])).union(flat("surnames", F.transform("surnames", lambda x: x["name"])))
    orgs = d.select("country", F.explode("org_names").alias("s", "v")).select("country", F.concat(F.lit("org_names."), "s"), F.explode("v"))
    return out.union(orgs).union(flat("acronyms", F.col("acronyms"))).union(flat("streets", F.col("streets"))).where("value is not null")


def load_inventories(spark: SparkSession, root: str, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inventory entries without the blocked ones (column ``part``, any case), and how many each country and kind of entry lost: ``(country, key, n_dropped)``.

    Names, firms and streets are filtered; acronyms stay as they are.
    """
    entries = inventory_entries(spark, root)
    open_ = F.col("key") == "acronyms"
    kept = isolation.unblocked(entries.where(~open_), blocked).unionByName(entries.where(open_))
    counts = lambda d, n: d.groupBy("country", "key").agg(F.count("*").alias(n))
    drops = counts(entries, "_all").join(counts(kept, "_kept"), ["country", "key"], "left")
    return kept, drops.select("country", "key", (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("n_dropped"))


def inventory_violations(entries: DataFrame, tests: DataFrame, expected: str = "expected") -> DataFrame:
    """``(country, key, value, name)`` of inventory entries that hold a test item's name as whole words."""
    e = entries.withColumn("_id", F.struct("country", "key", "value").cast("string"))
    found = isolation.names_in(e, isolation.test_names(tests, expected=expected), key="_id", text="value")
    return found.join(e, "_id").select("country", "key", "value", "name").distinct()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, split: str | None = None, drop: tuple[str, ...] = ("base",), seed: int = 0, key: str = "id") -> None:
    """JSON lines, a folder a split, in a seeded order over its files; helper columns are dropped. Files are ranges of that order, so a split has many writers."""
    d = df.drop(*drop).withColumn("_o", F.xxhash64(key, F.lit(seed)))
    by = [split] if split else []
    w = d.repartitionByRange(*by, "_o").sortWithinPartitions(*by, "_o").drop("_o").write.mode("overwrite")
    (w.partitionBy(split) if split else w).json(path)


def build_report(records: DataFrame, chunk_chars: int = 900) -> DataFrame:
    """Chunks by source, language and country with a column a split (train, dev), and each row's share of all."""
    g = records.groupBy("source", "lang", "country").pivot("split", ["train", "dev"]).agg(F.sum(F.length("text") / F.lit(float(chunk_chars))))
    g = g.na.fill(0.0, ["train", "dev"])
    both = F.col("train") + F.col("dev")
    total = g.agg(F.sum(both)).first()[0]
    return g.select("source", "lang", "country", F.round("train", 3).alias("train"), F.round("dev", 3).alias("dev"), F.round(both / F.lit(total), 6).alias("share"))


def markdown(df: DataFrame, limit: int = 500) -> str:
    """A small report as a markdown table; refuses more rows than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)]) + "\n"


def verify_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """``(path, status)`` of files named in a manifest ``(path, sha256)``, relative to the root: ok, mismatch or missing."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    got = d.select(F.col("path").alias("_p"), F.sha2("content", 256).alias("_h"))
    rel = F.expr("substring_index(_p, '" + root.rstrip("/").replace("'", "\\'") + "/', -1)")
    j = manifest.join(got.select(rel.alias("path"), "_h"), "path", "left")
    return j.select("path", F.when(F.col("_h").isNull(), "missing").when(F.col("_h") == F.lower("sha256"), "ok").otherwise("mismatch").alias("status"))


def identifiers(spark: SparkSession, kind: str, count: int, seed: int = 0) -> DataFrame:
    """``(n, kind, value)``: valid identifiers of a kind."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    return spark.range(count).select(F.col("id").alias("n"), F.lit(kind).alias("kind"), generate(kind, F.col("id"), seed).alias("value"))


def landed_notices(spark: SparkSession, root: str) -> DataFrame:
    """Notices as delivered, JSON lines whose nested members are JSON text; all columns as strings."""
    cols = "id numeroannonce dateparution publicationavis parution familleavis familleavis_lib typeavis_lib tribunal listepersonnes listeetablissements acte jugement".split()
    return spark.read.schema(", ".join(f"{c} string" for c in cols)).json(root)
