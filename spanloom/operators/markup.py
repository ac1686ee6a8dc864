"""Inline markup ``[[LABEL|value]]``, templates with slots, and the algebra of labelled pieces.

A document in pieces is a long table ``(key, i, text, label)``; its text is their concatenation in order, spans are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import col

LABELS = "PER|ORG|LOC|DATE"
ENTITY = rf"\[\[({LABELS})\|([^\[\]|\n]+)\]\]"
ENTITY_BARE = rf"\[\[(?:{LABELS})\|[^\[\]|\n]+\]\]"
SLOT = r"\{\{([A-Z0-9]+)(?:#(\d+))?(?::([a-z_]+)(?:@([a-z]+))?)?(?::(PER|ORG)#(\d+))?\}\}"
#: Fixed values.
COUNTRIES = "GB IE US FR BE CH ES".split()
DOCTYPES = "invoice payslip bank insurance lease medical letter cv support chat form".split()
SECTORS = "trades retail health finance insurance property employer school utility telecom hospitality transport legal".split()
SLOT_FORMS = {
    "PER": "full given surname initial_surname surname_given signature".split(), "ORG": "legal name acronym".split(),
    "LOC": "line street unit postcode_town town region country po_box".split(), "DATE": "long short numeric birth day_month iso".split(), "AMOUNT": ["", "big"],
}
PLAIN_SLOTS = "TITLE PUBLIC DEPT JOB PHONE MOBILE EMAIL URL IBAN BIC CARD4 ACCOUNT SORTCODE NATID TAXID COMPANYID VAT PLATE REF NUM".split()
MIN_SIZES = {"given_names": 200, "surnames": 300, "acronyms": 40, "streets": 250, "places": 150, "public_bodies": 40, "departments": 40, "jobs": 80}
INVENTORY_KEYS = "country lang given_names surnames titles legal_forms org_names acronyms streets units places po_box public_bodies departments jobs email_domains".split()


def plain_text(text: Column | str) -> Column:
    """The text with each entity replaced by its value."""
    return F.regexp_replace(col(text), ENTITY, "$2")


def markup_errors(text: Column | str) -> Column:
    """Reasons: untrimmed values and stray markup."""
    t = col(text)
    values = F.regexp_extract_all(t, F.lit(ENTITY), F.lit(2))
    plain = plain_text(t)
    tests = [(F.exists(values, lambda v: v != F.trim(v)), "untrimmed value"), (F.contains(plain, F.lit("[[")), "stray [["), (F.contains(plain, F.lit("]]")), "stray ]]")]
    return present(tests)


def present(tests: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(m)) for t, m in tests]), lambda x: x.isNotNull())


def markup_spans(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(key, start, end, label, value)`` of every entity, offsets in the plain text."""
    t = F.col(text)
    labels, values = (F.regexp_extract_all(t, F.lit(ENTITY), F.lit(k)) for k in (1, 2))
    gaps = F.split(t, ENTITY_BARE, -1)
    z = F.arrays_zip(labels.alias("l"), values.alias("v"), F.slice(gaps, 1, F.size(labels)).alias("g"))
    p = docs.select(key, F.posexplode(z).alias("i", "x"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("end", F.sum(F.length("x.g") + F.length("x.v")).over(w).cast("int"))
    return p.select(key, (F.col("end") - F.length("x.v")).alias("start"), "end", F.col("x.l").alias("label"), F.col("x.v").alias("value"))


def pieces_of_markup(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """The document as pieces; gaps between entities are unlabelled, empty ones left out."""
    t = F.col(text)
    labels, values = (F.regexp_extract_all(t, F.lit(ENTITY), F.lit(k)) for k in (1, 2))
    gaps = F.transform(F.split(t, ENTITY_BARE, -1), lambda g: F.struct(g.alias("text"), F.lit(None).cast("string").alias("label")))
    ents = F.zip_with(values, labels, lambda v, l: F.struct(v.alias("text"), l.alias("label")))
    mixed = F.flatten(F.zip_with(gaps, ents, lambda g, e: F.array(g, e)))
    return docs.select(key, F.posexplode(mixed).alias("i", "x")).where("x.text <> ''").select(key, "i", "x.text", "x.label")


def records_of_pieces(pieces: DataFrame, key: str = "id") -> DataFrame:
    """``(key, text, spans)``: a labelled piece's span leaves out white space around it and commas, semicolons and colons behind it.

    Offsets are fixed after leading line breaks of the whole text are dropped, so they never shift.
    """
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    p = pieces.withColumn("at", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    core = F.regexp_replace("text", r"^\p{IsWhite_Space}+|[\p{IsWhite_Space},;:]+$", "")
    lead = F.length("text") - F.length(F.regexp_replace("text", r"^\p{IsWhite_Space}+", ""))
    p = p.withColumn("s", (F.col("at") + lead).cast("int")).withColumn("e", (F.col("at") + lead + F.length(core)).cast("int"))
    g = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("ts"), F.array_sort(F.collect_list(F.when(F.col("label").isNotNull() & (core != ""), F.struct("s", "e", "label")))).alias("ss"))
    whole = F.array_join(F.transform("ts", lambda x: x["text"]), "")
    g = g.withColumn("whole", whole).withColumn("cut", F.length("whole") - F.length(F.regexp_replace("whole", r"^\n+", "")))
    spans = F.transform("ss", lambda x: F.struct((x["s"] - F.col("cut")).cast("int").alias("start"), (x["e"] - F.col("cut")).cast("int").alias("end"), x["label"].alias("label")))
    return g.select(key, F.regexp_replace("whole", r"^\n+|\n+$", "").alias("text"), spans.alias("spans"))


def assemble(records: DataFrame, residual: Column, least_chars: int = 250) -> DataFrame:
    """Records with a ``reason`` they would be dropped for: names left unlabelled (an array column), too short, or without a span; null when kept."""
    short = (F.length("text") < least_chars) | (F.coalesce(F.size("spans"), F.lit(0)) <= 0)
    return records.withColumn("reason", F.when(F.size(residual) > 0, F.concat(F.lit("unlabelled name: "), F.get(residual, F.lit(0)))).when(short, F.lit("too short")))


def unlabelled_text(text: Column | str, spans: Column | str) -> Column:
    """The text with every labelled span blanked by a bar, so that no name runs across it."""
    t, s = col(text), F.array_sort(F.coalesce(col(spans), F.expr("cast(array() as array<struct<start:int,end:int,label:string>>)")))
    acc = F.aggregate(s, F.struct(F.lit("").alias("o"), F.lit(0).alias("p")), lambda a, x: F.struct(F.concat(a["o"], F.substring(t, a["p"] + 1, F.greatest(x["start"] - a["p"], F.lit(0))), F.lit(" | ")).alias("o"), F.greatest(a["p"], x["end"]).alias("p")))
    return F.concat(acc["o"], F.substring(t, acc["p"] + 1, F.length(t)))


def document_errors(text: Column | str, negative: Column | None = None) -> Column:
    t = col(text)
    plain = plain_text(t)
    none = F.regexp_count(t, F.lit(ENTITY)) == 0
    return F.concat(markup_errors(t), present([(none & ~(negative if negative is not None else F.lit(False)), "no entity"), (plain.rlike(r"\{\{|\}\}"), "slot syntax in a document"), (F.contains(t, F.lit("\r")), "CR line ends")]))


def template_parts(text: Column | str) -> dict[str, Column]:
    """Header values and the body without comment lines."""
    t = col(text)
    head = lambda k: F.nullif(F.regexp_extract(t, rf"(?m)^#{k}:\s*(\S+)\s*$", 1), F.lit(""))
    body = F.array_join(F.filter(F.split(t, "\n", -1), lambda l: ~l.startswith("#")), "\n")
    return {"country": head("country"), "doctype": head("doctype"), "body": F.regexp_replace(body, r"^\n+|\n+$", "")}


def slots(body: Column) -> Column:
    """``ARRAY<STRUCT<slot, kind, n, form, sector, ref_kind, ref_n>>`` in order; absent parts are empty."""
    names = ["slot", "kind", "n", "form", "sector", "ref_kind", "ref_n"]
    return F.arrays_zip(*[F.regexp_extract_all(body, F.lit(SLOT), F.lit(k)).alias(c) for k, c in enumerate(names)])


def template_errors(text: Column | str) -> Column:
    p = template_parts(text)
    s = slots(p["body"])
    allowed = lambda x: F.coalesce(F.element_at(F.create_map(*[y for k, v in SLOT_FORMS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))]), x["kind"]), F.array(F.lit("")))
    kinds = F.array(*map(F.lit, [*SLOT_FORMS, *PLAIN_SLOTS]))
    bound = F.transform(F.filter(s, lambda x: x["kind"].isin("PER", "ORG") & (x["n"] != "")), lambda x: F.concat_ws("#", x["kind"], x["n"]))
    rest = F.regexp_replace(p["body"], SLOT, "")
    tests = [
        (F.coalesce(~p["country"].isin(COUNTRIES), F.lit(True)), "bad or missing country"), (F.coalesce(~p["doctype"].isin(DOCTYPES), F.lit(True)), "bad or missing doctype"),
        (F.exists(s, lambda x: ~F.array_contains(kinds, x["kind"])), "unknown slot"),
        (F.exists(s, lambda x: F.array_contains(kinds, x["kind"]) & ~F.array_contains(allowed(x), x["form"])), "unknown form"),
        (F.exists(s, lambda x: (x["sector"] != "") & ((x["kind"] != "ORG") | ~x["sector"].isin(SECTORS))), "bad sector"),
        (F.exists(s, lambda x: (x["ref_kind"] != "") & ~x["kind"].isin("EMAIL", "URL")), "only EMAIL and URL take a reference"),
        (F.exists(s, lambda x: (x["ref_kind"] != "") & ~F.array_contains(bound, F.concat_ws("#", x["ref_kind"], x["ref_n"]))), "reference to an entity that is not in the template"),
        (F.exists(s, lambda x: (x["kind"] == "TITLE") & (x["n"] == "")), "TITLE needs a number"), (F.exists(s, lambda x: (x["kind"] == "PUBLIC") & (x["n"] == "")), "PUBLIC needs a number"),
        (rest.rlike(r"\{\{|\}\}"), "malformed slot"), (F.size(s) + F.regexp_count(rest, F.lit(ENTITY)) < 8, "fewer than 8 slots and entities"),
        (~F.exists(s, lambda x: (x["kind"] == "PER") & (x["n"] != "")), "no person"), (F.contains(col(text), F.lit("\r")), "CR line ends"),
    ]
    return F.concat(present(tests), markup_errors(rest))


def inventory_errors(inventories: DataFrame, min_sizes: dict[str, int] | None = None, per_sector: int = 25) -> DataFrame:
    """``(country, problem)`` of inventories in columns (``given_names ARRAY<STRUCT<name, gender>>``, ``surnames ARRAY<STRUCT<name>>``, ``org_names MAP`` …)."""
    have = set(inventories.columns)
    if missing := [k for k in INVENTORY_KEYS if k not in have]:
        return inventories.select(F.col("country") if "country" in have else F.lit(None).cast("string").alias("country"), F.explode(F.array(*[F.lit(f"missing {k}") for k in missing])).alias("problem"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    tests = [(F.coalesce(~F.col("country").isin(COUNTRIES), F.lit(True)), F.lit("bad country"))]
    tests += [(size(k) < n, F.concat(F.lit(f"{k}: "), size(k).cast("string"), F.lit(f" < {n}"))) for k, n in (min_sizes or MIN_SIZES).items()]
    tests += [(F.coalesce(size(F.element_at("org_names", F.lit(s))), F.lit(0)) < per_sector, F.lit(f"org_names.{s}: too few")) for s in SECTORS]
    tests += [
        (F.exists("given_names", lambda g: F.coalesce(~g["gender"].isin("m", "f", "x"), F.lit(True)) | (F.coalesce(g["name"], F.lit("")) == "")), F.lit("bad given name")),
        (F.exists("places", lambda p: F.coalesce(p["town"], F.lit("")) == ""), F.lit("bad place")),
        (F.exists("public_bodies", lambda b: F.coalesce(b["local"] != F.contains(b["name"], F.lit("{town}")), F.lit(True))), F.lit("bad public body")),
        (F.exists(F.concat("units", "po_box"), lambda u: ~F.contains(u, F.lit("{n}"))), F.lit("unit or po box without {n}")),
    ]
    for k in ("given_names", "surnames"):
        names = F.transform(k, lambda x: x["name"])
        tests.append((F.size(F.array_distinct(names)) < F.size(names), F.lit(f"{k}: duplicates")))
    found = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), m) for t, m in tests]), lambda x: x.isNotNull())
    return inventories.select("country", F.explode(found).alias("problem"))
