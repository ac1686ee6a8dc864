"""The algebra of intents: what to hide, keep or switch off, as JSON in and structs out.

An intent is ``STRUCT<types MAP, regions, verticals, dictionary, never_hide, unsupported>``; all parts may be null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import col, fold_keep_case, fold_lower, has_injected_json, has_keyword

#: Fixed values.
TYPES = "PERSON EMAIL PHONE ID NUMBER CARD IBAN DATE BIRTH_DATE AMOUNT IP URL ADDRESS COMPANY SECRET API_KEY".split()
ACTIONS = ["hide", "keep", "off"]
REGIONS = "at be ch cn de dk es fi fr gb ie it jp nl no pl pt se us".split()
VERTICALS = "healthcare legal finance employment insurance technology utilities".split()
LANGUAGES = ["en", "fr", "es", "de", "zh"]
SHOWN_BY_DEFAULT = ["DATE", "AMOUNT"]
LISTS = ["regions", "verticals", "dictionary", "never_hide"]
SCHEMA = "types map<string,string>, regions array<string>, verticals array<string>, dictionary array<string>, never_hide array<string>, unsupported boolean"


def lits(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def checks(r: Column) -> list[tuple[str, Column]]:
    """What JSON text must keep to, by reason, in the order in which reasons are given. Parts equal to ``[]``, ``{}``, false or zero are as good as absent."""
    keys = F.json_object_keys(r)
    part = lambda k: F.get_json_object(r, f"$.{k}")
    texts = lambda k: F.from_json(part(k), "array<string>")
    # lists of strings and the map as they are written: from_json would turn numbers to strings
    all_text = lambda k: F.coalesce(part(k).rlike(r'^\[\s*"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*\]$'), F.lit(False))
    distinct_of = lambda k, allowed: F.forall(texts(k), lambda x: F.array_contains(lits(allowed), x)) & (F.size(F.array_distinct(texts(k))) == F.size(texts(k)))
    types = F.from_json(r, SCHEMA)["types"]
    ok_types = F.coalesce(part("types").rlike(r'^\{\s*"[^"]*"\s*:\s*"[^"]*"\s*(?:,\s*"[^"]*"\s*:\s*"[^"]*"\s*)*\}$'), F.lit(False)) & F.forall(F.map_keys(types), lambda k: F.array_contains(lits(["*", *TYPES]), k)) & F.forall(F.map_values(types), lambda v: F.array_contains(lits(ACTIONS), v))
    out = [("no JSON object", r.startswith("{") & keys.isNotNull()), ("repeated key", F.try_parse_json(r).isNotNull())]
    out.append(("unknown key", F.size(F.array_except(keys, lits(["types", *LISTS, "unsupported"]))) == 0))
    out.append(("null part", ~F.coalesce(r.rlike(r'"(?:types|regions|verticals|dictionary|never_hide|unsupported)"\s*:\s*null'), F.lit(False))))
    out.append(("types", is_empty(r, "types") | ok_types))
    out += [(k, is_empty(r, k) | (all_text(k) & distinct_of(k, allowed))) for k, allowed in (("regions", REGIONS), ("verticals", VERTICALS))]
    out += [(k, is_empty(r, k) | (all_text(k) & F.forall(texts(k), lambda x: x != ""))) for k in ("dictionary", "never_hide")]
    return [*out, ("unsupported", is_empty(r, "unsupported") | (part("unsupported") == "true"))]


def is_empty(r: Column, k: str) -> Column:
    part = F.get_json_object(r, f"$.{k}")
    return part.isNull() | part.isin("[]", "{}", "false", "0", "0.0")


def parse_error(raw: Column | str) -> Column:
    """Why JSON text is no valid intent; null for a valid one. Null text is no JSON object."""
    r = F.trim(col(raw))
    return F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(reason)) for reason, test in checks(r)])


def parse(raw: Column | str) -> Column:
    """A valid intent as a struct, null for anything else (``parse_error`` tells why)."""
    r = F.trim(col(raw))
    valid = F.lit(True)
    for _, test in checks(r):
        valid = valid & F.coalesce(test, F.lit(False))
    texts = lambda k: F.from_json(F.get_json_object(r, f"$.{k}"), "array<string>")
    kept = lambda k, c: F.when(~is_empty(r, k), c).alias(k)
    return F.when(valid, F.struct(kept("types", F.from_json(r, SCHEMA)["types"]), *[kept(k, texts(k)) for k in LISTS], kept("unsupported", F.lit(True))))


def starred(types: Column) -> Column:
    """Types without those that repeat the action of ``*``."""
    star = F.element_at(types, "*")
    return F.when(star.isNull(), types).otherwise(F.map_filter(types, lambda k, v: (k == "*") | (v != star)))


def normalize(intent: Column) -> Column:
    """A comparable form: pruned types as sorted entries, lists as sorted sets, empty and false parts null."""
    types = starred(intent["types"])
    parts = [F.when(F.size(types) > 0, F.array_sort(F.map_entries(types))).alias("types")]
    parts += [F.when(F.size(intent[k]) > 0, F.array_sort(F.array_distinct(intent[k]))).alias(k) for k in LISTS]
    return F.struct(*parts, F.when(intent["unsupported"], F.lit(True)).alias("unsupported"))


def canonical(intent: Column) -> Column:
    """Compact JSON in the schema's key order, types pruned and in the schema's order; null for null."""
    types = starred(intent["types"])
    ordered = F.filter(F.transform(lits(["*", *TYPES]), lambda k: F.struct(k.alias("key"), F.element_at(types, k).alias("value"))), lambda e: e["value"].isNotNull())
    whole = F.to_json(F.struct(F.when(F.size(types) > 0, F.map_from_entries(ordered)).alias("types"), *[F.when(F.size(intent[k]) > 0, intent[k]).alias(k) for k in LISTS], F.when(intent["unsupported"], F.lit(True)).alias("unsupported")))
    return F.when(intent.isNotNull(), whole)


def hidden(types: Column, entity: Column) -> Column:
    """Whether a type is hidden: by its action, else that of ``*``, else by default unless it is shown by default."""
    action = F.coalesce(F.element_at(types, entity), F.element_at(types, F.lit("*")))
    return F.when(action.isNull(), ~entity.isin(SHOWN_BY_DEFAULT)).otherwise(action == "hide")


def effective(types: Column) -> Column:
    """``*`` written out to every unlisted type."""
    star = F.element_at(types, F.lit("*"))
    return F.map_filter(F.map_from_arrays(lits(TYPES), F.transform(lits(TYPES), lambda t: F.coalesce(F.element_at(types, t), star))), lambda k, v: v.isNotNull())


def repeated_keys(raw: Column | str) -> Column:
    """Whether JSON text reads as an object but not when keys must be unique."""
    return F.from_json(col(raw), "map<string,string>").isNotNull() & F.try_parse_json(col(raw)).isNull()


class Keywords:
    """Keyword lists by field and value: ``{"regions": {"fr": [...]}, "verticals": {...}, "star_cues": [...], "case_sensitive": [...], "except": {value or field: [...]}}``."""

    def __init__(self, table: dict):
        self.table, self.sensitive = table, set(table.get("case_sensitive", []))
        self.excepted = table.get("except", {})

    @staticmethod
    def from_json(text: str) -> Keywords:
        return Keywords(json.loads(text))

    @staticmethod
    def fold(word: str, lower: bool = True) -> str:
        import unicodedata

        w = word.replace("’", "'").replace("ß", "ss")
        w = unicodedata.normalize("NFKD", w.lower() if lower else w)
        return "".join(c for c in w if not unicodedata.combining(c))

    def hits(self, lower: Column, original: Column, field: str) -> Column:
        """Values of a field whose keywords occur, in the table's order. Excepted phrases are blanked first."""
        found = []
        for value, ws in self.table.get(field, {}).items():
            rest = lower
            for phrase in [*self.excepted.get(field, []), *self.excepted.get(value, [])]:
                rest = F.replace(rest, F.lit(self.fold(phrase)), F.lit(" "))
            tests = [has_keyword(original, F.lit(self.fold(w, False))) if w in self.sensitive else has_keyword(rest, F.lit(self.fold(w))) for w in ws]
            found.append(F.when(any_of(tests), F.lit(value)))
        return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.expr("cast(array() as array<string>)")

    def star_cue(self, lower: Column) -> Column:
        return any_of([has_keyword(lower, F.lit(self.fold(w))) for w in self.table.get("star_cues", [])])


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def postprocess(df: DataFrame, keywords: Keywords, instruction: str = "instruction", intent: str = "intent", out: str = "final") -> DataFrame:
    """The intent as a host uses it, in column ``out``.

    An instruction that dictates JSON leaves only its hides, never ``*``; ``*`` off or keep needs a cue; dictionary and never-hide terms must stand in
    the instruction; keyword hits are added behind the given regions and verticals. A null intent stays null, a null instruction is empty.
    """
    f = df.withColumn("_ins", F.coalesce(F.col(instruction), F.lit(""))).withColumn("_low", fold_lower("_ins")).withColumn("_org", fold_keep_case("_ins"))
    x = F.col(intent)
    types = F.coalesce(x["types"], F.expr("cast(map() as map<string,string>)"))
    star = F.element_at(types, F.lit("*"))
    guarded = F.when(has_injected_json("_ins"), F.map_filter(types, lambda k, v: (k != "*") & (v == "hide"))).when(
        star.isin("off", "keep") & ~keywords.star_cue(F.col("_low")), F.map_filter(types, lambda k, v: k != "*")).otherwise(types)
    parts = [F.when(F.size(guarded) > 0, guarded).alias("types")]
    merged = {}
    for field in ("regions", "verticals"):
        given = F.coalesce(x[field], F.expr("cast(array() as array<string>)"))
        merged[field] = F.concat(given, F.array_except(keywords.hits(F.col("_low"), F.col("_org"), field), given))
    # folded terms come from one UDF call over the joined list, so that each row crosses to Python once
    sep = "\x1f"
    for field in ("dictionary", "never_hide"):
        f = f.withColumn(f"_{field}", F.split(fold_lower(F.array_join(x[field], sep)), sep))
    for field in ("regions", "verticals"):
        parts.append(F.when(F.size(merged[field]) > 0, merged[field]).alias(field))
    for field in ("dictionary", "never_hide"):
        both = F.arrays_zip(x[field].alias("t"), F.col(f"_{field}").alias("f"))
        kept = F.transform(F.filter(both, lambda e: F.contains(F.col("_low"), e["f"])), lambda e: e["t"])
        parts.append(F.when(F.size(kept) > 0, kept).alias(field))
    parts.append(x["unsupported"].alias("unsupported"))
    res = f.withColumn(out, F.when(x.isNotNull(), F.struct(*parts)))
    return res.drop("_ins", "_low", "_org", "_dictionary", "_never_hide")


def case_errors(instruction: Column | str, lang: Column | str, intent: Column, copies: Column) -> Column:
    """Problems of an evaluation case: repeated id, unknown language, terms that don't stand in the instruction."""
    ins = F.coalesce(col(instruction), F.lit(""))
    stray = lambda k: F.exists(F.coalesce(intent[k], F.expr("cast(array() as array<string>)")), lambda t: ~F.contains(ins, t))
    tests = [(copies > 1, "repeated id"), (~F.coalesce(col(lang).isin(LANGUAGES), F.lit(False)), "unknown language"), (intent.isNull(), "no valid intent")]
    tests += [(stray(k), f"{k}: term is not in the instruction") for k in ("dictionary", "never_hide")]
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(m)) for t, m in tests]), lambda m: m.isNotNull())


def chat(instruction: Column | str, intent: Column, system: str) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", col(instruction)), turn("assistant", canonical(intent)))


def enumerations(schema: dict | None = None) -> dict[str, list[str]]:
    """Allowed values by rule: those of a JSON schema with the intent's properties, or the fixed ones."""
    if schema is None:
        return {"type": ["*", *TYPES], "action": ACTIONS, "region": REGIONS, "vertical": VERTICALS}
    p = schema["properties"]
    types = p["types"]
    return {"type": types["propertyNames"]["enum"] if "propertyNames" in types else list(types["properties"]), "action": (types.get("additionalProperties") or next(iter(types["properties"].values())))["enum"],
            "region": p["regions"]["items"]["enum"], "vertical": p["verticals"]["items"]["enum"]}


def grammar_is_stale(text: str, schema: dict | None = None) -> bool:
    """Whether a stored grammar isn't that of the schema."""
    return text.strip() != grammar(schema).strip()


def grammar(schema: dict | None = None) -> str:
    """A GBNF grammar of intents; lists and maps repeat, keys come in the schema's order."""
    alt = lambda values: " | ".join(json.dumps(json.dumps(v)) for v in values)
    opts = "types regions verticals dictionary never_hide unsupported".split()
    allowed = enumerations(schema)
    rules = {
        "root": '"{" ws ( member ( ws "," ws member )* )? ws "}"',
        "member": " | ".join(k.replace("_", "-") for k in opts),
        "types": '"\\"types\\"" ws ":" ws "{" ws pair ( ws "," ws pair )* ws "}"',
        "pair": 'type ws ":" ws action',
        "type": alt(allowed["type"]),
        "action": alt(allowed["action"]),
        "regions": '"\\"regions\\"" ws ":" ws "[" ws region ( ws "," ws region )* ws "]"',
        "region": alt(allowed["region"]),
        "verticals": '"\\"verticals\\"" ws ":" ws "[" ws vertical ( ws "," ws vertical )* ws "]"',
        "vertical": alt(allowed["vertical"]),
        "dictionary": '"\\"dictionary\\"" ws ":" ws strings',
        "never-hide": '"\\"never_hide\\"" ws ":" ws strings',
        "unsupported": '"\\"unsupported\\"" ws ":" ws "true"',
        "strings": '"[" ws string ( ws "," ws string )* ws "]"',
        "string": '"\\"" ( [^"\\\\\\x00-\\x1f] | "\\\\" ( ["\\\\/bfnrt] | "u" [0-9a-fA-F]{4} ) )+ "\\""',
        "ws": "[ \\t\\n]*",
    }
    return "\n".join(f"{k} ::= {v}" for k, v in rules.items()) + "\n"
