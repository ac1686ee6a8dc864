"""Synthetic records from templates and inventories, every choice a pure function of document, entity and seed.

Nothing is drawn in sequence: an entity ``PER#1`` of a document has the attributes its hash gives it wherever it is mentioned, so mentions are
rendered apart from each other, in parallel, and agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import identifiers
from spanloom.functions.text import ES_MONTHS, col, slug
from spanloom.operators.markup import COUNTRIES, slots, template_parts
from spanloom.session import once

#: Fixed values.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(), "es": ES_MONTHS,
}
#: Which identifier a slot is in each country; and slots that are the same everywhere.
BY_COUNTRY = {
    "IBAN": {"GB": "gb_iban", "IE": "ie_iban", "FR": "fr_iban", "BE": "be_iban", "CH": "ch_iban", "ES": "es_iban", "US": "account"},
    "NATID": {"GB": "nino", "IE": "ie_pps", "US": "us_ssn", "FR": "nir", "BE": "be_national", "CH": "ch_avs", "ES": "dni"},
    "COMPANYID": {"GB": "gb_company", "IE": "ie_company", "US": "us_company", "FR": "siren", "BE": "be_enterprise", "CH": "ch_uid", "ES": "es_cif"},
    "VAT": {"GB": "gb_vat", "IE": "ie_vat", "US": "us_taxid", "FR": "fr_vat", "BE": "be_vat", "CH": "ch_vat", "ES": "es_vat"},
    "TAXID": {"GB": "gb_taxid", "IE": "ie_pps", "US": "us_taxid", "FR": "fr_taxid", "BE": "be_national", "CH": "ch_avs", "ES": "dni"},
    **{slot: {c: f"{c.lower()}_{kind}" for c in ("GB", "IE", "US", "FR", "BE", "CH", "ES")} for slot, kind in (("PHONE", "phone"), ("MOBILE", "mobile"), ("PLATE", "plate"), ("BIC", "bic"))},
}
ANYWHERE = {"CARD4": "card4", "ACCOUNT": "account", "SORTCODE": "sortcode", "REF": "reference", "NUM": "number"}
#: Parts of persons and firms with a name of another form.
TWO_SURNAMES_US, HYPHEN_SURNAME, TWO_GIVEN, ACRONYM_FIRM = 0.05, 0.06, 0.12, 0.12
STYLES = [("normal", 60), ("caps_surname", 14), ("comma", 8), ("caps", 12), ("middle", 6)]


def draw(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def chosen(values: Column, seed: int, *keys: Column | str) -> Column:
    """An element of an array by hash; null of an empty or null one."""
    return F.get(values, F.floor(draw(seed, *keys) * F.size(values)).cast("int"))


def weighted_choice(pairs: list[tuple[str, int]], u: Column) -> Column:
    total, at, out = sum(w for _, w in pairs), 0, None
    for v, w in pairs[:-1]:
        at += w
        test = u < at / total
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(pairs[-1][0]) if out is not None else F.lit(pairs[0][0])


def slot_rows(templates: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Templates in parts ``(key, country, i, literal, slot struct)``: literals and slots by turns."""
    p = template_parts(F.col(text))
    bare = r"\{\{[A-Z0-9]+(?:#\d+)?(?::[a-z_]+(?:@[a-z]+)?)?(?::(?:PER|ORG)#\d+)?\}\}"
    t = templates.select(key, p["country"].alias("country"), p["body"].alias("body"))
    lit = F.transform(F.split("body", bare, -1), lambda g: g)
    s = slots(F.col("body"))
    z = F.arrays_zip(lit.alias("literal"), s.alias("slot"))
    return t.select(key, "country", F.posexplode(z).alias("i", "x")).select(key, "country", "i", "x.literal", "x.slot")


def person_name(form: Column, given_name: Column, surname: Column, style: Column, middle: Column, lang: Column) -> Column:
    """A person's mention in one of the forms, in the person's style."""
    full = (
        F.when(style == "caps_surname", F.concat_ws(" ", F.upper(surname), given_name)).when(style == "comma", F.concat_ws(", ", surname, given_name))
        .when(style == "caps", F.upper(F.concat_ws(" ", given_name, surname))).when((style == "middle") & (lang == "en"), F.concat(given_name, F.lit(" "), middle, F.lit(". "), surname))
        .otherwise(F.concat_ws(" ", given_name, surname))
    )
    initials = F.array_join(F.transform(F.split(given_name, "[ -]"), lambda x: F.concat(F.substring(x, 1, 1), F.lit("."))), "")
    swapped = F.when(lang.isin("es", "fr"), F.upper(F.concat_ws(" ", surname, given_name))).otherwise(F.concat_ws(", ", F.upper(surname), given_name))
    return (
        F.when(form == "given", given_name).when(form == "surname", F.when(style.isin("caps_surname", "caps"), F.upper(surname)).otherwise(surname))
        .when(form == "initial_surname", F.concat_ws(" ", initials, surname)).when(form == "surname_given", swapped).otherwise(full)
    )


def whole_names(given: Column, given2: Column, surname: Column, surname2: Column, country: Column, lang: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Given name and surname with a second one where the country has it or by chance: two surnames in Spanish, a hyphen now and then elsewhere."""
    both = (country == "ES") | (lang == "es") | ((country == "US") & (u < TWO_SURNAMES_US))
    last = F.when(both, F.concat_ws(" ", surname, surname2)).when(u >= 1 - HYPHEN_SURNAME, F.concat_ws("-", surname, surname2)).otherwise(surname)
    first = F.when((v < TWO_GIVEN) & (country != "ES") & (given2 != given), F.when(lang == "fr", F.concat_ws("-", given, given2)).otherwise(F.concat_ws(" ", given, given2))).otherwise(given)
    return first, last


def org_name(form: Column, name: Column, legal: Column, acronym: Column, mention: Column, u: Column) -> Column:
    """A firm's mention: with legal form, by name or acronym; from the second mention on often by its initials, sometimes in capitals."""
    initials = F.upper(F.array_join(F.transform(F.filter(F.split(name, r"[\s&-]+"), lambda x: F.length(x) > 2), lambda x: F.substring(x, 1, 1)), ""))
    plain = F.when(form == "acronym", acronym).when(form == "name", name).otherwise(F.concat_ws(" ", name, legal))
    out = F.when((mention > 1) & (u < 0.45) & (F.length(initials) >= 2), initials).otherwise(plain)
    return F.when(u >= 0.85, F.upper(out)).otherwise(out)


def loc_name(form: Column, number: Column, street: Column, town: Column, postcode: Column, region: Column, country: Column, unit: Column, u: Column) -> Column:
    """A place's mention; the order of parts follows the country."""
    anglo = country.isin("GB", "IE", "US")
    line = F.when(anglo, F.concat_ws(" ", number, street)).when(country.isin("BE", "CH"), F.concat_ws(" ", street, number)).otherwise(F.concat_ws(", ", street, number))
    code_town = F.when(country.isin("GB", "IE"), F.concat_ws(" ", town, postcode)).when(country == "US", F.concat_ws(" ", F.concat_ws(", ", town, region), postcode)).otherwise(F.concat_ws(" ", postcode, town))
    out = F.when(form == "street", line).when(form == "unit", unit).when(form == "postcode_town", code_town).when(form == "town", town).when(form == "region", region).when(form == "country", country).when(
        form == "po_box", F.concat_ws(" ", F.lit("PO Box"), number)).otherwise(F.concat_ws(", ", line, code_town))
    return F.when(u < 0.12, F.upper(out)).otherwise(out)


def date_text(form: Column, day: Column, lang: Column, country: Column, u: Column) -> Column:
    """A date in one of the forms of a language and country; English ordinals and the French ``1er`` included."""
    months = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    month = F.get(F.element_at(months, lang), F.month(day) - 1)
    d, y = F.dayofmonth(day), F.year(day).cast("string")
    ordinal = F.concat(d.cast("string"), F.when(d.isin(1, 21, 31), "st").when(d.isin(2, 22), "nd").when(d.isin(3, 23), "rd").otherwise("th"))
    english = F.when(country == "US", F.concat(month, F.lit(" "), d.cast("string"), F.lit(", "), y)).otherwise(F.concat_ws(" ", F.when(u < 0.15, ordinal).otherwise(d.cast("string")), month, y))
    long = F.when(lang == "en", english).when(lang == "es", F.concat_ws(" de ", d.cast("string"), month, y)).otherwise(F.concat_ws(" ", F.when(d == 1, "1er").otherwise(d.cast("string")), month, y))
    numeric = F.when(country == "US", F.date_format(day, "MM/dd/yyyy")).when(country == "CH", F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    short = F.concat_ws(" ", d.cast("string"), F.substring(month, 1, 3), F.substring(y, 3, 2))
    return F.when(form == "iso", F.date_format(day, "yyyy-MM-dd")).when(form.isin("numeric", "birth"), numeric).when(form == "day_month", F.concat_ws(" ", d.cast("string"), month)).when(form == "short", short).otherwise(long)


def amount_text(value: Column, country: Column) -> Column:
    """An amount with the country's currency, separators and order."""
    s = F.format_number(value, 2)
    euro = F.translate(s, ",.", ".,")
    return (
        F.when(country == "GB", F.concat(F.lit("£"), s)).when(country == "US", F.concat(F.lit("$"), s)).when(country == "IE", F.concat(F.lit("€"), s))
        .when(country == "FR", F.concat(F.translate(s, ",.", " ,"), F.lit(" €"))).when(country == "CH", F.concat(F.lit("CHF "), F.translate(s, ",", "'"))).otherwise(F.concat(euro, F.lit(" €")))
    )


def render(templates: DataFrame, inventories: DataFrame, docs: DataFrame, seed: int = 0, key: str = "id") -> DataFrame:
    """Pieces ``(doc_id, i, text, label)`` of documents ``(doc_id, id, lang)`` rendered from templates ``(id, text)``.

    Inventories: one row a country with arrays ``given_names, surnames, titles, org_names, legal_forms, acronyms, streets, units, jobs, departments,
    public_bodies`` of strings and ``places`` of ``STRUCT<town, postcode, region>``; with ``genders`` (beside the given names) and ``titles_by``
    (a map from gender to titles) a title follows the person's gender. A template whose country has no inventory gives nothing.
    """
    parts = slot_rows(templates, key)
    j = docs.select("doc_id", key, "lang").join(parts, key).join(inventories.withColumnRenamed("country", "_c"), F.col("country") == F.col("_c"))
    ent = F.concat_ws("#", "slot.kind", F.when(F.col("slot.n") != "", F.col("slot.n")).otherwise(F.concat(F.lit("at"), F.col("i").cast("string"))))
    ref = F.when(F.col("slot.ref_kind") != "", F.concat_ws("#", "slot.ref_kind", "slot.ref_n")).otherwise(ent)
    j = j.withColumn("ent", ent).withColumn("ref", ref).withColumn("u", draw(seed, "doc_id", "i"))
    w = Window.partitionBy("doc_id", "ent").orderBy("i")
    j = j.withColumn("mention", F.row_number().over(w))
    of = lambda c, salt, who="ent": chosen(F.col(c), seed + salt, "doc_id", who)
    place = of("places", 5)
    number = (F.floor(draw(seed + 6, "doc_id", "ent") * 180) + 1).cast("string")
    day = F.date_add(F.lit("2015-01-01").cast("date"), F.floor(draw(seed + 7, "doc_id", "ent") * 4000).cast("int"))
    first, last = whole_names(of("given_names", 1), of("given_names", 17), of("surnames", 2), of("surnames", 18), F.col("country"), F.col("lang"), draw(seed + 19, "doc_id", "ent"), draw(seed + 20, "doc_id", "ent"))
    person = person_name(F.col("slot.form"), first, last, weighted_choice(STYLES, draw(seed + 3, "doc_id", "ent")), chosen(F.array(*map(F.lit, "ABCDEFGHJKLMNPRSTW")), seed + 4, "doc_id", "ent"), F.col("lang"))
    short_firm = draw(seed + 21, "doc_id", "ent") < ACRONYM_FIRM  # a firm that nobody spells out
    org = org_name(F.col("slot.form"), F.when(short_firm, of("acronyms", 10)).otherwise(of("org_names", 8)), of("legal_forms", 9), of("acronyms", 10), F.col("mention"), F.col("u"))
    loc = loc_name(F.col("slot.form"), number, of("streets", 11), place["town"], place["postcode"], place["region"], F.col("country"), F.replace(of("units", 12), F.lit("{n}"), number), F.col("u"))
    k = F.col("slot.kind")
    who = F.concat_ws(".", slug(of("given_names", 1, "ref")), slug(of("surnames", 2, "ref")))
    ident = F.concat_ws("|", "doc_id", "ent")
    text = F.when(k == "PER", person).when(k == "ORG", org).when(k == "LOC", loc).when(k == "DATE", date_text(F.col("slot.form"), day, F.col("lang"), F.col("country"), F.col("u")))
    text = text.when(k == "AMOUNT", amount_text(F.round(5 + F.col("u") * F.when(F.col("slot.form") == "big", 250000).otherwise(3000), 2), F.col("country")))
    text = text.when(k == "EMAIL", F.concat(who, F.lit("@example.org"))).when(k == "URL", F.concat(F.lit("www."), who, F.lit(".example")))
    # only identifiers that the templates ask for enter the plan: at most a row a country and kind of slot
    asked = {(r["country"], r["kind"]) for r in parts.select("country", F.col("slot.kind").alias("kind")).where(F.col("country").isin(COUNTRIES) & F.col("kind").isin([*BY_COUNTRY, *ANYWHERE])).distinct().collect()}
    for slot, by in BY_COUNTRY.items():
        for country, gen in by.items():
            if (country, slot) in asked:
                text = text.when((k == slot) & (F.col("country") == country), identifiers.generate(gen, ident, seed))
    for slot, gen in ANYWHERE.items():
        if any(kind == slot for _, kind in asked):
            text = text.when(k == slot, identifiers.generate(gen, ident, seed))
    text = text.when(k == "JOB", of("jobs", 13)).when(k == "DEPT", of("departments", 14)).when(k == "PUBLIC", F.replace(of("public_bodies", 15), F.lit("{town}"), place["town"]))
    title = of("titles", 16, "ref")
    if {"genders", "titles_by"} <= set(inventories.columns):
        gender = F.get(F.col("genders"), F.floor(draw(seed + 1, "doc_id", "ref") * F.size("given_names")).cast("int"))
        title = F.coalesce(chosen(F.element_at("titles_by", gender), seed + 16, "doc_id", "ref"), title)
    text = text.when(k == "TITLE", title)
    lab = F.when(k.isin("PER", "ORG", "LOC", "DATE"), k)
    two = F.array(F.struct(F.col("literal").alias("text"), F.lit(None).cast("string").alias("label")), F.struct(text.alias("text"), lab.alias("label")))
    made = once(j, made=two)  # a barrier, so that the filter behind it doesn't make each text again
    p = made.select("doc_id", "i", F.posexplode("made").alias("k", "x")).where("x.text is not null and x.text <> ''")
    return p.select("doc_id", (F.col("i") * 2 + F.col("k")).alias("i"), "x.text", "x.label")


def substitute_names(pieces: DataFrame, pool: list[str], seed: int = 0, key: str = "doc_id", firms: list[str] | None = None) -> DataFrame:
    """Person names replaced word by word, the same word by the same one within a document, in its case; the order of words stays.

    With ``firms``, a firm's name of over four characters that is not in capitals becomes one of them, the same name the same one within a document.
    """
    values = F.array(*map(F.lit, pool))

    def other(w: Column) -> Column:
        new = chosen(values, seed, F.col(key), F.lower(w))
        return F.when(~w.rlike(r"\p{L}"), w).when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).when(w == F.lower(w), F.lower(new)).otherwise(new)

    words = F.split("text", r"(?<=\p{L})(?=[^\p{L}])|(?<=[^\p{L}])(?=\p{L})", -1)
    text = F.when(F.col("label") == "PER", F.array_join(F.transform(words, other), ""))
    if firms:
        text = text.when((F.col("label") == "ORG") & (F.length("text") > 4) & (F.col("text") != F.upper("text")), chosen(F.array(*map(F.lit, firms)), seed + 1, F.col(key), F.col("text")))
    return pieces.withColumn("text", text.otherwise(F.col("text")))


def augment(pieces: DataFrame, seed: int = 0, key: str = "doc_id", chat: Column | None = None) -> DataFrame:
    """Noise: lower-case persons in half of chats, 4 % of documents in capitals, 10 % with misread characters, long labelled places wrapped
    now and then, and one in five places with two commas or more put on a line a part, each part labelled."""
    doc, here = draw(seed + 1, key), draw(seed + 2, key, "i")
    t = F.col("text")
    t = F.when((chat if chat is not None else F.lit(False)) & (F.col("label") == "PER") & (draw(seed + 3, key) < 0.5), F.lower(t)).otherwise(t)
    t = F.when(F.col("label").isin("LOC", "ORG") & (F.size(F.split(t, " ")) >= 3) & (here > 0.95), F.regexp_replace(t, r"^(\S+ \S+) ", "$1\n")).otherwise(t)
    misread = F.translate(F.regexp_replace(t, "@", " @ "), "lO", "10")
    t = F.when((doc >= 0.04) & (doc < 0.14) & (here < 0.15), misread).otherwise(t)
    p = pieces.withColumn("text", F.when(doc < 0.04, F.upper(t)).otherwise(t))
    parts = F.split("text", ", ")
    apart = (F.col("label") == "LOC") & (F.size(parts) >= 3) & (draw(seed + 4, key, "i") < 0.2)
    none = F.lit(None).cast("string")
    lines = F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, F.array(F.struct(x.alias("text"), F.col("label").alias("label")))).otherwise(F.array(F.struct(F.lit(",\n").alias("text"), none.alias("label")), F.struct(x.alias("text"), F.col("label").alias("label"))))))
    each = F.when(apart, lines).otherwise(F.array(F.struct(F.col("text").alias("text"), F.col("label").alias("label"))))
    rows = p.select(key, "i", F.posexplode(each).alias("k", "x"))
    return rows.select(key, (F.col("i").cast("bigint") * 1000 + F.col("k")).alias("i"), "x.text", "x.label")
