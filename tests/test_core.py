"""Text, identifiers, isolation, intents, scores, sampling, markup, registers, sources and streams on small fixtures."""

import json
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import identifiers as ids
from spanloom.functions import text as tx
from spanloom.session import once
from spanloom.operators import align, generate, intent, isolation, markup, neardup, registry, sampling, scorecard
from spanloom.sources import files
from spanloom.streaming.detect import detect_stream


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_title_case(spark):
    assert one(spark, "LOPEZ BAY ÉLODIE", tx.title_cased) == "Lopez BAY Élodie"
    assert one(spark, "", tx.title_cased) == "" and one(spark, None, tx.title_cased) is None
    assert one(spark, "İSTANBUL Wort ABCD1", tx.title_cased) == "İstanbul Wort Abcd1"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("aBÇé张 1-", max_size=12), min_size=1, max_size=8))
def test_title_case_keeps_bytes(spark, xs):
    rows = spark.createDataFrame([(x,) for x in xs], "x string").select("x", tx.title_cased("x").alias("y")).collect()
    assert all(len(r.x.encode()) == len(r.y.encode()) and r.x.lower() == r.y.lower() for r in rows)


def test_offsets(spark):
    text = "aé张😀b"
    rows = spark.createDataFrame([(text, k) for k in range(-1, 8)], "t string, k int").select("k", tx.byte_offset("t", "k").alias("b"), tx.utf16_offset("t", "k").alias("u")).collect()
    for r in rows:
        if 0 <= r.k <= 5:
            assert (r.b, r.u) == (len(text[: r.k].encode()), len(text[: r.k].encode("utf-16-le")) // 2)
        else:
            assert r.u is None
    got = {r.k: r.u for r in spark.createDataFrame([(text, k) for k in range(-1, 13)], "t string, k int").select("k", tx.utf16_of_byte("t", "k").alias("u")).collect()}
    edges = {len(text[:i].encode()): len(text[:i].encode("utf-16-le")) // 2 for i in range(6)}
    assert got == {k: edges.get(k) for k in range(-1, 13)}


def test_folds(spark):
    d = spark.createDataFrame([("Straße d’Été",), (None,)], "x string")
    assert [r.y for r in d.select(tx.fold_lower("x").alias("y")).collect()] == ["strasse d'ete", None]
    assert [r.y for r in d.select(tx.slug("x").alias("y")).collect()] == ["straedete", None]
    assert one(spark, "Hello,  WORLD_x", tx.norm) == "hello world x"


def test_names_and_dates(spark):
    same = lambda a, b: spark.range(1).select(tx.same_name(F.lit(a), F.lit(b)).alias("y")).first().y
    assert same("Rani Lebar", "LEBAR Rani") and not same("Rani", "Lebar") and not same("", "")
    assert one(spark, "Tribunal de Commerce de Reims", tx.court_pieces) == ["Tribunal de Commerce de ", "Reims"]
    assert one(spark, "Greffe", tx.court_pieces) == ["Greffe", None]
    assert one(spark, "2024-03-05", tx.fr_date) == "05/03/2024" and one(spark, "x", tx.fr_date) is None
    assert one(spark, "2024-09-12", tx.es_long_date) == "12 de septiembre de 2024" and one(spark, "2024-09-12", tx.es_weekday) == "jueves"
    assert one(spark, "Anna Maria Bell", tx.is_plain_name) and not one(spark, "Anna 3", tx.is_plain_name)
    assert one(spark, "abcdefghij", tx.grouped) == "abcd efgh ij"
    found = one(spark, "seen Anna Marlow and SL SA, Registro Mercantil", lambda c: tx.residual_names(c, "Registro Mercantil"))
    assert found == ["Anna Marlow"]
    assert one(spark, '["a","b"]', tx.as_list) == ["a", "b"] and one(spark, "a", tx.as_list) == ["a"] and one(spark, None, tx.as_list) == []


def test_strip_tags(spark):
    html = '<script>"</p>"</script><h1>T &amp; x</h1><p>a  b<br/>c , d</p>\n\n<li>e</li>'
    assert one(spark, html, tx.strip_tags) == "T & x\na b\nc, d\ne"
    assert spark.createDataFrame([("&eacute;&#x41;",)], "x string").select(tx.unescape_all("x").alias("y")).first().y == "éA"


def test_every_generated_identifier_is_valid_and_no_changed_one(spark):
    d = spark.range(60)
    for kind in ids.KINDS:
        r = once(d, v=ids.generate(kind, F.col("id"), 5)).select("v", ids.VALIDATORS[kind]("v").alias("ok")).collect()
        assert all(x.ok for x in r), (kind, [x.v for x in r if not x.ok][:3])
    for kind in ("siren", "card", "fr_iban", "es_iban", "dni", "nhs", "nir"):
        v = F.col("v")
        last = F.regexp_extract(v, r"(\d)\D*$", 1).cast("int")
        bad = F.concat(F.regexp_extract(v, r"^(.*)\d\D*$", 1), ((last + 1) % 10).cast("string"), F.regexp_extract(v, r"\d(\D*)$", 1))
        made = once(once(d, v=ids.generate(kind, F.col("id"), 5)), bad=bad)
        assert not any(x.ok for x in made.select(ids.VALIDATORS[kind]("bad").alias("ok")).collect()), kind


def test_known_identifiers(spark):
    cases = [(ids.is_iban, "GB82 WEST 1234 5698 7654 32", True), (ids.is_iban, "GB83 WEST 1234 5698 7654 32", False), (ids.is_be_enterprise, "0202.239.951", True), (ids.is_ch_avs, "756.9217.0769.85", True),
             (ids.is_ch_uid, "CHE-100.155.212", True), (ids.is_nino, "BG 12 34 56 A", False), (ids.is_us_ssn, "666-12-3456", False), (ids.is_nhs, "943 476 5919", True), (ids.is_es_cif, "A58818501", True),
             (ids.is_vat, "FR40303265045", True), (ids.is_vat, "FR41303265045", False), (ids.is_ie_pps, "1234567T", True)]
    for f, v, exp in cases:
        assert one(spark, v, f) is exp, v
        assert one(spark, None, f) is None and one(spark, "", f) is False
    assert one(spark, "1 234,50 €", lambda c: ids.has_shape(c, "amount")) and one(spark, "+33 6 12 34 56 78", lambda c: ids.has_shape(c, "phone"))


def test_isolation(spark):
    tests = spark.createDataFrame([("t1", "one two three four five six seven eight nine", [("PERSON", "Ada Marsh"), ("COMPANY", "dental care"), ("DATE", "x y")])], "case_id string, text string, expected array<struct<type:string,value:string>>")
    words = "one two three four five six seven eight nine"
    items = spark.createDataFrame([("a", words, "registry"), ("b", "x ADA MARSH_ y", "template"), ("t1", None, None), ("c", "XAda Marsh", "t"), ("c", "XAda Marsh", "t"), (None, "", "t")], "id string, text string, source string")
    assert isolation.shared_runs(items, tests, key="id", more_than=1).collect()[0]["n_shared"] == 2
    assert isolation.shared_runs(items, tests, key="id", more_than=2).count() == 0
    got = {(r.id, r.kind, r.detail) for r in isolation.violations(items, tests).collect()}
    assert got == {("b", "name", "ada marsh"), ("t1", "id", "t1")}
    real = spark.createDataFrame([("ADA MARSH",)], "name string")
    assert isolation.test_names(tests, real).count() == 0
    v = spark.createDataFrame([("Ada Marsh",), ("12 Mill Lane",)], "value string")
    assert {r.part for r in isolation.generator_values(v).collect()} == {"ada marsh", "ada", "marsh", "12 mill lane", "mill lane"}
    assert isolation.unblocked(spark.createDataFrame([("ADA",), ("Ben",)], "value string"), isolation.generator_values(v)).collect()[0].value == "Ben"


def test_near_duplicates_match_brute_force(spark):
    base = ["Hide all the names in this letter please", "Masque les noms dans cette lettre", "隐藏所有姓名", "Hide all the names in this letter, please!", "", None, "zzz"]
    a = spark.createDataFrame([(str(i), t) for i, t in enumerate(base)] + [("0", base[0])], "id string, instruction string")
    h = spark.createDataFrame([("h1", "Hide all names in that letter please"), ("h2", "隐藏所有名字"), ("h3", None)], "id string, instruction string")
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    exp = {(str(i), k, round(SequenceMatcher(None, norm(t), norm(x)).ratio(), 6)) for i, t in enumerate(base) for k, x in (("h1", "Hide all names in that letter please"), ("h2", "隐藏所有名字")) if norm(t) and SequenceMatcher(None, norm(t), norm(x)).ratio() >= 0.6}
    assert {tuple(r) for r in neardup.close_to(a, h, least=0.6).collect()} == exp and exp


def test_token_labels(spark):
    t = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 3, 6), (1, 2, 6, 6), (1, 3, 7, 9), (2, 0, 0, 1)], "doc_id int, i int, start int, end int")
    s = spark.createDataFrame([(1, 1, 8, "PER"), (1, 8, 9, "LOC")], "doc_id int, start int, end int, label string")
    got = [r.label for r in align.token_labels(t, s).orderBy("doc_id", "i").collect()]
    assert got == ["B-PER", "I-PER", "-100", "B-PER", "O"]


KW = intent.Keywords({"regions": {"fr": ["french", "法国"]}, "verticals": {"finance": ["US"]}, "case_sensitive": ["US"], "star_cues": ["only"], "except": {"fr": ["french fries"]}})


def parsed(spark, raw):
    return spark.createDataFrame([(raw,)], "r string").select(intent.parse("r").alias("i"), intent.canonical(intent.parse("r")).alias("c")).first()


def test_intent_parse(spark):
    good = {'{"types":{"*":"hide","PERSON":"hide"},"regions":[]}': '{"types":{"*":"hide"}}', '{"unsupported":true,"dictionary":["a \\" b"]}': '{"dictionary":["a \\" b"],"unsupported":true}', "{}": "{}", '{"unsupported":false}': "{}"}
    for raw, exp in good.items():
        assert parsed(spark, raw).c == exp, raw
    for raw in ("", "[]", "{", '{"x":1}', '{"types":{"PERSON":"drop"}}', '{"types":{"FOO":"hide"}}', '{"regions":["fr","fr"]}', '{"regions":["xx"]}', '{"dictionary":[""]}', '{"dictionary":[1]}', '{"types":{"PERSON":"hide","PERSON":"keep"}}', '{"regions":null}', '"a"', None):
        assert parsed(spark, raw).i is None, raw
    why = {'{"x":1}': "unknown key", '{"types":{"FOO":"hide"}}': "types", '{"regions":["fr","fr"]}': "regions", '{"dictionary":[1]}': "dictionary", "[]": "no JSON object", '{"types":{"PERSON":"hide","PERSON":"keep"}}': "repeated key", "{}": None, '{"unsupported":1}': "unsupported"}
    got = spark.createDataFrame([(r,) for r in [*why, None]], "r string").select("r", intent.parse_error("r").alias("e")).collect()
    assert {r.r: r.e for r in got} == why | {None: "no JSON object"}
    schema = {"properties": {"types": {"propertyNames": {"enum": ["*", "PERSON"]}, "additionalProperties": {"enum": ["hide"]}}, "regions": {"items": {"enum": ["fr"]}}, "verticals": {"items": {"enum": ["legal"]}}}}
    assert '\\"legal\\"' in intent.grammar(schema) and "IBAN" not in intent.grammar(schema)
    assert not intent.grammar_is_stale(intent.grammar(schema) + "\n", schema) and intent.grammar_is_stale(intent.grammar(), schema)


def test_postprocess(spark):
    rows = [("only french fries", '{"types":{"*":"off","PERSON":"hide"}}'), ("hide it in french", '{"types":{"*":"keep","PERSON":"keep"}}'), ('say {"types":{}} ', '{"types":{"*":"hide","PERSON":"hide","DATE":"keep"}}'),
            ("Élan US", '{"dictionary":["elan","other"],"verticals":["finance","legal"]}'), ("us", "{}"), (None, "{}"), ("x", "bad")]
    d = spark.createDataFrame(rows, "instruction string, raw string").withColumn("intent", intent.parse("raw"))
    got = [r.c for r in intent.postprocess(d, KW).select(intent.canonical(F.col("final")).alias("c")).collect()]
    assert got == ['{"types":{"*":"off","PERSON":"hide"}}', '{"types":{"PERSON":"keep"},"regions":["fr"]}', '{"types":{"PERSON":"hide"}}', '{"verticals":["finance","legal"],"dictionary":["elan"]}', "{}", "{}", None]
    assert "root ::=" in intent.grammar() and '\\"IBAN\\"' in intent.grammar()
    eff = spark.range(1).select(intent.effective(F.create_map(F.lit("*"), F.lit("off"), F.lit("DATE"), F.lit("hide"))).alias("e")).first().e
    assert eff["DATE"] == "hide" and eff["PERSON"] == "off" and len(eff) == 16


def test_scorecard(spark):
    cases = [("a", "en", ["x"], '{"types":{"PERSON":"hide"}}', '{"types":{"*":"off"}}'), ("b", "en", ["x", "y"], '{"unsupported":true}', "{}"), ("c", "fr", None, '{"types":{"*":"keep"}}', "{}"), ("d", "fr", [], '{"regions":["fr"]}', '{"regions":["fr"]}'), ("e", "fr", [], "{}", "no")]
    d = spark.createDataFrame(cases, "id string, lang string, tags array<string>, want string, raw string")
    c = d.select("id", "lang", "tags", intent.parse("want").alias("expect"))
    p = d.select("id", intent.parse("raw").alias("got"), F.lit(5).alias("ms"))
    m = scorecard.marks(scorecard.joined(c, p))
    sev = {r.id: r.severity for r in m.collect()}
    assert sev == {"a": ["leak"], "b": ["unwarned"], "c": sev["c"], "d": None, "e": ["minor"]} and "leak" not in sev["c"]
    s = scorecard.summary(m).first()
    assert (s.n, s.exact, s.invalid) == (5, 1, 1)
    assert {(r.grp, r.value, r.hits, r.total) for r in scorecard.breakdown(m).collect()} == {("lang", "en", 0, 2), ("lang", "fr", 1, 3), ("tag", "x", 0, 2), ("tag", "y", 0, 1)}
    with pytest.raises(Exception, match="no prediction"):
        scorecard.joined(c, p.where("id <> 'a'")).collect()
    q = scorecard.index_percentiles(spark.createDataFrame([(x,) for x in [5, 1, 3, 2, None]], "ms int"), "ms", {"p50": (1, 2), "p90": (9, 10)}).first()
    assert (q.p50, q.p90) == (3, 5)


def test_sampling(spark):
    d = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("lang"))
    for buckets in (1, 7, 1024):
        r = sampling.dev_split(d, 0.1, "id", "lang", buckets=buckets).where("in_dev").groupBy("lang").count().collect()
        assert sorted((x.lang, x["count"]) for x in r) == [(0, 3), (1, 3), (2, 3)]
    assert sampling.dev_split(d.limit(3), 0.1, "id", more_than=3).where("in_dev").count() == 0
    q = spark.createDataFrame([("a", i, 10) for i in range(6)], "g string, i int, n int")
    assert sorted(r.i for r in sampling.quota(q, "n", F.lit(25), ["i"], ["g"]).collect()) == [0, 1, 2]
    assert sampling.capped(q, "g", 2, ["i"]).count() == 2 and sampling.round_robin(q.select(F.col("i").alias("slot")), q.select(F.col("i").alias("id")).limit(0)).count() == 0
    f = sampling.first_of(spark.createDataFrame([("k", 2, None), ("k", 1, "x"), (None, 3, "y")], "k string, o int, v string"), "k", ["o"])
    assert {tuple(r) for r in f.collect()} == {("k", 1, "x"), (None, 3, "y")}


def test_markup(spark):
    text = "\nDear [[PER|Ada Marsh]], see [[ORG|Granite;]] on [[DATE|1 May]]\n"
    d = spark.createDataFrame([("a", text), ("b", "no [[PER| x]] [[ stray"), ("c", ""), ("d", None)], "id string, text string")
    spans = markup.markup_spans(d.where("id = 'a'")).orderBy("start").collect()
    plain = "\nDear Ada Marsh, see Granite; on 1 May\n"
    assert [plain[r.start : r.end] for r in spans] == [r.value for r in spans] == ["Ada Marsh", "Granite;", "1 May"]
    errors = {r.id: r.e for r in d.select("id", markup.markup_errors("text").alias("e")).collect()}
    assert errors["a"] == [] and errors["b"] == ["untrimmed value", "stray [["]
    rec = markup.records_of_pieces(markup.pieces_of_markup(d)).where("id = 'a'").first()
    assert rec.text == plain.strip("\n") and [rec.text[s.start : s.end] for s in rec.spans] == ["Ada Marsh", "Granite", "1 May"]
    doc = {r.id: r.e for r in d.select("id", markup.document_errors("text").alias("e")).collect()}
    assert "no entity" in doc["c"] and doc["a"] == []


TEMPLATE = "#country: GB\n#doctype: letter\n# note\n{{PER#1:full}} {{PER#1:surname}} {{ORG#2:name@legal}} {{DATE:iso}} {{LOC#1:town}} {{EMAIL:PER#1}} {{REF}} {{NUM}}"


def test_templates(spark):
    bad = ["x", TEMPLATE.replace("GB", "XX"), TEMPLATE.replace("{{REF}}", "{{FOO}}"), TEMPLATE.replace(":iso", ":isoo"), TEMPLATE.replace("EMAIL:PER#1", "EMAIL:PER#9"), TEMPLATE + "{{"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([TEMPLATE, *bad])], "i int, t string").select("i", markup.template_errors("t").alias("e")).collect()
    got = {r.i: r.e for r in rows}
    assert got[0] == [] and all(got[i] for i in range(1, 7))
    assert got[2] == ["bad or missing country"] and got[3] == ["unknown slot"] and got[4] == ["unknown form"] and got[6] == ["malformed slot"]


def test_render_is_consistent(spark):
    inv = spark.createDataFrame([("GB", ["Ada", "Ben", "Cy"], ["Marsh", "Lowell"], ["Ms"], ["Granite Supply"], ["Ltd"], ["GS"], ["Mill Lane"], ["Unit {n}"], ["clerk"], ["Billing"], ["{town} Council"], [("Leeds", "LS1 4AP", "Yorkshire")])],
        "country string, given_names array<string>, surnames array<string>, titles array<string>, org_names array<string>, legal_forms array<string>, acronyms array<string>, streets array<string>, units array<string>, jobs array<string>, departments array<string>, public_bodies array<string>, places array<struct<town:string,postcode:string,region:string>>")
    t = spark.createDataFrame([("t", "#country: GB\n#doctype: letter\nA {{PER#1:given}} B {{PER#1:given}} C {{DATE:iso}}.")], "id string, text string")
    docs = spark.range(20).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit("t").alias("id"), F.lit("en").alias("lang"))
    rec = markup.records_of_pieces(generate.render(t, inv, docs), "doc_id").collect()
    given = [re.fullmatch(r"A (.+) B \1 C .+\.", r.text) for r in rec]  # now and then a second given name
    assert len(rec) == 20 and all(given) and all(set(m[1].split(" ")) <= {"Ada", "Ben", "Cy"} for m in given)
    assert all(r.text[r.spans[0].start : r.spans[0].end] == m[1] for r, m in zip(rec, given))


def test_every_slot_is_filled(spark):
    countries = ("GB", "IE", "US", "FR", "BE", "CH", "ES")
    inv = spark.createDataFrame([(c, ["Ada", "Ben"], ["f", "m"], ["Marsh"], ["X"], {"f": ["Ms"], "m": ["Mr"]}, ["Granite"], ["Ltd"], ["GS"], ["Mill Lane"], ["Unit {n}"], ["clerk"], ["Billing"], ["{town} Council"], [("Leeds", "LS1", "York")]) for c in countries],
        "country string, given_names array<string>, genders array<string>, surnames array<string>, titles array<string>, titles_by map<string,array<string>>, org_names array<string>, legal_forms array<string>, acronyms array<string>, streets array<string>, units array<string>, jobs array<string>, departments array<string>, public_bodies array<string>, places array<struct<town:string,postcode:string,region:string>>")
    plain = [*generate.BY_COUNTRY, *generate.ANYWHERE]
    t = spark.createDataFrame([(c, f"#country: {c}\n#doctype: letter\n" + "\n".join(f"{{{{{k}}}}}" for k in plain) + "\n{{TITLE}}") for c in countries], "id string, text string")
    docs = t.select(F.concat(F.lit("d"), "id").alias("doc_id"), "id", F.lit("en").alias("lang"))
    rendered = markup.records_of_pieces(generate.render(t, inv, docs), "doc_id").collect()
    assert len(rendered) == 7
    for r in rendered:
        lines = r.text.split("\n")
        assert len(lines) == len(plain) + 1 and all(lines) and lines[-1] in ("Ms", "Mr"), lines


def test_registers(spark):
    act = "115535 - VIÑA ALTA. SOCIEDAD LIMITADA. Constitución. Comienzo: 1.02.20. Domicilio: C/ MAYOR 1 (MADRID). Adm. Unico: PEREZ ANA;ACME SL. Datos."
    got = [(act[a:b], k) for a, b, k in registry.act_spans(act)]
    assert got == [("VIÑA ALTA. SOCIEDAD LIMITADA", "ORG"), ("1.02.20", "DATE"), ("C/ MAYOR 1 (MADRID)", "LOC"), ("PEREZ ANA", "PER"), ("ACME SL", "ORG")]
    assert registry.act_spans("no act") == [] and "".join(t for t, _ in registry.pieces_between(act, registry.act_spans(act))) == act
    lines = [(1, "MADRID"), (2, "115535 - A SL. Consti-"), (3, "tución. Datos."), (4, "Núm. 12"), (5, "SEVILLA"), (6, "115536 - B SL. X."), (7, "more")]
    acts = registry.spanish_acts(spark.createDataFrame([("f", n, x) for n, x in lines], "file string, line_no int, line string")).orderBy("act_no").collect()
    assert [(r.act, r.province) for r in acts] == [("115535 - A SL. Constitución. Datos.", "Madrid"), ("115536 - B SL. X. more", "Sevilla")]
    person = {"denomination": "ACME", "nom": "LEBAR", "prenom": "Rani", "nomCommercial": "Rani Lebar", "adresse": {"france": {"numeroVoie": "3", "nomVoie": "Rue A", "codePostal": "75001", "ville": "Paris"}}}
    n = spark.createDataFrame([("7", "2024-03-05", "A", "12", None, "Vente", "Avis", "Tribunal de Reims", json.dumps({"personne": person}), None, json.dumps({"dateEffet": "2024-03-01"}), None)] * 2,
        "numeroannonce string, dateparution string, publicationavis string, parution string, familleavis string, familleavis_lib string, typeavis_lib string, tribunal string, listepersonnes string, listeetablissements string, acte string, jugement string")
    pieces = registry.french_notices(n).orderBy("i").collect()
    labelled = [(r.text, r.label) for r in pieces if r.label]
    assert labelled == [("05/03/2024", "DATE"), ("Reims", "LOC"), ("ACME", "ORG"), ("LEBAR Rani", "PER"), ("3 Rue A, 75001 Paris", "LOC"), ("01/03/2024", "DATE")]
    graph = [{"@id": "x/court/1", "name": "High Court"}, {"@id": "p", "@type": ["gaz:Person"], "foaf:name": "Ada Marsh"}, {"@id": "o", "@type": "Company", "name": {"@value": "Granite Ltd"}, "vcard:locality": "Leeds"}, {"@id": "z", "@type": "Firm", "name": "The Gazette"}]
    v = registry.british_values(spark.createDataFrame([("n", json.dumps(graph))], "id string, graph string"))
    assert {(r.value, r.label) for r in v.collect()} == {("Ada Marsh", "PER"), ("Granite Ltd", "ORG"), ("Leeds", "LOC")}
    text = "Ada Marsh of Marsh Partners, 3 Mill Lane, Leeds, LS1 4AP formerly 4 High Road, E6 3RX. Ada Marshall on 3 May 2024."
    pages = spark.createDataFrame([("n", text), ("e", ""), ("z", None)], "id string, text string")
    spans = {(text[r.start : r.end], r.label) for r in align.label_by_values(pages, v).collect()}
    assert ("Ada Marsh", "PER") in spans and ("3 May 2024", "DATE") in spans and ("4 High Road, E6 3RX", "LOC") in spans


def test_unlabelled_names_drop_a_record(spark):
    texts = ["Ada Marsh lives here.", "In the High Court of Justice, Companies Court, Nature of Business: Rose Vale Tools", "Constitucion. Situación concursal. Ley 12 BODACC", "THE COMPANIES ACT Of Some Year\nJoint Liquidator Noel Pike", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", tx.residual_names("text", registry.BOILERPLATE).alias("n"))
    assert [r.n for r in d.orderBy("i").collect()] == [["Ada Marsh"], [], [], ["Noel Pike"], [], None]


def test_sources(spark, tmp_path):
    (tmp_path / "t/en").mkdir(parents=True)
    (tmp_path / "t/en/letter-1.txt").write_text("\n" + TEMPLATE + "\n")
    t = files.templates(spark, str(tmp_path / "t")).first()
    assert (t.id, t.lang, t.country, t.doctype) == ("letter-1", "en", "GB", "letter") and t.body.startswith("{{PER")
    (tmp_path / "d/fr").mkdir(parents=True)
    for n in ("be-invoice-1", "neg-2", "note"):
        (tmp_path / f"d/fr/{n}.txt").write_text("x")
    got = {r.id: (r.country, r.doctype) for r in files.documents(spark, str(tmp_path / "d")).collect()}
    assert got == {"be-invoice-1": ("BE", "invoice"), "neg-2": ("FR", "negatives"), "note": ("FR", None)}
    (tmp_path / "i").mkdir()
    (tmp_path / "i/gb.json").write_text(json.dumps({"country": "GB", "given_names": [{"name": "Ada", "gender": "f"}], "surnames": [{"name": "Marsh"}], "org_names": {"legal": ["X"]}, "streets": ["Mill Lane"]}))
    assert {(r.key, r.value) for r in files.inventory_entries(spark, str(tmp_path / "i")).collect()} == {("given_names", "Ada"), ("surnames", "Marsh"), ("org_names.legal", "X"), ("streets", "Mill Lane")}
    kept, drops = files.load_inventories(spark, str(tmp_path / "i"), spark.createDataFrame([("MARSH",), ("x",), (None,)], "part string"))
    assert {r.value for r in kept.collect()} == {"Ada", "Mill Lane"} and {(r.key, r.n_dropped) for r in drops.collect()} == {("given_names", 0), ("surnames", 1), ("org_names.legal", 1), ("streets", 0)}
    cases = spark.createDataFrame([([("PERSON", "mill lane")],), (None,)], "expected array<struct<type:string,value:string>>")
    assert [tuple(r) for r in files.inventory_violations(kept, cases).collect()] == [("GB", "streets", "Mill Lane", "mill lane")]
    rec = spark.createDataFrame([("a", "x" * 900, "s", "en", "GB", "train", 1), ("b", "y" * 450, "s", "en", "GB", "dev", 1)], "id string, text string, source string, lang string, country string, split string, base int")
    files.write_jsonl(rec, str(tmp_path / "out"), "split")
    back = files.read_jsonl(spark, str(tmp_path / "out/split=dev"), files.RECORD).first()
    assert back.id == "b"
    r = files.build_report(rec)
    assert tuple(r.first()) == ("s", "en", "GB", 1.0, 0.5, 1.0) and "| s | en |" in files.markdown(r)
    m = spark.createDataFrame([("en/letter-1.txt", __import__("hashlib").sha256((tmp_path / "t/en/letter-1.txt").read_bytes()).hexdigest()), ("no.txt", "x")], "path string, sha256 string")
    assert {tuple(x) for x in files.verify_files(spark, str(tmp_path / "t"), m).collect()} == {("en/letter-1.txt", "ok"), ("no.txt", "missing")}
    assert files.identifiers(spark, "siren", 3).count() == 3


def test_stream(spark, tmp_path):
    from spanloom.operators import decode
    from spanloom.plans.catalog import CASE_CONFIG, case_tokens

    src, out = tmp_path / "in", []
    spark.createDataFrame([(1, "Hello Marlow there"), (2, None), (3, "")], "doc_id int, text string").write.parquet(str(src))
    docs = spark.readStream.schema("doc_id int, text string").parquet(str(src))
    run = lambda b: decode.detections(decode.bio_spans(case_tokens(b.where("text is not null")), CASE_CONFIG), b, CASE_CONFIG)
    q = detect_stream(docs, run, lambda d, n: out.extend(d.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.value for r in out] and all(r.doc_id == 1 for r in out)


def test_catalog_runs_on_empty_tables(spark, data, tmp_path):
    """Queries over tables without rows end, with no row or with totals of none."""
    import os

    from spanloom.plans import catalog

    for name in os.listdir(data):
        spark.read.parquet(f"{data}/{name}").limit(0).write.parquet(str(tmp_path / name))
    for name in ("bio_detections", "window_merge", "viterbi_native", "shared_runs", "violations", "dev_split", "token_labels", "markup_records", "near_duplicates", "final_intents"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0, name


def test_span_labels_counts_every_label(spark, data, tmp_path):
    from spanloom.plans import catalog

    spans = F.expr("transform(sequence(1, 1200), i -> named_struct('start', 0, 'end', 1, 'label', concat('L', i)))")
    spark.read.parquet(f"{data}/train.parquet").where("id is not null and text is not null").limit(1).withColumn("spans", spans).write.parquet(f"{tmp_path}/train.parquet")
    assert catalog.span_labels(spark, str(tmp_path)).count() == 1200
