"""Keeping test material out of training material: ids, names, word runs and blocked values.

The test side is small against the corpus, but is broadcast only when its bytes are measured and few (``bounded_broadcast``); else the same joins
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import col, has_name, is_plain_name, shingles, words
from spanloom.session import bounded_broadcast, once

#: Words that alone make no name.
GENERIC_WORDS = (
    "the of and a an y de del la le les des du bank banco banque insurance seguros assurance assurances group groupe grupo services service "
    "servicios dental medical health care clinic clinique clínica centre center practice solutions systems partners associates associés "
    "asociados limited ltd llp plc inc sa sl srl sarl sas company compagnie compañía société sociedad management gestion consulting energy "
    "energía énergie telecom mobile university college school hospital trust council"
).split()


def shared_ids(items: DataFrame, tests: DataFrame, key: str = "id", test_key: str = "case_id") -> DataFrame:
    """Items whose id is a test item's."""
    return items.join(tests.select(F.col(test_key).alias(key)).distinct(), key, "left_semi")


def run_table(df: DataFrame, key: str, text: str, size: int = 8) -> DataFrame:
    """Distinct ``(key, run)`` of word runs; rows with fewer words have none. Distinct in the row, so nothing is shuffled when keys are unique."""
    w = once(df.select(key, F.col(text).alias("_t")), _w=words("_t"))
    return w.select(key, F.explode(shingles("_w", size)).alias("run"))


def shared_runs(items: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", test_text: str = "text", size: int = 8, more_than: int = 3) -> DataFrame:
    """``(key, n_shared)`` of items that share more than so many distinct word runs with the test texts."""
    t = run_table(tests.withColumn("_k", F.lit(0)), "_k", test_text, size).select("run").distinct()
    hits = run_table(items, key, text, size).distinct().join(bounded_broadcast(t), "run")
    return hits.groupBy(key).agg(F.count("*").alias("n_shared")).where(F.col("n_shared") > more_than)


def test_names(tests: DataFrame, real: DataFrame | None = None, expected: str = "expected", types: tuple[str, ...] = ("PERSON", "COMPANY")) -> DataFrame:
    """Distinct folded names of the test items: of two words or more, not all generic, and not those of real organisations (column ``name``)."""
    v = tests.select(F.explode(expected).alias("e")).where(F.col("e.type").isin(*types)).select(F.lower("e.value").alias("name"))
    generic = F.array(*map(F.lit, GENERIC_WORDS))
    w = words("name")
    v = v.where((F.size(w) >= 2) & ~F.forall(w, lambda x: F.array_contains(generic, x))).distinct()
    return v.join(real.select(F.lower("name").alias("name")), "name", "left_anti") if real is not None else v


def names_in(items: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name") -> DataFrame:
    """``(key, name)`` of whole-word occurrences in any case: an equi-join on the name's first word, then the exact test on the text.

    Words meet the names first and carry no text; only pairs found get it back, so there is no cross join and no text a word. A name without a
    word never occurs.
    """
    n = names.select(F.col(name).alias("name"), F.element_at(words(name), 1).alias("w")).where("w is not null").distinct()
    w = items.select(F.col(key).alias("_k"), F.explode(F.array_distinct(words(text))).alias("w"))
    pairs = w.join(bounded_broadcast(n), "w").select("_k", "name").distinct()
    found = items.select(key, F.col(text).alias("_t")).join(pairs, F.col(key).eqNullSafe(F.col("_k")))
    return found.where(has_name("_t", "name")).select(key, "name").distinct()


def generator_values(values: DataFrame, value: str = "value") -> DataFrame:
    """Folded values, the words of those that look like a person's name, and streets without their number; distinct."""
    v = col(value)
    whole = values.select(F.lower(v).alias("part"))
    parts = values.where(is_plain_name(v)).select(F.explode(F.split(F.lower(F.trim(v)), r"\s+")).alias("part"))
    street = F.regexp_replace(v, r"^\d+\s+", "")
    streets = values.where(street != v).select(F.lower(street).alias("part"))
    return whole.union(parts).union(streets).where("part is not null and part <> ''").distinct()


def unblocked(entries: DataFrame, blocked: DataFrame, value: str = "value", part: str = "part") -> DataFrame:
    """Entries whose folded value isn't blocked."""
    return entries.join(blocked.select(F.lower(F.col(part)).alias("_b")).distinct(), F.lower(F.col(value)) == F.col("_b"), "left_anti")


def margin(source: Column | str, written: int = 3, registry: int = 25) -> Column:
    """How many runs a record of a source may share: announcements share their skeleton by law."""
    return F.when(F.lower(F.trim(col(source))) == "registry", registry).otherwise(written)


def violations(items: DataFrame, tests: DataFrame, key: str = "id", text: str = "text", source: str = "source", test_key: str = "case_id", expected: str = "expected", size: int = 8) -> DataFrame:
    """``(key, kind, detail)``: test ids used, test names found, and word runs shared beyond the source's margin. Repeated rows count once."""
    once = items.select(key, text, source).dropDuplicates([key])
    ids = shared_ids(once, tests, key, test_key).select(key, F.lit("id").alias("kind"), F.col(key).alias("detail"))
    names = names_in(once, test_names(tests, expected=expected), key, text).select(key, F.lit("name"), "name")
    runs = shared_runs(once, tests, key, text, size=size, more_than=0).join(once.select(key, source), key).where(F.col("n_shared") > margin(source))
    return ids.union(names).union(runs.select(key, F.lit("runs"), F.col("n_shared").cast("string")))
