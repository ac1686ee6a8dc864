"""Scores of predictions against gold: intents by case, spans by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.intent import LISTS, TYPES, hidden, lits, normalize
from spanloom.session import running

FIELDS = ["types", *LISTS, "unsupported"]


def joined(cases: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Cases with ``got`` (a parsed intent or null) and ``ms`` of their prediction; a case without one is an error when it is read."""
    j = cases.join(predictions.select(key, "got", "ms").withColumn("_found", F.lit(True)), key, "left")
    return j.withColumn("ms", F.when(F.col("_found"), F.col("ms")).otherwise(F.raise_error(F.concat(F.lit("no prediction for "), F.col(key))).cast("int"))).drop("_found")


def marks(df: DataFrame, want: str = "expect", got: str = "got") -> DataFrame:
    """Adds ``ok``, ``invalid``, one boolean ``ok_<field>`` each and ``severity``."""
    w, g = normalize(F.col(want)), normalize(F.col(got))
    valid = F.col(got).isNotNull()
    out = df.withColumn("invalid", ~valid)
    for f in FIELDS:
        out = out.withColumn(f"ok_{f}", valid & w[f].eqNullSafe(g[f]))
    every = F.lit(True)
    for f in FIELDS:
        every = every & F.col(f"ok_{f}")
    out = out.withColumn("ok", every)
    return out.withColumn("severity", F.when(~F.col("ok"), severity(F.col(want), F.col(got))))


def severity(want: Column, got: Column) -> Column:
    """What a miss costs, judged on intents as written; a missing one counts as empty."""
    none = F.expr("cast(array() as array<string>)")
    missing = lambda a, b: F.size(F.array_except(F.coalesce(a, none), F.coalesce(b, none))) > 0
    wt, gt = (F.coalesce(x["types"], F.expr("cast(map() as map<string,string>)")) for x in (want, got))
    shown = F.exists(lits(TYPES), lambda t: hidden(wt, t) & ~hidden(gt, t))
    over = F.exists(lits(TYPES), lambda t: hidden(gt, t) & ~hidden(wt, t))
    leak = shown | missing(want["dictionary"], got["dictionary"]) | missing(got["never_hide"], want["never_hide"])
    unwarned = F.coalesce(want["unsupported"], F.lit(False)) & ~F.coalesce(got["unsupported"], F.lit(False))
    labels = F.filter(F.array(F.when(leak, F.lit("leak")), F.when(unwarned, F.lit("unwarned")), F.when(over, F.lit("overhide"))), lambda x: x.isNotNull())
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("minor")))


def summary(marked: DataFrame) -> DataFrame:
    """One row: cases, exact matches, invalid outputs, and right fields."""
    return marked.agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("bigint")).alias("exact"), F.sum(F.col("invalid").cast("bigint")).alias("invalid"), *[F.sum(F.col(f"ok_{f}").cast("bigint")).alias(f"ok_{f}") for f in FIELDS])


def breakdown(marked: DataFrame, lang: str = "lang", tags: str = "tags") -> DataFrame:
    """``(grp, value, hits, total, rate)`` by language and by tag, worst first; a case counts under each of its tags."""
    rows = marked.select(F.lit("lang").alias("grp"), F.col(lang).alias("value"), "ok").union(marked.select(F.lit("tag"), F.explode(tags), "ok"))
    g = rows.groupBy("grp", "value").agg(F.sum(F.col("ok").cast("bigint")).alias("hits"), F.count("*").alias("total"))
    return g.withColumn("rate", F.round(F.col("hits") / F.col("total"), 6)).orderBy("grp", "rate", "value")


def costs(marked: DataFrame, key: str = "id") -> DataFrame:
    """``(severity, id)``, a row for each miss and severity."""
    return marked.where(~F.col("ok")).select(F.explode("severity").alias("severity"), F.col(key).alias("id"))


def cost_counts(marked: DataFrame, key: str = "id") -> DataFrame:
    """``(severity, n)`` of misses."""
    return costs(marked, key).groupBy("severity").agg(F.count("*").alias("n"))


def index_percentiles(df: DataFrame, value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """Values at the places ``n * a // b`` of the sorted column, which are not interpolated percentiles. Nulls are left out.

    Value counts are summed up in order by ranges of values.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    c = running(c, F.col("_c"), ["_v"])
    total = c.agg(F.sum("_c")).first()[0] or 0
    place = lambda a, b: F.lit(total * a // b)
    at = lambda a, b: (F.col("_before") <= place(a, b)) & (F.col("_before") + F.col("_c") > place(a, b))
    return c.agg(*[F.min(F.when(at(a, b), F.col("_v"))).alias(name) for name, (a, b) in shares.items()])


def entity_scores(gold: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(label, tp, fp, fn, precision, recall, f1)`` per label and as ``micro`` over exact spans ``(key, start, end, label)``; repeated spans count once."""
    on = [key, "start", "end", "label"]
    g = gold.select(*on).distinct().withColumn("g", F.lit(1))
    p = predicted.select(*on).distinct().withColumn("p", F.lit(1))
    j = g.join(p, on, "full_outer")
    j = j.groupBy("label").agg(F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)).alias("fp"), F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("fn"))
    every = j.union(j.agg(F.lit("micro"), F.sum("tp"), F.sum("fp"), F.sum("fn")))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return every.select("label", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp * 2, tp * 2 + fp + fn).alias("f1"))
