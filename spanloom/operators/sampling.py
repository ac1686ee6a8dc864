"""Deterministic sampling: splits, quotas, pools, shuffles, first of each.

Random orders are those of ``md5`` or ``xxhash64`` of the id, so they don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import running


def first_of(df: DataFrame, key: Column | str, order: list[Column | str]) -> DataFrame:
    """One row a key, the first by ``order``; an aggregation, so a hot key meets only its partial winners."""
    k = F.col(key) if isinstance(key, str) else key
    best = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(k.alias("_k")).agg(best.alias("_r")).select("_r.*")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of keys on several rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dev_split(ids: DataFrame, share: float = 0.1, key: str = "id", stratum: str | None = None, least: int = 1, more_than: int = 0, buckets: int = 1024) -> DataFrame:
    """``(…, in_dev)``: of each stratum the first ``max(least, round(n * share))`` by ``md5`` of the key, where it has over ``more_than`` rows.

    The cut-off is found from counts of hash buckets first, so only the rows of one bucket a stratum are ranked. Rounding is half to even.
    """
    s = F.col(stratum) if stratum else F.lit("")
    # every row is in one stratum: a null one is a stratum, too
    d = ids.withColumn("_s", F.coalesce(s.cast("string"), F.lit("\0"))).withColumn("_h", F.md5(F.col(key).cast("string")))
    d = d.withColumn("_b", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(float(1 << 32))).cast("int"))
    c = d.groupBy("_s", "_b").count()
    w = Window.partitionBy("_s")
    c = c.withColumn("_n", F.sum("count").over(w)).withColumn("_upto", F.sum("count").over(w.orderBy("_b")))
    goal = F.when(F.col("_n") > more_than, F.greatest(F.lit(least), F.bround(F.col("_n") * F.lit(share), 0).cast("int"))).otherwise(0)
    c = c.withColumn("_goal", goal).withColumn("_rest", F.col("_goal") - F.col("_upto") + F.col("count"))
    d = d.join(c.select("_s", "_b", "_rest", F.col("count").alias("_c")), ["_s", "_b"])
    edge = d.where("_rest > 0 and _rest < _c").withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key)))
    sure = d.where("_rest <= 0 or _rest >= _c").withColumn("in_dev", F.col("_rest") > 0)
    out = sure.unionByName(edge.withColumn("in_dev", F.col("_r") <= F.col("_rest")).drop("_r"))
    return out.select(*ids.columns, "in_dev")


def quota(df: DataFrame, size: Column | str, goal: Column | str, order: list[Column | str], by: list[str]) -> DataFrame:
    """Rows of each group in order as long as those before them add up to less than the goal. Rows of equal order count in any order; null sizes are 0."""
    n = F.col(size) if isinstance(size, str) else size
    g = F.col(goal) if isinstance(goal, str) else goal
    d = running(df.withColumn("_goal", g), F.coalesce(n, F.lit(0)), order, by)
    return d.where(F.col("_before") < F.col("_goal")).drop("_before", "_goal")


def mix_goals(available: DataFrame, chunks: int, registry: float = 0.25, document: float = 0.15, languages: int = 3) -> DataFrame:
    """``(lang, source, goal)`` from ``(lang, source, n)``: a language has its part of the chunks; announcements as many as there are up to their share,
    documents their share, templates the rest."""
    per = chunks / languages
    have = available.groupBy("lang").agg(F.sum(F.when(F.col("source") == "registry", F.col("n")).otherwise(0)).alias("reg"))
    reg = F.least(F.col("reg").cast("double"), F.lit(per * registry))
    doc = F.lit(per * document)
    goals = F.map_from_arrays(F.array(F.lit("registry"), F.lit("document"), F.lit("template")), F.array(reg, doc, F.lit(per) - reg - doc))
    return have.select("lang", F.explode(goals).alias("source", "goal"))


def round_robin(slots: DataFrame, pool: DataFrame, slot: str = "slot", order: str = "id") -> DataFrame:
    """Each slot with the row ``slot mod n`` of the pool in order; an empty pool gives nothing."""
    n = pool.count()
    p = running(pool, F.lit(1), [order], name="_k")
    return slots.withColumn("_k", F.pmod(F.col(slot), F.lit(max(n, 1))).cast("bigint")).join(p, "_k").drop("_k")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def capped(df: DataFrame, by: str, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` rows of each group: a cap that is asked for."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def top_counts(df: DataFrame, key: Column | str, n: int = 25) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)
