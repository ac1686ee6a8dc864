"""Related records kept in one split: components of the record-entity graph, then a stratified assignment of whole groups.

Records point to entities: the file they were built from, or their announcement and company. Records of one entity collapse into it by a
grouped aggregation, so what is iterated is the far smaller graph between entities; a hot entity costs one row. Labels spread by minimum
propagation over the edges in both directions, each round also taking the label of one's label (pointer jumping), so long chains need few
rounds. Lineage is cut by a checkpoint every round and nothing of the graph reaches the driver but the count of changed labels.

Groups are assigned whole: large ones one by one, all others in hash buckets, so the driver balances at most ``buckets`` plus
``1 / large`` vectors of a bounded number of label counts, greedily lowering the squared deviation of each split's label counts from its proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(node, label)`` with the smallest node of each node's component, by code point, over edges of strings.

    Null ends and loops are allowed: a loop or an edge with one null end makes its node known. An empty table gives an empty one.
    """
    e = edges.select(F.coalesce(a, b).alias("a"), F.coalesce(b, a).alias("b")).where("a is not null").distinct()
    both = cut(e.union(e.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = new.select(F.col("node").alias("low"), F.col("low").alias("far"))
        labels = cut(new.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), (F.least("low", F.coalesce("far", "low")) < F.col("label")).alias("moved")).withColumnRenamed("new", "label"))
        if not labels.where("moved").limit(1).count():
            break
        labels = labels.drop("moved")
    else:
        raise RuntimeError("labels did not settle")
    return labels.select("node", "label")


def file_key(source: Column, country: Column, doctype: Column, number: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(source)), F.lower(F.trim(country)), F.lower(F.trim(doctype)), number.cast("int").cast("string"))


def author_key(author: Column) -> Column:
    """One spelling of a person: no case, no accents' case, order or spacing; ``Family, Given`` equals ``Given Family``."""
    words = F.filter(F.split(F.lower(author), r"[\s,.;]+"), lambda w: w != "")
    return F.nullif(F.array_join(F.array_sort(words), " "), F.lit(""))


def parse_records(records: DataFrame) -> DataFrame:
    """``(id, file_key, announcement, company)`` of each distinct id, read from the id and, where it lacks a part, from the other columns."""
    i = F.lower(F.trim("id"))
    part = lambda pattern, k: F.nullif(F.regexp_extract(i, pattern, k), F.lit(""))
    registry = r"^reg-[a-z]+-([a-z]{2})-(\d{2,4})[-_/.](\d+)[-_/.]\d+$"
    # prefix (with the language, but for x), country, [doctype], file number, [.v version], serial
    built = r"^(tpl-[a-z]{2}|doc-[a-z]{2}|x)-([a-z]{2})[-_](?:([a-z]+)[-_])?(\d+)(?:\.v\d+)?-\d+$"
    prefix = F.substring_index(part(built, 1), "-", 1)
    source = F.when(prefix == "tpl", F.lit("template")).when(prefix == "doc", F.lit("document")).otherwise(F.lower(F.trim("source")))
    year = part(registry, 2)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return records.where("id is not null").groupBy("id").agg(
        F.min(F.when(prefix.isNotNull(), file_key(source, F.coalesce(part(built, 2), F.col("country")), F.coalesce(part(built, 3), F.col("doctype")), part(built, 4)))).alias("file_key"),
        F.min(F.when(year.isNotNull(), F.concat_ws("|", part(registry, 1), year, part(registry, 3).cast("bigint").cast("string")))).alias("announcement"),
        F.min(F.nullif(F.regexp_replace(F.upper(F.col("origin")), r"[^\p{L}\p{N}]", ""), F.lit(""))).alias("company"),
    )


def related_groups(records: DataFrame, files: DataFrame) -> DataFrame:
    """``(group_id, id)``, one row an id: the smallest file id of the group, or for registry records the smallest id of it.

    A record whose file isn't among the files, and one whose id can't be read, form groups of those that share the same file or nothing.
    Null ids are left out, as there is nothing to assign; null authors relate nothing.
    """
    r = cut(parse_records(records))
    f = files.select("file_id", file_key(F.col("source"), F.col("country"), F.col("doctype"), F.col("file_no")).alias("file_key"), author_key(F.col("author")).alias("author"), "adapted_from")
    fe = f.select(F.concat(F.lit("f"), "file_id").alias("a"), F.concat(F.lit("f"), F.coalesce("adapted_from", "file_id")).alias("b"))
    fe = fe.union(f.where("author is not null").select(F.concat(F.lit("f"), "file_id"), F.concat(F.lit("~author "), "author")))
    fe = fe.union(f.select(F.concat(F.lit("f"), "file_id"), F.concat(F.lit("~key "), "file_key")))
    # an announcement's and a company's node; smallest ids come with the announcement, as every readable registry record has one
    g = r.where("announcement is not null or company is not null")
    ge = g.groupBy(F.concat(F.lit("~an "), "announcement").alias("a"), F.concat(F.lit("~co "), "company").alias("b")).count().select("a", "b")
    labels = components(fe.union(ge))
    tied = r.withColumn("node", F.coalesce(F.concat(F.lit("~key "), "file_key"), F.concat(F.lit("~an "), "announcement"), F.concat(F.lit("~co "), "company")))
    at = tied.join(labels, "node", "left")
    # registry components have no file: name them by their smallest id; pre-aggregated on the map side, so a hot group is one row
    label = F.coalesce("label", "node", F.concat(F.lit("~id "), "id"))
    at = at.select("id", label.alias("label"))
    named = at.where(~F.col("label").startswith("f")).groupBy("label").agg(F.min("id").alias("least"))
    out = at.join(named, "label", "left")
    return out.select(F.when(F.col("label").startswith("f"), F.substring("label", 2, 1 << 30)).otherwise(F.col("least")).alias("group_id"), "id")


def assign_splits(groups: DataFrame, labels: DataFrame, shares: dict[str, float], label: str = "label", buckets: int = 4096, large: float = 0.0005, told_apart: int = 1000) -> DataFrame:
    """``(id, group_id, split)``: whole groups to splits, label counts near to the shares. ``labels``: ``(id, label)``; an id without one counts under null.

    A group over ``large`` of all records is placed by itself, the others by the hash bucket of their ``group_id``. The ``told_apart`` most
    frequent labels are balanced each by itself, any others in 64 lots by their hash; every record counts under one of these.
    """
    spark = groups.sparkSession
    x = groups.join(labels.groupBy("id").agg(F.min(label).alias("label")), "id", "left")
    sizes = cut(x.groupBy("group_id", "label").count())
    top = sizes.groupBy("label").agg(F.sum("count").alias("n")).where("label is not null").orderBy(F.desc("n"), "label").limit(told_apart).select("label", F.col("label").alias("own"))
    lot = F.when(F.col("label").isNotNull(), F.coalesce("own", F.concat(F.lit("\0lot "), F.pmod(F.xxhash64("label"), F.lit(64)).cast("string"))))
    sizes = cut(sizes.join(F.broadcast(top), "label", "left").groupBy("group_id", lot.alias("label")).agg(F.sum("count").alias("count")))
    total = sizes.agg(F.sum("count")).first()[0] or 0
    big = sizes.groupBy("group_id").agg(F.sum("count").alias("n")).where(F.col("n") > large * total).select("group_id", F.col("group_id").alias("big"))  # at most 1 / large rows
    unit = F.coalesce(F.concat(F.lit("g"), "big"), F.concat(F.lit("b"), F.pmod(F.xxhash64("group_id"), F.lit(buckets)).cast("string")))
    units = sizes.join(F.broadcast(big), "group_id", "left").groupBy(unit.alias("unit"), "label").agg(F.sum("count").alias("n")).collect()  # units times told_apart + 65 rows at most
    index = {v: i for i, v in enumerate(sorted({r["label"] or "" for r in units}))}
    vectors: dict[str, dict[int, int]] = {}
    for u, v, n in units:
        counts = vectors.setdefault(u, {})
        counts[index[v or ""]] = counts.get(index[v or ""], 0) + n
    names = list(shares)
    totals: dict[int, int] = {}
    for vec in vectors.values():
        for i, n in vec.items():
            totals[i] = totals.get(i, 0) + n
    have = {s: dict.fromkeys(totals, 0) for s in names}
    size = dict.fromkeys(names, 0)
    where = []
    for u, vec in sorted(vectors.items(), key=lambda kv: (-sum(kv[1].values()), kv[0])):
        m = sum(vec.values())

        def worse(s: str) -> float:
            """Growth of the squared relative deviations of labels and of the size when ``vec`` goes to ``s``."""
            f = shares[s]
            d = sum(((have[s][i] + n - f * totals[i]) ** 2 - (have[s][i] - f * totals[i]) ** 2) / (f * totals[i]) for i, n in vec.items())
            return d + ((size[s] + m - f * total) ** 2 - (size[s] - f * total) ** 2) / (f * total)

        best = min(names, key=lambda s: (worse(s), names.index(s)))
        where.append((u, best))
        size[best] += m
        for i, n in vec.items():
            have[best][i] += n
    plan = spark.createDataFrame(where, "unit string, split string")
    return groups.join(F.broadcast(big), "group_id", "left").withColumn("unit", unit).join(F.broadcast(plan), "unit").select("id", "group_id", "split")
