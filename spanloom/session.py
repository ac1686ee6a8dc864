"""Session settings that the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``). Where none is set, a temporary one on a single machine; a cluster without one is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named is None and current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):  # a local cluster is one machine, too
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, which outlives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: compressed, and read by column, where texts would make a checkpoint large."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends; until then any table read from it may be computed again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are computed exactly once a row: a Generate is a barrier to the optimizer, which would else inline them into lambdas."""
    keep = [c for c in df.columns if c not in cols]
    one = df.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_once"))
    return one.select(*keep, *[F.col("_once")[n].alias(n) for n in cols])


def running(df: DataFrame, amount: Column, order: list[str | Column], by: list[str] | None = None, name: str = "_before") -> DataFrame:
    """Adds the sum of ``amount`` over all rows before in the order, within ``by``.

    Rows go to tasks by ranges of the order, so neither a large group nor the whole table meets in one; only sums of ranges are put in order.
    """
    by = by or []
    names = [f"_o{i}" for i in range(len(order))]
    d = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names)], amount.alias("_amount"))
    d = cut(d.repartitionByRange(*by, *names).withColumn("_part", F.spark_partition_id()))
    keys = [f"_k{i}" for i in range(len(by))]
    sums = d.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("_part").alias("_p")).agg(F.sum("_amount").alias("_s"))  # a row a range and group in it
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    same = d["_part"] == sums["_p"]
    for c, k in zip(by, keys):
        same = same & d[c].eqNullSafe(sums[k])
    inner = Window.partitionBy(*by, "_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(sums, same).withColumn(name, F.col("_base") + F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    return out.select(*df.columns, name)


def bounded_broadcast(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A broadcast hint for a side whose bytes are measured to be few; any other goes unhinted. It is computed once."""
    d = cut(df)
    width = sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in d.schema), F.lit(16))
    return F.broadcast(d) if (d.agg(F.sum(width)).first()[0] or 0) <= most else d


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan gives fewer tasks than there are cores, as with one small file; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, where they can't import it by themselves."""
    context = spark.sparkContext
    if getattr(context, "_spanloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spanloom-code-")) / "spanloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))  # Spark serves it from the driver
    context._spanloom_shipped = True
