"""Places where intermediate results are kept, and small helpers around a DataFrame's columns."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine, for a local master only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="staging-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives the loss of executors.

    The table is removed when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_staged() -> None:
    for spark, path in _WRITTEN:
        try:
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
        except Exception:  # the session has ended before us
            if os.path.isdir(path):
                import shutil

                shutil.rmtree(path, ignore_errors=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, as they may not find it on their own path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="package-")) / f"{here.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """Before work in Python: as many partitions as cores at least. A scan of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """Of the rows with one key, the one with the greatest `by` (null last); remaining ties go to the smallest content hash.

    One shuffle on the key. Rows whose key is null are kept each.
    """
    from pyspark.sql import Window

    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    w = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last(), tie)
    rn = free_name(df, "rn")
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def positions(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with each row's place from 0 in the given order, by ranges: no task sees all rows."""
    from pyspark.sql import Window

    parts = stage(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = parts.groupBy("__p").agg(F.count("*").alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__b"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.join(F.broadcast(base), "__p").withColumn(out, (F.col("__b") + inside).cast("long")).drop("__p", "__b")


def often(df: DataFrame, on: list[str], most: int = 10_000, least: int = 100_000) -> DataFrame:
    """Keys (on, n) with more than one in `most` of the rows of df and more than `least` rows: fewer than `most`, whatever df has."""
    counts = df.groupBy(*on).agg(F.count("*").alias("n"))
    limit = max(least, df.count() // most)
    return counts.where(F.col("n") > limit)


def join_spread(df: DataFrame, other: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """df joined with other, which has one row per key, so that no task gets all rows of a frequent key.

    hot: such keys, few (see often). Their rows of `other` are broadcast; the rest is shuffled.
    """
    keys = F.broadcast(hot.select(*on))
    rest = df.join(keys, on, "left_anti").join(other.join(keys, on, "left_anti"), on)
    return df.join(F.broadcast(other.join(keys, on, "left_semi")), on).unionByName(rest)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    name, have = f"__{stem}", {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
