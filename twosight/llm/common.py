"""Helpers of the corpus operators: scratch tables, running totals, word patterns."""

from __future__ import annotations

import atexit
import gc
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_written: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is unset. Both are shared by all executors."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    app = spark.sparkContext.applicationId
    if app not in _written:
        atexit.register(_at_exit, spark, app)
    folder = f"{root}/{app}/{uuid4().hex}"
    _written.setdefault(app, []).append(folder)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes every scratch table of this application. Frames that still read one can't be used afterwards."""
    for folder in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, folder)


def folders(spark: SparkSession) -> list[str]:
    """The scratch tables of this application, the oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, old: list[str], keep: DataFrame) -> None:
    """Deletes the given scratch tables but those that keep reads, and lets the driver drop shuffles that nothing needs."""
    read = keep.inputFiles()
    gone = [f for f in old if not any(f.rsplit("/", 1)[1] in path for path in read)]
    for folder in gone:
        delete(spark, folder)
    app = spark.sparkContext.applicationId
    _written[app] = [f for f in _written.get(app, []) if f not in gone]
    gc.collect()
    spark._jvm.System.gc()


def _at_exit(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
            clear(spark)
    except Exception:  # the JVM may have ended before; then its folder is left to the cluster's own cleaning
        pass


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the scratch folder: cuts the lineage, survives a lost executor, has a known size."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop(df: DataFrame) -> None:
    """Deletes the files of a frame made by written(), once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none. No word is empty, so the filter drops only the edges."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, use) -> Column:
    """use(value) with value computed once per row. Inside a lambda Catalyst would compute it again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with columns c0, c1, ... and its names, so that no column can clash with an operator's own."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns


def named(names: list[str]) -> list[Column]:
    """The columns of positional() under their old names."""
    return [F.col(f"c{i}").alias(name) for i, name in enumerate(names)]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The frame written with a unique row number, so that rows keep their identity when ids repeat or are null."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def running_totals(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds name: the sum of value over all earlier rows in the order. The result is written.

    Rows are dealt into ranges of the order, summed inside each range, and shifted by the totals of the
    ranges before; only one row per range meets in one place. End the order with a column that tells rows apart.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    shift = shift.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = summed.join(shift, "_range").withColumn(name, F.col("_inside") + F.col("_shift"))
    result = written(out.drop("_range", "_inside", "_shift"))
    drop(ranged)
    return result
