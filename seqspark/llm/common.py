"""Helpers that the corpus operators share: table access, shared storage, session limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, shared_dir  # noqa: F401

#: Rows handed to a Python worker at once; bounds a worker's memory for long texts.
ARROW_ROWS = 256
#: Keys with more than one row in so many are joined by broadcast: fewer than HOT keys, whatever the data.
HOT = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tune(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Small Arrow batches, so that a batch of very long texts fits beside the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        spark, path = df.sparkSession, df.written_to
        name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def counted(rows: DataFrame, counts: DataFrame, keys: list[str], weight: str, each: int = 1) -> DataFrame:
    """rows joined with a table by keys; weight: the number of rows of a key, each: rows of ``counts`` a key has at most.

    Keys with over 1/HOT of all rows, fewer than HOT of them, are broadcast, so that no task of the join holds such a key.
    ``counts`` must be a written table or cheap to compute.
    """
    total = (counts.agg(F.sum(weight)).first()[0] or 0) / each
    hot = F.broadcast(counts.where(F.col(weight) > total / HOT))
    cold = counts.where(F.col(weight) <= total / HOT)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(keys).distinct()), keys, "left_anti").join(cold, keys))
