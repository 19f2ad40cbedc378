"""FASTA text: a batch reader, a data source (``format("fasta")``), and a sink."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "description string, residues string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, description, residues: each ``>`` at a line's beginning starts a record; only letters count as residues.

    Splitting at record starts is left to the text source, so a file may be read by many tasks. seq_id is a number in file order, not gapless.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("seq_id", F.monotonically_increasing_id())
    value = F.regexp_replace("value", r"\A>", "")
    headed = (F.col("seq_id") > 0) | F.col("value").startswith(">")
    header = F.when(headed, F.regexp_replace(F.split(value, r"\r?\n", 2)[0], r"\s+\z", "")).otherwise("")
    body = F.when(headed, F.coalesce(F.get(F.split(value, r"\r?\n", 2), 1), F.lit(""))).otherwise(value)
    return raw.where("trim(value) != ''").select("seq_id", header.alias("description"), F.regexp_replace(body, "[^A-Za-z]", "").alias("residues"))


def records(lines) -> Iterator[tuple[str, str]]:
    """(description, residues) of FASTA lines; text before the first header is a record without description."""
    name, parts, some = "", [], False
    for line in lines:
        if line.startswith(">"):
            if some or parts:
                yield name, "".join(parts)
            name, parts, some = line[1:].strip(), [], True
        else:
            parts.append("".join(c for c in line if c.isascii() and c.isalpha()))
    if some or any(parts):
        yield name, "".join(parts)


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, errors="replace") as f:
            yield from records(f)


class FastaSource(DataSource):
    """``spark.dataSource.register(FastaSource)``; option path: files that all executors can open, separated by commas."""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastaReader(self.options)


def as_text(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.coalesce("description", F.lit("")), F.lit("\n"), "residues").alias("value"))


def write(df: DataFrame, path: str) -> None:
    as_text(df).write.text(path)
