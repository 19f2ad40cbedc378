"""Sequence collections: loading from tables, writing and reading, statistics, sampling, selection, length order, index blocks, cluster expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alphabet
from ..storage import cut


def sequences(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """seq_id, residues, length of any table with an id and a text."""
    return df.select(F.col(id_col).alias("seq_id"), alphabet.residues(F.col(text_col)).alias("residues")).withColumn("length", F.length("residues").cast("long"))


def statistics(seqs: DataFrame) -> DataFrame:
    """One row: sequences, letters, shortest, longest, mean, median length."""
    return seqs.agg(F.count("*").alias("n_sequences"), F.sum("length").alias("n_letters"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.avg("length"), 6).alias("mean_length"), F.median("length").alias("median_length"))


def length_histogram(seqs: DataFrame, width: int = 100, bins: int = 20) -> DataFrame:
    """Sequences per bin of width letters; the last bin holds all longer ones."""
    return seqs.groupBy(F.least(F.floor(F.col("length") / width), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n_sequences"))


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Adds a gapless number from 0 in a global order: ranges are ordered and written once, numbered in parallel and shifted by the sizes of those before."""
    spark = df.sparkSession
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    parts = cut(parts, "numbered")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__f"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    return parts.join(F.broadcast(before.select("__p", "__b", "__f")), "__p").withColumn(name, (F.col("__b") + F.col("__i") - F.col("__f")).cast("long")).drop("__p", "__i", "__b", "__f")


def systematic_sample(seqs: DataFrame, k: int) -> DataFrame:
    """Every floor(n/k)-th sequence in id order."""
    n = seqs.count()
    step = max(1, n // k)
    return numbered(seqs, ["seq_id"]).where(F.col("rn") % step == 0)


def select_long(seqs: DataFrame, least: int, k: int) -> DataFrame:
    """The first k sequences, in id order, of at least so many letters."""
    return seqs.where(F.col("length") >= least).orderBy("seq_id").limit(k)


def by_length(seqs: DataFrame) -> DataFrame:
    """Rank of each sequence by length, then id."""
    return numbered(seqs, ["length", "seq_id"], "rank")


def blocks(seqs: DataFrame, block_size: int = 128 * 1024, most: int = 1 << 16) -> DataFrame:
    """block, first_rank, n_sequences, n_letters, longest, n_words: index blocks of sequences in length order.

    A block is closed before a sequence that would bring it to block_size letters, or after ``most`` sequences; a longer sequence is a block of its own.
    Sequences of one length are interchangeable, so the number of each length (one row a length) decides all blocks, without a pass over sequences.
    """
    rows, held, start = [], None, 0  # held: number, letters, longest, words

    def close():
        nonlocal held, start
        if held:
            rows.append((len(rows), start, *held))
            start += held[0]
        held = None

    for length, count in sorted((r["length"], r["count"]) for r in seqs.groupBy("length").count().collect()):
        while count:
            n, letters, longest, words = held or (0, 0, 0, 0)
            fits = min(count, most - n, count if length == 0 else max(0, (block_size - 1 - letters) // length))
            if fits == 0 and n == 0:
                fits = 1
            if fits == 0:
                close()
                continue
            held = (n + fits, letters + fits * length, length, words + fits * max(0, length - 2))
            count -= fits
    close()
    return seqs.sparkSession.createDataFrame(rows, "block long, first_rank long, n_sequences long, n_letters long, longest long, n_words long")


def in_blocks(seqs: DataFrame, block_size: int = 128 * 1024) -> DataFrame:
    """seq_id, length, rank, block."""
    table = blocks(seqs, block_size).select("block", "first_rank", (F.col("first_rank") + F.col("n_sequences")).alias("end_rank"))
    ranked = by_length(seqs)
    # ranks are dealt in equal stretches, so that a rank meets the blocks of its stretch only
    width = 4096
    stretches = table.select("*", F.explode(F.sequence(F.floor(F.col("first_rank") / width), F.floor((F.col("end_rank") - 1) / width))).alias("s"))
    return ranked.withColumn("s", F.floor(F.col("rank") / width)).join(stretches, "s").where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))).select("seq_id", "length", "rank", "block")


def write(seqs: DataFrame, path: str) -> None:
    """A collection as Parquet: seq_id, description, residues, codes, length, alphabet, dealt by ranges of length."""
    described = seqs if "description" in seqs.columns else seqs.withColumn("description", F.lit(""))
    out = described.select("seq_id", "description", "residues", F.transform(alphabet.codes(F.col("residues")), lambda c: c.cast("tinyint")).alias("codes"), F.length("residues").cast("long").alias("length"), alphabet.alphabet(F.col("residues")).alias("alphabet"))
    out.repartitionByRange("length", "seq_id").sortWithinPartitions("length", "seq_id").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def composition(seqs: DataFrame) -> DataFrame:
    """Counts of the twenty usual residues and their total."""
    up = F.upper("residues")
    counts = {f"n_{c.lower()}": F.length("residues") - F.length(F.replace(up, F.lit(c), F.lit(""))) for c in sorted("LAGSVETKDPIRNQFYMHCW")}
    return seqs.select("seq_id", *[v.cast("long").alias(k) for k, v in counts.items()], sum(counts.values(), F.lit(0)).cast("long").alias("n_usual"))


def expand_children(clusters: DataFrame) -> DataFrame:
    """Members of clusters from a representative and edits: region_start, length, edits array<struct<pos,code>>."""
    own = F.slice("codes", F.col("region_start") + 1, F.col("length"))
    return clusters.withColumn("codes", F.aggregate("edits", own, lambda s, e: F.transform(s, lambda c, i: F.when(i == e["pos"], e["code"]).otherwise(c))))
