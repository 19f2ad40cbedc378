"""Redundancy in collections: shared words, candidate pairs with their diagonal, representatives."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..storage import cut
from . import words

#: Word lists up to this number of places are paired within one row, longer ones by a join.
LONG_LIST = 64


def candidate_pairs(seqs: DataFrame, w: int = 30, long_list: int = LONG_LIST) -> DataFrame:
    """seq1, seq2, shift, n: all sequences that share words of w letters, longer first (least id among equals), with the commonest difference of places.

    n is the number of equal words at that difference (the greatest of equally common ones). Short lists of places that are alike but for a
    common move (the words of one shared passage) are paired once and weighted by their number.
    """
    k = words.kmers(seqs, w)
    shared = cut(k.join(k.groupBy("word").agg(F.count("*").alias("k"), F.min("seq_id").alias("lo"), F.max("seq_id").alias("hi")).where("lo < hi").select("word", "k"), "word"), "words")
    lists = shared.where(F.col("k") <= long_list).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("seq_id", "off"))).alias("p"))  # at most long_list places
    alike = lists.select(F.transform("p", lambda x: F.struct(x["seq_id"].alias("seq_id"), (x["off"] - F.col("p")[0]["off"]).alias("off"))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    short = alike.select("p", "n", F.explode("p").alias("a")).select("a", "n", F.explode(F.filter("p", lambda x: x["seq_id"] > F.col("a.seq_id"))).alias("b"))
    short = short.select(F.col("a.seq_id").alias("a"), F.col("b.seq_id").alias("b"), (F.col("b.off") - F.col("a.off")).alias("d"), "n")
    place = shared.where(F.col("k") > long_list)
    left, right = place.select("word", F.col("seq_id").alias("a"), F.col("off").alias("x")), place.select("word", F.col("seq_id").alias("b"), F.col("off").alias("y"))
    long = left.join(right, "word").where("a < b").select("a", "b", (F.col("y") - F.col("x")).alias("d"), F.lit(1).cast("long").alias("n"))
    counted = short.unionAll(long).groupBy("a", "b", "d").agg(F.sum("n").alias("n"))
    size = seqs.select("seq_id", "length")
    sized = counted.join(size.select(F.col("seq_id").alias("a"), F.col("length").alias("la")), "a").join(size.select(F.col("seq_id").alias("b"), F.col("length").alias("lb")), "b")
    turn = F.col("lb") > F.col("la")
    ordered = sized.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("seq1"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("seq2"), F.when(turn, -F.col("d")).otherwise(F.col("d")).alias("shift"), "n")
    return ordered.groupBy("seq1", "seq2").agg(F.max(F.struct("n", "shift")).alias("b")).select("seq1", "seq2", "b.shift", "b.n")


def close_pairs(seqs: DataFrame, identity: float = 0.9, w: int = 30, band: int = 10) -> DataFrame:
    """seq1, seq2, identity: candidate pairs with so many equal letters of the shorter one (seq2) around their commonest diagonal."""
    size = seqs.select("seq_id", "length")
    pairs = candidate_pairs(seqs, w).join(size.select(F.col("seq_id").alias("seq1"), F.col("length").alias("l1")), "seq1").join(size.select(F.col("seq_id").alias("seq2"), F.col("length").alias("l2")), "seq2")
    # letters of seq2 that have any letter of seq1 in their band bound the identity
    reach = F.least("l2", F.col("l1") + F.col("shift") + band) - F.greatest(F.lit(1), F.col("shift") - band + 1) + 1
    pairs = pairs.where(reach / F.col("l2") >= identity).select("seq1", "seq2", "shift")
    full = pairs.join(seqs.select(F.col("seq_id").alias("seq1"), F.upper("residues").alias("a")), "seq1").join(seqs.select(F.col("seq_id").alias("seq2"), F.upper("residues").alias("b")), "seq2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            a, b = ([t.encode() for t in x[c]] for c in ("a", "b"))
            same = kernels.identities(b, a, [-s for s in x["shift"]], identity, band)
            x["identity"] = [n / max(1, len(t)) for n, t in zip(same, b)]
            yield x[["seq1", "seq2", "identity"]]

    return full.mapInPandas(run, "seq1 long, seq2 long, identity double").where(F.col("identity") >= identity)


def followers(close: DataFrame) -> DataFrame:
    """seq_id of the sequences that don't represent themselves, of a written table of close pairs, longer first.

    Rounds: whoever leads a pair and is in no pair as the second represents itself, its partners don't, and all pairs of those go. Each round
    settles at least the first sequence in order, so the rounds end; their number is the longest chain of leaders that wait for each other.
    """
    out, open_ = [], close.select("seq1", "seq2")
    while not open_.isEmpty():
        first = open_.select("seq1").distinct().join(open_.select(F.col("seq2").alias("seq1")).distinct(), "seq1", "left_anti")
        gone = cut(open_.join(first, "seq1").select(F.col("seq2").alias("seq_id")).distinct(), "followers")
        open_ = cut(open_.join(gone.withColumnRenamed("seq_id", "seq1"), "seq1", "left_anti").join(gone.withColumnRenamed("seq_id", "seq2"), "seq2", "left_anti").select("seq1", "seq2"), "open")
        out.append(gone)
    spark = close.sparkSession
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], "seq_id long")


def representatives(seqs: DataFrame, identity: float = 0.9, w: int = 30) -> DataFrame:
    """seq_id, cluster_id, identity: each sequence, longest first (least id among equals), joins the first representative it is identical enough with,
    or represents itself.

    Exact copies of w letters or more have the same pairs, so the copy with the least id stands for them.
    """
    key = F.when(F.col("length") >= w, F.sha2(F.upper("residues"), 256)).otherwise(F.col("seq_id").cast("string"))
    copies = cut(seqs.select("seq_id", "length", key.alias("key")).withColumn("first", F.min("seq_id").over(Window.partitionBy("key"))).select("seq_id", "length", "first"), "copies")
    single = seqs.join(copies.where("seq_id = first").select("seq_id"), "seq_id")
    close = cut(close_pairs(single, identity, w), "close")
    led = close.join(followers(close).withColumnRenamed("seq_id", "seq1"), "seq1", "left_anti").join(copies.select(F.col("seq_id").alias("seq1"), "length"), "seq1")
    best = led.groupBy("seq2").agg(F.max(F.struct("length", (-F.col("seq1")).alias("neg"), "identity")).alias("m"))
    joined = copies.join(best.select(F.col("seq2").alias("first"), (-F.col("m.neg")).alias("cluster_id"), F.col("m.identity").alias("identity")), "first", "left")
    return joined.select("seq_id", F.coalesce("cluster_id", "first").alias("cluster_id"), F.coalesce("identity", F.lit(1.0)).alias("identity"))
