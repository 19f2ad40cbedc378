"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of a 60-bit ring; the stretch up to the next point is that point's arc. A row's
key (doc_id) hashes to a place on the ring and belongs to the shard of its arc. Loads are bounded as tightly as
rows allow: capacities are floor(n/shards) or one more, and sum to n. What finds its shard full continues
clockwise to the next shard with room, so counts differ by one at most (law ``rows``), and most keys stay where
the ring puts them when a shard is added.

No task holds more than a cell of an arc: an arc is cut into so many stretches of hashes that a cell has about
``CELL_ROWS`` rows. A key with more rows than that gets cells of its own by text, and equal rows of that number (which are interchangeable)
by row. So a row's cell, its rank there and its shard follow from its key and text and the counts, not from files or tasks.
The counts, one number a cell (at most ``MOST_CELLS`` and a few for each arc: cells grow beyond that), go to the driver, which plans stretches
of ranks; each row then finds its stretch by its rank within its cell.

Edge cases: a null doc_id is a key like any other; null and empty texts have size 16 and crc32 0; repeated rows
count one by one; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS, VNODES = 40, 256
CELL_ROWS, MOST_CELLS = 100_000, 50_000


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Points in ascending order and the shard of each."""
    points = sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int32)


def plan(counts: dict[tuple[int, str], int], shards: int = SHARDS, vnodes: int = VNODES) -> list[tuple[int, str, int, int, int, int]]:
    """(arc, cell, from rank, to rank, shard, first slot): where each cell's ranks go."""
    _, owner = ring(shards, vnodes)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    size = list(room)
    pieces, over = [], []

    def put(arc, cell, lo, hi, shard):
        take = min(hi - lo, room[shard])
        if take:
            pieces.append((arc, cell, lo, lo + take, shard, size[shard] - room[shard]))
            room[shard] -= take
        return lo + take

    for (arc, cell), n in sorted(counts.items()):
        if (lo := put(arc, cell, 0, n, int(owner[arc]))) < n:
            over.append((arc, cell, lo, n))
    for arc, cell, lo, n in over:
        at = arc
        while lo < n:
            at = (at + 1) % len(owner)
            lo = put(arc, cell, lo, n, int(owner[at]))
    return pieces


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, cell_rows: int = CELL_ROWS) -> DataFrame:
    spark = docs.sparkSession
    points, _ = ring(shards, vnodes)

    @F.pandas_udf("arc int, away long")
    def arc_of(h: pd.Series) -> pd.DataFrame:
        h = h.to_numpy(np.int64)
        arc = (np.searchsorted(points, h, side="right") - 1) % len(points)
        return pd.DataFrame({"arc": arc.astype(np.int32), "away": (h - points[arc]) & ((1 << 60) - 1)})

    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"))
    base = base.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 4)).withColumn("a", arc_of("h"))
    base = cut(base.select("doc_id", "size", "text_crc32", "th", "h", "a.arc", "a.away", F.monotonically_increasing_id().alias("row")), "ring")
    n = base.count()
    per_cell = max(cell_rows, -(-n // MOST_CELLS))
    # arcs differ in length: stretches of equal length, so many to the ring that one has half a cell's rows
    stretch = min(1 << 60, max(1, (1 << 60) * per_cell // (2 * max(1, n))))
    keys = base.groupBy("h").count().where(F.col("count") > per_cell).select("h", F.ceil(F.col("count") / per_cell).alias("own"))
    rows = base.groupBy("h", "th").count().where(F.col("count") > per_cell).select("h", "th", F.ceil(F.col("count") / per_cell).alias("equal"))
    base = base.join(F.broadcast(keys), "h", "left").join(F.broadcast(rows), ["h", "th"], "left")  # fewer than n / per_cell rows each
    own = F.when(F.col("equal").isNotNull(), F.concat_ws("-", F.col("th").cast("string"), F.pmod(F.xxhash64("row"), F.col("equal")).cast("string"))).when(F.col("own").isNotNull(), F.pmod(F.xxhash64("th"), F.col("own")).cast("string"))
    cell = F.concat_ws("/", F.lpad((F.col("away") / stretch).cast("long").cast("string"), 19, "0"), F.when(own.isNotNull(), F.concat_ws("-", F.col("h").cast("string"), own)))
    base = cut(base.withColumn("cell", cell).drop("own", "equal"), "cells")
    counts = {(r["arc"], r["cell"]): r["count"] for r in base.groupBy("arc", "cell").count().collect()}
    pieces = spark.createDataFrame(plan(counts, shards, vnodes), "arc int, cell string, lo long, hi long, shard int, slot0 long")
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "cell").orderBy("h", "doc_id", "th", "row")) - 1)
    # one stretch a cell and a few more for each full shard
    placed = ranked.join(F.broadcast(pieces), ["arc", "cell"]).where("rank >= lo and rank < hi")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
