"""Exact n-gram Jaccard self-join by regions of a metric space.

Points are sets of 5-word shingles under the Jaccard distance; radius r = 0.2. First-level pivots are the singleton
sets {s}: the region of pivot s holds the sets that contain s. A set need not enter all its regions: put shingles in
one fixed order (a hash, with very common ones last); two sets within r share one of their first
n - ceil(0.8 n) + 1 shingles, so these are the windows that boundary sets are replicated to, and no link is lost.
Within a region the next pivot is a member, the least by hash: the triangle inequality is used through sizes and
through parity sketches (the sketches' Hamming distance bounds the symmetric difference from below; a pair over
(m + n)/9 can't link). Distances to pivots are computed exactly; what links becomes one class; a region whose members are one
class is finished, as its remaining pairs can add nothing. Otherwise the region is joined again with more pivots (recursion by
ROUNDS); what is open after that is cut into blocks, and members outside a region's largest class meet all its blocks: their pairs of
different classes are compared by the bounds, and exactly where those let them pass. Only class membership is returned, so a group of k copies costs
about k comparisons, not k squared.

Equal sets are one point from the beginning. Words and shingles are 64-bit hashes; links are decided on whole sets.
Very common shingles are found by counting all of them into SKETCH buckets, in parts that are summed in parallel; that only
affects the order, hence speed, never the result.

Edge cases: null texts and texts without words have the empty set and no links, and are their own class; a null
doc_id takes part, and never is a class id unless its class has no other; equal doc_ids with different texts take part each by itself; an
empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, table, tune
from .components import components

N = 5
SKETCH = 1 << 20
SLICES = 64
#: Pivots of each region, round by round, before its remaining pairs are compared.
ROUNDS = (1, 12)
#: Regions up to this size are compared by a join; larger ones in blocks of so many members that a task holds at once.
SMALL, BLOCK = 48, 4096
#: Pairs up to this number may be broadcast (16 bytes each); more are joined by shuffles.
BROADCAST_PAIRS = 500_000


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(w))
    m = len(w) - k + 1
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[j : j + m] * np.uint64(0xD6E8FEB86659FD93)
    if len(w) < n:
        h += np.uint64(len(w))
    return np.unique(h ^ (h >> np.uint64(29)))


def prefix_size(n):
    """How many first shingles two sets within r must share one of: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def parity(s: np.ndarray, bits: int = 1024) -> bytes:
    return np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union."""
    if len(a) == 0 or len(b) == 0:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 80 * (len(a) + len(b) - common)


def points(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, th (text hash), n, sid (hash of its set), bits; and SLICES count rows per task (part, counts)."""
    tune(docs.sparkSession)
    df = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH, np.int32)
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            sid = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            if len(sets):
                total += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=SKETCH).astype(np.int32)
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "n": [len(s) for s in sets], "sid": sid, "bits": [parity(s) for s in sets], "part": -1, "counts": None})
        rows = [(None, None, 0, 0, None, k, x.tobytes()) for k, x in enumerate(np.split(total, SLICES)) if x.any()]
        yield pd.DataFrame(rows, columns=["doc_id", "th", "n", "sid", "bits", "part", "counts"])

    return df.mapInPandas(run, f"doc_id {kind}, th long, n int, sid long, bits binary, part int, counts binary")


def common_buckets(counted: DataFrame, over: int = 64) -> bytes:
    """A bitmap of SKETCH bits: buckets that hold far more shingles than an even spread explains."""

    def summed(b: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(SKETCH // SLICES, np.int64)
        for c in b["counts"]:
            x += np.frombuffer(c, np.int32)
        mean = float(np.median(x))
        hot = x > mean + max(over, 6 * np.sqrt(mean))
        return pd.DataFrame({"part": [int(b["part"].iloc[0])], "hot": [np.packbits(hot).tobytes()]})

    parts = {r["part"]: r["hot"] for r in counted.where("part >= 0").groupBy("part").applyInPandas(summed, "part int, hot binary").collect()}
    return b"".join(parts.get(k, bytes(SKETCH // SLICES // 8)) for k in range(SLICES))


def regions(docs: DataFrame, hot: bytes) -> DataFrame:
    """token, sid, n, pos: the regions a set is replicated to."""
    held = docs.sparkSession.sparkContext.broadcast(hot)  # SKETCH / 8 bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        seen: set[int] = set()  # equal sets of one task are sent once
        for b in batches:
            out = []
            for t in b["text"]:
                s = shingles(t)
                sid = xxhash.xxh3_64_intdigest(s.tobytes())
                if not len(s) or sid in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(sid)
                late = common[(s >> np.uint64(44)).astype(np.int64)]
                s = np.concatenate((s[~late], s[late])) if late.any() else s
                p = prefix_size(len(s))
                out.append((s[:p].view(np.int64), np.full(p, np.uint64(sid)).view(np.int64), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)))
            if out:
                yield pd.DataFrame(dict(zip(("token", "sid", "n", "pos"), map(np.concatenate, zip(*out)))))

    return docs.select("text").mapInPandas(run, "token long, sid long, n int, pos int")


def may_link(a: str, b: str):
    """Bounds that every link keeps: on sizes, and on what can be shared from the two places on."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * 80) & (F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos")) * 9 >= (n + m) * 4)


class Verifier:
    """Decides pairs of sets by their documents' texts."""

    def __init__(self, docs: DataFrame, base: DataFrame):
        self.docs, self.base = docs, base
        self.reps = base.where("n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("bits").alias("bits"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) pairs of sids -> those that link."""
        spark = self.docs.sparkSession
        pairs = cut(pairs.distinct(), "pairs")
        for side in ("a", "b"):
            pairs = pairs.join(self.reps.select(F.col("sid").alias(side), F.col("rep").alias(f"rep_{side}"), F.col("bits").alias(f"bits_{side}")), side)

        @F.pandas_udf("int")
        def apart(x: pd.Series, y: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="int32")
            d = np.frombuffer(b"".join(x), np.uint8) ^ np.frombuffer(b"".join(y), np.uint8)
            return pd.Series(np.unpackbits(d).reshape(len(x), -1).sum(1).astype(np.int32))

        near = cut(pairs.where(apart("bits_a", "bits_b") * 9 <= F.col("n") + F.col("m")).select("a", "b", "rep_a", "rep_b"), "near")
        few = near.count()
        if few == 0:
            return spark.createDataFrame([], "a long, b long")
        ends = near.select(F.col("a").alias("sid"), "rep_a.*").unionAll(near.select(F.col("b").alias("sid"), "rep_b.*")).distinct()
        ends = F.broadcast(ends) if few <= BROADCAST_PAIRS else ends
        keyed = self.docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
        texts = keyed.alias("d").join(ends.alias("e"), F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("d.th") == F.col("e.th"))).select("e.sid", "d.text")
        full = near.select("a", "b").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: dict[int, np.ndarray] = {}
            for x in batches:
                ok = []
                for a, ta, tb in zip(x["a"], x["text_a"], x["text_b"]):
                    if a not in kept:
                        if len(kept) > 200:
                            kept.clear()
                        kept[a] = shingles(ta)
                    ok.append(linked(kept[a], shingles(tb)))
                yield x.loc[ok, ["a", "b"]]

        return full.mapInPandas(run, "a long, b long")


def pivot_pairs(at: DataFrame, pivots: int) -> DataFrame:
    """Pairs of each region's first members by hash with its other members of other classes, within the bounds."""
    x, y = at.where(F.col("rank") <= pivots).alias("x"), at.alias("y")
    pairs = x.join(y, F.col("x.token") == F.col("y.token")).where((F.col("x.rank") < F.col("y.rank")) & (F.col("x.comp") != F.col("y.comp")) & may_link("x", "y"))
    return pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))


def close_pairs(probe: pd.DataFrame, build: pd.DataFrame, rows: int = 512) -> pd.DataFrame:
    """Pairs of a probe and a build member of different classes that pass all bounds; a part of the probes at a time."""
    words = lambda d: np.frombuffer(b"".join(d["bits"]), np.uint64).reshape(len(d), -1)
    bn, bp, bc, bs, bw = build["n"].to_numpy(np.int64), build["pos"].to_numpy(np.int64), build["comp"].to_numpy(), build["sid"].to_numpy(), words(build)
    out = []
    for lo in range(0, len(probe), rows):
        x = probe.iloc[lo : lo + rows]
        n, pos = x["n"].to_numpy(np.int64)[:, None], x["pos"].to_numpy(np.int64)[:, None]
        ok = (np.minimum(n, bn) * 100 >= np.maximum(n, bn) * 80) & (np.minimum(n - pos, bn - bp) * 9 >= (n + bn) * 4) & (x["comp"].to_numpy()[:, None] != bc)
        i, j = np.nonzero(ok)
        xw, xs = words(x), x["sid"].to_numpy()
        for k in range(0, len(i), 1 << 17):
            u, v = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            near = np.bitwise_count(xw[u] ^ bw[v]).sum(1, dtype=np.int64) * 9 <= n[u, 0] + bn[v]
            out.append(pd.DataFrame({"a": np.minimum(xs[u], bs[v])[near], "b": np.maximum(xs[u], bs[v])[near], "n": n[u, 0][near].astype(np.int32), "m": bn[v][near].astype(np.int32)}))
    return pd.concat(out, ignore_index=True).drop_duplicates(["a", "b"]) if out else pd.DataFrame({"a": [], "b": [], "n": [], "m": []})


def small_pairs(at: DataFrame) -> DataFrame:
    """Pairs of different classes within the bounds, of regions with SMALL members at most."""
    x, y = at.alias("x"), at.alias("y")
    pairs = x.join(y, F.col("x.token") == F.col("y.token")).where((F.col("x.sid") < F.col("y.sid")) & (F.col("x.comp") != F.col("y.comp")) & may_link("x", "y"))
    return pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))


def rest_pairs(at: DataFrame, bits: DataFrame, block: int) -> DataFrame:
    """All pairs of different classes in each region that pass the bounds.

    A region is cut into blocks of members. Members outside its largest class are replicated to all its blocks; pairs within the largest class need no look.
    So a task holds one block and, a part at a time, what is compared with it.
    """
    spark = at.sparkSession
    own = at.groupBy("token", "comp").agg(F.count("*").alias("c"))
    largest = own.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("k")).select("token", F.col("m.comp").alias("giant"), "k")
    x = at.join(largest, "token").join(bits, "sid").withColumn("blocks", F.ceil(F.col("k") / block).cast("int"))
    x = x.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    cols = ["token", "sid", "n", "pos", "comp", "bits"]
    build = x.select(*cols, F.col("own").alias("block"), F.lit(0).alias("probe"))
    probe = x.where("comp != giant").select(*cols, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("probe"))
    dealt = build.unionAll(probe).repartition(shuffle_parts(spark), "token", "block").sortWithinPartitions("token", "block", "probe")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        empty = pd.DataFrame({"a": [], "b": [], "n": [], "m": []})
        for b in batches:
            b = b.reset_index(drop=True)
            t, k = b["token"].to_numpy(), b["block"].to_numpy()
            ends = [*(np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1), len(b)]
            found, start = [], 0
            for end in ends:
                part = b.iloc[start:end]
                if (t[start], k[start]) != key:
                    key, held = (t[start], k[start]), []
                new, ask = part[part["probe"] == 0], part[part["probe"] == 1]
                if len(new):
                    held.append(new)
                if len(ask) and held:
                    held = [pd.concat(held, ignore_index=True)] if len(held) > 1 else held
                    found.append(close_pairs(ask, held[0]))
                start = end
            yield pd.concat(found, ignore_index=True) if found else empty

    return dealt.mapInPandas(run, "a long, b long, n int, m int")


def classes(docs: DataFrame, base: DataFrame, hot: bytes, block: int = BLOCK) -> DataFrame:
    """sid, comp: the classes of sets that have a link (others are not listed)."""
    docs = docs.select("doc_id", "text")
    check = Verifier(docs, base)
    w = Window.partitionBy("token")
    found = regions(docs, hot).withColumn("lo", F.min("sid").over(w)).withColumn("hi", F.max("sid").over(w)).where("lo != hi")
    at = cut(found.groupBy("token", "sid").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), "regions")
    at = at.withColumn("comp", F.col("sid"))
    links = None
    for pivots in (*ROUNDS, None):
        if pivots:
            pairs = pivot_pairs(at.withColumn("rank", F.row_number().over(w.orderBy("sid"))), pivots)
        else:
            sized = at.withColumn("k", F.count("*").over(w))
            bits = base.where("n > 0").groupBy("sid").agg(F.first("bits").alias("bits"))
            pairs = small_pairs(sized.where(F.col("k") <= SMALL)).unionAll(rest_pairs(sized.where(F.col("k") > SMALL).drop("k"), bits, block))
        new = cut(check.links(pairs), "links")
        links = new if links is None else links.unionAll(new)
        comps = cut(components(links), "comps")
        if pivots:
            at = at.drop("comp").join(comps.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
            at = at.withColumn("c0", F.min("comp").over(w)).withColumn("c1", F.max("comp").over(w)).where("c0 != c1").drop("c0", "c1")
            at = cut(at, "open")
    return comps


def join(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id, sid of every row."""
    both = cut(points(docs), "points")
    base = both.where("part < 0").select("doc_id", "th", "n", "sid", "bits")
    comps = classes(docs, base, common_buckets(both))
    sets = base.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = sets.join(comps.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    lowest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = named.join(lowest, "comp").select("sid", "component_id")
    rows = base.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    return rows.join(ids, "sid", "left").select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "sid")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents table with one document of each class: the one with the least doc_id."""
    found = join(docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "th").distinct()
    keyed = docs.withColumn("__th", F.xxhash64("text"))
    cond = keyed["doc_id"].eqNullSafe(keep["doc_id"]) & (keyed["__th"] == keep["th"])
    return keyed.join(keep, cond, "left_semi").dropDuplicates(["doc_id", "__th"]).drop("__th")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def sql() -> str:
    return """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id != y.doc_id GROUP BY 1, 2)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
