"""Benchmark decontamination by winnowing.

Texts become lower-case words. Every K-gram of words is hashed and, in each window of consecutive K-grams that
spans WINDOW words, the (rightmost) least hash is kept. Any WINDOW words that a document shares with an item
contain the same kept K-gram at the same place, so joining the kept hashes misses none of them; hits are then
extended and compared word by word. An item of fewer than WINDOW words is one window of its own length.

The documents are read once, in narrow passes without shuffle. The item side is read in blocks of at most
``BLOCK_CHARS`` characters; a block's fingerprints are broadcast, so that size is the bound, and a larger
benchmark means more passes (each written to the shared folder), never a larger broadcast.

Edge cases: null and empty texts have no words and no hits; items without words never occur; repeated items and
repeated rows are handled each by itself (an item_id counts once); an empty benchmark leaves all documents clean;
a null item_id is ignored as an item; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tune

WINDOW, K = 8, 4
BLOCK_CHARS = 32_000_000
#: A-Z become a-z; bytes that are no part of a word become blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """One hash per k-gram; NONE where a word is in no item (id below 0)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = ids.astype(np.int64).view(np.uint64) + np.uint64(1)
    h, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
    for j in range(k):
        part = w[j : j + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + part * np.uint64(0xD6E8FEB86659FD93)
        bad |= ids[j : j + n] < 0
    h ^= h >> np.uint64(29)
    h[bad] = NONE
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the kept hashes: the rightmost least one in each run of ``window`` hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, place = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        m = h[j : j + n] <= least
        least[m] = h[j : j + n][m]
        place[m] = j
    at = np.unique(np.arange(n) + place)
    return at[h[at] != NONE]


class Items:
    """A block of benchmark items, indexed by fingerprint."""

    def __init__(self, items: list[tuple[str, str | None]]):
        words = [(i, w) for i, t in items if (w := words_of(t))]
        self.names = [i for i, _ in words]
        self.short = {*self.names} - {i for i, w in words if len(w) >= WINDOW}
        self.vocab: dict[bytes, int] = {b"|": -2}
        flat = [[self.vocab.setdefault(x, len(self.vocab)) for x in w] for _, w in words]
        self.starts = np.cumsum([0, *map(len, flat)])
        self.ids = np.array([x for w in flat for x in w], np.int64)
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # window length: (hash, item, place)
        for i, w in enumerate(flat):
            own = np.array(w, np.int64)
            if len(w) >= WINDOW:
                h = gram_hashes(own, K)
                found[WINDOW] += [(int(h[p]), i, int(p)) for p in winnow(h, WINDOW - K + 1)]
            else:
                found[len(w)].append((int(gram_hashes(own, len(w))[0]), i, 0))
        self.index = {}
        for n, rows in found.items():
            rows.sort()
            self.index[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hit words (a mask) and the (place, item) pairs of occurring windows, as one array of two columns."""
        mask, pairs = np.zeros(len(ids) + 1, np.int64), []
        for n, (hashes, items, places) in self.index.items():
            k = K if n == WINDOW else n
            h = gram_hashes(ids, k)
            at = winnow(h, WINDOW - K + 1) if n == WINDOW else np.flatnonzero(h != NONE)
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            some = hi > lo
            at, lo, hi = at[some], lo[some], hi[some]
            if not len(at):
                continue
            rep = hi - lo
            row = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(lo, rep)
            p, item, q = np.repeat(at, rep), items[row], places[row]
            for back in range(n - k + 1):  # the window may begin so many words before the kept gram
                s, t = p - back, q - back
                ok = (s >= 0) & (s + n <= len(ids)) & (t >= 0) & (t + n <= self.starts[item + 1] - self.starts[item])
                s, t, i = s[ok], (t + self.starts[item])[ok], item[ok]
                same = np.ones(len(s), bool)
                for j in range(n):
                    same[same] = ids[s[same] + j] == self.ids[t[same] + j]
                s, i = s[same], i[same]
                np.add.at(mask, s, 1)
                np.add.at(mask, s + n, -1)
                pairs.append(np.stack([s, i], 1))
        return np.cumsum(mask)[:-1] > 0, np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)


def match_texts(items: Items, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: its number of words, hit stretches [from, to), occurring items. One pass over the joined texts."""
    joined = b" | ".join((t or "").encode("utf-8", "surrogatepass").translate(FOLD) for t in texts)
    words = joined.split()
    get = items.vocab.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    bars = np.flatnonzero(ids == -2)
    starts, ends = np.concatenate(([0], bars + 1)), np.concatenate((bars, [len(ids)]))
    hit, pairs = items.hits(ids)
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    ups, downs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans, names = defaultdict(list), defaultdict(set)
    for d, u, v in zip(np.searchsorted(starts, ups, "right") - 1, ups, downs):
        spans[d].append((int(u - starts[d]), int(v - starts[d])))
    if len(pairs):
        for d, i in np.unique(np.stack([np.searchsorted(starts, pairs[:, 0], "right") - 1, pairs[:, 1]], 1), axis=0):
            names[d].add(items.names[i])
    return [(int(e - s), spans.get(d, []), sorted(names.get(d, ()))) for d, (s, e) in enumerate(zip(starts, ends))]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """The benchmark in blocks of about block_chars characters; an item is in one block."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("i"), "text")
    size = items.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    n = max(1, -(-int(size) // block_chars))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)
        yield Items([tuple(r) for r in part.collect()])


def mark(docs: DataFrame, benchmark: DataFrame, keep_text: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, spans (hit stretches, merged per block), items (their ids as strings, sorted, distinct)."""
    spark = docs.sparkSession
    tune(spark)
    df = docs.select("doc_id", "text").withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<array<int>>"), "items": F.array().cast("array<string>")})
    for k, items in enumerate(blocks(benchmark, block_chars)):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = match_texts(held.value, list(b["text"]))
                b["n_words"] = [n for n, _, _ in got]
                b["spans"] = [[*map(list, old), *map(list, new)] for old, (_, new, _) in zip(b["spans"], got)]
                b["items"] = [sorted({*old, *new}) for old, (_, _, new) in zip(b["items"], got)]
                yield b

        df = (cut(df, "leaks") if k else df).mapInPandas(run, df.schema)
    return df if keep_text else df.drop("text")


def report(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    @F.pandas_udf("long")
    def covered(spans: pd.Series) -> pd.Series:
        def one(s):
            n, end = 0, 0
            for u, v in sorted(map(tuple, s)):
                n += max(0, v - max(u, end))
                end = max(end, v)
            return n

        return spans.map(one)

    df = mark(docs, benchmark)
    n = F.size("items").cast("long")
    return df.select("doc_id", "n_words", covered("spans").alias("n_hit"), n.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_short: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with no window of an item of WINDOW words or more and fewer than least_short items of fewer words.

    In the columns of documents; narrow passes, one for each block of items.
    """
    spark = docs.sparkSession
    tune(spark)
    df = docs.withColumn("__short", F.lit(0))
    for k, items in enumerate(blocks(benchmark, block_chars)):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [names for _, _, names in match_texts(held.value, list(b["text"]))]
                b["__short"] += [sum(i in held.value.short for i in names) for names in found]
                yield b[[held.value.short.issuperset(names) and n < least_short for names, n in zip(found, b["__short"])]]

        df = (cut(df, "leaks") if k else df).mapInPandas(run, df.schema)
    return df.drop("__short")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql() -> str:
    """The definition itself: all windows of all items joined with all windows of all documents."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS k, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND array_to_string(w[i : i + dw.k - 1], ' ') = g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(its.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
