"""Words that occur twice or more, counted exactly and without a row per word.

A stretch of neighbouring words whose least part of PART letters (by hash) is the same is kept whole, as one piece: the same word always has
the same least part, so all its occurrences are pieces of one bucket. Pieces are shuffled compressed, a few letters per word instead of w,
and a bucket's words are sorted by a rolling hash; words of equal hashes are compared letter by letter, so the hash decides nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 10
#: Letters looked at together, letters of pieces held by a task before they are sent, and words of a bucket sorted together.
CHUNK, HELD, SORTED = 1 << 20, 48 << 20, 1 << 22
#: Buckets of a shuffle partition, and the most words of a piece.
EACH, LONGEST = 8, 200
BASE = 0x9E3779B97F4A7C15


def rolling(a: np.ndarray, w: int, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each word of w letters, from those of words of 1, 2, 4... letters."""
    n = len(a) - w + 1
    h, size, out, done = a.astype(np.uint64) + np.uint64(1), 1, None, 0
    factor = lambda k: np.uint64(pow(base, k, 1 << 64))
    while True:
        if w & size:
            out = h[done : done + n].copy() if out is None else out * factor(size) + h[done : done + n]
            done += size
        if done == w:
            return out
        h = h[:-size] * factor(size) + h[size:]
        size *= 2


def least(h: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours."""
    size = 1
    while size * 2 <= k:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (k - size)], h[k - size :]) if k > size else h


def pieces(a: np.ndarray, w: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, lengths, letters) of the pieces of texts that are joined by a zero."""
    part = min(PART, w)
    if len(a) < w:
        return
    h = rolling(a, part)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h = least(h, w - part + 1)
    zeros = np.concatenate(([0], np.cumsum(a == 0, dtype=np.int32)))
    whole = zeros[w:] == zeros[:-w]
    start = np.flatnonzero(whole & np.concatenate(([True], (h[1:] != h[:-1]) | ~whole[:-1])))
    if not len(start):
        return
    # a piece ends before the next one or before the first word with a zero
    stop = np.flatnonzero(whole & np.concatenate(((h[1:] != h[:-1]) | ~whole[1:], [True]))) + 1
    parts = -(-(stop - start) // LONGEST)
    first = np.repeat(start, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    n = np.minimum(np.repeat(stop, parts) - first, LONGEST) + w - 1
    bucket = ((h[first] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, first, n = bucket[order], first[order], n[order]
    ends = np.cumsum(n)
    letters = a[np.repeat(first - (ends - n), n) + np.arange(ends[-1])]
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[i]), n[i:j].astype(np.uint16), letters[ends[i] - n[i] : ends[j - 1]]


def joined(texts: Iterator[str], w: int) -> Iterator[np.ndarray]:
    """Texts joined by zeros, about CHUNK letters at a time; a longer text is cut with w - 1 letters in common, so that each word is in one part."""
    held, size = [], 0
    for t in texts:
        data = t.encode()
        for i in range(0, max(1, len(data) - w + 1), CHUNK):
            part = data[i : i + CHUNK + w - 1]
            if len(part) >= w:
                held.append(part)
                size += len(part)
            if size >= CHUNK:
                yield np.frombuffer(b"\0".join(held), np.uint8)
                held, size = [], 0
    if held:
        yield np.frombuffer(b"\0".join(held), np.uint8)


def repeated(letters: np.ndarray, lengths: np.ndarray, w: int, base: int = BASE, most: int = SORTED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words as bytes, numbers) of the words of pieces that occur twice or more; about ``most`` words are sorted at a time."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    passes = max(1, -(-int((lengths - w + 1).sum()) // most))
    rows = np.lib.stride_tricks.sliding_window_view(letters, w)
    cuts = np.searchsorted(ends, np.arange(0, ends[-1], 4 * most), "left")
    cuts = np.unique(np.concatenate((cuts, [len(ends)])))
    cuts = cuts if cuts[0] == 0 else np.concatenate(([0], cuts))

    def words(k: int):
        for i, j in zip(cuts[:-1], cuts[1:]):
            lo, hi = ends[i] - lengths[i], ends[j - 1]
            h = rolling(letters[lo:hi], w, base)
            step = np.zeros(hi - lo + 1, np.int8)
            step[ends[i:j] - lengths[i:j] - lo] += 1
            step[ends[i:j] - w + 1 - lo] -= 1
            ok = np.cumsum(step[: len(h)], dtype=np.int8).view(bool)
            if passes > 1:
                ok &= (h >> np.uint64(20)) % np.uint64(passes) == k
            at = np.flatnonzero(ok)
            yield at + lo, h[at]

    for k in range(passes):
        at, h = map(np.concatenate, zip(*words(k)))
        order = np.argsort(h)
        h = h[order]
        same = np.concatenate(([False], h[1:] == h[:-1], [False]))
        twice = same[1:] | same[:-1]
        if not twice.any():
            continue
        text, same = np.ascontiguousarray(rows[at[order[twice]]]), same[:-1][twice]
        if (text[1:] != text[:-1])[same[1:]].any():  # different words of one hash
            found, n = np.unique(text.view(f"S{w}")[:, 0], return_counts=True)
            yield found[n > 1], n[n > 1]
        else:
            first = np.flatnonzero(~same)
            yield text[first].view(f"S{w}")[:, 0], np.diff(np.append(first, len(same)))


def _bucketed(seqs: DataFrame, w: int) -> DataFrame:
    """bucket, lengths, letters: pieces, dealt by bucket."""
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = EACH * parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = defaultdict(lambda: (bytearray(), bytearray()))

        def sent() -> pd.DataFrame:
            rows = [(b, pa.compress(bytes(n), "zstd", asbytes=True), len(n), pa.compress(bytes(t), "zstd", asbytes=True), len(t)) for b, (n, t) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["bucket", "lengths", "n_lengths", "letters", "n_letters"])

        size = 0
        for a in joined((t for batch in batches for t in batch["residues"]), w):
            for b, n, t in pieces(a, w, buckets):
                held[b][0].extend(n.tobytes())
                held[b][1].extend(t.tobytes())
                size += len(t)
            if size >= HELD:
                yield sent()
                size = 0
        yield sent()

    found = seqs.select(F.upper("residues").alias("residues")).mapInPandas(run, "bucket int, lengths binary, n_lengths int, letters binary, n_letters int")
    return found.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _over_buckets(seqs: DataFrame, w: int, schema: str, made) -> DataFrame:
    """made(words, numbers): a table of each lot of repeated words."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, lengths, letters = None, [], []

        def ended():
            for x in repeated(np.concatenate(letters), np.concatenate(lengths), w) if lengths else ():
                yield pd.DataFrame(dict(zip(names, made(*x))))
            lengths.clear()
            letters.clear()

        for x in batches:
            for b, n, n_size, t, t_size in x.itertuples(index=False):
                if b != bucket:
                    yield from ended()
                    bucket = b
                lengths.append(np.frombuffer(pa.decompress(n, n_size, "zstd", asbytes=True), np.uint16))
                letters.append(np.frombuffer(pa.decompress(t, t_size, "zstd", asbytes=True), np.uint8))
        yield from ended()

    return _bucketed(seqs, w).mapInPandas(run, schema)


def repeated_words(seqs: DataFrame, w: int = 30) -> DataFrame:
    """word, n: the words of w letters that occur twice or more, with their number."""
    return _over_buckets(seqs, w, "word string, n long", lambda words, n: (words.astype(f"U{w}"), n))


def repeat_counts(seqs: DataFrame, w: int = 30) -> DataFrame:
    """n, n_words: how many words of w letters occur n times, from twice on."""
    return _over_buckets(seqs, w, "n long, n_words long", lambda words, n: np.unique(n, return_counts=True)).groupBy("n").agg(F.sum("n_words").alias("n_words"))
