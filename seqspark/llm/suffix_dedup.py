"""Substring deduplication by suffix arrays of Lyndon groups: symbols of strings of LENGTH symbols that occur elsewhere too.

A text is a sequence of symbols: its UTF-8 bytes (unit ``bytes``) or its words (unit ``words``).

Finding places worth sorting. Every string of LENGTH symbols has an anchor: the place of its (rightmost) least KGRAM hash, which
depends on its symbols alone. The strings with one anchor whose start lies in one of two distance classes from it
all contain the same stretch around the anchor, the core (LENGTH - WIDTH + 1 symbols). Only strings whose cores are equal can be
equal. So each text gives one record for each anchor and class: core hash, hash of the whole slice that its strings cover,
place. A core seen once ends there; slices of equal content are one from then on, and repeat as a whole; what is left to find out is
which strings of a core's different slices are equal.

Sorting. The different slices of one core, with the core written as one symbol, form one string whose suffix array is built
in linear time: suffixes are grouped by their Lyndon prefixes, groups are processed in descending order and, along previous-smaller
pointers, split the groups before them; a second pass emits the order in every group from the pointers, without
renaming or recursion. Two strings are equal iff neighbours in that order agree over WIDTH symbols. Slices whose best agreement on both
sides of the core can't reach that are left out before.

Hot cores. A core with more than GROUP different slices is narrowed: its strings that reach far to the left get a core that
is longer on the left, the others one that is longer on the right. Each half is a set of cores of half the width, in
which slices that became equal are one and those that became single end. Every step is an aggregate over all tasks, and a core of width 1
has one slice only, so each group gets small enough to be sorted by the same array, whatever its size was; nothing is capped.

Skew. Counts are partial aggregates. Rows meet their counts in joins from which the keys with over 1/HOT of all rows are taken out:
there are fewer than HOT of these, whatever the data, so their counts are broadcast. A text that stands in so many rows is sliced once.

Identity. A text is known by two 64-bit hashes, a slice by those of its core and of itself (128 bits each); inside a group
everything but the core is compared symbol by symbol.

Edge cases: null and empty texts, and texts of fewer symbols, lose nothing; equal texts of LENGTH symbols or more lose all;
a text may repeat itself, overlaps count; repeated rows count as documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import counted, cut, release, shuffle_parts, table, tune

#: Bytes of a string that counts as a repeat unless the caller names another length.
LENGTH = 400
#: Different slices of a core that are sorted together; a larger core is narrowed first.
GROUP = 512
#: Strings of a very long text are handled so many at a time.
BLOCK = 1 << 21
CORE, STOP = 1, 0
MIX = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * MIX)
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def symbols(data: bytes, unit: str) -> np.ndarray:
    """One 64-bit value per symbol."""
    if unit == "bytes":
        return BYTE[np.frombuffer(data, np.uint8)]
    words = data.split()
    return _mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def sequence(packed: bytes, unit: str):
    """The symbols themselves, as a sequence that slices and compares."""
    return packed if unit == "bytes" else tuple(packed.split(b" ")) if packed else ()


def packed(seq, unit: str) -> bytes:
    return seq if unit == "bytes" else b" ".join(seq)


class Powers:
    """Powers of BASE and its inverse, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length()
            cls.up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, BASE, np.uint64))))
            cls.down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, INVERSE, np.uint64))))
        return cls.up[:n], cls.down[:n]


class Hashes:
    """Hashes of any stretch of some symbols in constant time."""

    def __init__(self, values: np.ndarray):
        up, self.down = Powers.of(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate((x, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def derived(length: int) -> tuple[int, int]:
    """(KGRAM, WIDTH) for strings of that length: WIDTH distances make one of two classes."""
    kgram = max(1, min(32, length // 8))
    return kgram, (length - kgram + 2) // 2


def slices(values: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(core hash, slice hash, first string, number of strings, distance of the first string from its core) of one text's slices."""
    kgram, width = derived(length)
    out = []
    for at in range(0, max(0, len(values) - length + 1), BLOCK):
        part = values[at : at + BLOCK + length - 1]
        h = Hashes(part)
        n = len(part) - length + 1
        g = np.arange(len(part) - kgram + 1)
        key = (_mixed((h.sums[kgram:] - h.sums[: len(g)]) * h.down[: len(g)]) & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - g.astype(np.uint64))
        anchor = (np.uint64(0xFFFFFF) - (sliding_least(key, length - kgram + 1) & np.uint64(0xFFFFFF))).astype(np.int64)
        kind = (anchor - np.arange(n)) // width
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1]))))
        count = np.diff(np.concatenate((first, [n])))
        core = anchor[first] - width * kind[first]
        core_hash = _mixed(h.of(core, core + length - width + 1) + kind[first].astype(np.uint64))
        whole = _mixed(h.of(first, first + count + length - 1) + (core - first).astype(np.uint64) * MIX)
        out.append((core_hash.view(np.int64), whole.view(np.int64), first + at, count, core - first))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(map(np.concatenate, zip(*out)))


def suffix_array(s: list[int]) -> list[int]:
    """Linear-time suffix array of a list of small non-negative integers (below 2^16: a radix sort opens it), by Lyndon groups."""
    n = len(s)
    text = np.asarray(s, np.int64)
    order = np.argsort(text.astype(np.uint16) if n and text.max() < 1 << 16 else text, kind="stable")
    firsts = np.flatnonzero(np.concatenate(([True], text[order][1:] != text[order][:-1]))) if n else np.empty(0, np.int64)
    group = np.empty(n, np.int64)
    sizes = np.zeros(n + 1, np.int64)
    sizes[firsts] = np.diff(np.concatenate((firsts, [n])))
    group[order] = np.repeat(firsts, sizes[firsts])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    order, group, place, size = order.tolist(), group.tolist(), place.tolist(), sizes.tolist()
    prev = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        members = order[start:end]
        # the nearest place before each with a suffix of a lower group or of the same one; pointers of higher groups are known
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > start:
                p = prev[p]
            prev[i] = p
        # chains through the same group end at the place before their leftmost member
        for i in members:
            p = prev[i]
            if p >= 0 and group[p] == start:
                chain = [i]
                while p >= 0 and group[p] == start:
                    chain.append(p)
                    p = prev[p]
                for j in chain:
                    prev[j] = p
        count: dict[int, int] = {}
        for i in members:
            p = prev[i]
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        # what lies before k members of this group moves behind the rest of its own group, larger k further
        levels: dict[int, list[int]] = {}
        for p, k in count.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):
            moved = levels[k]
            for p in moved:
                g = group[p]
                size[g] -= 1
                to, at = g + size[g], place[p]
                other = order[to]
                order[at], order[to] = other, p
                place[other], place[p] = at, to
            new = [group[p] + size[group[p]] for p in moved]
            for p, g in zip(moved, new):
                group[p] = g
                size[g] += 1
        end = start
    out, put, done = [0] * n, list(range(n + 1)), [False] * n
    filled = 0

    def chain_of(p: int) -> None:
        while p >= 0 and not done[p]:
            g = group[p]
            out[put[g]] = p
            put[g] += 1
            done[p] = True
            p = prev[p]

    chain_of(n - 1)
    while filled < n:
        chain_of(out[filled] - 1)
        filled += 1
    return out


def agreement(a, b) -> int:
    """Symbols that two sequences begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    if isinstance(a, bytes):
        return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())
    return next(k for k in range(n) if a[k] != b[k])


def promising(left: list, right: list, width: int) -> list[int]:
    """Slices that may share a string with another: their best agreements left and right of the core sum up to it."""
    best = np.zeros(len(left), np.int64)
    for side in ([x[::-1] for x in left], right):
        order = sorted(range(len(side)), key=side.__getitem__)
        near = [agreement(side[a], side[b]) for a, b in zip(order, order[1:])]
        most = np.zeros(len(side), np.int64)
        for k, a in enumerate(order):
            most[a] = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
        best += most
    return np.flatnonzero(best >= width - 1).tolist()


def repeats(left: list, right: list, width: int) -> list[tuple[int, int, int]]:
    """(slice, from, to): runs of strings that also are in another slice of the same core."""
    keep = promising(left, right, width)
    if len(keep) < 2:
        return []
    number: dict = {}
    name = (lambda x: x + 2) if isinstance(left[0], bytes) else (lambda x: number.setdefault(x, len(number) + 2))
    s: list[int] = []
    owner, offset = [], []
    for k in keep:
        n = len(left[k]) + len(right[k]) + 1 - width + 1
        owner += [k] * n + [-1] * width
        offset += [*range(n), *[0] * width]
        s += [*map(name, left[k]), CORE, *map(name, right[k]), STOP]
    owner, offset, text = np.array(owner), np.array(offset), np.array(s)
    sa = np.array(suffix_array(s))
    sa = sa[owner[sa] >= 0]
    rows = text[sa[:, None] + np.arange(width)]
    same = (rows[1:] == rows[:-1]).all(axis=1)
    hit = np.zeros(len(text), bool)
    hit[sa[1:][same]] = hit[sa[:-1][same]] = True
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [(int(owner[u]), int(offset[u]), int(offset[u]) + int(v - u)) for u, v in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def halves(left, right, width: int):
    """The two narrower slices of one: (side, symbols that join the core, left, right, width, first string behind the old first)."""
    h = width // 2
    if len(left) >= h:  # strings with h symbols or more before the core
        yield 0, left[len(left) - h :], left[: len(left) - h], right[: width - h - 1], width - h, 0
    if len(right) >= width - h:  # strings with fewer
        own = left[max(0, len(left) - h + 1) :]
        yield 1, right[: width - h], own, right[width - h :], h, len(left) - len(own)


def keyed(docs: DataFrame, length: int, unit: str) -> DataFrame:
    """th and ti (two hashes of a text) and text of the rows that can hold a string."""
    least = length if unit == "bytes" else 2 * length - 1
    return docs.select(F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("ti"), "text").where(F.octet_length("text") >= least)


def hot_texts(texts: DataFrame) -> DataFrame:
    """th, ti of texts in over 1/HOT of all rows, and in two at least: fewer than HOT rows."""
    counts = cut(texts.groupBy("th", "ti").count(), "copies")
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.where((F.col("count") > total / common.HOT) & (F.col("count") > 1)).select("th", "ti")


def once(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """th, ti, text, times: a hot text as one row with times 2, other rows as they are, with times 1."""
    hot = F.broadcast(hot)
    many = texts.join(hot, ["th", "ti"]).groupBy("th", "ti").agg(F.max("text").alias("text"))
    return texts.join(hot, ["th", "ti"], "left_anti").withColumn("times", F.lit(1)).unionByName(many.withColumn("times", F.lit(2)))


def records(texts: DataFrame, length: int, unit: str) -> DataFrame:
    """One row per slice: core, slice, th, ti (the text), at (first string), n (strings), lead (from there to the core)."""
    tune(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.iloc[lo : lo + 64]
                got = [slices(symbols(utf8(t), unit), length) for t in part["text"]]
                core, whole, at, n, lead = map(np.concatenate, zip(*got))
                size = [len(x[0]) for x in got]
                out = pd.DataFrame({"core": core, "slice": whole, "th": np.repeat(part["th"].to_numpy(), size), "ti": np.repeat(part["ti"].to_numpy(), size), "at": at, "n": n.astype(np.int16), "lead": lead.astype(np.int16)})
                yield out.loc[out.index.repeat(np.repeat(part["times"].to_numpy(), size))]

    return texts.mapInPandas(run, "core long, slice long, th long, ti long, at long, n short, lead short")


def parted(rows: DataFrame, keys: list[str], place: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (a core's keys, slice, place, open) -> (open rows whose slice repeats; one row per slice of cores with several, open if it stands there once).

    Cores with one row only, and those whose slices are all equal, need no sorting.
    """
    cores = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.min("slice").alias("s0"), F.max("slice").alias("s1")).where("k > 1")
    cores = cut(cores.select(*keys, "k", (F.col("s0") == F.col("s1")).alias("alike")), "cores")
    shared = cut(counted(rows, cores, keys, "k").drop("k"), "shared")
    mixed = shared.where(~F.col("alike")).drop("alike")
    kinds = cut(mixed.groupBy(*keys, "slice").agg(F.count("*").alias("k"), F.min(F.struct("open", *place)).alias("rep")), "kinds")
    whole = shared.where("alike and open").select(*place).unionAll(counted(mixed.where("open"), kinds.where("k > 1").select(*keys, "slice", "k"), [*keys, "slice"], "k").select(*place))
    whole = cut(whole, "whole")
    release(cores, shared)
    return whole, kinds.select(*keys, "slice", (F.col("rep.open") & (F.col("k") == 1)).alias("open"), *[f"rep.{c}" for c in place])


def with_sides(kinds: DataFrame, texts: DataFrame, length: int, unit: str) -> DataFrame:
    """Adds to slices what they hold left and right of the core, from their texts."""
    width = derived(length)[1]
    lists = kinds.groupBy("th", "ti").agg(F.collect_list(F.struct("core", "open", "at", "n", "lead")).alias("w"))  # at most a text's own slices

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for th, ti, text, w in zip(b["th"], b["ti"], b["text"], b["w"]):
                seq = utf8(text) if unit == "bytes" else utf8(text).split()
                for x in w:
                    core = x["at"] + x["lead"]
                    behind = core + length - width + 1
                    key = hashlib.blake2b(packed(seq[core:behind], unit), digest_size=16).digest()
                    rows.append((key, x["open"], th, ti, x["at"], packed(seq[x["at"] : core], unit), packed(seq[behind : x["at"] + x["n"] + length - 1], unit), width))
            yield pd.DataFrame(rows, columns=["key", "open", "th", "ti", "at", "left", "right", "width"])

    # of a text that stands in several rows one is enough
    return texts.join(lists, ["th", "ti"]).dropDuplicates(["th", "ti"]).select("th", "ti", "text", "w").mapInPandas(run, SIDES)


SIDES = "key binary, open boolean, th long, ti long, at long, left binary, right binary, width int"


def narrowed(large: DataFrame, unit: str) -> DataFrame:
    """Slices of too large cores, cut into those of cores of half the width: rows as SIDES and slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, opened, th, ti, at, l, r, w in zip(b["key"], b["open"], b["th"], b["ti"], b["at"], b["left"], b["right"], b["width"]):
                for side, more, left, right, width, behind in halves(sequence(l, unit), sequence(r, unit), w):
                    left, right = packed(left, unit), packed(right, unit)
                    own = hashlib.blake2b(key + bytes([side]) + packed(more, unit), digest_size=16).digest()
                    text = hashlib.blake2b(len(left).to_bytes(8, "big") + left + right, digest_size=16).digest()
                    rows.append((own, opened, th, ti, at + behind, left, right, width, text))
            yield pd.DataFrame(rows, columns=["key", "open", "th", "ti", "at", "left", "right", "width", "slice"])

    return large.mapInPandas(run, SIDES + ", slice binary")


def spread(left, right, width: int) -> int:
    """The number of strings of a slice."""
    return len(left) + len(right) + 2 - width


def stretches(texts: DataFrame, length: int, unit: str) -> DataFrame:
    """th, ti, from_, to_: stretches of symbols to remove from the texts (as ``once`` gives them) with these hashes, not merged."""
    spark = texts.sparkSession
    found = cut(records(texts, length, unit), "slices")
    whole, kinds = parted(found.withColumn("open", F.lit(True)), ["core"], ["th", "ti", "at", "n", "lead"])
    release(found)
    ends = whole.select("th", "ti", F.col("at").alias("from_"), (F.col("at") + F.col("n") + length - 1).alias("to_"))
    todo = cut(with_sides(kinds, texts.drop("times"), length, unit), "sides")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def groups(b: pd.DataFrame) -> pd.DataFrame:
            out = []
            keys = b["key"].tolist()
            th, ti, at, opened, left, right, width = (b[c].tolist() for c in ("th", "ti", "at", "open", "left", "right", "width"))
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                if end - start > 1 and any(opened[start:end]):
                    for k, u, v in repeats([sequence(x, unit) for x in left[start:end]], [sequence(x, unit) for x in right[start:end]], width[start]):
                        if opened[start + k]:
                            out.append((th[start + k], ti[start + k], at[start + k] + u, at[start + k] + v - 1 + length))
                start = end
            return pd.DataFrame(out, columns=["th", "ti", "from_", "to_"]).astype("int64")

        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = b["key"] == b["key"].iloc[-1]
            held = b[last]
            yield groups(b[~last])
        if held is not None:
            yield groups(held)

    while True:
        sizes = cut(todo.groupBy("key").agg(F.count("*").alias("k")), "sizes")
        large = sizes.where(F.col("k") > GROUP)
        n_large = large.count()
        small = todo if n_large == 0 else counted(todo, sizes, ["key"], "k").where(F.col("k") <= GROUP).drop("k")
        dealt = small.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", "th", "ti", "at")
        ends = ends.unionAll(cut(dealt.mapInPandas(sort, "th long, ti long, from_ long, to_ long"), "sorted"))
        if n_large == 0:
            release(todo)
            return ends
        wide = counted(todo, large, ["key"], "k").drop("k")
        half = cut(narrowed(wide, unit), "halves")
        release(todo)
        place = ["th", "ti", "at", "left", "right", "width"]
        whole, kinds = parted(half, ["key"], place)
        n = strings_of(unit)("left", "right", "width")
        ends = ends.unionAll(whole.select("th", "ti", F.col("at").alias("from_"), (F.col("at") + n + length - 1).alias("to_")))
        todo = cut(kinds.select("key", "open", *place), "sides")
        release(half)


def strings_of(unit: str):
    @F.pandas_udf("long")
    def n(left: pd.Series, right: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([spread(sequence(l, unit), sequence(r, unit), w) for l, r, w in zip(left, right, width)], dtype="int64")

    return n


def with_stretches(docs: DataFrame, length: int = LENGTH, unit: str = "bytes") -> DataFrame:
    """docs with the columns __cut (stretches of its text, or null) and __all (whether all its strings go, as the text stands in many rows)."""
    texts = keyed(docs, length, unit)
    hot = hot_texts(texts)
    found = stretches(once(texts, hot), length, unit).groupBy("th", "ti", "from_").agg(F.max("to_").alias("to_"))
    found = cut(found.groupBy("th", "ti").agg(F.sort_array(F.collect_list(F.struct("from_", "to_"))).alias("__cut")), "cuts")  # one text's own
    found = found.select(F.col("th").alias("__th"), F.col("ti").alias("__ti"), "__cut")
    hot = F.broadcast(hot.select(F.col("th").alias("__th"), F.col("ti").alias("__ti"), F.lit(True).alias("__all")))
    rows = docs.withColumns({"__th": F.when(F.octet_length("text") >= length, F.xxhash64("text")), "__ti": F.xxhash64(F.lit(1), "text")})
    rows = rows.join(hot, ["__th", "__ti"], "left").withColumn("__all", F.coalesce("__all", F.lit(False)))
    cold = rows.where(~F.col("__all")).join(found, ["__th", "__ti"], "left")
    warm = rows.where("__all").withColumn("__cut", F.lit(None).cast(found.schema["__cut"].dataType))
    return cold.unionByName(warm).drop("__th", "__ti")


def merged(spans, every: bool = False, n: int = 0) -> list[list[int]]:
    """Sorted stretches, joined where they touch; all n symbols if every is set."""
    if every:
        return [[0, n]] if n else []
    out: list[list[int]] = []
    for s in [] if spans is None else spans:
        if out and s["from_"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["to_"])
        else:
            out.append([s["from_"], s["to_"]])
    return out


def report(docs: DataFrame) -> DataFrame:
    df = with_stretches(docs.select("doc_id", "text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, spans, every in zip(b["text"], b["__cut"], b["__all"]):
                data, at, kept = utf8(text), 0, hashlib.sha256()
                cuts = merged(spans, every, len(data))
                for u, v in cuts:
                    kept.update(data[at:u])
                    at = v
                kept.update(data[at:])
                rows.append((len(data), sum(v - u for u, v in cuts), len(cuts), kept.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return df.select("doc_id", "text", "__cut", "__all").mapInPandas(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def shorter(text: str | None, spans, every: bool, unit: str, length: int) -> str | None:
    """A text without its stretches: of bytes, whole characters only; of words, from the first word's beginning to the last one's end."""
    data, at, out = utf8(text), 0, []
    if unit == "words":
        if spans is None and not every:
            return text
        words = [m.span() for m in WORD.finditer(data)]
        cuts = [(words[u][0], words[v - 1][1]) for u, v in merged(spans, every and len(words) >= length, len(words))]
    else:
        cuts = merged(spans, every, len(data))
    if not cuts:
        return text
    for u, v in cuts:
        while u < v and data[u] & 0xC0 == 0x80:
            u += 1
        while v > u and v < len(data) and data[v] & 0xC0 == 0x80:
            v -= 1
        out.append(data[at:u])
        at = v
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, length: int = LENGTH, unit: str = "bytes") -> DataFrame:
    """docs, their texts without the strings of length symbols that occur elsewhere too."""

    @F.pandas_udf("string")
    def shortened(text: pd.Series, spans: pd.Series, every: pd.Series) -> pd.Series:
        return pd.Series([shorter(t, s, e, unit, length) for t, s, e in zip(text, spans, every)], index=text.index, dtype=object)

    df = with_stretches(docs, length, unit)
    return df.withColumn("text", F.when(F.col("__cut").isNull() & ~F.col("__all"), F.col("text")).otherwise(shortened("text", "__cut", "__all"))).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def by_definition(texts: dict, length: int = LENGTH, unit: str = "bytes") -> dict:
    """The definition on a small table {doc_id: text}: for tests. (symbols, removed symbols, runs, hash of the rest)."""
    seen: dict = {}
    data = {i: utf8(t) if unit == "bytes" else tuple(utf8(t).split()) for i, t in texts.items()}
    for d in data.values():
        for k in range(len(d) - length + 1):
            seen[d[k : k + length]] = seen.get(d[k : k + length], 0) + 1
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = [c for c, g in zip(d, gone) if not g]
        runs = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(d), sum(gone), runs, hashlib.sha256(bytes(kept) if unit == "bytes" else b" ".join(kept)).hexdigest())
    return out
