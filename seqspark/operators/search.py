"""Similarity search: seeds, two-hit triggers, ungapped and gapped extension, significance, best pairs, traceback.

Seeds to triggers are joins and aggregates. Sequences are joined to a pair only once it has a trigger, and each pair is then one row
of an Arrow batch, so nothing is grouped in Python. The best pairs of a query are cut by a window limit before traceback.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import complexity, composition, kernels, matrices, statistics
from ..sources import fasta
from ..storage import cut
from . import collection, words

HSP = "query_id long, seq_id long, q_start int, q_end int, s_start int, s_end int, q_gap int, s_gap int, score int, evalue double, q_len int, s_len int"
FINAL = "query_id long, seq_id long, q_start int, q_end int, s_start int, s_end int, score int, bits double, evalue double, identities int, positives int, gaps int, gap_opens int, length int, edits string, rule string"


#: Cells of a row that are computed side by side.
CELLS = 50_000


@dataclass(frozen=True)
class Params:
    matrix: np.ndarray = field(default_factory=matrices.load)
    word: int = 3
    threshold: int = 11
    window: int = 40
    overlap: int = 3
    opening: int = 11
    extend: int = 1
    ungapped_bits: float = 7.0
    trigger_bits: float = 22.0
    gapped_bits: float = 15.0
    final_drop: int = 2076
    evalue: float = 10.0
    prelim_evalue: float = 50.0
    cutoff_length: int = 10
    max_hits: int = 500
    restricted: bool = True
    mask_query: bool = False
    scale: int = 32


def suppress(hits: list[tuple[int, int, int]], q: np.ndarray, s: np.ndarray, p: Params, trigger: int, drop: int) -> list[tuple[int, int, int, int]]:
    """Ungapped extensions (q_start, s_start, length, score) of a pair's (diag, q_off, distance) triggers, in diagonal order.

    A trigger that lies before the end of the last good extension to the right is skipped.
    """
    out, last = [], (-(10**9), 0)
    for diag, q_off, d in sorted(hits):
        s_word = diag + q_off - len(q) + p.word - 1
        end = s_word + p.word - 1
        if last > (diag, end):
            continue
        qs, ss, n, score, reached = kernels.ungapped(q, s, q_off, s_word, end - d + 1, p.matrix, drop, p.word)
        if score >= trigger:
            out.append((qs, ss, n, score))
            if reached >= 0:
                last = (diag, reached)
    return out


def contained(box, kept) -> bool:
    qs, qe, ss, se, score = box
    return any(k[4] >= score and k[0] <= qs and qe <= k[1] and k[2] <= ss and se <= k[3] for k in kept)


def cover(kept: list, new) -> None:
    """Adds an alignment to those that contain others; of two with a common end only the better stays."""
    for k in list(kept):
        if (k[0], k[2]) == (new[0], new[2]) or (k[1], k[3]) == (new[1], new[3]):
            if (k[4], -(k[1] - k[0])) >= (new[4], -(new[1] - new[0])):
                return
            kept.remove(k)
    kept.append(new)


def purge_common_ends(hsps: list[tuple]) -> list[tuple]:
    """Of alignments with the same start, then with the same end, the best stays."""
    best: dict = {}
    for h in sorted(hsps, key=lambda h: (-h[4], -h[1], -h[3])):
        best.setdefault((h[0], h[2]), h)
    ends: dict = {}
    for h in sorted(best.values(), key=lambda h: (-h[4], -h[0], -h[2])):
        ends.setdefault((h[1], h[3]), h)
    return list(ends.values())


def gapped_pair(ungapped: list[tuple[int, int, int, int]], q: np.ndarray, s: np.ndarray, p: Params, cut: int) -> list[tuple]:
    """(q_start, q_end, s_start, s_end, score, q_gap, s_gap) of a pair, best first."""
    order = sorted(ungapped, key=lambda u: (-u[3], u[1], -u[2], u[0]))
    low = int(0.68 * cut)
    restricted = p.restricted and order[0][3] < low
    drop = statistics.gapped_drop(p.gapped_bits)
    found: dict[int, tuple] = {}
    kept: list[tuple] = []
    k = 0
    while k < len(order):
        qs, ss, n, score = order[k]
        if k not in found and not contained((qs, qs + n, ss, ss + n, score), kept):
            at = kernels.gapped_start(q, s, qs, ss, n, p.matrix)
            got = kernels.gapped(q, s, *at, p.matrix, p.opening, p.extend, drop, restricted)
            if restricted and low <= got[0] < cut:
                restricted, k = False, 0
                continue
            if got[0] >= cut:
                h = (*got[1:], got[0], *at)
                found[k] = h
                cover(kept, h[:5])
        k += 1
    return sorted(purge_common_ends(list(found.values())), key=lambda h: (-h[4], h[2], h[0]))


def prelim(pairs: DataFrame, letters: int, p: Params) -> DataFrame:
    """HSPs of pairs (query_id, seq_id, hits, q, s): rows of HSP, significant at prelim_evalue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for b in batches:
            rows = []
            for qi, si, hits, qt, st in zip(b["query_id"], b["seq_id"], b["hits"], b["q"], b["s"]):
                if qt not in known:
                    code = matrices.encode(complexity.mask(qt, complexity.segments(qt)) if p.mask_query else qt)
                    lam, k, _ = statistics.karlin(code, p.matrix)
                    if len(known) > 1000:
                        known.clear()
                    known[qt] = (code, None if math.isnan(lam) else (statistics.ungapped_trigger(lam, k, p.trigger_bits), statistics.ungapped_drop(lam, p.ungapped_bits), statistics.cutoff(p.prelim_evalue, len(code), letters, p.cutoff_length)))
                q, own = known[qt]
                if own is None:
                    continue
                s = matrices.encode(st)
                first = suppress([(h["diag"], h["q_off"], h["distance"]) for h in hits], q, s, p, own[0], own[1])
                if not first:
                    continue
                for h in gapped_pair(first, q, s, p, own[2]):
                    e = statistics.evalue(h[4], len(q), len(s), letters)
                    if e <= p.prelim_evalue:
                        rows.append((qi, si, *h[:4], h[5], h[6], h[4], e, len(q), len(s)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HSP.split(", ")])

    return pairs.select("query_id", "seq_id", "hits", "q", "s").mapInPandas(run, HSP)


def best_pairs(hsps: DataFrame, keep: int) -> DataFrame:
    """The HSPs of each query's best pairs: by least e-value, then shorter subject, then id."""
    pair = hsps.groupBy("query_id", "seq_id").agg(F.min("evalue").alias("best"), F.first("s_len").alias("n"))
    top = pair.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "n", "seq_id"))).where(F.col("r") <= keep)
    return hsps.join(top.select("query_id", "seq_id"), ["query_id", "seq_id"])


def near_identical(q: str, s: str, h) -> bool:
    a, b = q[h["q_start"] : h["q_end"]], s[h["s_start"] : h["s_end"]]
    return bool(a) and bool(b) and kernels.identity(a.upper(), b.upper()) / min(len(a), len(b)) > 0.96


def final_pair(q_text: str, s_text: str, hsps: list[dict], letters: int, p: Params) -> list[tuple]:
    q = matrices.encode(q_text)
    done: list[tuple] = []
    flag, m, how, s = None, None, "", None
    for h in sorted(hsps, key=lambda h: (-h["score"], h["s_start"], -(h["s_end"] - h["s_start"]), h["q_start"])):
        box = (h["q_start"], h["q_end"], h["s_start"], h["s_end"], h["score"] * p.scale)
        margin = 2 * statistics.LN2 / (statistics.DEFAULT.lam / p.scale)
        if any(d[4] >= box[4] + margin and d[0] <= box[0] and box[1] <= d[1] and d[2] <= box[2] and box[3] <= d[3] for d in done):
            continue
        spans = (h["q_end"] - h["q_start"], h["s_end"] - h["s_start"])
        likely = spans[1] + 1 >= min(len(q), 50) and box[4] / max(1, min(spans)) >= 149.53
        if flag is None or likely != flag:
            flag = likely
            masked = s_text if flag and near_identical(q_text, s_text, h) else complexity.mask(s_text, complexity.segments(s_text, 10, 1.8, 2.1, 50, 2))
            s = matrices.encode(masked)
            m, how = composition.adjusted(p.matrix, q, s, scale=p.scale)
        got = kernels.traceback(q, s, h["q_gap"], h["s_gap"], m, p.opening * p.scale, p.extend * p.scale, p.final_drop)
        if got[0] > 1:
            done.append((*got[1:5], got[0], got[5], how))
    rows = []
    for d in purge_common_ends(done):
        e = statistics.evalue(d[4], len(q), len(s_text), letters, p.scale)
        if e <= p.evalue:
            rows.append((*d[:4], d[4], statistics.bit_score(d[4], p.scale), 0.0 if e < 1e-180 else e, *describe(q_text, s_text, d[0], d[2], d[5], p.matrix), d[5], d[6]))
    return rows


def describe(q: str, s: str, q0: int, s0: int, edits: str, m: np.ndarray) -> tuple[int, int, int, int, int]:
    """(identities, positives, gaps, gap opens, length)."""
    same = good = 0
    for e in edits:
        if e == "M":
            same += q[q0].upper() == s[s0].upper()
            a, b = matrices.encode(q[q0] + s[s0])
            good += m[a, b] > 0
        q0, s0 = q0 + (e != "I"), s0 + (e != "D")
    opens = sum(1 for a, b in zip("M" + edits, edits) if b != "M" and a != b)
    return same, good, len(edits) - edits.count("M"), opens, len(edits)


def finish(hsps: DataFrame, queries: DataFrame, subjects: DataFrame, letters: int, p: Params) -> DataFrame:
    """Alignments of the pairs that are left: rows of FINAL."""
    hsp = F.struct("q_start", "q_end", "s_start", "s_end", "q_gap", "s_gap", "score")
    pairs = hsps.groupBy("query_id", "seq_id").agg(F.collect_list(hsp).alias("hsps"))
    full = pairs.join(queries.select(F.col("seq_id").alias("query_id"), F.col("residues").alias("q")), "query_id").join(subjects.select("seq_id", F.col("residues").alias("s")), "seq_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(qi, si, *r) for qi, si, h, q, s in zip(b["query_id"], b["seq_id"], b["hsps"], b["q"], b["s"]) for r in final_pair(q, s, list(h), letters, p)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINAL.split(", ")])

    return full.select("query_id", "seq_id", "hsps", "q", "s").mapInPandas(run, FINAL)


def ranked(alignments: DataFrame, max_hits: int = 500) -> DataFrame:
    """Adds rank: pairs by their best alignment's e-value, bits and id, per query; at most max_hits pairs."""
    by_pair = Window.partitionBy("query_id", "seq_id")
    best = alignments.withColumn("best_e", F.min("evalue").over(by_pair)).withColumn("best_b", F.max("bits").over(by_pair))
    out = best.withColumn("rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy("best_e", F.desc("best_b"), F.desc("seq_id"))))
    return out.where(F.col("rank") <= max_hits).drop("best_e", "best_b")


class Engine:
    """Searches of query sequences (seq_id, residues, length) in subject sequences."""

    def __init__(self, spark: SparkSession, params: Params | None = None):
        self.spark, self.p = spark, params or Params()

    def load_fasta(self, path: str, collection_path: str | None = None) -> DataFrame:
        """The sequences of FASTA text, as a collection; written to collection_path and read from there if it is given."""
        seqs = fasta.read(self.spark, path).withColumn("length", F.length("residues").cast("long"))
        if collection_path is None:
            return seqs
        collection.write(seqs, collection_path)
        return collection.read(self.spark, collection_path)

    def build_index(self, subjects: DataFrame, path: str, exact: bool = False) -> DataFrame:
        """Writes the words of subjects in word order and returns them as read again, for ``search(index=...)``."""
        w = self.p.word
        words.write_index(words.kmers(subjects, w) if exact else words.code_words(subjects, w), path)
        return words.read_index(self.spark, path)

    def triggers(self, queries: DataFrame, subjects: DataFrame, exact: bool = False, index: DataFrame | None = None) -> DataFrame:
        w = self.p.word
        make = (lambda d: words.code_words(d, w)) if not exact else (lambda d: words.kmers(d, w))
        near = None if exact else words.similar_words(self.spark, self.p.threshold, self.p.matrix)
        seeds = words.seed_join(make(queries), index if index is not None else make(subjects), queries, w, near)
        return words.two_hits(seeds, self.p.window, self.p.overlap)

    def prelim(self, queries: DataFrame, subjects: DataFrame, index: DataFrame | None = None, exact: bool = False, letters: int | None = None) -> tuple[DataFrame, int]:
        """letters: those of the whole collection, if subjects are not all of it."""
        letters = int(subjects.agg(F.sum("length")).first()[0] or 0) if letters is None else letters
        hits = self.triggers(queries, subjects, exact, index).groupBy("query_id", "seq_id").agg(F.collect_list(F.struct("diag", "q_off", "distance")).alias("hits"))
        pairs = hits.join(queries.select(F.col("seq_id").alias("query_id"), F.col("residues").alias("q")), "query_id").join(subjects.select("seq_id", F.col("residues").alias("s")), "seq_id")
        return prelim(pairs, letters, self.p), letters

    def search(self, queries: DataFrame, subjects: DataFrame, index: DataFrame | None = None, exact: bool = False) -> DataFrame:
        """exact: seeds are equal words of Params.word letters instead of similar ones."""
        hsps, letters = self.prelim(queries, subjects, index, exact)
        top = best_pairs(hsps, 2 * self.p.max_hits + 50)
        return ranked(finish(top, queries, subjects, letters, self.p), self.p.max_hits)

    def search_merged(self, queries: DataFrame, subjects: DataFrame, exact: bool = False) -> DataFrame:
        """The result of ``search``, each text searched once however many subjects have it.

        A text stands under its least id. Of the pairs kept for a query only a text's first ids can be, and only texts that are themselves
        among as many by their least id; e-values are those of the whole collection.
        """
        keep = 2 * self.p.max_hits + 50
        letters = int(subjects.agg(F.sum("length")).first()[0] or 0)
        texts = cut(subjects.groupBy("residues").agg(F.min("seq_id").alias("seq_id"), F.first("length").alias("length")), "texts")
        top = cut(best_pairs(self.prelim(queries, texts, None, exact, letters)[0], keep), "top")
        copy = subjects.select("seq_id", "residues").withColumn("r", F.row_number().over(Window.partitionBy("residues").orderBy("seq_id"))).where(F.col("r") <= keep).drop("r")
        found = texts.select(F.col("seq_id").alias("text_id"), "residues").join(top.select(F.col("seq_id").alias("text_id")).distinct(), "text_id")
        pair = top.groupBy("query_id", F.col("seq_id").alias("text_id")).agg(F.min("evalue").alias("best"), F.first("s_len").alias("n"))
        each = pair.join(copy.join(found, "residues").select("text_id", "seq_id"), "text_id")
        each = each.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "n", "seq_id"))).where(F.col("r") <= keep).select("query_id", "text_id", "seq_id")
        final = finish(top, queries, texts, letters, self.p).withColumnRenamed("seq_id", "text_id")
        final = final.join(each, ["query_id", "text_id"]).drop("text_id")
        return ranked(final.select("query_id", "seq_id", *[c for c in final.columns if c not in ("query_id", "seq_id")]), self.p.max_hits)

    def exhaustive(self, queries: DataFrame, subjects: DataFrame) -> DataFrame:
        """Every query (a stated set) against all subjects by Smith-Waterman: query_id, seq_id, score, ends, evalue."""
        letters = int(subjects.agg(F.sum("length")).first()[0] or 0)
        stated = [(r["seq_id"], r["residues"]) for r in queries.select("seq_id", "residues").collect()]
        p = self.p
        held = self.spark.sparkContext.broadcast(stated)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = [(i, matrices.encode(t)) for i, t in held.value]
            for b in batches:
                rows, ids, codes = [], list(b["seq_id"]), [matrices.encode(t) for t in b["residues"]]
                order = sorted(range(len(codes)), key=lambda k: len(codes[k]))
                while order:
                    side = max(1, CELLS // max(1, len(codes[order[-1]])))
                    part, order = order[-side:], order[:-side]
                    for qi, q in own:
                        for k, (score, qe, se) in zip(part, kernels.smith_waterman_many(q, [codes[k] for k in part], p.matrix, p.opening, p.extend)):
                            rows.append((qi, ids[k], score, qe, se, statistics.evalue(score, len(q), len(codes[k]), letters) if len(q) and len(codes[k]) else math.inf))
                yield pd.DataFrame(rows, columns=["query_id", "seq_id", "score", "q_end", "s_end", "evalue"])

        return subjects.select("seq_id", "residues").mapInPandas(run, "query_id long, seq_id long, score int, q_end int, s_end int, evalue double")
