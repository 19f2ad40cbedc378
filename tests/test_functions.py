import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqspark.functions import alphabet, complexity, composition, kernels, matrices, statistics

USUAL = "ARNDCQEGHILKMFPSTWYV"
M = matrices.load()


def test_matrix_is_symmetric_and_reads_both_forms():
    assert (M == M.T).all() and M[matrices.encode("W"), matrices.encode("W")][0] == 11
    letters = alphabet.PROTEIN
    square = " ".join(letters) + "\n" + "\n".join(c + " " + " ".join(map(str, r)) for c, r in zip(letters, M))
    assert (matrices.parse("# remark\n" + square) == M).all()


def test_statistics_of_known_cases():
    assert [round(statistics.evalue(s, 312, 300, 10**6), 6) for s in (40, 60)] == [209.430244, 0.745332]
    assert [statistics.cutoff(50, n, 10**6) for n in (100, 312, 1000)] == [36, 41, 46]
    assert [round(statistics.bit_score(s), 6) for s in (1600, 1935, 1936)] == [23.868211, 27.720207, 28.105406]
    assert statistics.gapped_drop() == 38
    assert statistics.evalue_text(1e-200) == "0.0" and statistics.evalue_text(0.05) == "0.050"


protein = st.text(USUAL, min_size=1, max_size=40)


@settings(max_examples=60, deadline=None)
@given(protein, protein)
def test_gapped_is_at_most_smith_waterman_and_traceback_adds_up(a, b):
    q, s = matrices.encode(a), matrices.encode(b)
    best = kernels.smith_waterman(q, s, M)
    assert kernels.smith_waterman_many(q, [s, s[:0], s[:3]], M) == [best, (0, 0, 0), kernels.smith_waterman(q, s[:3], M)]
    i, j = len(q) // 2, len(s) // 2
    g = kernels.gapped(q, s, i, j, M, x=10**6)
    assert g[0] <= best[0]
    score, q0, q1, s0, s1, edits = kernels.traceback(q, s, i, j, M, x=10**6)
    at, to, total, last = q0, s0, 0, "M"
    for e in edits:
        total += M[q[at], s[to]] if e == "M" else -1 - 11 * (e != last)
        at, to, last = at + (e != "I"), to + (e != "D"), e
    assert (total, at, to) == (score, q1, s1) and score >= g[0]


def test_equal_sequences_reach_smith_waterman():
    q = matrices.encode("MKVLAWWDERTYIPASDFGHKLCVNM")
    assert kernels.gapped(q, q, 5, 5, M)[0] == kernels.smith_waterman(q, q, M)[0]


def test_low_complexity():
    assert complexity.segments("MKVLAAGIVGLC" + "QP" * 15 + "DEFGHIKLMNPQRSTVWY")
    assert complexity.segments("") == [] and complexity.dust("") == []
    s, e = complexity.dust("ACGTTGCATG" + "A" * 40 + "GCTAGCTTACG")[0]
    assert s <= 12 and e >= 48
    assert complexity.mask("ABCDEF", [(1, 3)]) == "AXXDEF"


def test_composition_rules():
    q = matrices.encode(USUAL * 5)
    assert composition.adjusted(M, q, matrices.encode("XXXX"))[1] == "none"
    m, how = composition.adjusted(M, q, matrices.encode("AAAAGGGGLLLLKKKK" * 4 + USUAL * 2))
    assert how in ("adjust", "scale") and m.shape == M.shape


def test_codes(spark):
    df = spark.createDataFrame([("LAGSU",), ("lag",), ("J*",), (None,), ("AC-D*\n12 ef",)], "t string")
    r = df.select(alphabet.residues(F.col("t")).alias("r")).select("r", alphabet.codes(F.col("r")).alias("c")).collect()
    assert [x["c"] for x in r] == [[0, 1, 2, 3, 23], [0, 1, 2], [23], [], [1, 18, 8, 5, 14]] and r[4]["r"] == "ACDef"
    df = spark.createDataFrame([("ACGTACGTNN",), ("ACGTRYKM",), ("MKV",), ("",)], "r string")
    assert [x[0] for x in df.select(alphabet.alphabet(F.col("r"))).collect()] == ["nucleotide", "protein", "protein", "protein"]
    w = df.sparkSession.createDataFrame([("LAG",), ("AAA",), ("MKV",), ("ACD",), ("AC",)], "r string")
    assert [x[0] for x in w.select(alphabet.word_codes(alphabet.codes(F.col("r")))).collect()] == [[26], [601], [9388], [1016], []]


def test_search_space_beyond_int(spark):
    s = spark.createDataFrame([(302,)], "score int")
    space = statistics.search_space(F.col("score"), F.lit(60_000_000), F.lit(50_000), F.lit(2))
    assert s.select(space.alias("space")).first()["space"] == 300 * 59_900_000
    whole = statistics.search_space(F.col("score"), F.lit(2_000_000_000), F.lit(1_500_000_000), F.lit(2))
    assert s.select(whole.alias("space")).first()["space"] == 300 * -1_000_000_000
