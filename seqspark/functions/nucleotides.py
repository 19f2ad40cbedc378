"""Nucleotide letters: ambiguity sets, their replacement and return, packing, and score matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC letters and the bases that each stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "N": "ACGT", "B": "CGT", "D": "AGT", "H": "ACT", "K": "GT", "M": "AC", "R": "AG", "S": "CG", "V": "ACG", "W": "AT", "Y": "CT"}
PLAIN = "ACGT"


def bases_of(residue: Column) -> Column:
    """The IUPAC letters of a text, in upper case."""
    return F.regexp_replace(F.upper(residue), f"[^{''.join(IUPAC)}]", "")


def replaced(text: str) -> str:
    """Ambiguity letters replaced by their bases in turn: the k-th place of a letter (from 1) gets base k mod n."""
    seen: dict[str, int] = {}
    out = []
    for c in text:
        if c in PLAIN:
            out.append(c)
        else:
            seen[c] = k = seen.get(c, 0) + 1
            out.append(IUPAC[c][k % len(IUPAC[c])])
    return "".join(out)


def without_ambiguity(bases: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(replaced, na_action="ignore")

    return F.pandas_udf(run, "string")(bases)


def ambiguities(bases: Column) -> Column:
    """array<struct<pos, letter>> of the ambiguity letters, positions from 0."""
    letters = F.transform(F.filter(F.split(bases, ""), lambda c: c != ""), lambda c, i: F.struct(i.alias("pos"), c.alias("letter")))
    return F.filter(letters, lambda x: ~x["letter"].isin(*PLAIN))


def _bound(column: Column, one) -> Column:
    """one(column), with the column's value made once, not once for each element that a lambda in it visits."""
    return F.transform(F.array(column), one)[0]


def restored(bases: Column, edits: Column) -> Column:
    """The letters with the ambiguity letters put back in their places: stretches between the edits, each with the letter behind it."""

    def one(x):
        b, e = x["b"], x["e"]
        behind = lambda i: F.when(i == 0, 0).otherwise(F.get(e, i - 1)["pos"] + 1)
        parts = F.transform(e, lambda v, i: F.concat(F.substring(b, behind(i) + 1, v["pos"] - behind(i)), v["letter"]))
        return F.concat(F.array_join(parts, ""), F.substring(b, behind(F.size(e)) + 1, F.length(b)))

    return _bound(F.struct(bases.alias("b"), edits.alias("e")), one)


def packed(bases: Column) -> Column:
    """Four bases a byte, the first in the highest bits, a last byte filled up with A: as lower-case hex."""

    def one(digits):
        starts = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(4))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(starts, lambda i: F.lpad(F.lower(F.conv(F.rpad(F.substring(digits, i, F.lit(4)), 4, "0"), 4, 16)), 2, "0")), "")

    return _bound(F.translate(bases, PLAIN, "0123"), one)


def unpacked(pack: Column, length: Column) -> Column:
    def one(p):
        starts = F.when(F.length(p) > 0, F.sequence(F.lit(1), F.length(p), F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(starts, lambda i: F.lpad(F.conv(F.substring(p, i, F.lit(2)), 16, 4), 4, "0")), "")

    return F.substring(F.translate(_bound(pack, one), "0123", PLAIN), F.lit(1), length)


def scores(match: int, mismatch: int) -> dict[tuple[str, str], int]:
    """Score of two letters: by the chance that bases drawn from both are equal, rounded up."""
    out = {}
    for a, x in IUPAC.items():
        for b, y in IUPAC.items():
            p = len({*x} & {*y}) / (len(x) * len(y))
            out[a, b] = math.ceil(match * p + mismatch * (1 - p) - 1e-9)
    return out


def matrix(match: int, mismatch: int) -> np.ndarray:
    """The same as an array, in the order of IUPAC."""
    s = scores(match, mismatch)
    return np.array([[s[a, b] for b in IUPAC] for a in IUPAC], np.int64)
