"""Letters and codes: cleaning, encoding, decoding, alphabet detection, complements, word codes. All as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the protein alphabet in code order; any other letter has the code of U.
PROTEIN = "LAGSVETKDPIRNQFYMHCWBZXU"
UNKNOWN = 23
LETTERS = 24
#: Fixed: nucleotide letters with their complements.
BASES, COMPLEMENTS = "ACGTRYKMSWBDHVN", "TGCAYRMKSWVHDBN"


def residues(text: Column) -> Column:
    """The letters A-Z and a-z of a text, others dropped; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")


def letters(residue: Column) -> Column:
    return F.filter(F.split(residue, ""), lambda c: c != "")


def codes(residue: Column) -> Column:
    """array<int> of protein codes, case ignored."""

    def code(c):
        at = F.position(F.upper(c), F.lit(PROTEIN))
        return F.when(at > 0, at - 1).otherwise(UNKNOWN)

    return F.transform(letters(residue), code)


def decode(code: Column) -> Column:
    table = F.array(*[F.lit(c) for c in PROTEIN])
    return F.array_join(F.transform(code, lambda c: F.coalesce(F.get(table, c), F.lit("_"))), "")


def alphabet(residue: Column) -> Column:
    """nucleotide iff all letters are IUPAC bases and at least nine of ten are A, C, G, T or N; else protein."""
    up = F.upper(residue)
    n = F.length(up)
    iupac = F.length(F.regexp_replace(up, f"[^{BASES}]", ""))
    plain = F.length(F.regexp_replace(up, "[^ACGTN]", ""))
    return F.when((n > 0) & (iupac == n) & (plain * 10 >= n * 9), "nucleotide").otherwise("protein")


def reverse_complement(residue: Column) -> Column:
    return F.translate(F.reverse(F.upper(residue)), BASES, COMPLEMENTS)


def word_codes(code: Column, w: int = 3) -> Column:
    """Codes of all words of w letters in order, base 24; letters beyond the alphabet count as 0."""

    def words(c):
        def one(i):
            total = F.lit(0).cast("long")
            for k in range(w):
                x = F.get(c, i + k)
                total = total * LETTERS + F.when(x < LETTERS, x).otherwise(0)
            return total

        return F.transform(F.when(F.size(c) >= w, F.sequence(F.lit(0), F.size(c) - w)).otherwise(F.array().cast("array<int>")), one)

    return F.transform(F.array(code), words)[0]  # so that the codes are made once
