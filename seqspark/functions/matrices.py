"""Score matrices and gap parameters. Others than the default are read from the usual text format, by path."""

from __future__ import annotations

import numpy as np

from .alphabet import LETTERS, PROTEIN, UNKNOWN

#: BLOSUM62, lower triangle, in the order of the letters before each row; X and U score -1 with all.
BLOSUM62 = """
A 4
B -2 4
C 0 -3 9
D -2 4 -3 6
E -1 1 -4 2 5
F -2 -3 -2 -3 -3 6
G 0 -1 -3 -1 -2 -3 6
H -2 0 -3 -1 0 -1 -2 8
I -1 -3 -1 -3 -3 0 -4 -3 4
K -1 0 -3 -1 1 -3 -2 -1 -3 5
L -1 -4 -1 -4 -3 0 -4 -3 2 -2 4
M -1 -3 -1 -3 -2 0 -3 -2 1 -1 2 5
N -2 4 -3 1 0 -3 0 1 -3 0 -3 -2 6
P -1 -2 -3 -1 -1 -4 -2 -2 -3 -1 -3 -2 -2 7
Q -1 0 -3 0 2 -3 -2 0 -3 1 -2 0 0 -1 5
R -1 -1 -3 -2 0 -3 -2 0 -3 2 -2 -1 0 -2 1 5
S 1 0 -1 0 0 -2 0 -1 -2 0 -2 -1 1 -1 0 -1 4
T 0 -1 -1 -1 -1 -2 -2 -2 -1 -1 -1 -1 0 -1 -1 -1 1 5
V 0 -3 -1 -3 -2 -1 -3 -3 3 -2 1 1 -3 -2 -2 -3 -2 0 4
W -3 -4 -2 -4 -3 1 -2 -2 -3 -3 -2 -1 -4 -4 -2 -3 -3 -2 -3 11
Y -2 -3 -2 -3 -2 3 -3 2 -1 -2 -1 -1 -2 -3 -1 -2 -2 -2 -1 2 7
Z -1 0 -3 1 4 -3 -2 0 -3 1 -3 -1 0 -1 4 0 0 -1 -2 -2 -2 4
"""
#: Default gap penalties by matrix (open, extend).
GAPS = {"BLOSUM45": (14, 2), "BLOSUM50": (13, 2), "BLOSUM62": (11, 1), "BLOSUM80": (10, 1), "PAM30": (10, 1), "PAM70": (9, 1)}
#: Residue frequencies (Robinson and Robinson) in code order, per thousand.
BACKGROUND = dict(zip("LAGSVETKDPIRNQFYMHCW", (90.19, 78.05, 73.77, 71.20, 64.41, 62.95, 58.41, 57.44, 53.64, 52.03, 51.42, 51.29, 44.87, 42.64, 38.56, 32.16, 22.43, 21.99, 19.25, 13.30)))


def parse(text: str) -> np.ndarray:
    """A matrix in code order from text: a header of column letters and one row per letter, or a lower triangle.

    Cells that the text leaves open are 1 on the diagonal, else the lowest score; ``*`` is ignored.
    """
    rows = [r.split() for r in text.splitlines() if r.strip() and not r.startswith("#")]
    square = all(len(c) == 1 and not c.lstrip("-").isdigit() for c in rows[0])
    columns = rows[0] if square else [r[0] for r in rows]
    given: dict[tuple[str, str], int] = {}
    for r in rows[1:] if square else rows:
        for c, v in zip(columns, r[1:]):
            given[r[0], c] = int(v)
            given.setdefault((c, r[0]), int(v))
    if not square:
        given |= {(a, b): -1 for x in "XU" for y in PROTEIN for a, b in ((x, y), (y, x))}
    low = min(given.values())
    m = np.full((LETTERS, LETTERS), low, np.int64)
    np.fill_diagonal(m, 1)
    for (a, b), v in given.items():
        if a in PROTEIN and b in PROTEIN:
            m[PROTEIN.index(a), PROTEIN.index(b)] = v
    return m


def load(path: str | None = None) -> np.ndarray:
    if path is None:
        return parse(BLOSUM62)
    with open(path) as f:
        return parse(f.read())


def encode(residues: str) -> np.ndarray:
    at = {c: i for i, c in enumerate(PROTEIN)}
    return np.array([at.get(c, UNKNOWN) for c in residues.upper()], np.int64)
