"""Alignment kernels on code arrays: ungapped and gapped X-drop extension, traceback, Smith-Waterman, banded identity."""

from __future__ import annotations

import numpy as np

NEG = -(10**9)


def ungapped(q: np.ndarray, s: np.ndarray, q_word: int, s_word: int, first_end: int, m: np.ndarray, x: int, w: int = 3):
    """Two-hit extension from the second word: (q_start, s_start, length, score, right end reached or -1).

    first_end: one behind the first word's last subject letter. Left from the best prefix of the word; right only if the left
    side reached the first word.
    """
    run = best = 0
    anchor = 0
    for k in range(w):
        run += m[q[q_word + k], s[s_word + k]]
        if run > best:
            best, anchor = run, k + 1
    qa, sa = q_word + anchor, s_word + anchor
    left, score, back = 0, 0, 0
    k = 1
    while k <= min(qa, sa):
        score += m[q[qa - k], s[sa - k]]
        if score > left:
            left, back = score, k
        elif left - score >= x:
            break
        k += 1
    total, ahead, reached = left, 0, -1
    if back >= sa - first_end:
        score, k = left, 0
        while qa + k < len(q) and sa + k < len(s):
            score += m[q[qa + k], s[sa + k]]
            k += 1
            if score > total:
                total, ahead = score, k
            elif score <= 0 or total - score >= x:
                break
        reached = sa + k
    return qa - back, sa - back, back + ahead, total, reached


def gapped_start(q: np.ndarray, s: np.ndarray, q_start: int, s_start: int, length: int, m: np.ndarray, window: int = 11) -> tuple[int, int]:
    """The middle of the best window of an ungapped alignment."""
    if length <= window:
        return q_start + length // 2, s_start + length // 2
    v = m[q[q_start : q_start + length], s[s_start : s_start + length]]
    sums = np.convolve(v, np.ones(window, np.int64), "valid")
    k = int(sums.argmax())
    at = k + window - 1 - window // 2 if sums[k] > 0 else 0
    return q_start + at, s_start + at


def xdrop(q: np.ndarray, s: np.ndarray, m: np.ndarray, opening: int, extend: int, x: int, restricted: bool = False, trace: bool = False):
    """Best score of an alignment that begins at both starts: (score, letters of q, letters of s[, edit string]).

    Row by row over q; a cell further than x below the best ends, gap states pass on. The first maximum in row order wins.
    Edits: M substitution, D letter of q against a gap, I letter of s against a gap. restricted: gaps open only at multiples of 10.
    """
    x = max(x, opening + extend)
    cost = opening + extend
    n = len(s)
    best, bq, bs = 0, 0, 0
    h = np.full(n + 2, NEG)
    up = np.full(n + 2, NEG)  # gap in s open above: consumes q
    h[0] = 0
    last = 0
    for j in range(1, n + 1):
        v = -cost - (j - 1) * extend
        if -v > x:
            break
        h[j] = v
        last = j
    up[: last + 1] = h[: last + 1] - cost
    first = 0
    rows = [(0, "")] if trace else None
    marks = []
    if trace:
        marks.append((0, ["I"] * (last + 1)))
    for i in range(1, len(q) + 1):
        row = m[q[i - 1]]
        diag, side = NEG, NEG
        new_first, new_last = None, -1
        line = []
        j = first
        while j <= n and (j <= last + 1 or best - side <= x):
            sub = diag + row[s[j - 1]] if j > 0 and diag > NEG // 2 else NEG
            old = h[j] if first <= j <= last else NEG
            above = up[j] if first <= j <= last else NEG
            v, mark = sub, "M"
            if above > v:
                v, mark = above, "D"
            if side > v:
                v, mark = side, "I"
            diag = old
            may_q = not restricted or j % 10 == 0
            may_s = not restricted or i % 10 == 0
            extended_up, extended_side = above - extend, side - extend
            if v <= NEG // 2 or best - v > x:
                keep = NEG
                up[j], side = extended_up, extended_side
                opened = ""
            else:
                keep = v
                if v > best:
                    best, bq, bs = v, i, j
                open_up = v - cost if may_q else NEG
                open_side = v - cost if may_s else NEG
                up[j] = max(extended_up, open_up)
                side_new = max(extended_side, open_side)
                opened = ("u" if extended_up < open_up else "") + ("s" if extended_side < open_side else "")
                side = side_new
                new_first = j if new_first is None else new_first
                new_last = j
            if up[j] > NEG // 2 and best - up[j] <= x:
                new_first = j if new_first is None else new_first
                new_last = max(new_last, j)
            h[j] = keep
            if trace:
                line.append((mark, opened))
            j += 1
        if trace:
            marks.append((first, line))
        if new_first is None:
            break
        first, last = new_first, max(new_last, new_first)
    if not trace:
        return best, bq, bs
    return best, bq, bs, _walk(marks, bq, bs)


def _walk(marks, i: int, j: int) -> str:
    """Edits from the origin to cell (i, j)."""
    out = []
    state = "H"
    while i > 0 or j > 0:
        if i == 0:
            out.append("I" * j)
            break
        first, line = marks[i]
        mark, _ = line[j - first]
        if state == "H":
            state = mark
            continue
        if state == "M":
            out.append("M")
            i, j, state = i - 1, j - 1, "H"
        elif state == "D":
            out.append("D")
            i -= 1
            if i == 0:
                state = "H"
                continue
            first, line = marks[i]
            opened = line[j - first][1] if 0 <= j - first < len(line) else ""
            state = "H" if "u" in opened else "D"
        else:
            out.append("I")
            j -= 1
            first, line = marks[i]
            opened = line[j - first][1] if 0 <= j - first < len(line) else ""
            state = "H" if "s" in opened else "I"
    return "".join(out)[::-1]


def gapped(q, s, q_at: int, s_at: int, m, opening=11, extend=1, x=38, restricted=False):
    """Score-only extension both ways from a start pair: (score, q_start, q_end, s_start, s_end)."""
    a, lq, ls = xdrop(q[: q_at + 1][::-1], s[: s_at + 1][::-1], m, opening, extend, x, restricted)
    b, rq, rs = xdrop(q[q_at + 1 :], s[s_at + 1 :], m, opening, extend, x, restricted) if q_at + 1 < len(q) and s_at + 1 < len(s) else (0, 0, 0)
    return a + b, q_at + 1 - lq, q_at + 1 + rq, s_at + 1 - ls, s_at + 1 + rs


def traceback(q, s, q_at: int, s_at: int, m, opening=11, extend=1, x=65):
    """As gapped, with the edit string; gaps at either end are taken off and their cost given back."""
    a, lq, ls, le = xdrop(q[: q_at + 1][::-1], s[: s_at + 1][::-1], m, opening, extend, x, trace=True)
    b, rq, rs, re_ = xdrop(q[q_at + 1 :], s[s_at + 1 :], m, opening, extend, x, trace=True)
    edits = le[::-1] + re_
    q0, q1, s0, s1, score = q_at + 1 - lq, q_at + 1 + rq, s_at + 1 - ls, s_at + 1 + rs, a + b
    for front in (True, False):
        while edits and edits[0 if front else -1] != "M":
            c = edits[0 if front else -1]
            body = edits.lstrip(c) if front else edits.rstrip(c)
            k = len(edits) - len(body)
            score += opening + extend * k
            if c == "D":
                q0, q1 = (q0 + k, q1) if front else (q0, q1 - k)
            else:
                s0, s1 = (s0 + k, s1) if front else (s0, s1 - k)
            edits = body
    return score, q0, q1, s0, s1, edits


def smith_waterman(q: np.ndarray, s: np.ndarray, m: np.ndarray, opening: int = 11, extend: int = 1) -> tuple[int, int, int]:
    """Best local affine score and its end (exclusive) in both; one vectorised row per query letter."""
    n = len(s)
    if not len(q) or not n:
        return 0, 0, 0
    h, f = np.zeros(n + 1, np.int64), np.full(n + 1, NEG, np.int64)
    k = np.arange(n + 1) * extend
    best, at = 0, (0, 0)
    for i, c in enumerate(q):
        f = np.maximum(f - extend, h - opening - extend)
        t = np.maximum(0, f)
        t[1:] = np.maximum(t[1:], h[:-1] + m[c, s])
        t[0] = 0
        e = np.maximum.accumulate(t + k)  # a gap along s from any cell before
        g = np.full(n + 1, NEG, np.int64)
        g[1:] = e[:-1] - k[1:] - opening
        h = np.maximum(t, g)
        top = int(h.max())
        if top > best:
            best, at = top, (i + 1, int(h.argmax()))
    return best, *at


def smith_waterman_many(q: np.ndarray, subjects: list[np.ndarray], m: np.ndarray, opening: int = 11, extend: int = 1) -> list[tuple[int, int, int]]:
    """smith_waterman of one query with many subjects, side by side in one array."""
    width = max(map(len, subjects), default=0)
    if not len(q) or not width:
        return [(0, 0, 0)] * len(subjects)
    s = np.full((len(subjects), width), len(m), np.int64)  # behind a subject's end nothing scores
    for k, x in enumerate(subjects):
        s[k, : len(x)] = x
    wide = np.concatenate((m, np.full((len(m), 1), NEG)), axis=1)
    h, f = np.zeros((len(s), width + 1), np.int64), np.full((len(s), width + 1), NEG, np.int64)
    k = np.arange(width + 1) * extend
    best, at = np.zeros(len(s), np.int64), np.zeros((len(s), 2), np.int64)
    for i, c in enumerate(q):
        f = np.maximum(f - extend, h - opening - extend)
        t = np.maximum(0, f)
        t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + wide[c][s])
        t[:, 0] = 0
        g = np.maximum.accumulate(t + k, axis=1)
        h = t
        h[:, 1:] = np.maximum(h[:, 1:], g[:, :-1] - k[1:] - opening)
        place = h.argmax(1)
        top = h[np.arange(len(s)), place]
        more = top > best
        best[more] = top[more]
        at[more] = np.stack((np.full(more.sum(), i + 1), place[more]), 1)
    return [(int(b), int(x), int(y)) for b, (x, y) in zip(best, at)]


def identity(a: str, b: str, shift: int = 0, band: int = 10) -> int:
    """Most equal letters of an alignment within a band around the diagonal."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        diag, lo = row[max(0, i + shift - band - 1)], max(1, i + shift - band)
        for j in range(lo, min(len(b), i + shift + band) + 1):
            up = row[j]
            row[j] = max(diag + (c == b[j - 1]), up, row[j - 1])
            diag = up
    return max(row)


#: Letters of a row of pairs that are compared side by side.
SIDE = 2_000_000


def identities(a: list[bytes], b: list[bytes], shifts: list[int], least: float = 0.0, band: int = 10) -> list[int]:
    """identity of many pairs side by side; 0 for those that don't reach the share least of a's letters."""
    out = [0] * len(a)
    order = []
    for k, (x, y, s) in enumerate(zip(a, b, shifts)):
        if s >= 0 and y[s : s + len(x)] == x:
            out[k] = len(x)
        else:
            order.append(k)
    order.sort(key=lambda k: len(a[k]))
    while order:
        side = max(1, SIDE // (len(a[order[-1]]) + 2 * band + 1))
        ks, order = np.array(order[-side:]), order[:-side]
        n = len(a[ks[-1]])
        size = np.array([len(a[k]) for k in ks])
        rows, cols = np.zeros((len(ks), n), np.uint8), np.ones((len(ks), n + 2 * band + 1), np.uint8)
        for p, k in enumerate(ks):
            rows[p, : len(a[k])] = np.frombuffer(a[k], np.uint8)
            start = int(shifts[k]) - band
            part = np.frombuffer(b[k], np.uint8)[max(0, start) : max(0, start + cols.shape[1])]
            cols[p, max(0, -start) : max(0, -start) + len(part)] = part
        rows, cols = np.ascontiguousarray(rows.T), np.ascontiguousarray(cols.T)
        best = np.zeros((2 * band + 1, len(ks)), np.int32)
        for i in range(n):
            got = best + (cols[i : i + 2 * band + 1] == rows[i])
            np.maximum(got[:-1], best[1:], out=got[:-1])
            best = np.maximum.accumulate(got, axis=0)
            if i % 64 == 63:
                can = (best[-1] + np.maximum(size - i - 1, 0)) / size >= least
                if can.sum() < 0.8 * len(ks):
                    ks, size, best = ks[can], size[can], best[:, can]
                    rows, cols = np.ascontiguousarray(rows[:, can]), np.ascontiguousarray(cols[:, can])
                    if not len(ks):
                        break
        for k, n_same in zip(ks, best[-1]):
            out[k] = int(n_same) if n_same / max(1, len(a[k])) >= least else 0
    return out
