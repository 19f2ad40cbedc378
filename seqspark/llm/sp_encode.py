"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model is a BPE model with byte fallback. Its encoding of a text is the one path through the lattice of pieces
in which every two neighbours are *compatible*: encoding the two pieces' text alone gives the same two pieces.
(Any cut of a valid encoding is valid, and each text has one valid encoding.) In the max-plus semiring an edge
between compatible pieces weighs 0 and any other minus infinity, so the best path is that encoding, and paths over
a stretch of text form a matrix between the states at its two ends. A state at a cut is a piece that begins before
the cut and ends at or behind it; there are few, as pieces have at most 16 characters.

Documents are split into chunks of CHUNK characters. Each chunk yields its transfer matrix; a document's matrices are
combined in order (they are associative, and small: some states by some states for each chunk), which fixes the state
at every cut; then each chunk is backtraced on its own between its two states. The chunks of giant documents (over
DEALT chunks) are dealt over all tasks; where a chunk is worked on is the only difference. No piece crosses from a non-blank
to a blank, so all states meet in one at every word's beginning, where a matrix is a product of one column and one row:
the words between two cuts are lattices of their own with one state at the beginning. As every prefix of a word has one valid
encoding, one state at each place has weight 0 (the last piece of that encoding), and the path goes through these states
in depth, longest pieces first, entering no place twice. Paths of distinct words are kept in a bounded cache.

Edge cases: null texts are empty texts, which have no pieces; unknown characters are their bytes; equal doc_ids are
encoded each by itself; an empty table gives an empty result; other input columns are ignored.
Decoding gives the text back exactly, but for U+2581, which the model reads as a blank.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, table, tune

CHUNK = 16_384
#: Documents of more chunks are dealt over all tasks.
DEALT = 4
CACHE = 500_000
#: Words of up to so many characters keep their paths in the cache.
KEPT = 64
BLANK = "\u2581"
KEY = 5
NEG = -np.inf
EMPTY: dict = {}
START = (0, -1)


class Model:
    """A BPE model file: pieces, and which may stand beside each other, for the lattice."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.text = [self.sp.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.id = {self.text[i]: i for i in usual}
        self.score = {self.text[i]: self.sp.get_score(i) for i in usual}
        self.longest = max(map(len, self.id))
        if any(re.search(f"[^{BLANK}]{BLANK}", t) for t in self.id):
            raise ValueError("pieces of this model cross word beginnings")
        self.bytes = {i: bytes([int(self.text[i][3:5], 16)]) for i in range(n) if self.sp.is_byte(i)}
        self.byte_id = {v[0]: k for k, v in self.bytes.items()}
        self.fit: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.id_bytes = {t: np.array([i], np.int32).tobytes() for t, i in self.id.items()}
        self.shown = [self.bytes[i] if i in self.bytes else t.replace(BLANK, " ").encode("utf-8") for i, t in enumerate(self.text)]
        self.whole = {t for t in self.id if self.merge(t) == [t]}
        # by a beginning of up to KEY characters: the lengths of pieces that begin so, or are beginnings of it, longest first
        self.begins: dict[str, list[int]] = {}
        for t in sorted(self.whole, key=len, reverse=True):
            if len(t) > 1 and len(t) not in (known := self.begins.setdefault(t[:KEY], [])):
                known.append(len(t))
        for t, known in self.begins.items():
            known.extend(n for n in range(min(len(t), known[-1]) - 1, 0, -1) if n == 1 or t[:n] in self.whole)
        self.words: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """BPE on a short string: join the neighbours of the best-scored piece, the leftmost first."""
        s, score = list(text), self.score.get
        joined = [score(a + b, NEG) for a, b in zip(s, s[1:])]
        while joined and (best := max(joined)) > NEG:
            i = joined.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = score(s[i - 1] + s[i], NEG)
            if i < len(joined):
                joined[i] = score(s[i] + s[i + 1], NEG)
        return s

    def pieces_at(self, s: str, i: int) -> list[str]:
        """Pieces that may begin at s[i]; a single character always may."""
        return [s[i]] + [s[i : i + n] for n in range(2, min(self.longest, len(s) - i) + 1) if s[i : i + n] in self.whole]

    def compatible(self, a: str, b: str) -> bool:
        if b[0] == BLANK and a[-1] != BLANK:
            return True
        row = self.fit.get(a)
        ok = row.get(b) if row else None
        if ok is None:
            if self.pairs > CACHE:
                self.fit.clear()
                self.pairs = 0
            ok = self.fit.setdefault(a, {})[b] = self.merge(a + b) == [a, b]
            self.pairs += 1
        return ok

    def ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte_id[c] for c in piece.encode("utf-8", "surrogatepass")]

    def bytes_of(self, piece: str) -> bytes:
        """The piece's ids as 32-bit numbers."""
        return self.id_bytes.get(piece) or np.array(self.ids(piece), np.int32).tobytes()

    def lengths(self, key: str) -> list[int]:
        """Lengths that pieces beginning with key, or inside it, can have, longest first; kept within the cache's bound."""
        known = next((self.begins[key[:n]] for n in range(len(key), 1, -1) if key[:n] in self.begins), [1])
        if len(self.begins) < CACHE:
            self.begins[key] = known
        return known

    def word(self, w: str) -> bytes:
        """Ids, as 32-bit numbers, of a word's one path: states in depth, each place entered once, so that the work is linear."""
        whole, fit, begins, size = self.whole, self.fit, self.begins, len(w)
        path, left, dead, at, last = [], [], set(), 0, ""
        while at < size:
            if len(left) == len(path):
                key = w[at : at + KEY]
                left.append(iter(begins.get(key) or self.lengths(key)))
            row = fit.get(last, EMPTY)
            for n in left[-1]:
                end = at + n
                if end > size or end in dead:
                    continue
                q = w[at:end]
                if n > KEY and q not in whole:
                    continue
                ok = row.get(q) if last else True
                if ok is None:
                    ok = self.compatible(last, q)
                if ok:
                    path.append(q)
                    at, last = end, q
                    break
            else:
                dead.add(at)
                left.pop()
                at -= len(path.pop())
                last = path[-1] if path else ""
        usual = self.id_bytes
        return b"".join([usual.get(q) or self.bytes_of(q) for q in path])

    def word_ids(self, words: list[str]) -> bytes:
        """Ids, as 32-bit numbers, of runs that begin with a blank and have blanks only at their beginning."""
        seen = self.words
        if len(seen) > CACHE:
            seen.clear()
        out = []
        for w in words:
            ids = seen.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= KEPT:
                    seen[w] = ids
            out.append(ids)
        return b"".join(out)


RUN = re.compile(f"{BLANK}+[^{BLANK}]*")


def shown(text: str | None) -> str:
    """The text as the model reads it."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def spans(n: int, chunk: int) -> list[tuple[int, int]]:
    return [(i, min(n, i + chunk)) for i in range(0, max(n, 1), chunk)]


def states(m: Model, s: str, at: int) -> list[tuple[int, str]]:
    """The states at a cut in the middle of s: (characters behind the cut, piece), in a fixed order."""
    out = []
    for i in range(max(0, at - m.longest), at):
        for p in m.pieces_at(s, i):
            if i + len(p) >= at:
                out.append((i + len(p) - at, p))
    return sorted(out)


def first_word(s: str, lo: int, hi: int) -> int:
    """The first place in [lo, hi) where a word begins behind a non-blank; hi if none."""
    for i in range(max(lo, 1), hi):
        if s[i] == BLANK and s[i - 1] != BLANK:
            return i
    return hi


def last_word(s: str, lo: int, hi: int) -> int:
    for i in range(hi - 1, max(lo, 1) - 1, -1):
        if s[i] == BLANK and s[i - 1] != BLANK:
            return i
    return lo


def lattice(m: Model, s: str, lo: int, stop: int, enter: list[tuple[int, str]]) -> dict[tuple[int, str], dict]:
    """Reachable (end, piece) with, for each entering state that reaches it (weight 0), the predecessor. Runs until pieces end at or behind stop."""
    reach: dict[tuple[int, str], dict[int, tuple]] = {}
    by_end: dict[int, list[str]] = {}
    for k, (off, p) in enumerate(enter):
        reach.setdefault((lo + off, p), {})[k] = None
        by_end.setdefault(lo + off, [])
        if p not in by_end[lo + off]:
            by_end[lo + off].append(p)
    for i in range(lo, stop):
        for p in by_end.get(i, ()):
            rows = reach[i, p]
            for q in m.pieces_at(s, i):
                if p is None or p == "" or m.compatible(p, q):
                    key = (i + len(q), q)
                    if key not in reach:
                        reach[key] = {}
                        by_end.setdefault(key[0], []).append(q)
                    for k in rows:
                        reach[key].setdefault(k, (i, p))
    return reach


def transfer(m: Model, s: str, lo: int, hi: int, first: bool, last: bool) -> np.ndarray:
    """The chunk's matrix between the states at lo and at hi: 0 or minus infinity."""
    enter = [(0, "")] if first else states(m, s, lo)
    leave = [(0, "")] if last else states(m, s, hi)
    a = first_word(s, lo, hi) if not first else lo
    if first or a < hi:
        b = max(last_word(s, a, hi), a)
        head = [True] * len(enter)
        if not first:
            reach = lattice(m, s, lo, a, enter)
            ok = {k for (end, _), rows in reach.items() if end == a for k in rows}
            head = [k in ok for k in range(len(enter))]
        if last:
            return np.where(np.array(head)[:, None], 0.0, NEG)
        reach = lattice(m, s, b, hi, [(0, "")])
        tail = [(hi + off, p) in reach for off, p in leave]
        return np.where(np.array(head)[:, None] & np.array(tail)[None, :], 0.0, NEG)
    reach = lattice(m, s, lo, hi, enter)
    out = np.full((len(enter), len(leave)), NEG)
    for j, (off, p) in enumerate(leave):
        if last:
            for (end, _), rows in reach.items():
                if end == hi:
                    out[list(rows), 0] = 0.0
        else:
            out[list(reach.get((hi + off, p), {})), j] = 0.0
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def resolve(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states each chunk begins and ends in: prefix products from the left, suffix products from the right."""
    forward = [np.zeros((1, 1))]
    for x in matrices:
        forward.append(combine(forward[-1], x))
    backward = [np.zeros((1, 1))]
    for x in reversed(matrices):
        backward.append(combine(x, backward[-1]))
    backward.reverse()
    at = [int((f[0] + b[:, 0]).argmax()) for f, b in zip(forward, backward)]
    return list(zip(at, at[1:]))


def path_back(reach: dict, k: int, end: tuple[int, str], lo: int) -> list[str]:
    out, at = [], end
    while at is not None and reach[at].get(k) is not None:
        out.append(at[1])
        at = reach[at][k]
    return out[::-1]


def path_ids(m: Model, path: list[str]) -> bytes:
    return b"".join(map(m.bytes_of, path))


def backtrace(m: Model, s: str, lo: int, hi: int, first: bool, last: bool, k: int, j: int) -> bytes:
    """Ids (32-bit) of the pieces that begin in [lo, hi), given the chunk's two states."""
    enter = [(0, "")] if first else states(m, s, lo)
    leave = None if last else states(m, s, hi)[j]
    out = b""
    a = lo if first else first_word(s, lo, hi)
    if not (first or a < hi):
        reach = lattice(m, s, lo, hi, [enter[k]])
        ends = [e for e in reach if e[0] == hi] if last else [(hi + leave[0], leave[1])]
        return path_ids(m, path_back(reach, 0, min(e for e in ends if 0 in reach.get(e, {})), lo))
    if not first and a > lo + enter[k][0]:
        reach = lattice(m, s, lo, a, [enter[k]])
        out = path_ids(m, path_back(reach, 0, next(e for e in reach if e[0] == a), lo))
    b = hi if last else max(last_word(s, a, hi), a)
    out += m.word_ids(RUN.findall(s, a, b))
    if not last:
        reach = lattice(m, s, b, hi, [(0, "")])
        out += path_ids(m, path_back(reach, 0, (hi + leave[0], leave[1]), b))
    return out


def encode_text(m: Model, text: str | None, chunk: int = CHUNK) -> np.ndarray:
    """One text through the whole scan, in one place."""
    s = shown(text)
    if not s:
        return np.empty(0, np.int32)
    cuts = spans(len(s), chunk)
    last = len(cuts) - 1
    ends = resolve([transfer(m, s, lo, hi, c == 0, c == last) for c, (lo, hi) in enumerate(cuts)]) if last else [(0, 0)]
    return np.frombuffer(b"".join(backtrace(m, s, lo, hi, c == 0, c == last, *ends[c]) for c, (lo, hi) in enumerate(cuts)), np.int32)


def decode_ids(m: Model, ids) -> str:
    """Ids to text: the bytes of all pieces side by side, read as UTF-8, the first blank taken off."""
    return b"".join(map(m.shown.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, n_chunks and ids (array<int>) of each document."""
    spark = docs.sparkSession
    tune(spark, 128)
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    giant = F.coalesce(F.length("text"), F.lit(0)) > DEALT * chunk
    models: dict[str, Model] = {}

    def loaded() -> Model:
        if model not in models:
            models[model] = Model(model)
        return models[model]

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = loaded()
        for b in batches:
            b["n_chunks"] = [len(spans(len(shown(t)), chunk)) if t else 0 for t in b["text"]]
            b["ids"] = [encode_text(m, t, chunk) for t in b["text"]]
            yield b

    out_schema = f"doc_id {kind}, text string, n_chunks int, ids array<int>"
    one_place = base.where(~giant).mapInPandas(small, out_schema)

    # a chunk carries so much text on either side as a piece can reach
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = 2 * loaded().longest
        for b in batches:
            for row, text in zip(b["row"], b["text"]):
                s = shown(text)
                cuts = spans(len(s), chunk)
                yield pd.DataFrame([(row, c, len(cuts), lo - max(0, lo - reach), s[max(0, lo - reach) : hi + reach], hi - lo) for c, (lo, hi) in enumerate(cuts)], columns=["row", "c", "n", "lo", "s", "len"])

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = loaded()
        for b in batches:
            got = [transfer(m, s, lo, lo + k, c == 0, c == n - 1) for c, n, lo, s, k in zip(b["c"], b["n"], b["lo"], b["s"], b["len"])]
            yield pd.DataFrame({"row": b["row"], "c": b["c"], "rows": [x.shape[0] for x in got], "open": [(x == 0).tobytes() for x in got]})

    def solved(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("c")
        ends = resolve([np.where(np.frombuffer(o, bool).reshape(r, -1), 0.0, NEG) for o, r in zip(b["open"], b["rows"])])
        return pd.DataFrame({"row": b["row"], "c": b["c"], "k": [k for k, _ in ends], "j": [j for _, j in ends]})

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = loaded()
        for b in batches:
            ids = [np.frombuffer(backtrace(m, s, lo, lo + n_, c == 0, c == n - 1, k, j), np.int32) for c, n, lo, s, n_, k, j in zip(b["c"], b["n"], b["lo"], b["s"], b["len"], b["k"], b["j"])]
            yield pd.DataFrame({"row": b["row"], "c": b["c"], "ids": ids})

    # rows are numbered once, in a written table, before they are split and put together again
    large = cut(base.where(giant).withColumn("row", F.monotonically_increasing_id()), "giants")
    chunks = large.mapInPandas(split, "row long, c int, n int, lo int, s string, len int").repartition(shuffle_parts(spark), "row", "c")
    ends = chunks.mapInPandas(matrices, "row long, c int, rows int, open binary").groupBy("row").applyInPandas(solved, "row long, c int, k int, j int")
    parts = chunks.join(ends, ["row", "c"]).mapInPandas(traced, "row long, c int, ids array<int>")
    whole = parts.groupBy("row").agg(F.count("*").cast("int").alias("n_chunks"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("ids"))
    return one_place.unionByName(large.join(whole, "row").select("doc_id", "text", "n_chunks", "ids"))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Adds the column decoded."""
    models: dict[str, Model] = {}

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        if model not in models:
            models[model] = Model(model)
        return ids.map(lambda x: decode_ids(models[model], x))

    return encoded.withColumn("decoded", decoded(ids_col))


def report(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chunks, n_pieces, ids_crc32 (ids as little-endian 32-bit), text_crc32 (of the decoded text), exact (whether that is the text)."""
    df = encode(docs, model, chunk)
    models: dict[str, Model] = {}

    @F.pandas_udf("ids_crc32 long, text_crc32 long, exact boolean")
    def digest(ids: pd.Series, text: pd.Series) -> pd.DataFrame:
        if model not in models:
            models[model] = Model(model)
        rows = []
        for i, t in zip(ids, text):
            back = decode_ids(models[model], i)
            rows.append((zlib.crc32(np.asarray(i, "<u4").tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == (t or "").replace(BLANK, " ")))
        return pd.DataFrame(rows, columns=["ids_crc32", "text_crc32", "exact"])

    return df.select("doc_id", "n_chunks", F.size("ids").cast("long").alias("n_pieces"), digest("ids", "text").alias("d")).select("doc_id", "n_chunks", "n_pieces", "d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
