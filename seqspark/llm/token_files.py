"""Token ids in Arrow files of fixed-size-list batches, and reading them back.

Documents are dealt by ranges of doc_id, and each task encodes its range in order and writes Arrow IPC files, a new one
after ``FILE_TOKENS`` tokens (at the end of a document): the ids as one stream, cut into sequences of equal length (``fixed_size_list``), with a mask of the same shape that
is false over the padding of the last sequence. A second small file holds doc_id, start and n_tokens. Ids are
uint16 where the vocabulary allows it. Files are uncompressed: a reader maps them and takes any sequence without
copying. A file is written under a name of its own attempt and then renamed, so that a repeated task leaves one
whole file. Reading goes batch by batch: a reader holds one batch and one document, whatever a file's size.

Encoding is by the tokenizers library. Its pre-tokenizer always starts a piece at a blank that a visible
character follows, so texts are cut there, and each distinct part is encoded once per worker (a bounded cache).

Edge cases: null and empty texts have the end id only; null doc_ids come first; equal doc_ids are ordered by text
hash; an empty table gives no documents; other input columns are ignored. Very long texts stay whole.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, shuffle_parts, table, tune

LENGTH, ROWS, END = 2048, 256, 2
FILE_TOKENS = 1 << 26
CACHE = 500_000
SIGNS = ".,;:!?"
VISIBLE = re.compile(r"[!-~\w]")
#: A blank that a letter, digit or ASCII sign follows: always the start of a piece.
PART = re.compile(r" (?=[!-~\w])")


class Encoder:
    """Text to ids by a tokenizer file, as little-endian bytes of ``kind``.

    A part of a text is one word, or a word with signs behind it, or words with a line end between them; each of
    these pieces is encoded once and kept. What is none of these goes to the tokenizer as it stands.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.kind, self.parts, self.pieces = Tokenizer.from_file(path), kind, {}, {}
        self.special = [t["content"] for t in json.loads(self.tok.to_str()).get("added_tokens", [])]
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {bytes([c]).decode("latin-1"): byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(128)}
        rest = [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in range(128, 0x800)]
        for c, two in zip(range(128, 0x800), rest):
            shown |= {bytes([x]).decode("latin-1"): y for x, y in zip(chr(c).encode(), two)}
        self.shown, self.line_end = str.maketrans(shown), self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def piece(self, text: str) -> bytes:
        """Of a text that the pre-tokenizer leaves in one piece."""
        got = self.pieces.get(text)
        if got is None:
            if text.isascii():
                shown = "\u0120" + text[1:] if text[0] == " " else text
            else:
                shown = text.encode("utf-8").decode("latin-1").translate(self.shown)
            got = self.pieces[text] = np.array([t.id for t in self.tok.model.tokenize(shown)], self.kind).tobytes()
        return got

    def part(self, p: str, lead: str) -> bytes:
        if p.isalpha():
            return self.piece(lead + p)
        core = p.rstrip(SIGNS)
        if core.isalpha():
            return self.piece(lead + core) + self.piece(p[len(core) :])
        head, line_end, rest = p.partition("\n")
        if line_end and VISIBLE.match(rest) and VISIBLE.match(head[-1:]):
            return self.part(head, lead) + self.line_end + self.part(rest, "")
        return self.whole(lead + p)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = PART.split(text)
        parts = self.parts
        if len(parts) > CACHE:
            parts.clear()
        if len(self.pieces) > 2 * CACHE:
            self.pieces.clear()
        for w in rest:
            if w not in parts:
                parts[w] = self.part(w, " ")
        return (self.part(first, "") if first else b"") + b"".join(map(parts.__getitem__, rest))


def file_system(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Writer:
    """One file of ids and the file of its documents."""

    def __init__(self, folder: str, name: str, kind: str, length: int, rows: int):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.final, self.own = f"{folder}/{name}", f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}"
        self.kind, self.length, self.rows, self.held, self.count = kind, length, rows, [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(kind)), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.own + ".ids")
        self.ipc = pa.ipc.new_file(self.out, self.schema)
        self.docs: list[tuple] = []
        self.total = 0

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // np.dtype(self.kind).itemsize
        self.docs.append((doc_id, self.total, n))
        self.total += n
        self.held.append(ids)
        self.count += n
        if self.count >= self.length * self.rows:
            self.flush(False)

    def flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.held), self.kind)
        full = len(data) // self.length
        while full >= self.rows or last and len(data):
            k = min(self.rows, -(-len(data) // self.length))
            take = min(len(data), k * self.length)
            ids = np.zeros(k * self.length, self.kind)
            ids[:take] = data[:take]
            mask = np.arange(k * self.length) < take
            self.ipc.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
            data = data[take:]
            full = len(data) // self.length
        self.held, self.count = [data.tobytes()], len(data)

    def close(self) -> None:
        self.flush(True)
        self.ipc.close()
        self.out.close()
        index = pd.DataFrame(self.docs, columns=["doc_id", "start", "n_tokens"])
        with self.fs.open_output_stream(self.own + ".docs") as out:
            t = pa.table({"doc_id": pa.array(index["doc_id"].astype("Int64")), "start": pa.array(index["start"], pa.int64()), "n_tokens": pa.array(index["n_tokens"], pa.int64())})
            with pa.ipc.new_file(out, t.schema) as ipc:
                ipc.write_table(t)
        for kind in (".ids", ".docs"):
            self.fs.move(self.own + kind, self.final + kind)


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END, length: int = LENGTH, rows: int = ROWS, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files; returns one row per file: part, number in the part, path, tokens before it, its tokens. Runs at once."""
    spark = docs.sparkSession
    tune(spark, 64)
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shuffle_parts(spark), "doc_id", F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, encoder, writer, k = TaskContext.get().partitionId(), Encoder(tokenizer, kind), None, 0
        stop = np.array([end], kind).tobytes()

        def closed() -> pd.DataFrame:
            writer.close()
            return pd.DataFrame({"part": [part], "k": [k], "path": [writer.path], "tokens": [writer.total]})

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                writer = writer or Writer(folder, f"part-{part:06d}-{k:05d}", kind, length, rows)
                writer.add(None if pd.isna(doc_id) else int(doc_id), encoder.encode(text) + stop)
                if writer.total >= file_tokens:
                    yield closed()
                    writer, k = None, k + 1
        if writer is not None:
            yield closed()

    files = cut(ordered.mapInPandas(run, "part int, k int, path string, tokens long"), "files")
    rows_ = sorted((r["part"], r["k"], r["path"], r["tokens"]) for r in files.collect())  # one row per file
    before, table_ = 0, []
    for part, k, path, n in rows_:
        table_.append((part, k, path, before, n))
        before += n
    return spark.createDataFrame(table_, "part int, k int, path string, before long, tokens long")


def opened(path: str):
    fs, name = file_system(path)
    return pa.ipc.open_file(pa.memory_map(name + ".ids") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name + ".ids"))


def index(path: str) -> pa.Table:
    """doc_id, start and n_tokens of a file's documents."""
    fs, name = file_system(path)
    return pa.ipc.open_file(fs.open_input_file(name + ".docs")).read_all()


def stream(path: str) -> Iterator[np.ndarray]:
    """The ids of a file without padding, batch by batch."""
    ipc = opened(path)
    for i in range(ipc.num_record_batches):
        b = ipc.get_batch(i)
        ids, valid = b.column(0).flatten().to_numpy(), b.column(1).flatten()
        yield ids if valid.true_count == len(ids) else ids[valid.to_numpy(zero_copy_only=False)]


def read(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of a file's documents in order; one batch and one document are held."""
    batches, at, here = stream(path), 0, np.empty(0, np.uint16)
    docs = index(path)
    for doc_id, start, n in zip(docs["doc_id"].to_pylist(), docs["start"].to_pylist(), docs["n_tokens"].to_pylist()):
        parts, left = [], n
        while left:
            if at == len(here):
                here, at = next(batches), 0
            parts.append(here[at : at + left])
            left -= len(parts[-1])
            at += len(parts[-1])
        yield doc_id, start, parts[0] if len(parts) == 1 else np.concatenate(parts)


def sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th sequence of a file and its mask; only its pages are touched."""
    ipc = opened(path)
    rows = ipc.get_batch(0).num_rows
    b = ipc.get_batch(k // rows)
    return b.column(0)[k % rows].values.to_numpy(), b.column(1)[k % rows].values.to_numpy(zero_copy_only=False)


def report(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    spread = files.repartition(shuffle_parts(spark), "part", "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for path, before in zip(b["path"], b["before"]):
                rows = []
                for doc_id, start, ids in read(path):
                    rows.append((doc_id, start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})

    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return report(write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "tokens")))
