"""Token ids as flat binary files with 64-bit document offsets.

A token folder holds, for each part: ``part-N.bin`` (the ids, little-endian uint16 or uint32), ``part-N.idx``
(uint64 offsets into it, one more than documents) and ``part-N.ids`` (int64 document ids), and a Parquet
manifest with each part's base: the ids in all parts before it. Parts and documents are in ascending doc_id
order. Files are written under another name and renamed, so that a repeated task leaves the same whole file.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _slices, map_batches, restore_batches

END_ID = 2
CACHED_WORDS = 250_000

# Characters whose normal form and lower case do not depend on their neighbours.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+")  # one piece
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ſß]+|[0-9]|[^a-zà-öø-ſß0-9]+")


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep = make, keep

    def __missing__(self, key):
        if len(self) >= self.keep:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """The tokenizer's ids of whole texts, as packed integers.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in turn;
    frequent words are looked up. Words of plain characters go to the BPE model piece by piece, all others
    through the tokenizer's own normaliser. Equal to encoding the whole text; tests hold it to that.
    """

    def __init__(self, path: str, keep: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letter = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = byte_letters()
        self.pieces = _Cache(self._piece, keep)
        self.words = _Cache(self._word, keep)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return self.pack([t.id for t in self.model.tokenize(spelled)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode(errors="replace")
        body, mark = (text[:-1], text[-1]) if text[-1] in ".,;:!?" else (text, "")
        if LETTERS.fullmatch(body):
            return self.pieces[body.lower()] + self.pieces[mark] if mark else self.pieces[body.lower()]
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process: later tasks find its words known."""
    return Encoder(path)


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str, bool]:
    """The file system of a folder, the folder's path there, and whether the machine can map its files."""
    parsed = urlparse(folder)
    if parsed.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), parsed.path, True
    return *pyarrow.fs.FileSystem.from_uri(folder), False


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id``, write the files; returns the manifest.

    Ascending doc_id, null ids first, equal ids by text. ``folder`` must be one that every executor reaches.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encode, part = None, context.partitionId()
        fs, base, _ = _open(folder)
        names = [f"{base}/part-{part:06d}.{kind}" for kind in ("bin", "idx", "ids")]
        drafts = [f"{n}.{context.taskAttemptId()}" for n in names]
        tokens = nulls = docs_here = 0
        files = []
        for batch in batches:
            for ids, texts in _slices(batch):
                if encode is None:
                    encode = encoder(tokenizer)
                    fs.create_dir(base)
                    files = [fs.open_output_stream(d) for d in drafts]
                    end = encode.pack([end_id])
                    files[1].write(np.zeros(1, "<u8").tobytes())
                parts = [encode(t) + end for t in texts]
                files[0].write(b"".join(parts))
                ends = tokens + np.cumsum([len(p) // encode.dtype.itemsize for p in parts])
                files[1].write(ends.astype("<u8").tobytes())
                files[2].write(np.array([0 if i is None else i for i in ids], "<i8").tobytes())
                tokens, docs_here, nulls = int(ends[-1]), docs_here + len(ids), nulls + ids.count(None)
        for file, draft, name in zip(files, drafts, names, strict=False):
            file.close()
            fs.move(draft, name)
        if files:
            yield pa.RecordBatch.from_pydict({
                "part": [part], "docs": [docs_here], "null_ids": [nulls], "tokens": [tokens], "width": [encode.dtype.itemsize]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    parts = map_batches(ordered, run, "part long, docs long, null_ids long, tokens long, width long")
    parts.write.parquet(f"{folder}/parts")
    restore_batches(spark)
    written = spark.read.parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_part(folder: str, part: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's ids, offsets and document ids; memory-mapped where the machine can map the folder's files."""
    fs, base, mapped = _open(folder)
    out = []
    for kind, dtype in (("bin", f"<u{width}"), ("idx", "<u8"), ("ids", "<i8")):
        name = f"{base}/part-{part:06d}.{kind}"
        out.append(np.memmap(name, dtype, "r") if mapped else np.frombuffer(fs.open_input_file(name).read(), dtype))
    return tuple(out)


def read_tokens(spark: SparkSession, folder: str, rows: int = 4096) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    n_parts = max(1, manifest.count())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame.itertuples():
                ids, ends, doc_ids = read_part(folder, p.part, p.width)
                for at in range(0, p.docs, rows):
                    edges = ends[at:min(at + rows, p.docs) + 1].astype(np.int64)
                    n = len(edges) - 1
                    yield pd.DataFrame({
                        "doc_id": pd.array(doc_ids[at:at + n], "Int64").copy() if at >= p.null_ids else pd.array(
                            [None if at + j < p.null_ids else int(doc_ids[at + j]) for j in range(n)], "Int64"),
                        "start": p.base + edges[:-1], "n_tokens": np.diff(edges),
                        "ids_crc32": [zlib.crc32(ids[edges[j]:edges[j + 1]].astype("<u4").tobytes()) for j in range(n)],
                    })

    return manifest.repartitionByRange(n_parts, "part").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
