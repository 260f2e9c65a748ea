"""Token ids in binary files, packed with word-aligned Simple-8b coding.

`write_token_files` orders documents by id over the cluster; each task encodes its range and writes
files that end with the document that fills `file_ids` ids to the shared folder. `read_token_files` reads them back.

A file holds its documents' ids and lengths, then blocks of `BLOCK` ids. A block is a run of 64-bit
words: 4 bits of selector and 60 bits of ids, 1 to 60 to a word. Selector 1 is a run of 120 zeros. An id
of 60 bits or more is escaped: selector 0, and the payload is its place among the file's raw 64-bit
escapes. The offsets of every block's words are stored, so that blocks decode on their own, and all
words of one selector decode in one numpy operation.

Null texts count as empty (only the end id is written); a null document id comes first and is kept.
Repeated rows are all written; rows of one id, or without one, are dealt out by their text. An empty table gives no files and no rows.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelens.llm.common import PieceCoder, chunks, per_worker, text_of
from wirelens.llm.pieces import RARE, ByteSplitter, byte_letters, load
from wirelens.session import broadcast_table, measured_table, scratch_folder

# Ids per word and bits per id of selectors 2 to 15.
LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([1, 120, *(n for n, _ in LAYOUTS)], np.int64)
ESCAPE, ZEROS = 0, 1
MAGIC = b"SIMPLE8B"
BLOCK = 1 << 17
FILE_IDS = 2_000_000
#: The letter that stands for a space.
SPACE = byte_letters()[ord(" ")]


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For every place, the selector that packs most ids from there on; a last word may be padded."""
    n = len(ids)
    chosen = np.full(n, 15, np.uint8)
    top = int(ids.max()) if n else 0
    if top >> 60:
        chosen[ids >> np.uint64(60) > 0] = ESCAPE
    ids = ids.astype(np.uint32) if top < 1 << 32 else ids
    fits = np.ones(n, bool)
    narrow = np.ones(n + 120, bool)  # ids behind the end are zeros
    # What fits a layout also fits the ones before, with fewer and wider ids.
    for selector in range(14, ZEROS - 1, -1):
        count, bits = (120, 0) if selector == ZEROS else LAYOUTS[selector - 2]
        if top >> bits:
            np.less(ids, ids.dtype.type(1 << bits), out=narrow[:n])
            for k in range(count):
                fits &= narrow[k : k + n]
            if not fits.any():
                break
        chosen[fits] = selector
    return chosen


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped ids of one block."""
    ids = ids.astype(np.uint64, copy=False)
    n = len(ids)
    chosen = _selectors(ids)
    steps = COUNTS.astype(np.uint8)[chosen].tobytes()
    heads, at = [], 0
    while at < n:
        heads.append(at)
        at += steps[at]
    heads = np.array(heads, np.int64)
    chosen = chosen[heads]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(120, np.uint64)])
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
        elif selector != ZEROS:
            count, bits = LAYOUTS[selector - 2]
            for k in range(count):
                words[mine] |= padded[heads[mine] + k] << np.uint64(bits * k)
    return words, ids[heads[chosen == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The `n` ids of one block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    heads = ends - COUNTS[selectors]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            out[heads[mine]] = escapes[payload[mine].astype(np.int64)]
        elif selector != ZEROS:
            count, bits = LAYOUTS[selector - 2]
            low = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[heads[mine] + k] = payload[mine] >> np.uint64(bits * k) & low
    return out[:n]


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: documents, their lengths, and their ids one after the other."""
    packed = [pack(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    words = np.concatenate([w for w, _ in packed] or [np.zeros(0, np.uint64)])
    escapes = np.concatenate([e for _, e in packed] or [np.zeros(0, np.uint64)])
    offsets = np.cumsum([[0, 0], *([len(w), len(e)] for w, e in packed)], axis=0, dtype=np.int64)
    head = np.array([len(doc_ids), len(ids), len(packed), len(words), len(escapes)], np.int64)
    parts = [
        head,
        np.array([d or 0 for d in doc_ids], np.int64),
        np.array([d is None for d in doc_ids], np.int64),
        np.asarray(lengths, np.int64),
        offsets,
        words,
        escapes,
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def parse_file(content: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, lengths, ids) of a file, in pieces of whole documents of about a block."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of packed token ids")
    at = 8

    def take(n: int, kind=np.int64) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += 8 * n
        return out

    n_docs, n_ids, n_blocks, n_words, n_escapes = take(5).tolist()
    docs, missing, lengths = take(n_docs), take(n_docs), take(n_docs)
    offsets = take(2 * (n_blocks + 1)).reshape(-1, 2)
    words, escapes = take(n_words, np.uint64), take(n_escapes, np.uint64)
    names = [None if m else d for d, m in zip(docs.tolist(), missing.tolist())]
    ends = np.cumsum(lengths)
    held, first, have = [], 0, 0
    for k in range(n_blocks):
        (w0, e0), (w1, e1) = offsets[k], offsets[k + 1]
        held.append(unpack(words[w0:w1], escapes[e0:e1], min(BLOCK, n_ids - k * BLOCK)))
        have = min((k + 1) * BLOCK, n_ids)
        last = int(np.searchsorted(ends, have, side="right"))
        if last > first:
            ids = np.concatenate(held)
            used = int(lengths[first:last].sum())
            yield names[first:last], lengths[first:last], ids[:used]
            held, first = [ids[used:]], last
    if first < n_docs:
        yield names[first:], lengths[first:], np.zeros(0, np.uint64)


class _Words:
    """Ids of words from the tokenizers library, piece by piece; words share their pieces."""

    def __init__(self, splitter: ByteSplitter, limit: int = 350_000):
        self.splitter = splitter
        self.tokenize = splitter.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = PieceCoder(lambda pieces: list(map(self.piece, pieces)), self.pieces_of, limit=limit)

    def pieces_of(self, word: str) -> list[str]:
        if word.isalpha() and (word.isascii() or not RARE.search(word)):
            return [" " + word]
        return self.splitter.pieces_of(word) or []

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = self.pieces.encode(words)
        for i in np.flatnonzero(lengths == 0):
            lengths[i] = 0 if self.splitter.pieces_of(words[i]) == [] else -1
        return ids, lengths

    def piece(self, piece: str) -> list[int]:
        if piece in self.splitter.special:
            return [self.splitter.special[piece]]
        if piece.isascii() and piece[1:].isalnum():
            spelled = SPACE + piece[1:] if piece[0] == " " else piece.translate(self.letters)
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.tokenize(spelled)]


def _coder(tokenizer: str) -> PieceCoder:
    splitter = ByteSplitter(load(tokenizer))
    return PieceCoder(_Words(splitter).ids, split=splitter.whole, mark=splitter.mark)


def _store(folder: str):
    """The file system of a folder, and the folder's path in it."""
    if "://" not in folder and not folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), folder
    return pa.fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    folder: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    file_ids: int = FILE_IDS,
) -> tuple[str, DataFrame, int]:
    """Encode documents, write their files in ascending order of document ids.

    Gives the folder, the list of its files (file, part, seq, n_docs, n_ids) as a table, and their number.
    A task that is run again writes files of new names; only the files in the list count.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"

    def write(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        gc.disable()  # millions of remembered pieces and no cycles
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        coder = per_worker("byte ids", (tokenizer,), lambda: _coder(tokenizer))
        names, lengths, ids, held = [], [], [], 0

        def flush():
            nonlocal seq, held
            file = f"{part:07d}-{seq:05d}-{uuid.uuid4().hex}.s8b"
            content = file_bytes(names, np.concatenate(lengths), np.concatenate(ids))
            with store.open_output_stream(f"{root}/{file}") as out:
                out.write(content)
            row = {"file": [file], "part": [part], "seq": [seq], "n_docs": [len(names)], "n_ids": [held]}
            seq, held = seq + 1, 0
            names.clear(), lengths.clear(), ids.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch, texts in chunks(batches):
            found, counts = coder.encode(texts)
            found = np.insert(found, np.cumsum(counts), end_id)
            docs, sizes, done = batch.column("doc_id").to_pylist(), counts + 1, np.cumsum(counts + 1)
            first = 0
            while first < len(docs):  # whole documents, until a file is full
                before = int(done[first - 1]) if first else 0
                last = min(len(docs), int(np.searchsorted(done, before + file_ids - held)) + 1)
                lengths.append(sizes[first:last])
                ids.append(found[before : done[last - 1]])
                names += docs[first:last]
                held += len(ids[-1])
                first = last
                if held >= file_ids:
                    yield flush()
        if names:
            yield flush()

    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
        .withColumn("spread", F.xxhash64("text"))
        .repartitionByRange("doc_id", "spread")
        .sortWithinPartitions("doc_id", "spread")
        .drop("spread")
    )
    files = ordered.mapInArrow(write, "file string, part long, seq long, n_docs long, n_ids long")
    table, seen = measured_table(files, "token-files")
    return folder, table, seen["n"]


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, n_files: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    `start` is the number of ids in front of the document in all files. The running total over files is
    a window over one row per file.
    """
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not n_files:
        return spark.createDataFrame([], schema)
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("file", F.coalesce(before, F.lit(0)).alias("offset"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    rows = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(
        broadcast_table(placed, n_files), "file"
    )

    def parse(batches):
        for batch in batches:
            for offset, content in zip(batch.column("offset").to_pylist(), batch.column("content")):
                at = offset
                for names, lengths, ids in parse_file(content.as_buffer().to_pybytes()):
                    ends = np.cumsum(lengths)
                    raw = pa.py_buffer(ids.astype("<u4").tobytes())
                    cuts = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names, pa.int64()),
                            pa.array(at + ends - lengths),
                            pa.array(lengths),
                            pa.Array.from_buffers(pa.binary(), len(names), [None, cuts, raw]),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    at += int(lengths.sum())

    return rows.select("offset", "content").mapInArrow(parse, schema)
