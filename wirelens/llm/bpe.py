"""BPE encoding with a lexicon of frequent words, and decoding.

`frequent_words` counts all words of all documents. `build_lexicon` merges the most frequent of them
once, compiles the automaton and hands it to the executors as a file; workers map it into memory. Words
outside the lexicon are merged exactly, by the file's merge ranks. Results don't depend on the lexicon.

Null texts count as empty (no ids, empty decoded text). Repeated rows are each encoded; an empty table
gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import tempfile
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm.common import PieceCoder, chunks, per_worker, text_of
from wirelens.llm.lexicon import Lexicon, compile_lexicon
from wirelens.llm.pieces import WordSplitter, byte_letters, load
from wirelens.session import scratch_table

#: The lexicon has at most so many words, of at most so many bytes.
LEXICON_WORDS = 131_072
LEXICON_BYTES = 64
CLASSES = 64
#: Distinct words that a counting task holds before it hands them on.
COUNTED_WORDS = 400_000
WORD_END = "</w>"


class Merges:
    """Exact merging of one word: always the pair of lowest rank, and of equal ones the leftmost."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + WORD_END] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}

    def ids(self, word: str) -> list[int]:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self._short(symbols) if len(symbols) <= 40 else self._long(symbols)

    def _short(self, symbols: list[int]) -> list[int]:
        rank = self.rank.get
        while len(symbols) > 1:
            found = [(r[0], i, r[1]) for i, r in enumerate(map(rank, zip(symbols, symbols[1:]))) if r]
            if not found:
                break
            _, at, made = min(found)
            symbols[at : at + 2] = [made]
        return symbols

    def _long(self, symbols: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        heap = []

        def push(at: int) -> None:
            if at >= 0 and after[at] >= 0:
                pair = symbols[at], symbols[after[at]]
                if pair in self.rank:
                    heapq.heappush(heap, (self.rank[pair][0], at, pair))

        for i in range(n - 1):
            push(i)
        while heap:
            _, at, pair = heapq.heappop(heap)
            right = after[at]
            if not alive[at] or right < 0 or (symbols[at], symbols[right]) != pair:
                continue
            symbols[at] = self.rank[pair][1]
            alive[right] = False
            after[at] = after[right]
            if after[right] >= 0:
                before[after[right]] = at
            push(before[at])
            push(at)
        return [s for s, here in zip(symbols, alive) if here]


def frequent_words(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(word, n) over all documents; tasks add up their own counts first."""

    def count(batches):
        splitter = per_worker("splitter", (tokenizer,), lambda: WordSplitter(load(tokenizer)))
        gc.disable()  # many words and no cycles
        held: Counter = Counter()

        def rows():
            words: Counter = Counter()
            for between, n in held.items():  # each text between two spaces is split once
                for word in splitter.split(between):
                    words[word] += n
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words.keys()), pa.string()), pa.array(list(words.values()), pa.int64())],
                names=["word", "n"],
            )

        for _, texts in chunks(batches):
            for t in texts:
                held.update(t.split(" "))
            if len(held) > COUNTED_WORDS:
                yield rows()
        if held:
            yield rows()

    counted = docs.select(text_of(text).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(words: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words and ship the file; gives its name among Spark's files.

    Words are taken by classes of frequency, `CLASSES` for each doubling of the count, the highest first,
    as long as the class fits into `size` words; only these words come to the driver.
    """
    spark = words.sparkSession
    level = F.floor(F.log2("n") * CLASSES).cast("int")
    words = scratch_table(words.where(F.octet_length("word") <= LEXICON_BYTES).withColumn("level", level), "words")
    least, have = None, 0
    for row in words.groupBy("level").count().orderBy(F.desc("level")).collect():
        have += row["count"]
        if have > size:
            break
        least = row["level"]
    rows = words.where(F.lit(False) if least is None else F.col("level") >= least)
    found = load(tokenizer)
    special = {t.content for t in found.get_added_tokens_decoder().values()}
    merges = Merges(tokenizer)
    content = compile_lexicon({w: merges.ids(w) for (w,) in rows.select("word").collect() if w not in special})
    return ship(spark, content.tobytes(), "lexicon")


def ship(spark: SparkSession, content: bytes, kind: str) -> str:
    """Hand a small file to all executors, present and future."""
    name = f"{kind}-{hashlib.sha256(content).hexdigest()[:24]}.bin"
    if (spark.sparkContext.applicationId, name) in _shipped:
        return name
    path = os.path.join(tempfile.mkdtemp(prefix="wirelens-"), name)
    with open(path, "wb") as file:
        file.write(content)
    spark.sparkContext.addFile(path)
    _shipped.add((spark.sparkContext.applicationId, name))
    return name


_shipped: set[tuple[str, str]] = set()


def _coder(tokenizer: str, lexicon: str | None) -> PieceCoder:
    splitter = WordSplitter(load(tokenizer))
    merges = Merges(tokenizer)
    known = Lexicon(SparkFiles.get(lexicon)) if lexicon else None

    def resolve(words):
        """Ids of what stands between spaces; its pieces are looked up all at once."""
        pieces = [splitter.split(w) for w in words]
        distinct = list(dict.fromkeys(chain.from_iterable(pieces)))
        ranks = known.ranks(distinct).tolist() if known else [-1] * len(distinct)
        ids = {
            p: [splitter.special[p]] if p in splitter.special else known.ids_of(r) if r >= 0 else merges.ids(p)
            for p, r in zip(distinct, ranks)
        }
        return [[i for p in one for i in ids[p]] for one in pieces]

    return PieceCoder(resolve)


class _Decoder:
    """Texts of id lists: the tokens' strings, joined by spaces, as a file without a decoder asks."""

    def __init__(self, tokenizer: str):
        found = load(tokenizer)
        names = [found.id_to_token(i) for i in range(found.get_vocab_size())]
        self.tokens = pa.array(names, pa.string())

    def texts(self, ids: pa.Array, cuts: np.ndarray) -> pa.Array:
        tokens = pc.take(self.tokens, ids)
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), tokens)
        return pc.binary_join(lists, " ")


def _id_lists(ids: np.ndarray, counts: np.ndarray) -> tuple[pa.ListArray, pa.Array, np.ndarray]:
    cuts = np.concatenate([[0], np.cumsum(counts)])
    flat = pa.array(ids.astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat), flat, cuts


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every document."""

    def run(batches):
        coder = per_worker("word ids", (tokenizer, lexicon), lambda: _coder(tokenizer, lexicon))
        for batch, texts in chunks(batches):
            lists, _, _ = _id_lists(*coder.encode(texts))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=[key, "ids"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every list of ids; null lists and null ids count as absent."""

    def run(batches):
        decoder = per_worker("decoder", (tokenizer,), lambda: _Decoder(tokenizer))
        for batch in batches:
            lists = batch.column("ids")
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            texts = decoder.texts(pc.list_flatten(lists), cuts)
            yield pa.RecordBatch.from_arrays([batch.column("key"), texts], names=[key, "text"])

    whole = F.array_compact(F.coalesce(F.col(ids), F.array().cast("array<int>")))
    return rows.select(F.col(key).cast("long").alias("key"), whole.alias("ids")).mapInArrow(run, f"`{key}` long, text string")


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): `encode` and `decode` in one pass over the texts."""

    def run(batches):
        coder = per_worker("word ids", (tokenizer, lexicon), lambda: _coder(tokenizer, lexicon))
        decoder = per_worker("decoder", (tokenizer,), lambda: _Decoder(tokenizer))
        for batch, texts in chunks(batches):
            lists, flat, cuts = _id_lists(*coder.encode(texts))
            decoded = decoder.texts(flat, cuts)
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists, decoded], names=[key, "ids", "decoded"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, ids array<int>, decoded string")
