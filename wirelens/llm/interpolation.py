"""Language-model scores by deleted interpolation.

A text's probability is the product over its tokens (words, A-Z lower-cased, and one end) of a mixture of
maximum-likelihood estimates: the token after its predecessor (bigram), the token alone (unigram), and
1 / (V + 1). How much the bigram counts depends on how often its context was seen, in buckets that double;
the unigram has one weight. The weights are learned by expectation-maximisation on held-out counts: each
learning document is scored with its own counts taken away from the corpus counts.

Counts are exact over all learning documents and grow with them. Text blocks ask for the counts of their
distinct words and word pairs (64-bit hashes, sorted, dealt out by key) and bring their own counts along;
tasks add up and answer, in compressed arrays. A very common word or pair is asked for once per block. Weights come from a table
of log-probabilities rounded to 1/`STEPS` of a doubling: at most `BUCKETS` x 64 * `STEPS` squared cells,
whatever the corpus, summed up by Spark.

Defined results: null texts are empty and have just the end. Without learning documents all scores are 0.
Repeated rows learn and score each. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.blocks import by_block, by_part, planes, rows_of, text_blocks, values_of
from wirelens.llm.common import text_of
from wirelens.llm.order_minhash import BASE, mix
from wirelens.session import measured_table, scratch_table

STEPS = 8
BUCKETS = 40
TASK_KEYS = 1_000_000
START, END = np.uint64(2), np.uint64(4)
LEAST_WEIGHT = 1e-6


class Tokens:
    """A block's tokens as hashes, and its distinct words (even keys) and pairs (odd keys) in order."""

    def __init__(self, data: bytes, parts: int):
        self.rows = rows_of(data)
        names: dict[bytes, int] = {}
        codes, self.lengths = [], []
        for text in self.rows.column("text").to_pylist():
            words = text.encode("utf-8", "surrogatepass").lower().split()
            self.lengths.append(len(words) + 1)
            codes += [names.setdefault(w, len(names)) for w in words]
            codes.append(-1)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
        token = np.append(hashes << np.uint64(3), END)[np.array(codes, np.int64)]
        self.lengths = np.array(self.lengths, np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first] = START
        pair = mix(before * np.uint64(BASE) + token) | np.uint64(1)
        self.n = len(token)
        self.both = np.concatenate([token, pair])
        self.keys, self.key_of = np.unique(self.both, return_inverse=True)
        self.order, self.there, self.cuts = by_part(self.keys, parts)
        self.learn = self.rows.column("learn").to_numpy()

    def of_parts(self):
        return ((int(p), self.order[a:b]) for p, a, b in zip(self.there, self.cuts, self.cuts[1:]))

    def own_counts(self) -> np.ndarray:
        """How often the learning documents of this block have each key."""
        learning = np.tile(np.repeat(self.learn, self.lengths), 2)
        return np.bincount(self.key_of[learning], minlength=len(self.keys))

    def counts(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of every token and of every pair."""
        found = np.zeros(len(self.keys), np.int64)
        for part, which in self.of_parts():
            found[which] = values_of(pa.decompress(answers[part], 8 * len(which), "zstd", asbytes=True), np.int64)
        found = found[self.key_of]
        return found[: self.n], found[self.n :]

    def in_document(self) -> tuple[np.ndarray, np.ndarray]:
        """How often its own document has every token and every pair."""
        doc = np.tile(np.repeat(np.arange(len(self.lengths), dtype=np.uint64), self.lengths), 2)
        _, at, n = np.unique(self.both ^ mix(doc + np.uint64(1)), return_inverse=True, return_counts=True)
        found = n[at]
        return found[: self.n], found[self.n :]

    def contexts(self, counts: np.ndarray, at_start: np.ndarray) -> np.ndarray:
        """Counts of the tokens before; `at_start` is what the first token of each document gets."""
        out = np.empty_like(counts)
        out[1:] = counts[:-1]
        out[self.first] = at_start
        return out


def _rounded(numerator: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    """-log2 of a ratio in steps, 0 to 64 * STEPS - 1; 64 * STEPS for a ratio of 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -np.log2(numerator / np.maximum(denominator, 1)) * STEPS
    return np.where(numerator > 0, np.clip(np.round(out), 0, 64 * STEPS - 1), 64 * STEPS).astype(np.int64)


def buckets_of(contexts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one for each doubling of their count."""
    return np.frexp(contexts.astype(np.float64))[1].clip(0, BUCKETS - 1)


@dataclass
class Weights:
    unigram: float
    bigram: np.ndarray  # by bucket
    tokens: int
    distinct: int
    documents: int

    def probabilities(self, count: np.ndarray, pair: np.ndarray, context: np.ndarray) -> np.ndarray:
        low = self.unigram * count / max(1, self.tokens) + (1 - self.unigram) / (self.distinct + 1)
        weight = self.bigram[buckets_of(context)]
        return weight * pair / np.maximum(context, 1) + (1 - weight) * low


def learned(cells: np.ndarray, tokens: int, distinct: int, documents: int, rounds: int = 100) -> Weights:
    """Weights from rows (bucket, rounded bigram, rounded unigram, n) by expectation-maximisation."""
    bigram = np.zeros(BUCKETS)
    if not tokens or not len(cells):
        return Weights(0.0, bigram, tokens, distinct, documents)

    def likely(steps: np.ndarray) -> np.ndarray:
        return np.where(steps >= 64 * STEPS, 0.0, 2.0 ** (-steps / STEPS))

    bucket, pair, single, n = cells.T
    pair, single = likely(pair), likely(single)
    unigram = 0.5
    for _ in range(rounds):
        part = unigram * single
        unigram = float(np.clip((n * part / (part + (1 - unigram) / (distinct + 1))).sum() / n.sum(), LEAST_WEIGHT, 1 - LEAST_WEIGHT))
    low = unigram * single + (1 - unigram) / (distinct + 1)
    total = np.bincount(bucket, n, BUCKETS)
    bigram[1:] = 0.5
    for _ in range(rounds):
        part = bigram[bucket] * pair
        share = n * part / (part + (1 - bigram[bucket]) * low)
        bigram = np.bincount(bucket, share, BUCKETS) / np.maximum(total, 1)
        bigram[1:] = np.clip(bigram[1:], LEAST_WEIGHT, 1 - LEAST_WEIGHT)
        bigram[0] = 0  # nothing is known about an unseen context
    for b in range(2, BUCKETS):  # buckets without held-out tokens take the weight below
        if not total[b]:
            bigram[b] = bigram[b - 1]
    return Weights(unigram, bigram, tokens, distinct, documents)


def _ask(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, counts, tokens, distinct): answers to every block; the last two once for each part."""

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                found = Tokens(data.as_py(), parts)
                own = found.own_counts()
                asked = [(p, block, planes(found.keys[w]), planes(own[w])) for p, w in found.of_parts()]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*asked), kinds)], names=["part", "block", "keys", "own"]
                )

    def add_up(table: pa.Table) -> pa.Table:
        keys = [values_of(k, np.uint64) for k in table.column("keys").to_pylist()]
        own = np.concatenate([values_of(c, np.int64) for c in table.column("own").to_pylist()])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, own, len(distinct)).astype(np.int64)
        words = distinct & np.uint64(1) == 0
        n = table.num_rows
        return pa.table(
            {
                "block": table.column("block"),
                "part": table.column("part"),
                "counts": pa.array(
                    [
                        pa.compress(planes(c), "zstd", asbytes=True)
                        for c in np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
                    ],
                    pa.binary(),
                ),
                "tokens": pa.array([int(total[words].sum())] + [0] * (n - 1)),
                "distinct": pa.array([int((total[words] > 0).sum())] + [0] * (n - 1)),
            }
        )

    asked = blocks.mapInArrow(run, "part int, block long, keys binary, own binary")
    return asked.groupBy("part").applyInArrow(add_up, "block long, part int, counts binary, tokens long, distinct long")


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Scores are log10 probabilities; `base_score` is that of the add-one unigram model. `learn` says which
    documents the models learn from (null: not).
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks, total = text_blocks(rows)
    parts = max(16, total // 5 // TASK_KEYS)
    answers, seen = measured_table(_ask(blocks, parts), "ngram-counts", tokens=F.sum("tokens"), distinct=F.sum("distinct"))
    tokens, distinct = seen["tokens"] or 0, seen["distinct"] or 0
    if not total and not blocks.head():
        return docs.sparkSession.createDataFrame([], _SCORES)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dict(zip(right.column("part").to_pylist(), right.column("counts").to_pylist()))
        out = []
        for data in left.column("data").to_pylist():
            block = Tokens(data, parts)
            count, pair = block.counts(found)
            documents = int(count[block.first[0] + block.lengths[0] - 1])  # every document has one end
            cells = _held_out(block, count, pair, documents, tokens)
            out.append(
                pa.table(
                    {
                        "doc_ids": pa.array([block.rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        "learn": pa.array([block.learn.tolist()], pa.list_(pa.bool_())),
                        "lengths": pa.array([block.lengths]),
                        "counts": pa.array([pa.compress(planes(count), "zstd", asbytes=True)], pa.binary()),
                        "pairs": pa.array([pa.compress(planes(pair), "zstd", asbytes=True)], pa.binary()),
                        "documents": pa.array([documents]),
                        "cells": pa.array([cells.ravel()]),
                    }
                )
            )
        return pa.concat_tables(out)

    known = scratch_table(
        by_block(blocks, answers.select("block", "part", "counts")).applyInArrow(
            look_up,
            "doc_ids array<long>, learn array<boolean>, lengths array<long>, counts binary, pairs binary, documents long, cells array<long>",
        ),
        "ngram-known",
    )

    def split(batches):
        for batch in batches:
            cells = batch.column("cells").flatten().to_numpy().reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells.T], names=["bucket", "pair", "single", "n"])

    table = (
        known.select("cells")
        .mapInArrow(split, "bucket long, pair long, single long, n long")
        .groupBy("bucket", "pair", "single")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    cells = np.stack([table.column(c).to_numpy() for c in ("bucket", "pair", "single", "n")], axis=1)
    documents = known.agg(F.max("documents")).head()[0] or 0
    weights = learned(cells, tokens, distinct, documents)

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _scored(row, weights)

    return known.drop("cells").mapInArrow(finish, _SCORES)


_SCORES = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _held_out(block: Tokens, count: np.ndarray, pair: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """Rows (bucket, rounded bigram, rounded unigram, n) of learning tokens, each without its document."""
    own_count, own_pair = block.in_document()
    context = block.contexts(count - own_count, np.full(len(block.lengths), documents - 1))
    learning = np.repeat(block.learn, block.lengths)
    rest = np.repeat(tokens - block.lengths, block.lengths)
    single = _rounded(count - own_count, rest)[learning]
    double = _rounded(pair - own_pair, context)[learning]
    bucket = buckets_of(context)[learning].astype(np.int64)
    width = 64 * STEPS + 1
    cell, n = np.unique((bucket * width + double) * width + single, return_counts=True)
    return np.stack([cell // width // width, cell // width % width, cell % width, n], axis=1)


def _scored(row: dict, weights: Weights) -> pa.RecordBatch:
    lengths = np.array(row["lengths"], np.int64)
    n = int(lengths.sum())
    count, pair = (
        values_of(pa.decompress(row[c], 8 * n, "zstd", asbytes=True), np.int64) for c in ("counts", "pairs")
    )
    first = np.cumsum(lengths) - lengths
    context = np.empty_like(count)
    context[1:] = count[:-1]
    context[first] = weights.documents
    base = np.log10((count + 1) / (weights.tokens + weights.distinct + 1))
    model = np.log10(weights.probabilities(count, pair, context))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["doc_ids"], pa.int64()),
            pa.array(row["learn"], pa.bool_()),
            pa.array(lengths),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
            pa.array(np.full(len(lengths), weights.tokens, np.int64)),
            pa.array(np.add.reduceat(base, first)),
            pa.array(np.add.reduceat(model, first)),
        ],
        names=["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
