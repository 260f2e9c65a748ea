"""Toxicity by a weighted lexicon that is learned from labels and matched by Aho-Corasick.

Texts are folded first: compatibility forms, letters of other scripts that look like Latin ones, digits and
marks that stand for letters, and characters without width. What isn't a letter separates words. A folded text
is ` one two three `, so an entry ` stupid ` is a whole word and ` stup` is the beginning of words.

The lexicon holds words and beginnings that come in toxic documents much more often than in others; an entry's
weight is the lower bound of its log-odds. Entries that say no more than a beginning of theirs are left out. An
exception is a word, or two words in a row, that holds an entry but is at home in documents that aren't toxic;
what lies inside one doesn't count. Of all entries in one word the heaviest counts. The sum over a text,
absolute and per word, the heaviest entry and the number of hits go into a logistic model for the score, which is
fitted on labelled documents that the lexicon hasn't seen.

Lexicon and model come from about `SAMPLE_ROWS` labelled documents, those of smallest hash. All documents are
scored, as whole texts, in their task's stream without a shuffle.

Accents count, since they tell words of many languages apart. A word with accents is also read without them,
against entries that are whole words of five or more Latin letters, so that accents don't hide these.

Defined results: null and empty texts have no words and get the model's score for no hits. Several labels of a
document count as their mean, 1/2 as toxic; null labels and ids are left out. Without labels of both kinds the
score is 0. Repeated rows are each scored; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import chunks, per_worker, sampled, text_of
from wirelens.session import broadcast_table, measured_table, scratch_table

SAMPLE_ROWS = 20_000
#: Of the sample, one part in so many fits the model on top; the others the lexicon.
MODEL_PART = 3
#: Beginnings of words that can be entries, in letters.
SHORTEST, LONGEST = 3, 8
#: Documents that must have an entry or an exception, the least weight, and how many standard errors lower it.
LEAST_DOCS, LEAST_WEIGHT, ERRORS = 5, 1.5, 1.5
LEXICON_ENTRIES = 50_000
#: Letters of words that are also read without accents.
LEAST_BARE = 5
THRESHOLD = 0.7

# Letters that look like Latin ones, and digits and marks that stand for letters.
LOOK_ALIKES = dict(zip("авекмнорстухіјѕԁһԛԝɑɡıαβεικνορτυχ", "abekmhopctyxijsdhqwagiabeikvoptux"))
DIGITS = dict(zip("0134578", "oieastb"))
MARKS = {"!": "i", "@": "a", "$": "s"}
NO_WIDTH = "­​‌‍⁠﻿"

_MARKS = re.compile(r"[!@$](?=\w)")


class Fold(dict):
    """What each character becomes: a letter, nothing, or a space."""

    def __missing__(self, point: int) -> str:
        letter = chr(point)
        if letter in DIGITS:
            out = DIGITS[letter]
        elif letter in NO_WIDTH:
            out = ""
        else:
            out = "".join(c for c in unicodedata.normalize("NFKC", letter).lower())
            out = "".join(LOOK_ALIKES.get(c, c) for c in out)
            if not all(c.isalpha() or unicodedata.combining(c) for c in out):
                out = " "
        self[point] = out
        return out


FOLD = Fold()


def folded(text: str) -> str:
    """The text's words in their folded form, each between two spaces."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "!" in text or "@" in text or "$" in text:
        text = _MARKS.sub(lambda m: MARKS[m[0]], text)
    return f" {' '.join(text.translate(FOLD).split())} "


def without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def forms(words: Iterable[str], known: frozenset[str] | None = None) -> Counter:
    """How often everything comes that could be an entry (and is known): words, and beginnings of longer ones."""
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for form in [f" {word} "] * (len(word) >= SHORTEST) + [f" {word[:k]}" for k in range(SHORTEST, min(len(word) - 1, LONGEST) + 1)]:
            if known is None or form in known:
                out[form] += n
    return out


@dataclass
class Lexicon:
    """Entries with weights, exceptions, and the model on top; without one, scores are 0."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    center: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    model: list[float] = field(default_factory=list)


class Matcher:
    """Finds a lexicon's entries in folded texts."""

    def __init__(self, lexicon: Lexicon):
        self.weights = lexicon.weights
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if lexicon.weights:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> dict[int, float]:
        """The heaviest entry's weight for each word that has one, by the place of the space in front of it."""
        words: dict[int, float] = {}
        if not self.weights:
            return words
        without: list[tuple[int, int]] = []
        for last, (length, weight) in self.automaton.iter(text):
            first = last - length + 1
            if weight is None:
                without.append((first, last))
            elif weight > words.get(first, 0.0):
                words[first] = weight
        if not text.isascii():
            words |= self._bare(text)
        for first, last in without:
            for at in [at for at in words if first <= at < last]:
                del words[at]
        return words

    def _bare(self, text: str) -> dict[int, float]:
        """The same for words that have accents, read without them."""
        out, at = {}, 0
        for word in text.split():
            if not word.isascii():
                bare = without_accents(word)
                if bare.isascii() and len(bare) >= LEAST_BARE:
                    weight = self.weights.get(f" {bare} ")
                    if weight is not None:
                        out[at] = weight
            at += len(word) + 1
        return out


def measures(found: dict[int, float], n_words: int) -> list[float]:
    """What the model sees: the sum of weights, absolute and per word, the heaviest and the number of hits."""
    total = sum(found.values())
    return [
        float(np.log1p(total)),
        float(np.log1p(100 * total / max(1, n_words))),
        max(found.values(), default=0.0),
        float(np.log1p(len(found))),
        float(np.log1p(100 * len(found) / max(1, n_words))),
    ]


def _count(rows: DataFrame, count) -> DataFrame:
    """(form, toxic_docs, toxic, clean_docs, clean): documents and places with each of the forms of `count(text)`."""

    def run(batches):
        places, docs = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}

        def told():
            for toxic, tally in places.items():
                columns = [pa.array(tally.keys(), pa.string()), pa.array([toxic] * len(tally), pa.int32())]
                numbers = [pa.array(list(tally.values()), pa.float64()), pa.array([docs[toxic][f] for f in tally], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + numbers, names=["form", "toxic", "places", "docs"])
                tally.clear(), docs[toxic].clear()

        for batch, texts in chunks(batches):
            for text, toxic in zip(texts, batch.column("toxic").to_pylist()):
                found = count(folded(text))
                places[toxic].update({form: math.log2(1 + n) for form, n in found.items()})
                docs[toxic].update(found.keys())
                if len(places[toxic]) > 500_000:
                    yield from told()
        yield from told()

    found = rows.select("text", "toxic").mapInArrow(run, "form string, toxic int, places double, docs long")
    return found.groupBy("form").agg(
        *[
            F.sum(F.when(F.col("toxic") == toxic, F.col(of)).otherwise(0)).alias(name)
            for name, toxic, of in (("toxic_docs", 1, "docs"), ("toxic", 1, "places"), ("clean_docs", 0, "docs"), ("clean", 0, "places"))
        ]
    )


def _log_odds(counted, sizes: dict[int, tuple[int, int]], errors: float):
    """Log-odds of the forms among toxic documents' words against other words, moved by so many standard errors.

    Places in one document aren't independent, so documents make the errors.
    """
    odds = np.log((counted["toxic"] + 0.5) / sizes[1][1]) - np.log((counted["clean"] + 0.5) / sizes[0][1])
    return odds + errors * np.sqrt(1 / (counted["toxic_docs"] + 0.5) + 1 / (counted["clean_docs"] + 0.5))


def _entries(counted: pd.DataFrame, sizes: dict[int, tuple[int, int]]) -> dict[str, float]:
    """Forms that are heavy enough; a beginning and what it begins share the places.

    From long to short: a form that is no lighter than all entries it begins stands for them. Otherwise these
    stay, and the form is an entry too if it is heavy enough without their places.
    """
    columns = ["toxic", "clean", "toxic_docs", "clean_docs"]
    counts = dict(zip(counted["form"], counted[columns].to_numpy(float)))
    entries: dict[str, dict[str, float]] = {}  # of all that a form begins
    covered: dict[str, np.ndarray] = {}

    def weight(n: np.ndarray) -> float:
        return float(_log_odds(dict(zip(columns, n)), sizes, -ERRORS))

    for form in sorted(counts, key=len, reverse=True):
        mine, taken = entries.pop(form, {}), covered.pop(form, np.zeros(4))
        whole, rest = weight(counts[form]), np.maximum(counts[form] - taken, 0)
        if whole >= max([LEAST_WEIGHT, *mine.values()]):
            mine, taken = {form: whole}, counts[form]
        elif mine and rest[2] >= LEAST_DOCS and weight(rest) >= LEAST_WEIGHT:
            mine, taken = mine | {form: weight(rest)}, counts[form]
        # The next shorter form that begins this one: all letters of a whole word, then one less.
        up = form[: min(len(form) - 2, 1 + LONGEST)] if form.endswith(" ") else form[:-1]
        while len(up) > SHORTEST and up not in counts:
            up = up[:-1]
        up = up if len(up) > SHORTEST else ""
        entries[up] = entries.get(up, {}) | mine
        covered[up] = covered.get(up, np.zeros(4)) + taken
    return entries.get("", {})


def _around(matcher: Matcher):
    """Words with an entry, alone and with each neighbour."""

    def count(text: str) -> Counter:
        out: Counter = Counter()
        for at in matcher(text):
            end = text.find(" ", at + 1)
            before, after = text.rfind(" ", 0, at) if at else -1, text.find(" ", end + 1)
            out.update([text[at : end + 1]] + [text[before : end + 1]] * (before >= 0) + [text[at : after + 1]] * (after >= 0))
        return out

    return count


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[list, list, list]:
    """Logistic regression with a small ridge, by Newton steps: means, deviations, and weights after the base."""
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - center) / scale])
    penalty = ridge * np.eye(z.shape[1])
    penalty[0, 0] = 0
    weights = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (y - p) - penalty @ weights
        curve = (z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-6 * np.eye(z.shape[1])
        step = np.linalg.solve(curve, slope)
        weights = weights + step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-6:
            break
    return center.tolist(), scale.tolist(), weights.tolist()


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """The lexicon and the model of `labels` (doc_id, label) on the texts of `docs` (doc_id, text)."""
    named = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    named, seen = measured_table(named, "toxic-labels")
    chosen, n_chosen = measured_table(sampled(named, seen["n"], sample_rows, "doc_id"), "toxic-sample")
    rows = docs.join(broadcast_table(chosen, n_chosen["n"]), "doc_id").select(
        text_of("text").alias("text"),
        (F.col("label") >= 0.5).cast("int").alias("toxic"),
        (F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(MODEL_PART)) == 0).alias("for_model"),
    )
    rows = scratch_table(rows, "toxic-texts")
    for_lexicon = rows.where("not for_model")
    counted = for_lexicon.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum(F.size(F.split("text", r"\s+"))).alias("words"))
    sizes = {r.toxic: (r.docs, r.words) for r in counted.collect()}
    if len(sizes) < 2:  # labels of one kind only
        return Lexicon()
    possible = (
        _count(for_lexicon.where("toxic = 1"), lambda text: forms(text.split()))
        .where(F.col("toxic_docs") >= LEAST_DOCS)
        .orderBy(F.desc("toxic_docs"), "form")
        .limit(LEXICON_ENTRIES)
        .toPandas()
    )
    known = frozenset(possible["form"])
    clean = _count(for_lexicon.where("toxic = 0"), lambda text: forms(text.split(), known)).toPandas().set_index("form")
    for column in ("clean", "clean_docs"):
        possible[column] = possible["form"].map(clean[column]).fillna(0)
    lexicon = Lexicon(_entries(possible, sizes))

    # What holds an entry and is still at home in other documents.
    phrases = _count(for_lexicon, _around(Matcher(lexicon))).where(F.col("clean_docs") >= LEAST_DOCS).toPandas()
    lexicon.exceptions = sorted(
        f for f, high in zip(phrases["form"], _log_odds(phrases, sizes, ERRORS)) if high < 0 and f not in lexicon.weights
    )

    x, y = _measured(rows.where("for_model"), lexicon)
    if 0 < y.sum() < len(y):
        lexicon.center, lexicon.scale, lexicon.model = _fit(x, y)
    return lexicon


def _measured(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        matcher = Matcher(lexicon)
        for batch, texts in chunks(batches):
            found = [measures(matcher(f), f.count(" ") - 1) for f in map(folded, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").toPandas()
    order = found.sort_values(["x", "toxic"], key=lambda c: c.map(str)).index
    return np.array(found["x"][order].tolist(), float).reshape(len(found), -1), found["toxic"][order].to_numpy(float)


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_hits, n_words) for every row."""
    kept = (tuple(sorted(lexicon.weights.items())), tuple(lexicon.exceptions))

    def run(batches):
        matcher = per_worker("toxic words", kept, lambda: Matcher(lexicon))
        center, scale, model = map(np.array, (lexicon.center, lexicon.scale, lexicon.model))
        for batch, texts in chunks(batches):
            found, sizes = [], []
            x = []
            for one in map(folded, texts):
                words = matcher(one)
                sizes.append(one.count(" ") - 1 if len(one) > 2 else 0)
                found.append(len(words))
                x.append(measures(words, sizes[-1]))
            if len(model):
                scores = 1 / (1 + np.exp(-np.clip(model[0] + (np.array(x) - center) / scale @ model[1:], -30, 30)))
            else:
                scores = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(scores), pa.array(found, pa.int64()), pa.array(sizes, pa.int64())],
                names=[key, "score", "n_hits", "n_words"],
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, score double, n_hits long, n_words long")
