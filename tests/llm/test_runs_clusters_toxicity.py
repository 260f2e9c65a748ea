import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from compare import compare, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirelens.llm import pivot_clusters, queries, toxicity, word_runs

SF = "/root/testdata/sf0.001"


# --- runs -----------------------------------------------------------------------------------


def plain_runs(words):
    """Every stretch with w[i] = w[i + q] that nothing extends, smallest period first."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            end = i
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end > i and end - i + q >= max(6, 4 * q):
                found.setdefault((i, end - i + q), q)
            i = max(end, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *best, best[1] and math.floor(1000 * best[1] / best[2]),
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = sorted(tuple(r) for r in queries.op11_word_runs(spark, SF).collect())
    assert found == sorted(plain_row(d.doc_id, d.text) for d in docs)
    assert sum(r[1] > 0 for r in found) > 15


def test_odd_texts_have_runs(odd):
    found = word_runs.digests(word_runs.word_runs(odd, tails=True)).collect()
    want = [plain_row(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert word_runs.word_runs(odd.limit(0)).count() == 0
    by_id = {r.doc_id: r for r in word_runs.word_runs(odd).collect()}
    assert [tuple(r) for r in by_id[12].runs] == [(0, 8000, 2)] and by_id[12].kept == "x y"
    assert by_id[0].runs == [] and by_id[0].kept == "" and by_id[0].n_words == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 7)), max_size=5), max_size=4))
def test_runs_of_small_texts(made):
    docs = [[w for part, n in doc for w in part * n] for doc in made]
    numbers = np.array([w for doc in docs for w in doc], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    want, at = [], 0
    for words in docs:
        want += [[at + s, n, q] for s, n, q in plain_runs(words)]
        at += len(words)
    assert word_runs.runs_of(numbers, doc).tolist() == sorted(want, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("period", [1, 2, 1000, 24_999])
def test_long_runs(period):
    words = np.concatenate([[-1], np.arange(100_000) % period, [-2]]) + 2
    assert word_runs.runs_of(words, np.zeros(len(words), np.int64)).tolist() == [[1, 100_000, period]]


# --- clusters -------------------------------------------------------------------------------


def test_query_12(spark):
    ok, message = compare(spark, duck(SF), "op12", queries.op12_pivot_clusters, queries.ORACLES["op12_pivot_clusters"], SF)
    assert ok, message


def plain_clusters(vectors, clusters, rounds, seed):
    units = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors.items()}
    order = sorted(units, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centers = [list(units[i]) for i in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        places = {i: near(v)[1] for i, v in units.items()}
        for k in range(len(centers)):
            mine = [units[i] for i, at in places.items() if at == k]
            if mine:
                centers[k] = [sum(column) // len(mine) for column in zip(*mine)]
    return {i: (near(v)[1], near(v)[0], centers[near(v)[1]]) for i, v in units.items()}


@pytest.mark.parametrize("n, spread", [(300, 0.1), (60, 4000.0), (7, 1.0)])
def test_clusters_as_by_measuring_all(spark, n, spread):
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(5, 8)) * spread
    vectors = {i: (centers[i % 5] + rng.normal(size=8) * spread / (1 + i % 3)).astype(np.float32).tolist() for i in range(n)}
    vectors |= {n: vectors[0], n + 1: [0.0] * 8, n + 2: [-0.0] * 8}  # ties
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    found = pivot_clusters.cluster(rows, clusters=6, rounds=4, seed=9, dimensions=8).collect()
    want = plain_clusters(vectors, 6, 4, 9)
    assert {r.vec_id: (r.cluster, r.distance, r.centroid) for r in found} == want
    for r in found:
        assert r.cluster_inertia == sum(d for c, d, _ in want.values() if c == r.cluster)
        assert r.inertia == sum(d for _, d, _ in want.values())


def test_pivots_spare_distances():
    rng = np.random.default_rng(1)
    centers = rng.integers(-5000, 5000, (40, 64))
    vectors = np.repeat(centers, 100, axis=0) + rng.integers(-50, 50, (4000, 64))
    pivots = rng.integers(-5000, 5000, (pivot_clusters.PIVOTS, 64))
    best, distance, computed = pivot_clusters.nearest(vectors, pivot_clusters.to_pivots(vectors, pivots), centers, pivots)
    assert (best == np.repeat(np.arange(40), 100)).all() and (distance == ((vectors - centers[best]) ** 2).sum(axis=1)).all()
    assert computed < 4000 * 40 / 4


def test_odd_vectors(spark):
    good, nan, far = [1.0] * 64, [float("nan")] + [1.0] * 63, [1e30] + [1.0] * 63
    rows = [(1, good), (1, good), (1, [0.5] * 64), (2, nan), (3, None), (4, [1.0]), (5, [None] + [1.0] * 63), (6, [float("inf")] * 64), (None, good), (7, far)]
    columns = "vec_id long, embedding array<float>, cluster int, units int, key string"
    df = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], columns)
    found = pivot_clusters.cluster(df).collect()
    assert sorted(str(r.vec_id) for r in found) == ["1", "1", "1", "None"]
    assert {r.cluster for r in found} == {0} and {r.inertia for r in found} == {sum(r.distance for r in found)}
    assert pivot_clusters.cluster(df.limit(0)).count() == 0
    assert pivot_clusters.cluster(df.where("vec_id = 3")).count() == 0


# --- toxicity -------------------------------------------------------------------------------


def test_folding_undoes_disguises():
    assert toxicity.folded("You 1D10T, $tup!d…\n") == " you idiot stupid "
    assert toxicity.folded("іdіоt ｉｄｉｏｔ st​upid L0­SER") == " idiot idiot stupid loser "
    assert toxicity.folded("Réeux été") == " réeux été "
    assert toxicity.folded("") == toxicity.folded(" \n 69") == "  "


def test_words_beginnings_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " idio": 2.0, " idiot": 4.0, " scum ": 1.0}, [" trash can ", " idiotype "])
    matcher = toxicity.Matcher(lexicon)

    def found(text):
        return sorted(matcher(toxicity.folded(text)).values())

    assert found("trash! an IDIOT and idioms") == [2.0, 3.0, 4.0]
    assert found("the trash can, an idiotype, trashy") == []
    assert found("trash trash can") == [3.0]
    assert found("scüm ïdiot träsh") == [3.0]  # without accents: whole words of five letters
    assert toxicity.Matcher(toxicity.Lexicon())("  any ") == {}


def toxic_docs(spark, n=3000):
    random.seed(8)
    words = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        text = random.choices(words, k=random.randint(20, 120))
        for _ in range(random.randint(2, 4) if toxic else 0):
            text.insert(random.randrange(len(text)), random.choice(["moron", "trash", "m0r0n", "vequ" + random.choice(words)]))
        for _ in range(random.randint(0, 2)):
            text.insert(random.randrange(len(text)), "trash can" if i % 15 == 1 else "plain")
        rows.append((i, " ".join(text), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_a_lexicon_is_learned(spark):
    docs = toxic_docs(spark)
    lexicon = toxicity.learn(docs.select("doc_id", "text"), docs.where("doc_id % 2 = 0").select("doc_id", "label"))
    assert any(" moron ".startswith(e) for e in lexicon.weights) and any(e.startswith(" veq") for e in lexicon.weights)
    assert " trash can " in lexicon.exceptions
    rows = toxicity.score(docs.where("doc_id % 2 = 1"), lexicon).join(docs, "doc_id").collect()
    right = sum((r.score >= 0.7) == (r.label == 1) for r in rows)
    assert right >= 0.99 * len(rows)


def test_query_13_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.op13_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = found.where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    wrong = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) >= 0.85 * len(caught) and sum(wrong) <= 0.005 * len(wrong)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_odd_texts_are_scored(spark, odd):
    docs = odd.withColumns({"score": F.lit(1), "toxic": F.lit(1), "label": F.lit("x")})
    labels = spark.createDataFrame([(3, 0.0), (3, 1.0), (5, None), (None, 1.0), (12, 0.0), (13, 1.0)], "doc_id long, label double")
    for given_labels in (labels, labels.limit(0), labels.where("doc_id = 12")):
        lexicon = toxicity.learn(docs.select("doc_id", "text"), given_labels)
        rows = toxicity.score(docs, lexicon).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    made = toxic_docs(spark, 600)
    lexicon = toxicity.learn(made.select("doc_id", "text"), made.select("doc_id", "label"))
    by_id = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    assert by_id[0].score == by_id[1].score < 0.5 and by_id[0].n_words == 0 and by_id[12].n_words == 8000
