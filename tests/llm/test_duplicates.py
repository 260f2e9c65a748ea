import contextlib
import gc
import hashlib
import itertools
import os
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from plain import Groups, words_of

from wirelens.llm import multi_index, order_minhash, queries, repeats, simhash
from wirelens.llm.common import components
from wirelens.session import scratch_folder, scratch_table

SF = "/root/testdata/sf0.001"


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    random.seed(5)
    random.shuffle(edges)
    want = Groups()
    for a, b in edges:
        want.join(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: want.find(x) for e in edges if e[0] != e[1] for x in e}


# --- Order MinHash --------------------------------------------------------------------------


def test_query_2(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    found = {r.doc_id: r for r in queries.op2_order_minhash(spark, SF).collect()}
    sketch = order_minhash.OrderMinHash()
    for i, doc in enumerate(docs):
        following = docs[(i + 1) % len(docs)].text
        cut = len(doc.text) // 3
        edited = doc.text[: len(doc.text) - cut] + following[:cut]
        codes = sketch(doc.text), sketch(edited), sketch(following)
        row = found[doc.doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(doc.text), hashlib.sha256(edited.encode()).hexdigest())
        assert row.fingerprint == order_minhash.hexadecimal(codes[0])
        assert row.edited_fingerprint == order_minhash.hexadecimal(codes[1])
        assert (row.near_edited, row.near_next) == (
            order_minhash.likeness(codes[0], codes[1]),
            order_minhash.likeness(codes[0], codes[2]),
        )
        assert order_minhash.compared(row.fingerprint, row.edited_fingerprint) == row.near_edited


def test_odd_texts_have_fingerprints(odd):
    rows = order_minhash.compare_with_next(odd).collect()
    assert len(rows) == odd.count()
    alone = order_minhash.fingerprints(odd).collect()
    assert sorted(map(str, [(r.doc_id, r.fingerprint) for r in rows])) == sorted(map(str, [(r.doc_id, r.fingerprint) for r in alone]))
    of = {r.doc_id: r.fingerprint for r in alone}
    assert of[0] == of[1] == "0" * 256 and of[14] == of[15]
    assert order_minhash.compare_with_next(odd.limit(0)).count() == 0
    assert order_minhash.compare_with_next(odd.limit(1)).count() == 1


def test_order_counts():
    sketch = order_minhash.OrderMinHash()
    random.seed(3)
    parts = ["".join(random.choice("abcdefgh ") for _ in range(60)) for _ in range(20)]
    text, moved = "".join(parts), "".join(parts[::-1])
    near = "".join(parts[:9] + ["a small change"] + parts[10:])
    assert order_minhash.likeness(sketch(text), sketch(near)) > 0.7
    assert order_minhash.likeness(sketch(text), sketch(moved)) < 0.7
    assert order_minhash.likeness(sketch(text), sketch(text)) == 1


def test_long_texts_are_numbered_the_same_way():
    sketch = order_minhash.OrderMinHash()
    places = order_minhash.window_hashes(np.frombuffer(b"abcabcab" * 50, np.uint8), 12) >> np.uint64(24)
    for a, b in zip(sketch._numbered_short(places.copy()), sketch._numbered_long(places.copy())):
        assert (a == b).all()


# --- inverted multi-index -------------------------------------------------------------------


def brute_vectors(rows, threshold):
    """(links, component) of (id, label, vector) by comparing all."""
    good = []
    for name, label, vector in rows:
        v = np.array([np.nan if x is None else x for x in vector or []], float)
        if label is not None and len(v) and np.isfinite(v).all() and v.any():
            good.append((name, label, v / np.linalg.norm(v)))
    links, groups = {name: 0 for name, _, _ in rows}, Groups()
    for (a, la, u), (b, lb, v) in itertools.combinations(good, 2):
        if la == lb and len(u) == len(v) and float(u @ v) >= threshold:
            links[a] += 1
            links[b] += 1
            groups.join(a, b)
    return {name: (links[name], groups.find(name)) for name, _, _ in rows}


def test_vectors_link_as_by_comparing_all(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        center = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), int(c % 3), (center + rng.normal(size=16) * 0.08).tolist()))
    rows += [(len(rows) + i, 1, rows[0][2]) for i in range(3)] + [(len(rows) + 3 + i, 0, rows[0][2]) for i in range(3)]
    n = len(rows)
    rows += [
        (n, None, rows[0][2]), (n + 1, 0, None), (n + 2, 0, [0.0] * 16), (n + 3, 0, [float("nan")] + [1.0] * 15),
        (n + 4, 0, [None] + [1.0] * 15), (n + 5, 0, [float("inf")] * 16), (n + 6, 0, [1.0] * 5), (n + 7, 0, []),
    ]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as cell", "2 as copies")
    found = multi_index.near_duplicates(table).collect()
    want = brute_vectors([(i, l, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows], 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found}
    total, have = sum(l for l, _ in want.values()), sum(l for l, _ in got.values())
    assert all(got[i][0] <= want[i][0] for i in want) and have >= 0.9 * total
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert all(got[i] == (0, i) for i in range(n, n + 8))


def test_blocks_of_hot_cells_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [(i, 1, (np.ones(8) + rng.normal(size=8) * 0.3).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute_vectors(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_duplicates(table, target_recall=1.0).collect()}
    assert sum(a for a, _ in got.values()) >= 0.98 * sum(a for a, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def grouped_vectors(rng, centers, dims, labels, spread=0.05):
    rows = []
    for c in range(centers):
        center = rng.normal(size=dims)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), int(c % labels), (center + rng.normal(size=dims) * spread).tolist()))
    return rows


def test_regions_rounds_and_blocks_lose_nothing(spark, monkeypatch):
    """Small limits, so that regions, rounds, blocks of both sides and passing visitors all come up."""
    for name, most in (("HOST_BYTES", 4_000), ("GUEST_BYTES", 9_000), ("ROUND_BYTES", 20_000), ("ROUND_SHARE", 8), ("GUEST_ROWS", 40), ("BLOCK_ROWS", 9)):
        monkeypatch.setattr(multi_index, name, most, raising=False)
    rows = grouped_vectors(np.random.default_rng(4), 300, 16, 2)
    rows += [(len(rows) + i, 1, [2 * x for x in rows[1][2]]) for i in range(3)]  # equal unit vectors
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_duplicates(table, target_recall=1.0).collect()}
    want = brute_vectors(rows, 0.93)
    assert sum(a for a, _ in want.values()) > 1000
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)
    assert all(got[i][0] <= want[i][0] for i in want)


def test_vectors_take_little_disk(spark, monkeypatch):
    """Scratch tables and shuffle files at any time, against the vectors themselves."""
    monkeypatch.setattr(multi_index, "ROUND_BYTES", 1 << 20, raising=False)
    n, dims = 20_000, 64
    flat = np.random.default_rng(5).standard_normal(n * dims).astype(np.float32)
    vectors = pa.ListArray.from_arrays(np.arange(0, n * dims + 1, dims, dtype=np.int32), flat)
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": vectors, "label": np.zeros(n, np.int64)}))
    table = scratch_table(table.repartition(8), "test-vectors")
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    folders = [*local, scratch_folder(spark).removeprefix("file:")]

    def used():
        total = 0
        for folder in folders:
            for path, _, names in os.walk(folder):
                for name in names:
                    if not name.startswith("broadcast_"):
                        with contextlib.suppress(OSError):  # a file may go meanwhile
                            total += os.path.getsize(f"{path}/{name}")
        return total

    gc.collect()
    before, most, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            most[0] = max(most[0], used() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert multi_index.near_duplicates(table).count() == n
    finally:
        over.set()
        watcher.join()
    assert 0 < most[0] <= 4 * n * dims * 4 + (2 << 20)


def test_reach_is_the_distance_of_the_last_visited_cell():
    rng = np.random.default_rng(6)
    grid = multi_index.Grid(rng.normal(size=(300, 8)), 12, 3)
    one, two = grid.distances(rng.normal(size=(60, 8)))
    rows, sums = np.arange(60)[:, None], (one[:, :, None] + two[:, None, :]).reshape(60, -1)
    for n in (1, 7, 144, 999):
        cells, reach = grid.visits(one, two, n), grid.reaches(one, two, n)
        assert (sums[rows, cells].max(axis=1) == reach).all()
        regions = grid.regions(one, two, reach)
        assert regions[rows, grid.regions_of(cells)].all()
        assert [set(np.flatnonzero(x)) for x in regions] == [set(grid.regions_of(np.flatnonzero(y <= r))) for y, r in zip(sums, reach)]


def test_cells_are_told_alike_in_any_batch():
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((500, 64)).astype(np.float32)
    units = multi_index._unit(vectors)
    grid = multi_index.Grid(units, 20)
    one, two = grid.distances(units)
    for size in (1, 3, 64):
        for i in range(0, 500, size):
            some = multi_index._unit(vectors[i : i + size])
            assert (some == units[i : i + size]).all()
            assert all((x == y[i : i + size]).all() for x, y in zip(grid.distances(some), (one, two)))


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert multi_index.near_duplicates(table).count() == 0
    nulls = spark.createDataFrame([(1, None, None)], "vec_id long, label int, embedding array<float>")
    assert multi_index.near_duplicates(nulls).collect()[0][1:] == (0, 1, True)


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(3)
    grid = multi_index.Grid(rng.normal(size=(200, 8)), 6)
    one, two = grid.distances(rng.normal(size=(50, 8)))
    sums = (one[:, :, None] + two[:, None, :]).reshape(50, -1)
    for n in (1, 5, 36):
        cells = grid.visits(one, two, n)
        assert np.allclose(np.take_along_axis(sums, cells, 1), np.sort(sums, axis=1)[:, :n])
    assert (grid.visits(one, two, 3)[:, 0] == grid.homes(one, two)).all()


# --- SimHash --------------------------------------------------------------------------------


def fingerprint(text):
    words = words_of(text)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_7(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op7_simhash_balls(spark, SF).collect()}
    codes, groups = {d.doc_id: fingerprint(d.text) for d in docs}, Groups()
    for a, b in itertools.combinations(codes, 2):
        if (codes[a] ^ codes[b]).bit_count() <= 3:
            groups.join(a, b)
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {
        i: (f"{c:016x}", groups.find(i)) for i, c in codes.items()
    }


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_lose_no_component(spark, radius):
    rng = np.random.default_rng(radius)
    values = set()
    for base in rng.integers(0, 2**63, 25).tolist():
        values.add(base)
        for _ in range(7):
            x = base
            for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fingerprint long")
    found = {r.doc_id: r.component for r in simhash.near_duplicates(rows, radius=radius).collect()}
    groups = Groups()
    for (i, a), (j, b) in itertools.combinations(enumerate(values), 2):
        if (a ^ b).bit_count() <= radius:
            groups.join(i, j)
    assert found == {i: groups.find(i) for i in range(len(values))}


def test_odd_texts_are_hashed(odd):
    rows = simhash.near_duplicates(simhash.fingerprints(odd)).collect()
    assert len(rows) == odd.count()
    of = {r.doc_id: r for r in rows}
    assert of[0].fingerprint == of[1].fingerprint == of[2].fingerprint == 0 and of[2].component == 0
    assert of[5].component == of[6].component == 5
    assert simhash.near_duplicates(simhash.fingerprints(odd.limit(0))).count() == 0


@pytest.mark.parametrize("n, pairs", [(20_000, 10), (100_000, 60)])
def test_rare_links_are_found(spark, n, pairs):
    """Random vectors, and few pairs just above the threshold: rarer than one vector in a thousand."""
    rng = np.random.default_rng(n)
    vectors = rng.standard_normal((n, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    aside = rng.standard_normal((pairs, 64))
    aside -= (aside * vectors[:pairs]).sum(axis=1, keepdims=True) * vectors[:pairs]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.945, (pairs, 1))
    near = cosine * vectors[:pairs] + np.sqrt(1 - cosine**2) * aside
    every = np.concatenate([vectors, near])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(every.ravel()), 64).cast(pa.list_(pa.float64()))
    table = pa.table({"vec_id": np.arange(len(every)), "embedding": flat, "label": np.zeros(len(every), np.int64)})
    rows = spark.createDataFrame(table).repartition(8)
    found = multi_index.near_duplicates(rows).where("n_links > 0").collect()
    linked = {r.vec_id: r.component_id for r in found}
    assert all(linked[n + i] == i for i in range(pairs) if n + i in linked)
    assert sum(n + i in linked for i in range(pairs)) >= 0.98 * pairs


# --- repeats --------------------------------------------------------------------------------


def brute_repeats(docs, length):
    first = {}
    for i, text in docs:
        raw = (text or "").encode()
        for at in range(len(raw) - length + 1 if i is not None else 0):
            part = raw[at : at + length]
            first[part] = min(i, first.get(part, i))
    out = []
    for i, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1 if i is not None else 0):
            if first[raw[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def found_repeats(df, **more):
    rows = repeats.remove_repeats(df, **more).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), bytes(r.kept)) for r in rows), key=str)


def test_query_6(spark, small_docs):
    want = brute_repeats([tuple(r) for r in small_docs.collect()], 50)
    got = queries.op6_previous_factors(spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        ((i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in want), key=str
    )


def test_odd_texts_lose_what_came_before(odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found_repeats(odd) == brute_repeats(docs, 50)
    assert found_repeats(odd.limit(0)) == []


@pytest.mark.parametrize("slice_bytes, hot", [(1 << 19, 20_000), (700, 20_000), (1 << 19, 3), (700, 3)])
def test_pieces_of_one_text(spark, monkeypatch, slice_bytes, hot):
    monkeypatch.setattr(repeats, "SLICE", slice_bytes)
    monkeypatch.setattr(repeats, "HOT_STRETCHES", hot)
    random.seed(4)
    base = "".join(random.choice("ab é") for _ in range(3000))
    docs = [
        (i, "".join(base[j : j + random.randint(20, 200)] for j in random.sample(range(2900), random.randint(0, 6))))
        for i in range(60)
    ]
    docs += [(5, base[:100]), (None, base), (7, None), (99, "a" * 500), (98, "a" * 60)]
    random.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found_repeats(df) == brute_repeats(docs, 50)
    by_bytes = {(r.doc_id, r.row.copy): r for r in repeats.remove_repeats(df.withColumn("copy", df.text)).collect()}
    for row in repeats.remove_repeats(df.withColumn("copy", df.text), whole_characters=True).collect():
        gone = set()
        for a, b in zip(by_bytes[row.doc_id, row.row.copy].starts, by_bytes[row.doc_id, row.row.copy].ends):
            gone.update(range(a, b))
        at, kept = 0, ""
        for letter in row.row.copy or "":
            size = len(letter.encode())
            kept += "" if gone.issuperset(range(at, at + size)) else letter
            at += size
        assert bytes(row.kept).decode() == kept


def test_nearest_smaller():
    random.seed(6)
    for n in (0, 1, 2, 30, 200):
        for top in (1, 3, 1000):
            values = [random.randrange(top) for _ in range(n)]
            want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(n)]
            assert repeats.nearest_smaller(np.array(values, np.int64)).tolist() == want
    falling = np.arange(100_000)[::-1].copy()
    assert (repeats.nearest_smaller(falling) == -1).all()


def test_longest_previous_factors():
    random.seed(9)
    for length in (3, 8, 13):
        docs = ["".join(random.choice("ab") for _ in range(random.randint(length, 40))).encode() for _ in range(12)]
        buffer = np.frombuffer(b"".join(docs), np.uint8)
        ends = np.cumsum([len(d) for d in docs])
        place = np.concatenate([np.arange(e - len(d), e - length + 1) for d, e in zip(docs, ends)])
        doc = np.searchsorted(ends, place, side="right")
        got = repeats.previous_factors(buffer, place, doc, length)
        raw = buffer.tobytes()
        for at, d, factor in zip(place.tolist(), doc.tolist(), got.tolist()):
            earlier = [raw[p : p + length] for p, e in zip(place.tolist(), doc.tolist()) if e < d]
            mine = raw[at : at + length]
            assert factor == max((next((k for k in range(length) if mine[k] != o[k]), length) for o in earlier), default=0)


def test_a_hot_phrase_is_dealt_by_its_windows():
    """One phrase among different words: as one minimizer's group, and split, with the same answers."""
    rng = np.random.default_rng(2)
    phrase = b"the licence phrase that stands here"
    n = 3000
    texts = [rng.integers(97, 123, 40, np.uint8).tobytes() + phrase + rng.integers(97, 123, 40, np.uint8).tobytes() for _ in range(n)]
    texts[n // 2] = texts[5][:60] + texts[n // 2][60:]
    rows = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array([t.decode() for t in texts])})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    found = []
    for hot in (20_000, 100):
        block = repeats.Block(sink.getvalue().to_pybytes(), 64, 50)
        asked = block.asked()
        shared, much = [], []
        for _, keys, several, stretches in asked:
            one, other = repeats.shared_keys([(keys, several, stretches)], hot)
            shared.append(np.packbits(one[0]).tobytes()), much.append(np.packbits(other[0]).tobytes())
        bits = {part: pair for (part, *_), pair in zip(asked, zip(shared, much))}
        sent = block.sent(bits)
        answers, most = {}, 0
        for part, which in sent:
            lead = block.lead[which]
            counts, docs = block.all.count[lead], block.ids[block.all.doc[lead]]
            strings = block.buffer[repeats.ragged(block.all.first[lead], counts + 49)]
            most = max(most, len(strings))
            answers[part] = repeats.planes(repeats.earlier_windows(strings, counts, docs, 50))
        fresh = repeats.Block(sink.getvalue().to_pybytes(), 64, 50)
        found.append((fresh.removed(bits, answers).tobytes(), most))
    assert found[0][0] == found[1][0] and sum(found[0][0]) > 0
