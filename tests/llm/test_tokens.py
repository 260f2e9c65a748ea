import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wirelens.llm import bpe, pieces, queries, token_files
from wirelens.llm.lexicon import Lexicon, compile_lexicon

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def rows_by_id(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.doc_id, []).append(row)
    return out


@pytest.mark.parametrize("with_lexicon", [True, False])
def test_words_as_the_library_encodes_them(odd, with_lexicon):
    lexicon = bpe.build_lexicon(bpe.frequent_words(odd, WORDS), WORDS, size=40) if with_lexicon else None
    whole = Tokenizer.from_file(WORDS)
    texts = rows_by_id(odd)
    found = bpe.round_trip(odd, WORDS, lexicon).collect()
    assert len(found) == odd.count()
    for row in found:
        ids = whole.encode(texts[row.doc_id][0].text or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.decoded == whole.decode(ids, skip_special_tokens=False)


def test_encode_then_decode_is_the_round_trip(odd):
    encoded = bpe.encode(odd, WORDS, None)
    decoded = {(r.doc_id, r.text) for r in bpe.decode(encoded, WORDS).collect()}
    assert decoded == {(r.doc_id, r.decoded) for r in bpe.round_trip(odd, WORDS, None).collect()}


def test_query_1(spark):
    whole = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = rows_by_id(queries.op1_bpe_lexicon(spark, "/root/testdata/sf0.001"))
    for doc in docs:
        ids = whole.encode(doc.text, add_special_tokens=False).ids
        (row,) = found[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lexicon_shares_endings_and_finds_all(tmp_path):
    words = ["tap", "taps", "top", "tops", "é", "a", "walking", "talking"]
    entries = {w: [i, i + 1] for i, w in enumerate(words)}
    content = compile_lexicon(entries)
    (tmp_path / "lexicon").write_bytes(content.tobytes())
    lexicon = Lexicon(str(tmp_path / "lexicon"))
    assert len(lexicon.final) < 1 + sum(len(w.encode()) for w in words) - 8
    ranks = lexicon.ranks([*words, "ta", "tapss", "", "b", "zé"])
    assert sorted(ranks[: len(words)]) == list(range(len(words)))
    assert [lexicon.ids_of(r) for r in ranks[: len(words)]] == [entries[w] for w in words]
    assert (ranks[len(words) :] == -1).all()


def test_long_words_merge_as_short_ones():
    merges = bpe.Merges(WORDS)
    random.seed(1)
    for _ in range(200):
        word = "".join(random.choice("abtheinés") for _ in range(random.randint(1, 40)))
        raw = word.encode()
        symbols = [merges.inner[b] for b in raw[:-1]] + [merges.last[raw[-1]]]
        assert merges._short(list(symbols)) == merges._long(list(symbols))


def test_fast_splitting_agrees_with_the_library():
    """Every character that the patterns cover, in many surroundings."""
    words, as_bytes = pieces.WordSplitter(pieces.load(WORDS)), pieces.ByteSplitter(pieces.load(BYTES))
    random.seed(2)
    letters = [chr(p) for p in pieces.COMMON]
    for letter in letters * 3:
        text = "".join(random.choice(["a", " ", "1", "'s", ".", letter, random.choice(letters)]) for _ in range(8)) + letter
        cuts = as_bytes.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        assert as_bytes.plain(text) == [text[a:b] for _, (a, b) in cuts]
        low = words.tokenizer.normalizer.normalize_str(text)
        assert words.plain(text) == [low[a:b] for _, (a, b) in words.tokenizer.pre_tokenizer.pre_tokenize_str(low)]


def test_files_hold_what_the_library_encodes(spark, odd):
    whole = Tokenizer.from_file(BYTES)
    folder, files, n = token_files.write_token_files(odd.repartition(3), BYTES, end_id=0, file_ids=2000)
    assert n > 1
    found = token_files.read_token_files(spark, folder, files, n).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert len(ids) == odd.count()
    texts, at = rows_by_id(odd), 0
    for row in found:
        want = whole.encode(texts[row.doc_id][0].text or "", add_special_tokens=False).ids + [0]
        assert row.start == at and row.n_tokens == len(want)
        assert np.frombuffer(row.ids, "<u4").tolist() == want
        at += len(want)


def test_no_files_for_no_documents(spark, odd):
    folder, files, n = token_files.write_token_files(odd.limit(0), BYTES)
    assert n == 0 and token_files.read_token_files(spark, folder, files, n).count() == 0


def test_query_9(spark):
    whole = Tokenizer.from_file(BYTES)
    found = rows_by_id(queries.op9_token_files(spark, "/root/testdata/sf0.001"))
    at = 0
    for doc in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(whole.encode(doc.text, add_special_tokens=False).ids + [0], "<u4")
        assert tuple(found[doc.doc_id][0]) == (doc.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 300), st.integers(0, 2**64 - 1)), max_size=400))
def test_words_of_ids_come_back(values):
    ids = np.array(values, np.uint64)
    words, escapes = token_files.pack(ids)
    assert (token_files.unpack(words, escapes, len(ids)) == ids).all()
    assert len(escapes) == sum(v >= 1 << 60 for v in values)


def test_zeros_and_small_ids_share_words():
    assert len(token_files.pack(np.zeros(240, np.uint64))[0]) == 2
    assert len(token_files.pack(np.full(60, 1, np.uint64))[0]) == 1
    assert len(token_files.pack(np.full(4, 2**15 - 1, np.uint64))[0]) == 1
    assert len(token_files.pack(np.full(4, 2**15, np.uint64))[0]) == 2


def test_answers_to_blocks_are_compressed(spark):
    from wirelens.llm import interpolation
    from wirelens.llm.blocks import text_blocks

    text = " ".join(f"w{i}" for i in range(20_000))
    rows = spark.createDataFrame([(1, text, True)], "doc_id long, text string, learn boolean")
    blocks, _ = text_blocks(rows)
    sizes = interpolation._ask(blocks, 4).selectExpr("sum(octet_length(counts)) as n").head()
    assert sizes.n < 40_000  # 8 bytes for each of 40,000 words and pairs otherwise
