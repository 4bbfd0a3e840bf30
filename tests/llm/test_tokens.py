"""Byte-level BPE, token counts and token files against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, queries, token_counts, token_files
from millrace.llm._scratch import written

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = " \n\t\r\x0b\x0c\x1c\x85\xa0   　​'sdtreABCé漢🎉٣9<|endoftext|>.,!  a b"


def odd_texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [None, "", " ", "\n", "a", " a", "a ", "x" * 5000, "w " * 30000, "a\nb\n\nc", *made]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "extra") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows + rows[:5], "doc_id long, text string, size string").repartition(4)


@pytest.fixture(scope="module")
def reference():
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_of_the_vocabulary_is_reached():
    coder = byte_bpe.ByteBpe(MULTI, public_tokenizers.PATTERN)
    tokens = byte_bpe.read_ranks(MULTI)
    mapped = [t.decode("latin-1").translate(coder.to_text) for t in tokens]
    assert coder.model.encode(mapped, num_threads=1) == [[i] for i in range(len(tokens))]


def test_byte_bpe_equals_the_library_on_odd_texts(odd, reference):
    path, pattern = MULTI, public_tokenizers.PATTERN
    one = byte_bpe.round_trip(odd, path, pattern)
    assert one.columns == ["doc_id", "size", "n_tokens", "ids", "decoded"]
    two = byte_bpe.decode(byte_bpe.encode(odd, path, pattern), path, pattern)
    texts = odd_texts()
    for frame in (one, two):
        rows = frame.select("doc_id", "n_tokens", "ids", "decoded").collect()
        assert len(rows) == len(texts) + 5
        for r in rows:
            ids = reference.encode_ordinary(texts[r.doc_id] or "")
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
            assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_byte_bpe_refuses_clashing_columns_and_takes_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(none, MULTI, public_tokenizers.PATTERN).count() == 0
    clash = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_tokens int")
    with pytest.raises(ValueError, match="n_tokens"):
        byte_bpe.encode(clash, MULTI, public_tokenizers.PATTERN)


def test_op4_on_documents(spark, texts, reference):
    rows = queries.op4_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        ids = np.array(reference.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(odd, name):
    path = public_tokenizers.path(name)
    texts = odd_texts()
    if name.endswith(".model"):
        expected = list(map(len, sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])))
    else:
        encoded = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        expected = [len(e.ids) for e in encoded]
    for r in token_counts.count_tokens(odd, path, limit=10).collect():
        assert (r.n_bytes, r.n_tokens) == (len((texts[r.doc_id] or "").encode()), expected[r.doc_id])
        assert r.over_limit == (r.n_tokens > 10)


def test_counts_of_an_empty_table_and_a_clash(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), JSON).count() == 0
    with pytest.raises(ValueError, match="over_limit"):
        token_counts.count_tokens(spark.createDataFrame([("a", 1)], "text string, over_limit int"), JSON)


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 24, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_packing_round_trip(bits, n):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-n * bits // 8)
    assert token_files.unpack(packed, bits, n).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [15, 16])
def test_random_access_in_a_segment(bits):
    rng = np.random.default_rng(1)
    lengths = np.array([0, 5, 0, 700, 1, 64, 0])
    ids = rng.integers(0, 1 << 15, lengths.sum()).astype(np.uint32)
    read = token_files.Segment(token_files.to_segment(lengths, ids, bits, block=64))
    at = np.cumsum([0, *lengths])
    for k in range(len(lengths)):
        assert read.document(k).tolist() == ids[at[k] : at[k + 1]].tolist()
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert read.ids(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError, match="bits"):
        token_files.to_segment(np.array([1]), np.array([1 << 15], np.uint32), 15)


def token_rows(pairs):
    encode = Tokenizer.from_file(JSON).encode
    start, rows = 0, []
    for doc_id, text in pairs:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


def test_op5_on_documents(spark, texts):
    got = sorted(map(tuple, queries.op5_token_files(spark, "/root/testdata/sf0.001").collect()))
    assert got == token_rows(sorted(texts.items()))


def test_token_files_of_nulls_ties_and_nothing(spark, monkeypatch):
    rows = [(3, "c d"), (None, "x"), (1, None), (2, "b"), (2, "b"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stored = written(token_files.segments(docs, JSON, end_id=2), "test")
    got = sorted(map(tuple, token_files.documents_of(stored).collect()), key=lambda r: r[1])
    assert got == token_rows([(None, "x"), (None, "x"), (1, None), (2, "b"), (2, "b"), (3, "c d")])
    none = written(token_files.segments(docs.limit(0), JSON, end_id=2), "test")
    assert token_files.documents_of(none).count() == 0
