"""BPE encoding, decoding and token counts, against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opinia.llm import bpe_codec, token_counts

from .conftest import EDGE

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe_codec.encoder(WORD)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encoder_on_random_texts(encoder):
    library, drawn = Tokenizer.from_file(WORD), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDE '.,!?0123456789éèüßñΣςİıﬁ中文日本한국 \u0327\u0301\x1c\x85\u2028\u00a0\n\t\x00😀🏽ªº²"
    words = ["the", "ing", "tion", "er's", "don't", "<|endoftext|>", "<|startoftext|>", "'ll've", "''s", "aaaaaaaaaaaa"]
    for _ in range(1500):
        text = "".join(drawn.choice(letters if drawn.random() < 0.7 else words) for _ in range(drawn.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        found = encoder.encode(text)
        assert found.tolist() == ids, text
        assert encoder.decode(found).decode() == library.decode(ids, skip_special_tokens=False), text


def test_a_pair_is_compatible_if_merging_leaves_it(encoder):
    """All merges of the first ranks: the two parts of a merge never stay side by side."""
    for (left, right), _ in list(encoder.words.rank.items())[:2000]:
        assert not encoder.fits(left, right)


def test_memory_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 3)
    encoder = bpe_codec.Encoder(WORD)
    library = Tokenizer.from_file(WORD)
    for _, text in EDGE:
        assert encoder.encode(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_digests(edge, nothing):
    library = Tokenizer.from_file(WORD)
    expected = []
    for i, text in EDGE:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe_codec.digests(edge, WORD).collect()), key=str) == sorted(expected, key=str)
    assert bpe_codec.digests(nothing, WORD).collect() == []
    real = {r.doc_id: (r.ids, r.decoded) for r in bpe_codec.encode_decode(edge.filter("doc_id IN (1, 3)"), WORD).collect()}
    assert real[3] == ([], "") and real[1][0] == library.encode(EDGE[0][1], add_special_tokens=False).ids


@pytest.mark.parametrize("block_bytes", [1, 100, token_counts.BLOCK_BYTES])
def test_token_counts(edge, nothing, block_bytes):
    library = Tokenizer.from_file(BYTE)
    expected = []
    for i, text in EDGE:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((i, len((text or "").encode()), n, n > 512))
    found = token_counts.token_counts(edge, BYTE, block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert token_counts.token_counts(nothing, BYTE).collect() == []


def test_token_counts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(BYTE)
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, BYTE).collect()}
    assert found == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
