"""Operators 1, 8 and 10 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import bitplanes, token_counts, trie_bpe
from tideline.llm.bpe_vocab import vocabulary
from tideline.llm.catalog import BYTE_BPE, QUERIES, WORD_BPE

ALPHABET = "aAbcéĠ ñ'st  \n\t\x1c\x85\xa0漢ﬁ1½²Ⅷ<|endoftext|>!_-—😀İΣ́"


def noise(n, seed=3):
    g = random.Random(seed)
    return ["".join(g.choice(ALPHABET) for _ in range(g.randint(0, 60))) + g.choice(["", " ", "<|endoftext|>", " <|startoftext|> x", "don't we'LL"]) for _ in range(n)]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE_BPE)


def test_trie_encoding_and_decoding_of_odd_texts(word):
    e, texts = trie_bpe.encoder(WORD_BPE), noise(1500)
    for t, (ids, decoded) in zip(texts, e.encode_batch(texts), strict=True):
        want = word.encode(t, add_special_tokens=False).ids
        assert list(np.frombuffer(ids, "<u4")) == want and decoded == word.decode(want, skip_special_tokens=False) == e.decode(want)


def test_heap_counts_of_odd_texts(word):
    v = vocabulary(WORD_BPE)
    for t in noise(1500, 4):
        assert token_counts.count_text(t, v, {}, {}) == len(word.encode(t, add_special_tokens=False).ids)


def test_caches_do_not_matter(word, monkeypatch):
    monkeypatch.setattr(trie_bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(trie_bpe, "CACHED_PAIRS", 3)
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 3)
    e, v, known, pieces = trie_bpe.TrieEncoder(vocabulary(WORD_BPE)), vocabulary(WORD_BPE), {}, {}
    for t in noise(60, 5):
        want = word.encode(t, add_special_tokens=False).ids
        assert list(np.frombuffer(e.encode_batch([t])[0][0], "<u4")) == want and token_counts.count_text(t, v, known, pieces) == len(want)


def test_cached_tokenizer(byte):
    c, texts = bitplanes.CachedTokenizer(BYTE_BPE), noise(1500, 6)
    for t, ids in zip(texts, c.encode_batch(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == byte.encode(t, add_special_tokens=False).ids


def test_planes_round_trip():
    g = np.random.default_rng(1)
    for n, top in ((0, 2), (1, 2), (7, 2), (1000, 60_000), (65_536, 2**31)):
        ids = g.integers(0, top, n).astype("<u4")
        assert np.array_equal(bitplanes.from_planes(bitplanes.to_planes(ids), n), ids)


def test_joined_crc():
    g = random.Random(2)
    for _ in range(50):
        a, b = g.randbytes(g.randint(0, 50)), g.randbytes(g.randint(0, 300))
        assert bitplanes.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [5, 64, 65_536])
def test_files_of_odd_rows(spark, odd, byte, block):
    got = [tuple(r) for r in bitplanes.shuffled_planes(odd, BYTE_BPE, block).orderBy("start").collect()]
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    start, want = 0, []
    for i, t in rows:
        ids = np.array([*byte.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == want


def test_empty_tables(spark, empty):
    assert bitplanes.shuffled_planes(empty, BYTE_BPE).count() == 0
    assert token_counts.count_tokens(empty, WORD_BPE).count() == 0
    assert trie_bpe.encode(empty, WORD_BPE).count() == 0


def test_odd_rows(odd, word):
    for r in trie_bpe.encode(odd, WORD_BPE).collect():
        assert list(r.ids) == word.encode(r.text or "", add_special_tokens=False).ids
    for r in token_counts.count_tokens(odd, WORD_BPE, limit=100).collect():
        n = len(word.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 100, len((r.text or "").encode()))


def test_queries(spark, sf, word, byte):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: word.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in QUERIES["op8_heap_token_counts"](spark, sf).collect():
        assert r.n_tokens == len(ids[r.doc_id])
    for r in QUERIES["op10_trie_bpe"](spark, sf).collect():
        raw = np.array(ids[r.doc_id], "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(word.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in QUERIES["op1_bit_plane_shuffle"](spark, sf).collect()}
    for i, t in texts.items():
        raw = np.array([*byte.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert got[i] == (len(raw) // 4, zlib.crc32(raw))


def test_a_task_lets_its_encoder_go(spark, odd, odd_rows, word, monkeypatch):
    """Workers outlive a task, and the next task of an executor may come to another one: encoders that stay would add up."""
    monkeypatch.setattr(trie_bpe, "ROWS", 2)
    monkeypatch.setattr(trie_bpe, "BATCH_CHARS", 100)
    rows = trie_bpe.encoded_rows(odd, WORD_BPE).collect()
    want = [(i, word.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in odd_rows]
    assert sorted([(r.doc_id, list(r.ids)) for r in rows], key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == len(r.ids) for r in rows)

    def held(batches):
        from tideline.llm import common

        for pdf in batches:
            yield pdf.assign(held=",".join(common._store))

    left = odd.select("doc_id").mapInPandas(held, "doc_id long, held string")
    assert not any("trie" in r.held for r in left.collect())


def test_a_word_that_is_one_token_costs_one_check(word, monkeypatch):
    """States are worked out when asked for, the longest token first: whole words leave those of their prefixes alone."""
    v = vocabulary(WORD_BPE)
    whole = sorted(t.removesuffix(v.end) for t in v.ids if t.endswith(v.end) and t.removesuffix(v.end).isalpha() and t.isascii() and len(t) > 12)[:500]
    e, checked = trie_bpe.TrieEncoder(v), []
    monkeypatch.setattr(e, "merged", lambda symbols, f=e.merged: checked.append(len(symbols)) or f(symbols))
    found = e.encode_pieces(whole)
    assert {w: list(np.frombuffer(b, "<u4")) for w, b in found.items()} == {w: word.encode(w, add_special_tokens=False).ids for w in whole}
    assert len(checked) == len(whole)


def test_long_words_and_shared_prefixes(word):
    g = random.Random(8)
    stems = ["".join(g.choice("aeinrst") for _ in range(g.randint(1, 9))) for _ in range(40)]
    words = ["a" * 3000, "ab" * 1500, "é" * 1500, *("".join(g.choices(stems, k=g.randint(1, 60))) for _ in range(800))]
    texts = [" ".join(words), *words, *(w[:-1] for w in words if len(w) > 1), "ÀÉÎ ĮįĬİı ŒŸ ǅ", "Éa\u0301x ª º ß×÷µ"]
    for t, (ids, _) in zip(texts, trie_bpe.TrieEncoder(vocabulary(WORD_BPE)).encode_batch(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == word.encode(t, add_special_tokens=False).ids
