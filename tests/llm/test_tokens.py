import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noveltybench.llm import byte_bpe, packed_ids

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab'sÉİß. \n\t\x1c\x85 　 \x01\x00<|endoftext|>12!漢😀́'ll"


def texts(n=3000):
    rnd = random.Random(8)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", " ", "\n", "a\n", "  a", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(reference, monkeypatch):
    found = texts()
    for most in (byte_bpe.CACHE_PIECES, 100):  # with and without room in the cache
        monkeypatch.setattr(byte_bpe, "CACHE_PIECES", most)
        bpe = byte_bpe.ByteBpe(BYTE_BPE)
        for at in range(0, len(found), 100):
            part = found[at : at + 100]
            for text, ids in zip(part, bpe.encode(part), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), repr(text)
                assert bpe.decode_bytes(ids) == text.encode()


def test_offsets_and_split_characters(reference):
    bpe = byte_bpe.load(BYTE_BPE)
    text = "Hé 😀 漢字 end"
    ids = bpe.encode([text])[0]
    pieces = [bpe.bytes_of[i] for i in np.frombuffer(ids, "<u4")]
    starts = bpe.offsets(text, ids)
    assert starts[0] == 0 and starts == sorted(starts) and len(starts) == len(pieces)
    assert byte_bpe.decode_stream(pieces) == text
    assert byte_bpe.decode_stream(pieces[:-1] + [b"\xff"]).endswith("�")


def test_byte_bpe_rows(odd_docs, no_docs, reference):
    rows = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for r in byte_bpe.digest(odd_docs, BYTE_BPE).collect():
        ids = reference.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.digest(no_docs, BYTE_BPE).collect() == []
    both = byte_bpe.decode(byte_bpe.encode(odd_docs, BYTE_BPE, with_offsets=True, round_trip=True), BYTE_BPE)
    assert all(r["decoded"] == (r["text"] or "") and len(r["offsets"]) == r["n_tokens"] for r in both.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60_000), max_size=700), st.data())
def test_packing_round_trip(values, data):
    ids = np.array(values, np.uint32)
    shard = packed_ids.pack(ids)
    assert packed_ids.unpack(shard).tolist() == values
    first = data.draw(st.integers(0, len(values)))
    count = data.draw(st.integers(0, len(values) - first))
    assert packed_ids.unpack(shard, first, count).tolist() == values[first : first + count]


def test_packing_is_narrow():
    ids = np.random.default_rng(1).integers(1000, 1256, 128 * 100, dtype=np.uint32)
    ids[::128] = 40_000
    assert len(packed_ids.pack(ids)) < 1.4 * len(ids)
    with pytest.raises(ValueError):
        packed_ids.unpack(b"XXXX" + packed_ids.pack(ids)[4:])


def test_word_bpe_equals_the_library(monkeypatch):
    library, found = Tokenizer.from_file(WORD_BPE), texts()
    rnd = random.Random(9)
    parts = ["The", "it's", "'S", ",", ".", "!!", "...", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "|>", " ", "  ", "\n", "=\u0338", "e\u0301", "\u0130", "\u0915\u093c", "1", "word" * 9, "x" * 24, "y" * 25]
    found += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    for most in (packed_ids.CACHE_PIECES, 100):
        monkeypatch.setattr(packed_ids, "CACHE_PIECES", most)
        bpe = packed_ids.WordBpe(WORD_BPE)
        for at in range(0, len(found), 100):
            part = found[at : at + 100]
            for first, last, ids, many in bpe.encode(pa.array(part)):
                for text, got in zip(part[first:last], np.split(ids, np.cumsum(many)[:-1]), strict=True):
                    assert got.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(packed_ids.PieceTable, "hashes", staticmethod(lambda keys: np.zeros(len(keys), np.uint64)))
    library = Tokenizer.from_file(WORD_BPE)
    text = "one two three two one, longer-than-twenty-four-bytes one"
    ((_, _, ids, many),) = packed_ids.WordBpe(WORD_BPE).encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and many.tolist() == [len(ids)]


def test_packed_rows(spark, odd_docs, no_docs, monkeypatch):
    library = Tokenizer.from_file(WORD_BPE)
    docs = odd_docs.select("doc_id", "text", "lang")
    want, before = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    got = packed_ids.digest(docs, WORD_BPE).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert packed_ids.digest(no_docs, WORD_BPE).collect() == []
