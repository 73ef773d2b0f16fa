"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary file (JSON of the tokenizers library, the same vocabulary as the
rank file of that name; tests compare the ids) is a parameter.  A text is
cut before each whitespace run: no match of the split pattern spans such a cut
and merges stay inside one match, so the ids of a text are those of its pieces,
and a piece seen before needs no second encoding.  New pieces are encoded
together and told apart by the byte lengths of their tokens.

Defined cases: a null text counts as empty and has no ids; special-token
strings in a text are ordinary text; any text length is processed whole.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.storage import with_fields

#: White_Space of Unicode (fixed values), as in the split pattern.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LOOSE = re.compile(f"[{SPACE}](?:[{SPACE}]|\\Z)|\\A[{SPACE}]")
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: Pieces remembered by a worker (bounds its memory, never changes a result), and pieces encoded together.
CACHE_PIECES = 400_000
TOGETHER = 2_000


def byte_to_char() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class ByteBpe:
    """A byte-level vocabulary with a piece cache; made once a worker by ``load``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {c: b for b, c in byte_to_char().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.spaced: dict[str, bytes] = {}  # of " " + piece, or of the piece if it starts with a line break
        self.chunks: dict[str, bytes] = {}  # of other pieces, with their own white space

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that each start with one white space character, encoded together."""
        found = {}
        for at in range(0, len(pieces), TOGETHER):
            part = pieces[at : at + TOGETHER]
            texts = [p if p[0] == "\n" else " " + p for p in part]
            ids = self._ids("".join(texts))
            ends = np.cumsum([len(t.encode()) for t in texts])
            reached = np.cumsum(self.length_of[ids])
            cuts = np.searchsorted(reached, ends) + 1
            start = 0
            for piece, cut in zip(part, cuts.tolist(), strict=True):
                found[piece] = ids[start:cut].tobytes()
                start = cut
        return found

    def _chunk(self, chunk: str) -> bytes:
        got = self.chunks.get(chunk)
        if got is None:
            got = self._ids(chunk).tobytes()
            if len(self.chunks) < CACHE_PIECES // 4:
                self.chunks[chunk] = got
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str] | None] = [None if not t or _LOOSE.search(t) else t.replace("\n", " \n").split(" ") for t in texts]
        known = self.spaced
        new = {p for pieces in cut if pieces for p in pieces[1:] if p not in known}
        if len(known) + len(new) > CACHE_PIECES:  # pieces of older texts make room
            known.clear()
            new = {p for pieces in cut if pieces for p in pieces[1:]}
        known.update(self._learn(sorted(new)))
        out = []
        for text, pieces in zip(texts, cut, strict=True):
            if pieces:
                out.append(self._chunk(pieces[0]) + b"".join(map(known.__getitem__, pieces[1:])))
            else:
                out.append(b"".join(map(self._chunk, _CHUNK.findall(text))))
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> list[int]:
        """Character at which each token starts; a token inside a split character has that character's place."""
        encoded = np.frombuffer(text.encode(), np.uint8)
        char_at = np.cumsum((encoded & 0xC0) != 0x80) - 1
        lengths = self.length_of[np.frombuffer(ids, "<u4")]
        return char_at[np.cumsum(lengths) - lengths].tolist()


def decode_stream(parts: Iterable[bytes]) -> str:
    """Text of byte pieces whose characters may be split between them; broken bytes become U+FFFD."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join([reader.decode(p) for p in parts]) + reader.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def local_copy(path: str) -> str:
    """A vocabulary file on this worker: the path itself where it exists, else the copy Spark distributed."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", with_offsets: bool = False, round_trip: bool = False) -> DataFrame:
    """``df`` with the ids of ``text`` (binary, little-endian unsigned 32 bit) and ``n_tokens``.

    If asked, with token ``offsets``, and with ``decoded_sha256`` of the bytes that the ids decode to.

    Columns of ``df`` that have one of these names are replaced.
    """
    added = [ids, "n_tokens", *["offsets"] * with_offsets, *["decoded_sha256"] * round_trip]
    kept = df.drop(*added)
    schema = with_fields(kept, (ids, "binary"), ("n_tokens", "long"), *[("offsets", "array<int>")] * with_offsets, *[("decoded_sha256", "string")] * round_trip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(local_copy(vocabulary))
        for batch in batches:
            for part in parts(batch):
                texts = texts_of(part.column(part.schema.get_field_index(text)))
                got = bpe.encode(texts)
                columns = [*part.columns, pa.array(got, pa.binary()), pa.array([len(g) // 4 for g in got], pa.int64())]
                if with_offsets:
                    columns.append(pa.array([bpe.offsets(t, g) for t, g in zip(texts, got, strict=True)], pa.list_(pa.int32())))
                if round_trip:
                    columns.append(pa.array([hashlib.sha256(bpe.decode_bytes(g)).hexdigest() for g in got]))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "decoded", as_text: bool = True) -> DataFrame:
    """``df`` with the decoded text (or bytes) of an id column; null ids decode to nothing."""
    kept = df.drop(out)
    schema = with_fields(kept, (out, "string" if as_text else "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(local_copy(vocabulary))
        for batch in batches:
            for part in parts(batch):
                got = [bpe.decode_bytes(i or b"") for i in part.column(part.schema.get_field_index(ids)).to_pylist()]
                column = pa.array([decode_stream([g]) for g in got], pa.string()) if as_text else pa.array(got, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out])

    return kept.mapInArrow(run, schema)


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a whole-text round trip of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(local_copy(vocabulary))
        for batch in batches:
            for part in parts(batch):
                got = bpe.encode(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(g) // 4 for g in got], pa.int64()),
                        pa.array([hashlib.sha256(g).hexdigest() for g in got]),
                        pa.array([hashlib.sha256(bpe.decode_bytes(g)).hexdigest() for g in got]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
