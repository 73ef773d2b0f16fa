"""Token ids in patched frame-of-reference blocks.

Ids come from a tokenizers vocabulary file.  A shard is one binary value: blocks
of BLOCK ids, each with its minimum subtracted and packed at the width that
holds PERCENTILE of its values; values that don't fit leave their high bits in
an exception list.  An index holds where each block starts, so any range of ids
can be read without the rest.

Shards are rows of a Parquet table in ascending document order, written and read
by Spark alone, with the documents' ids and lengths beside them.

Layout of a shard (little-endian): "NBPF", version, BLOCK, ids (u64), then per
block minimum (u32), width (u8), exceptions (u8), start of its packed words
(u32) and of its exceptions (u32); then packed words (u32), exception places
(u8) and high parts (u32).

Defined cases: a null text counts as empty (only the end id); null document ids
come first; rows that share an id stand in a fixed order of their texts; an
empty table gives an empty shard table.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.byte_bpe import local_copy
from noveltybench.llm.storage import new_path
from noveltybench.llm.textops import LOWER, mix, slices, text_buffer

BLOCK, PERCENTILE = 128, 0.9
#: Ids after which a shard ends.
SHARD_IDS = 1 << 20
END_ID = 2
_HEAD = struct.Struct("<4sIIQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of BLOCK * width / 32 words."""
    lanes = BLOCK // 32
    v = np.ascontiguousarray(values.reshape(-1, 32, lanes).transpose(1, 0, 2))
    out = np.zeros((width, len(values), lanes), np.uint32)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        out[word] |= v[i] << np.uint32(shift)
        if shift + width > 32:
            out[word + 1] |= v[i] >> np.uint32(32 - shift)
    return out.transpose(1, 0, 2).reshape(len(values), width * lanes)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = BLOCK // 32
    w = np.ascontiguousarray(words.reshape(-1, width, lanes).transpose(1, 0, 2))
    out = np.empty((32, len(words), lanes), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        v = w[word] >> np.uint32(shift)
        if shift + width > 32:
            v |= w[word + 1] << np.uint32(32 - shift)
        out[i] = v & mask
    return out.transpose(1, 0, 2).reshape(len(words), BLOCK)


def pack(ids: np.ndarray) -> bytes:
    """A shard of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # bits each value needs
    at = int(np.ceil(BLOCK * PERCENTILE)) - 1
    width = np.partition(bits, at, axis=1)[:, at] if blocks else np.zeros(0, np.int64)
    over = bits > width[:, None]
    place = np.nonzero(over)
    many = over.sum(axis=1)
    words = width * (BLOCK // 32)
    start = np.cumsum(words) - words
    packed = np.zeros(int(words.sum()), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            mask = np.uint32((1 << w) - 1)
            packed[start[rows][:, None] + np.arange(w * (BLOCK // 32))] = _pack(rest[rows] & mask, w)
    high = (rest[place] >> width[place[0]].astype(np.uint32)).astype("<u4")
    index = np.zeros(blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("many", "u1"), ("word", "<u4"), ("exception", "<u4")]))
    index["low"], index["width"], index["many"] = low, width, many
    index["word"], index["exception"] = start, np.cumsum(many) - many
    return b"".join([_HEAD.pack(b"NBPF", 1, BLOCK, n), index.tobytes(), packed.astype("<u4").tobytes(), place[1].astype(np.uint8).tobytes(), high.tobytes()])


def unpack(shard: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids first .. first + count of a shard; only the blocks that hold them are read."""
    magic, version, block, n = _HEAD.unpack_from(shard)
    if magic != b"NBPF" or version != 1 or block != BLOCK:
        raise ValueError("not a shard of this kind")
    count = n - first if count is None else count
    if first < 0 or count < 0 or first + count > n:
        raise ValueError(f"ids {first}..{first + count} of {n}")
    blocks = -(-n // BLOCK)
    kind = np.dtype([("low", "<u4"), ("width", "u1"), ("many", "u1"), ("word", "<u4"), ("exception", "<u4")])
    index = np.frombuffer(shard, kind, blocks, _HEAD.size)
    at = _HEAD.size + kind.itemsize * blocks
    total = int(index["word"][-1]) + int(index["width"][-1]) * (BLOCK // 32) if blocks else 0
    packed = np.frombuffer(shard, "<u4", total, at)
    at += 4 * total
    exceptions = int(index["exception"][-1]) + int(index["many"][-1]) if blocks else 0
    places = np.frombuffer(shard, np.uint8, exceptions, at)
    highs = np.frombuffer(shard, "<u4", exceptions, at + exceptions)
    a, b = first // BLOCK, -(-(first + count) // BLOCK)
    chosen = index[a:b]
    out = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(chosen["width"]).tolist():
        if w:
            rows = np.flatnonzero(chosen["width"] == w)
            out[rows] = _unpack(packed[chosen["word"][rows][:, None].astype(np.int64) + np.arange(w * (BLOCK // 32))], w)
    if len(chosen) and (total_here := int(chosen["many"].sum())):
        start = int(chosen["exception"][0])
        row = np.repeat(np.arange(len(chosen)), chosen["many"])
        out[row, places[start : start + total_here]] |= highs[start : start + total_here] << chosen["width"][row].astype(np.uint32)
    out += chosen["low"][:, None]
    return out.ravel()[first - a * BLOCK : first - a * BLOCK + count]


#: Pieces a worker remembers (bounds its memory, never changes a result), and pieces encoded together.
CACHE_PIECES = 2_000_000
TOGETHER = 2_000
#: Bytes of a piece that its key holds; longer pieces are remembered by themselves.
KEY_BYTES = 24
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Classes of lower-cased bytes: white space, letters, marks that are splits of their own beside letters, all others.
_SPACE, _LETTER, _MARK, _OTHER = 0, 1, 2, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[97:123] = _LETTER
_CLASS[np.frombuffer(b".,;:!?*#$%&", np.uint8)] = _MARK
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class PieceTable:
    """Token ids of pieces in flat arrays: an open-addressing table from a piece's bytes and length to its ids."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << 13, -1, np.int32)
        self.n, self.n_ids = 0, 0
        self.keys = np.zeros((1 << 12, KEY_BYTES // 8 + 1), np.uint64)  # the bytes, and the length
        self.at = np.zeros(1 << 12, np.int64)  # of the first id
        self.many = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.long: dict[bytes, int] = {}

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0]
        for k in range(1, keys.shape[1]):
            h = mix(h) ^ keys[:, k]
        return mix(h)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slot, found, open_ = self._home(hashes), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(open_):
            entry = self.slots[slot[open_]]
            open_, entry = open_[entry >= 0], entry[entry >= 0]
            same = (self.keys[entry] == keys[open_]).all(axis=1)
            found[open_[same]] = entry[same]
            open_ = open_[~same]
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
        return found

    def add(self, ids: np.ndarray, many: np.ndarray) -> np.ndarray:
        """New entries with so many of these ids each, as yet without keys."""
        entries = np.arange(self.n, self.n + len(many))
        before = self.n_ids
        self.n, self.n_ids = self.n + len(many), before + len(ids)
        for name, least in (("keys", self.n), ("at", self.n), ("many", self.n), ("ids", self.n_ids)):
            held = getattr(self, name)
            if len(held) < least:
                setattr(self, name, np.concatenate([held, np.zeros((max(least, 2 * len(held)) - len(held), *held.shape[1:]), held.dtype)]))
        self.at[entries], self.many[entries] = before + np.cumsum(many) - many, many
        self.ids[before : self.n_ids] = ids
        return entries

    def key(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Files entries under keys that are new and differ from each other."""
        self.keys[entries] = keys
        if 2 * self.n > len(self.slots):  # at most half full, so that a search ends soon
            self.slots = np.full(1 << int(4 * self.n).bit_length(), -1, np.int32)
            entries = np.flatnonzero(self.keys[: self.n, -1])
        slot, open_ = self._home(self.hashes(self.keys[entries])), np.arange(len(entries))
        while len(open_):
            free = open_[self.slots[slot[open_]] < 0]
            self.slots[slot[free]] = entries[free]
            open_ = open_[self.slots[slot[open_]] != entries[open_]]  # taken, maybe by another of these
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)

    def take(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the entries, one after the other."""
        many = self.many[entries]
        ends = np.cumsum(many)
        return self.ids[np.repeat(self.at[entries] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordBpe:
    """A vocabulary with word-end tokens whose splits never span white space.

    Texts are cut at white space and between letters a-z and marks, where splits always end, so a text's ids are those
    of its pieces.  Pieces seen before are looked up, all of a slice at once.  Texts that may hold special tokens are
    encoded whole by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_split = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_split[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.table = PieceTable(CACHE_PIECES)

    def _each(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, encoded on its own."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(ids, how many of each piece, order of the pieces).

        Words of plain letters are one split each, so many are encoded as one text and told apart; they come first.
        """
        plain = [i for i, p in enumerate(pieces) if p.isalpha() or _LETTERS.fullmatch(p.decode())]
        other = sorted(set(range(len(pieces))).difference(plain))
        ids, many = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            ids.append(np.array(self._each([b" ".join([pieces[i] for i in part]).decode()])[0], np.uint32))
            many.append(np.diff(np.flatnonzero(self.ends_split[ids[-1]]), prepend=-1))
            if len(many[-1]) != len(part):
                raise ValueError("a word of letters is not one split of this vocabulary")
        for at in range(0, len(other), TOGETHER):
            found = self._each([pieces[i].decode() for i in other[at : at + TOGETHER]])
            ids.append(np.array([i for f in found for i in f], np.uint32))
            many.append(np.array([len(f) for f in found]))
        return np.concatenate(ids), np.concatenate(many), plain + other

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """New entries for the pieces, as yet without keys."""
        ids, many, order = self._encode(pieces)
        entries = np.empty(len(pieces), np.int64)
        entries[order] = self.table.add(ids, many)
        return entries

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table entries of the pieces; ``data`` has KEY_BYTES bytes to spare."""
        table, lengths = self.table, ends - starts
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        keys = np.empty((len(starts), KEY_BYTES // 8 + 1), np.uint64)
        for k in range(KEY_BYTES // 8):
            keys[:, k] = words[starts + 8 * k * (lengths > 8 * k)] & _LOW_BYTES[np.clip(lengths - 8 * k, 0, 8)]
        keys[:, -1] = lengths
        hashes = table.hashes(keys)
        found = table.find(keys, hashes)
        long = np.flatnonzero(lengths > KEY_BYTES)
        names = [data[s:e].tobytes() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        fresh = sorted(set(names).difference(table.long))
        if len(fresh):
            table.long.update(zip(fresh, self._learn(fresh).tolist(), strict=True))
        found[long] = [table.long[name] for name in names]
        open_ = np.flatnonzero(found < 0)
        while len(open_):  # once, but for keys of one hash
            new = open_[np.unique(hashes[open_], return_index=True)[1]]
            entries = self._learn([data[s:e].tobytes() for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            table.key(keys[new], entries)
            found[open_] = table.find(keys[open_], hashes[open_])
            open_ = open_[found[open_] < 0]
        return found

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids of these rows, ids of each row) of a text column, whole texts, by bounded slices."""
        data, offsets = text_buffer(column)
        for first, last in slices(offsets):
            at = offsets[first : last + 1] - offsets[first]
            raw = data[offsets[first] : offsets[last]]
            low = np.append(LOWER[raw], np.zeros(KEY_BYTES, np.uint8))
            kind = _CLASS[low[: len(raw)]]
            edge = np.ones(len(raw) + 1, bool)
            edge[1:-1] = ((kind[1:] | kind[:-1]) == _LETTER | _MARK) | ((kind[1:] == _SPACE) != (kind[:-1] == _SPACE))
            edge[at] = True
            cuts = np.flatnonzero(edge)
            starts, ends = cuts[:-1], cuts[1:]
            good = kind[starts] != _SPACE if len(raw) else np.zeros(len(starts), bool)
            starts, ends = starts[good], ends[good]
            if self.table.n > self.table.most:
                self.table.clear()
            entries = self._entries(low, starts, ends)
            ids = self.table.take(entries)
            before = np.concatenate([[0], np.cumsum(self.table.many[entries])])[np.searchsorted(starts, at)]
            text = raw.tobytes()
            if b"<|" in text:
                rows = np.split(ids, before[1:-1])
                for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if b"<|" in text[a:b]:
                        rows[row] = np.array(self._each([text[a:b].decode()])[0], np.uint32)
                ids, before = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            yield first, last, ids, np.diff(before)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


SHARDS = "part int, local_start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, shard binary"


def shards(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Shard rows in ascending document order; ``part`` numbers the range partitions in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, done = load(local_copy(vocabulary)), TaskContext.get().partitionId(), 0
        names, lengths, ids, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            values = [part, done, size, pa.concat_arrays(names), np.concatenate(lengths), pack(np.concatenate(ids))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SHARDS.split(", ")])

        for batch in batches:
            for first, last, found, many in bpe.encode(batch.column(1)):
                ends = np.cumsum(many + 1)
                closed = np.full(int(ends[-1]), end_id, np.uint32)
                closed[np.arange(len(found)) + np.repeat(np.arange(len(many)), many)] = found
                names.append(batch.column(0).slice(first, last - first))
                lengths.append(many + 1)
                ids.append(closed)
                size += len(closed)
                if size >= SHARD_IDS:
                    yield shard()
                    done += size
                    names, lengths, ids, size = [], [], [], 0
        if names:
            yield shard()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Texts by hash within an id, so that many rows of one id, or without one, are dealt over tasks too.
    order = ["doc_id", F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, SHARDS)


def write(docs: DataFrame, vocabulary: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Writes the shard table of ``docs`` to ``path``."""
    shards(docs, vocabulary, key, text, end_id).write.parquet(path)


def offsets(table: DataFrame) -> dict[int, int]:
    """Ids before each range partition; as many entries as partitions."""
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    out, before = {}, 0
    for part, n in totals:
        out[part] = before
        before += n
    return out


def read(table: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, the ids (binary) of each document of a shard table."""
    before = offsets(table)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", token_ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["shard"]).astype("<u4").tobytes()
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                pieces = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths + row["local_start"] + before[row["part"]]), pa.array(lengths), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.binary()))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return table.mapInArrow(run, schema)


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the written shard table."""
    path = new_path(docs.sparkSession, "ids")
    write(docs, vocabulary, path)
    return read(docs.sparkSession.read.schema(SHARDS).parquet(path), with_ids=False)
