"""Cross-tokenizer alignment: pandas ``merge_asof`` per batch, keyed by document.

Each text is encoded by a byte-level BPE (side A: space + text) and by a piece model that adds that space itself
(side B).  Token starts are byte places.  ``merge_asof`` by document finds for each token start of one side the other
side's covering token; the union of both directions are the overlaps (links), and places where tokens of both sides end
cut the tokens into groups.  Batches are cut into slices of about SLICE bytes of text.

Counts of linked id pairs over documents are summed in Spark.  The documents' counts are looked up in a sorted table that
is broadcast where it has MOST_PAIRS rows at most (counted first), and joined by pair beyond that.

The byte-level ids come from the tiktoken library with the ranks of the given vocabulary file (tests compare them with
the tokenizers library), as it takes under half the time.

Defined cases: a text that is null or empty, or whose tokens' bytes on either side are not space + text (a text with
U+2581, say), has no tokens: zeros and an empty digest.  Special-token strings are plain text.  Rows that repeat an id,
or have none, are documents of their own.  Columns named like results are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noveltybench.llm import byte_bpe
from noveltybench.llm.storage import stored, with_fields

#: Bytes of text aligned together, and rows of the broadcast pair table (17 bytes each); neither changes a result.
SLICE, MOST_PAIRS = 1 << 20, 2_000_000
#: The split pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Sides:
    """Both tokenizers of a worker: ids of space + text, and what bytes an id stands for."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        import sentencepiece
        import tiktoken

        self.path = byte_vocabulary
        with open(byte_vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        back = {c: b for b, c in byte_bpe.byte_to_char().items()}
        ranks = {bytes(map(back.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the byte vocabulary does not hold every byte")
        # merges are in the order of their results' ids, so the ids are ranks; no text is left out, as all bytes have ids
        self.encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        self.lengths = (lengths, np.array([len(p) for p in self.pieces], np.int64))
        self.marked = [f"{i}{mark}".encode() for mark in ",|;" for i in range(max(map(len, self.lengths)))]

    def byte_ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        except ValueError:  # its pattern can't take a run of a million spaces; the slower library can
            return np.frombuffer(byte_bpe.load(self.path).encode([text])[0], "<i4")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of either side; nothing for both where the pieces' bytes are not space + text."""
        left, right = [], []
        for text, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True):
            sound = text and b"".join(map(self.pieces.__getitem__, ids)) == b" " + text.encode()
            left.append(self.byte_ids(" " + text) if sound else np.zeros(0, np.int32))
            right.append(np.array(ids if sound else [], np.int32))
        return left, right


@lru_cache(maxsize=2)
def load(byte_vocabulary: str, piece_model: str) -> Sides:
    return Sides(byte_vocabulary, piece_model)


class Aligned(NamedTuple):
    """Tokens of some documents, one after the other, and how they overlap."""

    ids: tuple[np.ndarray, np.ndarray]
    first: tuple[np.ndarray, np.ndarray]  # each document's first token of either side (n + 1 values)
    links: tuple[np.ndarray, np.ndarray]  # token numbers of either side
    first_group: np.ndarray  # each document's first group (n + 1 values)
    group_ends: tuple[np.ndarray, np.ndarray]  # tokens of either side up to the end of each group


def align(sides: Sides, texts: list[str]) -> Aligned:
    tokens, first, ids, ends = [], [], [], []
    for lengths, found in zip(sides.lengths, sides.encode(texts), strict=True):
        flat = np.concatenate([*found, np.zeros(0, np.int32)])
        sizes = np.array([len(f) for f in found], np.int64)
        reached = np.cumsum(lengths[flat])  # places run on from document to document
        ids.append(flat)
        ends.append(reached)
        first.append(np.concatenate([[0], np.cumsum(sizes)]))
        tokens.append(pd.DataFrame({"doc": np.repeat(np.arange(len(texts)), sizes), "start": reached - lengths[flat], "token": np.arange(len(flat))}))
    a, b = tokens
    forth = pd.merge_asof(a, b.rename(columns={"token": "other"}), on="start", by="doc")  # the B token over each A start
    back = pd.merge_asof(b, a.rename(columns={"token": "other"}), on="start", by="doc")
    starts = a["start"].to_numpy()[back["other"].to_numpy()] if len(back) else np.zeros(0, np.int64)
    new = starts < b["start"].to_numpy()  # at equal starts the pair is known from the other direction
    links = (np.concatenate([forth["token"].to_numpy(), back["other"].to_numpy()[new]]), np.concatenate([forth["other"].to_numpy(), back["token"].to_numpy()[new]]))
    shared = np.intersect1d(ends[0], ends[1], assume_unique=True)
    group_ends = tuple(np.searchsorted(e, shared) + 1 for e in ends)
    return Aligned(tuple(ids), tuple(first), links, np.searchsorted(group_ends[0], first[0], side="right"), group_ends)


def groups_text(sides: Sides, found: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document: every token's number and the mark after it, put in their places."""
    ends_a, ends_b = found.group_ends
    sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    at_a = np.arange(len(found.ids[0])) + np.repeat(ends_b - sizes_b, sizes_a)
    at_b = np.arange(len(found.ids[1])) + np.repeat(ends_a, sizes_b)
    numbers = len(sides.marked) // 3
    out = np.zeros(len(at_a) + len(at_b), np.int64)
    out[at_a], out[at_b] = found.ids[0], found.ids[1]
    out[at_a[ends_a - 1]] += numbers
    out[at_b[ends_b - 1]] += 2 * numbers
    first = (found.first[0] + found.first[1]).tolist()
    marked = list(map(sides.marked.__getitem__, out.tolist()))
    return [b"".join(marked[i:j])[:-1] for i, j in zip(first, first[1:], strict=False)]


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of about SLICE bytes of text."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    reached, first = np.concatenate([[0], np.cumsum(sizes)]), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(reached, reached[first] + SLICE, side="right")) - 1)
        last = min(last, batch.num_rows, first + 1_000)
        part = batch.slice(first, last - first)
        yield part, [t or "" for t in part.column(text).to_pylist()]
        first = last


def _lists(values: list[pa.Array | np.ndarray], first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in values[1:]], names=values[0]))


def alignments(df: DataFrame, byte_vocabulary: str, piece_model: str, text: str = "text") -> DataFrame:
    """``df`` with ``a_ids``, ``b_ids``, ``links`` (numbers of overlapping tokens a, b in the document) and ``groups``
    (how many tokens a, b stand before the end of each group)."""
    added = ["a_ids", "b_ids", "links", "groups"]
    kept = df.drop(*added)
    schema = with_fields(kept, ("a_ids", "array<int>"), ("b_ids", "array<int>"), ("links", "array<struct<a:int,b:int>>"), ("groups", "array<struct<a:int,b:int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = load(byte_bpe.local_copy(byte_vocabulary), byte_bpe.local_copy(piece_model))
        for batch in batches:
            for part, texts in _slices(batch, batch.schema.get_field_index(text)):
                found = align(sides, texts)
                (a0, b0), (a, b) = found.first, found.links
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                doc = np.searchsorted(a0, a, side="right") - 1
                of = np.repeat(np.arange(len(texts)), np.diff(found.first_group))
                columns = [pa.ListArray.from_arrays(pa.array(f, pa.int32()), pa.array(i, pa.int32())) for f, i in zip(found.first, found.ids, strict=True)]
                columns.append(_lists([["a", "b"], a - a0[doc], b - b0[doc]], np.searchsorted(doc, np.arange(len(texts) + 1))))
                columns.append(_lists([["a", "b"], found.group_ends[0] - a0[of], found.group_ends[1] - b0[of]], found.first_group))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *added])

    return kept.mapInArrow(run, schema)


def linked(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs with how often each is linked.

    A pair is a * (ids of B) + b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = load(byte_bpe.local_copy(byte_vocabulary), byte_bpe.local_copy(piece_model))
        for batch in batches:
            for part, texts in _slices(batch, 1):
                found = align(sides, texts)
                doc = np.searchsorted(found.first[0], found.links[0], side="right") - 1
                pieces = len(sides.pieces)
                space = len(sides.lengths[0]) * pieces
                keys = np.sort(doc * space + found.ids[0][found.links[0]].astype(np.int64) * pieces + found.ids[1][found.links[1]])
                at = np.flatnonzero(np.diff(keys, prepend=-1))
                times = np.diff(at, append=len(keys))
                keys = keys[at]
                first = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * space), pa.int32())
                columns = [
                    part.column(0),
                    *[pa.array(np.diff(f)) for f in (*found.first, found.first_group)],
                    pa.array(np.bincount(doc, minlength=len(texts))),
                    pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups_text(sides, found)]),
                    pa.ListArray.from_arrays(first, pa.array(keys % space)),
                    pa.ListArray.from_arrays(first, pa.array(times, pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame, pairs_of_b: int) -> DataFrame:
    """pair, count (documents that hold it linked), and whether that is the highest of its A id."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    best = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / F.lit(pairs_of_b))))  # an A id has as many pairs as B has ids, at most
    return counts.withColumn("best", F.col("count") == best)


def looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with n_best and count_sum from a small pair table, broadcast as sorted arrays."""
    table = counts.orderBy("pair").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "count", "best")))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
            sizes = pa.compute.list_value_length(pairs).to_numpy()
            of = np.repeat(np.arange(batch.num_rows), sizes)
            at, n = np.searchsorted(pair, pairs.flatten().to_numpy()), times.flatten().to_numpy()
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for out, values in zip(sums, (n * best[at], n * count[at]), strict=True):
                np.add.at(out, of, values)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

    return rows.mapInArrow(run, with_fields(rows.drop("pairs", "times"), ("n_best", "long"), ("count_sum", "long")))


def joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join on pairs, for tables of any size."""
    key = F.monotonically_increasing_id()  # rows are stored: a partition's rows come in the same order each time
    numbered = rows.withColumn("__row", key)
    uses = numbered.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("use")).select("__row", F.col("use.pairs").alias("pair"), F.col("use.times").cast("long").alias("times"))
    sums = uses.join(counts.hint("merge"), "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = numbered.drop("pairs", "times").join(sums.hint("merge"), "__row", "left").drop("__row")
    return out.fillna(0, ["n_best", "count_sum"])


def digest(docs: DataFrame, byte_vocabulary: str, piece_model: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row a document."""
    import sentencepiece

    rows = stored(linked(docs, byte_vocabulary, piece_model), "token-links")
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    counts = stored(pair_counts(rows, pieces), "token-pairs")
    out = looked_up(rows, counts) if counts.count() <= most_pairs else joined(rows, counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
