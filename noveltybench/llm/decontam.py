"""Benchmark decontamination: n-gram windows of benchmark items found in training texts.

Words are runs of digits, lower-cased ASCII letters and non-ASCII bytes.  A
window is ``n`` consecutive words of an item; an item of fewer words is one
window.  The windows are written once, counted and measured, and go to the
workers as a hash set when their number is within ``MAX_BROADCAST`` and their
words and item ids within ``MAX_BYTES``; beyond either, texts are first screened
against a bitmap, sixteen bits a window and 2**MOST_BITS at most, and the
windows that remain are joined by hash.  Either way every hit is verified word
by word.

Defined cases: null or word-less texts and items have no windows and no hits;
repeated rows are each answered; an empty benchmark hits nothing; windows of
items with a null id count as hits, and only the id is missing from the items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.storage import stored, unused, with_fields
from noveltybench.llm.textops import ALNUM, LOWER, ngram_hashes, slices, text_buffer, word_hashes, word_spans

#: Most benchmark windows, and bytes of their words and item ids, that are broadcast; exponents of the least and largest bitmap (32 MB).
MAX_BROADCAST, MAX_BYTES = 200_000, 64_000_000
LEAST_BITS, MOST_BITS = 20, 28


def _row_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> bytes:
    return b" ".join([data[s:e].tobytes() for s, e in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True)])


def benchmark_windows(benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct (item, hash, n_words, words) windows of the benchmark items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            data = LOWER[data]
            starts, ends, before = word_spans(data, offsets, ALNUM)
            words = word_hashes(data, starts, ends)
            rows = set()
            for row, name in enumerate(batch.column(0).to_pylist()):
                a, b = int(before[row]), int(before[row + 1])
                size = min(n, b - a)
                if size:
                    for at, h in enumerate(ngram_hashes(words[a:b], size).view(np.int64).tolist()):
                        rows.add((name, h, size, _row_words(data, starts, ends, a + at, size)))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["item", "hash", "n", "words"])

    return benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).mapInArrow(run, "item string, hash long, n int, words binary").distinct()


class WindowSet:
    """Hashes of windows by length, and the words and items behind each hash."""

    def __init__(self, rows: list[tuple[str, int, int, bytes]]):
        self.by_hash: dict[tuple[int, int], list[tuple[bytes, str]]] = {}
        for name, h, n, words in rows:
            self.by_hash.setdefault((n, h), []).append((bytes(words), name))
        self.sorted = {n: np.array(sorted({h for m, h in self.by_hash if m == n}), np.int64).view(np.uint64) for n in {m for m, _ in self.by_hash}}
        self.sorted = {n: np.sort(v) for n, v in self.sorted.items()}
        self.screen = {}
        for n, v in self.sorted.items():
            bits = np.zeros(1 << 20, bool)
            bits[v >> np.uint64(44)] = True
            self.screen[n] = bits

    def find(self, n: int, grams: np.ndarray) -> np.ndarray:
        """Places whose hash is one of the windows of ``n`` words."""
        at = np.flatnonzero(self.screen[n][grams >> np.uint64(44)])
        known = self.sorted[n]
        where = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
        return at[known[where] == grams[at]]


class WindowRows:
    """Broadcast windows; the set is made once in a worker, not in each of its tasks."""

    def __init__(self, rows: list[tuple[str, int, int, bytes]]):
        self.rows, self.made = rows, None

    def get(self) -> WindowSet:
        if self.made is None:
            self.made = WindowSet(self.rows)
        return self.made


class BitmapSet:
    """A bitmap's view of too many windows: places that may hit."""

    def __init__(self, lengths: list[int], bits: int, at: np.ndarray, values: np.ndarray):
        self.lengths, self.bits = lengths, bits
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[at] = values.view(np.uint64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        place = grams >> np.uint64(64 - self.bits)
        return np.flatnonzero((self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))


def _slices_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, byte offset, starts, ends, words before each row) by bounded slices."""
    data, offsets = text_buffer(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        part = LOWER[data[at[0] : at[-1]]]
        yield first, last, part, at - at[0], *word_spans(part, at - at[0], ALNUM)


def _verified(windows: WindowSet, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(row, first word in the row, words, item) of each occurrence in a slice."""
    hashes = word_hashes(part, starts, ends)
    found = []
    for n in windows.sorted:
        grams = ngram_hashes(hashes, n)
        at = windows.find(n, grams)
        rows = np.searchsorted(before, at, side="right") - 1
        inside = at + n <= before[rows + 1]
        for place, row in zip(at[inside].tolist(), rows[inside].tolist(), strict=True):
            words = _row_words(part, starts, ends, place, n)
            for known, name in windows.by_hash[n, int(grams[place : place + 1].view(np.int64)[0])]:
                if known == words:
                    found.append((row, place - int(before[row]), n, name))
    return found


def _answers(column: pa.Array, hits_of, remove: bool) -> Iterator[tuple[int, int, list[tuple]]]:
    """(first, last, answers) by slice; an answer is (n_words, n_hit, items, text without hit spans or None)."""
    for first, last, part, offsets, starts, ends, before in _slices_of(column):
        hits: dict[int, list[tuple[int, int, str]]] = {}
        for row, at, n, name in hits_of(first, last, part, starts, ends, before):
            hits.setdefault(row, []).append((at, n, name))
        out = []
        for row in range(last - first):
            a, b = int(before[row]), int(before[row + 1])
            mine = hits.get(row)
            if not mine:
                out.append((b - a, 0, [], None))
                continue
            covered = np.zeros(b - a + 1, np.int32)
            for at, n, _ in mine:
                covered[at] += 1
                covered[at + n] -= 1
            hit = np.cumsum(covered[:-1]) > 0
            rest = None
            if remove:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                raw = column[first + row].as_py().encode()
                kept, done = [], 0
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    kept.append(raw[done : int(starts[a + s] - offsets[row])])
                    done = int(ends[a + e - 1] - offsets[row])
                rest = b"".join([*kept, raw[done:]]).decode("utf-8", "replace")
            out.append((b - a, int(hit.sum()), sorted({name for _, _, name in mine if name is not None}), rest))
        yield first, last, out


def mark(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", remove: bool = False, max_broadcast: int = MAX_BROADCAST, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (array, sorted) and, with ``remove``, ``clean_text`` without the hit spans.

    Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    windows = stored(benchmark_windows(benchmark, n), "windows")
    kept = docs.drop("n_words", "n_hit", "items", "clean_text")
    count, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0))).first()
    if count <= max_broadcast and size <= max_bytes:
        shared = spark.sparkContext.broadcast(WindowRows([tuple(r) for r in windows.collect()]))
        return _mark(kept, lambda: shared.value.get(), None, text, remove)
    return _mark_joined(kept, windows, count, text, remove)


def _mark(kept: DataFrame, make, hits: str | None, text: str, remove: bool) -> DataFrame:
    """Answers from a window set made in the worker, or from a column of verified hits."""
    more = [("clean_text", "string")] if remove else []
    schema = with_fields(kept.drop(hits) if hits else kept, ("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = make() if make else None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            texts = column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())

            def look(first, last, part, starts, ends, before):
                return _verified(windows, part, starts, ends, before)

            def known(first, last, part, starts, ends, before):
                given = batch.column(batch.schema.get_field_index(hits)).slice(first, last - first).to_pylist()
                return [(row, h["at"], h["n"], h["item"]) for row, hs in enumerate(given) for h in hs or []]

            rest = [i for i, f in enumerate(batch.schema) if f.name != hits]
            for first, last, out in _answers(texts, known if hits else look, remove):
                part = batch.slice(first, last - first)
                columns = [part.column(i) for i in rest] + [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.string()))]
                names = [batch.schema.names[i] for i in rest] + ["n_words", "n_hit", "items"]
                if remove:
                    same = part.column(batch.schema.get_field_index(text)).to_pylist()
                    columns.append(pa.array([t if o[3] is None else o[3] for t, o in zip(same, out, strict=True)], pa.string()))
                    names.append("clean_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)


def _mark_joined(kept: DataFrame, windows: DataFrame, count: int, text: str, remove: bool) -> DataFrame:
    """The same answers for any number of windows: bitmap screen, then an equi-join on hash, length and words."""
    spark = kept.sparkSession
    size = min(max((16 * count - 1).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.shiftrightunsigned("hash", 64 - size)
    bits = windows.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - size}) & 63 as int))")).alias("bits"))
    lengths = [r[0] for r in windows.select("n").distinct().collect()]
    words = bits.toArrow()  # at most 2**(MOST_BITS - 6) words
    shared = spark.sparkContext.broadcast(BitmapSet(lengths, size, words.column("at").to_numpy(), words.column("bits").to_numpy()))
    own, hit = unused("key", kept.columns), unused("hits", kept.columns)
    keyed = kept.withColumn(own, F.struct(F.xxhash64(F.col(text)), F.md5(F.coalesce(F.col(text), F.lit("")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = shared.value
        for batch in batches:
            for first, _, part, _, starts, ends, before in _slices_of(batch.column(1)):
                hashes = word_hashes(part, starts, ends)
                for n in screen.lengths:
                    grams = ngram_hashes(hashes, n)
                    at = screen.find(grams)
                    rows = np.searchsorted(before, at, side="right") - 1
                    inside = at + n <= before[rows + 1]
                    at, rows = at[inside], rows[inside]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows + first)), pa.array((at - before[rows]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(grams[at].view(np.int64)), pa.array([_row_words(part, starts, ends, int(a), n) for a in at], pa.binary())],
                        names=["key", "at", "n", "hash", "words"],
                    )

    texts = keyed.select(F.to_json(own).alias("key"), F.col(text).cast("string")).dropDuplicates(["key"])
    possible = texts.mapInArrow(run, "key string, at int, n int, hash long, words binary")
    hits = possible.join(windows, ["hash", "n", "words"]).groupBy("key").agg(F.collect_list(F.struct("at", "n", "item")).alias(hit))
    marked = keyed.withColumn(own, F.to_json(own)).join(hits.withColumnRenamed("key", own), own, "left").drop(own)
    return _mark(marked, None, hit, text, remove)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or (``mode="span"``) with the hit spans cut out of their texts.

    All columns pass through whatever their names.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"mode is 'document' or 'span', not {mode!r}")
    clashing = {c: unused(c, docs.columns) for c in docs.columns if c in ("n_words", "n_hit", "items", "clean_text")}
    marked = mark(docs.withColumnsRenamed(clashing), benchmark, n, text, remove=mode == "span")
    kept = marked.where("n_hit = 0") if mode == "document" else marked
    return kept.select(*[F.col("clean_text" if mode == "span" and c == text else clashing.get(c, c)).alias(c) for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, n)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
