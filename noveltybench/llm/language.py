"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language.  A text is parsed
from left to right into the longest phrases that occur in a language's sample;
phrases * log2(sample length) / characters estimates the cross entropy in bits
a character, and the language needing fewest normalised phrases wins.

Texts are lower-cased and each run of non-letters counts as one space.  Whole
texts are parsed: those of a group in step, longest first, as long as many last;
the rest of the longest ones character by character.

Fitting uses a bounded sample: for each language at most ROWS labelled rows
(those of smallest hash, rows with LEAST..ROW_CHARS characters first), ROW_CHARS
characters of each, SAMPLE_CHARS characters in all.

``keep_identified`` rejects on evidence only: a text goes if it has no letters,
or if it needs REJECT_RATIO times as many phrases as one half of the language's
own sample needs over the other half, by more than chance allows at its length.
So short texts and languages of large alphabets stay.

Defined cases: a null text or one without letters is ``und`` with score 0;
without any labelled row every text is ``und``; ties go to the first language
by name; rows are answered one by one, repeated rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.labelled import spread_ids
from noveltybench.llm.storage import unused, with_fields
from noveltybench.llm.textops import slices, text_buffer

ROWS = 48
LEAST, ROW_CHARS, SAMPLE_CHARS = 300, 1_500, 24_000
#: Bytes of text parsed together, and texts below which they are parsed one by one.
GROUP_CHARS, LANES = 1 << 22, 128
#: Cells of a language's transition table up to which it is flat (16 MB); larger ones are searched, with equal answers.
FLAT_CELLS = 1 << 22
#: Times the phrases of the language's own texts that make a text one of another language.
REJECT_RATIO = 3.0
ADDED = ["lang_pred", "score", "bits_per_char", "identified"]


class SuffixAutomaton:
    """All substrings of a text of small integers; ``next_of[state][code]`` is the state after one more code."""

    def __init__(self, codes: list[int]):
        self.next_of: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        nexts = self.next_of
        for c in codes:
            here = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = here
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[here] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[here] = copy
            last = here


class Parser:
    """Counts the phrases of texts of codes: 0 stands for all that occurs nowhere in the automaton's text."""

    def __init__(self, automaton: SuffixAutomaton, width: int):
        self.next_of, self.width, self.alone = automaton.next_of, width, len(automaton.next_of)
        # A character that occurs nowhere is a phrase of its own: whatever follows ends it.
        self.first = np.full(width, self.alone, np.int64)
        for c, s in self.next_of[0].items():
            self.first[c] = s
        self.flat = None
        if (self.alone + 1) * width <= FLAT_CELLS:
            self.flat = np.tile((self.first * 2 + 1).astype(np.int32), self.alone + 1)  # next state * 2, + 1 where a phrase ended
            self.flat[:width] -= 1
        edges = np.array([(state * width + c, s) for state, row in enumerate(self.next_of) for c, s in row.items()], np.int64).reshape(-1, 2)
        if self.flat is not None:
            self.flat[edges[:, 0]] = edges[:, 1] * 2
        else:
            order = np.argsort(edges[:, 0])
            self.keys, self.targets = np.append(edges[order, 0], -1), np.append(edges[order, 1], 0)

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase ended before each code)."""
        if self.flat is not None:
            moved = self.flat[state * self.width + codes]
            return moved >> 1, moved & 1
        keys = state * self.width + codes
        at = np.searchsorted(self.keys[:-1], keys)
        hit = self.keys[at] == keys
        return np.where(hit, self.targets[at], self.first[codes]), ~hit & (state != 0)

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text; a text without characters has none."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        long, starts = lengths[order], offsets[:-1][order]
        together = int(long[LANES - 1]) if len(long) >= LANES else min(1, int(long.max(initial=0)))
        active = len(long) - np.searchsorted(long[::-1], np.arange(together), side="right")
        state, count = np.zeros(len(long), np.int64), (long > 0).astype(np.int64)
        for t, m in enumerate(active.tolist()):
            state[:m], ended = self.step(state[:m], codes[starts[:m] + t])
            count[:m] += ended
        nexts, root, nowhere = self.next_of, self.next_of[0], {}
        for k in range(int((long > together).sum())):
            row, more = nexts[state[k]] if state[k] < self.alone else nowhere, 0
            for c in codes[starts[k] + together : starts[k] + long[k]].tolist():
                s = row.get(c)
                if s is None:
                    more += 1
                    s = root.get(c)
                row = nowhere if s is None else nexts[s]
            count[k] += more
        out = np.empty(len(long), np.int64)
        out[order] = count
        return out


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the texts in lower case, runs of non-letters as one space."""
    points = np.frombuffer("".join([t.lower().replace("\0", " ") + "\0" for t in texts]).encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    stop = points == 0
    keep = letter | stop
    keep[1:] |= letter[:-1]  # the first character after a letter: a space, or the end
    points = np.where(letter | stop, points, 32).astype(np.uint32)[keep]
    ends = np.flatnonzero(points == 0)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    lengths = ends - starts
    return points[points != 0], np.concatenate([[0], np.cumsum(lengths)])


class Model:
    """Parsers of the samples; made once in a worker."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in samples]
        self.samples = [normalise(text.split("\0")) for _, text in samples]
        self.alphabet = np.unique(np.concatenate([p for p, _ in self.samples])) if samples else np.zeros(0, np.uint32)
        self.code_of = np.zeros(0x110000, np.int32)
        self.code_of[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.parsers, self.weights = [], []
        for points, offsets in self.samples:
            parser, weight = self._parser(points, offsets)
            self.parsers.append(parser)
            self.weights.append(weight)
        self._rates: list[float] | None = None

    def _parser(self, points: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, Parser], float]:
        """(own code of each shared code, parser), bits of a phrase."""
        own = np.zeros(len(self.alphabet) + 1, np.int32)
        letters = np.unique(self.code_of[points])
        own[letters] = np.arange(1, len(letters) + 1)
        codes: list[int] = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            codes += own[self.code_of[points[a:b]]].tolist()
            codes.append(-1 - a)  # a mark of its own, so that no phrase runs across two rows
        automaton = SuffixAutomaton(codes[:-1])
        for row in automaton.next_of:
            for c in [c for c in row if c < 0]:
                del row[c]
        return (own, Parser(automaton, len(letters) + 1)), float(np.log2(max(len(codes), 2)))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, letters and spaces of each text)."""
        codes, lengths, at = [], [], 0
        while at < len(texts):  # normalised by a megabyte or one text at a time
            end, size = at, 0
            while end < len(texts) and (size < 1 << 20 or end == at):
                size += len(texts[end])
                end += 1
            points, offsets = normalise(texts[at:end])
            codes.append(self.code_of[points])
            lengths.append(np.diff(offsets))
            at = end
        shared = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        sizes = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for k, (own, parser) in enumerate(self.parsers):
            out[:, k] = parser.phrases(own[shared], offsets)
        return out, sizes

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a character by text and language, letters and spaces of each text)."""
        phrases, lengths = self.phrases(texts)
        return phrases * np.array(self.weights) / np.maximum(lengths, 1)[:, None], lengths

    def rates(self) -> np.ndarray:
        """Phrases a character that one half of each sample needs over the other half."""
        if self._rates is None:
            self._rates = []
            for points, offsets in self.samples:
                half = int(np.searchsorted(offsets, offsets[-1] / 2)) if len(offsets) > 2 else 0
                middle = int(offsets[half]) if half else len(points) // 2
                known, rest = points[:middle], points[middle:]
                (own, parser), _ = self._parser(known, np.array([0, len(known)]))
                count = parser.phrases(own[self.code_of[rest]], np.array([0, len(rest)]))
                self._rates.append(float(count[0]) / max(len(rest), 1))
        return np.array(self._rates)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, score, bits a character, whether the text is like that language) of each text."""
        if not self.languages:
            return [("und", 0.0, float("inf"), False)] * len(texts)
        phrases, lengths = self.phrases([t or "" for t in texts])
        bits = phrases * np.array(self.weights) / np.maximum(lengths, 1)[:, None]
        best = bits.argmin(axis=1)
        sharp = np.minimum(lengths, 200)[:, None] / 10
        score = 1 / np.exp(-(bits - bits.min(axis=1, keepdims=True)) * sharp).sum(axis=1)
        usual = self.rates()[best] * lengths
        alike = phrases[np.arange(len(texts)), best] <= REJECT_RATIO * usual + 4 * np.sqrt(usual) + 2
        return [
            (self.languages[b], float(s), float(row[b]), bool(a)) if n and t else ("und", 0.0, float("inf"), False)
            for b, s, row, a, n, t in zip(best.tolist(), score.tolist(), bits, alike.tolist(), lengths.tolist(), texts, strict=True)
        ]


@lru_cache(maxsize=2)
def load(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def sample(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """The bounded training sample, (language, texts joined by NUL) by language name, of rows that may be learned from."""
    usable = rows.where(F.col(lang).isNotNull() & (F.col(lang) != "und") & F.col(text).isNotNull() & F.col(key).isNotNull())
    other = (~F.length(text).between(LEAST, ROW_CHARS)).cast("string")
    named = usable.select(F.concat_ws("\0", F.col(lang).cast("string"), other).alias("by"), F.col(key).alias("key"))
    chosen = {}
    for place, (by, k) in enumerate(sorted(spread_ids(named, "key", "by", ROWS, 7), key=lambda r: (r[0].endswith("\0true"), r))):
        name = by.rpartition("\0")[0]
        if sum(n == name for n, _ in chosen) < ROWS:
            chosen.setdefault((name, k), place)
    if not chosen:
        return ()
    met = usable.where(F.col(key).isin(sorted({k for _, k in chosen})))
    one = F.min_by(F.substring(text, 1, ROW_CHARS), F.struct(F.xxhash64(text), F.col(text)))  # of rows that share an id and a language
    texts = met.groupBy(F.col(lang).cast("string"), key).agg(one).collect()
    by_lang: dict[str, dict] = {}
    for name, k, t in texts:
        if (name, k) in chosen:
            by_lang.setdefault(name, {})[chosen[name, k], k] = t
    out = []
    for name, found in sorted(by_lang.items()):
        kept, size = [], 0
        for _, t in sorted(found.items()):  # in the order of choice
            if size < SAMPLE_CHARS:
                kept.append(t.replace("\0", " "))
                size += len(t)
        out.append((name, "\0".join(kept)))
    return tuple(out)


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), bits_per_char and identified; columns of these names are replaced."""
    added = ADDED
    kept = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def answered(model: Model, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = model.predict([t for part in parts for t in part.column(part.schema.get_field_index(text)).to_pylist()])
        at = 0
        for part in parts:
            mine = got[at : at + part.num_rows]
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([g[i] for g in mine], kind) for i, kind in enumerate(kinds)]], names=[*part.schema.names, *added])
            at += part.num_rows

    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = load(shared.value), [], 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, last in slices(text_buffer(column)[1], GROUP_CHARS):
                held.append(batch.slice(first, last - first))
                size += column.slice(first, last - first).nbytes
                if size >= GROUP_CHARS:
                    yield from answered(model, held)
                    held, size = [], 0
        yield from answered(model, held)

    return kept.mapInArrow(run, with_fields(kept, ("lang_pred", "string"), ("score", "double"), ("bits_per_char", "double"), ("identified", "boolean")))


def held_out(key: str = "doc_id", mod: int = 4, rest: int = 2):
    return F.crc32(F.col(key).cast("string")) % mod == rest


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that aren't held out."""
    samples = sample(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, samples).select("doc_id", "held_out", "lang_pred", "score", "bits_per_char")


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Documents whose text is in one of the labelled languages, with that language in ``lang``; all others go.

    Other columns pass through whatever their names.
    """
    clashing = {c: unused(c, docs.columns) for c in docs.columns if c in ADDED}
    named = docs.withColumnsRenamed(clashing).withColumn(text, F.col(text).cast("string"))
    found = identify(named, sample(docs, text=text, lang=lang), text).where("identified")
    return found.select(*[(F.col("lang_pred") if c == lang else F.col(clashing.get(c, c))).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
