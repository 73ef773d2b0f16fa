"""URL filters: rules by host and path, and logistic regression on hashed character n-grams.

A rule (host and path, like ``example.net/en/``) fits its host and all subdomains where the url's path starts with the
rule's; the longest that fits decides.  Other urls are decided by a logistic regression on the presence of hashed runs of
GRAMS bytes of host and path, trained from a small labelled table of urls: at most ROWS distinct urls of either label
(those of smallest hash) of LONGEST bytes at most are learned from.  Every url is scored whole, in Arrow batches, in
bounded slices; rules are column expressions.

Defined cases: a null url, or one without ``://``, has neither host nor path, fits no rule and is scored by the
regression's offset alone; repeated urls are learned once and answered alike; with one label only, or none, the
regression allows.  Columns of the table that are named like results are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.labelled import spread_ids
from noveltybench.llm.storage import with_fields
from noveltybench.llm.textops import distinct, mix, slices, text_buffer

GRAMS, BITS, ROWS, LONGEST = (3, 4, 5), 18, 2_000, 4_096
#: The rules of the registered query: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[tuple[str, str], ...], what: int) -> Column:
    """The longest rule that fits (``what`` 0), or its verdict (1); null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # longer ones are tried first
        name, slash, rest = rule[0].partition("/")
        out = F.when(((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest)), F.lit(rule[what])).otherwise(out)
    return out


def grams(hosts: pa.Array, paths: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, rows, features): the distinct hashed n-grams of ``^host$`` and of the path."""
    sides = [text_buffer(hosts), text_buffer(paths)]
    total = sides[0][1] + sides[1][1]
    for first, last in slices(total):
        found = []
        for side, (data, offsets) in enumerate(sides):
            at = offsets[first : last + 1]
            part, at = data[at[0] : at[-1]], at - at[0]
            if side == 0:  # marks where a host begins and ends, so that a gram tells "net" at the end from "net" within
                marks = np.repeat(at[1:-1], 2)
                part = np.insert(part, np.concatenate([[0], marks, [at[-1]]]), np.tile(np.frombuffer(b"^$", np.uint8), last - first))
                at = at + 2 * np.arange(last - first + 1)
            packed = np.full(len(part), side + 1, np.uint64)
            for size in range(1, max(GRAMS) + 1):
                n = len(part) - size + 1
                if n <= 0:
                    break
                packed = (packed[:n] << np.uint64(8)) | part[size - 1 :]
                if size in GRAMS:
                    rows = np.searchsorted(at, np.arange(n), side="right") - 1
                    good = np.arange(n) + size <= at[rows + 1]
                    found.append(rows[good].astype(np.int64) << BITS | (mix(packed[good]) >> np.uint64(64 - BITS)).astype(np.int64))
        both = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
        yield first, last, both >> BITS, both & ((1 << BITS) - 1)


def logistic(rows: np.ndarray, features: np.ndarray, label: np.ndarray, ridge: float = 1e-3, steps: int = 200, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights by feature and offset of the logistic regression on presence of features, by Adam; labels count alike."""
    used, columns = np.unique(features, return_inverse=True)
    share = np.where(label, 0.5 / max(label.sum(), 1), 0.5 / max((~label).sum(), 1))
    w = np.zeros(len(used) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        f = np.bincount(rows, w[columns], minlength=len(label)) + w[-1]
        error = share * (1 / (1 + np.exp(-np.clip(f, -40, 40))) - label)
        g = np.append(np.bincount(columns, error[rows], minlength=len(used)) + ridge * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w[:-1]
    return weights, float(w[-1])


class UrlModel:
    """Probability of ``block``: weights of 2**BITS features, one megabyte."""

    def __init__(self, weights: np.ndarray | None, offset: float):
        self.weights, self.offset = weights, offset

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(hosts), self.offset)
        out = np.zeros(len(hosts))
        for first, last, rows, features in grams(hosts, paths):
            f = self.offset + np.bincount(rows, self.weights[features], minlength=last - first)
            out[first:last] = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        return out


def fit(labelled: DataFrame, url: str = "url", label: str = "block") -> UrlModel:
    """Fitted on a table of urls with a boolean label, true for those to block; null urls and labels are left out."""
    usable = labelled.where(F.octet_length(F.col(url)) <= LONGEST).select(F.col(url).cast("string").alias("url"), F.col(label).cast("boolean").alias("block"))
    chosen = spread_ids(usable, "url", "block", ROWS, 41)
    block = np.array([b for b, _ in chosen], bool)
    if not len(block) or block.all() or not block.any():
        return UrlModel(None, 0.0)
    parts = labelled.sparkSession.createDataFrame([(i, u) for i, (_, u) in enumerate(chosen)], "i long, url string")
    kept = parts.select("i", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).orderBy("i").toArrow()
    rows, features = [], []
    for first, _, r, f in grams(kept["host"].combine_chunks(), kept["path"].combine_chunks()):
        rows.append(first + r)
        features.append(f)
    return UrlModel(*logistic(np.concatenate(rows), np.concatenate(features), block))


def judge(df: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (null if none fits), verdict and score (the regression's probability of block)."""
    added = ["host", "path", "rule", "verdict", "score"]
    text = F.col(url).cast("string")
    parsed = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added or c == url], host_of(text).alias("__host"), path_of(text).alias("__path"))
    host, path = F.coalesce("__host", F.lit("")), F.coalesce("__path", F.lit(""))
    kept = [c for c in parsed.columns[:-2] if c.lower() not in added]
    ruled = parsed.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"), fitting(host, path, rules, 0).alias("rule"), fitting(host, path, rules, 1).alias("verdict"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(batch.num_columns - 4), batch.column(batch.num_columns - 3))
            verdict = pa.compute.coalesce(batch.column(batch.num_columns - 1), pa.array(np.where(scores > 0.5, "block", "allow").tolist(), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], verdict, pa.array(scores)], names=[*kept, *added])

    return ruled.mapInArrow(run, with_fields(ruled, ("score", "double")))


def ruled(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """url and block: the rows that a rule decides, as a labelled table."""
    text = F.col(url).cast("string")
    verdict = fitting(F.coalesce(host_of(text), F.lit("")), F.coalesce(path_of(text), F.lit("")), rules, 1)
    return df.select(text.alias("url"), (verdict == "block").alias("block")).where("block is not null")


def remove_blocked(df: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """Rows that are allowed, with the columns that ``judge`` adds."""
    return judge(df, model, rules, url).where("verdict = 'allow'")


def digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score; the labelled table are the pages that a rule decides."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return judge(rows, fit(ruled(rows))).select("page_id", "host", "path", "rule", "verdict", "score")
